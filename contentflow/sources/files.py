"""Small files that the driver itself reads and creates: the commit records of a library.

Spark's writers have no way to create a file only if nobody else has, which is
what makes a commit exclusive. A local or mounted path is linked into place by
the operating system; any other file system is asked through the session's
Hadoop client, whose ``create`` without overwriting is atomic on HDFS and on
stores with conditional puts.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession


def local_path(path: str) -> str | None:
    """The path for the operating system, where the file system is a local or mounted one."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        return None
    return unquote(parts.path) if parts.scheme else path


def _hadoop(spark: SparkSession, path: str):
    # Needs a session with a driver JVM of its own; Spark Connect has none.
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    if (local := local_path(folder)) is not None:
        return sorted(n for n in (os.listdir(local) if os.path.isdir(local) else []) if not n.startswith("."))
    _, where, files = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def content(spark: SparkSession, path: str) -> str:
    if (local := local_path(path)) is not None:
        with open(local, encoding="utf-8") as file:
            return file.read()
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this content; false, and nothing changed, if there is one."""
    if (local := local_path(path)) is not None:
        folder = os.path.dirname(local)
        os.makedirs(folder, exist_ok=True)
        draft = f"{folder}/.{uuid.uuid4().hex}"
        with open(draft, "x", encoding="utf-8") as file:
            file.write(text)
        try:
            os.link(draft, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    jvm, where, files = _hadoop(spark, path)
    try:
        stream = files.create(where, False)
    except Exception:  # the client names the cause differently per file system
        if files.exists(where):
            return False
        raise
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    return True
