"""Documents in buckets that ask hash partitions about what they hold.

An operator that must know which of a document's many pieces occur elsewhere
would shuffle a row per piece. Here the texts are shuffled once into buckets by
id. A bucket sends each hash partition one packed, sorted set of distinct
hashes; the partition compares the sets of all buckets and answers each with
the part that matters to it; the answer meets the bucket's texts again. A piece
that is in a third of all documents is sent once per bucket, so no partition
receives more of it than there are buckets. Plans read the text exchange
several times; Spark runs it once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets per shuffle partition: hashing them evens out the partitions and keeps one bucket small.
PER_PARTITION = 4
#: Stands for a missing id inside the buckets, where a null would turn ids into floats; orders after all others.
NO_ID = (1 << 63) - 1


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_buckets(spark) -> int:
    return max(32, PER_PARTITION * partitions(spark))


def even_labels(spark, each: int) -> list[int]:
    """Bucket numbers of which Spark's hash partitioning puts exactly so many into every shuffle partition."""
    count = partitions(spark)
    tried = count * (each + 4)
    while True:
        label = F.col("id").cast("int")
        placed = spark.range(tried).groupBy(F.pmod(F.hash(label), F.lit(count))).agg(F.slice(F.sort_array(F.collect_list(label)), 1, each).alias("labels")).collect()
        if len(placed) == count and all(len(r["labels"]) == each for r in placed):
            return sorted(x for r in placed for x in r["labels"])
        tried *= 2


def placed(docs: DataFrame, key: str = "doc_id", text: str = "text", each: int | None = None) -> DataFrame:
    """(bucket, doc_id, text): the bucket each row belongs to, rows not moved yet."""
    spark = docs.sparkSession
    spread = F.when(F.col(key).isNull(), F.xxhash64(F.col(text))).otherwise(F.xxhash64(F.col(key)))
    if each:
        labels = even_labels(spark, each)
        bucket = F.get(F.array(*[F.lit(x) for x in labels]), F.pmod(spread, F.lit(len(labels))).cast("int"))
    else:
        bucket = F.pmod(spread, F.lit(n_buckets(spark))).cast("int")
    return docs.select(bucket.alias("bucket"), F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.col(text).cast("string").alias("text"))


def bucketed(docs: DataFrame, key: str = "doc_id", text: str = "text", each: int | None = None) -> DataFrame:
    """(bucket, doc_id, text): all rows of an id in one bucket; rows without an id spread by their text.

    ``each`` asks for exactly so many buckets in every partition, for operators
    that want few of them.
    """
    return placed(docs, key, text, each).repartition(partitions(docs.sparkSession), "bucket")


def restored(rows: DataFrame) -> DataFrame:
    """Rows made from buckets, with missing ids null again."""
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def texts(rows: pd.DataFrame) -> tuple[pd.DataFrame, list[bytes]]:
    """A bucket's rows in order of id and text, and the encoded texts."""
    rows = rows.assign(text=rows["text"].fillna("")).sort_values(["doc_id", "text"], kind="stable", ignore_index=True)
    return rows, [t.encode("utf-8", "surrogatepass") for t in rows["text"]]


def split(part: np.ndarray, *columns: np.ndarray):
    """Slices of columns by the runs of a sorted partition number."""
    if len(part):
        edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        for a, b in zip(edges, edges[1:], strict=False):
            yield int(part[a]), *(c[a:b] for c in columns)


def asked(buckets: DataFrame, emit: Callable[[int, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows (part, bucket, …) that every bucket sends; parts are numbered below ``partitions``."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return emit(int(key[0]), rows)

    return buckets.groupBy("bucket").applyInPandas(run, f"part int, bucket int, {schema}")


def answered(sent: DataFrame, decide: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What each part makes of all rows sent to it. A part is a shuffle partition, so parts are as even as hashes are."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if rows:
            yield decide(pd.concat(rows, ignore_index=True))

    return sent.repartitionById(partitions(sent.sparkSession), F.col("part")).mapInPandas(run, schema)


def met(buckets: DataFrame, answers: DataFrame, finish: Callable[[int, pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What the buckets make of their texts and the answers."""

    def run(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return finish(int(key[0]), rows, answers)

    return buckets.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(run, schema)
