"""What a new batch of fetches really brings: changed documents, current sources, newer ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.functions import text

# --- fixed values -----------------------------------------------------------
FEED_REVISION = 4
# ---------------------------------------------------------------------------


def fingerprint() -> Column:
    """Validator of a fetched document: entity tag, else modification date, else a hash of the body."""
    return F.coalesce(text.blank_to_null(F.col("etag")), text.blank_to_null(F.col("last_modified")), F.sha2("text", 256))


def changed_fetches(raw: DataFrame, seen: DataFrame, key: tuple[str, ...] = ("url",)) -> DataFrame:
    """Fetches whose fingerprint is not the last one seen under their key."""
    marked = raw.withColumn("fingerprint", fingerprint())
    known = [*key, "fingerprint"]
    return marked.where(F.col("status") != 304).join(seen.select(*known), known, "left_anti")


def replayed_fetches(raw: DataFrame, seen: DataFrame, sources: DataFrame, revision: int = FEED_REVISION, key: tuple[str, ...] = ("url",)) -> DataFrame:
    """Changed fetches, plus every fetch of a source whose items an older parser read."""
    stale = sources.where(~F.col("metadata_revision").eqNullSafe(F.lit(revision))).select(F.col("id").alias("source_id"))
    marked = raw.withColumn("fingerprint", fingerprint()).where(F.col("status") != 304)
    known = [*key, "fingerprint"]
    replay = marked.join(stale, "source_id", "left_semi")
    rest = marked.join(stale, "source_id", "left_anti").join(seen.select(*known), known, "left_anti")
    return replay.unionByName(rest.select(*replay.columns))


def last_seen(raw: DataFrame, seen: DataFrame, key: tuple[str, ...] = ("url",)) -> DataFrame:
    """Newest fingerprint per key after a batch."""
    fresh = raw.where(F.col("status") != 304).withColumn("fingerprint", fingerprint()).select(*key, "fingerprint", "seq")
    older = seen.select(*key, "fingerprint", F.lit(-1).cast("bigint").alias("seq"))
    return fresh.unionByName(older).groupBy(*key).agg(F.max_by("fingerprint", "seq").alias("fingerprint"))


def binding(sources: DataFrame) -> DataFrame:
    """(source_id, kind, connector, rule): what the results of a fetch depend on; the rule only of web sources, as a hash."""
    rule = F.when(F.col("kind") == "generic", F.coalesce("extraction_rule", F.lit("null"))).otherwise(F.lit(""))
    return sources.select(F.col("id").alias("source_id"), "kind", F.coalesce("connector_id", "kind").alias("connector"), F.md5(rule).alias("rule"))


def current_sources(read_from: DataFrame, sources: DataFrame) -> DataFrame:
    """``source_id`` of the sources that still exist with the binding they were read with."""
    return binding(read_from).join(binding(sources), ["source_id", "kind", "connector", "rule"], "left_semi").select("source_id")


def still_current(batch: DataFrame, read_from: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows whose source still exists with the kind, connector and, for web sources, the rule it was read with."""
    return batch.join(current_sources(read_from, sources), "source_id", "left_semi")


def _number(column: str) -> Column:
    return F.col(column).try_cast("decimal(38,0)")


def increment(posts: DataFrame, since: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts newer than their author's cursor, and the cursors after them.

    ``posts`` needs ``author_id, post_id``; ``since`` holds ``author_id,
    since_id``. Ids are numbers in text and compared as such. The cursor moves
    over every post read, also those a later filter drops.
    """
    known = since.select("author_id", "since_id")
    fresh = posts.join(known, "author_id", "left").where(F.col("since_id").isNull() | (_number("post_id") > _number("since_id"))).drop("since_id")
    newest = fresh.select("author_id", F.col("post_id").alias("since_id")).unionByName(known)
    after = newest.groupBy("author_id").agg(F.max_by("since_id", _number("since_id")).alias("since_id"))
    return fresh, after


def latest_id(since: DataFrame) -> DataFrame:
    return since.agg(F.max_by("since_id", _number("since_id")).alias("since_id"))
