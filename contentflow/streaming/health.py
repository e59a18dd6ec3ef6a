"""Source health over a stream of runs: summaries of micro-batches folded into a written state.

The log is cut into segments of time, each with a summary per source. Runs in
order extend the stored summary of their source and of their segment without
reading anything older. A run that arrives late changes its own segment only:
that segment's part of the log is read again, and the source's summary is
folded anew from its segments, one short row each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contentflow.operators.health import combine_summaries, fold_segments, run_summary
from contentflow.sources.files import names

SUMMARY = """source_id string, last_outcome string, last_message string, last_at bigint, last_id string,
 seen_ok boolean, seen_full boolean, failures bigint, empties bigint, late bigint, batch bigint"""
SEGMENT = """source_id string, last_outcome string, last_message string, last_at bigint, last_id string,
 seen_ok boolean, seen_full boolean, failures bigint, empties bigint, segment bigint, batch bigint"""
#: Length of a segment: what one late run makes a batch read again.
SEGMENT_MS = 24 * 3600 * 1000


def read_summary(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """Summary after ``batch``; nothing before the first one."""
    if batch < 0:
        return spark.createDataFrame([], SUMMARY)
    return spark.read.schema(SUMMARY).parquet(f"{path}/batch={batch}").withColumn("batch", F.lit(batch).cast("bigint"))


def placed(runs: DataFrame, stored: DataFrame) -> DataFrame:
    """Runs with ``is_late``: not newer than the stored last run of their source."""
    mark = stored.select("source_id", F.struct("last_at", "last_id").alias("last"))
    late = F.struct(F.col("created_at").alias("last_at"), F.col("id").alias("last_id")) <= F.col("last")
    return runs.join(mark, "source_id", "left").withColumn("is_late", F.coalesce(late, F.lit(False))).drop("last")


def fold_batch(stored: DataFrame, runs: DataFrame, summed_again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """State after one more micro-batch.

    The streaks that late runs belong to are closed, so the summaries of their
    sources come from ``summed_again``, which is given those sources; without
    it late runs are only counted.
    """
    marked = placed(runs, stored)
    late = marked.where("is_late").groupBy("source_id").agg(F.count("*").alias("more"))
    older = stored.select("source_id", F.col("late").alias("before"))
    folded = combine_summaries(stored, run_summary(marked.where(~F.col("is_late")).select(*runs.columns)))
    if summed_again is not None:
        folded = folded.join(late, "source_id", "left_anti").unionByName(summed_again(late.select("source_id")))
    counted = folded.join(older, "source_id", "left").join(late, "source_id", "left")
    total = (F.coalesce("before", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("bigint")
    return counted.withColumn("late", total).drop("before", "more")


def segment_of(created_at: Column) -> Column:
    return F.floor(created_at / SEGMENT_MS)


class SegmentedLog:
    """The runs of a stream and the summaries of its segments, below one folder, by segment and micro-batch."""

    def __init__(self, spark: SparkSession, path: str, run_schema: str) -> None:
        self.spark, self.path, self.run_schema = spark, path, run_schema

    def _write(self, rows: DataFrame, table: str, batch: int) -> None:
        # A batch owns its partitions: written again after a failure, it replaces them and no others.
        marked = rows.withColumn("batch", F.lit(batch).cast("bigint"))
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment", "batch").parquet(f"{self.path}/{table}")

    def _read(self, table: str, schema: str, segments: list[int] | None) -> DataFrame:
        if segments is not None and not segments:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/{table}"] if segments is None else [f"{self.path}/{table}/segment={s}" for s in segments]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*folders)

    def add(self, runs: DataFrame, batch: int) -> list[int]:
        """Write a batch of runs; the segments it falls into, one for each stretch of time in it."""
        rows = runs.withColumn("segment", segment_of(F.col("created_at")))
        self._write(rows, "log", batch)
        return sorted(r[0] for r in rows.select("segment").distinct().collect())

    def runs(self, segments: list[int], batch: int) -> DataFrame:
        """Runs of these segments up to a batch, each once."""
        rows = self._read("log", f"{self.run_schema}, segment bigint, batch bigint", segments)
        return rows.where(F.col("batch") <= batch).dropDuplicates(["id"])

    def batch(self, segments: list[int], batch: int) -> DataFrame:
        return self._read("log", f"{self.run_schema}, segment bigint, batch bigint", segments).where(F.col("batch") == batch).drop("batch")

    def summaries(self, segments: list[int] | None, batch: int) -> DataFrame:
        """Newest summary of every (source, segment) before or after a batch; of all segments if none are named."""
        rows = self._read("segments", SEGMENT, segments).where(F.col("batch") <= batch)
        values = [c for c in rows.columns if c not in ("source_id", "segment", "batch")]
        last = F.max_by(F.struct(*values), "batch").alias("last")
        return rows.groupBy("source_id", "segment").agg(last).select("source_id", "segment", "last.*")

    def extend(self, marked: DataFrame, touched: list[int], batch: int) -> None:
        """Bring the summaries of a batch's (source, segment) pairs up to date: in-order runs extend them, late ones make them anew."""
        key = ["source_id", "segment"]
        late = marked.where("is_late")
        pairs = late.select(*key).distinct()
        fresh = run_summary(marked.where(~F.col("is_late")), key)
        known = self._existing(touched)
        stored = self.summaries(known, batch - 1).join(marked.select(*key).distinct(), key, "left_semi")
        extended = combine_summaries(stored, fresh, key).join(pairs, key, "left_anti")
        reread = sorted(r[0] for r in late.select("segment").distinct().collect())
        again = run_summary(self.runs(reread, batch).join(pairs, key, "left_semi"), key)
        self._write(extended.unionByName(again), "segments", batch)

    def _existing(self, segments: list[int]) -> list[int]:
        """Of the named segments those with summaries."""
        have = {int(n.split("=")[1]) for n in names(self.spark, f"{self.path}/segments") if n.startswith("segment=")}
        return [s for s in segments if s in have]


def source_health_stream(runs: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Keep the summary of every source current below ``state_path``, one folder per micro-batch.

    A batch writes its runs to the log and reads the summary of the batch
    before it; everything it writes is its own, so a replay after a failure
    gives the same result.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema)
        log = SegmentedLog(spark, state_path, kinds)
        touched = log.add(batch, number)
        own = log.batch(touched, number)
        stored = read_summary(spark, f"{state_path}/summary", number - 1).drop("batch")
        marked = placed(own, stored)
        log.extend(marked, touched, number)

        def summed_again(sources: DataFrame) -> DataFrame:
            return fold_segments(log.summaries(None, number).join(sources, "source_id", "left_semi"))

        anything_late = not marked.where("is_late").isEmpty()
        after = fold_batch(stored, own.drop("segment"), summed_again if anything_late else None)
        after.write.mode("overwrite").parquet(f"{state_path}/summary/batch={number}")

    return runs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
