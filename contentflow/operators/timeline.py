"""Timeline reads: range filter, order, limits, per-source views, nested origins, counts."""

from __future__ import annotations

import datetime as dt
import math
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.operators.ranking import ranked
from contentflow.schemas import write_through

VIEWS = ("all", "today", "unread", "favorite")
TIMELINE_KEYS = ("published_at", "observed_at", "created_at")


def timeline_ts() -> Column:
    return F.coalesce(*[F.col(c) for c in TIMELINE_KEYS])


def _bound(compare, keys: tuple[str, ...] = TIMELINE_KEYS) -> Column:
    """``coalesce(keys) <op> bound`` spelt with plain comparisons, which reach the parquet scan."""
    head, rest = F.col(keys[0]), keys[1:]
    return compare(head) | (head.isNull() & _bound(compare, rest)) if rest else compare(head)


def finite(value: float | None) -> bool:
    return value is not None and math.isfinite(value)


def in_range(start_at: float | None, end_at: float | None) -> Column:
    """Half-open range on the timeline instant; a bound that is not finite is ignored."""
    test = F.lit(True)
    if finite(start_at) and finite(end_at) and end_at <= start_at:
        return F.lit(False)
    if finite(start_at):
        test = test & _bound(lambda c: c >= F.lit(start_at))
    if finite(end_at):
        test = test & _bound(lambda c: c < F.lit(end_at))
    return test


def timeline_order() -> list[Column]:
    """Dated rows first, newest first; note that this is not the key the range filter uses."""
    return [
        F.col("published_at").isNull().asc(),
        F.col("published_at").desc(),
        F.col("observed_at").desc(),
        F.col("created_at").desc(),
        F.col("id").asc(),
    ]


def whole_limit(limit: float | None) -> int | None:
    """A row count of at least one; none for a limit that is no number."""
    return max(1, math.floor(limit)) if finite(limit) else None


def check_arguments(limit=None, start_at=None, end_at=None) -> None:
    """Reject arguments a caller must not pass; the query itself clamps instead."""
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 1000):
        raise ValueError("limit must be an integer from 1 to 1000")
    for name, value in (("start_at", start_at), ("end_at", end_at)):
        if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value < 0):
            raise ValueError(f"{name} must be a finite instant of at least 0")
    if start_at is not None and end_at is not None and start_at >= end_at:
        raise ValueError("start_at must be before end_at")


def of_source(entries: DataFrame, origins: DataFrame, source_id: str) -> DataFrame:
    """Entries a source owns or has been seen in: one scan of each table, existence join on the id."""
    seen = origins.alias("seen").where(
        (F.col("seen.source_id") == source_id) & (F.col("seen.entry_id") == F.col("entry.id").outer())
    )
    return entries.alias("entry").where((F.col("entry.source_id") == source_id) | seen.exists())


def timeline(
    entries: DataFrame,
    origins: DataFrame,
    source_id: str | None = None,
    start_at: float | None = None,
    end_at: float | None = None,
    limit: float | None = None,
) -> DataFrame:
    rows = of_source(entries, origins, source_id) if source_id else entries
    ordered = rows.where(in_range(start_at, end_at)).orderBy(*timeline_order())
    bounded = whole_limit(limit)
    return ordered.limit(bounded) if bounded else ordered


def day_bounds(as_of: int, tz: str = "UTC") -> tuple[int, int]:
    """First instant of the local day holding ``as_of`` and of the day after."""
    zone = ZoneInfo(tz)
    day = dt.datetime.fromtimestamp(as_of / 1000, zone).date()

    def start(date: dt.date) -> int:
        return int(dt.datetime(date.year, date.month, date.day, tzinfo=zone).timestamp() * 1000)

    return start(day), start(day + dt.timedelta(days=1))


def library_view(
    entries: DataFrame, origins: DataFrame, view: str, source_id: str | None, as_of: int, tz: str = "UTC", limit: int | None = None
) -> DataFrame:
    """One of the four library views, whole or its first ``limit`` rows; flags are filtered before the sort, not after it."""
    if view not in VIEWS:
        raise ValueError(f"unknown view {view}")
    if view == "today":
        start, end = day_bounds(as_of, tz)
        return timeline(entries, origins, source_id, start, end, limit)
    if view == "unread":
        return timeline(entries.where(~F.col("is_read")), origins, limit=limit)
    if view == "favorite":
        return timeline(entries.where("is_favorite"), origins, source_id, limit=limit)
    return timeline(entries, origins, source_id, limit=limit)


def library_counts(entries: DataFrame, as_of: int, tz: str = "UTC") -> DataFrame:
    start, end = day_bounds(as_of, tz)
    return entries.agg(
        F.count_if(~F.col("is_read")).alias("unread"),
        F.count_if(F.col("is_favorite")).alias("favorite"),
        F.count_if(in_range(start, end)).alias("today"),
    )


#: Origins of an entry in one array.
PART_LENGTH = 10_000


def nest_origins(origins: DataFrame, per_row: int = PART_LENGTH) -> DataFrame:
    """Origins as arrays per entry, oldest first, none longer than ``per_row``.

    Entries are counted first. One with more origins has several rows (``part``
    0, 1, …), each the next slice in time; its origins are ranked by range
    partitions, so no task ever holds them all.
    """
    hit = F.struct(
        "observed_at", "source_id", "provider_id", "external_id", "provider_label", "original_url"
    )
    nested = F.sort_array(F.collect_list(hit)).alias("origins")

    def whole(rows: DataFrame) -> DataFrame:
        return rows.groupBy("entry_id").agg(nested).select("entry_id", F.lit(1).alias("parts"), F.lit(0).alias("part"), "origins")

    counts = origins.groupBy("entry_id").agg(F.count("*").alias("n")).where(F.col("n") > per_row)
    hot = write_through(counts.select("entry_id", F.ceil(F.col("n") / per_row).cast("int").alias("parts")), "hot-entries")
    if hot.isEmpty():
        return whole(origins)
    order = [F.col(c) for c in ("observed_at", "source_id", "provider_id", "external_id", "provider_label", "original_url")]
    placed = ranked(origins.join(hot.select("entry_id"), "entry_id", "left_semi"), ["entry_id"], order).withColumn("part", F.floor((F.col("rank") - 1) / per_row).cast("int"))
    sliced = placed.groupBy("entry_id", "part").agg(nested).join(hot, "entry_id").select("entry_id", "parts", "part", "origins")
    return whole(origins.join(hot.select("entry_id"), "entry_id", "left_anti")).unionByName(sliced)


def with_origins(entries: DataFrame, origins: DataFrame) -> DataFrame:
    """Entries with their nested origins; an entry without any gets an empty array."""
    wanted = origins.join(entries.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
    nested = nest_origins(wanted).withColumnRenamed("entry_id", "id")
    joined = entries.join(nested, "id", "left")
    empty = F.array().cast(nested.schema["origins"].dataType)
    return joined.withColumns(
        {
            "origins": F.coalesce("origins", empty),
            "part": F.coalesce("part", F.lit(0)),
            "parts": F.coalesce("parts", F.lit(1)),
        }
    )


def with_source(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Dimension lookup of the owning source; entries of a vanished source stay."""
    dimension = sources.select(
        F.col("id").alias("source_id"),
        F.col("title").alias("source_title"),
        F.coalesce("connector_id", "kind").alias("source_connector"),
    )
    return entries.join(dimension, "source_id", "left")


def other_providers(entries: DataFrame, origins: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct providers of an entry other than its source's own connector, one row each."""
    owner = with_source(entries.select("id", "source_id"), sources).select(
        F.col("id").alias("entry_id"), "source_connector"
    )
    seen = origins.select("entry_id", F.coalesce(F.nullif("provider_label", F.lit("")), "provider_id").alias("provider")).distinct()
    return seen.join(owner, "entry_id").where(~F.col("provider").eqNullSafe(F.col("source_connector"))).select(
        "entry_id", "provider"
    )


def by_id(rows: DataFrame, value: str, column: str = "id") -> DataFrame:
    """Point lookup; an equality on the stored column, so it prunes files and row groups."""
    return rows.where(F.col(column) == value)
