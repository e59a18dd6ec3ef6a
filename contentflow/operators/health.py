"""Source health from the run log, due sources, fetch plan and the next-check schedule.

A run log is a fold per source in the reference semantics. Here it is a set of
aggregates: the failure streak is the number of failures after the last
success, the empty streak the number of empty successes after the last one
that was not empty. Both combine before the shuffle, so a source that holds a
third of the log is summed by every map task instead of replayed by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.operators.ranking import ranked

# --- fixed values -----------------------------------------------------------
PAUSE_AFTER = 5
REVIEW_AFTER_EMPTY = 3
RETRY_BASE_MS = 5 * 60_000
RETRY_MAX_MS = 6 * 60 * 60_000
MIN_INTERVAL_MINUTES = 5
DEFAULT_INTERVAL_MINUTES = 30
DEFAULT_SPREAD_MINUTES = 31
JITTER = 0.1
DUE_STATUSES = ["active", "error"]
INTERVALS = [30, 60, 120, 240, 720, 1440]
# ---------------------------------------------------------------------------

FAILURE, SUCCESS, EMPTY = "failure", "success", "empty"
# An empty success after which the source needs its rule reviewed.
WARNING = "warning"


def portable_hash(text: Column) -> Column:
    """First 32 bits of the MD5 of a text; the same number in any engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def retry_delay(failures: Column) -> Column:
    doubled = F.lit(RETRY_BASE_MS) * F.pow(F.lit(2.0), F.least(F.greatest(failures - 1, F.lit(0)), F.lit(30)))
    return F.least(F.lit(RETRY_MAX_MS).cast("double"), doubled).cast("bigint")


def refresh_delay(source_id: Column, checked_at: Column, interval_minutes: Column) -> Column:
    """Interval with up to ten per cent of jitter either way, drawn from a hash of source and time."""
    draw = portable_hash(F.concat_ws(":", source_id, checked_at.cast("string")))
    wave = F.pmod(draw, F.lit(2001)).cast("double") / 1000 - 1
    jitter = F.floor(interval_minutes * JITTER * wave + 0.5)
    chosen = F.greatest(F.lit(MIN_INTERVAL_MINUTES), interval_minutes + jitter)
    default = F.lit(DEFAULT_INTERVAL_MINUTES) + F.pmod(draw, F.lit(DEFAULT_SPREAD_MINUTES))
    minutes = F.when(F.coalesce(interval_minutes, F.lit(0)) == 0, default).otherwise(chosen)
    return (minutes * 60_000).cast("bigint")


def next_check(source_id: Column, checked_at: Column, interval_minutes: Column) -> Column:
    return checked_at + refresh_delay(source_id, checked_at, interval_minutes)


def run_marks(runs: DataFrame, key: list[str] = ["source_id"]) -> DataFrame:  # noqa: B006
    """Per key: the last run, the last success and the last success with rows."""
    ok = F.col("outcome") != FAILURE
    full = F.col("outcome") == SUCCESS
    order = F.struct("created_at", "id")
    return runs.groupBy(*key).agg(
        F.max_by(F.struct("outcome", "message", "created_at", "id"), order).alias("last"),
        F.max(F.when(ok, order)).alias("last_ok"),
        F.max(F.when(full, order)).alias("last_full"),
    )


def run_streaks(runs: DataFrame, marks: DataFrame, key: list[str] = ["source_id"]) -> DataFrame:  # noqa: B006
    """Failures after the last success and empty runs after the last full one."""
    order = F.struct("created_at", "id")
    # Compare (created_at, id) pairs; a source that never had a success counts every run.
    after_ok = F.col("last_ok").isNull() | (order > F.col("last_ok"))
    after_full = F.col("last_full").isNull() | (order > F.col("last_full"))
    slim = runs.where(F.col("outcome") != SUCCESS).select(*key, "outcome", "created_at", "id")
    marked = slim.join(marks.select(*key, "last_ok", "last_full"), key)
    return marked.groupBy(*key).agg(
        F.count_if((F.col("outcome") == FAILURE) & after_ok).alias("failures"),
        F.count_if(F.col("outcome").isin(EMPTY, WARNING) & after_full).alias("empties"),
    )


def run_summary(runs: DataFrame, key: list[str] = ["source_id"]) -> DataFrame:  # noqa: B006
    """Streaks and last run per source, or per source and part of the log.

    ``runs`` needs ``source_id, outcome (failure | empty | success), message, created_at, id``.
    An unchanged (not modified) answer and an empty but healthy one count as ``success``.
    """
    marks = run_marks(runs, key)
    return marks.join(run_streaks(runs, marks, key), key, "left").select(
        *key,
        F.col("last.outcome").alias("last_outcome"),
        F.col("last.message").alias("last_message"),
        F.col("last.created_at").alias("last_at"),
        F.col("last.id").alias("last_id"),
        F.col("last_ok").isNotNull().alias("seen_ok"),
        F.col("last_full").isNotNull().alias("seen_full"),
        F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"),
        F.coalesce("empties", F.lit(0)).cast("bigint").alias("empties"),
    )


def combine_summaries(stored: DataFrame, fresh: DataFrame, key: list[str] = ["source_id"]) -> DataFrame:  # noqa: B006
    """Summary of a log from the summaries of its older and its newer part.

    This is what makes the fold incremental: a newer part with a success
    restarts the streak, one without extends it.
    """
    o, n = stored.alias("o"), fresh.alias("n")
    newer = F.col("n.last_at").isNotNull()

    def last(name: str) -> Column:
        return F.when(newer, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name)

    def streak(name: str, reset: str) -> Column:
        restarted = F.coalesce(F.col(f"n.{reset}"), F.lit(False))
        older = F.when(restarted, F.lit(0)).otherwise(F.coalesce(F.col(f"o.{name}"), F.lit(0)))
        return (older + F.coalesce(F.col(f"n.{name}"), F.lit(0))).cast("bigint").alias(name)

    def seen(name: str) -> Column:
        return (F.coalesce(F.col(f"o.{name}"), F.lit(False)) | F.coalesce(F.col(f"n.{name}"), F.lit(False))).alias(name)

    return o.join(n, key, "full_outer").select(
        *key,
        last("last_outcome"),
        last("last_message"),
        last("last_at"),
        last("last_id"),
        seen("seen_ok"),
        seen("seen_full"),
        streak("failures", "seen_ok"),
        streak("empties", "seen_full"),
    )


def fold_segments(segments: DataFrame) -> DataFrame:
    """Summary per source from the summaries of the segments of its log, in whatever order they were made.

    A streak is what the last segment with a success has after it, and all of
    the segments behind that one; both are sums, so a source with very many
    segments leaves each map task as one row.
    """
    marks = segments.groupBy("source_id").agg(
        F.max_by(F.struct("last_outcome", "last_message", "last_at", "last_id"), "segment").alias("last"),
        F.max(F.when(F.col("seen_ok"), F.col("segment"))).alias("ok"),
        F.max(F.when(F.col("seen_full"), F.col("segment"))).alias("full"),
    )
    slim = segments.select("source_id", "segment", "failures", "empties").join(marks.select("source_id", "ok", "full"), "source_id")
    from_ok = F.col("ok").isNull() | (F.col("segment") >= F.col("ok"))
    from_full = F.col("full").isNull() | (F.col("segment") >= F.col("full"))
    sums = slim.groupBy("source_id").agg(
        F.sum(F.when(from_ok, F.col("failures")).otherwise(0)).alias("failures"), F.sum(F.when(from_full, F.col("empties")).otherwise(0)).alias("empties")
    )
    return marks.join(sums, "source_id").select(
        "source_id", "last.*", F.col("ok").isNotNull().alias("seen_ok"), F.col("full").isNotNull().alias("seen_full"), "failures", "empties"
    )


def health_of(summary: DataFrame, sources: DataFrame) -> DataFrame:
    """Status, streaks and next check of every source that has run."""
    dimension = sources.select(F.col("id").alias("source_id"), "kind", "polling_enabled", "refresh_interval_minutes")
    failed = F.col("last_outcome") == FAILURE
    paused = failed & (F.col("failures") >= PAUSE_AFTER)
    review = ~failed & (F.col("kind") == "generic") & (F.col("empties") >= REVIEW_AFTER_EMPTY)
    status = (
        F.when(paused, F.lit("paused"))
        .when(failed, F.lit("error"))
        .when(review, F.lit("needs_review"))
        .otherwise(F.lit("active"))
    )
    retry = F.when(~paused, F.col("last_at") + retry_delay(F.col("failures")))
    scheduled = F.when(
        ~review & F.col("polling_enabled"), next_check(F.col("source_id"), F.col("last_at"), F.col("refresh_interval_minutes"))
    )
    return summary.join(dimension, "source_id").select(
        "source_id",
        status.alias("status"),
        F.col("failures").alias("failure_count"),
        F.col("empties").alias("consecutive_empty"),
        F.when(failed, F.col("last_message")).alias("last_error"),
        F.col("last_at").alias("last_checked_at"),
        F.when(failed, retry).otherwise(scheduled).alias("next_check_at"),
    )


def after_run(sources: DataFrame, outcomes: DataFrame, as_of: int) -> DataFrame:
    """Health of the sources that ran once more, from the counters stored with them.

    ``outcomes`` has one row per source: ``source_id, outcome, message``. A
    failure adds to the failures and leaves the empty streak; an empty success
    adds to that, any other ends it, and every success ends the failures.
    """
    failed, empty = F.col("outcome") == FAILURE, F.col("outcome") == EMPTY
    stored = sources.select(F.col("id").alias("source_id"), F.coalesce("failure_count", F.lit(0)).alias("before"), F.coalesce("consecutive_empty", F.lit(0)).alias("bare"))
    summary = outcomes.join(stored, "source_id").select(
        "source_id",
        F.col("outcome").alias("last_outcome"),
        F.col("message").alias("last_message"),
        F.lit(as_of).cast("bigint").alias("last_at"),
        F.when(failed, F.col("before") + 1).otherwise(0).alias("failures"),
        F.when(failed, F.col("bare")).when(empty, F.col("bare") + 1).otherwise(0).alias("empties"),
    )
    return health_of(summary, sources)


def source_health(runs: DataFrame, sources: DataFrame) -> DataFrame:
    return health_of(run_summary(runs), sources)


def due_sources(sources: DataFrame, as_of: int) -> DataFrame:
    due = F.col("polling_enabled") & F.col("status").isin(DUE_STATUSES) & (F.col("next_check_at") <= F.lit(as_of))
    return sources.where(due).orderBy("next_check_at", "id")


def fetch_plan(due: DataFrame, host: Column, lanes: int = 2) -> DataFrame:
    """Place of every due source in its host's serial queue, and the lane of that host.

    One host may own a third of the sources, all due at one instant, so a
    queue is not ranked in one task (see ``ranking``).
    """
    queued = ranked(due.withColumn("host", host), ["host"], [F.col("next_check_at"), F.col("id")], "wave")
    return queued.select(
        F.col("id").alias("source_id"),
        "host",
        "wave",
        F.pmod(portable_hash(F.col("host")), F.lit(lanes)).cast("bigint").alias("lane"),
        "next_check_at",
    )


def latest_runs(runs: DataFrame, source_id: str | None = None, limit: int = 100) -> DataFrame:
    """Newest runs, of one source or of all; a top-k, never a full sort."""
    rows = runs.where(F.col("source_id") == source_id) if source_id else runs
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def run_totals(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source_id", "outcome").agg(
        F.count("*").alias("runs"),
        F.sum("fetched_count").alias("fetched"),
        F.sum("inserted_count").alias("inserted"),
    )
