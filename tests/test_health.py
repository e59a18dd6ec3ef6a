import random

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from contentflow import schemas
from contentflow.operators import health
from contentflow.session import scratch_path
from contentflow.streaming.health import fold_batch, read_summary, source_health_stream


def made_runs(seed, sources=6, n=200):
    rng = random.Random(seed)
    names = ["hot"] * 3 + [f"s{i}" for i in range(sources)]
    return [(f"{i:05d}", rng.choice(names), rng.choice(["failure", "failure", "empty", "empty", "success"]), 1, 1, f"m{i}", i // 2) for i in range(n)]


def kinds(spark, names):
    return fx.sources(spark, *[dict(id=n, kind="generic" if n in ("hot", "s1", "s2") else "rss", polling_enabled=n != "s3") for n in names])


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.RUNS)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_streaks_equal_a_replay(spark, seed):
    rows = made_runs(seed)
    names = sorted({r[1] for r in rows})
    got = fx.as_dicts(health.source_health(frame(spark, rows), kinds(spark, names)), "source_id")
    for name in names:
        outcomes = [r[2] for r in sorted(rows, key=lambda r: (r[6], r[0])) if r[1] == name]
        want = fx.sequential_health(outcomes, "generic" if name in ("hot", "s1", "s2") else "rss")
        row = got[name]
        assert (row["status"], row["failure_count"], row["consecutive_empty"]) == want
        assert (row["next_check_at"] is None) == (row["status"] in ("paused", "needs_review") or (row["status"] == "active" and name == "s3"))


def test_backoff(spark):
    rows = spark.createDataFrame([(1,), (2,), (20,)], "n int").select(health.retry_delay(F.col("n")).alias("d")).collect()
    assert [r["d"] for r in rows] == [300_000, 600_000, 21_600_000]


def test_refresh_delay_stays_in_bounds(spark):
    rows = spark.range(300).select(
        health.refresh_delay(F.col("id").cast("string"), F.lit(5), F.lit(60)).alias("a"),
        health.refresh_delay(F.col("id").cast("string"), F.lit(5), F.lit(None).cast("int")).alias("b"),
        health.refresh_delay(F.col("id").cast("string"), F.lit(5), F.lit(3)).alias("c"),
    ).collect()
    assert {r["a"] // 60_000 for r in rows} == set(range(54, 67))
    assert {r["b"] // 60_000 for r in rows} == set(range(30, 61))
    assert {r["c"] for r in rows} == {300_000}


def test_fetch_plan_positions(spark):
    rng = random.Random(5)
    rows = [(f"s{i:03d}", rng.choice(["hot", "hot", "hot", "h1", "h2"]), rng.randrange(400_000)) for i in range(150)]
    due = spark.createDataFrame(rows, "id string, host string, next_check_at bigint")
    got = {r["source_id"]: r["wave"] for r in health.fetch_plan(due, F.col("host")).collect()}
    for host in ("hot", "h1", "h2"):
        ordered = sorted((r for r in rows if r[1] == host), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in ordered] == list(range(1, len(ordered) + 1))


def test_incremental_fold_equals_one_pass_and_counts_late_runs(spark):
    rows = made_runs(9, n=160)
    stored = read_summary(spark, "", -1).drop("batch")
    for lo in range(0, 160, 40):
        stored = spark.createDataFrame(fold_batch(stored, frame(spark, rows[lo : lo + 40])).collect(), stored.schema)
    whole = {r["source_id"]: r for r in health.run_summary(frame(spark, rows)).collect()}
    for row in stored.collect():
        for name in ("last_id", "failures", "empties", "seen_ok", "seen_full", "last_outcome"):
            assert row[name] == whole[row["source_id"]][name]
        assert row["late"] == 0
    late = fold_batch(stored, frame(spark, rows[:10]))
    assert sum(r["late"] for r in late.collect()) == 10
    assert {(r["source_id"], r["failures"], r["last_id"]) for r in late.collect()} == {(r["source_id"], r["failures"], r["last_id"]) for r in stored.collect()}


def test_stream_equals_batch_over_several_files(spark):
    rows = made_runs(11, n=90)
    random.Random(1).shuffle(rows)  # many runs arrive late
    root = scratch_path(spark, "health-test")
    names = sorted({r[1] for r in rows})
    got = None
    for lo in (0, 30, 60):  # one landed file per run of the stream
        frame(spark, rows[lo : lo + 30]).coalesce(1).write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(schemas.RUNS).option("maxFilesPerTrigger", 1).parquet(f"{root}/landing")
        running = source_health_stream(stream, f"{root}/state", f"{root}/checkpoint")
        running.awaitTermination()
        got = health.health_of(read_summary(spark, f"{root}/state/summary", lo // 30), kinds(spark, names))
    want = health.source_health(frame(spark, rows), kinds(spark, names))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
