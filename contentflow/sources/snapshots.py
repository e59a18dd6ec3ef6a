"""Versioned library tables on shared storage that grow by what a batch changes.

A table is a set of Parquet parts, each partitioned by a hash of the merge key:
a base, and changes on top of it. A batch writes the rows it changed, not the
table, and looks up what it needs in the buckets its keys fall into. Readers
take the newest row of every key. Changes are merged in tiers, eight small
parts into a larger one, and folded into a new base when they have grown to a
share of it, so a row is rewritten a few times however many batches follow.

A version becomes current when its commit record appears, a file that only one
writer can create; it names all parts of all tables, so loading reads one
record. Readers never see half a merge, and a replayed batch is recognised by
its run. Parts of older versions are left for a lifecycle rule of the store.
"""

from __future__ import annotations

import dataclasses
import json
import re
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentflow.schemas import ORIGIN_KEY, TABLES, State, columns, empty_state
from contentflow.sources import files

# The merge key of every table. None of them repeats, so no bucket can be larger than
# its share, however many origins an entry or runs a source has.
KEYS = {
    "sources": ["id"],
    "entries": ["canonical_url"],
    "entry_origins": ORIGIN_KEY,
    "dismissed": ["canonical_identity"],
    "subscriptions": ["source_id"],
    "checkpoints": ["subscription_id"],
    "maintenance": ["source_id"],
    "followees": ["url_token"],
    "runs": ["id"],
    "seen": ["source_id", "url"],
}
#: Parts of one tier that are merged into one of the next, and the share of its base at which changes are folded in.
FANOUT, SHARE = 8, 0.5
#: Changed rows below which a table is not folded for their share alone.
SMALL = 100_000
#: Commit records in one folder, so that finding the newest lists two short folders.
FOLDER = 1000
BASE, CHANGED, ADDED = "base", "changed", "added"
PARTS = "version bigint, table string, run string, path string, kind string, tier int, rows bigint"


class Conflict(RuntimeError):
    """Another writer committed the version first; load again and redo the batch."""


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def numbered(run: str) -> tuple[str, int] | None:
    """Name and number of a run ``name-number``; the runs of one name are committed in order."""
    found = re.fullmatch(r"(.*)-(\d+)", run)
    return (found[1], int(found[2])) if found else None


@dataclasses.dataclass(frozen=True)
class Library:
    """A folder of library versions. ``buckets`` is per table, fixed when its base is written; without it, the session's shuffle partitions."""

    spark: SparkSession
    root: str
    buckets: int | None = None

    def _record(self, version: int) -> str:
        return f"{self.root}/commits/{version // FOLDER:09d}/{version:012d}.json"

    def version(self) -> int | None:
        """Newest committed version."""
        for folder in reversed(files.names(self.spark, f"{self.root}/commits")):
            if records := files.names(self.spark, f"{self.root}/commits/{folder}"):
                return int(records[-1].removesuffix(".json"))
        return None

    def commit(self, version: int | None = None) -> dict:
        """The record of a version, the newest by default: its tables and the runs committed so far."""
        version = self.version() if version is None else version
        if version is None:
            return {"version": None, "run": None, "done": {}, "runs": [], "tables": {}}
        for _ in range(50):
            try:
                return json.loads(files.content(self.spark, self._record(version)))
            except json.JSONDecodeError:  # created on a remote store, not written to its end yet
                time.sleep(0.2)
        raise Conflict(f"version {version} is not complete")

    def commits(self) -> DataFrame:
        """The parts of the newest version, with the version and run that wrote them."""
        parts = [(p["version"], name, p["run"], p["path"], p["kind"], p["tier"], p["rows"]) for name, t in self.commit()["tables"].items() for p in t["parts"]]
        return self.spark.createDataFrame(parts, PARTS)

    def has_run(self, run: str) -> bool:
        """Whether a run has been committed; a replayed one then has nothing to do."""
        record, found = self.commit(), numbered(run)
        return record["done"].get(found[0], -1) >= found[1] if found else run in record["runs"]

    # --- reading ---

    def _part(self, name: str, part: dict, only: list[int] | None) -> DataFrame:
        rows = self.spark.read.schema(f"{TABLES[name]}, gone boolean, bucket int").parquet(part["path"])
        return rows if only is None else rows.where(F.col("bucket").isin(only))

    def _changes(self, name: str, parts: list[dict], only: list[int] | None = None) -> DataFrame:
        """Newest change of every key, with ``gone`` for removed ones."""
        marked = [self._part(name, p, only).drop("bucket").withColumn("version", F.lit(p["version"])) for p in parts]
        if len(marked) == 1:
            return marked[0].drop("version")
        names = [*columns(TABLES[name]), "gone"]
        values = [c for c in names if c not in KEYS[name]]
        last = F.max_by(F.struct(*values), "version").alias("last")
        return reduce(DataFrame.unionByName, marked).groupBy(*KEYS[name]).agg(last).select(*KEYS[name], "last.*").select(*names)

    def _current(self, name: str, table: dict, only: list[int] | None = None) -> DataFrame:
        stored = [self._part(name, p, only) for p in table["parts"] if p["kind"] != CHANGED]
        changed = [p for p in table["parts"] if p["kind"] == CHANGED]
        names = columns(TABLES[name])
        rows = reduce(DataFrame.unionByName, stored).select(*names) if stored else self.spark.createDataFrame([], TABLES[name])
        if not changed:
            return rows
        changes = self._changes(name, changed, only)
        return rows.join(changes.select(*KEYS[name]), KEYS[name], "left_anti").select(*names).unionByName(changes.where("NOT gone").select(*names))

    def load(self, version: int | None = None) -> State:
        """Tables as of a version, the newest by default; one never written is empty."""
        tables = self.commit(version)["tables"]
        return empty_state(self.spark).with_tables(**{name: self._current(name, table) for name, table in tables.items()})

    def lookup(self, version: int | None = None) -> Callable[[str, DataFrame], DataFrame]:
        """``stored(name, keys)``: the rows of a version with the given keys, read from the buckets these fall into."""
        tables = self.commit(version)["tables"]

        def stored(name: str, keys: DataFrame) -> DataFrame:
            if name not in tables:
                return self.spark.createDataFrame([], TABLES[name])
            key = KEYS[name]
            # Numbers of buckets, of which there are as many as the table has.
            touched = [r[0] for r in keys.select(bucket_of(key, tables[name]["buckets"]).alias("b")).distinct().collect()]
            return self._current(name, tables[name], touched).join(keys.select(*key).distinct(), key, "left_semi")

        return stored

    # --- writing ---

    def _written(self, name: str, rows: DataFrame, kind: str, version: int, run: str, buckets: int, tier: int = 0) -> dict:
        path = f"{self.root}/{name}/{version:012d}-{kind}-{uuid.uuid4().hex}"
        if "gone" not in rows.columns:
            rows = rows.withColumn("gone", F.lit(False))
        placed = rows.select(*columns(TABLES[name]), "gone", bucket_of(KEYS[name], buckets).alias("bucket"))
        # Rows of a bucket meet in few files; a bucket beyond the advisory size is split among tasks.
        placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", *KEYS[name]).write.partitionBy("bucket").parquet(path)
        return {"path": path, "version": version, "run": run, "kind": kind, "tier": tier, "rows": self.spark.read.schema("bucket int").parquet(path).count()}

    def publish(
        self,
        run: str,
        added: dict[str, DataFrame] | None = None,
        changed: dict[str, DataFrame] | None = None,
        removed: dict[str, DataFrame] | None = None,
        based_on: int | None = None,
        **tables: DataFrame,
    ) -> int:
        """Commit the next version; tables not named keep their parts.

        A table given whole is replaced. ``changed`` rows replace those with
        their keys, which must not repeat among them; ``removed`` holds keys to
        take out; ``added`` rows of a log have keys never used before.
        ``based_on`` is the version the rows were made from, the current one by
        default. Whoever commits after another has taken the next version gets
        a ``Conflict``, and nothing of it is read.
        """
        record = self.commit(self.version() if based_on is None else based_on)
        version = (record["version"] or 0) + 1
        default = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        after = dict(record["tables"])
        parts = [(BASE, name, rows) for name, rows in tables.items()] + [(ADDED, name, rows) for name, rows in (added or {}).items()]
        for name in {**(changed or {}), **(removed or {})}:
            rows = (changed or {}).get(name)
            if name in (removed or {}):
                gone = removed[name].select(*KEYS[name]).withColumn("gone", F.lit(True))
                rows = gone if rows is None else rows.withColumn("gone", F.lit(False)).unionByName(gone, allowMissingColumns=True)
                rows = self.spark.createDataFrame([], f"{TABLES[name]}, gone boolean").unionByName(rows, allowMissingColumns=True)
            parts.append((CHANGED if name in after else BASE, name, rows))
        def write(part: tuple[str, str, DataFrame]) -> dict:
            kind, name, rows = part
            if kind == BASE and "gone" in rows.columns:
                rows = rows.where("NOT gone")
            buckets = default if name in tables or name not in after else after[name]["buckets"]
            return {**self._written(name, rows, kind, version, run, buckets), "buckets": buckets}

        # The tables are independent: their jobs run side by side.
        with ThreadPoolExecutor(max(1, len(parts))) as pool:
            made = list(pool.map(write, parts))
        for (kind, name, _), part in zip(parts, made, strict=True):
            buckets = part.pop("buckets")
            before = [] if kind == BASE else after.get(name, {"parts": []})["parts"]
            after[name] = {"buckets": buckets, "parts": before + ([part] if part["rows"] or not before else [])}
        return self._commit(record, version, run, after)

    def _commit(self, record: dict, version: int, run: str, tables: dict) -> int:
        found = numbered(run)
        done = {**record["done"], found[0]: max(found[1], record["done"].get(found[0], -1))} if found else record["done"]
        runs = record["runs"] if found else [*record["runs"], run]
        text = json.dumps({"version": version, "run": run, "done": done, "runs": runs, "tables": tables})
        if not files.created(self.spark, self._record(version), text):
            raise Conflict(f"version {version} is taken")
        return version

    def compact(self, fanout: int = FANOUT, share: float = SHARE) -> int | None:
        """Merge tiers that are full and fold changes that have grown to a share of their base; the version made, if any was due."""
        record = self.commit()
        version = (record["version"] or 0) + 1
        after, run = dict(record["tables"]), f"compact-{version}"
        for name, table in record["tables"].items():
            parts = table["parts"]
            total = {kind: sum(p["rows"] for p in parts if p["kind"] == kind) for kind in (BASE, CHANGED, ADDED)}
            changed = [p for p in parts if p["kind"] == CHANGED]
            # Tables that are small altogether wait until a tier is full.
            grown = total[CHANGED] >= share * (total[BASE] + total[ADDED]) and (total[CHANGED] >= SMALL or len(changed) >= fanout)
            if changed and grown:
                parts = [self._written(name, self._current(name, table), BASE, version, run, table["buckets"])]
            else:
                for kind in (CHANGED, ADDED):
                    tiers = {p["tier"] for p in parts if p["kind"] == kind}
                    for tier in sorted(tiers):
                        full = [p for p in parts if p["kind"] == kind and p["tier"] == tier]
                        if len(full) >= fanout:
                            rows = self._changes(name, full) if kind == CHANGED else reduce(DataFrame.unionByName, [self._part(name, p, None).drop("bucket") for p in full])
                            merged = self._written(name, rows, kind, version, run, table["buckets"], tier + 1)
                            # What it holds is as old as the newest of them: later changes still come after it.
                            merged["version"] = max(p["version"] for p in full)
                            parts = [p for p in parts if p not in full] + [merged]
            after[name] = {**table, "parts": parts}
        return None if after == record["tables"] else self._commit(record, version, run, after)


def write_report(report: DataFrame, path: str) -> None:
    """Audit and refresh reports as JSON lines."""
    report.write.mode("overwrite").json(path)
