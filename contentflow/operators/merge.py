"""Merging a batch of entries into a snapshot: fold by key, tombstone filter, upsert.

Rows are folded with algebraic aggregates before the shuffle, so a canonical
URL that holds a third of a batch still leaves every map task as one row. Both
sides of the merge join are then unique on the key, which leaves no skew.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow import schemas
from contentflow.schemas import ENTRIES, ORIGIN_KEY, ORIGINS, State

# Set when a row is first inserted, never touched by a later one.
INSERT_ONLY = ["id", "source_id", "original_url", "observed_at", "created_at"]
# Always taken from the newest row.
OVERWRITTEN = ["title", "content_hash"]
# Newest value that is not null.
FILLED = [
    "author",
    "published_at",
    "summary",
    "image_url",
    "provider_id",
    "provider_label",
    "external_id",
    "canonical_identity",
]
USER_STATE = ["is_read", "is_favorite"]


def last_known(column: str, order: Column) -> Column:
    """Newest non-null value; a plain ``max_by`` would return a trailing null."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), order))


def fold_entries(batch: DataFrame) -> DataFrame:
    """What upserting the batch row by row in ``seq`` order leaves per canonical URL."""
    order = F.col("seq")
    first = F.min_by(F.struct(*INSERT_ONLY), order).alias("first")
    last = F.max_by(F.struct(*OVERWRITTEN), order).alias("last")
    filled = [last_known(name, order).alias(name) for name in FILLED]
    folded = batch.where(F.col("canonical_url").isNotNull()).groupBy("canonical_url").agg(first, last, *filled)
    return folded.select("canonical_url", "first.*", "last.*", *FILLED)


def fold_origins(batch: DataFrame, key: list[str]) -> DataFrame:
    """Newest observation per origin key, label filled from the newest known one."""
    last = F.max_by(F.struct("original_url", "observed_at"), F.col("seq")).alias("last")
    label = last_known("provider_label", F.col("seq")).alias("provider_label")
    return batch.groupBy(*key).agg(last, label).select(*key, "provider_label", "last.*")


def without_dismissed(batch: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Rows whose identity the user has not dismissed; identity falls back to the canonical URL."""
    identified = batch.withColumn("canonical_identity", F.coalesce("canonical_identity", "canonical_url"))
    return identified.join(dismissed.select("canonical_identity"), "canonical_identity", "left_anti")


@dataclasses.dataclass(frozen=True)
class MergeResult:
    state: State
    inserted: DataFrame  # canonical URLs that were new, with the source that brought them


@dataclasses.dataclass(frozen=True)
class Changes:
    entries: DataFrame
    entry_origins: DataFrame
    inserted: DataFrame


#: The stored rows of a table that may have the given keys.
Stored = Callable[[str, DataFrame], DataFrame]


def upsert_entries(snapshot: DataFrame, folded: DataFrame) -> DataFrame:
    """Full outer join on the canonical URL; existing rows keep their identity and user state."""
    old, new = snapshot.alias("o"), folded.alias("n")
    joined = old.join(new, "canonical_url", "full_outer")
    known = F.col("o.id").isNotNull()
    kept = [F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in INSERT_ONLY]
    replaced = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in OVERWRITTEN + FILLED]
    flags = [F.coalesce(F.col(f"o.{c}"), F.lit(False)).alias(c) for c in USER_STATE]
    return joined.select("canonical_url", *kept, *replaced, *flags).select(*schemas.columns(ENTRIES))


def upsert_origins(snapshot: DataFrame, folded: DataFrame) -> DataFrame:
    old, new = snapshot.alias("o"), folded.alias("n")
    joined = old.join(new, ORIGIN_KEY, "full_outer")
    values = [
        F.coalesce(F.col("n.provider_label"), F.col("o.provider_label")).alias("provider_label"),
        F.coalesce(F.col("n.original_url"), F.col("o.original_url")).alias("original_url"),
        F.coalesce(F.col("n.observed_at"), F.col("o.observed_at")).alias("observed_at"),
    ]
    return joined.select(*ORIGIN_KEY, *values).select(*schemas.columns(ORIGINS))


def merged_rows(batch: DataFrame, stored: Stored, folded_as: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Changes:
    """The rows that upserting normalised entries and their provenance makes of the stored ones.

    With ``stored`` rows of the batch's keys only, these are the changed rows;
    with whole tables, the tables after the batch. ``folded_as`` may write the
    folded batch, which is read several times.
    """
    identified = batch.withColumn("canonical_identity", F.coalesce("canonical_identity", "canonical_url"))
    live = without_dismissed(batch, stored("dismissed", identified.select("canonical_identity")))
    folded = folded_as(fold_entries(live))
    known = stored("entries", folded.select("canonical_url"))
    seen = live.withColumn("external_id", F.coalesce("external_id", F.lit("")))
    per_url = fold_origins(seen, ["canonical_url", "source_id", "provider_id", "external_id"])
    # An entry keeps the id it was stored with; only a new URL gets the hashed one.
    ids = known.select("canonical_url", F.col("id").alias("stored_id"))
    origins = (
        per_url.join(ids, "canonical_url", "left")
        .withColumn("entry_id", F.coalesce("stored_id", F.sha2(F.col("canonical_url"), 256)))
        .drop("stored_id", "canonical_url")
    )
    inserted = folded.select("canonical_url", "source_id").join(known.select("canonical_url"), "canonical_url", "left_anti")
    return Changes(upsert_entries(known, folded), upsert_origins(stored("entry_origins", origins), origins), inserted)


def merge_entries(state: State, batch: DataFrame) -> MergeResult:
    """Upsert normalised entries and their provenance into the state."""
    after = merged_rows(batch, lambda name, keys: getattr(state, name))
    return MergeResult(state.with_tables(entries=after.entries, entry_origins=after.entry_origins), after.inserted)


def upsert_by_key(snapshot: DataFrame, changes: DataFrame, key: str, order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Newest change per key overwrites the row; columns in ``keep`` stay as first stored."""
    names = snapshot.columns
    values = [c for c in names if c != key]
    folded = changes.groupBy(key).agg(F.max_by(F.struct(*values), F.col(order)).alias("last")).select(key, "last.*")
    hit = F.col("n._new").isNotNull()
    stored = F.col("o._old").isNotNull()
    joined = snapshot.withColumn("_old", F.lit(True)).alias("o").join(
        folded.withColumn("_new", F.lit(True)).alias("n"), key, "full_outer"
    )
    chosen = [
        F.when(hit & ~(stored & F.lit(c in keep)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values
    ]
    return joined.select(key, *chosen).select(*names)


def merge_followees(state: State, batch: DataFrame) -> State:
    return state.with_tables(followees=upsert_by_key(state.followees, batch, "url_token", "seq"))


def upsert_subscriptions(state: State, batch: DataFrame) -> State:
    """One subscription per source: settings are overwritten, id and creation time stay."""
    return state.with_tables(
        subscriptions=upsert_by_key(state.subscriptions, batch, "source_id", "seq", keep=("id", "created_at"))
    )


def save_checkpoints(state: State, batch: DataFrame) -> State:
    return state.with_tables(checkpoints=upsert_by_key(state.checkpoints, batch, "subscription_id", "seq"))


def first_by_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """First occurrence per key in ``order``; an aggregate, so it combines before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.min_by(F.struct(*others), F.col(order)).alias("first"))
    return picked.select(*key, "first.*").select(*rows.columns)


def distinct_in_order(*parts: DataFrame, key: str, order: str) -> DataFrame:
    """Union of ordered lists, each value once, at the position it is first seen.

    Parts come one after the other: a value of an earlier part precedes every later part.
    """
    tagged = [part.select(F.col(key), F.lit(i).alias("part"), F.col(order).alias("pos")) for i, part in enumerate(parts)]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other)
    return (
        union.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(F.struct("part", "pos")).alias("at"))
        .select(key, "at.part", "at.pos")
    )
