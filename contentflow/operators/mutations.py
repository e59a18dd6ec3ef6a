"""Merge-style changes of the library: user actions, source removal, settings, backfill."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow import schemas
from contentflow.functions import text, urls
from contentflow.operators.health import INTERVALS, next_check
from contentflow.operators.merge import first_by_key
from contentflow.schemas import ENTRIES, State

PUBLIC_KINDS = ["rss", "generic", "manual"]


def _ids(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.select(F.col(column).alias(name)).distinct()


def reassign_owner(entries: DataFrame, remaining: DataFrame, ownerless: DataFrame) -> DataFrame:
    """Give entries whose owner goes (``ownerless``: distinct ``id``) to their earliest remaining origin.

    The heir is an aggregate per entry, ties go to the smaller source id.
    Everything is keyed by the entry id, so the entries are shuffled once.
    """
    heirs = (
        remaining.withColumnRenamed("entry_id", "id")
        .join(ownerless, "id", "left_semi")
        .groupBy("id")
        .agg(F.min_by("source_id", F.struct("observed_at", "source_id")).alias("heir"))
    )
    return (
        entries.join(heirs, "id", "left").withColumn("source_id", F.coalesce("heir", "source_id")).select(*schemas.columns(ENTRIES))
    )


def delete_origin_rows(state: State, matches: DataFrame) -> State:
    """Take matched ``(entry_id, source_id)`` pairs out; shared entries survive with another owner."""
    pairs = matches.select("entry_id", "source_id").distinct()
    remaining = state.entry_origins.join(pairs, ["entry_id", "source_id"], "left_anti")
    named = pairs.withColumnRenamed("entry_id", "id")
    ownerless = state.entries.select("id", "source_id").join(named, ["id", "source_id"], "left_semi").select("id")
    owned = reassign_owner(state.entries, remaining, ownerless)
    orphans = _ids(pairs, "entry_id", "entry_id").join(remaining.select("entry_id"), "entry_id", "left_anti")
    entries = owned.join(orphans.withColumnRenamed("entry_id", "id"), "id", "left_anti")
    return state.with_tables(entries=entries.select(*schemas.columns(ENTRIES)), entry_origins=remaining)


def remove_source_content(state: State, source_ids: DataFrame) -> State:
    """Drop the origins of the given sources (column ``source_id``), then sweep every orphan."""
    ids = source_ids.select("source_id").distinct()
    remaining = state.entry_origins.join(ids, "source_id", "left_anti").select(*state.entry_origins.columns)
    ownerless = state.entries.select("id", "source_id").join(ids, "source_id", "left_semi").select("id")
    owned = reassign_owner(state.entries, remaining, ownerless)
    entries = owned.join(remaining.select(F.col("entry_id").alias("id")), "id", "left_semi")
    return state.with_tables(entries=entries.select(*schemas.columns(ENTRIES)), entry_origins=remaining)


def delete_sources(state: State, source_ids: DataFrame) -> State:
    """Remove sources with everything that hangs on them; followees go with a Q&A account source."""
    ids = source_ids.select("source_id").distinct()
    doomed = state.sources.join(ids.withColumnRenamed("source_id", "id"), "id", "left_semi")
    cleaned = remove_source_content(state, ids)
    dead_subscriptions = state.subscriptions.join(ids, "source_id", "left_semi")
    account_gone = doomed.where(F.col("kind") == "zhihu").select(F.lit(True).alias("gone")).limit(1)
    return cleaned.with_tables(
        sources=state.sources.join(ids.withColumnRenamed("source_id", "id"), "id", "left_anti").select(*state.sources.columns),
        subscriptions=state.subscriptions.join(ids, "source_id", "left_anti").select(*state.subscriptions.columns),
        checkpoints=state.checkpoints.join(
            dead_subscriptions.select(F.col("id").alias("subscription_id")), "subscription_id", "left_anti"
        ),
        maintenance=state.maintenance.join(ids, "source_id", "left_anti"),
        runs=state.runs.join(ids, "source_id", "left_anti").select(*state.runs.columns),
        followees=state.followees.withColumn("gone", F.lit(True)).join(F.broadcast(account_gone), "gone", "left_anti").drop("gone"),
    )


def reset_sources(state: State, rules: DataFrame, as_of: int) -> State:
    """A corrected rule ``(source_id, extraction_rule)``: the source is healthy again and replays its content."""
    cleaned = remove_source_content(state, rules)
    change = rules.select(F.col("source_id").alias("id"), F.col("extraction_rule").alias("new_rule"))
    now = F.lit(as_of).cast("bigint")
    hit = F.col("new_rule").isNotNull()

    def changed(column: str, value: Column) -> Column:
        return F.when(hit, value).otherwise(F.col(column))

    sources = state.sources.join(change, "id", "left").withColumns(
        {
            "extraction_rule": F.coalesce("new_rule", "extraction_rule"),
            "status": changed("status", F.lit("active")),
            "consecutive_empty": changed("consecutive_empty", F.lit(0)),
            "next_check_at": changed("next_check_at", now),
            "updated_at": changed("updated_at", now),
        }
    )
    return cleaned.with_tables(sources=sources.select(*state.sources.columns))


def replace_rules(state: State, rules: DataFrame, as_of: int) -> State:
    """An automatically repaired rule; content, read state and schedule stay."""
    change = rules.select(F.col("source_id").alias("id"), F.col("extraction_rule").alias("new_rule"))
    now = F.lit(as_of).cast("bigint")
    sources = state.sources.join(change, "id", "left").withColumns(
        {
            "extraction_rule": F.coalesce("new_rule", "extraction_rule"),
            "updated_at": F.when(F.col("new_rule").isNotNull(), now).otherwise(F.col("updated_at")),
        }
    )
    return state.with_tables(sources=sources.select(*state.sources.columns))


def apply_actions(state: State, actions: DataFrame, as_of: int) -> State:
    """Replay a user action log ``(entry_id, action, value, seq)``; per entry and action the latest wins.

    ``action`` is ``read``, ``favorite`` or ``dismiss``. A dismissed entry
    leaves a tombstone on its identity and disappears.
    """
    order = F.col("seq")

    def latest(action: str) -> Column:
        return F.max_by("value", F.when(F.col("action") == action, order)).alias(action)

    folded = actions.groupBy(F.col("entry_id").alias("id")).agg(
        latest("read"), latest("favorite"), F.bool_or(F.col("action") == "dismiss").alias("dismissed")
    )
    joined = state.entries.join(folded, "id", "left")
    gone = F.coalesce("dismissed", F.lit(False))
    entries = joined.where(~gone).withColumns(
        {"is_read": F.coalesce("read", "is_read"), "is_favorite": F.coalesce("favorite", "is_favorite")}
    )
    tombstones = (
        joined.where(gone)
        .select(F.coalesce(text.blank_to_null(F.col("canonical_identity")), F.col("canonical_url")).alias("canonical_identity"))
        .distinct()
        .withColumn("dismissed_at", F.lit(as_of).cast("bigint"))
    )
    older = state.dismissed.join(tombstones.select("canonical_identity"), "canonical_identity", "left_anti")
    dead = joined.where(gone).select(F.col("id").alias("entry_id"))
    return state.with_tables(
        entries=entries.select(*schemas.columns(ENTRIES)),
        entry_origins=state.entry_origins.join(dead, "entry_id", "left_anti").select(*state.entry_origins.columns),
        dismissed=older.unionByName(tombstones),
    )


def register_sources(state: State, inputs: DataFrame, as_of: int) -> State:
    """Add new sources; a URL that exists keeps its source, among new ones the first wins.

    ``inputs`` carries ``seq, url, title, category, kind, connector_id, account_id, config_json,
    status, extraction_rule, polling_enabled, refresh_interval_minutes``.
    """
    now = F.lit(as_of).cast("bigint")
    fresh = first_by_key(inputs, ["url"], "seq").join(state.sources.select("url"), "url", "left_anti")
    created = fresh.select(
        F.sha2("url", 256).alias("id"),
        "url",
        "title",
        F.lit(None).cast("string").alias("icon_url"),
        text.category_label(F.col("category")).alias("category"),
        "kind",
        F.coalesce("connector_id", "kind").alias("connector_id"),
        "account_id",
        "config_json",
        F.coalesce("status", F.lit("active")).alias("status"),
        "extraction_rule",
        F.lit(None).cast("int").alias("metadata_revision"),
        "polling_enabled",
        "refresh_interval_minutes",
        F.lit(None).cast("string").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.lit(None).cast("bigint").alias("last_checked_at"),
        F.when(F.col("polling_enabled"), now).alias("next_check_at"),
        F.lit(0).alias("consecutive_empty"),
        F.lit(0).alias("failure_count"),
        F.lit(None).cast("string").alias("last_error"),
        now.alias("created_at"),
        now.alias("updated_at"),
    ).where(~text.category_too_long(F.col("category")))
    target = F.when(F.get_json_object("config_json", "$.targetId") != "", F.get_json_object("config_json", "$.targetId"))
    subscriptions = created.select(
        "id",
        F.col("id").alias("source_id"),
        "connector_id",
        "account_id",
        target.alias("target_id"),
        F.coalesce("config_json", F.lit("{}")).alias("config_json"),
        "created_at",
        "updated_at",
    )
    return state.with_tables(
        sources=state.sources.unionByName(created), subscriptions=state.subscriptions.unionByName(subscriptions)
    )


def check_settings(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """Settings changes with a ``reject`` reason; null means the change may be applied."""
    old = sources.select(
        "id",
        F.col("kind").alias("old_kind"),
        F.col("connector_id").alias("old_connector"),
        F.get_json_object("config_json", "$.sourceProvider").alias("provider"),
        F.get_json_object("config_json", "$.mode").alias("mode"),
    )
    new_title, new_category = text.collapse(F.col("title")), text.category_label(F.col("category"))
    public = F.col("old_kind").isin(PUBLIC_KINDS)
    moved = F.col("kind") != F.col("old_kind")
    reject = (
        F.when(F.col("old_kind").isNull(), F.lit("unknown source"))
        .when(F.coalesce(new_title, F.lit("")) == "", F.lit("title missing"))
        .when(text.category_too_long(F.col("category")), F.lit("category too long"))
        .when(~public & moved, F.lit("kind is fixed by the connector"))
        .when((F.col("provider") == "rsshub") & moved, F.lit("kind is fixed by the connector"))
        .when(public & ~F.col("kind").isin(PUBLIC_KINDS), F.lit("kind not public"))
        .when(
            F.col("polling_enabled") & F.col("refresh_interval_minutes").isNotNull() & ~F.col("refresh_interval_minutes").isin(INTERVALS),
            F.lit("interval not offered"),
        )
    )
    retired = (F.col("old_kind") == "x") & (F.col("old_connector") == "x") & (F.col("mode") == "public-profile")
    polls = F.when((F.col("kind") == "manual") | F.coalesce(retired, F.lit(False)), F.lit(False)).otherwise(F.col("polling_enabled"))
    return (
        changes.join(old, "id", "left")
        .withColumns({"reject": reject, "title": F.trim("title"), "category": new_category})
        .withColumn("polling_enabled", polls)
        .withColumn("refresh_interval_minutes", F.when(F.col("polling_enabled"), F.col("refresh_interval_minutes")))
        .select("id", "title", "category", "kind", "polling_enabled", "refresh_interval_minutes", "reject")
    )


def apply_settings(state: State, changes: DataFrame, as_of: int) -> State:
    """Apply accepted settings, one per source ``(id, title, category, kind, polling_enabled, refresh_interval_minutes)``.

    A kind change switches the connector, forgets validators and the
    maintenance marker, and makes the source active again.
    """
    accepted = check_settings(state.sources, changes).where(F.col("reject").isNull()).drop("reject")
    new = accepted.select("id", *[F.col(c).alias(f"new_{c}") for c in accepted.columns if c != "id"])
    now = F.lit(as_of).cast("bigint")
    hit = F.col("new_kind").isNotNull()
    moved = hit & (F.col("new_kind") != F.col("kind"))

    def when_hit(value: Column, column: str) -> Column:
        return F.when(hit, value).otherwise(F.col(column)).alias(column)

    schedule = F.when(F.col("new_polling_enabled"), next_check(F.col("id"), now, F.col("new_refresh_interval_minutes")))
    changed = {
        "title": when_hit(F.col("new_title"), "title"),
        "category": when_hit(F.col("new_category"), "category"),
        "kind": when_hit(F.col("new_kind"), "kind"),
        "connector_id": F.when(moved, F.col("new_kind")).otherwise(F.coalesce("connector_id", "kind")),
        "polling_enabled": when_hit(F.col("new_polling_enabled"), "polling_enabled"),
        "refresh_interval_minutes": when_hit(F.col("new_refresh_interval_minutes"), "refresh_interval_minutes"),
        "extraction_rule": F.when(~(moved & (F.col("new_kind") != "generic")), F.col("extraction_rule")),
        "etag": F.when(~moved, F.col("etag")),
        "last_modified": F.when(~moved, F.col("last_modified")),
        "status": F.when(moved, F.lit("active")).otherwise(F.col("status")),
        "next_check_at": when_hit(schedule, "next_check_at"),
        "updated_at": when_hit(now, "updated_at"),
    }
    joined = state.sources.join(new, "id", "left").withColumn("moved", F.coalesce(moved, F.lit(False)))
    changed = {name: F.when(hit, value).otherwise(F.col(name)) for name, value in changed.items()}
    sources = joined.select(*[changed.get(c, F.col(c)).alias(c) for c in state.sources.columns])
    switched = joined.where("moved").select(F.col("id").alias("source_id"), F.col("new_kind"))
    subscriptions = state.subscriptions.join(switched, "source_id", "left").withColumns(
        {
            "connector_id": F.coalesce("new_kind", "connector_id"),
            "account_id": F.when(F.col("new_kind").isNull(), F.col("account_id")),
            "updated_at": F.when(F.col("new_kind").isNull(), F.col("updated_at")).otherwise(now),
        }
    )
    return state.with_tables(
        sources=sources,
        subscriptions=subscriptions.select(*state.subscriptions.columns),
        maintenance=state.maintenance.join(switched.select("source_id"), "source_id", "left_anti"),
    )


def pause_sources(state: State, reasons: DataFrame, as_of: int) -> State:
    """Stop sources ``(source_id, reason)``; collected content stays."""
    change = reasons.select(F.col("source_id").alias("id"), F.col("reason"))
    hit = F.col("reason").isNotNull()
    now = F.lit(as_of).cast("bigint")
    sources = state.sources.join(change, "id", "left").withColumns(
        {
            "status": F.when(hit, F.lit("paused")).otherwise(F.col("status")),
            "polling_enabled": F.col("polling_enabled") & ~hit,
            "next_check_at": F.when(~hit, F.col("next_check_at")),
            "last_error": F.when(hit, F.col("reason")).otherwise(F.col("last_error")),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        }
    )
    return state.with_tables(sources=sources.select(*state.sources.columns))


def retired_sources(sources: DataFrame) -> DataFrame:
    """Sources on the withdrawn public-profile transport that are not fully stopped yet."""
    legacy = (
        (F.col("kind") == "x")
        & (F.col("connector_id") == "x")
        & (F.get_json_object("config_json", "$.mode") == "public-profile")
        & ((F.col("status") != "paused") | F.col("polling_enabled"))
    )
    return sources.where(legacy).select(F.col("id").alias("source_id"))


def update_icons(state: State, icons: DataFrame, as_of: int) -> State:
    """Store feed-declared icons ``(source_id, icon_url)``; only public addresses are taken."""
    public = icons.where(urls.is_public_url(F.col("icon_url"))).select(
        F.col("source_id").alias("id"), F.col("icon_url").alias("new_icon")
    )
    differs = F.col("new_icon").isNotNull() & ~F.col("new_icon").eqNullSafe(F.col("icon_url"))
    sources = state.sources.join(public, "id", "left").withColumns(
        {
            "updated_at": F.when(differs, F.lit(as_of).cast("bigint")).otherwise(F.col("updated_at")),
            "icon_url": F.coalesce("new_icon", "icon_url"),
        }
    )
    return state.with_tables(sources=sources.select(*state.sources.columns))


def backfill(state: State) -> State:
    """Upgrade rows of a library from before connectors, origins and subscriptions; safe to repeat."""
    sources = state.sources.withColumn("connector_id", F.coalesce(text.blank_to_null(F.col("connector_id")), F.col("kind")))
    dimension = sources.select(F.col("id").alias("source_id"), F.col("connector_id").alias("source_connector"))
    filled = state.entries.join(dimension, "source_id", "left").withColumns(
        {
            "observed_at": F.coalesce("observed_at", "created_at"),
            "provider_id": F.coalesce("provider_id", "source_connector"),
            "canonical_identity": F.coalesce("canonical_identity", "canonical_url"),
        }
    )
    origins = filled.select(
        F.col("id").alias("entry_id"),
        "source_id",
        F.coalesce("provider_id", F.lit("generic")).alias("provider_id"),
        F.coalesce("external_id", F.lit("")).alias("external_id"),
        "provider_label",
        "original_url",
        F.coalesce("observed_at", "created_at").alias("observed_at"),
    )
    missing = origins.join(state.entry_origins, schemas.ORIGIN_KEY, "left_anti").select(*state.entry_origins.columns)
    subscriptions = sources.select(
        "id",
        F.col("id").alias("source_id"),
        "connector_id",
        "account_id",
        F.lit(None).cast("string").alias("target_id"),
        "config_json",
        "created_at",
        "updated_at",
    ).join(state.subscriptions.select("source_id"), "source_id", "left_anti")
    return state.with_tables(
        sources=sources,
        entries=filled.select(*schemas.columns(ENTRIES)),
        entry_origins=state.entry_origins.unionByName(missing),
        subscriptions=state.subscriptions.unionByName(subscriptions),
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
