"""One-time historical repairs, gated per source by a revision marker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow import schemas
from contentflow.functions import text, urls
from contentflow.functions.binding import staged
from contentflow.operators.mutations import delete_origin_rows, union_all
from contentflow.schemas import ENTRIES, ORIGIN_KEY, ORIGINS, State, write_through

REVISION = 1


def connector() -> Column:
    return F.coalesce(text.blank_to_null(F.col("connector_id")), F.col("kind"))


def needs_maintenance(sources: DataFrame) -> DataFrame:
    return sources.where(connector().isin("generic", "rss") | (F.col("kind") == "zhihu_follow"))


def pending_sources(state: State, revision: int = REVISION) -> DataFrame:
    """Sources whose marker is older than the revision."""
    done = state.maintenance.where(F.col("revision") >= revision).select(F.col("source_id").alias("id"))
    return needs_maintenance(state.sources).join(done, "id", "left_anti")


def owned_by(entries: DataFrame, sources: DataFrame) -> DataFrame:
    return entries.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")


def _pairs(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("id").alias("entry_id"), "source_id")


def doomed_rows(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """``(entry_id, source_id, reason)`` of stored cards that were never content.

    One scan serves all three rules: taxonomy pages of generic sources,
    unsupported activity and promotions of follow timelines.
    """
    dimension = sources.select(
        F.col("id").alias("source_id"),
        (connector() == "generic").alias("generic"),
        (F.col("kind") == "zhihu_follow").alias("follow"),
    )
    link = F.col("original_url")
    reason = (
        F.when(F.col("generic") & urls.is_stored_taxonomy_url(link), "taxonomy")
        .when(F.col("follow") & urls.is_unsupported_activity(link), "unsupported")
        .when(F.col("follow") & urls.is_promotion_url(link), "promotion")
    )
    judged = staged(entries.select("id", "source_id", "original_url").join(dimension, "source_id"), reason=reason)
    return judged.where(F.col("reason").isNotNull()).select(F.col("id").alias("entry_id"), "source_id", "reason")


def nav_rows(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Stored cards that are navigation of their feed rather than content.

    ``sources`` may carry ``remove_homepage``: the source declared a feed, so a
    homepage card goes even when it has a description.
    """
    if "remove_homepage" not in sources.columns:
        sources = sources.withColumn("remove_homepage", F.lit(False))
    dimension = sources.select(F.col("id").alias("source_id"), F.col("url").alias("home"), "remove_homepage")
    undated = entries.where(F.col("published_at").isNull()).join(dimension, "source_id")
    bare = (text.non_blank(F.col("summary")).isNull()) & (text.non_blank(F.col("image_url")).isNull())
    link, home = F.col("original_url"), F.col("home")
    is_home = (
        (urls.url_origin(link) == urls.url_origin(home))
        & (urls.url_path(link) == urls.url_path(home))
        & (urls.url_query(link) == urls.url_query(home))
    )
    social = urls.url_host(link).rlike(urls.SOCIAL_HOST) & F.col("title").rlike(urls.SOCIAL_LABEL)
    doomed = F.when(is_home, F.col("remove_homepage") | bare).otherwise(bare & social)
    return _pairs(staged(undated, doomed=F.coalesce(doomed, F.lit(False))).where("doomed"))


def prune_nav(state: State, sources: DataFrame) -> State:
    return delete_origin_rows(state, nav_rows(state.entries, sources))


def homepage_repairs(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """``(id, source_id, target)`` of generic cards whose link is the source home but whose identity is a page.

    A target URL is given away once and only when no other entry has it.
    """
    generic = sources.where(F.col("kind") == "generic").select(F.col("id").alias("source_id"), "url")
    homes = staged(generic, home=urls.canonical_content_url(F.col("url"))).select(
        "source_id", "home", urls.url_origin(F.col("home")).alias("home_origin"), urls.url_path(F.col("home")).alias("home_path")
    )
    cards = entries.where(F.col("canonical_identity").isNotNull()).join(homes, "source_id")
    on_home = (urls.url_origin(F.col("canonical_url")) == F.col("home_origin")) & (
        urls.url_path(F.col("canonical_url")) == F.col("home_path")
    )
    keyed = staged(cards, on_home=on_home).where("on_home")
    keyed = staged(keyed, target=urls.canonical_content_url(F.col("canonical_identity")))
    candidates = (
        keyed.where((urls.url_origin(F.col("target")) == F.col("home_origin")) & (F.col("target") != F.col("home")))
        .groupBy("target")
        .agg(F.min_by(F.struct("id", "source_id", "canonical_url"), F.struct("created_at", "id")).alias("card"))
        .select("card.*", "target")
    )
    taken = entries.select(F.col("canonical_url").alias("target"), F.col("id").alias("holder")).alias("t")
    free = candidates.alias("c").join(
        taken, (F.col("c.target") == F.col("t.target")) & (F.col("c.id") != F.col("t.holder")), "left_anti"
    )
    return free.select("id", "source_id", "target")


def repair_homepage_urls(state: State, repairs: DataFrame) -> State:
    hit = repairs.select("id", "target")
    entries = state.entries.join(hit, "id", "left").withColumns(
        {name: F.coalesce("target", name) for name in ("canonical_url", "original_url", "canonical_identity")}
    )
    pairs = repairs.select(F.col("id").alias("entry_id"), "source_id", "target")
    origins = state.entry_origins.join(pairs, ["entry_id", "source_id"], "left").withColumn(
        "original_url", F.coalesce("target", "original_url")
    )
    return state.with_tables(
        entries=entries.select(*schemas.columns(ENTRIES)), entry_origins=origins.select(*schemas.columns(ORIGINS))
    )


def quality() -> Column:
    """Rank of a row among its duplicates; the epoch term outweighs the flags, as intended."""

    def points(test: Column, value: int) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.lit(value)).otherwise(F.lit(0))

    return (
        points(F.col("is_favorite"), 1_000_000)
        + points(F.col("is_read"), 100_000)
        + points(F.col("published_at") != 0, 10_000)
        + F.coalesce(F.length("summary"), F.lit(0)) * 10
        + points(F.col("image_url") != "", 100)
        + F.coalesce("observed_at", "created_at")
    ).cast("bigint")


def wrapper_repairs(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """``(id, target)`` of entries stored under a per-delivery redirect address."""
    maybe = entries.where(F.col("canonical_url").contains(urls.WRAPPER_HOST)).select("id", "source_id", "canonical_url")
    keyed = staged(
        owned_by(maybe, sources),
        wrapped=urls.is_redirect_wrapper(F.col("canonical_url")),
        target=urls.canonical_content_url(F.col("canonical_url")),
    )
    return keyed.where(F.col("wrapped") & (F.col("target") != F.col("canonical_url"))).select("id", "target")


def merge_duplicates(state: State, repairs: DataFrame) -> State:
    """Fold the entries of one target URL into one, keeping user state and every origin.

    ``repairs`` maps ``id`` to ``target``; an entry already stored under a
    target joins its group. All choices are aggregates, so the size of a group
    does not matter.
    """
    targets = repairs.select("target").distinct()
    moved = state.entries.join(repairs, "id").withColumn("held", F.lit(0))
    holders = (
        state.entries.join(targets, F.col("canonical_url") == F.col("target"))
        .join(repairs.select("id"), "id", "left_anti")
        .withColumn("held", F.lit(1))
    )
    members = moved.unionByName(holders).withColumn("order", F.struct("held", "created_at", "id"))
    order = F.col("order")
    best = F.struct((-quality()).alias("quality"), "order")

    def first_known(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), order)).alias(f"first_{name}")

    groups = members.groupBy("target").agg(
        F.min_by(F.struct(*schemas.columns(ENTRIES)), best).alias("winner"),
        F.bool_or("is_read").alias("any_read"),
        F.bool_or("is_favorite").alias("any_favorite"),
        first_known("author"),
        first_known("published_at"),
        first_known("image_url"),
        F.min_by("summary", F.when(F.col("summary") != "", F.struct((-F.length("summary")).alias("n"), "order"))).alias("longest"),
        F.min("created_at").alias("oldest"),
        F.max(F.coalesce("observed_at", "created_at")).alias("newest"),
    )
    merged = groups.select("winner.*", *[c for c in groups.columns if c != "winner"]).withColumns(
        {
            "canonical_url": F.col("target"),
            "canonical_identity": F.col("target"),
            "is_read": F.col("any_read"),
            "is_favorite": F.col("any_favorite"),
            "author": F.coalesce("author", "first_author"),
            "published_at": F.coalesce("published_at", "first_published_at"),
            "summary": F.col("longest"),
            "image_url": F.coalesce("image_url", "first_image_url"),
            "created_at": F.col("oldest"),
            "observed_at": F.col("newest"),
        }
    )
    winners = merged.select("target", F.col("id").alias("winner_id"))
    mapping = members.select(F.col("id").alias("entry_id"), "target", "order").join(winners, "target").select(
        "entry_id", "winner_id", "order"
    )
    others = [c for c in schemas.columns(ORIGINS) if c not in ORIGIN_KEY]
    touched = (
        state.entry_origins.join(mapping, "entry_id")
        .withColumn("own", F.when(F.col("entry_id") == F.col("winner_id"), F.lit(0)).otherwise(F.lit(1)))
        .withColumn("entry_id", F.col("winner_id"))
        .groupBy(*ORIGIN_KEY)
        .agg(F.min_by(F.struct(*others), F.struct("own", "order")).alias("kept"))
        .select(*ORIGIN_KEY, "kept.*")
    )
    untouched = state.entry_origins.join(mapping.select("entry_id"), "entry_id", "left_anti")
    owner = touched.groupBy(F.col("entry_id").alias("id")).agg(
        F.min_by("source_id", F.struct("observed_at", "source_id")).alias("owner")
    )
    rows = merged.join(owner, "id", "left").withColumn("source_id", F.coalesce("owner", "source_id"))
    rest = state.entries.join(members.select("id"), "id", "left_anti")
    names = schemas.columns(ENTRIES)
    return state.with_tables(
        entries=rest.select(*names).unionByName(rows.select(*names)),
        entry_origins=untouched.select(*schemas.columns(ORIGINS)).unionByName(touched.select(*schemas.columns(ORIGINS))),
    )


def run_maintenance(state: State, as_of: int, revision: int = REVISION) -> tuple[State, DataFrame]:
    """Run every repair a source still needs and mark it done; the report counts rows per repair.

    All sources are repaired together. The markers are part of the returned
    state, so they become visible only when the repaired tables are published.
    """
    pending = pending_sources(state, revision)
    feeds = pending.where(connector() == "rss")

    doomed = doomed_rows(state.entries, pending)
    step = delete_origin_rows(state, doomed).written("maintenance-deleted", "entries", "entry_origins")
    homepages = write_through(homepage_repairs(step.entries, pending), "maintenance-homepages")
    wrapped = write_through(wrapper_repairs(step.entries, feeds), "maintenance-wrapped")
    step = merge_duplicates(repair_homepage_urls(step, homepages), wrapped)

    markers = pending.select(
        F.col("id").alias("source_id"), F.lit(revision).alias("revision"), F.lit(as_of).cast("bigint").alias("updated_at")
    )
    kept = state.maintenance.join(markers.select("source_id"), "source_id", "left_anti")
    report = maintenance_report(
        {
            "inspected_sources": needs_maintenance(state.sources),
            "maintained_sources": pending,
            "taxonomy_entries_removed": doomed.where(F.col("reason") == "taxonomy"),
            "homepage_urls_repaired": homepages,
            "wrapper_entries_merged": wrapped,
            "unsupported_entries_removed": doomed.where(F.col("reason") == "unsupported"),
            "promotions_removed": doomed.where(F.col("reason") == "promotion"),
        }
    )
    return step.with_tables(maintenance=kept.unionByName(markers)), report


def maintenance_report(parts: dict[str, DataFrame]) -> DataFrame:
    """One row of counts; each part is counted where its rows are, only the counts move."""
    counted = union_all([rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, rows in parts.items()])
    totals = counted.agg(*[F.coalesce(F.sum(F.when(F.col("part") == name, F.col("n"))), F.lit(0)).alias(name) for name in parts])
    return totals.withColumn("skipped_sources", F.col("inspected_sources") - F.col("maintained_sources"))
