"""Every operator as a job over the given tables: ``name -> callable(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentflow import schemas
from contentflow.functions import text, urls
from contentflow.functions.binding import staged
from contentflow.operators import health, maintenance, merge, mutations, timeline
from contentflow.plans import roles
from contentflow.plans.roles import AS_OF, DAY, ORDER_CLOCK, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- URL and text rules ------------------------------------------------------


@query
def canonical_urls(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.canonical_content_url(url).alias("canonical_url"), urls.is_public_url(url).alias("is_public"))


@query
def public_url_check(spark, sf):
    """Addresses of every kind, made from the customers: public, private, loopback, bare, unusable."""
    key = F.col("c_custkey")
    shapes = [
        F.concat(F.lit("https://shop"), key, F.lit(".example.org/a")),
        F.concat(F.lit("http://10.0."), key % 250, F.lit(".1/x")),
        F.concat(F.lit("http://192.168.1."), key % 250),
        F.concat(F.lit("http://172."), key % 40, F.lit(".0.1/")),
        F.concat(F.lit("http://localhost:"), key, F.lit("/feed")),
        F.concat(F.lit("http://[::1]/"), key),
        F.concat(F.lit("box"), key, F.lit(".local/rss")),
        F.concat(F.lit("ftp://files.example.org/"), key),
        F.concat(F.lit("127.0.0."), key % 250),
        F.concat(F.lit("www.example.net/"), key),
        F.concat(F.lit("http://0.0.0.0/"), key),
    ]
    made = table(spark, sf, "customer").select("c_custkey", F.get(F.array(*shapes), (key % len(shapes)).cast("int")).alias("url"))
    url = F.col("url")
    return made.select(
        "c_custkey",
        urls.is_public_url(url).alias("is_public"),
        urls.is_feed_url_allowed(url, allow_loopback=True).alias("feed_allowed"),
    )


@query
def taxonomy_filter(spark, sf):
    """Page addresses moved under archive-like folders, by both taxonomy rules."""
    folder = roles.pick(["tag", "posts", "archives", "Category", "tagged", "categories"], F.col("page_id"))
    pages = table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("https://www.example.org/"), folder, F.lit("/"), F.col("page_id") % 3).alias("deep"),
        F.concat(F.lit("https://www.example.org/a/"), folder).alias("flat"),
    )
    return pages.select(
        "page_id",
        urls.is_taxonomy_url(F.col("deep")).alias("deep_page"),
        urls.is_taxonomy_url(F.col("flat")).alias("flat_page"),
        urls.is_stored_taxonomy_url(F.col("deep")).alias("deep_stored"),
        urls.is_stored_taxonomy_url(F.col("flat")).alias("flat_stored"),
    )


@query
def source_marks(spark, sf):
    """Icon kind, favicon candidate and default folder of every source."""
    sources = roles.sources(spark, sf)
    mark = urls.icon_kind(F.col("url"), F.col("kind"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return staged(sources, mark=mark).select(
        "id", "mark", urls.favicon_candidate(F.col("icon_url"), F.col("url"), F.col("mark")).alias("favicon")
    )


@query
def profile_targets(spark, sf):
    """Strict profile addresses among customer links; every other shape has no target."""
    key = F.col("c_custkey")
    shape = roles.pick(["user/profile/", "explore/", "user/profile/x/", "user/"], key)
    link = F.concat(F.lit("https://www.xiaohongshu.com/"), shape, F.lit("id_"), key, F.lit("?t=1"))
    made = table(spark, sf, "customer").select("c_custkey", link.alias("link"))
    return made.select("c_custkey", urls.profile_id(F.col("link")).alias("profile_id"), urls.profile_url(F.col("link")).alias("url"))


@query
def link_dates(spark, sf):
    """Publication dates read from dated article addresses; impossible days give none."""
    key = F.col("o_orderkey")
    day = F.concat_ws("/", F.lit(2000) + key % 30, key % 14, key % 33)
    link = F.concat(F.lit("https://www.example.org/blog/"), day, F.lit("/post-"), key)
    return table(spark, sf, "orders").select("o_orderkey", text.published_day(urls.url_date_text(link)).alias("published_at"))


@query
def published_days(spark, sf):
    """Date labels in every supported spelling, read back to UTC days."""
    when = F.col("o_orderdate")
    styles = [
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.date_format(when, "yyyy/M/d"),
        F.date_format(when, "yyyy年M月d日"),
        F.date_format(when, "d MMM yyyy"),
        F.concat(F.date_format(when, "MMMM d, yyyy"), F.lit("Research note")),
        F.date_format(when, "M/d/yyyy"),
        F.concat(F.lit("Release "), F.date_format(when, "yy.MM")),
    ]
    label = F.get(F.array(*styles), (F.col("o_orderkey") % len(styles)).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", text.published_day(label).alias("published_at"))


@query
def compact_text(spark, sf):
    """Collapsed documents whole, and as list cards show them."""
    body = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(text.compact(body)).alias("whole_md5"), text.shortened(body, 240).alias("title"), text.shortened(body, 500).alias("summary")
    )


@query
def redacted_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.redact_message(F.col("text"))).alias("redacted_md5"))


@query
def redacted_messages(spark, sf):
    """Run-log messages with tokens and addresses in them."""
    key = F.col("event_id")
    message = F.concat(
        F.lit("GET https://user:pw@h"), key % 9, F.lit(".example.org/feed?token="), key, F.lit(" failed, Bearer abc"), key, F.lit("; api_key: k"), key
    )
    return table(spark, sf, "events").select("event_id", text.redact_message(message).alias("message"))


@query
def leaked_tex(spark, sf):
    found = staged(table(spark, sf, "documents").select("doc_id", "text"), found=text.leaked_math(F.col("text")))
    return found.select("doc_id", F.size("found").cast("bigint").alias("leaked"), F.coalesce(F.get("found", F.lit(0)), F.lit("")).alias("first"))


@query
def paired_tex(spark, sf):
    """Inline pairs in documents, price-like text included: a matched pair always counts."""
    found = staged(table(spark, sf, "documents").select("doc_id", "text"), found=text.paired_math(F.col("text")))
    return found.select("doc_id", F.size("found").cast("bigint").alias("pairs"))


@query
def model_excerpt(spark, sf):
    """Whole documents as numbered excerpts of bounded length; documents without text are left out."""
    made = staged(table(spark, sf, "documents").select("doc_id", "source", "text"), parts=text.excerpt_parts(F.col("text")))
    return made.select("doc_id", "source", F.posexplode("parts").alias("part", "excerpt")).select(
        "doc_id",
        F.col("part").cast("bigint").alias("part"),
        text.collapse(F.col("source")).alias("source_title"),
        F.md5("excerpt").alias("excerpt_md5"),
        F.length("excerpt").cast("bigint").alias("n_chars"),
    )


@query
def failure_classes(spark, sf):
    cause = roles.pick(["net::ERR_PROXY_CONNECTION_FAILED", "ENOTFOUND host", "The operation timed out", "socket hang up"], F.col("event_id"))
    failed = roles.runs(table(spark, sf, "events").where(F.col("event_type") == "error"))
    return failed.withColumn("event_id", F.col("id").cast("bigint")).select(
        "event_id", "source_id", text.failure_class(cause).alias("failure_class")
    )


@query
def srcset_choice(spark, sf):
    key = F.col("p_partkey")
    item = F.concat(F.lit("https://cdn.example.org/w_"), key % 7 * 100, F.lit(",c_fit/"), key)
    value = F.concat(item, F.lit(" 100w, //img.example.org/"), key, F.lit(".png "), key % 5 * 90, F.lit("w, /small.png"))
    return table(spark, sf, "part").select("p_partkey", text.largest_srcset(value).alias("image"))


# --- merge -------------------------------------------------------------------


def _entry_columns(entries: DataFrame) -> DataFrame:
    return entries.select(
        "canonical_url", "source_id", "original_url", "title", "author", "published_at", "summary", "external_id", "observed_at", "content_hash", "provider_id"
    )


@query
def entries_upsert(spark, sf):
    """One batch of documents into an empty library."""
    return _entry_columns(merge.merge_entries(schemas.empty_state(spark), roles.document_batch(spark, sf)).state.entries)


@query
def entries_upsert_two_batches(spark, sf):
    """The same rows in two merges; the state in between is a written snapshot."""
    batch = roles.document_batch(spark, sf).withColumn("half", F.col("seq") % 2)
    later = F.col("seq") * 2 + F.col("half") * 1_000_000_000
    batch = batch.withColumn("seq", later)
    first = merge.merge_entries(schemas.empty_state(spark), batch.where("half = 0").drop("half")).state
    first = first.written("two-batches", "entries", "entry_origins")
    return _entry_columns(merge.merge_entries(first, batch.where("half = 1").drop("half")).state.entries)


@query
def pages_upsert(spark, sf):
    """The crawl dump into an empty library: one entry per canonical URL."""
    entries = merge.merge_entries(schemas.empty_state(spark), roles.page_batch(spark, sf)).state.entries
    return entries.select("canonical_url", "original_url", "title", "observed_at")


@query
def new_entries(spark, sf):
    """Canonical URLs that a second batch adds, dismissed ones left out."""
    batch = roles.document_batch(spark, sf)
    first = merge.merge_entries(schemas.empty_state(spark), batch.where("seq % 3 = 0")).state.written("new-entries", "entries", "entry_origins")
    dismissed = first.entries.where(F.col("author") == "en").select("canonical_identity", F.lit(AS_OF).alias("dismissed_at"))
    state = first.with_tables(dismissed=dismissed)
    return merge.merge_entries(state, batch.where("seq % 3 <> 0")).inserted.select("canonical_url")


@query
def tombstoned_merge(spark, sf):
    """Merge after dismissals: everything the users dismissed stays away."""
    batch = roles.document_batch(spark, sf)
    dismissed = batch.where("seq % 10 = 0").select("canonical_identity", F.lit(AS_OF).alias("dismissed_at")).distinct()
    state = schemas.state_of(spark, dismissed=dismissed)
    return merge.merge_entries(state, batch).state.entries.select("canonical_url", "source_id", "title")


@query
def origins_flat(spark, sf):
    """Provenance after two merges: one row per entry, source, provider and external id."""
    batch = roles.document_batch(spark, sf)
    first = merge.merge_entries(schemas.empty_state(spark), batch.where("seq % 2 = 0")).state.written("origins", "entries", "entry_origins")
    origins = merge.merge_entries(first, batch.where("seq % 2 = 1")).state.entry_origins
    return origins.select("entry_id", "source_id", "provider_id", "external_id", "original_url", "observed_at")


@query
def origins_nested(spark, sf):
    """Origins nested per entry, oldest first, shown by size and first and last element."""
    nested = timeline.with_origins(roles.entries(spark, sf), roles.origins(spark, sf))
    return nested.select(
        "id", "part", "parts", F.size("origins").cast("bigint").alias("n"),
        F.get("origins", F.lit(0))["source_id"].alias("first_source"),
        F.try_element_at("origins", F.lit(-1))["observed_at"].alias("last_observed"),
    )


@query
def origins_per_provider(spark, sf):
    """Distinct providers of an entry besides its owner's connector."""
    return timeline.other_providers(roles.entries(spark, sf), roles.origins(spark, sf), roles.sources(spark, sf))


@query
def source_lookup(spark, sf):
    entries = timeline.with_source(roles.entries(spark, sf), roles.sources(spark, sf))
    return entries.select("id", "source_id", "source_title", "source_connector")


@query
def entry_by_url(spark, sf):
    """Point lookup of one entry by its canonical URL."""
    return timeline.by_id(roles.entries(spark, sf), "https://www.example.org/o/77", "canonical_url").select("id", "title", "author")


# --- timeline ----------------------------------------------------------------

TIMELINE = ["id", "source_id", "published_at", "observed_at", "created_at"]


@query
def timeline_page(spark, sf):
    return timeline.timeline(roles.entries(spark, sf), roles.origins(spark, sf), limit=200).select(*TIMELINE)


@query
def timeline_range(spark, sf):
    start, end = ORDER_CLOCK, ORDER_CLOCK + 60 * DAY
    return timeline.timeline(roles.entries(spark, sf), roles.origins(spark, sf), start_at=start, end_at=end).select(*TIMELINE)


@query
def timeline_by_source(spark, sf):
    return timeline.timeline(roles.entries(spark, sf), roles.origins(spark, sf), source_id="s5").select(*TIMELINE)


@query
def timeline_unbounded(spark, sf):
    return timeline.timeline(roles.entries(spark, sf), roles.origins(spark, sf)).select(*TIMELINE)


@query
def library_counts(spark, sf):
    return timeline.library_counts(roles.entries(spark, sf), ORDER_CLOCK)


@query
def view_today(spark, sf):
    return timeline.library_view(roles.entries(spark, sf), roles.origins(spark, sf), "today", None, ORDER_CLOCK).select(*TIMELINE)


@query
def view_unread(spark, sf):
    return timeline.library_view(roles.entries(spark, sf), roles.origins(spark, sf), "unread", "s1", ORDER_CLOCK).select(*TIMELINE)


@query
def view_favorite(spark, sf):
    return timeline.library_view(roles.entries(spark, sf), roles.origins(spark, sf), "favorite", "s1", ORDER_CLOCK).select(*TIMELINE)


# --- health ------------------------------------------------------------------


@query
def source_health(spark, sf):
    events = table(spark, sf, "events")
    return health.source_health(roles.runs(events), roles.run_sources(events))


@query
def run_log_latest(spark, sf):
    return health.latest_runs(roles.runs(table(spark, sf, "events"))).select("id", "source_id", "outcome", "created_at")


@query
def run_log_of_source(spark, sf):
    return health.latest_runs(roles.runs(table(spark, sf, "events")), "u7", 50).select("id", "source_id", "outcome", "created_at")


@query
def run_totals(spark, sf):
    totals = health.run_totals(roles.runs(table(spark, sf, "events")))
    return totals.select("source_id", "outcome", "runs", F.col("fetched").cast("bigint").alias("fetched"), F.col("inserted").cast("bigint").alias("inserted"))


@query
def due_sources(spark, sf):
    return health.due_sources(roles.sources(spark, sf), AS_OF).select("id", "next_check_at")


@query
def fetch_plan(spark, sf):
    return health.fetch_plan(health.due_sources(roles.sources(spark, sf), AS_OF), urls.url_host(F.col("url")))


@query
def next_checks(spark, sf):
    sources = roles.sources(spark, sf)
    checked = F.lit(AS_OF) + F.substring("id", 2, 20).cast("bigint")
    return sources.select("id", health.next_check(F.col("id"), checked, F.col("refresh_interval_minutes")).alias("next_check_at"))


@query
def sources_by_update(spark, sf):
    return roles.sources(spark, sf).orderBy(F.col("updated_at").desc(), "id").select("id", "title", "updated_at")


# --- mutations ---------------------------------------------------------------


def _picked(state, condition):
    return state.sources.where(condition).select(F.col("id").alias("source_id"))


@query
def source_delete(spark, sf):
    """Entries left, with their owners, after every tenth source is deleted."""
    state = roles.library(spark, sf)
    after = mutations.delete_sources(state, _picked(state, F.col("id").endswith("3")))
    return after.entries.select("id", "source_id")


@query
def source_delete_origins(spark, sf):
    state = roles.library(spark, sf)
    after = mutations.delete_sources(state, _picked(state, F.col("id").endswith("3")))
    return after.entry_origins.groupBy("source_id").agg(F.count("*").alias("origins"), F.countDistinct("entry_id").alias("entries"))


@query
def rule_reset(spark, sf):
    """Sources after a rule correction: healthy, due now, content gone for replay."""
    state = roles.library(spark, sf)
    rules = _picked(state, F.col("kind") == "generic").withColumn("extraction_rule", F.lit('{"version":1}'))
    after = mutations.reset_sources(state, rules, AS_OF)
    left = after.entries.groupBy("source_id").agg(F.count("*").alias("entries"))
    return after.sources.join(left, after.sources.id == left.source_id, "left").select(
        "id", "status", "next_check_at", "extraction_rule", F.coalesce("entries", F.lit(0)).alias("entries")
    )


@query
def rule_replace(spark, sf):
    state = roles.library(spark, sf)
    rules = _picked(state, F.col("kind") == "generic").withColumn("extraction_rule", F.lit('{"version":1}'))
    return mutations.replace_rules(state, rules, AS_OF).sources.select("id", "status", "extraction_rule", "updated_at", "next_check_at")


@query
def origin_delete(spark, sf):
    """Origin-safe removal of matched pairs: shared entries survive with another owner."""
    state = roles.library(spark, sf)
    matches = state.entry_origins.where(F.col("external_id").isin("1", "2", "3")).select("entry_id", "source_id")
    return mutations.delete_origin_rows(state, matches).entries.select("id", "source_id")


@query
def user_actions(spark, sf):
    state = roles.library(spark, sf)
    after = mutations.apply_actions(state, roles.actions(table(spark, sf, "events")), AS_OF)
    return after.entries.select("id", "is_read", "is_favorite")


@query
def user_dismissals(spark, sf):
    state = roles.library(spark, sf)
    return mutations.apply_actions(state, roles.actions(table(spark, sf, "events")), AS_OF).dismissed


@query
def register_sources(spark, sf):
    """Customers as subscription requests: known addresses keep their source, the first new one wins."""
    key = F.col("c_custkey")
    state = schemas.state_of(spark, sources=roles.sources(spark, sf))
    url = F.concat(F.lit("https://h"), key % 7, F.lit(".example.org/feed/"), key % 500)
    inputs = table(spark, sf, "customer").select(
        key.alias("seq"), url.alias("url"), F.col("c_name").alias("title"), F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")).alias("category"),
        F.lit("rss").alias("kind"), roles.null("string").alias("connector_id"), roles.null("string").alias("account_id"),
        F.concat(F.lit('{"targetId":"t'), key, F.lit('"}')).alias("config_json"), roles.null("string").alias("status"), roles.null("string").alias("extraction_rule"),
        F.lit(True).alias("polling_enabled"), roles.null("int").alias("refresh_interval_minutes"),
    )
    after = mutations.register_sources(state, inputs, AS_OF)
    targets = after.subscriptions.select("id", "target_id")
    return after.sources.join(targets, "id", "left").select("url", "title", "category", "kind", "next_check_at", "target_id")


def _settings(state):
    key = F.substring("id", 2, 20).cast("bigint")
    kind = F.when(key % 2 == 0, F.col("kind")).otherwise(roles.pick(["generic", "manual", "rss", "x"], key))
    return state.sources.select(
        "id",
        F.when(key % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" New "), F.col("title"))).alias("title"),
        F.when(key % 4 == 0, F.lit("Shared  folder")).alias("category"),
        kind.alias("kind"),
        (key % 5 != 0).alias("polling_enabled"),
        F.when(key % 3 == 0, F.lit(45)).otherwise(F.lit(60)).alias("refresh_interval_minutes"),
    )


@query
def settings_check(spark, sf):
    state = roles.library(spark, sf)
    return mutations.check_settings(state.sources, _settings(state)).select("id", "reject")


@query
def settings_update(spark, sf):
    state = roles.library(spark, sf)
    after = mutations.apply_settings(state, _settings(state), AS_OF)
    return after.sources.select("id", "title", "category", "kind", "connector_id", "status", "polling_enabled", "refresh_interval_minutes", "etag", "next_check_at", "updated_at")


@query
def settings_subscriptions(spark, sf):
    state = roles.library(spark, sf)
    after = mutations.apply_settings(state, _settings(state), AS_OF)
    marked = after.maintenance.select("source_id", F.lit(True).alias("marked"))
    return after.subscriptions.join(marked, "source_id", "left").select("source_id", "connector_id", "account_id", F.coalesce("marked", F.lit(False)).alias("marked"))


@query
def pause_sources(spark, sf):
    state = roles.library(spark, sf)
    reasons = _picked(state, F.col("kind") == "x").withColumn("reason", F.repeat(F.lit("gone "), 80))
    return mutations.pause_sources(state, reasons, AS_OF).sources.select("id", "status", "polling_enabled", "next_check_at", "last_error")


@query
def subscription_upsert(spark, sf):
    """Orders as subscription changes, several per source: the newest settings stay."""
    state = roles.library(spark, sf)
    key = F.col("o_orderkey")
    changes = table(spark, sf, "orders").select(
        F.concat(F.lit("sub"), key).alias("id"), F.concat(F.lit("s"), F.col("o_custkey") % 150).alias("source_id"), F.lit("rss").alias("connector_id"),
        roles.null("string").alias("account_id"), F.concat(F.lit("t"), key).alias("target_id"), F.lit("{}").alias("config_json"),
        key.alias("created_at"), key.alias("updated_at"), key.alias("seq"),
    )
    after = merge.upsert_subscriptions(state, changes).subscriptions
    return after.select("source_id", "id", "target_id", "account_id", "created_at", "updated_at")


@query
def followee_upsert(spark, sf):
    """Customers as a followee list seen twice; the second look overwrites."""
    key = F.col("c_custkey")
    base = table(spark, sf, "customer").select(
        F.concat(F.lit("f"), key % 700).alias("url_token"), F.col("c_name").alias("fullname"), F.lit("https://example.org").alias("url"),
        roles.null("string").alias("avatar_url"), F.col("c_mktsegment").alias("headline"), F.floor("c_acctbal").cast("bigint").alias("follower_count"),
        F.lit(AS_OF).alias("updated_at"), key.alias("seq"),
    )
    first = merge.merge_followees(schemas.empty_state(spark), base.where("seq < 600")).written("followees", "followees")
    return merge.merge_followees(first, base.where("seq >= 600")).followees.select("url_token", "fullname", "headline", "follower_count")


@query
def library_backfill(spark, sf):
    """An old library without connectors, providers or some origins, upgraded."""
    state = roles.library(spark, sf)
    legacy = state.with_tables(
        sources=state.sources.withColumn("connector_id", F.when(F.col("polling_enabled"), F.col("connector_id"))),
        entries=state.entries.withColumn("provider_id", F.when(F.col("is_read"), F.col("provider_id"))).withColumn("canonical_identity", F.lit(None).cast("string")),
        entry_origins=state.entry_origins.where(F.col("provider_id") != "rss"),
        subscriptions=state.subscriptions.where(F.col("id").endswith("5")),
    )
    after = mutations.backfill(legacy)
    counts = after.entry_origins.groupBy(F.col("entry_id").alias("id")).agg(F.count("*").alias("origins"))
    return after.entries.join(counts, "id", "left").select("id", "provider_id", "observed_at", "canonical_identity", F.coalesce("origins", F.lit(0)).alias("origins"))


# --- maintenance -------------------------------------------------------------


def _legacy_library(spark, sf):
    """Orders stored the way old builds did: wrapper variants, home links, taxonomy and promoted cards."""
    key = F.col("o_orderkey")
    shape = key % 8
    source = F.when(shape < 3, F.lit("rss")).when(shape < 6, F.lit("gen")).otherwise(F.lit("fol"))
    wrapped = F.concat(F.lit("https://scour.ing/r/rss/item-"), F.floor(key / 24))
    home = F.lit("https://blog.example.org/")
    url = (
        F.when(shape < 2, F.concat(wrapped, F.lit("?as="), key))
        .when(shape == 2, F.when(key % 16 == 2, wrapped).otherwise(F.concat(F.lit("https://rss.example.org/"), key)))
        .when(shape == 3, F.concat(home, F.lit("tags/"), key, F.lit("/")))
        .when(shape == 4, F.concat(home, F.lit("?legacy="), key))
        .when(shape == 5, F.concat(home, F.lit("post/"), key))
        .when(shape == 6, F.concat(F.lit("https://www.zhihu.com/pin/"), key))
        .otherwise(F.concat(F.lit("https://zhuanlan.zhihu.com/p/"), key, F.when(key % 3 == 0, F.lit("?spu=biz%3D0")).otherwise(F.lit(""))))
    )
    identity = F.when(shape == 4, F.concat(home, F.lit("?p="), F.floor(key / 16)))
    rows = table(spark, sf, "orders").select("*", source.alias("owner"), url.alias("link"), identity.alias("identity"))
    # Equal wrapper rows of one order group collapse to one stored URL, as the unique key would.
    kept = rows.groupBy("link").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "link"]), "o_orderkey").alias("r")).select("link", "r.*")
    entries = kept.select(
        F.concat(F.lit("e"), key).alias("id"), F.col("owner").alias("source_id"), F.col("link").alias("canonical_url"),
        F.when(shape == 4, home).otherwise(F.col("link")).alias("original_url"), F.concat(F.lit("Order "), key).alias("title"),
        F.when(key % 5 == 0, F.concat(F.lit("c"), F.col("o_custkey"))).alias("author"), F.when(key % 3 == 0, roles.ms("o_orderdate")).alias("published_at"),
        F.when(key % 2 == 0, F.concat(F.col("o_orderpriority"), F.lit(" "), key)).alias("summary"), roles.null("string").alias("image_url"), F.md5("link").alias("content_hash"),
        (F.col("o_orderstatus") == "F").alias("is_read"), (F.col("o_orderpriority") == "1-URGENT").alias("is_favorite"),
        (key * 1000).alias("created_at"), (key * 1000 + F.col("o_custkey")).alias("observed_at"), F.col("owner").alias("provider_id"), roles.null("string").alias("provider_label"),
        roles.null("string").alias("external_id"), F.coalesce("identity", "link").alias("canonical_identity"),
    )
    names = schemas.ORIGIN_KEY + ["provider_label", "original_url", "observed_at"]
    own = entries.select(F.col("id").alias("entry_id"), "source_id", "provider_id", F.lit("").alias("external_id"), "provider_label", "original_url", "observed_at")
    shared = entries.where(F.substring("id", 2, 20).cast("bigint") % 7 == 0).select(
        F.col("id").alias("entry_id"), F.lit("other").alias("source_id"), F.lit("x").alias("provider_id"), F.lit("").alias("external_id"), "provider_label", "original_url", F.col("created_at").alias("observed_at")
    )
    kinds = [("rss", "https://scour.ing/feed", "rss"), ("gen", "https://blog.example.org/", "generic"), ("fol", "https://www.zhihu.com/follow", "zhihu_follow"), ("other", "https://o.example.org/", "x")]
    made = spark.createDataFrame(kinds, "sid string, surl string, skind string")
    sources = roles._source_rows(made, id=F.col("sid"), url=F.col("surl"), title=F.col("sid"), kind=F.col("skind"), connector_id=F.col("skind"), status=F.lit("active"), polling_enabled=F.lit(True), created_at=F.lit(0), updated_at=F.lit(0))
    state = schemas.state_of(spark, sources=sources, entries=entries, entry_origins=own.select(*names).unionByName(shared.select(*names)))
    return state.written("legacy", "entries", "entry_origins")


@query
def maintenance_report(spark, sf):
    return maintenance.run_maintenance(_legacy_library(spark, sf), AS_OF)[1]


@query
def maintenance_entries(spark, sf):
    after = maintenance.run_maintenance(_legacy_library(spark, sf), AS_OF)[0]
    return after.entries.select("id", "source_id", "canonical_url", "is_read", "is_favorite", "author", "published_at", "summary", "created_at", "observed_at")


@query
def duplicate_merge(spark, sf):
    """Wrapper variants folded into one entry per target: state, winner and owner."""
    state = _legacy_library(spark, sf)
    repairs = schemas.write_through(maintenance.wrapper_repairs(state.entries, state.sources), "repairs")
    after = maintenance.merge_duplicates(state, repairs).entries
    return after.select("id", "source_id", "canonical_url", "is_read", "is_favorite", "author", "published_at", "summary", "created_at", "observed_at")


@query
def duplicate_merge_origins(spark, sf):
    state = _legacy_library(spark, sf)
    repairs = schemas.write_through(maintenance.wrapper_repairs(state.entries, state.sources), "repairs")
    return maintenance.merge_duplicates(state, repairs).entry_origins.select("entry_id", "source_id", "provider_id", "original_url", "observed_at")


@query
def homepage_repair(spark, sf):
    state = _legacy_library(spark, sf)
    return maintenance.homepage_repairs(state.entries, state.sources)


@query
def nav_prune(spark, sf):
    """Stored feed cards left after navigation cards are pruned."""
    key = F.col("p_partkey")
    label = roles.pick(["GitHub", "YouTube", "X (@me)", "Real post"], key)
    link = (
        F.when(key % 4 == 0, F.concat(F.lit("https://github.com/u"), key))
        .when(key % 4 == 1, F.concat(F.lit("https://www.youtube.com/c"), key))
        .when(key % 4 == 2, F.concat(F.lit("https://x.com/u"), key))
        .otherwise(F.concat(F.lit("https://news.example.org/?q="), key % 9))
    )
    parts = table(spark, sf, "part")
    entries = parts.select(
        F.concat(F.lit("e"), key).alias("id"), F.concat(F.lit("n"), key % 3).alias("source_id"), F.concat(F.lit("https://news.example.org/u"), key).alias("canonical_url"), link.alias("original_url"),
        label.alias("title"), roles.null("string").alias("author"), F.when(key % 5 == 0, F.lit(AS_OF)).alias("published_at"), F.when(key % 7 == 0, F.col("p_name")).alias("summary"),
        roles.null("string").alias("image_url"), F.lit("").alias("content_hash"), F.lit(False).alias("is_read"), F.lit(False).alias("is_favorite"), key.alias("created_at"), key.alias("observed_at"),
        F.lit("rss").alias("provider_id"), roles.null("string").alias("provider_label"), roles.null("string").alias("external_id"), link.alias("canonical_identity"),
    )
    origins = entries.select(F.col("id").alias("entry_id"), "source_id", "provider_id", F.lit("").alias("external_id"), "provider_label", "original_url", "observed_at").unionByName(
        entries.where(key_of("id") % 6 == 0).select(F.col("id").alias("entry_id"), F.lit("m").alias("source_id"), "provider_id", F.lit("").alias("external_id"), "provider_label", "original_url", "observed_at")
    )
    made = spark.createDataFrame([(f"n{i}", "https://news.example.org/?q=3") for i in range(3)], "sid string, surl string")
    sources = roles._source_rows(made, id=F.col("sid"), url=F.col("surl"), kind=F.lit("rss"))
    state = schemas.state_of(spark, sources=sources, entries=entries, entry_origins=origins)
    return maintenance.prune_nav(state, sources).entries.select("id", "source_id", "title")


def key_of(column: str):
    return F.substring(column, 2, 20).cast("bigint")
