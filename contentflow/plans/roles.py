"""The given tables in the roles of a content library.

Every role is a projection, join or aggregate over whole tables, so each job
built on it grows with them:

* ``supplier`` are sources, ``orders`` entries, ``lineitem`` their origins
* ``pages`` is the crawl dump, one source per host
* ``documents`` are syndicated articles, one permalink per distinct text
* ``events`` is the run log of one source per user, or a user-action log
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentflow import schemas
from contentflow.functions import text, urls
from contentflow.functions.binding import spread
from contentflow.operators.normalize import normalize
from contentflow.schemas import State

# 2024-01-31T12:00:00Z, the clock of every job run on the given tables.
AS_OF = 1_706_702_400_000
ORDER_CLOCK = 883_656_000_000  # 1998-01-01T12:00:00Z, a day inside the order dates
DAY = 86_400_000
KINDS = ["rss", "generic", "manual", "zhihu", "zhihu_follow", "x", "xiaohongshu", "academic"]
STATUSES = ["active", "error", "needs_review", "paused"]


# Tables of long texts, where the work per row is large.
TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXT_TABLES else rows


def ms(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _source_rows(rows: DataFrame, **fields: Column) -> DataFrame:
    """Sources table with the given fields; the others are empty."""
    kinds = {part.split()[0]: part.split()[1] for part in schemas.SOURCES.replace("\n", " ").split(",")}
    return rows.select(*[fields.get(c, null(kinds[c])).cast(kinds[c]).alias(c) for c in schemas.columns(schemas.SOURCES)])


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return _source_rows(
        table(spark, sf_dir, "supplier"),
        id=F.concat(F.lit("s"), key),
        url=F.concat(F.lit("https://h"), F.pmod(key, F.lit(7)), F.lit(".example.org/feed/"), key),
        title=F.col("s_name"),
        category=F.when(key % 5 == 0, F.concat(F.lit("Nation "), F.col("s_nationkey"))),
        kind=pick(KINDS, key),
        connector_id=pick(KINDS, key),
        status=pick(STATUSES, F.floor(key / 2)),
        polling_enabled=key % 6 != 0,
        refresh_interval_minutes=F.when(key % 3 == 1, F.lit(30)).when(key % 3 == 2, F.lit(120)),
        etag=F.concat(F.lit("tag"), key),
        next_check_at=F.lit(AS_OF - 5 * DAY) + F.round(F.col("s_acctbal") * 100).cast("bigint") * 600,
        consecutive_empty=F.lit(0),
        failure_count=F.lit(0),
        created_at=key * 1000,
        updated_at=key * 1000 + F.col("s_nationkey"),
    )


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = F.when(F.col("l_returnflag") == "A", "rss").when(F.col("l_returnflag") == "N", "generic").otherwise("x")
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("e"), F.col("l_orderkey")).alias("entry_id"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("source_id"),
        provider.alias("provider_id"),
        F.col("l_linenumber").cast("string").alias("external_id"),
        ms("l_shipdate").alias("seen"),
    )
    return rows.groupBy(*schemas.ORIGIN_KEY).agg(F.max("seen").alias("observed_at")).select(
        *schemas.ORIGIN_KEY,
        null("string").alias("provider_label"),
        F.concat(
            F.lit("https://www.example.org/o/"), F.substring("entry_id", 2, 30), F.lit("?line="), F.col("external_id")
        ).alias("original_url"),
        "observed_at",
    )


def entries(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> DataFrame:
    """Orders as entries, owned by their earliest origin; an order without lines is an orphan."""
    seen = origins(spark, sf_dir) if seen is None else seen
    owner = seen.groupBy(F.col("entry_id").alias("id")).agg(
        F.min_by("source_id", F.struct("observed_at", "source_id")).alias("owner")
    )
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    created = ms("o_orderdate") + F.lit(DAY) * (customer % 30)
    url = F.concat(F.lit("https://www.example.org/o/"), key)
    rows = table(spark, sf_dir, "orders").withColumn("id", F.concat(F.lit("e"), key)).join(owner, "id", "left")
    return rows.select(
        "id",
        F.coalesce("owner", F.concat(F.lit("s"), customer % 10)).alias("source_id"),
        url.alias("canonical_url"),
        url.alias("original_url"),
        F.concat(F.lit("Order "), key).alias("title"),
        F.concat(F.lit("Customer "), customer).alias("author"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", ms("o_orderdate")).alias("published_at"),
        F.col("o_orderpriority").alias("summary"),
        null("string").alias("image_url"),
        F.sha2(url, 256).alias("content_hash"),
        (F.col("o_orderstatus") == "F").alias("is_read"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_favorite"),
        created.alias("created_at"),
        F.when(customer % 4 != 0, created + 1000).alias("observed_at"),
        pick(KINDS, customer).alias("provider_id"),
        null("string").alias("provider_label"),
        null("string").alias("external_id"),
        url.alias("canonical_identity"),
    )


def library(spark: SparkSession, sf_dir: str) -> State:
    seen = origins(spark, sf_dir)
    dimension = sources(spark, sf_dir)
    subscriptions = dimension.select(
        "id",
        F.col("id").alias("source_id"),
        "connector_id",
        F.lit("acc").alias("account_id"),
        null("string").alias("target_id"),
        F.lit("{}").alias("config_json"),
        "created_at",
        "updated_at",
    )
    markers = dimension.where(F.col("id").endswith("1")).select(
        F.col("id").alias("source_id"), F.lit(1).alias("revision"), "updated_at"
    )
    return schemas.state_of(
        spark,
        sources=dimension,
        entry_origins=seen,
        entries=entries(spark, sf_dir, seen),
        subscriptions=subscriptions,
        maintenance=markers,
    )


def raw_entries(rows: DataFrame, **fields: Column) -> DataFrame:
    kinds = {part.split()[0]: part.split()[1] for part in schemas.RAW_ENTRY.replace("\n", " ").split(",")}
    return rows.select(*[fields.get(c, null(kinds[c])).cast(kinds[c]).alias(c) for c in schemas.columns(schemas.RAW_ENTRY)])


def page_sources(pages: DataFrame) -> DataFrame:
    """One generic source per crawled origin."""
    found = pages.select(urls.url_origin(F.col("url")).alias("origin")).where(F.col("origin").isNotNull()).distinct()
    return _source_rows(
        found,
        id=F.col("origin"),
        url=F.concat("origin", F.lit("/")),
        title=F.col("origin"),
        kind=F.lit("generic"),
        connector_id=F.lit("generic"),
        status=F.lit("active"),
        polling_enabled=F.lit(True),
    )


def page_items(pages: DataFrame) -> DataFrame:
    """The crawl dump as raw items, title from the document head."""
    title = text.unescape_entities(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return raw_entries(
        pages,
        source_id=urls.url_origin(F.col("url")),
        seq=F.col("page_id"),
        url=F.col("url"),
        title=text.compact(title),
        observed_at=F.lit(AS_OF) + F.col("page_id"),
    )


def page_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return normalize(page_items(pages), page_sources(pages), AS_OF)


def document_sources(documents: DataFrame) -> DataFrame:
    return _source_rows(
        documents.select("source").distinct(),
        id=F.col("source"),
        url=F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/feed")),
        title=F.col("source"),
        kind=F.lit("rss"),
        connector_id=F.lit("rss"),
        status=F.lit("active"),
        polling_enabled=F.lit(True),
    )


def document_items(documents: DataFrame) -> DataFrame:
    """Documents as syndicated items: copies of one text share a permalink and differ in delivery state."""
    key = F.col("doc_id")
    link = F.concat(
        F.lit("https://News.Example.org/a/"), F.md5("text"), F.lit("/?utm_source="), F.col("source"), F.lit("&id=1#top")
    )
    return raw_entries(
        documents,
        source_id=F.col("source"),
        seq=key,
        url=link,
        title=F.concat(F.lit("Document "), key),
        author=F.when(key % 3 != 0, F.col("lang")),
        published_at=F.when(key % 4 == 0, F.lit(AS_OF) - key * 60_000),
        summary=F.when(key % 5 != 0, F.concat(F.lit("n="), F.col("n_chars"))),
        external_id=F.when(key % 2 == 0, key.cast("string")),
        observed_at=F.lit(AS_OF) + key,
    )


def document_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return normalize(document_items(documents), document_sources(documents), AS_OF)


def runs(events: DataFrame) -> DataFrame:
    """The event log as sync runs: errors fail, views are empty successes."""
    outcome = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "empty").otherwise("success")
    return events.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("source_id"),
        outcome.alias("outcome"),
        F.floor("value").cast("int").alias("fetched_count"),
        F.floor(F.col("value") / 2).cast("int").alias("inserted_count"),
        F.concat(F.lit("run "), F.col("props")).alias("message"),
        ms("ts").alias("created_at"),
    )


def run_sources(events: DataFrame) -> DataFrame:
    key = F.col("user_id")
    return _source_rows(
        events.select("user_id").distinct(),
        id=F.concat(F.lit("u"), key),
        url=F.concat(F.lit("https://h"), key % 9, F.lit(".example.org/"), key),
        title=F.concat(F.lit("User "), key),
        kind=pick(KINDS, key),
        connector_id=pick(KINDS, key),
        status=F.lit("active"),
        polling_enabled=key % 7 != 0,
        refresh_interval_minutes=F.when(key % 3 != 0, F.lit(60)),
    )


def actions(events: DataFrame) -> DataFrame:
    """The event log as user actions on orders; the entry is drawn from the event id."""
    action = (
        F.when(F.col("event_type") == "view", "read")
        .when(F.col("event_type") == "click", "read")
        .when(F.col("event_type") == "purchase", "favorite")
        .when(F.col("event_type") == "signup", "favorite")
        .otherwise("dismiss")
    )
    return events.select(
        F.concat(F.lit("e"), (F.col("event_id") * 7 + F.col("user_id")) % 20000).alias("entry_id"),
        action.alias("action"),
        F.col("event_type").isin("view", "purchase").alias("value"),
        F.col("event_id").alias("seq"),
    )
