"""First look at fetched addresses: feed, page with a declared feed, or page to be read as a list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentflow.functions import urls
from contentflow.functions.binding import staged
from contentflow.schemas import write_through
from contentflow.sources.feeds import ITEMS_PER_DOCUMENT, feed_heads, is_feed, parse_feeds
from contentflow.sources.pages import REVIEW_BELOW, discover_feeds, extract_listing

# --- fixed values -----------------------------------------------------------
UNSUPPORTED_HOST = r"(?i)(^|\.)(?:x|twitter)\.com$"
MANUAL_HOST = r"(?i)(^|\.)xiaohongshu\.com$"
FEED_CONFIDENCE, DECLARED_CONFIDENCE = 1.0, 0.98
# ---------------------------------------------------------------------------


def probe(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdict and preview rows for every fetched address of the dump.

    A page that declares a feed becomes that feed when the dump holds it with
    items. A loopback address may only be a feed, and social hosts whose rules
    forbid reading are refused. The verdict holds ``seq, kind, url, title,
    confidence, requires_review, initial_status``; previews are numbered by ``row``.
    """
    host = urls.url_host(F.col("url"))
    usable = urls.is_feed_url_allowed(F.col("url"), allow_loopback=True) & ~host.rlike(UNSUPPORTED_HOST)
    feed = is_feed(F.col("content_type"), F.col("text"))
    judged = staged(raw, usable=F.coalesce(usable, F.lit(False)), feed=F.coalesce(feed, F.lit(False)), loopback=urls.is_loopback(F.col("url")))
    open_rows = judged.where(F.col("usable"))

    documents = open_rows.where("feed").select(*raw.columns)
    items = write_through(parse_feeds(documents), "probe-items")
    counts = items.groupBy(F.floor(F.col("seq") / ITEMS_PER_DOCUMENT).alias("seq")).agg(F.count("*").alias("entries"))
    heads = write_through(feed_heads(documents).join(counts, "seq", "left").select("seq", "feed_url", "title", F.coalesce("entries", F.lit(0)).alias("entries")), "probe-heads")

    pages = open_rows.where(~F.col("feed") & ~F.col("loopback")).select(F.col("seq").alias("page_id"), "url", F.col("text").alias("html"))
    working = heads.where(F.col("entries") > 0).groupBy("feed_url").agg(F.max_by(F.struct("seq", "title"), "seq").alias("feed"))
    declared = (
        discover_feeds(pages).join(working, "feed_url").groupBy("page_id").agg(F.min_by(F.struct("feed_url", "feed"), "rank").alias("found"))
    )
    entries, result = extract_listing(pages.join(declared, "page_id", "left_anti"))
    listed = result.join(pages.select("page_id", "url"), "page_id")

    def verdict(rows: DataFrame, seq, kind: str, url, title, score, review) -> DataFrame:
        return rows.select(
            seq.alias("seq"), F.lit(kind).alias("kind"), url.alias("url"), title.alias("title"), score.cast("double").alias("confidence"), review.alias("requires_review")
        )

    found = F.col("found")
    verdicts = (
        verdict(heads, F.col("seq"), "rss", F.col("feed_url"), F.col("title"), F.lit(FEED_CONFIDENCE), F.lit(False))
        .unionByName(verdict(declared, F.col("page_id"), "rss", found["feed_url"], found["feed"]["title"], F.lit(DECLARED_CONFIDENCE), F.lit(False)))
        .unionByName(
            verdict(listed, F.col("page_id"), "generic", F.col("url"), F.col("page_title"), F.col("confidence"), F.col("fallback") | (F.col("confidence") < REVIEW_BELOW))
        )
    )
    manual = urls.url_host(F.col("url")).rlike(MANUAL_HOST)
    verdicts = verdicts.withColumns(
        {
            "initial_status": F.when((F.col("kind") == "generic") & (F.col("confidence") < 0.5) & ~manual, "needs_review").otherwise("active"),
            "requires_review": F.col("requires_review") & ~manual,
            "confidence": F.when(manual, F.lit(1.0)).otherwise(F.col("confidence")),
            "kind": F.when(manual, "manual").otherwise(F.col("kind")),
        }
    )
    by_document = items.select(F.floor(F.col("seq") / ITEMS_PER_DOCUMENT).alias("document"), F.col("seq").alias("place"), "url", "title", "published_at")
    through_page = by_document.join(declared.select(F.col("page_id").alias("seq"), found["feed"]["seq"].alias("document")), "document")
    shown = (
        by_document.withColumnRenamed("document", "seq")
        .unionByName(through_page.drop("document"))
        .unionByName(entries.select(F.col("page_id").alias("seq"), F.col("place").cast("bigint").alias("place"), F.col("entry_url").alias("url"), "title", "published_at"))
    )
    row = F.row_number().over(Window.partitionBy("seq").orderBy("place"))
    return verdicts, shown.withColumn("row", row).drop("place")
