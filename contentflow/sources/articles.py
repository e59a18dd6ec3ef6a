"""Article bodies: container choice, clean-up, and the fallback chain to feed-supplied text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.functions import text, urls
from contentflow.functions.binding import staged
from contentflow.sources.clean import asset, with_clean_body
from contentflow.sources.page_facts import page_facts
from contentflow.sources.pages import page_day

# --- fixed values -----------------------------------------------------------
MIN_CONTAINER_TEXT = 40
MIN_FALLBACK_TEXT = 24
FULL_ARTICLE = 220
# ---------------------------------------------------------------------------


def best_container(containers: Column) -> Column:
    """The container with the highest priority, then the best score, then the first one."""
    ranked = F.transform(
        F.filter(containers, lambda c: c["text_length"] >= MIN_CONTAINER_TEXT),
        lambda c, i: F.struct(
            c["priority"].alias("priority"),
            (c["text_length"] + c["paragraphs"] * 140 + c["images"] * 90 - c["links"] * 18).alias("score"),
            (-i).alias("order"),
            c.alias("container"),
        ),
    )
    return F.array_max(ranked)["container"]


def content_quality(container: Column) -> Column:
    """Text, blocks, headings and media minus a penalty for link-heavy text."""
    length, links = container["quality_text"], container["link_text"]
    density = F.when(length > 0, links / length).otherwise(F.lit(1.0))
    penalty = F.floor(density * length * 0.7 + 0.5)
    return (
        length + container["blocks"] * 120 + container["headings"] * 90 + container["media"] * 70 - penalty
    ).cast("bigint")


def plain_text(html: Column) -> Column:
    """Visible text of cleaned HTML, which holds no scripts."""
    return text.collapse(text.unescape_entities(F.regexp_replace(html, r"<[^>]*>", "")))


def extract_articles(pages: DataFrame) -> DataFrame:
    """Body, title, author, date and cover per page; pages without a usable body are left out.

    ``pages`` needs ``page_id, url, html`` and may carry ``entry_title``,
    ``entry_author``, ``entry_day``, ``entry_image`` and ``entry_summary`` of the
    stored entry. Facts and the choice of the container stay in the page's row;
    the nodes of the chosen body meet after one exchange.
    """
    hints = {"entry_title": "string", "entry_author": "string", "entry_day": "bigint", "entry_image": "string", "entry_summary": "string"}
    for name, kind in hints.items():
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    profiled = pages.select("page_id", "url", *hints, "html").withColumn("scientific", urls.render_profile(F.col("url")) == "scientific")
    facts = page_facts(profiled, ["head", "containers"])
    chosen = staged(facts, container=best_container(F.col("containers"))).where(F.col("container").isNotNull())
    head, box = F.col("head"), F.col("container")
    title = text.blank_to_null(text.collapse(F.coalesce(head["og_title"], head["twitter_title"], text.blank_to_null(head["h1"]), F.col("entry_title"))))
    body = F.substring(F.col("html"), box["first"] + 1, box["last"] - box["first"])
    titled = chosen.select(
        "page_id", "url", *hints, "scientific", "head", "container", title.alias("title"), body.alias("body")
    )
    sanitised = with_clean_body(titled, "body", "url", "title", "entry_summary", "scientific")
    head, box = F.col("head"), F.col("container")
    linked = staged(sanitised, content_html=F.col("clean"), text=plain_text(F.col("clean")))
    cover = urls.absolute_url(F.coalesce(head["cover"], F.col("entry_image")), F.col("url"))
    shown = staged(linked.where(F.col("text") != ""), cover=F.when(urls.is_public_url(cover), cover))
    return shown.select(
        "page_id",
        "url",
        F.coalesce("title", "entry_title").alias("title"),
        F.coalesce(text.compact(head["author"]), text.compact(head["byline"]), text.compact(F.col("entry_author"))).alias("author"),
        F.coalesce(page_day(head["dates"]), F.col("entry_day")).alias("published_at"),
        F.when(~F.col("content_html").contains(F.coalesce(asset(F.col("cover")), F.lit("\0"))), F.col("cover")).alias("cover_image_url"),
        F.when(F.col("scientific"), "scientific").otherwise("standard").alias("render_profile"),
        content_quality(box).alias("quality"),
        box["priority"].alias("priority"),
        "content_html",
        "text",
        F.length("text").alias("text_length"),
    )


def feed_bodies(entries: DataFrame, feed_items: DataFrame) -> DataFrame:
    """``(id, feed_html)`` of entries whose feed item carries a body.

    An item belongs to an entry when its canonical address is the stored one or
    the canonical form of the entry's original address: two equi joins, not an OR.
    """
    items = staged(
        feed_items.where(F.col("feed_content_html").isNotNull()), item_key=urls.canonical_url(F.col("url"))
    ).select("source_id", "item_key", "seq", "feed_content_html")
    keyed = staged(entries.select("id", "source_id", "canonical_url", "original_url"), original_key=urls.canonical_url(F.col("original_url")))
    keys = keyed.select("id", "source_id", F.col("canonical_url").alias("item_key")).unionByName(
        keyed.where(F.col("original_key") != F.col("canonical_url")).select("id", "source_id", F.col("original_key").alias("item_key"))
    )
    found = keys.join(items, ["source_id", "item_key"])
    return found.groupBy("id").agg(F.min_by("feed_content_html", "seq").alias("feed_html"))


def article_with_fallback(entries: DataFrame, articles: DataFrame, feed_items: DataFrame, sources: DataFrame) -> DataFrame:
    """What to show for every entry: the page's article, the feed's body, the feed's summary, or nothing.

    ``articles`` carries ``page_url`` of the fetched page next to the extracted
    columns; the join key is the entry's original address.
    """
    kinds = sources.select(F.col("id").alias("source_id"), F.col("kind").alias("source_kind"))
    pages = articles.groupBy(F.col("url").alias("original_url")).agg(
        F.max_by(F.struct("content_html", "text_length"), "text_length").alias("page")
    )
    joined = (
        entries.join(kinds, "source_id", "left")
        .join(pages, "original_url", "left")
        .join(feed_bodies(entries, feed_items), "id", "left")
    )
    missing = F.col("page").isNull() & (F.col("source_kind") == "rss") & F.col("feed_html").isNotNull()
    profile = urls.render_profile(F.col("original_url")) == "scientific"
    offered = joined.withColumn("fed", F.when(missing, F.col("feed_html"))).withColumn("untitled", F.lit("")).withColumn("scientific", profile)
    fed = with_clean_body(offered, "fed", "original_url", "untitled", "untitled", "scientific")
    shown = staged(fed.withColumn("fed", F.when(F.col("fed").isNotNull(), F.col("clean"))), fed_text=plain_text(F.col("fed")), short=text.compact(F.col("summary")))
    body_usable = (F.length("fed_text") >= MIN_FALLBACK_TEXT) | F.col("fed").contains("<img")
    summary_usable = F.col("source_kind").isin("rss", "x") & (F.length("short") >= MIN_FALLBACK_TEXT)
    mode = (
        F.when(F.col("page").isNotNull(), "article").when(body_usable, "feed_body").when(summary_usable, "feed_summary").otherwise("unavailable")
    )
    escaped = F.replace(F.replace(F.replace(F.col("short"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = (
        F.when(F.col("content_mode") == "article", F.col("page.content_html"))
        .when(F.col("content_mode") == "feed_body", F.col("fed"))
        .when(F.col("content_mode") == "feed_summary", F.concat(F.lit("<p>"), escaped, F.lit("</p>")))
    )
    return staged(shown, content_mode=mode).select("id", "source_id", "original_url", "title", "summary", "content_mode", html.alias("content_html"))
