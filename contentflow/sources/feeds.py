"""RSS, Atom and JSON Feed documents to raw entries, parsed in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow import schemas
from contentflow.functions import text, urls
from contentflow.functions.binding import let, staged

# --- fixed values -----------------------------------------------------------
FEED_CONTENT_TYPE = r"(?i)(?:rss|atom|feed\+json|xml)"
FEED_PROLOG = r"(?i)^\s*<(?:\?xml[^>]*>)?\s*<(rss|feed)\b"
JSON_START = r"^\s*\{"
BLOCK_TAG = r"(?is)</?(?:h\d|br|p|ul|ol|li|blockquote|section|table|tr|div)(?:\s[^>]*)?/?>"
# ---------------------------------------------------------------------------

# Room for the items of one document inside the order of documents.
ITEMS_PER_DOCUMENT = 1_000_000

_RSS_ITEM = """struct<title:string, link:string, guid:struct<_VALUE:string>, pubDate:string, `dc:date`:string,
 description:string, `content:encoded`:string, `dc:creator`:string, author:string,
 `media:content`:array<struct<_url:string>>, enclosure:array<struct<_url:string>>>"""
RSS = f"""channel struct<title:string, image:struct<url:string>, `itunes:image`:struct<_href:string>,
 item:array<{_RSS_ITEM}>>, item array<{_RSS_ITEM}>"""
ATOM = """title struct<_VALUE:string>, icon string, logo string,
 entry array<struct<title:struct<_VALUE:string>, link:array<struct<_rel:string,_href:string>>, published:string, updated:string,
 author:array<struct<name:string>>, content:struct<_VALUE:string>, summary:struct<_VALUE:string>>>"""
JSON_FEED = """version string, title string, icon string, favicon string, items array<struct<id:string, url:string,
 external_url:string, title:string, summary:string, content_text:string, content_html:string, date_published:string,
 date_modified:string, image:string, banner_image:string, authors:array<struct<name:string>>, author:struct<name:string>>>"""


def is_feed(content_type: Column, body: Column) -> Column:
    """Routes a fetched document to the feed parsers: by content type, XML prolog or a leading brace."""
    return F.coalesce(content_type.rlike(FEED_CONTENT_TYPE), F.lit(False)) | body.rlike(FEED_PROLOG) | body.rlike(JSON_START)


_HEAD = """channel struct<title:string, image:struct<url:string>, `itunes:image`:struct<_href:string>>, item array<struct<title:string>>,
 title struct<_VALUE:string>, icon string, logo string, entry array<struct<updated:string>>"""
_JSON_HEAD = "version string, icon string, favicon string, items array<struct<id:string>>"


def feed_verdict() -> Column:
    """struct(problem, icon) of a document (``content_type, text``), whose head is parsed once.

    ``problem`` says why it is no readable feed and is null for one that is;
    ``icon`` is the declared one, not resolved.
    """
    body = F.col("text")

    def from_json(head: Column) -> Column:
        problem = F.when(head["version"].isNull() | head["items"].isNull(), F.lit("no JSON Feed"))
        return F.struct(problem.alias("problem"), _first(head["icon"], head["favicon"]).alias("icon"))

    def from_xml(head: Column) -> Column:
        empty = head["channel"].isNull() & head["item"].isNull() & head["title"].isNull() & head["entry"].isNull()
        problem = F.when(F.coalesce(empty, F.lit(True)), F.lit("feed cannot be parsed"))
        channel = head["channel"]
        icon = _first(channel["image"]["url"], channel["itunes:image"]["_href"], head["icon"], head["logo"])
        return F.struct(problem.alias("problem"), icon.alias("icon"))

    neither = F.struct(F.lit("no feed document").alias("problem"), F.lit(None).cast("string").alias("icon"))
    return (
        F.when(~F.coalesce(is_feed(F.col("content_type"), body), F.lit(False)), neither)
        .when(body.rlike(JSON_START), let(F.from_json(body, _JSON_HEAD), from_json))
        .otherwise(let(F.from_xml(body, _HEAD), from_xml))
    )


def feed_problem() -> Column:
    """Why a document (``content_type, text``) is no readable feed; null for one that is."""
    return feed_verdict()["problem"]


def _first(*options: Column) -> Column:
    """First option that is neither null nor empty."""
    return F.coalesce(*[text.blank_to_null(option) for option in options])


def utc_day(value: Column) -> Column:
    """Day of a machine date in UTC; the label's own day when it has no machine form."""
    iso = F.when(value.rlike(r"^\s*\d{4}-\d{2}-\d{2}T"), F.floor(text.instant_ms(value) / text.DAY_MS) * text.DAY_MS)
    rfc = text.published_day(text.rfc822_utc_day(value))
    return F.coalesce(iso.cast("bigint"), rfc, text.published_day(value))


def snippet(html: Column) -> Column:
    """Visible text of an item body: block tags break lines, other tags vanish, entities are decoded."""
    return text.unescape_entities(F.regexp_replace(F.regexp_replace(html, BLOCK_TAG, "\n"), r"<[^>]*>", ""))


def feed_html(html: Column) -> Column:
    """Item body kept whole for the article job; null when blank."""
    return text.blank_to_null(F.trim(html))


def is_nav_item(url: Column, title: Column, feed_url: Column, feed_title: Column, bare: Column) -> Column:
    """A bare item that points at the feed's own home or carries a social network's name."""
    same_site = urls.url_origin(url) == urls.url_origin(feed_url)
    home = (urls.url_path(url) == urls.url_path(feed_url)) & (urls.url_query(url) == urls.url_query(feed_url))
    named = F.coalesce(feed_title == title, F.lit(False))
    social = urls.url_host(url).rlike(urls.SOCIAL_HOST) & (title.rlike(urls.SOCIAL_LABEL) | named)
    return bare & F.coalesce((same_site & (home | named)) | social, F.lit(False))


def _documents(raw: DataFrame) -> DataFrame:
    return raw.select("source_id", "seq", F.col("url").alias("feed_url"), "text")


_COMMON = ["source_id", "seq", "feed_url", "feed_title", "icon"]


def _xml_items(raw: DataFrame) -> DataFrame:
    """One row per RSS or Atom item, both dialects in one shape."""
    documents = _documents(raw.where(~F.col("text").rlike(JSON_START)))
    atom = F.col("text").rlike(r"<(?:\w+:)?feed[\s>]") & ~F.col("text").rlike(r"<rss[\s>]")
    rss_doc = staged(documents.where(~atom), doc=F.from_xml(F.col("text"), RSS))
    channel = F.col("doc.channel")
    rss = rss_doc.select(
        "source_id",
        "seq",
        "feed_url",
        channel["title"].alias("feed_title"),
        _first(channel["image"]["url"], channel["itunes:image"]["_href"]).alias("icon"),
        F.posexplode_outer(F.coalesce(channel["item"], F.col("doc.item"))).alias("pos", "item"),
    ).select(
        *_COMMON,
        "pos",
        _first(F.col("item.link"), F.col("item.guid._VALUE")).alias("link"),
        F.col("item.title").alias("title"),
        _first(F.col("item.pubDate"), F.col("item.`dc:date`")).alias("date"),
        snippet(F.col("item.description")).alias("summary"),
        _first(F.col("item.`content:encoded`"), F.col("item.description")).alias("body"),
        _first(F.col("item.`dc:creator`"), F.col("item.author")).alias("author"),
        _first(
            F.get(F.col("item.`media:content`"), F.lit(0))["_url"], F.get(F.col("item.enclosure"), F.lit(0))["_url"]
        ).alias("image"),
    )
    atom_doc = staged(documents.where(atom), doc=F.from_xml(F.col("text"), ATOM))
    alternate = F.get(F.filter(F.col("item.link"), lambda l: l["_rel"] == "alternate"), F.lit(0))["_href"]
    entry = atom_doc.select(
        "source_id",
        "seq",
        "feed_url",
        F.col("doc.title._VALUE").alias("feed_title"),
        _first(F.col("doc.icon"), F.col("doc.logo")).alias("icon"),
        F.posexplode_outer("doc.entry").alias("pos", "item"),
    ).select(
        *_COMMON,
        "pos",
        _first(alternate, F.get(F.col("item.link"), F.lit(0))["_href"]).alias("link"),
        F.col("item.title._VALUE").alias("title"),
        _first(F.col("item.published"), F.col("item.updated")).alias("date"),
        _first(snippet(F.col("item.content._VALUE")), F.col("item.summary._VALUE")).alias("summary"),
        F.col("item.content._VALUE").alias("body"),
        F.get(F.col("item.author"), F.lit(0))["name"].alias("author"),
        F.lit(None).cast("string").alias("image"),
    )
    return rss.unionByName(entry).withColumn("day", utc_day(F.col("date")))


def _json_items(raw: DataFrame) -> DataFrame:
    parsed = staged(_documents(raw.where(F.col("text").rlike(JSON_START))), doc=F.from_json("text", JSON_FEED))
    valid = parsed.where(F.col("doc.version").isNotNull() & F.col("doc.items").isNotNull())
    author = _first(F.get(F.col("item.authors"), F.lit(0))["name"], F.col("item.author.name"))
    return valid.select(
        "source_id",
        "seq",
        "feed_url",
        F.col("doc.title").alias("feed_title"),
        _first(F.col("doc.icon"), F.col("doc.favicon")).alias("icon"),
        F.posexplode_outer("doc.items").alias("pos", "item"),
    ).select(
        *_COMMON,
        "pos",
        _first(F.col("item.url"), F.col("item.external_url"), F.col("item.id")).alias("link"),
        F.col("item.title").alias("title"),
        F.col("item.date_published").alias("date"),
        _first(F.col("item.summary"), F.col("item.content_text"), text.strip_tags(F.col("item.content_html"))).alias("summary"),
        F.col("item.content_html").alias("body"),
        author.alias("author"),
        _first(F.col("item.image"), F.col("item.banner_image")).alias("image"),
        F.coalesce(text.published_day(F.col("item.date_published")), text.published_day(F.col("item.date_modified"))).alias("day"),
    )


def _entries(items: DataFrame) -> DataFrame:
    """Shared projection of all dialects; items without address or title and navigation items go."""
    base = staged(
        items.where(F.col("pos").isNotNull()),
        item_url=urls.absolute_url(F.col("link"), F.col("feed_url")),
        item_title=text.compact(F.col("title")),
        item_summary=text.compact(F.col("summary")),
        html=feed_html(F.col("body")),
        image_url=urls.absolute_url(F.col("image"), F.col("feed_url")),
    ).where(F.col("item_url").isNotNull() & F.col("item_title").isNotNull())
    bare = (
        F.col("day").isNull() & F.col("item_summary").isNull() & F.col("html").isNull() & F.col("image_url").isNull()
    )
    nav = is_nav_item(
        F.col("item_url"), F.col("item_title"), F.col("feed_url"), text.compact(F.col("feed_title")), bare
    )
    # Only bare items pay for the address comparison.
    judged = staged(base, nav=F.when(bare, nav).otherwise(F.lit(False))).where(~F.col("nav"))
    missing = F.lit(None).cast("string")
    return judged.select(
        "source_id",
        (F.col("seq") * ITEMS_PER_DOCUMENT + F.col("pos")).alias("seq"),
        F.col("item_url").alias("url"),
        F.col("item_title").alias("title"),
        text.compact(F.col("author")).alias("author"),
        F.col("day").alias("published_at"),
        F.col("item_summary").alias("summary"),
        "image_url",
        missing.alias("external_id"),
        missing.alias("canonical_identity"),
        F.lit(None).cast("bigint").alias("observed_at"),
        missing.alias("provider_id"),
        missing.alias("provider_label"),
        F.col("html").alias("feed_content_html"),
    ).select(*schemas.columns(schemas.RAW_ENTRY))


def parse_xml_feeds(raw: DataFrame) -> DataFrame:
    return _entries(_xml_items(raw))


def parse_json_feeds(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries, and the documents that look like JSON but are no JSON Feed."""
    documents = raw.where(F.col("text").rlike(JSON_START))
    parsed = staged(documents, doc=F.from_json("text", "version string, items array<struct<id:string>>"))
    rejects = parsed.where(F.col("doc.version").isNull() | F.col("doc.items").isNull()).drop("doc")
    return _entries(_json_items(raw)), rejects


def parse_feeds(raw: DataFrame) -> DataFrame:
    """Every feed dialect; documents that are no feed should be filtered with ``is_feed`` first."""
    return _entries(_xml_items(raw).unionByName(_json_items(raw)))


def feed_heads(raw: DataFrame) -> DataFrame:
    """Per feed document: title, or host when it has none, and the declared icon."""
    items = _xml_items(raw).unionByName(_json_items(raw))
    heads = items.groupBy("source_id", "seq", "feed_url").agg(
        F.first("feed_title", ignorenulls=True).alias("title"), F.first("icon", ignorenulls=True).alias("icon"), F.count("pos").alias("items")
    )
    return heads.select(
        "source_id",
        "seq",
        "feed_url",
        F.coalesce(text.compact(F.col("title")), urls.url_host(F.col("feed_url"))).alias("title"),
        urls.absolute_url(F.col("icon"), F.col("feed_url")).alias("icon_url"),
        "items",
    )


def feed_icons(raw: DataFrame) -> DataFrame:
    """Declared icons with a public address, one per source (the newest document's)."""
    heads = staged(feed_heads(raw), public=urls.is_public_url(F.col("icon_url")))
    return heads.where("public").groupBy("source_id").agg(F.max_by("icon_url", "seq").alias("icon_url"))
