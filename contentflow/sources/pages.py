"""Feed discovery and listing extraction over the facts of fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentflow.functions import text, urls
from contentflow.functions.binding import let, staged
from contentflow.operators.merge import first_by_key
from contentflow.schemas import write_through
from contentflow.sources.elements import page_elements
from contentflow.sources.page_facts import json_ld, page_cards, page_facts, with_head

# --- fixed values -----------------------------------------------------------
DECLARED_FEED = r"(?i)(?:rss|atom|feed\+json|application/(?:json|xml))"
FEED_PATH = r"(?i)(?:^|/)(?:rss|atom|feed)(?:[/.]|$)|\.(?:rss|atom|xml|json)$"
FEED_LABEL = r"(?i)(?:rss|atom|feed|subscribe|syndicat)"
FEED_QUERY = r"(?i)(?:^|&)(?:format|output|type)=(?:rss|atom|feed|json)(?:&|$)"
LABELS = {
    "article": "文章卡片",
    "li": "列表项目",
    "class": "页面内容卡片",
    "link": "「%s」文章链接",
    "many": "（%d 篇）",
    "single": "（1 篇，单篇监测）",
}
PAIR_THRESHOLD, SINGLE_THRESHOLD = 1.9, 2.35
RULE_REVISION = 3
REVIEW_BELOW = 0.75
# ---------------------------------------------------------------------------


def page_day(dates: Column) -> Column:
    """Publication day of a page: the best-ranked statement that is a date."""
    read = F.transform(
        dates, lambda d, i: F.struct(d["rank"].alias("rank"), i.alias("i"), text.published_day(d["value"]).alias("day"))
    )
    return F.array_min(F.filter(read, lambda d: d["day"].isNotNull()))["day"]


def discover_feeds(pages: DataFrame, k: int | None = None) -> DataFrame:
    """Feed addresses a page declares or links to, distinct, in document order; with ``k`` the first ones.

    ``pages`` needs ``page_id, url, html``. The links of a page stay in its row
    until they are filtered.
    """
    facts = page_facts(pages.select("page_id", "url", "html"), ["links"]).drop("html")
    link = F.col("link")
    exploded = facts.select("page_id", "url", F.explode("links").alias("link"))
    resolved = staged(exploded, feed_url=urls.absolute_url(link["href"], F.col("url")))
    path, query = urls.url_path(F.col("feed_url")), urls.url_query(F.col("feed_url"))
    likely = path.rlike(FEED_PATH) | query.rlike(FEED_QUERY)
    declared = (link["kind"] == "link") & link["rel_type"].rlike(DECLARED_FEED)
    named = (link["kind"] == "a") & link["label"].rlike(FEED_LABEL) & query.rlike(FEED_QUERY)
    hits = resolved.where(F.col("feed_url").isNotNull() & (declared | F.coalesce(likely | named, F.lit(False))))
    first = hits.groupBy("page_id", "feed_url").agg(F.min(link["pos"]).alias("pos"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return first_ranked(first.withColumn("rank", rank), "rank", k).select("page_id", "rank", "feed_url")


def first_ranked(rows: DataFrame, rank: str, k: int | None) -> DataFrame:
    return rows if k is None else rows.where(F.col(rank) <= k)


def card_score() -> Column:
    """Article evidence of one node, from its features."""

    def points(test: Column, value: float) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.lit(value)).otherwise(F.lit(0.0))

    card = F.col("card")
    return (
        points(card["title"].isNotNull(), 0.9)
        + points(card["score_link"], 0.6)
        + points(card["heading"], 0.35)
        + points(card["has_time"] | card["dated"], 0.4)
        + points(card["has_image"], 0.2)
        + points(card["long_paragraph"], 0.35)
        + points(card["length"] > 100, 0.25)
    )


def _selectors(page_url: Column) -> Column:
    """Groups a card belongs to, as ``(order, selector)``: tag, stable classes, first path segment of its link."""
    card = F.col("card")
    names = F.filter(F.split(card["classes"], r"\s+"), lambda n: (n != "") & ~n.rlike(r"[0-9]{5,}") & ~n.contains("__"))
    escaped = F.transform(F.slice(names, 1, 2), lambda n: F.concat(F.lit("."), F.regexp_replace(n, r"([^a-zA-Z0-9_-])", r"\\$1")))
    by_class = F.when(
        F.lower(card["classes"]).rlike(r"(post|entry|article|story|card|item|feed|list|research)") & (F.size(names) > 0),
        F.concat(card["tag"], F.array_join(escaped, "")),
    )

    def by_segment(link: Column) -> Column:
        segment = F.regexp_extract(urls.url_path(link), r"^/+([^/]+)", 1)
        fits = (urls.url_origin(link) == urls.url_origin(page_url)) & ~urls.is_taxonomy_url(link) & segment.rlike(r"(?i)^[a-z0-9_-]+$")
        return F.when(fits, F.concat(F.lit('a[href*="/'), segment, F.lit('/"]')))

    linked = F.when(card["is_link"] & (card["length"] >= 18), let(F.col("card_url"), by_segment))
    groups = F.array(
        F.struct(F.lit(0).alias("order"), F.when(card["tag"] == "article", F.lit("article")).alias("selector")),
        F.struct(F.lit(1).alias("order"), F.when(card["tag"] == "li", F.lit("li")).alias("selector")),
        F.struct(F.lit(2).alias("order"), by_class.alias("selector")),
        F.struct(F.lit(3).alias("order"), linked.alias("selector")),
    )
    return F.filter(groups, lambda g: g["selector"].isNotNull())


def _cards(facts: DataFrame) -> DataFrame:
    """One row per candidate card with its resolved address and entry fields, all of a page in one place."""
    card = F.col("card")
    resolved = staged(page_cards(facts), card_url=urls.absolute_url(card["href"], F.col("url")), evidence=card_score())
    return staged(
        resolved,
        title=text.compact(card["title"]),
        valid=F.coalesce(
            card["title"].isNotNull() & (F.col("card_url") != F.col("url")) & ~urls.is_taxonomy_url(F.col("card_url")), F.lit(False)
        ),
    )


def _entry_fields() -> list[Column]:
    card = F.col("card")
    return [
        F.col("card_url").alias("entry_url"),
        "title",
        text.compact(card["author"]).alias("author"),
        card["day"].alias("published_at"),
        text.compact(card["summary"]).alias("summary"),
        urls.absolute_url(card["image"], F.col("url")).alias("image_url"),
    ]


def card_groups(cards: DataFrame, minimum: int = 2) -> tuple[DataFrame, DataFrame]:
    """Repeated-card groups above the evidence threshold, and their member cards.

    Everything is keyed by page: the rows of one page are brought together once
    and all later grouping and ranking reuses that partitioning.
    """
    members = (
        cards.where(~F.col("card.rule"))
        .withColumn("group", F.explode(_selectors(F.col("url"))))
        .select("*", "group.order", "group.selector")
        .repartition("page_id")
    )
    place = F.row_number().over(Window.partitionBy("page_id", "selector").orderBy("card.pos"))
    members = members.withColumn("place", place)
    sizes = members.groupBy("page_id", "selector").agg(
        F.count("*").alias("nodes"),
        F.min(F.struct("order", "card.pos")).alias("seen"),
        F.avg("evidence").alias("average"),
    )
    firsts = members.where("valid").groupBy("page_id", "selector", "card_url").agg(F.min("place").alias("place"))
    entries = firsts.groupBy("page_id", "selector").agg(F.count("*").alias("entries"))
    score = F.col("average") + F.least(F.col("entries"), F.lit(10)) * 0.08
    threshold = F.when(F.col("entries") == 1, F.lit(SINGLE_THRESHOLD)).otherwise(F.lit(PAIR_THRESHOLD))
    groups = (
        sizes.where(F.col("nodes") >= minimum)
        .join(entries.where(F.col("entries") >= minimum), ["page_id", "selector"])
        .withColumn("score", score)
        .where(F.col("score") >= threshold)
        .withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("score").desc(), "seen")))
        .select("page_id", "selector", "rank", "nodes", "entries", "score")
    )
    kept = members.join(firsts, ["page_id", "selector", "card_url", "place"], "left_semi")
    return groups, kept


def confidence(top: float) -> Column:
    return F.least(
        F.lit(top), F.lit(0.45) + F.least(F.col("entries"), F.lit(8)) * 0.05 + F.least(F.col("score"), F.lit(3.0)) * 0.08
    )


def calibration_candidates(pages: DataFrame, k: int | None = None, preview: int | None = None) -> DataFrame:
    """Candidate groups a person may choose from, single cards included, with their rows; ``k`` and ``preview`` ask for the first ones only."""
    facts = page_elements(pages.select("page_id", "url", F.lit(None).cast("string").alias("rule"), "html"))
    groups, members = card_groups(write_through(_cards(facts), "page-cards"), minimum=1)
    shown = members.join(first_ranked(groups, "rank", k), ["page_id", "selector"])
    row = F.row_number().over(Window.partitionBy("page_id", "selector").orderBy("place"))
    return (
        first_ranked(shown.withColumn("row", row), "row", preview)
        .select("page_id", F.col("rank"), "selector", group_label().alias("label"), "entries", confidence(0.98).alias("confidence"), "row", *_entry_fields())
    )


def group_label() -> Column:
    """What a person sees for a group: its kind and how many entries it holds."""
    segment = F.regexp_extract("selector", r'^a\[href\*="(/.*/)"\]$', 1)
    kind = (
        F.when(F.col("selector") == "article", LABELS["article"])
        .when(F.col("selector") == "li", LABELS["li"])
        .when(segment != "", F.format_string(LABELS["link"], segment))
        .otherwise(LABELS["class"])
    )
    size = F.when(F.col("entries") == 1, LABELS["single"]).otherwise(F.format_string(LABELS["many"], F.col("entries")))
    return F.concat(kind, size)


def extract_listing(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of listing pages and the outcome per page.

    ``pages`` needs ``page_id, url, html`` and may carry ``rule``, a saved
    extraction rule as JSON. The cascade is JSON-LD, saved rule (unless the
    page now shows far more than a narrow automatic rule finds), repeated
    cards, and a single card from the page's own metadata.
    """
    if "rule" not in pages.columns:
        pages = pages.withColumn("rule", F.lit(None).cast("string"))
    # Parsed once; the branches of the cascade read the written metadata and cards, which are far smaller than the pages.
    parsed = write_through(page_elements(pages.select("page_id", "url", "rule", "html")), "page-elements")
    facts = write_through(with_head(staged(parsed, json_ld=json_ld())).select("page_id", "url", "rule", "head", "json_ld", "rule_problem"), "page-facts")
    cards = write_through(_cards(parsed), "page-cards")

    ld = F.col("ld")
    linked = staged(
        facts.select("page_id", "url", F.posexplode("json_ld").alias("place", "ld")),
        entry_url=urls.absolute_url(F.coalesce(ld["url"], ld["page_id"]), F.col("url")),
        title=text.compact(F.coalesce(ld["headline"], ld["name"])),
    ).where(F.col("entry_url").isNotNull() & F.col("title").isNotNull())
    from_ld = linked.select(
        "page_id",
        "place",
        "entry_url",
        "title",
        text.compact(ld["author"]).alias("author"),
        text.published_day(F.coalesce(ld["published"], ld["created"])).alias("published_at"),
        text.compact(F.coalesce(ld["description"], ld["body"])).alias("summary"),
        urls.absolute_url(F.coalesce(ld["image"], ld["thumbnail"]), F.col("url")).alias("image_url"),
    )

    groups, members = card_groups(cards)
    best = groups.where(F.col("rank") == 1)
    from_cards = members.join(best.select("page_id", "selector"), ["page_id", "selector"]).select("page_id", "place", *_entry_fields())
    from_rule = cards.where(F.col("card.rule") & F.col("valid")).select("page_id", F.col("card.pos").alias("place"), *_entry_fields())

    title = F.coalesce(text.compact(F.coalesce(F.col("head.og_title"), F.col("head.title"))), urls.url_host(F.col("url")))
    fallback = facts.select(
        "page_id",
        F.lit(0).alias("place"),
        F.coalesce(urls.absolute_url(F.col("head.og_url"), F.col("url")), F.col("url")).alias("entry_url"),
        title.alias("title"),
        F.lit(None).cast("string").alias("author"),
        page_day(F.col("head.dates")).alias("published_at"),
        text.compact(F.col("head.description")).alias("summary"),
        urls.absolute_url(F.col("head.og_image"), F.col("url")).alias("image_url"),
    )

    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("page_id").agg(F.count("*").alias(name))

    saved = F.from_json("rule", "itemRootSelector string, titleSelector string, timeSelector string, authorSelector string, imageSelector string, summarySelector string, rendererRequired boolean")
    outcome = (
        facts.select("page_id", "url", title.alias("page_title"), saved.alias("saved"))
        .join(count(from_ld, "ld_entries"), "page_id", "left")
        .join(count(from_rule, "rule_entries"), "page_id", "left")
        .join(best.select("page_id", "selector", "entries", "score"), "page_id", "left")
        .na.fill(0, ["ld_entries", "rule_entries", "entries"])
    )
    card_confidence = confidence(0.89)
    replace = rule_is_narrow(F.col("saved"), F.col("rule_entries"), F.col("entries"), card_confidence)
    ruled = F.coalesce(F.col("saved.itemRootSelector"), F.lit("")) != ""
    method = (
        F.when(F.col("ld_entries") >= 1, "json_ld")
        .when(ruled & replace, "cards")
        .when(ruled & (F.col("rule_entries") > 0), "rule")
        .when(ruled, "fallback")
        .when(F.col("entries") > 0, "cards")
        .otherwise("fallback")
    )
    result = staged(outcome, method=method).select(
        "page_id",
        "page_title",
        "method",
        F.when(F.col("method") == "rule", F.col("saved.itemRootSelector")).when(F.col("method") == "cards", F.col("selector")).alias("selector"),
        F.when(F.col("method") == "json_ld", F.when(F.col("ld_entries") >= 2, 0.91).otherwise(0.7))
        .when(F.col("method") == "rule", 0.88)
        .when(F.col("method") == "cards", card_confidence)
        .otherwise(0.2)
        .alias("confidence"),
        (F.col("method") == "fallback").alias("fallback"),
        (ruled & replace & (F.col("method") == "cards")).alias("rule_replaced"),
    )
    tagged = [("json_ld", from_ld), ("cards", from_cards), ("rule", from_rule), ("fallback", fallback)]
    union = None
    for name, rows in tagged:
        part = rows.withColumn("method", F.lit(name))
        union = part if union is None else union.unionByName(part)
    entries = union.join(result.select("page_id", "method"), ["page_id", "method"], "left_semi")
    return entries, result


def rule_is_narrow(rule: Column, current: Column, detected: Column, detected_confidence: Column) -> Column:
    """A simple automatic rule that finds far less than the page now shows should be replaced."""
    simple = ~F.coalesce(rule["rendererRequired"], F.lit(False))
    for name in ("titleSelector", "timeSelector", "authorSelector", "imageSelector", "summarySelector"):
        simple = simple & (F.coalesce(rule[name], F.lit("")) == "")
    enough = (detected >= 2) & (detected_confidence >= 0.7) & (detected >= F.greatest(current + 10, current * 2))
    return F.coalesce(simple & enough, F.lit(False))


def needs_review(result: DataFrame) -> DataFrame:
    """Probe verdict per page: whether a person must look, and the status a new source starts with."""
    return result.select(
        "page_id",
        "confidence",
        (F.col("fallback") | (F.col("confidence") < REVIEW_BELOW)).alias("requires_review"),
        F.when(F.col("confidence") < 0.5, "needs_review").otherwise("active").alias("initial_status"),
    )


def enrich_dates(entries: DataFrame, article_dates: DataFrame) -> DataFrame:
    """Fill missing publication days from the address, else from the linked article.

    ``entries`` needs ``source_id, seq, url, published_at``; ``article_dates``
    holds ``url, article_day`` of the articles that were read; how many those are
    is for the fetch plan to say. A known date stays.
    """
    dated = staged(entries, url_day=text.published_day(urls.url_date_text(F.col("url"))))
    open_rows = dated.where(F.col("published_at").isNull() & F.col("url_day").isNull())
    one_date = article_dates.groupBy("url").agg(F.max("article_day").alias("article_day"))
    found = open_rows.select("source_id", "seq", "url").join(one_date, "url").select("source_id", "seq", "article_day")
    filled = dated.join(found, ["source_id", "seq"], "left")
    return filled.withColumn("published_at", F.coalesce("published_at", "url_day", "article_day")).select(*entries.columns)


def first_occurrences(rows: DataFrame, key: str, order: str) -> DataFrame:
    return first_by_key(rows, [key], order)
