"""Clean-up of chosen article bodies as a plan over their nodes.

A body becomes one row per element and piece of text, numbered in document
order; ``end`` is the number of the last node inside. One node lies in another
when its number is not beyond the other's ``end``, so "inside anything that goes"
is a running maximum, and pictures, links and figures are windows over the nodes
nearest to them. What is left is written as tokens: one where a node starts, one
where it ends, sorted and joined per body.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from contentflow.functions import text, urls
from contentflow.functions.binding import let, staged
from contentflow.sources.elements import VOID, attr, has, known, read
from contentflow.sources.page_facts import is_noise

# --- fixed values -----------------------------------------------------------
ALLOWED_TAGS = [
    "a", "abbr", "b", "blockquote", "br", "caption", "cite", "code", "dd", "del", "details", "div", "dl", "dt", "em", "figcaption", "figure",
    "h1", "h2", "h3", "h4", "h5", "h6", "hr", "img", "kbd", "li", "mark", "ol", "p", "picture", "pre", "s", "small", "span", "strong", "sub",
    "summary", "sup", "table", "tbody", "td", "th", "thead", "tr", "ul",
]
CHROME_CLASSES = [
    "post-header", "entry-header", "article-header", "post-title", "entry-title", "breadcrumb", "breadcrumbs", "post-footer", "entry-footer", "article-footer",
]
CHROME_CLASS_PARTS = ["breadcrumb", "post-meta", "entry-meta", "article-meta", "post-footer", "entry-footer", "article-footer"]
BYLINE = r"(?i)^by\s+.+\|\s*\d{4}-\d{2}-\d{2}\s*\|"
COMMENT_IDS = ["comments", "PostComment", "MobileComments"]
COMMENT_CLASSES = ["AllComments", "ComListLi", "block-comment"]
COMMENT_ID_STARTS = ["comment-", "respond-post-"]
SCIENTIFIC_EXTRA_IDS = ["content_tips", "pay", "how_to_cite"]
LEAD_LENGTH, LEAD_MINIMUM = 28, 12
LEAD_TAGS = ["p", "div", "section", "article"]
# Where an image's address may stand, the most trusted place first; "picture" is what the sources of its picture state.
IMAGE_ADDRESSES = [
    "data-actualsrc", "data-original", "data-original-src", "data-srcset", "data-lazy-srcset", "picture", "srcset", "data-src", "data-lazy-src", "src",
]
SEVERAL_SIZES = ["data-srcset", "data-lazy-srcset", "picture", "srcset"]
SIZE_SUFFIX = r"(?i)-\d{1,5}x\d{1,5}(?=\.[a-z0-9]{2,5}(?:$|\?))"
TEX_LINK = r"\\href\{(https?://[^}\s]+)\}\{([^}]*)\}|\\url\{(https?://[^}\s]+)\}"
LITERAL_TAGS = ["code", "pre", "kbd"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
TITLE_TAGS = ["h1", "h2", "h3"]
# ---------------------------------------------------------------------------

NODE = StructType(
    [StructField(name, IntegerType()) for name in ("n", "end", "parent")]
    + [StructField("tag", StringType()), StructField("attrs", MapType(StringType(), StringType())), StructField("cls", StringType()), StructField("text", StringType())]
)


def _nodes(html: str | None) -> list[dict]:
    """Elements and pieces of text in document order; a noscript also carries its own text, which may be markup."""
    page = read(html)
    number = [e.pos + e.first for e in page.elements]
    rows = [
        {"n": number[e.pos], "end": e.last + e.stop, "parent": number[e.above[0]] if e.above else -1, "tag": e.tag, "attrs": e.attrs, "cls": e.get("class"),
         "text": page.text(e) if e.tag == "noscript" else None}
        for e in page.elements
    ]
    taken, n = set(number), 0
    for holder, piece in page.pieces:
        while n in taken:
            n += 1
        rows.append({"n": n, "end": n, "parent": number[holder] if holder >= 0 else -1, "tag": None, "attrs": None, "cls": None, "text": piece})
        n += 1
    return sorted(rows, key=lambda row: row["n"])


@F.pandas_udf(ArrayType(NODE))
def body_nodes(html: pd.Series) -> pd.Series:
    return pd.Series([_nodes(body) if isinstance(body, str) else [] for body in html], dtype="object")


# --- addresses and texts ---


def _safe(value: Column, page_url: Column) -> Column:
    """Absolute public http(s) address, or null."""
    return let(urls.absolute_url(value, page_url), lambda link: F.when(link.rlike(r"(?i)^https?://") & urls.is_public_url(link), link))


def asset(url: Column) -> Column:
    """Address without fragment and generated size, the part two copies of one picture share."""
    return F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), SIZE_SUFFIX, "")


def _offers(stated) -> Column:
    """Every address an image may have, in order of trust; ``stated(place)`` is what stands there."""
    return F.array(*[text.largest_srcset(stated(place)) if place in SEVERAL_SIZES else stated(place) for place in IMAGE_ADDRESSES])


def _first_known(links: Column) -> Column:
    return F.get(F.filter(links, lambda link: link.isNotNull()), F.lit(0))


def _in_markup(markup: Column, name: str) -> Column:
    """An attribute of the first image of markup that arrived as text."""
    tag = F.replace(F.regexp_extract(markup, r"(?is)<img\b[^>]*>", 0), F.lit("&amp;"), F.lit("&"))
    stated = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return known(F.concat(*[F.regexp_extract(tag, stated, group) for group in (1, 2, 3)]))


def _escaped(value: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(char), F.lit(name))
    return value


def _quoted(value: Column) -> Column:
    return F.replace(F.replace(_escaped(value), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def _tex_targets(piece: Column) -> Column:
    named = F.regexp_extract_all(piece, F.lit(TEX_LINK), F.lit(1))
    bare = F.regexp_extract_all(piece, F.lit(TEX_LINK), F.lit(3))
    return F.zip_with(named, bare, lambda a, b: F.concat(a, b))


def _has_tex_link(piece: Column) -> Column:
    return piece.contains("\\href{") | piece.contains("\\url{")


def _with_links(piece: Column, links: Column) -> Column:
    r"""Escaped text, ``\url{…}`` and ``\href{…}{…}`` as links to the usable ones among their addresses."""

    def link(i: Column) -> Column:
        href, label = F.get(links, i), known(F.get(F.regexp_extract_all(piece, F.lit(TEX_LINK), F.lit(2)), i))
        anchor = F.concat(F.lit('<a href="'), _quoted(href), F.lit('">'), _escaped(F.coalesce(label, href)), F.lit("</a>"))
        return F.coalesce(anchor, _escaped(F.get(F.regexp_extract_all(piece, F.lit(TEX_LINK), F.lit(0)), i)), F.lit(""))

    joined = F.array_join(F.transform(F.split(piece, TEX_LINK, -1), lambda part, i: F.concat(_escaped(part), link(i))), "")
    return F.when(_has_tex_link(piece), joined).otherwise(_escaped(piece))


# --- rules on one node ---


def _classes(e: Column) -> Column:
    return F.split(e["cls"], r"\s+")


def _any_class(e: Column, names: list[str]) -> Column:
    return (e["cls"] != "") & F.arrays_overlap(_classes(e), F.array(*[F.lit(n) for n in names]))


def _noise_or_chrome(e: Column, scientific: Column) -> Column:
    chrome = (e["tag"] == "header") | _any_class(e, CHROME_CLASSES) | e["cls"].rlike("|".join(CHROME_CLASS_PARTS))
    named = attr(e, "id").isin(COMMENT_IDS + SCIENTIFIC_EXTRA_IDS) | attr(e, "id").rlike("^(?:" + "|".join(map(re.escape, COMMENT_ID_STARTS)) + ")")
    return e["tag"].isNotNull() & (is_noise(e) | chrome | (scientific & (named | _any_class(e, COMMENT_CLASSES))))


def _heading_link(e: Column) -> Column:
    return (e["tag"] == "a") & (_any_class(e, ["headerlink"]) | attr(e, "href").startswith("#"))


def _inside(e: Column, outer: Column) -> Column:
    return (e["n"] > outer["n"]) & (e["n"] <= outer["end"])


def _visible(block: Column) -> Column:
    """Text of a block without what the rules on single nodes take from it; reads ``_nodes`` and ``_cuts``."""

    def joined(cuts: Column) -> Column:
        kept = F.filter(F.slice("_nodes", block["n"] + 1, block["end"] - block["n"] + 1), lambda p: p["tag"].isNull() & ~F.exists(cuts, lambda c: _inside(p, c)))
        return text.collapse(F.array_join(F.transform(kept, lambda p: p["text"]), ""))

    return let(F.filter("_cuts", lambda c: _inside(c, block)), joined)


def _intervals(nodes: Column | str) -> Column:
    return F.transform(nodes, lambda e: F.struct(e["n"].alias("n"), e["end"].alias("end")))


# --- windows over the nodes of a body ---

def _up_to():
    return Window.partitionBy("_key").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before():
    return Window.partitionBy("_key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)


def _within(test: Column, frame) -> Column:
    """Whether a node of the frame that passes the test holds this one."""
    return F.coalesce(F.max(F.when(test, F.col("end"))).over(frame) >= F.col("n"), F.lit(False))


def _nearest(test: Column, frame) -> Column:
    """Number of the last node of the frame that passes the test, when it holds this one."""
    held = F.last(F.when(test, F.struct("n", "end")), ignorenulls=True).over(frame)
    return F.when(held["end"] >= F.col("n"), held["n"])


def _node_rows(rows: DataFrame, html: str, url: str, title: str, summary: str, scientific: str) -> DataFrame:
    """One row per node, with the numbers of repeated titles and bylines (``_told``) and of the lead (``_since``).

    Equal rows are folded and counted first, so a body that a third of all rows
    repeat is cleaned once. The row itself travels with the first node only.
    """
    given = rows.select(F.sha2(F.to_json(F.struct("*")), 256).alias("_key"), F.struct("*").alias("_row"))
    folded = given.groupBy("_key").agg(F.first("_row").alias("_row"), F.count(F.lit(1)).alias("_copies"))
    parsed = folded.select(
        "_key", F.struct("_copies", "_row").alias("_row"), F.col("_row")[url].alias("_url"), F.coalesce(F.col("_row")[title], F.lit("")).alias("_title"),
        F.substring(text.collapse(F.col("_row")[summary]), 1, LEAD_LENGTH).alias("_lead"), F.coalesce(F.col("_row")[scientific], F.lit(False)).alias("_scientific"),
        body_nodes(F.col("_row")[html]).alias("_nodes"),
    )
    headed = parsed.withColumn("_headings", F.filter("_nodes", lambda e: e["tag"].isin(HEADINGS)))
    beside_heading = lambda e: _heading_link(e) & F.exists("_headings", lambda h: _inside(e, h))
    cut = headed.withColumn("_cuts", F.filter("_nodes", lambda e: F.coalesce(_noise_or_chrome(e, F.col("_scientific")) | beside_heading(e), F.lit(False))))
    reads_lead = F.col("_scientific") & (F.length("_lead") >= LEAD_MINIMUM)
    blocks = F.filter("_nodes", lambda e: e["tag"].isin([*TITLE_TAGS, "p"]) | (reads_lead & e["tag"].isin(LEAD_TAGS)))
    told = staged(cut, _blocks=F.transform(blocks, lambda e: F.struct(e["n"].alias("n"), e["end"].alias("end"), e["tag"].alias("tag"), _visible(e).alias("text"))))
    titled = lambda e: e["tag"].isin(TITLE_TAGS) & (F.col("_title") != "") & (e["text"] == F.col("_title"))
    going = staged(told, _going=F.concat(_intervals("_cuts"), _intervals(F.filter("_blocks", lambda e: titled(e) | ((e["tag"] == "p") & e["text"].rlike(BYLINE))))))
    held = lambda e: F.exists("_going", lambda c: (e["n"] >= c["n"]) & (e["n"] <= c["end"]))
    holders = F.filter("_blocks", lambda e: e["tag"].isin(LEAD_TAGS) & e["text"].contains(F.col("_lead")) & ~held(e))
    least = F.array_min(F.transform(holders, lambda e: F.struct(F.length(e["text"]).alias("length"), e["n"].alias("n"))))
    led = going.withColumn("_since", F.when(reads_lead, least["n"]))
    carried = F.transform("_nodes", lambda e: F.struct(e.alias("node"), F.when(e["n"] == 0, F.col("_row")).alias("row"), F.array_contains(F.col("_goes"), e["n"]).alias("cut")))
    empty = F.array(F.struct(F.lit(None).cast(NODE).alias("node"), F.col("_row").alias("row"), F.lit(False).alias("cut")))
    dealt = led.withColumn("_goes", F.transform("_going", lambda c: c["n"])).select("_key", "_url", "_since", F.explode(F.when(F.size("_nodes") > 0, carried).otherwise(empty)).alias("_of"))
    node = F.col("_of.node")
    return dealt.select(
        "_key", "_url", "_since", F.col("_of.row").alias("_row"), node.alias("node"), node["n"].alias("n"), node["end"].alias("end"), node["parent"].alias("parent"), node["tag"].alias("tag"),
        F.col("_of.cut").alias("cut"),
    )


def _with_pictures(nodes: DataFrame) -> DataFrame:
    """``address``, ``alt`` and ``stands_in`` (a noscript that becomes an image) of every node.

    A picture offers its first stated source to its first image. A noscript's image
    completes an image beside it, the same picture or the one right before it; with
    neither it takes the noscript's place.
    """
    node, url = F.col("node"), F.col("_url")
    placed = nodes.select(
        "*",
        _within(F.col("tag") == "noscript", _before()).alias("spoken"),
        _nearest(F.col("tag") == "noscript", _up_to()).alias("block"),
        _nearest(F.col("tag") == "picture", _before()).alias("picture"),
    )
    of_picture = Window.partitionBy("_key", "picture").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    source = F.when(F.col("tag") == "source", F.coalesce(known(attr(node, "data-srcset")), known(attr(node, "srcset"))))
    offered = placed.select("*", F.first(source, ignorenulls=True).over(of_picture).alias("_source"), F.min(F.when(F.col("tag") == "img", F.col("n"))).over(of_picture).alias("_first"))
    stated = lambda place: F.when(F.col("picture").isNotNull() & (F.col("n") == F.col("_first")), F.col("_source")) if place == "picture" else known(attr(node, place))
    said, image = F.col("tag") == "noscript", F.col("tag") == "img"
    from_text = lambda place: F.lit(None).cast("string") if place == "picture" else _in_markup(node["text"], place)
    markup = said & node["text"].rlike(r"(?i)<img\b")
    raw = (
        F.when(image, _offers(stated)).when(markup, _offers(from_text)).when(F.col("tag") == "a", F.array(known(attr(node, "href"))))
        .when(F.col("tag").isNull() & _has_tex_link(node["text"]), _tex_targets(node["text"]))
    )
    # Every address of a body is resolved and judged here.
    linked = staged(offered, links=F.transform(raw, lambda link: _safe(link, url)))
    alt = F.when(image, known(text.collapse(attr(node, "alt")))).when(markup, known(text.collapse(_in_markup(node["text"], "alt"))))
    own = linked.withColumn("address", F.when(image | markup, _first_known(F.col("links")))).withColumn("alt", alt)
    held = own.withColumn("_held", F.min(F.when(F.col("spoken") & image, F.struct("n", "address", "alt"))).over(Window.partitionBy("_key", "block")))
    has_image = said & F.col("_held").isNotNull()
    found = held.select(
        *[c for c in held.columns if c not in ("address", "alt")],
        F.when(has_image, F.col("_held.address")).otherwise(F.col("address")).alias("address"),
        F.when(has_image, F.col("_held.alt")).otherwise(F.col("alt")).alias("alt"),
    )
    keyed = found.withColumn("asset", asset(F.col("address")))
    # Siblings: pieces of text do not part an image from its noscript.
    beside = Window.partitionBy("_key", "parent", F.isnull("tag")).orderBy("n")
    alike = Window.partitionBy("_key", "parent", "asset")
    seen = image & ~F.col("spoken")
    near = keyed.select(
        "*",
        F.min(F.when(seen & F.col("asset").isNotNull(), F.col("n"))).over(alike).alias("_twin"),
        F.min(F.when(said & F.col("asset").isNotNull(), F.struct("n", "alt"))).over(alike).alias("_other"),
        F.lag(seen).over(beside).alias("_after_image"),
        F.lead(F.when(said, F.struct("address", "asset"))).over(beside).alias("_next"),
    )
    lent = F.when(seen & F.col("address").isNull(), F.col("_next.address"))
    return near.select(
        *[c for c in nodes.columns if c != "cut"],
        "cut", "spoken", "links",
        F.coalesce("address", lent).alias("address"),
        F.coalesce("alt", F.when(seen & (F.col("n") == F.col("_twin")), F.col("_other.alt"))).alias("alt"),
        F.coalesce(said & ~F.col("spoken") & F.col("address").isNotNull() & F.col("_twin").isNull() & ~F.coalesce("_after_image", F.lit(False)), F.lit(False)).alias("stands_in"),
    ).withColumn("asset", asset(F.col("address")))


def _left(nodes: DataFrame) -> DataFrame:
    """Nodes that stay; of one picture's repeats within a figure, or directly in one outermost element, the first."""
    node = F.col("node")
    pictured = (F.col("tag") == "img") | F.col("stands_in")
    going = F.col("cut") & ~F.col("stands_in")
    lead_end = F.max(F.when(F.col("n") == F.col("_since"), F.col("n"))).over(Window.partitionBy("_key"))
    judged = nodes.select("*", (_within(going, _up_to()) | F.col("spoken") | (F.col("end") < F.coalesce(lead_end, F.lit(0)))).alias("gone"))
    framing = F.col("tag").isin("figure", "picture")
    outermost = judged.withColumn("_frame", framing & ~_within(framing, _before()))
    root = F.col("parent") == -1
    framed = outermost.select(
        "*",
        _nearest(F.col("_frame"), _up_to()).alias("frame"),
        F.last(F.when(root & F.col("tag").isNotNull(), F.col("n")), ignorenulls=True).over(_up_to()).alias("_root"),
        _nearest((F.col("tag") == "a") & ~F.col("gone"), _up_to()).alias("link"),
        # Repeats and emptied links, which go later, hold no text, so what is literal or linked is known here.
        _within(~F.col("gone") & F.col("tag").isin(LITERAL_TAGS), _before()).alias("_literal"),
        _within(~F.col("gone") & (F.col("tag") == "a"), _before()).alias("_linked"),
    )
    grouped = framed.withColumn("frame", F.coalesce("frame", F.when(F.col("parent") == F.col("_root"), F.col("_root"))))
    candidate = pictured & ~F.col("gone")
    group = Window.partitionBy("_key", "frame", "asset", candidate).orderBy("n")
    repeats = grouped.withColumn("repeat", candidate & F.col("frame").isNotNull() & F.col("asset").isNotNull() & (F.row_number().over(group) > 1))
    of_link = Window.partitionBy("_key", "link")
    speaks = ~F.col("gone") & ((F.col("tag").isNull() & (text.collapse(node["text"]) != "")) | (pictured & ~F.col("repeat")))
    emptied = F.max("repeat").over(of_link) & ~F.max(speaks).over(of_link) & F.col("link").isNotNull()
    kept = repeats.withColumn("_emptied", emptied)
    return kept.withColumn("gone", F.col("gone") | F.col("repeat") | F.coalesce("_emptied", F.lit(False)))


def _written(nodes: DataFrame) -> DataFrame:
    """``start`` and ``stop``: what stands where a node begins and behind its last node."""
    node, tag = F.col("node"), F.col("tag")
    shown = ~F.col("gone")
    quiet = nodes.withColumn("_href", F.when(shown & (tag == "a"), F.get("links", F.lit(0))))
    image = F.concat(
        F.lit('<img src="'), _quoted(F.col("address")), F.lit('"'), F.coalesce(F.concat(F.lit(' alt="'), _quoted(F.col("alt")), F.lit('"')), F.lit("")), F.lit(">")
    )
    box = F.concat(F.lit("<span>"), F.when(has(node, "checked"), "☑").otherwise("☐"), F.lit(" </span>"))
    plain = tag.isin([t for t in ALLOWED_TAGS if t not in VOID and t != "a"])
    start = (
        F.when(tag.isNull(), F.when(F.col("_literal") | F.col("_linked"), _escaped(node["text"])).otherwise(_with_links(node["text"], F.col("links"))))
        .when((tag == "img") | F.col("stands_in"), image)
        .when((tag == "input") & (F.lower(attr(node, "type")) == "checkbox"), box)
        .when(tag.isin([t for t in ALLOWED_TAGS if t in VOID]), F.concat(F.lit("<"), tag, F.lit(">")))
        .when(plain, F.concat(F.lit("<"), tag, F.when(tag == "details", " open").otherwise(""), F.lit(">")))
    )
    opened = staged(quiet, start=F.when(shown, start))
    # A link without any content shows its address.
    bare = ~F.coalesce(F.max(F.length("start") > 0).over(Window.partitionBy("_key", "link")), F.lit(False))
    anchor = F.concat(F.lit('<a href="'), _quoted(F.col("_href")), F.lit('">'), F.when(F.col("_bare"), _escaped(F.col("_href"))).otherwise(""))
    return opened.withColumn("_bare", bare).select(
        "_key", "_row", "n", "end",
        F.coalesce("start", anchor).alias("start"),
        F.when(shown & plain, F.concat(F.lit("</"), tag, F.lit(">"))).when(F.col("_href").isNotNull(), "</a>").alias("stop"),
    )


def with_clean_body(rows: DataFrame, html: str, url: str, title: str, summary: str, scientific: str, out: str = "clean") -> DataFrame:
    """The rows with ``out``: the safe subset of the body in column ``html``.

    Noise, page chrome, links beside headings, repeated titles and bylines are gone,
    on scientific pages discussions and all before the lead too; attributes are
    dropped, addresses absolute and public, each image has the best address that
    anything states for it. A null body gives an empty text; repeated rows stay
    repeated. Bodies meet their windows after one exchange.
    """
    tokens = F.concat(
        F.when(F.col("start").isNotNull(), F.array(F.struct(F.col("n").alias("at"), F.lit(0).alias("behind"), F.lit(0).alias("inner"), F.col("start").alias("text")))).otherwise(F.array()),
        F.when(F.col("stop").isNotNull(), F.array(F.struct(F.col("end").alias("at"), F.lit(1).alias("behind"), (-F.col("n")).alias("inner"), F.col("stop").alias("text")))).otherwise(F.array()),
    )
    written = _written(_left(_with_pictures(_node_rows(rows, html, url, title, summary, scientific))))
    bodies = written.groupBy("_key").agg(F.first("_row", ignorenulls=True).alias("_row"), F.array_sort(F.flatten(F.collect_list(tokens))).alias("_tokens"))
    body = F.array_join(F.transform("_tokens", lambda t: t["text"]), "")
    finished = bodies.select("_row", F.regexp_replace(body, r"^\s+|\s+$", "").alias("_body"))
    repeated = finished.select("_row", "_body", F.explode(F.sequence(F.lit(1), F.col("_row._copies"))).alias("_copy"))
    return repeated.select("_row._row.*", F.col("_body").alias(out))
