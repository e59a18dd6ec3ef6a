"""OPML subscription files: outlines with a feed address and the folders above them."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow.functions import text, urls
from contentflow.functions.binding import staged

OUTLINES = "seq bigint, pos int, xml_url string, title string, folders array<string>, problem string"


def _outlines(body: str) -> list[tuple]:
    """``(xml_url, title, folders)`` of every outline in document order, folders still raw."""
    root = ElementTree.fromstring(body.strip())
    if root.tag.lower() != "opml" and root.find(".//opml") is None:
        raise ValueError("no opml element")
    found, todo = [], [(root, [])]
    while todo:
        node, above = todo.pop()
        label = node.get("title") or node.get("text")
        if node.tag == "outline":
            address = node.get("xmlUrl") or node.get("xmlurl")
            if address and address.strip():
                found.append((address.strip(), label, above))
            above = above + [label]
        todo.extend((child, above) for child in reversed(node))
    return found


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["seq", "pos", "xml_url", "title", "folders", "problem"]
    for batch in batches:
        rows = []
        for seq, body in zip(batch["seq"], batch["text"]):
            try:
                found = _outlines(body)
                rows += [(seq, pos, *outline, None) for pos, outline in enumerate(found)]
                if not found:
                    rows.append((seq, 0, None, None, None, "no subscription"))
            except (ElementTree.ParseError, ValueError) as error:
                rows.append((seq, 0, None, None, None, str(error)))
        yield pd.DataFrame(rows, columns=names)


def parse_opml(raw: DataFrame) -> DataFrame:
    """Subscriptions per file in document order; an unusable file is one row with a ``problem``."""
    parsed = raw.select("seq", "text").mapInPandas(_parse, OUTLINES)
    labels = F.filter(F.transform("folders", text.collapse), lambda label: label != "")
    path = F.array_join(labels, " / ")
    return parsed.select(
        "seq",
        "pos",
        F.col("xml_url").alias("url"),
        text.blank_to_null(text.collapse(F.col("title"))).alias("title"),
        text.blank_to_null(path).alias("category"),
        "problem",
    )


def judge_outlines(outlines: DataFrame, sources: DataFrame) -> DataFrame:
    """Outcome of every outline: ``imported``, ``existing`` or ``skipped``.

    The identity of a feed is its canonical address. The first outline of a
    new identity is imported, later ones count as existing, addresses outside
    the public range (loopback feeds excepted) are skipped.
    """
    usable = urls.is_feed_url_allowed(F.col("url"), allow_loopback=True) & ~F.coalesce(F.length("title") > 120, F.lit(False))
    rooted = F.when(F.col("url").rlike(r"(?i)^https?:"), F.col("url")).otherwise(F.concat(F.lit("https://"), F.col("url")))
    keyed = staged(
        outlines.where(F.col("problem").isNull()),
        usable=usable,
        identity=urls.canonical_url(rooted),
        order=F.struct("seq", "pos"),
    )
    known = staged(sources.select("url"), identity=urls.canonical_url(F.col("url"))).select("identity").distinct().withColumn("known", F.lit(True))
    first = keyed.where("usable").groupBy("identity").agg(F.min("order").alias("first"))
    joined = keyed.join(first, "identity", "left").join(known, "identity", "left")
    outcome = (
        F.when(~F.col("usable"), "skipped")
        .when(F.col("known") | (F.col("order") != F.col("first")), "existing")
        .otherwise("imported")
    )
    return joined.select("seq", "pos", "url", "title", "category", "identity", outcome.alias("outcome"))


def import_opml(outlines: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New sources to register, and the counts of imported, existing and skipped outlines."""
    judged = judge_outlines(outlines, sources)
    fresh = judged.where(F.col("outcome") == "imported").select(
        "url",
        F.coalesce("title", urls.url_host(F.col("identity"))).alias("title"),
        "category",
        urls.is_loopback(F.col("url")).alias("loopback"),
    )
    counts = judged.agg(*[F.count_if(F.col("outcome") == name).alias(name) for name in ("imported", "existing", "skipped")])
    return fresh, counts
