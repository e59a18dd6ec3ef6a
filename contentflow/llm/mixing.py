"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed into cells of (source, language, topic). Raking gives every
cell a weight ``a[source] * b[language] * c[topic]`` under which the three
marginals meet their targets. A document's probability is its cell's weight
times a factor that makes the expected tokens a chosen share of all, at most
one, and a hash of its id decides.

The sources may be many: they stay distributed, one row per source with its
cells, and every round is one aggregation to the (language, topic) totals. Only
those totals, whose number depends on the categories and not on the documents,
come to the driver. A source with a third of all documents is one row like the
others. All work on rows is DataFrame functions.

Defined results: a null source, language or topic is a category of its own; a
null or blank text has no tokens and keeps the probability of its cell (0 if no
document of the cell has a token); repeated rows of one id share its fate; a
row without an id is decided by its text; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.llm.tables import looked_up, words, written

#: Topics by what a text holds: the first pattern found names it, ``prose`` otherwise.
TOPICS: tuple[tuple[str, str], ...] = (
    ("notice", "(?i)licen[sc]e|copyright"),
    ("table", r" \| "),
    ("symbols", r"[#*$%&]{2}"),
    ("figures", "[0-9]{4}"),
)
#: A marginal's target share is its own share to this power, renormed: 1 keeps the mix, 0 evens it out.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.9}
#: Expected share of all tokens that is kept.
KEEP = 0.5
ROUNDS, TOLERANCE = 50, 1e-6
NONE = "\x00none"


def topic(text: Column) -> Column:
    found = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        found = F.when(F.coalesce(text, F.lit("")).rlike(pattern), name).otherwise(found)
    return found


def measured(docs: DataFrame) -> DataFrame:
    """The documents' columns with ``_source``, ``_lang``, ``_topic`` (never null) and ``_tokens``."""
    return docs.withColumns({
        "_source": F.coalesce(F.col("source"), F.lit(NONE)),
        "_lang": F.coalesce(F.col("lang"), F.lit(NONE)),
        "_topic": topic(F.col("text")),
        "_tokens": F.size(words(F.col("text"))).cast("bigint"),
    })


@dataclass
class Mix:
    """Fitted factors: sources as a table (_source, _factor), languages and topics as dictionaries, and the common scale."""

    sources: DataFrame
    n_sources: int
    langs: dict[str, float]
    topics: dict[str, float]
    scale: float
    error: float

    def weight(self, rows: DataFrame) -> DataFrame:
        """Add ``_weight`` and ``_p`` to measured rows."""
        rows = looked_up(rows, self.sources, "_source", self.n_sources)
        weight = F.coalesce(F.col("_factor"), F.lit(0.0)) * _chosen(F.col("_lang"), self.langs) * _chosen(F.col("_topic"), self.topics)
        return rows.withColumn("_weight", weight).withColumn("_p", F.least(F.lit(1.0), F.col("_weight") * F.lit(self.scale))).drop("_factor")


def _chosen(key: Column, values: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def _shares(totals: dict, power: float, given: dict | None) -> dict:
    """Target shares over the categories that have tokens: the given ones, or tempered ones."""
    raised = {k: (given.get(k if k != NONE else None, 0.0) if given else v**power) if v else 0.0 for k, v in totals.items()}
    whole = sum(raised.values()) or 1.0
    return {k: v / whole for k, v in raised.items()}


def fit(rows: DataFrame, temper: dict[str, float] = TEMPER, keep: float = KEEP, targets: dict[str, dict] | None = None) -> Mix:
    """Rake the cells of measured rows. ``targets`` may give shares for "lang" and "topic" by value, and a table (source, share) for "source"."""
    targets = targets or {}
    cells = rows.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("n"))
    cells = written(cells.where("n > 0"), "cells")
    pairs = {(r["_lang"], r["_topic"]): float(r["n"]) for r in cells.groupBy("_lang", "_topic").agg(F.sum("n").alias("n")).collect()}
    whole = sum(pairs.values())
    by_lang, by_topic = {}, {}
    for (lang, name), n in pairs.items():
        by_lang[lang] = by_lang.get(lang, 0.0) + n
        by_topic[name] = by_topic.get(name, 0.0) + n
    langs, topics = sorted(by_lang), sorted(by_topic)
    want_lang, want_topic = _shares(by_lang, temper["lang"], targets.get("lang")), _shares(by_topic, temper["topic"], targets.get("topic"))

    each = cells.groupBy("_source").agg(F.sum("n").alias("n"), F.collect_list(F.struct("_lang", "_topic", "n")).alias("cells"))
    if targets.get("source") is not None:
        given = targets["source"].select(F.coalesce("source", F.lit(NONE)).alias("_source"), F.col("share").cast("double").alias("raised"))
        each = each.join(given, "_source", "left").withColumn("raised", F.coalesce("raised", F.lit(0.0)))
    else:
        each = each.withColumn("raised", F.pow("n", F.lit(temper["source"])))
    each = written(each, "sources")
    total = each.agg(F.sum("raised").alias("raised"), F.count("*").alias("n")).first()
    raised, n_sources = float(total["raised"] or 1.0), int(total["n"])

    b, c, error = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0), 0.0

    def with_factor() -> DataFrame:
        mass = F.aggregate(F.transform("cells", lambda x: x["n"] * _chosen(x["_lang"], b) * _chosen(x["_topic"], c)), F.lit(0.0), lambda s, x: s + x)
        factor = F.when(mass > 0, F.lit(whole) * F.col("raised") / F.lit(raised) / mass).otherwise(0.0)
        return each.select("_source", "cells", factor.alias("_factor"))

    for _ in range(ROUNDS if whole else 0):
        held = with_factor().select("_factor", F.inline("cells")).groupBy("_lang", "_topic").agg(F.sum(F.col("_factor") * F.col("n")).alias("m"))
        m = {(r["_lang"], r["_topic"]): float(r["m"]) for r in held.collect()}

        def mass(lang=None, name=None):
            return sum(v * b[x] * c[y] for (x, y), v in m.items() if lang in (None, x) and name in (None, y))  # noqa: B023

        error = max([abs(mass(lang=x) / whole - want_lang[x]) for x in langs] + [abs(mass(name=y) / whole - want_topic[y]) for y in topics])
        if error < TOLERANCE:
            break
        b = {x: b[x] * whole * want_lang[x] / (mass(lang=x) or 1.0) for x in langs}
        c = {y: c[y] * whole * want_topic[y] / (mass(name=y) or 1.0) for y in topics}

    sources = with_factor()
    flat = sources.select("_factor", F.inline("cells")).withColumn("w", F.col("_factor") * _chosen(F.col("_lang"), b) * _chosen(F.col("_topic"), c))
    scale = _scale(flat, whole, keep)
    return Mix(written(sources.select("_source", "_factor"), "factors"), n_sources, b, c, scale, error)


def _scale(cells: DataFrame, whole: float, keep: float) -> float:
    """The factor at which the expected kept tokens are the wanted share, each probability being one at most."""
    low, high = 1e-9, 1e9
    for _ in range(6 if whole else 0):
        steps = [low * (high / low) ** (i / 63) for i in range(64)]
        kept = cells.agg(*[F.sum(F.col("n") * F.least(F.lit(1.0), F.col("w") * F.lit(s))).alias(f"k{i}") for i, s in enumerate(steps)]).first()
        above = next((i for i in range(64) if (kept[i] or 0.0) >= keep * whole * (1 - 1e-12)), 63)
        low, high = steps[max(0, above - 1)], steps[above]
    return high


def draw(seed: int = 7) -> Column:
    """A number in [0, 1) fixed by the id, or by the text of a row without one."""
    by_id = F.xxhash64(F.lit(seed), F.col("doc_id"))
    by_text = F.xxhash64(F.lit(seed), F.coalesce(F.col("text"), F.lit("")))
    bits = F.shiftrightunsigned(F.coalesce(F.when(F.col("doc_id").isNotNull(), by_id), by_text), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def probabilities(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, sampled) for every document."""
    rows = written(measured(docs.select("doc_id", "source", "lang", "text")).withColumn("_draw", draw()).drop("text"), "tokens")
    mix = fit(rows, **options)
    return mix.weight(rows).select(
        "doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.col("_weight").alias("weight"), F.col("_p").alias("probability"), (F.col("_draw") < F.col("_p")).alias("sampled"),
    )


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents with all their columns, and ``mix_weight`` and ``mix_probability`` (replacing any of these names)."""
    names = [c for c in docs.columns if c not in ("mix_weight", "mix_probability")]
    # The columns that came with a row wait in one of their own, where no name can clash.
    rows = measured(docs.select(F.struct(*names).alias("_row"), "doc_id", "source", "lang", "text"))
    rows = rows.withColumn("_draw", draw()).drop("doc_id", "source", "lang", "text")
    mix = fit(rows.select("_source", "_lang", "_topic", "_tokens"), **options)
    chosen = mix.weight(rows).where(F.col("_draw") < F.col("_p"))
    return chosen.select("_row.*", F.col("_weight").alias("mix_weight"), F.col("_p").alias("mix_probability"))
