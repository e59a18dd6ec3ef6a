"""Language of every text: script ranges narrow the candidates, Viterbi over words labels spans.

A word is a maximal run of letters and combining marks. Its score for a language
is the log probability of its pairs and triples of lower-cased characters, with
the word's borders, under that language's smoothed counts. Only languages whose
learned texts use the script of the word's first letter are candidates for it.
Viterbi over the words of a text, where a change of language costs a fixed
penalty, labels spans; the language with most letters is the text's. The
recursion runs only over stretches of words in which leaving the best single
label can pay, which sums over the words tell beforehand.

Counts are learned on a bounded, documented sample of labelled documents for
each language, as sums over (language, bin) in Spark; the model has languages
times BINS numbers, whatever the input. Predicting is one pass over the rows:
only the text goes to Python, so ids and other columns stay as they are.

Defined results: null texts and texts without a letter are ``und`` with score
0, as is every text when nothing was learned; very long texts are read whole,
in pieces; ties go to the first language by name; repeated rows are predicted
alike; null languages and documents without an id are not learned from; the
columns a text came with are kept, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentflow.llm.tables import BROADCAST_ROWS

#: Ranges of code points by script, first and last.
SCRIPTS: list[tuple[str, int, int]] = [
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x0370, 0x03FF),
    ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
]
NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]

BINS = 1 << 15
#: Documents of each language that are learned from, and languages a model may have.
SAMPLE_PER_LANGUAGE, MOST_LANGUAGES = 2000, 1000
#: What a change of language between two words costs, in nats.
SWITCH = 12.0
#: A language is a candidate for words of a script that holds so large a share of its learned words.
SCRIPT_SHARE = 0.005
#: Numbers gathered at once: characters times languages.
PIECE = 1 << 22
UNKNOWN = "und"
CLOSED = -1e6

_PLANES = 0x20000


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: 0 outside words, 1 for marks, 2 for letters; the lower-case form; the script."""
    kinds, lower = np.zeros(_PLANES, np.uint8), np.arange(_PLANES, dtype=np.int64)
    for c in range(_PLANES):
        char = chr(c)
        if char.isalpha():
            kinds[c] = 2
            if len(small := char.lower()) == 1:
                lower[c] = ord(small)
        elif unicodedata.category(char)[0] == "M":
            kinds[c] = 1
    script = np.zeros(_PLANES, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = NAMES.index(name)
    return kinds, lower, script


KINDS, LOWERED, SCRIPT = _tables()


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BINS x languages, log probabilities
    scripts: np.ndarray  # scripts x languages, 0 for candidates and CLOSED for others
    switch: float = SWITCH


@dataclass
class Words:
    """The words of some texts: places in their texts, letters, scripts, and the bins of their character groups."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    bins: np.ndarray  # 2 x groups
    first: np.ndarray  # first group of each word, and the end


def words_of(texts: list[str]) -> Words:
    """All words; characters beyond the tables count as no letters."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(codes < _PLANES, codes, 0)
    kind = KINDS[codes]
    inside = np.concatenate([[False], kind > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    letters = np.diff(np.concatenate([[0], np.cumsum(kind == 2)])[np.stack([start, end])], axis=0)[0]
    # Marks alone are no word.
    start, end, letters = start[letters > 0], end[letters > 0], letters[letters > 0]
    lengths = end - start
    text = np.searchsorted(begin, start, side="right") - 1
    # Each character of a word, and the place behind it, closes a pair and a triple; before a word there are zeros.
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    nth = np.arange(first[-1]) - np.repeat(first[:-1], lengths + 1)
    at = np.repeat(start, lengths + 1) + nth
    low = LOWERED[codes] + 1
    closing = nth == np.repeat(lengths, lengths + 1)
    one = np.where(closing, 0, low[np.minimum(at, len(low) - 1)])
    two = np.where(nth >= 1, low[np.maximum(at - 1, 0)], 0)
    three = np.where(nth >= 2, low[np.maximum(at - 2, 0)], 0)
    pair = one * 0x9E3779B1 + two * 0x85EBCA77
    bins = np.stack([_bin(pair), _bin(pair + three * 0xC2B2AE3D + 1)])
    return Words(text, start - begin[text], end - begin[text], letters, SCRIPT[codes[start]], bins, first)


def _bin(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(49)).astype(np.int64)


def word_scores(model: Model, words: Words) -> np.ndarray:
    """Words x languages."""
    out = np.zeros((len(words.text), len(model.languages)))
    groups = max(1 << 12, PIECE // len(model.languages))
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(words.first, words.first[at] + groups, side="right")) - 1)
        bins = words.bins[:, words.first[at] : words.first[to]]
        sums = model.weights[bins[0]] + model.weights[bins[1]]
        out[at:to] = np.add.reduceat(sums, words.first[at:to] - words.first[at], axis=0) / 2
        at = to
    closed = model.scripts[words.script]
    # A script that no language uses narrows nothing.
    return out + np.where((closed < 0).all(axis=1, keepdims=True), 0, closed)


def viterbi(scores: np.ndarray, switch: float, before: int | None = None, behind: int | None = None) -> np.ndarray:
    """The labels of the best sequence, between two given labels where there are such."""
    fee = np.arange(scores.shape[1])
    value = (scores[0] - switch * (fee != before) if before is not None else scores[0]).tolist()
    back: list[tuple[int, list[bool]]] = []
    for row in scores[1:].tolist():
        top = max(value)
        floor = top - switch
        back.append((value.index(top), [v >= floor for v in value]))
        value = [(v if v >= floor else floor) + s for v, s in zip(value, row, strict=True)]
    if behind is not None:
        value = [v - switch * (k != behind) for k, v in enumerate(value)]
    label = value.index(max(value))
    labels = [label]
    for source, stays in reversed(back):
        label = label if stays[label] else source
        labels.append(label)
    return np.array(labels[::-1])


def best_labels(scores: np.ndarray, switch: float) -> np.ndarray:
    """As ``viterbi`` over all words, but looking only where leaving the best single label can pay.

    ``gain`` bounds what another label is worth at a word. A stretch of other
    labels that pays has no part at an inner border with a gain below zero, so
    it lies where one of two walks over the gains, which start again whenever
    they fall to zero, is above zero, and it adds up to one change at the ends
    of the text and two within it.
    """
    best = int(scores.sum(axis=0).argmax())
    labels = np.full(len(scores), best)
    if scores.shape[1] == 1:
        return labels
    gain = np.delete(scores, best, axis=1).max(axis=1) - scores[:, best]
    if gain.sum() >= switch:
        return viterbi(scores, switch)
    walk = np.zeros(len(scores))
    for turned in (gain, gain[::-1]):
        total = np.concatenate([[0.0], np.cumsum(turned)])
        up = (total - np.minimum.accumulate(total))[1:]
        walk = np.maximum(walk, up) if turned is gain else np.maximum(walk, up[::-1])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], walk > 0, [False]])))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        first, last = a == 0, b == len(scores)
        if walk[a:b].max() >= (1 if first or last else 2) * switch:
            labels[a:b] = viterbi(scores[a:b], switch, None if first else best, None if last else best)
    return labels


@dataclass
class Found:
    language: str
    score: float
    spans: list[tuple[int, int, str]]


def found_in(model: Model | None, texts: list[str]) -> Iterator[Found]:
    """For each text its language, a score, and spans (start, end, language) in code points."""
    words = words_of(texts)
    if model is None or not len(words.text):
        yield from (Found(UNKNOWN, 0.0, []) for _ in texts)
        return
    scores = word_scores(model, words)
    edges = np.searchsorted(words.text, np.arange(len(texts) + 1))
    for a, b in zip(edges, edges[1:], strict=False):
        if a == b:
            yield Found(UNKNOWN, 0.0, [])
            continue
        own = scores[a:b]
        labels = best_labels(own, model.switch)
        letters = np.bincount(labels, weights=words.letters[a:b], minlength=len(model.languages))
        best = int(letters.argmax())
        # How sure the words under that label are of it, times the share of letters that have it.
        sums = own[labels == best].sum(axis=0)
        sure = 1.0 / np.exp(np.maximum(sums - sums[best], -700).clip(max=700)).sum()
        cuts = np.flatnonzero(np.diff(labels)) + 1
        spans = [(int(words.start[a + i]), int(words.end[a + j - 1]), model.languages[labels[i]]) for i, j in zip([0, *cuts], [*cuts, b - a], strict=True)]
        yield Found(model.languages[best], float(min(1.0, letters[best] / letters.sum() * sure)), spans)


def in_groups(model: Model | None, texts: Iterable[str]) -> Iterator[Found]:
    """As ``found_in``, for so many texts at once that the arrays stay small."""
    group: list[str] = []
    held = 0
    for text in texts:
        if group and held + len(text) > PIECE // 8:
            yield from found_in(model, group)
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield from found_in(model, group)


def learned_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(lang, text) of the first so many documents of each language in hash order, outside the held-out fold."""
    rows = docs.where(F.coalesce(F.crc32(F.col(key).cast("string")) % 5 != 0, F.lit(False)))
    rows = rows.select(F.col(key).alias("id"), F.col(language).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # Hashes below a language's share leave about twice the asked number to be ranked, however many documents it has.
    shares = rows.sparkSession.createDataFrame([(name, min(1.0, 2 * per_language / n)) for name, n in totals.items()], "lang string, share double")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ids = rows.select("id", "lang").join(F.broadcast(shares), "lang").where(place < F.col("share")).select("id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = ids.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language).select("id", "lang")
    # Only ids and languages were ranked; the texts of the chosen ones are looked up.
    chosen = F.broadcast(chosen) if len(totals) * per_language <= BROADCAST_ROWS else chosen
    return rows.join(chosen, ["id", "lang"]).select("lang", F.coalesce("text", F.lit("")).alias("text"))


def counted(rows: DataFrame) -> DataFrame:
    """(lang, bin, n) over all given texts; bins from BINS on count words by script."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                words = words_of([text])
                sums = held.setdefault(lang, np.zeros(BINS + len(NAMES), np.int64))
                sums += np.bincount(words.bins.reshape(-1), minlength=len(sums)) + np.bincount(BINS + words.script.astype(np.int64), minlength=len(sums))
        for lang, sums in held.items():
            at = np.flatnonzero(sums)
            yield pd.DataFrame({"lang": lang, "bin": at.astype(np.int32), "n": sums[at]})

    return rows.mapInPandas(count, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def fitted(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """The model of the labelled documents; none if there are none. Its size is languages times BINS, whatever the input."""
    rows = learned_rows(docs, key, text, language, per_language)
    found = counted(rows).toPandas()
    languages = sorted(found["lang"].unique())
    if not languages:
        return None
    counts = np.zeros((BINS + len(NAMES), len(languages)))
    counts[found["bin"].to_numpy(), np.searchsorted(languages, found["lang"].to_numpy(str))] = found["n"]
    groups, scripts = counts[:BINS], counts[BINS:]
    weights = np.log((groups + 0.1) / (groups.sum(axis=0) + 0.1 * BINS))
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, weights.astype(np.float32), np.where(share >= SCRIPT_SHARE, 0.0, CLOSED))


def labelled(docs: DataFrame, model: Model | None, text: str = "text", into: str = "language", spans: bool = True) -> DataFrame:
    """``docs`` and one more column: struct(lang_pred, score, and spans of (start, end, lang) where asked for)."""
    kind = "lang_pred string, score double" + (", spans array<struct<start: int, end: int, lang: string>>" if spans else "")

    @F.pandas_udf(kind)
    def label(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = list(in_groups(model, [t if isinstance(t, str) else "" for t in batch]))
            columns = {"lang_pred": [f.language for f in found], "score": [f.score for f in found]}
            if spans:
                columns["spans"] = [[{"start": a, "end": b, "lang": lang} for a, b, lang in f.spans] for f in found]
            yield pd.DataFrame(columns)

    return docs.withColumn(into, label(F.col(text)))


def predicted(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document."""
    model = fitted(docs, key, text, language)
    held_out = F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))
    rows = labelled(docs.select(F.col(key).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text")), model, "text", "found", spans=False)
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")
