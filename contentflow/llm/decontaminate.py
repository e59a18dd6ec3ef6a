"""Benchmark decontamination by the q-gram lemma.

A text that holds a benchmark passage of m bytes with at most k edits shares at
least m - q + 1 - k * q of its q-grams with it, all within k + 1 neighbouring
diagonals. Shared q-grams are counted in bands of 2 * (k + 1) diagonals that
overlap by half; the bands that reach the bound are verified by an alignment
within the band. Passages are compared lower-cased (A-Z), as UTF-8 bytes; an
item longer than ``PIECE`` is looked for in overlapping pieces, so a document
that quotes any such piece of it is found.

Documents are read once and not shuffled. The benchmark, the query set, is held
by every task in blocks of ``BLOCK_BYTES``; a larger one takes another pass over
the documents for each further block.

Defined results: null and empty texts match nothing; whole texts are searched;
items that are null or shorter than ``LEAST`` bytes prove nothing and are not
looked for; repeated items match each under its own id; rows of one id are
searched each, and so are rows without an id; other columns are kept by ``clean``
as they are and left out by ``matches``;
an empty table on either side gives no matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.llm.hashing import member

Q = 8
#: Edits allowed per byte of a passage.
EDITS = 0.1
LEAST, PIECE = 24, 160
MATCH = ("item_id", "start", "end", "edits")
BLOCK_BYTES = 8 << 20
#: Bytes of text searched at once, and bits of the table that q-grams are first looked up in.
TEXT_BYTES, TABLE_BITS = 1 << 20, 22
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Benchmark:
    """Passages of benchmark items and the index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS):
        self.items: list[int] = []
        self.passages: list[bytes] = []
        for item, text in items:
            body = (text or "").encode("utf-8", "surrogatepass").lower()
            if len(body) < LEAST:
                continue
            last = max(0, len(body) - PIECE)
            for at in sorted({*range(0, last + 1, PIECE // 2), last}):
                self.items.append(item)
                self.passages.append(body[at : at + PIECE])
        size = np.array([len(p) for p in self.passages], np.int64)
        # As many edits as allowed while the lemma still asks for a few q-grams.
        self.size, self.edits = size, np.minimum((size * edits).astype(np.int64), np.maximum(0, (size - Q - 2) // Q))
        self.least = size - Q + 1 - self.edits * Q
        grams = [grams_of(p) for p in self.passages]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        by = np.argsort(flat, kind="stable")
        self.passage = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[by]
        self.place = (np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64))[by]
        self.grams, self.start = np.unique(flat[by], return_index=True)
        self.stop = np.append(self.start[1:], len(flat))
        self.table: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "table": None}

    def hits(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, entry of the index) of every shared q-gram."""
        if self.table is None:
            self.table = np.zeros(1 << TABLE_BITS, bool)
            self.table[_slot(self.grams)] = True
        own = grams_of(text)
        at = np.flatnonzero(self.table[_slot(own)])
        own = own[at]
        index = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        hit = self.grams[index] == own
        at, index = at[hit], index[hit]
        many = self.stop[index] - self.start[index]
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.start[index], many)
        return np.repeat(at, many), entry

    def regions(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(passage, first diagonal, last diagonal) of bands that hold enough shared q-grams."""
        at, entry = self.hits(text)
        passage = self.passage[entry]
        step = self.edits[passage] + 1
        # Diagonals are counted from the longest passage before the text, so none is negative.
        diagonal = at - self.place[entry] + PIECE
        band = diagonal // step
        span = np.int64(len(text) + 2 * PIECE)
        place = self.place[entry]
        all_keys = np.concatenate([passage * span + band, (passage * span + band - 1)[band > 0]])
        all_places = np.concatenate([place, place[band > 0]])
        key, count = np.unique(all_keys, return_counts=True)
        key = key[count >= self.least[key // span]]
        # A stammering text meets the same few q-grams of a passage again and again; each counts once.
        near = member(all_keys, key)
        once = np.unique(all_keys[near] * PIECE + all_places[near])
        key, count = np.unique(once // PIECE, return_counts=True)
        found = key // span
        good = count >= self.least[found]
        for p, b in zip(found[good], (key % span)[good], strict=True):
            first = b * (self.edits[p] + 1) - PIECE
            yield int(p), int(first), int(first + 2 * self.edits[p] + 1)

    def verified(self, text: bytes) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, edits) of verified passages in a lower-cased text, the first for each item and region."""
        done: dict[int, list[tuple[int, int]]] = {}
        for p, first, last in self.regions(text):
            passage, item = self.passages[p], self.items[p]
            exact = text.find(passage, max(0, first), max(0, last) + len(passage))
            if exact >= 0:
                found = (exact, exact + len(passage), 0)
            else:
                found = aligned(passage, text, first, last, int(self.edits[p]))
            if found:
                known = done.setdefault(p, [])
                if not any(a < found[1] and found[0] < b for a, b in known):
                    known.append(found[:2])
                    yield item, *found


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * _SPREAD) >> np.uint64(64 - TABLE_BITS)


def grams_of(text: bytes) -> np.ndarray:
    """Every eight bytes in a row, as numbers."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for o in range(min(Q, n)):
        part = np.frombuffer(text, "<u8", count=(len(text) - o) // Q, offset=o)
        out[o::Q] = part
    return out


def aligned(passage: bytes, text: bytes, first: int, last: int, edits: int) -> tuple[int, int, int] | None:
    """The best place (start, end, edits) of a passage whose alignment stays within diagonals first - edits to last + edits."""
    low = first - edits
    width = last - first + 1 + 2 * edits
    letters = np.frombuffer(b"\x00" * max(0, -low) + text[max(0, low) : max(0, low + width + len(passage))] + b"\x00" * (width + len(passage)), np.uint8)
    own = np.frombuffer(passage, np.uint8)
    far = 1 << 20
    steps = np.arange(width)
    # cost[d]: edits with i letters of the passage used, ending on diagonal low + d; origin: where it started.
    cost, origin = np.zeros(width, np.int64), steps + low
    for i in range(len(own)):
        through = cost + (letters[i : i + width] != own[i])
        skip = np.append(cost[1:] + 1, far)  # a letter of the passage is missing in the text
        from_skip = skip < through
        best = np.where(from_skip, skip, through)
        start = np.where(from_skip, np.append(origin[1:], 0), origin)
        # Letters of the text that the passage lacks: the cheapest to the left, plus one each.
        ramp = best - steps
        lowest = np.minimum.accumulate(ramp)
        source = np.maximum.accumulate(np.where(ramp == lowest, steps, 0))
        cost, origin = lowest + steps, start[source]
        if cost.min() > edits:
            return None
    d = int(cost.argmin())
    start, end = max(0, int(origin[d])), min(len(text), low + d + len(own))
    return (start, end, int(cost[d])) if cost[d] <= edits and start < end else None


def blocks(benchmark: DataFrame, edits: float = EDITS) -> Iterator[Benchmark]:
    """The benchmark in blocks of bounded size, read partition by partition."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("item_id IS NOT NULL AND length(text) > 0")
    for item, text in rows.toLocalIterator():
        held.append((item, text))
        size += len(text)
        if size >= BLOCK_BYTES:
            yield Benchmark(held, edits)
            held, size = [], 0
    if held:
        yield Benchmark(held, edits)


def found_in(index: Benchmark, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) in code points of whole texts."""
    bodies = [t.encode("utf-8", "surrogatepass").lower() if isinstance(t, str) else b"" for t in texts]
    group: list[int] = []
    size = 0
    for i in [*range(len(bodies)), None]:
        if i is None or (group and size + len(bodies[i]) > TEXT_BYTES):
            # Zero bytes keep diagonals of one text out of the next; no q-gram with one is in a passage.
            gap = b"\x00" * (2 * PIECE)
            edges = np.cumsum([0] + [len(bodies[j]) + len(gap) for j in group])
            if len(index.grams):
                flat = gap.join(bodies[j] for j in group)
                for item, start, end, edits in index.verified(flat):
                    # A passage that lacks its first or last bytes may be aligned into the gap; its middle lies in its text.
                    row = int(np.searchsorted(edges, (start + end) // 2, side="right")) - 1
                    body = bodies[group[row]]
                    a, b = max(0, start - int(edges[row])), min(end - int(edges[row]), len(body))
                    if a < b:
                        yield group[row], item, len(body[:a].decode("utf-8", "ignore")), len(body[:b].decode("utf-8", "ignore")), edits
            group, size = [], 0
        if i is not None:
            group.append(i)
            size += len(bodies[i]) + 2 * PIECE


def places(index: Benchmark) -> Callable[[Column], Column]:
    """Every place of a text that holds a passage; only the text goes to Python, so ids stay what they are, null ones too."""

    @F.pandas_udf("array<struct<item_id: bigint, start: bigint, end: bigint, edits: int>>")
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found: list[list[tuple]] = [[] for _ in batch]
            for i, *match in found_in(index, batch.tolist()):
                found[i].append(tuple(match))
            yield pd.Series([[dict(zip(MATCH, m, strict=True)) for m in sorted(each)] for each in found], dtype=object)

    return search


def free(index: Benchmark) -> Callable[[Column], Column]:
    """Whether a text holds no passage."""

    @F.pandas_udf("boolean")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            gone = {i for i, *_ in found_in(index, batch.tolist())}
            yield pd.Series([i not in gone for i in range(len(batch))], dtype=bool)

    return judge


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", edits: float = EDITS) -> DataFrame:
    """(doc_id, item_id, start, end, edits): every place, in code points, where a document holds a passage of an item."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = rows.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, start bigint, end bigint, edits int")
    for index in blocks(benchmark, edits):
        out = out.unionAll(rows.select("doc_id", F.explode(places(index)(F.col("text"))).alias("match")).select("doc_id", "match.*"))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", edits: float = EDITS) -> DataFrame:
    """The documents, with all their columns, that hold no passage of the benchmark."""
    for index in blocks(benchmark, edits):
        docs = docs.where(free(index)(F.col(text)))
    return docs
