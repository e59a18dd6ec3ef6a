"""Exact repeated passages, by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of ten words, which are
indexed, and every window of ten consecutive words probes the index. Any repeat
of twenty words holds a whole block of either side, so both sides are hit. Hits
are extended to all windows of twenty words around them; windows that occur in
an earlier place are joined into the maximal repeats, whose words go.

The index is hash-partitioned. Buckets of texts (see ``exchange``) send the
distinct hashes of their blocks and windows, not a row per window, and the
candidates' full hashes in a second exchange. Block hashes may collide, which
only adds candidates; a repeat is decided by 64 bits within a partition chosen
by other bits.

Defined results: null, empty and short texts lose nothing; texts are handled
whole; rows with one id are ordered by text and the second copy loses all its
windows; rows without an id come after all others; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from contentflow.llm import exchange, hashing
from contentflow.llm.hashing import U, member, unpacked

WINDOW = 20
#: 2 * BLOCK - 1 <= WINDOW: every window holds a whole block.
BLOCK = 10
LOW = U(0xFFFFFFFF)


def _probes(first: np.ndarray, words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of ten words, their (partition, short hash) in one number, and whether a block starts there."""
    place = hashing.starts(first, BLOCK)
    h = hashing.ngrams(words, BLOCK)[place]
    text = np.searchsorted(first, place, side="right") - 1
    return place, ((h >> U(32)) % U(buckets) << U(32)) | (h & LOW), (place - first[text]) % BLOCK == 0


def _windows(first: np.ndarray, words: np.ndarray, buckets: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of whole windows, their hashes, and the partition of each, from another hash."""
    place = hashing.starts(first, window)
    return place, hashing.ngrams(words, window)[place], (hashing.ngrams(words, window, seed=1)[place] >> U(20)) % U(buckets)


def _merged(rows: pd.DataFrame, column: str) -> np.ndarray:
    """The (partition, short hash) numbers of all answers to a bucket, sorted."""
    if not len(rows):
        return np.zeros(0, U)
    return np.sort(np.concatenate([unpacked(v) | U(p) << U(32) for p, v in zip(rows["part"], rows[column], strict=True)]))


def removals(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept): spans [start, end) of removed words, and the kept words joined by one space."""
    if window < 2 * BLOCK - 1:
        raise ValueError(f"a window needs {2 * BLOCK - 1} words to hold a block")
    rows, count = exchange.bucketed(docs, key, text), exchange.partitions(docs.sparkSession)

    def ask(bucket: int, rows: pd.DataFrame) -> pd.DataFrame:
        words, first = hashing.word_hashes(exchange.texts(rows)[1])
        _, probe, block = _probes(first, words, count)
        found, times = np.unique(probe[block], return_counts=True)
        sets = [np.unique(probe[~block]), found[times == 1], found[times > 1]]
        # One row to each part, with its slices of the three sets.
        edges = [np.searchsorted(v, np.arange(count + 1, dtype=U) << U(32)) for v in sets]
        sent = [(p, bucket, *(hashing.packed(v[e[p] : e[p + 1]] & LOW) for v, e in zip(sets, edges, strict=True))) for p in range(count)]
        return pd.DataFrame(sent, columns=["part", "bucket", "window", "once", "often"])

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        sent = {c: list(map(unpacked, rows[c])) for c in ("once", "often")}
        blocks, times = np.unique(np.concatenate([np.zeros(0, U), *sent["once"], *sent["often"], *sent["often"]]), return_counts=True)
        shared = blocks[times > 1]
        out = []
        for part, bucket, windows, once, often in rows[["part", "bucket", "window", "once", "often"]].itertuples(index=False):
            own = [unpacked(windows), np.sort(np.concatenate([unpacked(once), unpacked(often)]))]
            hits = [v[member(v, among)] for v, among in zip(own, (blocks, shared), strict=True)]
            if any(map(len, hits)):
                out.append((bucket, part, *map(hashing.packed, hits)))
        return pd.DataFrame(out, columns=["bucket", "part", "window", "block"])

    def extend(bucket: int, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows, texts = exchange.texts(rows)
        words, first = hashing.word_hashes(texts)
        at, probe, block = _probes(first, words, count)
        hit = np.zeros(len(words) + window + 1, np.int32)
        for column, which in (("window", ~block), ("block", block)):
            hit[at[which][member(probe[which], _merged(answers, column))] + 1] = 1
        hits = np.cumsum(hit)
        place, h, part = _windows(first, words, count, window)
        near = hits[place + window - BLOCK + 1] > hits[place]
        place, h, part = place[near], h[near], part[near]
        ids = rows["doc_id"].to_numpy()[np.searchsorted(first, place, side="right") - 1]
        by = np.lexsort((place, h, part))
        h, part, ids = h[by], part[by], ids[by]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        sent = [(p, bucket, hashing.packed(v), i.tobytes()) for p, v, i in exchange.split(part[new].astype(np.int64), h[new], ids[new])]
        return pd.DataFrame(sent, columns=["part", "bucket", "window", "ids"])

    def earliest(rows: pd.DataFrame) -> pd.DataFrame:
        values = [unpacked(v) for v in rows["window"]]
        bucket = np.repeat(rows["bucket"].to_numpy(), [len(v) for v in values])
        h, ids = np.concatenate(values), np.concatenate([np.frombuffer(i, np.int64) for i in rows["ids"]])
        by = np.lexsort((bucket, ids, h))
        h, bucket = h[by], bucket[by]
        late = np.zeros(len(h), bool)
        late[1:] = h[1:] == h[:-1]
        h, bucket = h[late], bucket[late]
        by = np.lexsort((h, bucket))
        return pd.DataFrame([(b, hashing.packed(v)) for b, v in exchange.split(bucket[by], h[by])], columns=["bucket", "window"])

    def remove(bucket: int, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows, texts = exchange.texts(rows)
        words, first = hashing.word_hashes(texts)
        place, h, _ = _windows(first, words, count, window)
        late = member(h, np.sort(np.concatenate([np.zeros(0, U), *map(unpacked, answers["window"])])))
        repeat = np.ones(len(h), bool)
        repeat[np.unique(h, return_index=True)[1]] = False
        late |= repeat
        change = np.zeros(len(words) + window + 1, np.int32)
        np.add.at(change, place[late], 1)
        np.add.at(change, place[late] + window, -1)
        gone = np.cumsum(change)[: len(words)] > 0
        out = []
        for i, (doc, text) in enumerate(zip(rows["doc_id"], texts, strict=True)):
            mask = gone[first[i] : first[i + 1]]
            if mask.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
            else:
                spans = []
            # A lone surrogate was encoded as it came and is decoded so.
            kept = b" ".join(compress(text.split(), ~mask)).decode("utf-8", "replace")
            out.append((doc, len(mask), int(mask.sum()), spans, kept))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "removed", "kept"])

    probes = exchange.answered(exchange.asked(rows, ask, "window binary, once binary, often binary"), decide, "bucket int, part int, window binary, block binary")
    candidates = exchange.met(rows, probes, extend, "part int, bucket int, window binary, ids binary")
    late = exchange.answered(candidates, earliest, "bucket int, window binary")
    done = exchange.met(rows, late, remove, "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept string")
    return exchange.restored(done)
