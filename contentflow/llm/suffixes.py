"""Repeated passages by a sparse suffix array.

Of each text, only the suffixes that start at minimisers are kept: words at
which the hash of eight words is smallest in some run of sixteen starts, a choice
that depends on the content alone, so equal passages keep the same suffixes.
Every run of ``MATCH`` words belongs to the suffix chosen from its first sixteen
starts. Runs are brought together in two steps: by the first ``HEAD`` words of
their suffix, and, where these occur more than once, by all their words. Equal
runs meet wherever they are, so a pair that shares words on both sides of a
suffix is found whatever else lies between the two in an order of suffixes.
Runs that occur more than once are joined per document, so a longer passage is
covered piece by piece, however long it is.

Both steps exchange packed sets of hashes (see ``exchange``). A bucket sends
each run once with the smallest id that has it, and hears the smallest id of the
other buckets: a notice in a third of all documents, or one that a text repeats
many times, is one entry per bucket, and no group has a limit.

Defined results: null, empty and short texts have no passages; a passage
repeated within one text counts; rows of one id are separate texts with spans
under one id; rows without an id are compared and have a null id; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow.llm import exchange, hashing
from contentflow.llm.hashing import U, member, unpacked
from contentflow.llm.language_model import planes, unplaned

MATCH = 50
#: Words hashed for the choice of suffixes, and starts among which one is chosen.
GRAM, RUN = 8, 16
#: Words by which suffixes are brought together: at most MATCH - RUN + 1.
HEAD = 24
#: Starts whose runs are looked at together, so that memory stays small.
GROUP = 1024
#: Buckets per shuffle partition: two steps send a message from each to each partition.
EACH = 2


def chosen(words: np.ndarray, first: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which ``match`` words of one text start, and the suffix of each: of its first starts, the first with the smallest hash."""
    place = hashing.starts(first, match)
    if not len(place):
        return place, place
    runs = np.lib.stride_tricks.sliding_window_view(hashing.ngrams(words, GRAM, seed=2), RUN)
    return place, np.concatenate([p + runs[p].argmin(axis=1) for p in np.array_split(place, -(-len(place) // GROUP))])


def edges(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values, and the run of each value."""
    new = np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]
    start = np.flatnonzero(new)
    return start, np.diff(start, append=len(values)), np.cumsum(new) - 1


def partners(value: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place with a value and an id: the smallest other id that has the value, else its own; and how many places have it."""
    by = np.lexsort((ids, value))
    start, size, run = edges(value[by])
    ids = ids[by]
    least = ids[start]
    own = ids == least[run]
    after = start + np.bincount(run, weights=own, minlength=len(start)).astype(np.int64)
    second = np.where(after < start + size, ids[np.minimum(after, len(ids) - 1)], least)
    other, many = np.empty_like(ids), np.empty_like(run)
    other[by], many[by] = np.where(own, second[run], least[run]), size[run]
    return other, many


def joined(spans: pd.DataFrame) -> pd.DataFrame:
    """Overlapping spans of one text joined; the smallest partner is kept."""
    spans = spans.sort_values(["doc_id", "row", "start", "end"], ignore_index=True)
    text = np.cumsum(np.concatenate([[0], (spans["doc_id"].to_numpy()[1:] != spans["doc_id"].to_numpy()[:-1]) | (spans["row"].to_numpy()[1:] != spans["row"].to_numpy()[:-1])]))
    # Ends of earlier texts lie below all starts of later ones once each text is shifted by more than any end.
    shift = text * (np.int64(spans["end"].max()) + 1)
    reach = np.maximum.accumulate(spans["end"].to_numpy() + shift)
    new = np.concatenate([[True], spans["start"].to_numpy()[1:] + shift[1:] > reach[:-1]])
    group = np.cumsum(new) - 1
    return spans.assign(group=group).groupby("group", sort=False).agg(doc_id=("doc_id", "first"), start=("start", "min"), end=("end", "max"), match_doc_id=("match_doc_id", "min"))


def passages(docs: DataFrame, match: int = MATCH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, n_words, match_doc_id): the repeated passages of every document, end exclusive, and a document that has it too."""
    if match < HEAD + RUN - 1:
        raise ValueError(f"passages of {HEAD + RUN - 1} words and more can be asked for")
    rows, count = exchange.bucketed(docs, key, text, EACH), exchange.partitions(docs.sparkSession)

    def suffixes(rows: pd.DataFrame):
        rows, texts = exchange.texts(rows)
        words, first = hashing.word_hashes(texts)
        place, suffix = chosen(words, first, match)
        at, which = np.unique(suffix, return_inverse=True)
        head = hashing.ngrams(words, HEAD)[at] if len(words) else np.zeros(0, U)
        return rows, words, first, place, which, (head >> U(32)) % U(count) << U(32) | (head & U(0xFFFFFFFF))

    def runs(rows: pd.DataFrame, heads: list[np.ndarray]):
        """Text, start within it, id and hash of the runs whose suffix has one of the given heads."""
        rows, words, first, place, which, head = suffixes(rows)
        given = np.sort(np.concatenate([np.zeros(0, U), *heads]))
        place = place[member(head, given)[which]]
        text = np.searchsorted(first, place, side="right") - 1
        value = hashing.ngrams(words, match)[place] if len(place) else np.zeros(0, U)
        return text, place - first[text], rows["doc_id"].to_numpy(np.int64)[text], value

    def ask(bucket: int, rows: pd.DataFrame) -> pd.DataFrame:
        *_, head = suffixes(rows)
        value, times = np.unique(head, return_counts=True)
        sent = [(p, bucket, hashing.packed(v), planes(t)) for p, v, t in exchange.split((value >> U(32)).astype(np.int64), value & U(0xFFFFFFFF), times)]
        return pd.DataFrame(sent, columns=["part", "bucket", "heads", "times"])

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        heads, times = [unpacked(h) for h in rows["heads"]], [unplaned(t) for t in rows["times"]]
        total, where = np.unique(np.concatenate(heads), return_inverse=True)
        summed = np.bincount(where, weights=np.concatenate(times), minlength=len(total)).astype(np.int64)
        out, at = [], 0
        for part, bucket, h in zip(rows["part"], rows["bucket"], heads, strict=True):
            n = summed[where[at : at + len(h)]]
            at += len(h)
            if (n > 1).any():
                out.append((bucket, part, hashing.packed(h[n > 1])))
        return pd.DataFrame(out, columns=["bucket", "part", "heads"])

    def enter(bucket: int, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(answers):
            return pd.DataFrame(columns=["part", "bucket", "heads", "runs", "ids"])
        heads = [unpacked(h) | U(p) << U(32) for p, h in zip(answers["part"], answers["heads"], strict=True)]
        _, _, ids, value = runs(rows, heads)
        part = ((value >> U(32)) % U(count)).astype(np.int64)
        by = np.lexsort((ids, value, part))
        by = by[edges(value[by])[0]]
        sent = {p: (hashing.packed(v), planes(i.astype(U))) for p, v, i in exchange.split(part[by], value[by], ids[by])}
        # The heads come back with the answer, so that the last step has all of them.
        back = dict(zip(answers["part"], answers["heads"], strict=True))
        return pd.DataFrame([(p, bucket, back.get(p, b""), *sent.get(p, (b"", b""))) for p in sorted({*sent, *back})], columns=["part", "bucket", "heads", "runs", "ids"])

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sent, ids = [unpacked(r) for r in rows["runs"]], [unplaned(i) for i in rows["ids"]]
        value = np.concatenate(sent)
        other, many = partners(value, np.concatenate(ids))
        out, at = [], 0
        for part, bucket, heads, v in zip(rows["part"], rows["bucket"], rows["heads"], sent, strict=True):
            o, n = other[at : at + len(v)], many[at : at + len(v)]
            at += len(v)
            out.append((bucket, part, heads, hashing.packed(v[n > 1]), planes(o[n > 1].astype(U))))
        return pd.DataFrame(out, columns=["bucket", "part", "heads", "runs", "others"])

    def collect(bucket: int, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("doc_id", "start_word", "end_word", "n_words", "match_doc_id")})
        if not len(rows) or not len(answers):
            return empty
        text, start, ids, value = runs(rows, [unpacked(h) | U(p) << U(32) for p, h in zip(answers["part"], answers["heads"], strict=True)])
        given, others = np.concatenate([unpacked(r) for r in answers["runs"]]), np.concatenate([unplaned(i) for i in answers["others"]])
        by = np.argsort(given)
        given, others = given[by], others[by]
        other, many = partners(value, ids)
        outside = member(value, given)
        abroad = others[np.minimum(np.searchsorted(given, value), len(given) - 1)] if len(given) else other
        # An id of another bucket counts before a document's own.
        other = np.where(outside, np.where(other == ids, abroad, np.minimum(other, abroad)), other)
        use = outside | (many > 1)
        if not use.any():
            return empty
        spans = joined(pd.DataFrame({"row": text[use], "doc_id": ids[use], "start": start[use], "end": start[use] + match, "match_doc_id": other[use]}))
        return pd.DataFrame({"doc_id": spans["doc_id"], "start_word": spans["start"], "end_word": spans["end"], "n_words": spans["end"] - spans["start"], "match_doc_id": spans["match_doc_id"]})

    heads = exchange.answered(exchange.asked(rows, ask, "heads binary, times binary"), decide, "bucket int, part int, heads binary")
    entered = exchange.met(rows, heads, enter, "part int, bucket int, heads binary, runs binary, ids binary")
    answers = exchange.answered(entered, compare, "bucket int, part int, heads binary, runs binary, others binary")
    done = exchange.met(rows, answers, collect, "doc_id bigint, start_word int, end_word int, n_words int, match_doc_id bigint")
    return exchange.restored(done).withColumn("match_doc_id", F.nullif("match_doc_id", F.lit(exchange.NO_ID)))
