"""Stupid-backoff scores of documents under the n-gram counts of all other documents.

Counts of all n-grams up to the order are tables partitioned by hash; the
n-grams of the documents are joined to them and the logs summed per document.
Both sides travel packed (see ``exchange``): a bucket of documents sends each
partition its distinct n-grams with their counts, the partition adds up over all
buckets and answers, in the same order, with what the others have. A document's
own counts are then taken off, so a text is scored by the rest of the corpus and
back-off happens. Words and pairs go first; a longer n-gram occurs elsewhere only
if both its parts do, so only those are asked for in the next round.

For a word with its context: count(context, word) / count(context) where the
n-gram occurs elsewhere, else ``ALPHA`` times the score with a context shorter
by one. A single word's score is its count over all words; a word that occurs
nowhere else counts as one occurrence.

Defined results: null, blank and empty texts have no words and a null score;
words are taken as they are; rows of one id are documents of their own, so
copies predict each other; if a document is the whole corpus, the number of
other words counts as one; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow.llm import exchange, hashing
from contentflow.llm.hashing import U, unpacked
from contentflow.llm.tables import written

ORDER, ALPHA = 3, 0.4
#: Buckets per shuffle partition: fewer and larger ones hold more n-grams in common and ask for each once.
EACH = 2
#: Bits of an n-gram's hash. Two of ten thousand million n-grams share one with a chance of one in seven million for each.
BITS = 56


class Counts:
    """How often other documents have the n-grams that start at each word of a bucket, filled round by round."""

    def __init__(self, texts: list[bytes], order: int):
        self.words, self.first = hashing.word_hashes(texts)
        self.sizes = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.counts = [np.zeros(len(self.words), np.int64) for _ in range(order)]

    def ask(self, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of these sizes that may occur elsewhere, sorted, and how often the bucket has each."""
        self.places = []
        for n in sizes:
            place = hashing.starts(self.first, n)
            if n > 2:
                known = self.counts[n - 2] > 0
                place = place[known[place] & known[place + 1]]
            self.places.append(place)
        self.asked = sizes
        grams = np.concatenate([hashing.ngrams(self.words, n)[p] >> U(64 - BITS) for n, p in zip(sizes, self.places, strict=True)])
        found, self.where, self.times = np.unique(grams, return_inverse=True, return_counts=True)
        return found, self.times

    def told(self, others: np.ndarray) -> None:
        """Take the counts of the other buckets, add the bucket's own and take off each document's."""
        total = (self.times + others)[self.where]
        own = np.concatenate([self.owner[p] for p in self.places]) * np.int64(len(self.times) + 1) + self.where
        _, again, times = np.unique(own, return_inverse=True, return_counts=True)
        left, at = total - times[again], 0
        for n, place in zip(self.asked, self.places, strict=True):
            self.counts[n - 1][place] = left[at : at + len(place)]
            at += len(place)


def rounds(order: int) -> list[tuple[int, ...]]:
    return [tuple(range(1, min(order, 2) + 1)), *[(n,) for n in range(3, order + 1)]]


def planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, without planes that are zero."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.astype(U).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    rows = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, : data[0]] = rows.T
    return out.view(np.int64)[:, 0]


def scored(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, lm_score): the mean natural log of the scores of a document's words."""
    rows, count = exchange.bucketed(docs, key, text, EACH), exchange.partitions(docs.sparkSession)

    def parts(number: int) -> int:
        # The rounds after the first ask for half as much: as large parts, half as many.
        return count if number == 0 else (count + 1) // 2

    def part_of(h: np.ndarray, number: int) -> np.ndarray:
        # By the high bits, so that sorted hashes come partition by partition.
        return ((h >> U(BITS - 32)) * U(parts(number)) >> U(32)).astype(np.int64)

    def replayed(texts: list[bytes], answers: pd.DataFrame, known: int) -> Counts:
        """The counts after the first so many rounds."""
        state = Counts(texts, order)
        for number, sizes in enumerate(rounds(order)[:known]):
            grams, _ = state.ask(sizes)
            edges = np.searchsorted(part_of(grams, number), np.arange(parts(number) + 1))
            others = np.zeros(len(grams), np.int64)
            given = answers[answers[f"others_{number}"].notna()]
            for part, values in zip(given["part"], given[f"others_{number}"], strict=True):
                others[edges[part] : edges[part + 1]] = unplaned(values)
            state.told(others)
        return state

    def sent(bucket: int, state: Counts, number: int) -> pd.DataFrame:
        grams, times = state.ask(rounds(order)[number])
        rows = [(p, bucket, hashing.packed(g), planes(t)) for p, g, t in exchange.split(part_of(grams, number), grams, times)]
        return pd.DataFrame(rows, columns=["part", "bucket", "grams", "times"])

    def add_up(number: int):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            grams, times = [unpacked(g) for g in rows["grams"]], [unplaned(t) for t in rows["times"]]
            total, where = np.unique(np.concatenate(grams), return_inverse=True)
            summed = np.bincount(where, weights=np.concatenate(times), minlength=len(total))
            out, at = [], 0
            for part, bucket, t in zip(rows["part"], rows["bucket"], times, strict=True):
                others = summed[where[at : at + len(t)]].astype(np.int64) - t
                at += len(t)
                if others.any():
                    out.append((bucket, part, planes(others)))
            return pd.DataFrame(out, columns=["bucket", "part", f"others_{number}"])

        return run

    def score(bucket: int, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows, texts = exchange.texts(rows)
        state = replayed(texts, answers, len(rounds(order)))
        words, first, sizes, owner, counts = state.words, state.first, state.sizes, state.owner, state.counts
        inside = np.arange(len(words)) - first[owner]
        log, open_ = np.zeros(len(words)), np.ones(len(words), bool)
        for n in range(order, 1, -1):
            i = np.flatnonzero(open_ & (inside >= n - 1))
            start = i - n + 1
            have = counts[n - 1][start]
            hit = have > 0
            log[i[hit]] += np.log(have[hit] / counts[n - 2][start[hit]])
            open_[i[hit]] = False
            log[i[~hit]] += np.log(alpha)
        log[open_] += np.log(np.maximum(counts[0][open_], 1))
        sums = np.bincount(owner, weights=log, minlength=len(sizes))
        single = np.bincount(owner, weights=open_, minlength=len(sizes)).astype(np.int64)
        return pd.DataFrame({"doc_id": rows["doc_id"], "n_words": sizes, "log_sum": sums, "n_single": single})

    answers, schema = None, "part int, bucket int, grams binary, times binary"
    for number in range(len(rounds(order))):
        if answers is None:
            asked = exchange.asked(rows, lambda bucket, rows: sent(bucket, Counts(exchange.texts(rows)[1], order), 0), "grams binary, times binary")
        else:

            def ask(bucket: int, rows: pd.DataFrame, told: pd.DataFrame, number: int = number) -> pd.DataFrame:
                return sent(bucket, replayed(exchange.texts(rows)[1], told, number), number)

            asked = exchange.met(rows, answers, ask, schema)
        told = exchange.answered(asked, add_up(number), f"bucket int, part int, others_{number} binary")
        answers = told if answers is None else answers.unionByName(told, allowMissingColumns=True)
    sums = exchange.met(rows, answers, score, "doc_id bigint, n_words bigint, log_sum double, n_single bigint")
    sums = written(exchange.restored(sums), "lm")
    whole = sums.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    others = F.greatest(F.lit(whole) - F.col("n_words"), F.lit(1))
    mean = (F.col("log_sum") - F.col("n_single") * F.log(others.cast("double"))) / F.col("n_words")
    return sums.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.round(mean, 6)).alias("lm_score"))
