"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; filters of eight bytes move by four over the whole text,
which is cut into chunks of 512 bytes that overlap by 128. Each filter is
max-pooled within a chunk; the largest and the mean pooled values over all
chunks of the text give one probability. The network is fitted by Adam on a
bounded, class-balanced sample of labelled texts and corrected to the class
shares of all labels. Scoring is one pass over the rows without a shuffle.

Defined results: null and empty texts are one chunk of padding and get that
chunk's score; very long texts are scored whole; repeated rows score alike;
null labels are not learned from; labels of one class only give the constant
share of that class, no labels 0.5; a null id is scored and not held out; ids and
other columns are left as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.llm.tables import absent

STEP, BLOCK, CHUNK, HOP = 4, 128, 512, 384
EMBED, FILTERS = 8, 32
#: Labelled texts of each class that the network is fitted on, and chunks of each that are looked at.
SAMPLE_PER_CLASS, SAMPLE_CHUNKS = 1000, 48
EPOCHS, MINIBATCH, RATE = 8, 16, 0.01
THRESHOLD = 0.3
#: Bytes scored at once.
PIECE = 1 << 20


@dataclass
class Net:
    embed: np.ndarray  # 256 x EMBED
    taps: np.ndarray  # 2 x (STEP * EMBED) x FILTERS, the halves of each filter
    shift: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS, for the largest and the mean
    bias: np.ndarray  # 1

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.taps, self.shift, self.out, self.bias]


def fresh(seed: int = 3) -> Net:
    g = np.random.default_rng(seed)
    return Net(
        g.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        g.normal(0, (2 * STEP * EMBED) ** -0.5, (2, STEP * EMBED, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        g.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        np.zeros(1, np.float32),
    )


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each padded to whole blocks and at least a chunk; the first block of each and the end."""
    sizes = [max(CHUNK, -(-(len(t) + STEP) // BLOCK) * BLOCK) for t in texts]
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = np.zeros(starts[-1], np.uint8)
    for t, s in zip(texts, starts, strict=False):
        flat[s : s + len(t)] = np.frombuffer(t, np.uint8)
    return flat, starts // BLOCK


def chunk_starts(blocks: int) -> np.ndarray:
    """First block of each chunk of a text of so many blocks; the last chunk ends with the text."""
    last = blocks - CHUNK // BLOCK
    return np.unique(np.append(np.arange(0, last + 1, HOP // BLOCK), last))


def convolved(net: Net, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of four embedded bytes, the number of the cell after each, and the filter values; after a text's last cell comes an empty one."""
    cells = net.embed[np.append(flat, np.zeros(STEP, np.uint8))].reshape(-1, STEP * EMBED)
    after = np.arange(1, len(cells))
    last = first[1:] * (BLOCK // STEP) - 1
    after[last] = len(cells) - 1
    both = cells @ np.concatenate([net.taps[0], net.taps[1]], axis=1)
    out = both[:-1, :FILTERS] + both[1:, FILTERS:]
    out[last] = both[last, :FILTERS] + both[-1, FILTERS:]
    return cells, after, out


def pooled(net: Net, flat: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Per text: chunks x FILTERS, the largest filter values."""
    *_, out = convolved(net, flat, first)
    blocks = out.reshape(-1, BLOCK // STEP, FILTERS).max(axis=1)
    found = []
    for a, b in zip(first, first[1:], strict=False):
        own, at = blocks[a:b], chunk_starts(b - a)
        found.append(np.maximum(np.maximum(own[at], own[at + 1]), np.maximum(own[at + 2], own[at + 3])))
    return found


def probability(net: Net, largest: np.ndarray, mean: np.ndarray) -> np.ndarray:
    logit = np.concatenate([largest, mean], axis=-1) @ net.out + net.bias
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -40, 40)))


def scores(net: Net, texts: list[bytes]) -> np.ndarray:
    """Scores of whole texts; of a text longer than a piece, the pooled values of the chunks of its pieces are combined."""
    out = np.zeros(len(texts))
    group: list[int] = []

    def flush() -> None:
        if group:
            pools = [np.maximum(p + net.shift, 0) for p in pooled(net, *laid_out([texts[i] for i in group]))]
            out[group] = probability(net, np.array([p.max(axis=0) for p in pools]), np.array([p.mean(axis=0) for p in pools]))
            group.clear()

    held = 0
    for i, text in enumerate(texts):
        if len(text) > PIECE:
            largest, total, count = np.zeros(FILTERS), np.zeros(FILTERS), 0
            # Pieces overlap as chunks do, so what spans a border is within one of them.
            step = PIECE // HOP * HOP
            for at in range(0, len(text), step):
                p = np.maximum(pooled(net, *laid_out([text[at : at + step + CHUNK - HOP]]))[0] + net.shift, 0)
                largest, total, count = np.maximum(largest, p.max(axis=0)), total + p.sum(axis=0), count + len(p)
            out[i] = probability(net, largest, total / count)[0]
            continue
        if held + len(text) > PIECE:
            flush()
            held = 0
        group.append(i)
        held += len(text) + CHUNK
    flush()
    return out


def sampled_chunks(text: bytes, limit: int = SAMPLE_CHUNKS) -> bytes:
    """For fitting only: at most so many chunks' worth of a text, in evenly spread runs of four chunks."""
    if len(text) <= limit * CHUNK:
        return text
    runs, size = limit // 4, 4 * CHUNK
    starts = np.linspace(0, len(text) - size, runs).astype(int)
    return b"".join(text[s : s + size] for s in starts)


def _gradients(net: Net, texts: list[bytes], labels: np.ndarray) -> tuple[list[np.ndarray], float]:
    flat, first = laid_out(texts)
    cells, after, out = convolved(net, flat, first)
    per = CHUNK // STEP
    spans = [a + chunk_starts(b - a) for a, b in zip(first, first[1:], strict=False)]
    counts = np.array([len(s) for s in spans])
    owner = np.repeat(np.arange(len(texts)), counts)
    start = np.concatenate(spans) * (BLOCK // STEP)
    view = np.lib.stride_tricks.sliding_window_view(out, per, axis=0)[start]  # chunks x FILTERS x per
    best = view.argmax(axis=2)
    pool = np.take_along_axis(view, best[:, :, None], 2)[:, :, 0] + net.shift
    active = np.maximum(pool, 0)
    edges = np.concatenate([[0], np.cumsum(counts)])
    largest = np.maximum.reduceat(active, edges[:-1], axis=0)
    mean = np.add.reduceat(active, edges[:-1], axis=0) / counts[:, None]
    p = probability(net, largest, mean)
    wrong = ((p - labels) / len(texts)).astype(np.float32)
    features = np.concatenate([largest, mean], axis=1)
    to_out, to_bias = features.T @ wrong, np.array([wrong.sum()], np.float32)
    to_largest, to_mean = wrong[:, None] * net.out[:FILTERS], wrong[:, None] * net.out[FILTERS:]
    back = (to_mean / counts[:, None])[owner] + np.where(active == largest[owner], to_largest[owner], 0)
    back = np.where(pool > 0, back, 0).astype(np.float32)
    place = start[:, None] + best  # row of cells of each pooled value
    left, right = cells[place], cells[after[place]]
    to_taps = np.stack([np.einsum("cfk,cf->kf", left, back), np.einsum("cfk,cf->kf", right, back)])
    to_embed = np.zeros_like(net.embed)
    groups = np.append(flat, np.zeros(STEP, np.uint8)).reshape(-1, STEP)
    for half, at in ((0, place), (1, after[place])):
        grad = (back[:, :, None] * net.taps[half].T[None]).reshape(-1, STEP, EMBED)
        np.add.at(to_embed, groups[at.reshape(-1)], grad)
    loss = float(-np.mean(labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9)))
    return [to_embed, to_taps, back.sum(axis=0), to_out, to_bias], loss


def trained(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Net:
    """Fit by Adam in a fixed order of minibatches."""
    net, order = fresh(seed), np.random.default_rng(seed)
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    steps, batches = 0, max(1, -(-len(texts) // MINIBATCH))
    for epoch in range(max(epochs, -(-300 // batches))):
        for pick in np.array_split(order.permutation(len(texts)), batches):
            steps += 1
            rate = RATE * (0.5 if epoch > epochs // 2 else 1.0)
            grads, _ = _gradients(net, [texts[i] for i in pick], labels[pick])
            for part, grad, (m, v) in zip(net.parts(), grads, moment, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                part -= (rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)
    return net


def constant(share: float) -> Net:
    net = fresh()
    net.out[:] = 0
    share = min(max(share, 1e-6), 1 - 1e-6)
    net.bias[:] = np.log(share / (1 - share))
    return net


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Net:
    """Fit on a sample of labelled documents outside the held-out fold (crc32 of the id as text, modulo 5, is 0)."""
    marked = labels.select("doc_id", F.col(label).alias("_label")).where("_label IN (0, 1) AND doc_id IS NOT NULL")
    marked = marked.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    classes = {int(r["_label"]): r["n"] for r in marked.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        return constant(float(next(iter(classes))) if classes else 0.5)
    # The first so many ids of each class in hash order: a sample of fixed size, so it can be broadcast.
    ids = marked.withColumn("_order", F.xxhash64("doc_id"))
    ids = [ids.where(F.col("_label") == k).orderBy("_order", "doc_id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(ids[0].unionAll(ids[1]))

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_order": b["_order"], "_label": b["_label"], "part": [sampled_chunks((t or "").encode()) for t in b["text"]]})

    rows = docs.select("doc_id", "text").join(chosen, "doc_id").mapInPandas(cut, "_order bigint, _label int, part binary").collect()
    rows = sorted(((r["_order"], r["_label"], bytes(r["part"])) for r in rows), key=lambda r: (r[0], r[1], r[2]))
    if len({r[1] for r in rows}) < 2:
        return constant(classes[1] / sum(classes.values()))
    net = trained([r[2] for r in rows], np.array([r[1] for r in rows], float))
    ones = sum(r[1] for r in rows)
    # The sample is balanced; the shares of all labels set the odds.
    net.bias += np.float32(np.log(classes[1] / classes[0]) - np.log(ones / (len(rows) - ones)))
    return net


def score_of(net: Net) -> Callable[[Column], Column]:
    """The score of a text; nothing but the text goes to Python, so ids and other columns stay what they are."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(scores(net, [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in batch]))

    return score


def scored(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, score) for every row."""
    return docs.select("doc_id", score_of(net)(F.col("text")).alias("score"))


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    net = fitted(docs, labels, **options)
    return scored(docs, net).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, **options) -> DataFrame:
    """The documents that are not rejected, with the columns they came with."""
    net = fitted(training if training is not None else docs, labels, **options)
    name = absent(docs, "score")
    return docs.withColumn(name, score_of(net)(F.col("text"))).where(F.col(name) >= THRESHOLD).drop(name)
