"""Hard negatives of anchors by a vertical scan of the columns, with bounds on what is still unread.

Vectors are packed into blocks that hold each dimension as one column, with the
smallest and largest value of every column. Anchors are packed likewise, and
every block of anchors meets every block of vectors in a cell of a grid, which
is one group of bounded size. In a cell an anchor reads the columns in
descending order of its own magnitudes, a few at a time. What the unread
columns can still add lies between sums of column extremes; rows whose bounds
show that they cannot be among the first are struck from the candidate bitmap.
A first scan finds each anchor's positives, a second one the negatives of the
score windows that the positives open. What cells find is ranked by Spark,
whose map tasks keep the first few rows of each anchor.

Scores are inner products of the components times 256, rounded down, in exact
integers. The anchors are a stated query set against all rows: the work is
anchors times rows, nothing is left out, and no group is larger than a block.

Defined results: a null id, label, vector or component, a component that is not
finite, and one beyond 131,072 in magnitude (scores would leave the range of a
long) exclude the row; a shorter vector counts as followed by zeros, an empty
one scores 0; a negative positive score opens no window; every repeated row
counts, also as another row of its own anchor; ties go to the smaller id; other
columns are not read, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentflow.llm.tables import written

#: Rows and anchors of a block, and dimensions read between two looks at the bounds.
ROWS, ANCHORS, SLICE = 1024, 512, 8
POSITIVES, NEGATIVES = 5, 5
#: A negative scores at least so many hundredths of the positive, and at most as much as it.
SHARE = 80
#: Components beyond this magnitude would take sums of products out of 64 bits.
LARGEST = 1 << 17

PACKED = "block int, n int, rows binary, ids binary, labels binary, values binary, windows binary"
FOUND = "anchor_row bigint, anchor_id bigint, window bigint, row bigint, id bigint, score bigint"


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """(row, id, label, q) of the rows that take part: a number of the row's own and integer components."""
    label = F.col(label) if isinstance(label, str) else label
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) <= LARGEST, F.lit(False)))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.when(fine, F.col(vector)).alias("q"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL")
    return rows.select(
        F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("q", lambda x: F.floor(256 * x.cast("double")).cast("int")).alias("q")
    )


def packed(rows: DataFrame, blocks: int) -> DataFrame:
    """So many blocks of columns; rows are dealt to them by a hash of their number."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row", ignore_index=True)
        values = np.zeros((max(map(len, part["q"])), len(part)), np.int32)
        windows = np.full((len(part), POSITIVES), -1, np.int64)
        for i, (q, w) in enumerate(zip(part["q"], part["windows"], strict=True)):
            values[: len(q), i] = q
            windows[i, : len(w)] = w
        longs = [part[c].to_numpy(np.int64).tobytes() for c in ("row", "id", "label")]
        return pd.DataFrame([(part["block"][0], len(part), *longs, values.tobytes(), windows.tobytes())], columns=[c.split()[0] for c in PACKED.split(", ")])

    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    return rows.withColumn("block", block).groupBy("block").applyInPandas(pack, PACKED)


class Block:
    """A packed block opened: ``values`` is dimensions x rows."""

    def __init__(self, row: pd.Series) -> None:
        n = int(row["n"])
        self.rows, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids", "labels"))
        self.values = np.frombuffer(row["values"], np.int32).reshape(-1, n).astype(np.int64)
        self.windows = np.frombuffer(row["windows"], np.int64).reshape(n, POSITIVES)
        self.low, self.high = self.values.min(axis=1), self.values.max(axis=1)


def scanned(anchor: np.ndarray, block: Block, candidates: np.ndarray, possible: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that ``possible`` keeps to the end, and their scores.

    ``possible`` gets lower and upper bounds of the scores and returns the
    bitmap of candidates to go on with. After the last column both are exact.
    """
    dims = min(len(anchor), len(block.values))
    anchor = anchor[:dims]
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = anchor * block.low[:dims], anchor * block.high[:dims]
    least, most = np.minimum(*ends)[order], np.maximum(*ends)[order]
    partial = np.zeros(len(candidates), np.int64)
    for at in range(0, dims, SLICE):
        read = order[at : at + SLICE]
        partial = partial + anchor[read] @ block.values[np.ix_(read, candidates)]
        bitmap = possible(partial + least[at + SLICE :].sum(), partial + most[at + SLICE :].sum())
        if not bitmap.all():
            candidates, partial = candidates[bitmap], partial[bitmap]
        if not len(candidates):
            break
    return candidates, partial


def among_first(low: np.ndarray, high: np.ndarray, first: int) -> np.ndarray:
    """Bitmap of the rows whose upper bound reaches the lower bounds of so many rows."""
    if len(low) <= first:
        return np.ones(len(low), bool)
    return high >= np.partition(low, len(low) - first)[len(low) - first]


def in_windows(low: np.ndarray, high: np.ndarray, windows: np.ndarray, share: int, first: int) -> np.ndarray:
    """Bitmap of the rows that may be among the first of a window [share % of p, p]."""
    kept = np.zeros(len(low), bool)
    for top in windows:
        bottom = -(-share * top // 100)
        may = (high >= bottom) & (low <= top)
        # Rows that are in the window whatever comes set a floor for all others.
        sure = low[(low >= bottom) & (high <= top)]
        if len(sure) >= first:
            may &= high >= np.partition(sure, len(sure) - first)[len(sure) - first]
        kept |= may
    return kept


def ordered(block: Block, candidates: np.ndarray, scores: np.ndarray, first: int) -> np.ndarray:
    return np.lexsort((block.rows[candidates], block.ids[candidates], -scores))[:first]


def same_label(anchors: Block, block: Block, first: int) -> Iterator[tuple]:
    """The first other rows of each anchor's label in this block."""
    own = {label: np.flatnonzero(block.labels == label) for label in np.unique(anchors.labels)}
    for i, (row, label) in enumerate(zip(anchors.rows, anchors.labels, strict=True)):
        candidates = own[label][block.rows[own[label]] != row]
        candidates, scores = scanned(anchors.values[:, i], block, candidates, lambda low, high: among_first(low, high, first))
        for k in ordered(block, candidates, scores, first):
            yield row, anchors.ids[i], -1, block.rows[candidates[k]], block.ids[candidates[k]], scores[k]


def other_labels(anchors: Block, block: Block, share: int, first: int) -> Iterator[tuple]:
    """The first rows of other labels in every window of each anchor in this block."""
    others = {label: np.flatnonzero(block.labels != label) for label in np.unique(anchors.labels)}
    for i, (row, label) in enumerate(zip(anchors.rows, anchors.labels, strict=True)):
        windows = anchors.windows[i][anchors.windows[i] >= 0]
        candidates, scores = scanned(anchors.values[:, i], block, others[label], lambda low, high, w=windows: in_windows(low, high, w, share, first))
        for top in windows:
            inside = (100 * scores >= share * top) & (scores <= top)
            for k in ordered(block, candidates[inside], scores[inside], first):
                found = candidates[inside][k]
                yield row, anchors.ids[i], top, block.rows[found], block.ids[found], scores[inside][k]


def over_grid(anchors: DataFrame, blocks: DataFrame, counts: tuple[int, int], scan: Callable[[Block, Block], Iterator[tuple]]) -> DataFrame:
    """What ``scan`` finds in every pair of a block of anchors and a block of rows, each pair a group of its own."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def cell(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(scan(Block(left.iloc[0]), Block(right.iloc[0]))) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=names).astype("int64")

    tasks = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = anchors.select("*", F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(counts[1] - 1))).alias("b"))
    right = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(counts[0] - 1))).alias("a"), F.col("block").alias("b"))
    left, right = left.repartition(tasks, "a", "b"), right.repartition(tasks, "a", "b")
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(cell, FOUND)


def ranked(found: DataFrame, first: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)


def mined(
    vectors: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    share: int = SHARE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchors``, a condition on ``id``, selects."""
    if not 1 <= positives <= POSITIVES:
        raise ValueError(f"between 1 and {POSITIVES} positives an anchor")
    rows = written(usable(vectors, key, vector, label), "vectors").withColumn("windows", F.array().cast("array<bigint>"))
    asked = written(rows.where(anchors), "anchors")
    counts = tuple(max(1, -(-n // size)) for n, size in ((asked.count(), ANCHORS), (rows.count(), ROWS)))
    blocks = written(packed(rows, counts[1]), "blocks")
    same = over_grid(packed(asked, counts[0]), blocks, counts, lambda a, b: same_label(a, b, positives))
    best = written(ranked(same, positives).select("anchor_row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Positives of one score open one window.
    opened = best.where("positive_score >= 0").groupBy("anchor_row").agg(F.collect_set("positive_score").alias("windows"))
    again = asked.drop("windows").join(opened, asked["row"] == opened["anchor_row"]).drop("anchor_row")
    others = over_grid(packed(again, counts[0]), blocks, counts, lambda a, b: other_labels(a, b, share, negatives))
    hard = written(ranked(others, negatives), "negatives")
    return best.join(hard, (best["anchor_row"] == hard["anchor_row"]) & (best["positive_score"] == hard["window"])).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
