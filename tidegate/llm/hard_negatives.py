"""Hard negatives by windows of scores, with BOND: a branch-and-bound scan of vertically stored dimensions.

Candidates are dealt into blocks and anchors into chunks, and each pair of them is one group. A group keeps its block
by columns. For each anchor it reads columns in descending order of the anchor's magnitudes and adds up partial scores;
what the unread columns can still add lies between sums of their smallest and largest products. These bounds shrink
the candidates: first to those that can be among the best of the anchor's own label (its positives), then, once the
positives of all blocks are known, to those of other labels that can be in one of the windows that positives set, and
among the best there. Rows that survive all columns have exact scores.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import partitions, stored
from tidegate.llm.topk import _largest, matrix

#: Candidates in a block: at most, and at least where partitions would stay empty; anchors in a chunk.
BLOCK_ROWS, LEAST_ROWS, CHUNK_ANCHORS = 32768, 2048, 8192
#: Columns read between looks at the bounds: few at first, when most candidates go.
STEPS = (4, 4, 8, 16)


class Columns:
    """A block of candidates, one contiguous array for each dimension, rows in the order of their ids."""

    def __init__(self, ids: np.ndarray, names: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.names, self.labels = ids[order], names[order], labels[order]
        self.columns = np.ascontiguousarray(rows[order].T)
        self.low, self.high = self.columns.min(axis=1, initial=None), self.columns.max(axis=1, initial=None)
        self.read = 0

    def scan(self, anchor: np.ndarray, alive: np.ndarray, possible: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of what is left of the bitmap `alive`.

        `possible` says, by lower and upper bounds of the scores, which candidates can still be of use.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.low, anchor * self.high])[:, order]
        rest = [np.append(np.cumsum(x[::-1])[::-1], 0 * x[:1]) for x in (ends.min(axis=0), ends.max(axis=0))]
        at = np.flatnonzero(alive)
        partial, read, step = np.zeros(len(at), self.columns.dtype), 0, 0
        while len(at) and read < len(order):
            some = order[read : read + STEPS[min(step, len(STEPS) - 1)]]
            partial = partial + anchor[some] @ self.columns[np.ix_(some, at)]
            read, step, self.read = read + len(some), step + 1, self.read + len(some) * len(at)
            keep = possible(partial + rest[0][read], partial + rest[1][read])
            at, partial = at[keep], partial[keep]
        return at, partial

    def best(self, anchor: np.ndarray, alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best of `alive`, ties to smaller ids."""
        return _first(*self.scan(anchor, alive, lambda low, high: high >= _kth(low, k)), k)

    def within(self, anchor: np.ndarray, alive: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (least, most) rows and scores of the k best of `alive` whose score lies in it."""

        def possible(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            keep = np.zeros(len(low), bool)
            for least, most in windows:
                sure = low[(low >= least) & (high <= most)]
                keep |= (low <= most) & (high >= (max(least, _kth(sure, k)) if len(sure) >= k else least))
            return keep

        at, scores = self.scan(anchor, alive, possible)
        inside = [(scores >= least) & (scores <= most) for least, most in windows]
        return [_first(at[i], scores[i], k) for i in inside]


def _kth(values: np.ndarray, k: int):
    """The kth largest value; with fewer, the smallest."""
    if len(values) <= k:
        return values.min() if len(values) else 0
    return np.partition(values, len(values) - k)[len(values) - k]


def _first(at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((at, -scores))[:k]
    return at[order], scores[order]


def labelled_vectors(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, scale: float) -> DataFrame:
    """(vec_id, label, v) with v = floor(scale * x).

    Rows whose id, label or vector is null, or whose vector holds a null or a value that is not finite, take no part.
    """
    x = F.col(vector_column)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long"))
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), whole.alias("v"))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, block_rows: int = BLOCK_ROWS, chunk_anchors: int = CHUNK_ANCHORS) -> DataFrame:
    """For each anchor of `rows` (vec_id, label, v) and each of its positives, the first negatives.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Scores are exact integer inner
    products, shorter vectors counting as padded with zeros. Positives are the `positives` best other rows of the
    anchor's label; negatives are the `negatives` best rows of other labels with
    least * positive_score <= 100 * negative_score <= most * positive_score, so a negative positive_score has none.
    Ties go to the smaller vec_id. Rows that share a vec_id are rows of their own: each is a candidate of the others,
    and each asks for itself. A label that all rows share has no negatives, one that a single row has no positives; an
    empty table or no anchor gives no rows, vectors without dimensions score zero, and columns beside vec_id, label and
    v are ignored. A group holds one block and one chunk, whatever the table's size or the commonest label or vector;
    a candidate is copied once for each chunk, so (anchors / chunk_anchors) times, in both passes.
    """
    spark = rows.sparkSession
    # rows are named once, in a table: a scan that is read again may be packed otherwise
    named = stored(rows.select("vec_id", "label", "v", F.monotonically_increasing_id().alias("row"), is_anchor.alias("asks")), "labelled")
    total, asked, width = named.select(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(-(-total // block_rows), min(-(-total // LEAST_ROWS), partitions(spark))) or 1
    chunks = -(-asked // chunk_anchors) or 1
    at = F.xxhash64("row")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = named.select("vec_id", "label", "v", "row", F.pmod(at, F.lit(blocks)).cast("int").alias("block"), spread(chunks).alias("chunk"))
    anchors = named.where("asks").select("vec_id", "label", "v", "row", F.pmod(at, F.lit(chunks)).cast("int").alias("chunk"))

    def block_of(mine: pa.Table, theirs: pa.Table) -> tuple[Columns, np.ndarray]:
        c, a = matrix(mine["v"], width), matrix(theirs["v"], width)
        kind = np.float64 if _largest(c) * _largest(a) * max(1, width) < 2**52 else object
        return Columns(*(mine[n].to_numpy() for n in ("vec_id", "row", "label")), c.astype(kind)), a.astype(kind)

    def near(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(mine) and len(theirs):
            block, a = block_of(mine, theirs)
            for row, name, label, anchor in zip(theirs["row"].to_pylist(), theirs["vec_id"].to_pylist(), theirs["label"].to_pylist(), a, strict=True):
                found, scores = block.best(anchor, (block.labels == label) & (block.names != row), positives)
                for column, values in zip(out, ([row] * len(found), [name] * len(found), block.ids[found].tolist(), map(int, scores)), strict=True):
                    column.extend(values)
        return pa.table([pa.array(c, pa.int64()) for c in out], ["row", "anchor_id", "positive_id", "positive_score"])

    def far(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(mine) and len(theirs):
            block, a = block_of(mine, theirs)
            for row, label, scores, anchor in zip(theirs["row"].to_pylist(), theirs["label"].to_pylist(), theirs["scores"].to_pylist(), a, strict=True):
                windows = [(-(-least * s // 100), most * s // 100) for s in scores]
                for place, (found, got) in enumerate(block.within(anchor, block.labels != label, windows, negatives)):
                    for column, values in zip(out, ([row] * len(found), [place] * len(found), block.ids[found].tolist(), map(int, got)), strict=True):
                        column.extend(values)
        return pa.table([pa.array(c, pa.int64()) for c in out], ["row", "place", "negative_id", "negative_score"])

    def asked_of(frame: DataFrame, task: Callable, schema: str) -> DataFrame:
        everywhere = frame.select(*(F.col(c).alias(c) for c in frame.columns), spread(blocks).alias("block"))  # columns apart from the candidates'
        return candidates.groupBy("block", "chunk").cogroup(everywhere.groupBy("block", "chunk")).applyInArrow(task, schema)

    found = asked_of(anchors, near, "row long, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    best = found.withColumn("place", (F.row_number().over(order) - 1).cast("long")).where(F.col("place") < positives)
    best = stored(best, "positives")
    # at most `positives` entries for each anchor
    windows = best.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("scores"))
    found = asked_of(anchors.join(windows, "row"), far, "row long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.join(best, ["row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
