"""Exact top-k search by inner product with Fagin's threshold algorithm.

Candidates are dealt into blocks and queries into chunks; each pair of a block and a chunk is one group, which
sorts a list for each dimension once and runs the threshold algorithm for its queries: lists are read from the
end that the query's sign favours, rows that come up are scored, and reading stops when the best score that a
row not yet seen can have is below the kth one. Block results are merged by query.

On vectors of many nearly independent dimensions the bound falls slowly, and most rows come up before it stops;
README has the figures.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import partitions, stored

#: Candidates in a block and most queries in a chunk, which is how often a block is sent for so many queries.
BLOCK_ROWS, CHUNK_QUERIES = 32768, 8192
#: Queries of a chunk that search at once: their marks of rows seen are what a group holds beside block and chunk.
SEARCHED = 512
#: How far the lists are read at first, and by which factor further each time.
FIRST_DEPTH, FASTER = 64, 3
#: Queries whose newly seen rows are scored together.
BATCH = 64


class SortedLists:
    """One list for each dimension over a block's rows, kept as the order and the sorted values."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, names: np.ndarray | None = None) -> None:
        """`names` tell rows apart where ids repeat; without them ids do."""
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.names = ids[order], rows[order], (ids if names is None else names)[order]
        self.order = np.ascontiguousarray(np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(self.rows, self.order.T.astype(np.int64), axis=0)

    def bounds(self, queries: np.ndarray, depth: int) -> np.ndarray:
        """For each query, the best score of a row that no list shows in its first `depth` places."""
        n = len(self.rows)
        if depth >= n:
            return np.full(len(queries), -np.inf)
        return np.maximum(queries, 0) @ self.values[n - 1 - depth] + np.minimum(queries, 0) @ self.values[depth]

    def search(self, query_names: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(candidate ids, scores) of each query's k best in this block, ties to smaller ids; its own row is left out.

        Every query reads its lists in steps, and stops once the bound is below its kth score or every row has come
        up. Rows that a step shows to any query of a batch are scored together; a query takes only those that its
        own lists show.
        """
        n = len(self.rows)
        depths = [min(FIRST_DEPTH, n)]
        while depths[-1] < n:
            depths.append(min(depths[-1] * FASTER, n))
        out = [(np.zeros(0, np.int64), np.zeros(0, self.rows.dtype))] * len(queries)
        seen = self.names == query_names[:, None]
        active, read = np.arange(len(queries)), 0
        for depth in depths:
            top, bottom, bounds = self._places(n - depth, n - read), self._places(read, depth), self.bounds(queries, depth)
            going = []
            for some in np.array_split(active, -(-len(active) // BATCH)):
                new = np.stack([self._shown(queries[i], top, bottom) for i in some]) if depth < n else np.ones((len(some), n), bool)
                new &= ~seen[some]  # at the end also rows that only lists of zero weight hold
                seen[some] |= new
                any_new = np.flatnonzero(new.any(0))
                scores, mine = queries[some] @ self.rows[any_new].T, new[:, any_new]
                for i, own, found in zip(some, mine, scores, strict=True):
                    best, kept = out[i]
                    out[i] = best, kept = self._best(np.concatenate([best, any_new[own]]), np.concatenate([kept, found[own]]), k)
                    if not (len(best) >= k and bounds[i] < kept[-1] or seen[i].all()):
                        going.append(i)
            active, read = np.array(going, np.int64), depth
            if not going:
                break
        return [(self.ids[rows], scores) for rows, scores in out]

    def _places(self, start: int, stop: int) -> np.ndarray:
        """For each list, a bit for each row, set for those that stand from `start` to `stop`."""
        marks = np.zeros(self.order.shape, bool)
        np.put_along_axis(marks, self.order[:, start:stop].astype(np.int64), True, 1)
        return np.packbits(marks, axis=1)

    def _shown(self, query: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
        """The rows that the lists show to a query: from the end that the sign of its weight favours."""
        bits = np.bitwise_or.reduce(top[query > 0], axis=0) | np.bitwise_or.reduce(bottom[query < 0], axis=0)
        return np.unpackbits(bits, count=len(self.rows)).view(bool)

    @staticmethod
    def _best(rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best by score, ties to smaller rows, which stand in the order of their ids."""
        if len(rows) > k:
            near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            rows, scores = rows[near], scores[near]
        order = np.lexsort((rows, -scores))[:k]
        return rows[order], scores[order]


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    lists = column.combine_chunks()
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.asarray(lists.value_lengths()))
    sizes = np.diff(np.r_[0, ends])
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
    return out


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x); rows whose id or vector is null or not wholly finite take no part."""
    x = F.col(vector_column)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_column).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long")).alias("v"))


def top_k(rows: DataFrame, is_query: Column, k: int = 20, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """The k best other rows of `rows` (vec_id, v) for each query row: query_id, rank, vec_id, score.

    Scores are exact integer inner products, shorter vectors counting as padded with zeros. Ties go to the smaller
    vec_id; a query's own row is left out, and with fewer rows all are returned. Rows that share a vec_id are rows of
    their own: each is a candidate of the others, and each asks for itself. An empty table or no query gives no rows;
    columns beside vec_id and v are ignored. Groups hold one block and one chunk, whatever the size of the table;
    equal vectors are spread over blocks by row. Chunks are smaller while there are fewer groups than partitions.
    """
    # rows are named once, in a table: a scan that is read again may be packed otherwise
    named = stored(rows.select("vec_id", "v", F.monotonically_increasing_id().alias("row"), is_query.alias("asks")), "vectors")
    total, asked, width = named.select(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = -(-total // block_rows) or 1
    chunks = max(-(-asked // chunk_queries), min(-(-asked // SEARCHED), -(-partitions(rows.sparkSession) // blocks))) or 1
    at = F.xxhash64("row")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = named.where("asks").select("vec_id", "v", "row", F.pmod(at, F.lit(chunks)).cast("int").alias("chunk"), spread(blocks).alias("block"))
    left = named.select("vec_id", "v", "row", F.pmod(at, F.lit(blocks)).cast("int").alias("block"), spread(chunks).alias("chunk"))
    names = ["query_row", "query_id", "vec_id", "score"]

    def search(mine: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(mine) or not len(queries):
            return pa.table([pa.array([], pa.int64())] * 4, names)
        c, q = matrix(mine["v"], width), matrix(queries["v"], width)
        kind = np.float64 if _largest(c) * _largest(q) * max(1, width) < 2**53 else object
        lists, asking, q = SortedLists(mine["vec_id"].to_numpy(), c.astype(kind), mine["row"].to_numpy()), queries["row"].to_numpy(), q.astype(kind)
        found = [f for a in range(0, len(q), SEARCHED) for f in lists.search(asking[a : a + SEARCHED], q[a : a + SEARCHED], k)]
        sizes = [len(f) for f, _ in found]
        return pa.table(
            [
                pa.array(np.repeat(asking, sizes), pa.int64()),
                pa.array(np.repeat(queries["vec_id"].to_numpy(), sizes), pa.int64()),
                pa.array(np.concatenate([f for f, _ in found]), pa.int64()),
                pa.array(np.concatenate([s for _, s in found]).astype(np.int64), pa.int64()),
            ],
            names,
        )

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(search, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
