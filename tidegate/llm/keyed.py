"""Counting keys that chunks of documents ask about, without a row for each occurrence.

A chunk is a group of documents. It sends each key it holds once, with its own count, sorted and packed by key
range (a bucket); a bucket adds the counts up and answers every chunk in the order it asked in. So a key,
however frequent, crosses the network once for each chunk and way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import partitions

ASKED = "bucket int, chunk int, n array<int>, keys array<binary>, values array<binary>"
ANSWERED = "chunk int, bucket int, n array<int>, answers array<binary>, totals array<array<long>>"
#: Counts of counts that a bucket reports: how many keys occur 1 to RANKS times.
RANKS = 6


def encode(x: np.ndarray) -> bytes:
    """Compressed bytes, equal bytes of all numbers side by side."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()) if len(x) else b""


def decode(data: bytes, kind: type, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, n).T).view(kind).ravel()


def chunked(docs: DataFrame, *columns: str) -> DataFrame:
    """`columns` of `docs` and the chunk of each row, one for each shuffle partition, by a hash of id and text."""
    n = partitions(docs.sparkSession)
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk"), *columns)


def _joined(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _values(data: bytes, kinds: list[type], n: int) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = int.from_bytes(data[at : at + 4], "little")
        out.append(decode(data[at + 4 : at + 4 + size], kind, n))
        at += 4 + size
    return out


def ask(chunk: int, buckets: int, *sets: tuple[np.ndarray, list[np.ndarray]]) -> pa.Table:
    """A row for each bucket, also where it gets no keys, with every set of (sorted distinct keys, values)."""
    cuts = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)
    edges = [[*np.searchsorted(keys, cuts).tolist(), len(keys)] for keys, _ in sets]
    n, keys_out, values_out = [], [], []
    for b in range(buckets):
        span = [slice(e[b], e[b + 1]) for e in edges]
        n.append([s.stop - s.start for s in span])
        keys_out.append([encode(np.diff(keys[s], prepend=np.uint64(0))) if s.stop > s.start else b"" for (keys, _), s in zip(sets, span, strict=True)])
        values_out.append([_joined([encode(v[s]) for v in values]) for (_, values), s in zip(sets, span, strict=True)])
    return pa.table(
        [pa.array(range(buckets), pa.int32()), pa.array([chunk] * buckets, pa.int32()), pa.array(n, pa.list_(pa.int32())), pa.array(keys_out, pa.list_(pa.binary())), pa.array(values_out, pa.list_(pa.binary()))],
        ["bucket", "chunk", "n", "keys", "values"],
    )


def answer(questions: DataFrame, kinds: list[type], merge: Callable[[np.ndarray, list[np.ndarray]], tuple[list[np.ndarray], list[int]]]) -> DataFrame:
    """Group questions by bucket and answer each row.

    `merge` gets, for one set of keys, the number of each asked key (equal keys have equal numbers) and the
    values; it returns arrays aligned with them, and totals that every answer repeats.
    """

    def reply(table: pa.Table) -> pa.Table:
        chunk, bucket, count = (table[c].to_pylist() for c in ("chunk", "bucket", "n"))
        rows, sets = len(chunk), len(count[0])
        answers: list[list[bytes]] = [[] for _ in range(rows)]
        totals = []
        for k in range(sets):
            n = [c[k] for c in count]
            asked = np.concatenate([np.cumsum(decode(table["keys"][r][k].as_py(), np.uint64, n[r]), dtype=np.uint64) for r in range(rows)])
            given = [np.concatenate(v) for v in zip(*(_values(table["values"][r][k].as_py(), kinds, n[r]) for r in range(rows)), strict=True)]
            number = np.unique(asked, return_inverse=True)[1]
            del asked
            found, total = merge(number, given)
            totals.append(total)
            edges = np.r_[0, np.cumsum(n)].tolist()
            for r in range(rows):
                answers[r].append(_joined([encode(a[edges[r] : edges[r + 1]]) for a in found]))
        kept = pa.array([totals] * rows, pa.list_(pa.list_(pa.int64())))
        return pa.table([table["chunk"], table["bucket"], table["n"], pa.array(answers, pa.list_(pa.binary())), kept], ["chunk", "bucket", "n", "answers", "totals"])

    return questions.groupBy("bucket").applyInArrow(reply, ANSWERED)


def answers_of(table: pa.Table, k: int, types: list[type]) -> tuple[list[np.ndarray], np.ndarray]:
    """A chunk's answers for its set k, in the order of its sorted keys, and the totals over all buckets."""
    order = np.argsort(table["bucket"].to_numpy(), kind="stable").tolist()
    parts = [_values(table["answers"][r][k].as_py(), types, table["n"][r][k].as_py()) for r in order]
    return [np.concatenate(p) for p in zip(*parts, strict=True)], np.array([t[k] for t in table["totals"].to_pylist()], np.int64).sum(0)


def add_counts(number: np.ndarray, given: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
    """Sum of each key's counts, and flags: [count, flags].

    Flag 1: this question is the first of those that count any; flag 2: several questions hold the key.

    Totals: all counts, keys that occur, keys that occur 1, 2, ..., RANKS times.
    """
    counts = given[0].astype(np.int64)
    size = int(number.max()) + 1 if len(number) else 0
    total = np.bincount(number, counts, size).astype(np.int64)
    first = np.zeros(len(number), np.uint8)
    some = np.flatnonzero(counts > 0)
    first[some[np.unique(number[some], return_index=True)[1]]] = 1
    first |= (np.bincount(number, minlength=size)[number] > 1).astype(np.uint8) << 1
    ranks = np.bincount(np.minimum(total, RANKS + 1), minlength=RANKS + 2)
    return [total[number], first], [int(total.sum()), int((total > 0).sum()), *ranks[1 : RANKS + 1].tolist()]
