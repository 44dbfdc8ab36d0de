"""Best-fit packing of encoded documents into fixed-size sequences.

Each task packs the pieces of its partition with bounded-space online best fit: a fixed number of open
bins, found through a bitset keyed by free space; when all are open the fullest one closes first. Pieces come
in the order of a hash, and each run of them, twice as many as open bins, is placed longest first. A task's
memory is one run and the open bins, however many pieces it gets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import stored
from tidegate.llm.encoding import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
#: The id that ends a document.
END = 0
#: Open bins of a task, and pieces that a task gets.
OPEN_BINS, TASK_PIECES = 1024, 65_536


class OpenBins:
    """At most `limit` open bins of `capacity`; `place` returns the bin and the offset in it."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.open, self.made, self.closed = 0, 0, 0, 0

    def _take(self, free: int) -> int:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            free, chosen = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(chosen)
            self.bits |= 1 << left
            self.open += 1
        return chosen, self.capacity - free

    def place_run(self, lengths: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
        """The order in which a run is placed, longest first (ties as they came), and (bin, offset) in that order."""
        order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
        return order, [self.place(lengths[k]) for k in order]


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full ones after a first that may be shorter."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity
    starts = ([0] if first else []) + list(range(first, total, capacity))
    return [(s, e - s) for s, e in zip(starts, starts[1:] + [total], strict=True)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """Encode every whole text, add id 0 and cut what is longer than `capacity`. A null text is empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py())
                ids.append(END)
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, PIECES)


def best_fit(parts: DataFrame, capacity: int = 2048, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Give each piece (`doc_id`, `piece`, ..., `length`) a sequence and its place there.

    Pieces are dealt evenly by document and piece, so neither a hot source nor a very long document gathers
    in one task. Repeated rows are packed as often as they occur; an empty table gives an empty result.
    """
    names = parts.columns
    at = names.index("length")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for run in _runs(batches, 2 * open_bins):
            order, placed = bins.place_run(run.column(at).to_pylist())
            columns = [*run.take(pa.array(order, pa.int64())).columns, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    tasks = -(-parts.count() // task_pieces) or 1
    dealt = parts.repartition(tasks, "doc_id", "piece", "ids_crc32")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    mixed = F.xxhash64("doc_id", "piece", "ids_crc32")
    return dealt.sortWithinPartitions(mixed, "doc_id", "piece", "ids_crc32").mapInArrow(pack, schema)


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in batches of `size`; the last one may be shorter."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        while sum(map(len, waiting)) >= size:
            rows = pa.concat_batches(waiting)
            yield rows.slice(0, size)
            waiting = [rows.slice(size)]
    if any(map(len, waiting)):
        yield pa.concat_batches(waiting)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Pack `docs` (doc_id, text), one row per piece, as PACKED.

    A null or empty text is one piece of the end id alone; a text of any length is cut into whole pieces; equal
    lengths go by a hash of document and piece; repeated rows are packed as often as they occur; an empty table gives
    no rows; columns beside doc_id and text are ignored, whatever their names.
    """
    return best_fit(stored(pieces(docs, vocabulary, capacity), "pieces"), capacity, open_bins, task_pieces)
