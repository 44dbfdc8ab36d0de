"""Substring deduplication by super-k-mer partitioning.

A window is so many consecutive words of one document. Its minimiser is the smallest hash of a short run of
words in it; consecutive windows that share a minimiser travel as one packed string to the minimiser's bucket,
so equal windows always meet. A bucket rolls its strings out into windows, sorts them and counts equal ones.
Strings that occur several times in a slab of a map task are sent once, marked as repeated, so a passage
however frequent reaches its bucket once for each slab.

A minimiser that very many different windows share, as inside a common phrase, would fill one bucket. Such hot ones
are found beforehand, and their windows are dealt by their own hash instead, which travels in place of the words.
How windows are dealt never changes what is counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import partitions
from tidegate.llm.hashing import run_hashes, run_minima, slabs, word_hashes

#: Words in the run whose hash is minimised, bytes of text handled at once, and windows in one packed string.
MINIMISER_WORDS, SLAB_BYTES, MOST_WINDOWS = 4, 6_000_000, 256
#: One row in so many is looked at to find hot minimisers: those with more than a quarter of a bucket's fair share of
#: the strings there, and so many at least.
HOT_SAMPLE, HOT_STRINGS = 16, 500
_NO_DOC = -(2**63)
#: What a packed row holds: strings of windows, or hashes of windows.
STRINGS, HASHES = 0, 1


def _blob(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(b"".join(a.tobytes() for a in arrays))


def _runs(at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Where strings begin: at windows whose minimiser is another than the window's before, and every MOST_WINDOWS."""
    new = np.r_[True, (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])]
    since = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return np.flatnonzero(new | (since % MOST_WINDOWS == 0))


def _windows(sizes: np.ndarray, window: int) -> np.ndarray:
    """Where the windows of documents of so many words start, in all words together."""
    first = np.cumsum(sizes) - sizes
    inside = np.zeros(int(sizes.sum()) + 1, np.int64)
    has = sizes >= window
    np.add.at(inside, first[has], 1)
    np.add.at(inside, (first + sizes - window + 1)[has], -1)
    return np.flatnonzero(np.cumsum(inside[:-1]) > 0)


def _minimisers(words: list[bytes], window: int) -> np.ndarray:
    m = min(MINIMISER_WORDS, window)
    return run_minima(run_hashes(word_hashes(words), m, 2), window - m + 1)


def hot_minimisers(rows: DataFrame, window: int, buckets: int) -> np.ndarray:
    """Sorted minimisers that would fill a bucket: fewer than four for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for a, b in slabs(map(len, texts), SLAB_BYTES):
                lists = [t.split() for t in texts[a:b]]
                at = _windows(np.array([len(x) for x in lists], np.int64), window)
                if not len(at):
                    continue
                least = _minimisers([w for x in lists for w in x], window)
                found, n = np.unique(least[at[_runs(at, least)]], return_counts=True)
                often = n > n.sum() // (8 * buckets)
                kept = np.append(found[often].view(np.int64), 0), np.append(n[often], n.sum()), np.append(np.ones(often.sum(), np.int8), 0)
                yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int64()), pa.array(kept[1], pa.int64()), pa.array(kept[2], pa.int8())], ["minimiser", "n", "one"])

    some = rows.where(F.pmod("row_key", F.lit(HOT_SAMPLE)) == 0).select("text").mapInArrow(count, "minimiser long, n long, one byte")
    sums = some.groupBy("one", "minimiser").agg(F.sum("n").alias("n"))
    total = sums.where("one = 0").select(F.col("n").alias("total"))
    hot = sums.where((F.col("one") == 1) & (F.col("n") > HOT_STRINGS)).join(F.broadcast(total), F.col("n") > F.col("total") / (4 * buckets))
    return np.sort(np.array([r[0] for r in hot.select("minimiser").collect()], np.int64).view(np.uint64))


def _hashed(words: list[bytes], at: np.ndarray, window: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
    """(bucket, one window of each kind, whether it repeats, their hashes) and last (-1, all that repeat, ...)."""
    h = word_hashes(words)
    one, two = run_hashes(h, window, 0)[at], run_hashes(h, window, 2)[at]
    bucket = (one % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((two, one, bucket))
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    heads = np.flatnonzero(np.r_[True, ~same])
    sizes = np.diff(np.r_[heads, len(order)])
    twice = np.zeros(len(order), bool)
    twice[order] = np.repeat(sizes > 1, sizes)
    kept = order[heads]
    edges = np.r_[0, np.flatnonzero(np.diff(bucket[kept])) + 1, len(kept)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        k = kept[a:b]
        yield int(bucket[k[0]]), at[k], twice[k], _blob(one[k], two[k])
    yield -1, at[twice], twice[twice], b""


def _pack(texts: list[bytes], keys: np.ndarray, ids: np.ndarray, window: int, buckets: int, hot: np.ndarray) -> Iterator[tuple]:
    """Rows (bucket, count, kind, packed windows, row keys, ids and starts) of one slab; counts below 0: repeats found here."""
    lists = [t.split() for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    words = [w for x in lists for w in x]
    del lists
    if len(words) < window:
        return
    at = _windows(sizes, window)
    if not len(at):
        return
    least = _minimisers(words, window)
    first = np.cumsum(sizes) - sizes

    def places(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The document of each start, and where in it."""
        doc = np.searchsorted(first, start, "right") - 1
        while (empty := sizes[doc] == 0).any():
            doc[empty] -= 1
        return doc, (start - first[doc]).astype(np.int32)

    repeats: list[tuple[np.ndarray, ...]] = []
    if len(hot) and (heated := np.isin(least[at], hot)).any():
        for b, start, twice, packed in _hashed(words, at[heated], window, buckets):
            doc, place = places(start)
            if b >= 0:
                yield b, len(start), HASHES, packed, _blob(keys[doc], ids[doc], place, twice.astype(np.int8))
            elif len(start):
                repeats.append((keys[doc], ids[doc], place, np.full(len(start), window, np.int32)))
        at = at[~heated]
    yield from _strings(words, at, least, keys, ids, window, buckets, places, repeats)
    if repeats:
        marks = [np.concatenate(x) for x in zip(*repeats, strict=True)]
        yield int(keys[0] % buckets), -len(marks[0]), STRINGS, b"", _blob(*marks)


def _strings(words: list[bytes], at: np.ndarray, least: np.ndarray, keys: np.ndarray, ids: np.ndarray, window: int, buckets: int, places: Callable, repeats: list) -> Iterator[tuple]:
    """The rows of windows that travel as strings; what repeats in this slab is added to `repeats`."""
    if not len(at):
        return
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    joined = b" ".join(words)
    heads = _runs(at, least)
    start = at[heads]
    last = at[np.r_[heads[1:], len(at)] - 1] + window - 1
    bucket = (least[start] % np.uint64(buckets)).astype(np.int64)
    low, high = begins[start], ends[last]
    doc, place = places(start)
    covered = (last - start + 1).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    edges = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        runs = order[a:b]
        strings = [joined[i:j] for i, j in zip(low[runs].tolist(), high[runs].tolist(), strict=True)]
        seen: dict[bytes, int] = {}
        twice = np.zeros(len(runs), bool)
        for k, s in enumerate(strings):
            if (before := seen.setdefault(s, k)) != k:
                twice[before] = twice[k] = True
        kept = np.fromiter(seen.values(), np.int64, len(seen))
        if twice.any():
            again = runs[twice]
            repeats.append((keys[doc[again]], ids[doc[again]], place[again], covered[again]))
        runs = runs[kept]
        packed = zstandard.ZstdCompressor(3).compress(b"\n".join(seen))
        yield int(bucket[runs[0]]), len(runs), STRINGS, packed, _blob(keys[doc[runs]], ids[doc[runs]], place[runs], twice[kept].astype(np.int8))


def _unpack(blob: bytes, count: int, kinds: tuple) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, count, at))
        at += count * np.dtype(kind).itemsize
    return out


def super_kmers(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """Packed strings, or hashes of hot windows, of `rows` (row_key, row_id, text) by bucket."""
    hot = hot_minimisers(rows, window, buckets)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in slabs(map(len, texts), SLAB_BYTES):
                for row in _pack(texts[a:b], keys[a:b], ids[a:b], window, buckets, hot):
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "n", "kind", "packed", "meta"])

    return rows.select("row_key", "row_id", "text").mapInArrow(pack, "bucket int, n int, kind int, packed binary, meta binary")


def repeated_stretches(packed: DataFrame, window: int) -> DataFrame:
    """(row_key, row_id, low, high): stretches of words that windows occurring more than once cover."""

    def count(table: pa.Table) -> pa.Table:
        keys, ids, starts, weights, hashes, strings_of, offsets = [], [], [], [], [], [], []
        marks: list[tuple[np.ndarray, ...]] = []
        for n, kind, strings, meta in zip(*(table[c].to_pylist() for c in ("n", "kind", "packed", "meta")), strict=True):
            if n < 0:
                k, i, s, c = _unpack(meta, -n, (np.int64, np.int64, np.int32, np.int32))
                marks.append((k, i, s.astype(np.int64), s.astype(np.int64) + c))
                continue
            k, i, s, t = _unpack(meta, n, (np.int64, np.int64, np.int32, np.int8))
            if kind == HASHES:
                covers, offset = np.ones(n, np.int64), np.zeros(n, np.int64)
                hashes.append(tuple(_unpack(strings, n, (np.uint64, np.uint64))))
            else:
                # only windows are kept of a row's strings, which hold several times as many words
                raw = zstandard.ZstdDecompressor().decompress(strings)
                size = np.array([x.count(b" ") + 1 for x in raw.split(b"\n")], np.int64)
                h, covers = word_hashes(raw.split()), size - window + 1
                del raw
                offset = np.arange(covers.sum()) - np.repeat(np.cumsum(covers) - covers, covers)
                at = np.repeat(np.cumsum(size) - size, covers) + offset
                hashes.append((run_hashes(h, window, 0)[at], run_hashes(h, window, 2)[at]))
            strings_of.append((sum(map(len, keys)) + np.repeat(np.arange(n, dtype=np.int32), covers)).astype(np.int32))
            offsets.append(offset.astype(np.int16))
            keys.append(k)
            ids.append(i)
            starts.append(s.astype(np.int64))
            weights.append(t + 1)
        if keys:
            key, row, start, weight = (np.concatenate(x) for x in (keys, ids, starts, weights))
            one, two = (np.concatenate(x) for x in zip(*hashes, strict=True))
            string, offset = np.concatenate(strings_of), np.concatenate(offsets)
            del hashes, strings_of, offsets
            order = np.argsort(one, kind="stable")
            same = one[order][1:] == one[order][:-1]
            if (two[order][1:][same] != two[order][:-1][same]).any():
                order = np.lexsort((two, one))
                same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
            heads = np.flatnonzero(np.r_[True, ~same])
            total = np.add.reduceat(weight[string[order]].astype(np.int64), heads)
            repeated = np.zeros(len(one), bool)
            repeated[order] = np.repeat(total > 1, np.diff(np.r_[heads, len(one)]))
            # windows of strings marked as repeated are known already; the others' repeated windows join to stretches
            hit = np.flatnonzero(repeated & (weight[string] == 1))
            if len(hit):
                cut = np.r_[True, (np.diff(hit) != 1) | (np.diff(string[hit]) != 0)]
                a, b = hit[cut], hit[np.r_[np.flatnonzero(cut)[1:], len(hit)] - 1]
                of = string[a]
                marks.append((key[of], row[of], start[of] + offset[a], start[of] + offset[b] + window))
        columns = [np.concatenate(x) for x in zip(*marks, strict=True)] if marks else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["row_key", "row_id", "low", "high"])

    return packed.groupBy("bucket").applyInArrow(count, "row_key long, row_id long, low long, high long")


def deduplicate(docs: DataFrame, window: int = 35, with_text: bool = False) -> DataFrame:
    """Remove each word that a window occurring anywhere else, too, covers, judged on the whole input.

    Returns doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by single spaces), and with
    `with_text` the kept text. Null and empty texts have no words; a text of any length is judged whole, and every
    copy of a passage goes, so there are no ties. Rows are told apart by id and text, so rows that share an id keep
    their own results, and equal rows, being copies, lose all windows. An empty table gives no rows; columns beside
    doc_id and text are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce("doc_id", F.lit(_NO_DOC)).alias("row_id"))
    marks = repeated_stretches(super_kmers(rows, window, partitions(docs.sparkSession)), window)
    by_row = marks.groupBy("row_key", "row_id").agg(F.collect_list(F.struct("low", "high")).alias("marks"))
    extra = ", text string" if with_text else ""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split() if text else []
                n = len(words)
                if found:
                    gone = np.zeros(n + 1, np.int64)
                    np.add.at(gone, [m["low"] for m in found], 1)
                    np.add.at(gone, [m["high"] for m in found], -1)
                    words = [w for w, g in zip(words, np.cumsum(gone)[:n].tolist(), strict=True) if not g]
                kept = b" ".join(words)
                out.append((doc_id, n, n - len(words), sha256(kept).hexdigest(), kept.decode())[: 4 + with_text])
            names, kinds = ["doc_id", "n_words", "n_removed", "kept_sha256", "text"], [pa.int64()] * 3 + [pa.string()] * 2
            columns = list(zip(*out, strict=True)) or [[]] * (4 + with_text)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[: 4 + with_text])

    joined = rows.join(by_row, ["row_key", "row_id"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + extra)
