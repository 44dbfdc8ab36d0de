"""How the tokens of two public tokenizers lie over each other in every text, and how often ids meet in the corpus.

Everything between the tokenizers and Spark is Arrow. A task takes its texts a stretch at a time: token lists are
flattened with their parent indices, byte lengths are summed up segment by segment to the tokens' ends, and an Acero
hash join on (stretch, end) finds where ends of both meet. Sorted and filled backward, the outer join's rows are the
links: each end of either tokenizer closes the one overlap of an A token and a B token. `Table.group_by` counts id
pairs of a stretch; a chunk of texts keeps each pair once, and its links as numbers of these pairs, and Spark adds the
chunks' counts up, finds each B id's highest, and sends every chunk the answers to the pairs it holds.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import stored
from tidegate.llm.encoding import LONG_RUN

#: Characters of a stretch, which Acero joins at once, and of a chunk, which shares one list of pairs.
STRETCH, CHUNK = 1 << 20, 1 << 24
#: Distinct words, and their characters, that a worker remembers before it forgets all of them.
REMEMBERED, REMEMBERED_CHARS = 300_000, 8_000_000

CHUNKS = (
    "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "codes array<long>, times array<long>, links binary"
)
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

#: A space between two characters that are not white space: both tokenizers start a token there, whatever stands around.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class Tokenizers:
    """Both tokenizers, by parts of a text: the stretches between single spaces, each with the space before it.

    The byte-level vocabulary's pattern breaks before such a space. The piece vocabulary is checked to have no piece
    that goes on after a space, so its merges never cross one either; with other vocabularies, texts are one part.
    """

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(byte_path)
        self.slow.encode_special_tokens = True
        with open(byte_path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        by_id = {i: b for b, i in ranks.items()}
        self.a_bytes = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.parted = not any("▁" in n.lstrip("▁") for n in names)
        self.a_lengths, self.b_lengths = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_sizes, self.b_sizes = pa.array(self.a_lengths), pa.array(self.b_lengths)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.inexact: set[int] = set()
        self.a, self.b = (array("i"), array("i", [0])), (array("i"), array("i", [0]))

    def parts(self, text: str) -> list[str]:
        return _BETWEEN.split(text) if self.parted else [text]

    def numbers(self, parts: list[str]) -> list[int]:
        """The numbers of parts, whose ids are remembered under them."""
        found = list(map(self.known.get, parts))
        if None in found:
            new = list(dict.fromkeys(p for p, n in zip(parts, found, strict=True) if n is None))
            if not self._together(new):
                for part in new:
                    self._alone(part)
            found = list(map(self.known.__getitem__, parts))
        return found

    def _alone(self, part: str) -> None:
        whole = " " + part
        a = self.slow.encode(whole, add_special_tokens=False).ids if len(part) >= LONG_RUN else self.fast(whole)
        b = self.pieces.encode(part, num_threads=1)
        for (ids, ends), new in ((self.a, a), (self.b, b)):
            ids.extend(new)
            ends.append(len(ids))
        if not b"".join(map(self.a_bytes.__getitem__, a)) == whole.encode() == b"".join(map(self.b_bytes.__getitem__, b)):
            self.inexact.add(len(self.known))
        self.known[part] = len(self.known)
        self.chars += len(part)

    def _together(self, parts: list[str]) -> bool:
        """Encode parts as one text, if both token lists spell it with an end at each part's; else nothing is done."""
        if not self.parted or len(parts) < 2 or any(len(p) >= LONG_RUN or not p or p[0].isspace() or p[-1].isspace() for p in parts):
            return False
        text = " ".join(parts)
        whole = (" " + text).encode()
        places = np.cumsum([len(p.encode()) + 1 for p in parts])
        found = []
        for ids, table, sizes in ((self.fast(" " + text), self.a_bytes, self.a_lengths), (self.pieces.encode(text, num_threads=1), self.b_bytes, self.b_lengths)):
            ends = np.cumsum(sizes[ids])
            at = np.searchsorted(ends, places)
            if b"".join(map(table.__getitem__, ids)) != whole or not np.array_equal(ends[at], places):
                return False
            found.append((ids, at + 1))
        for (ids, ends), (new, at) in zip((self.a, self.b), found, strict=True):
            ends.extend((at + len(ids)).tolist())
            ids.extend(new)
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        self.chars += len(text)
        return True

    def covers(self, numbers: list[int], text: str) -> bool:
        """Whether the bytes of both token lists are a space and the text."""
        if not self.inexact or self.inexact.isdisjoint(numbers):
            return True
        joined = lambda side, table: b"".join(table[i] for n in numbers for i in side[0][side[1][n] : side[1][n + 1]])
        return joined(self.a, self.a_bytes) == (" " + text).encode() == joined(self.b, self.b_bytes)

    def lists(self) -> tuple[pa.ListArray, pa.ListArray]:
        """The ids of all remembered parts, by number."""
        return tuple(pa.ListArray.from_arrays(*(pa.array(np.array(x, np.int32)) for x in (ends, ids))) for ids, ends in (self.a, self.b))


@lru_cache(maxsize=1)
def tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    """One pair for each worker process."""
    return Tokenizers(byte_path, piece_path)


@lru_cache(maxsize=1)
def _labels(a: int, b: int) -> pa.Array:
    """The texts of ids: an A id followed by a comma or a bar, a B id by a comma or a semicolon."""
    return pa.array([f"{i}{end}" for ids, ends in ((a, ",|"), (b, ",;")) for i in range(ids) for end in ends])


def ends_of(lists: pa.ListArray, unit: pa.Array, sizes: pa.Array, name: str) -> tuple[pa.Table, pa.Array]:
    """(key, `name`): the ids of `lists` with stretch and end of each, and the stretch of each; `unit` is that of each list."""
    ids = lists.flatten()
    of = unit.take(pc.list_parent_indices(lists))
    upto = pc.cumulative_sum(sizes.take(ids))
    # what stretches before a token's own sum up to
    last = pc.not_equal(of.slice(1), of.slice(0, len(of) - 1)) if len(of) else pa.array([], pa.bool_())
    first = np.concatenate([[True], last.to_numpy(zero_copy_only=False)]) if len(of) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    before = np.concatenate([[0], upto.to_numpy()[starts[1:] - 1]]) if len(starts) else np.zeros(0, np.int64)
    base = pa.array(np.repeat(before, np.diff(np.append(starts, len(of)))))
    key = pc.add(pc.shift_left(of, pa.scalar(32, pa.int64())), pc.subtract(upto, base))
    return pa.table([key, ids], ["key", name]), of


def overlaps(a: pa.Table, b: pa.Table) -> pa.Table:
    """(unit, a, b, own_a, own_b) of each link in order; own_a, own_b: whether a token of A, of B ends with the link."""
    both = a.join(b, "key", join_type="full outer", use_threads=False).combine_chunks().sort_by("key")
    x, y = both["a"].combine_chunks(), both["b"].combine_chunks()
    return pa.table(
        [pc.shift_right(both["key"], pa.scalar(32, pa.int64())), pc.fill_null_backward(x), pc.fill_null_backward(y), x.is_valid(), y.is_valid()],
        ["unit", "a", "b", "own_a", "own_b"],
    )


def written_groups(links: pa.Table, units: int, a_ids: int, b_ids: int) -> pa.Array:
    """Each stretch's groups as `a1,a2|b1;`, a semicolon after the last group, too."""
    own_a, own_b, unit = (links[n].to_numpy() for n in ("own_a", "own_b", "unit"))
    closes = own_a & own_b
    group = np.cumsum(closes) - closes
    a, b = links["a"].to_numpy()[own_a].astype(np.int64), links["b"].to_numpy()[own_b].astype(np.int64)
    a_group, b_group = group[own_a], group[own_b]
    groups = int(closes.sum())
    a_upto, b_upto = (np.append(0, np.cumsum(np.bincount(g, minlength=groups))) for g in (a_group, b_group))
    label = np.empty(len(a) + len(b), np.int32)
    label[np.arange(len(a)) + b_upto[a_group]] = 2 * a + closes[own_a]
    label[np.arange(len(b)) + a_upto[b_group + 1]] = 2 * a_ids + 2 * b + closes[own_b]
    tokens = np.bincount(unit[own_a], minlength=units) + np.bincount(unit[own_b], minlength=units)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tokens)).astype(np.int32)), _labels(a_ids, b_ids).take(pa.array(label)))
    return pc.binary_join(lists, "")


class Chunk:
    """Texts that share one list of id pairs; their links are numbers of its entries, written batch by batch."""

    def __init__(self, pair: Tokenizers) -> None:
        self.pair = pair
        self.ids: list[int | None] = []
        self.hashes: list[object | None] = []
        self.counts: list[np.ndarray] = []
        self.codes, self.times = pa.array([], pa.int64()), np.zeros(0, np.int64)
        self.sink = pa.BufferOutputStream()
        self.batches = pa.ipc.new_stream(self.sink, pa.schema([("doc", pa.int32()), ("link", pa.int32())]), options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.chars = self.waiting = 0
        self.units: list[tuple[int, list[int]]] = []

    def add(self, doc_id: int | None, text: str | None) -> None:
        doc = len(self.ids)
        self.ids.append(doc_id)
        self.hashes.append(None)
        if not text:
            return
        self.chars += len(text)
        if len(self.pair.known) > REMEMBERED or self.pair.chars > REMEMBERED_CHARS:
            self.align()  # numbers that wait go first
            self.pair.forget()
        parts = self.pair.parts(text)
        numbers = self.pair.numbers(parts)
        if not self.pair.covers(numbers, text):
            return
        if self.waiting + len(text) + 1 < STRETCH:
            self.waiting += len(text) + 1
            self.units.append((doc, numbers))
            return
        start = at = 0
        for at, part in enumerate(parts, 1):
            self.waiting += len(part) + 1
            if self.waiting >= STRETCH:
                self.units.append((doc, numbers[start:at]))
                self.align()
                start = at
        if start < at:
            self.units.append((doc, numbers[start:]))

    def align(self) -> None:
        """Align the stretches that wait."""
        units, self.units, self.waiting = self.units, [], 0
        if units:
            pair, docs = self.pair, np.array([d for d, _ in units], np.int64)
            numbers = pa.array(np.fromiter(chain.from_iterable(x for _, x in units), np.int32))
            unit = pa.array(np.repeat(np.arange(len(units)), [len(x) for _, x in units]))
            (a, of_a), (b, of_b) = (ends_of(lists.take(numbers), unit, sizes, name) for lists, sizes, name in zip(pair.lists(), (pair.a_sizes, pair.b_sizes), "ab", strict=True))
            links = overlaps(a, b)
            for k, text in enumerate(written_groups(links, len(units), len(pair.a_bytes), len(pair.b_bytes)).to_pylist()):
                if self.hashes[docs[k]] is None:
                    self.hashes[docs[k]] = hashlib.sha256()
                else:
                    self.hashes[docs[k]].update(b";")
                self.hashes[docs[k]].update(text[:-1].encode())
            of = links["unit"].to_numpy()
            closed = of[pc.and_(links["own_a"], links["own_b"]).to_numpy()]
            self.counts.append(np.stack([docs, *(np.bincount(x, minlength=len(units)) for x in (of_a.to_numpy(), of_b.to_numpy(), closed, of))]))
            self._count(pc.bit_wise_or(pc.shift_left(links["a"].cast(pa.int64()), pa.scalar(32, pa.int64())), links["b"].cast(pa.int64())), docs[of])

    def _count(self, codes: pa.ChunkedArray, doc: np.ndarray) -> None:
        found = pa.table([codes], ["code"]).group_by("code", use_threads=False).aggregate([("code", "count")])
        new = found["code"].filter(pc.invert(pc.is_in(found["code"], value_set=self.codes)))
        self.codes = pa.concat_arrays([self.codes, *new.chunks])
        self.times = np.append(self.times, np.zeros(len(new), np.int64))
        self.times[pc.index_in(found["code"], value_set=self.codes).to_numpy()] += found["code_count"].to_numpy()
        link = pc.index_in(codes, value_set=self.codes).combine_chunks()
        self.batches.write_batch(pa.record_batch([pa.array(doc.astype(np.int32)), link], ["doc", "link"]))

    def row(self, name: int) -> pa.RecordBatch:
        self.align()
        self.batches.close()
        sums = np.zeros((4, len(self.ids)), np.int64)
        for doc, *found in self.counts:
            for k in range(4):
                np.add.at(sums[k], doc, found[k])
        listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        hashes = pa.array(["" if h is None else h.hexdigest() for h in self.hashes], pa.string())
        columns = [pa.array([name]), *map(listed, (pa.array(self.ids, pa.int64()), *map(pa.array, sums), hashes, self.codes, pa.array(self.times)))]
        schema = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times", "links"]
        return pa.RecordBatch.from_arrays([*columns, pa.array([self.sink.getvalue().to_pybytes()], pa.binary())], schema)


def chunks(rows: Iterable[tuple[int | None, str | None]], pair: Tokenizers, first: int) -> Iterator[pa.RecordBatch]:
    """A row of CHUNKS for each CHUNK characters of the (doc_id, text) rows; their names count from `first`."""
    open_chunk = None
    for doc_id, text in rows:
        open_chunk = open_chunk or Chunk(pair)
        open_chunk.add(doc_id, text)
        if open_chunk.chars >= CHUNK:
            yield open_chunk.row(first)
            open_chunk, first = None, first + 1
    if open_chunk:
        yield open_chunk.row(first)


def answered(table: pa.Table, answers: pa.Table) -> pa.Table:
    """Rows of ALIGNED for the one chunk in `table`, by the (place, count, best) of its pairs."""
    if not len(table):
        return pa.table([pa.array([], pa.int64())] * 7 + [pa.array([], pa.string())], [c.split()[0] for c in ALIGNED.split(", ")])
    columns = {n: table[n].combine_chunks().flatten() for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    order = pc.sort_indices(answers["place"])
    count, best = (answers[n].take(order).combine_chunks() for n in ("count", "best"))
    sums = np.zeros((2, len(columns["doc_id"])), np.int64)
    for batch in pa.ipc.open_stream(table["links"][0].as_buffer()):
        met = pa.table([batch["doc"], count.take(batch["link"]), best.take(batch["link"]).cast(pa.int64())], ["doc", "count", "best"])
        found = met.group_by("doc", use_threads=False).aggregate([("best", "sum"), ("count", "sum")])
        for k, name in enumerate(("best_sum", "count_sum")):
            sums[k][found["doc"].to_numpy()] += found[name].to_numpy()
    columns |= {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
    return pa.table({n: columns[n] for n in (c.split()[0] for c in ALIGNED.split(", "))})


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """ALIGNED of every row: tokens of both vocabularies, groups between common ends, links of overlapping tokens.

    `byte_path` is a byte-level vocabulary (A), which gets a space and the text, `piece_path` a piece vocabulary (B),
    which adds the space itself. n_best counts links whose id pair is the commonest of its B id in the corpus, ties
    included, and count_sum adds up the corpus counts of the row's links. A null or empty text, or one whose tokens do
    not spell it, has no tokens: zeros and an empty groups_sha256. Texts of any length are taken whole, in stretches cut
    where both vocabularies have an end. Repeated rows each get a row and each count; null ids are kept; an empty
    table gives none; columns beside doc_id and text are ignored, whatever their names.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True))
        yield from chunks(rows, tokenizers(byte_path, piece_path), TaskContext.get().partitionId() << 32)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    aligned = stored(texts.mapInArrow(tasks, CHUNKS), "aligned")
    pairs = aligned.select("chunk", F.posexplode(F.arrays_zip("codes", "times")).alias("place", "pair")).select("chunk", "place", "pair.codes", "pair.times")
    totals = pairs.groupBy("codes").agg(F.sum("times").alias("count")).withColumn("b", F.col("codes").bitwiseAND(F.lit((1 << 32) - 1)))
    totals = stored(totals, "pair-counts")
    highest = totals.groupBy("b").agg(F.max("count").alias("highest"))
    counts = totals.join(highest, "b").select("codes", "count", (F.col("count") == F.col("highest")).alias("best"))
    answers = pairs.join(counts, "codes").select(F.col("chunk").alias("of"), "place", "count", "best")
    return aligned.drop("codes", "times").groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(answered, ALIGNED)
