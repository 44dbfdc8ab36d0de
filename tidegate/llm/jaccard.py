"""Exact similarity join of documents by the Jaccard index of their word n-grams, with signature trees.

1. Each document becomes a set of shingle hashes; equal sets are one class from then on.
2. Document frequencies of all shingles (by `keyed`, without a row for each occurrence) put shingles in one
   order, rarest first. Two sets that are similar enough share a shingle of their prefixes in that order; a
   set whose prefix holds unique shingles only has no partner and leaves.
3. Classes that share a prefix shingle, directly or over others, form a family. A family beyond one block first
   meets a few of its own classes, its pivots, block by block; classes that one pivot links are connected, and
   shingles that only connected classes share are of no more use. What is left forms smaller families.
4. Families are split into blocks of bounded size. The largest connected part of a family is dealt once, a block to
   a group; the classes outside it visit each of these groups, and meet each other by pairs of blocks.
5. A group builds a signature tree over each side: leaves are bitmaps of sets, nodes combine them by OR and
   keep ranges of sizes. Two trees are traversed together; a pair of nodes is dropped when even the largest
   possible overlap is too small, or when all below it is connected already. Sets that remain are compared
   exactly, and the links found join classes to components.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import partitions, stored
from tidegate.llm.components import components
from tidegate.llm.hashing import run_hashes, word_hashes
from tidegate.llm.keyed import ASKED, add_counts, answer, answers_of, ask, chunked

#: Classes and shingles in a block, children of a tree node, and pivots of a family of several blocks.
BLOCK_CLASSES, BLOCK_SHINGLES, FANOUT, PIVOTS = 512, 500_000, 8, 8
#: A class is 120 bits of its set's digest.
CLASS = pa.decimal128(38, 0)
#: Bits of a signature: the smallest power of two above four times the mean set, within these.
LEAST_BITS, MOST_BITS = 1024, 16384


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams; a shorter text is one n-gram, one without words none."""
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    return np.unique(run_hashes(word_hashes(found), min(words, len(found)), 1))


@dataclass(frozen=True)
class Threshold:
    """Similar: intersection / union >= part / whole."""

    part: int
    whole: int

    def similar(self, overlap: int, a: int, b: int) -> bool:
        return overlap * self.whole >= self.part * (a + b - overlap)

    def least_overlap(self, sizes: np.ndarray) -> np.ndarray:
        """What two sets of this size together must share at least."""
        return -(-self.part * sizes // (self.whole + self.part))

    def prefix(self, size: int) -> int:
        """A similar set shares one of so many shingles that come first in a common order."""
        return size + self.part * size // -self.whole + 1


class Forest:
    """Union-find over a group's sets."""

    def __init__(self, n: int, labels: Sequence | None = None) -> None:
        """Sets of equal labels are connected from the start."""
        first: dict = {}
        self.parent = list(range(n)) if labels is None else [first.setdefault(x, k) for k, x in enumerate(labels)]
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], np.int64)


class SignatureTree:
    """Levels from the sets' bitmaps up; each node has OR-combined bits, the range of sizes and the largest surplus.

    A set's surplus is its size less its set bits, by which equal bits can hide shingles of an overlap.
    """

    def __init__(self, members: np.ndarray, sets: list[np.ndarray], bits: int) -> None:
        marks = np.zeros((len(members), bits), bool)
        for i, m in enumerate(members):
            marks[i, (sets[m] & np.uint64(bits - 1)).astype(np.int64)] = True
        size = np.array([len(sets[m]) for m in members], np.int64)
        order = np.lexsort((np.argmax(marks, axis=1), size))
        self.members = members[order]
        bitmap = np.packbits(marks[order], axis=1).view(np.uint64)
        size = size[order]
        self.levels = [(bitmap, size, size, size - np.bitwise_count(bitmap).sum(1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            bitmap, low, high, surplus = self.levels[-1]
            cut = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bitmap, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(surplus, cut)))

    def labels(self, of: np.ndarray) -> list[np.ndarray]:
        """Each node's component where all below it are in one, else -1."""
        out = [of[self.members]]
        for level in self.levels[1:]:
            below, cut = out[-1], np.arange(0, len(out[-1]), FANOUT)
            low, high = np.minimum.reduceat(below, cut), np.maximum.reduceat(below, cut)
            out.append(np.where(low == high, low, -1)[: len(level[0])])
        return out


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, t: Threshold) -> np.ndarray:
    """Whether nodes i of level a and j of level b can hold a similar pair."""
    shared = np.bitwise_count(a[0][i] & b[0][j]).sum(1, dtype=np.int64)
    most = np.minimum(shared + np.minimum(a[3][i], b[3][j]), np.minimum(a[2][i], b[2][j]))
    sizes_fit = (a[2][i] * t.whole >= b[1][j] * t.part) & (b[2][j] * t.whole >= a[1][i] * t.part)
    return sizes_fit & (most >= t.least_overlap(a[1][i] + b[1][j]))


def traverse(one: SignatureTree, two: SignatureTree, sets: list[np.ndarray], forest: Forest, t: Threshold, step: int = 16384) -> None:
    """Link all similar pairs of the two trees' sets, as far as they are not connected already."""
    same = one is two
    top = (len(one.levels) - 1, len(two.levels) - 1)
    stack = [(*top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    labels_at, labels = -1, ([], [])
    while stack:
        la, lb, i, j = stack.pop()
        if len(i) > step:
            stack += [(la, lb, i[k : k + step], j[k : k + step]) for k in range(0, len(i), step)]
            continue
        if labels_at != len(forest.links):
            of = forest.labels()
            labels_at, labels = len(forest.links), (one.labels(of), two.labels(of))
        x, y = labels[0][la][i], labels[1][lb][j]
        keep = (x != y) | (x < 0)
        keep[keep] = _possible(one.levels[la], two.levels[lb], i[keep], j[keep], t)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if la == lb == 0:
            for a, b in zip(one.members[i].tolist(), two.members[j].tolist(), strict=True):
                if a != b and forest.find(a) != forest.find(b):
                    p, q = sets[a], sets[b]
                    if t.similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q)):
                        forest.join(a, b)
            continue
        for side, level in ((0, la), (1, lb)):
            if level and level >= (lb if side == 0 else la):
                nodes, other = (i, j) if side == 0 else (j, i)
                below = len((one if side == 0 else two).levels[level - 1][0])
                children = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                other = np.repeat(other, FANOUT)[children < below]
                children = children[children < below]
                i, j = (children, other) if side == 0 else (other, children)
                if side == 0:
                    la -= 1
                else:
                    lb -= 1
        if same and la == lb:
            i, j = i[i <= j], j[i <= j]
        stack.append((la, lb, i, j))


def links_within(first: np.ndarray, second: np.ndarray | None, sets: list[np.ndarray], t: Threshold, labels: Sequence | None = None) -> list[tuple[int, int]]:
    """Links that connect what similar pairs connect, inside one block or between two; equal labels are connected."""
    forest = Forest(len(sets), labels)
    members = first if second is None else np.concatenate([first, second])
    mean = sum(len(sets[m]) for m in members) // max(len(members), 1)
    bits = min(max(LEAST_BITS, 1 << (4 * mean).bit_length()), MOST_BITS)
    one = SignatureTree(first, sets, bits)
    two = one if second is None else SignatureTree(second, sets, bits)
    trees = [one] if two is one else [one, two]
    # a set near to many others joins them before the trees are walked
    for pivot in members[:8].tolist():
        if forest.find(pivot) == pivot:
            own = next(tree for tree in trees if pivot in tree.members)
            at = np.flatnonzero(own.members == pivot)
            for tree in trees:
                every = np.arange(len(tree.members))
                for m in tree.members[_possible(own.levels[0], tree.levels[0], np.repeat(at, len(every)), every, t)].tolist():
                    if forest.find(m) != forest.find(pivot) and t.similar(len(np.intersect1d(sets[m], sets[pivot], assume_unique=True)), len(sets[m]), len(sets[pivot])):
                        forest.join(pivot, m)
    traverse(one, two, sets, forest, t)
    return forest.links


def _document_sets(table: pa.Table, words: int) -> tuple[list[np.ndarray], list[bytes | None], dict[bytes, int]]:
    """Each document's set size holder, its fingerprint, and the first document of each distinct set."""
    sets, marks, first = [], [], {}
    for k, text in enumerate(table["text"].cast(pa.binary()).to_pylist()):
        s = shingles(text, words)
        mark = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
        if mark is not None and first.setdefault(mark, k) != k:
            s = s[:0]  # a copy: its set is held once
        sets.append(s)
        marks.append(mark)
    return sets, marks, first


def id_kind(docs: DataFrame) -> str:
    """Ids are long; decimal ones, which can name more rows than 64 bits tell apart, stay as they are."""
    kind = dict(docs.dtypes)["doc_id"]
    return kind if kind.startswith("decimal") else "long"


def document_sets(docs: DataFrame, words: int, t: Threshold) -> DataFrame:
    """(doc_id, n_shingles, class, prefix, members) of every row; prefix and members where a partner is possible.

    `class` tells distinct sets apart and is null for empty ones; one row of a chunk carries a class's arrays.
    """
    kind = id_kind(docs)
    rows = chunked(docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", "text")
    buckets = partitions(docs.sparkSession)

    def frequencies(key: tuple, table: pa.Table) -> pa.Table:
        sets, _, _ = _document_sets(table, words)
        keys, counts = np.unique(np.concatenate(sets), return_counts=True)
        return ask(key[0].as_py(), buckets, (keys, [counts.astype(np.int32)]))

    def prefixes(table: pa.Table, answers: pa.Table) -> pa.Table:
        sets, marks, first = _document_sets(table, words)
        (frequency, _), _ = answers_of(answers, 0, [np.int64, np.uint8])
        keys, at = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = {m: len(sets[k]) for m, k in first.items()}
        ends = np.cumsum([len(s) for s in sets])
        prefix, members = [None] * len(sets), [None] * len(sets)
        for k in first.values():
            s = sets[k]
            often = frequency[at[ends[k] - len(s) : ends[k]]]
            shared = np.flatnonzero(often > 1)
            need = t.prefix(len(s)) - (len(s) - len(shared))
            if need > 0 and len(shared):
                prefix[k] = s[shared[np.lexsort((s[shared], often[shared]))[:need]]].view(np.int64)
                members[k] = s.tobytes()
        return pa.table(
            [
                table["doc_id"],
                pa.array([sizes.get(m, 0) for m in marks], pa.int64()),
                pa.array([None if m is None else Decimal(int.from_bytes(m[:15], "little")) for m in marks], CLASS),
                pa.array(prefix, pa.list_(pa.int64())),
                pa.array(members, pa.binary()),
            ],
            ["doc_id", "n_shingles", "class", "prefix", "members"],
        )

    counted = answer(rows.groupBy("chunk").applyInArrow(frequencies, ASKED), [np.int32], add_counts)
    schema = f"doc_id {kind}, n_shingles long, class decimal(38,0), prefix array<long>, members binary"
    return rows.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(prefixes, schema)


def _families(tokens: DataFrame, label: str) -> DataFrame:
    """(class, family) of classes in `tokens` (class, `label`, token) that share a token with one of another label."""
    leaders = tokens.groupBy("token").agg(F.min("class").alias("leader"), F.min(label).alias("low"), F.max(label).alias("high"))
    mixed = leaders.where(F.col("low") != F.col("high")).select("token", "leader")
    star = tokens.join(mixed, "token").select(F.col("leader").alias("a"), F.col("class").alias("b")).distinct()
    return components(star).withColumnsRenamed({"node": "class", "component": "family"})


def _blocks(placed: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`placed` (class, size, *keys) with `name`, the number of blocks that the rows of equal keys take."""
    sizes = placed.groupBy(*keys).agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias(name))
    return placed.join(sizes, keys)


def _own(blocks: str) -> Column:
    return F.pmod(F.xxhash64("class"), F.col(blocks)).cast("int")


def _every(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def _links(dealt: DataFrame, candidates: DataFrame, t: Threshold) -> DataFrame:
    """Links (a, b) inside each group of `dealt` (class, label, family, low, high, side).

    Where low equals high a group is compared with itself, else its sides 0 and 1 with each other. The sets join
    last, by class, so a family is dealt by all keys of its groups, whatever its size.
    """

    def link(key: tuple, table: pa.Table) -> pa.Table:
        classes = table["class"].to_pylist()
        sets_of = [np.frombuffer(m, np.uint64) for m in table["members"].to_pylist()]
        side, labels = table["side"].to_numpy(), table["label"].to_pylist()
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if key[1] == key[2]:
            found = links_within(first, None, sets_of, t, labels)
        else:
            found = links_within(first, second, sets_of, t, labels) if len(first) and len(second) else []
        return pa.table([pa.array([classes[x[k]] for x in found], CLASS) for k in (0, 1)], ["a", "b"])

    groups = candidates.select("class", "members").join(dealt, "class")
    return groups.groupBy("family", "low", "high").applyInArrow(link, "a decimal(38,0), b decimal(38,0)")


def _met_pivots(placed: DataFrame, candidates: DataFrame, t: Threshold) -> DataFrame:
    """Links (a, b) of the classes in `placed` (class, label, size, family, blocks) with pivots of their family."""
    order = Window.partitionBy("family").orderBy(F.xxhash64("class"), "class")
    pivots = placed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS)
    none = F.lit(-1)
    visits = pivots.select("class", "label", "family", _every("blocks").alias("low"), none.alias("high"), F.lit(1).alias("side"))
    rest = placed.join(pivots.select("class"), "class", "left_anti").select("class", "label", "family", _own("blocks").alias("low"), none.alias("high"), F.lit(0).alias("side"))
    return stored(_links(rest.unionAll(visits), candidates, t), "pivot-links")


def class_links(sets: DataFrame, t: Threshold) -> DataFrame:
    """Links (a, b) between classes that connect what similar classes connect."""
    candidates = sets.where(F.col("members").isNotNull()).groupBy("class").agg(F.first("prefix").alias("prefix"), F.first("members").alias("members"))
    candidates = stored(candidates.withColumn("size", (F.length("members") / 8).cast("long")), "candidates")
    tokens = candidates.select("class", F.explode("prefix").alias("token"))
    placed = stored(_blocks(candidates.select("class", "size").join(_families(tokens, "class"), "class"), ["family"], "blocks").withColumn("label", F.col("class")), "families")
    small, large = placed.where("blocks = 1"), placed.where("blocks > 1")
    alone = small.select("class", "label", "family", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("side"))
    found = _links(alone, candidates, t)
    if large.isEmpty():
        return found
    met = _met_pivots(large, candidates, t)
    labels = components(met).withColumnsRenamed({"node": "class", "component": "label"})
    labelled = stored(large.select("class", "size").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class")), "labels")
    again = _families(tokens.join(labelled, "class"), "label")
    parts = labelled.join(again, "class")
    # the label that most classes of a family have is dealt once; all others visit it, and each other
    share = parts.groupBy("family", "label").agg(F.count("*").alias("n"))
    main = share.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    parts = parts.join(main, "family").withColumn("outside", F.col("label") != F.col("main")).drop("main")
    parts = stored(_blocks(parts, ["family", "outside"], "blocks"), "parts")
    inside, outside = parts.where("not outside"), parts.where("outside")
    of_main = inside.select("family", F.col("blocks").alias("main_blocks")).distinct()
    none = F.lit(-1)
    one = inside.select("class", "label", "family", _own("blocks").alias("low"), none.alias("high"), F.lit(0).alias("side"))
    visits = outside.join(of_main, "family").select("class", "label", "family", _every("main_blocks").alias("low"), none.alias("high"), F.lit(1).alias("side"))
    numbered = outside.withColumn("own", _own("blocks")).withColumn("other", _every("blocks"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    between = numbered.select("class", "label", "family", low.alias("low"), high.alias("high"), F.when(F.col("own") == low, 0).otherwise(1).alias("side"))
    return found.unionAll(met).unionAll(_links(one.unionAll(visits).unionAll(between), candidates, t))


def near_duplicates(docs: DataFrame, words: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the component is the smallest id reachable by links.

    Documents link when the Jaccard index of their n-gram sets is at least part / whole. A null or empty text
    has an empty set and links with nothing; its component is its own id. Equal sets always link. A text of any length
    gives its whole set. Null ids never name a component unless all of its ids are null; a repeated id is the id of
    every component that one of its rows is the smallest of. Repeated rows each get a row; an empty table gives none;
    columns beside doc_id and text are ignored, whatever their names.
    """
    t = Threshold(part, whole)
    sets = stored(document_sets(docs, words, t), "sets")
    parts = components(class_links(sets, t)).withColumnsRenamed({"node": "class", "component": "part"})
    narrow = sets.select("doc_id", "n_shingles", "class").join(parts, "class", "left").withColumn("part", F.coalesce("part", "class"))
    # a table of its own, so that a part holding many documents can be split in the join
    names = stored(narrow.groupBy("part").agg(F.min("doc_id").alias("component_id")).where(F.col("part").isNotNull()), "names")
    return narrow.join(names, "part", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
