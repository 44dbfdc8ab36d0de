"""SimHash near-duplicates: fingerprints of word shingles, and exact pairs of them by vantage-point trees.

1. Each text gives one fingerprint; equal ones are one point from then on, so copies cost nothing.
2. A tree fitted on a bounded sample of the points deals them into shards: each point to its home, and to the shards
   beyond a boundary that lies within the radius of it (see `vantage`).
3. Shards are cut into blocks of bounded size; homes of a block meet each other and the visitors, and a group goes on
   splitting by vantage points of its own until few comparisons are left.
4. The links join points to components, and components take the smallest id of their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import partitions, stored
from tidegate.llm.components import components
from tidegate.llm.vantage import Shard, Tree

#: Points of a shard that a tree aims at, at least where partitions would stay empty; points of a block.
SHARD_POINTS, LEAST_POINTS, BLOCK_POINTS = 1 << 20, 2048, 1 << 20
#: The sample that a tree is fitted on: points for each shard, and most of them.
SAMPLE_OF_SHARD, MOST_SAMPLE = 64, 1 << 20
#: The seed of the shingles' XXH64, and how many of them are counted at once.
SEED, COUNTED = 42, 1 << 16


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Bits that are set in over half of the hashes of a text's shingles, repeats included; no words: zero."""
    found = text.lower().split() if text else []
    if not found:
        return 0
    words = min(words, len(found))
    joined, sizes = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), COUNTED):
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[k : k + COUNTED], ends[k : k + COUNTED], strict=True)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, point) of every row; point is the fingerprint as a signed number."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch["text"].cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "point"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(marks, "doc_id long, point long")


def _unsigned(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column, np.int64).view(np.uint64)


def links(points: DataFrame, radius: int, shard_points: int = SHARD_POINTS, block_points: int = BLOCK_POINTS) -> DataFrame:
    """Links (a, b) that connect what distinct points (a column `point`) at most `radius` bits apart connect."""
    total = points.count()
    shards = max(-(-total // shard_points), min(-(-total // LEAST_POINTS), partitions(points.sparkSession)))
    wanted = min(shards * SAMPLE_OF_SHARD, MOST_SAMPLE)
    # at most one point in 32, by its hash
    sample = [r[0] for r in points.where(F.pmod(F.xxhash64("point"), F.lit(max(total, 1))) < wanted).limit(2 * MOST_SAMPLE).collect()] if shards > 1 else []
    tree = Tree.fit(np.sort(np.array(sample, np.int64)).view(np.uint64), shards, radius)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _unsigned(batch["point"])
            who, leaf, home = tree.places(values, radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(home), pa.array(values[who].view(np.int64))], ["shard", "home", "point"])

    dealt = stored(points.select("point").mapInArrow(place, "shard int, home boolean, point long"), "simhash-shards")
    blocks = lambda n: F.ceil(n / block_points).cast("int")
    sizes = dealt.groupBy("shard").agg(blocks(F.count_if("home")).alias("homes"), blocks(F.count_if(~F.col("home"))).alias("visits"))
    spread = dealt.join(F.broadcast(sizes), "shard")  # a row for each shard, of which a fitted tree has at most MOST_SAMPLE
    own = F.pmod(F.xxhash64("point"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("visits"))).cast("int") + F.when(F.col("home"), 0).otherwise(F.col("homes"))
    spread = spread.withColumn("own", own)
    # a home's block meets every block of its shard, a visitor's block those of the homes
    meets = F.sequence(F.lit(0), F.when(F.col("home"), F.col("homes") + F.col("visits")).otherwise(F.col("homes")) - 1)
    groups = spread.where("homes > 0").select("shard", "point", "own", F.explode(meets).alias("other"))
    groups = groups.select("shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("second"), "point")

    def search(key: tuple, table: pa.Table) -> pa.Table:
        values, second = _unsigned(table["point"]), table["second"].to_numpy()
        found = Shard(values[~second], values[second], radius, key[1] == key[2]).find()
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return groups.groupBy("shard", "low", "high").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the component is the smallest id reachable by links.

    Documents link when their fingerprints (64 bits of shingles of `words` words) differ in at most `radius` bits. A
    null or empty text, or one without words, has the fingerprint zero and links like any other; a text with fewer
    words is one shingle; texts of any length give all their shingles. Equal fingerprints always link. Null ids name a
    component only if all of its ids are null; a repeated id is the id of every component that one of its rows is the
    smallest of. Repeated rows each get a row; an empty table gives none; columns beside doc_id and text are ignored,
    whatever their names.
    """
    marks = stored(fingerprints(docs, words), "simhash-marks")
    points = stored(marks.groupBy("point").agg(F.min("doc_id").alias("first")), "simhash-points")
    parts = components(links(points, radius)).withColumnsRenamed({"node": "point", "component": "part"})
    placed = points.join(parts, "point", "left").select("point", "first", F.coalesce("part", "point").alias("part"))
    names = placed.groupBy("part").agg(F.min("first").alias("component_id"))
    # a table of its own, so that a point with many documents can be split in the join
    named = stored(placed.join(names, "part").select("point", "component_id"), "simhash-names")
    return marks.join(named, "point").select("doc_id", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id")
