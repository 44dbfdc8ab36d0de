"""Fingerprints and their links against plain versions: every pair of fingerprints compared."""

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidegate.llm import queries, simhash
from tidegate.llm.vantage import Shard, Tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks, radius=2):
    """Smallest name reachable for each of `marks`, a list of (name, fingerprint)."""
    parent = {p: p for _, p in marks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = list(parent)
    array = np.array(values, np.uint64)
    for x in values:
        for y in np.flatnonzero(np.bitwise_count(array ^ np.uint64(x)) <= radius):
            parent[find(values[y])] = find(x)
    least = defaultdict(list)
    for name, p in marks:
        if name is not None:
            least[find(p)].append(name)
    return [min(least[find(p)], default=None) for _, p in marks]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    marks = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs]
    want = sorted((i, f"{p:016x}", c) for (i, p), c in zip(marks, plain_components(marks)))
    assert sorted(tuple(r) for r in queries.op12_vantage_simhash(spark, sf_dir).collect()) == want
    assert len({c for _, _, c in want}) < len(want)


def clusters(n, centres, steps, seed):
    """Points around centres: each of `steps` flips one bit of four points in five."""
    draw = np.random.default_rng(seed)
    points = draw.integers(0, 2**64, centres, dtype=np.uint64)[draw.integers(0, centres, n)]
    for _ in range(steps):
        points = points ^ (np.uint64(1) << draw.integers(0, 64, n).astype(np.uint64)) * (draw.random(n) < 0.8).astype(np.uint64)
    return np.unique(points)


@pytest.mark.parametrize(("n", "centres", "steps"), [(3000, 30, 3), (5000, 1, 3), (6000, 1500, 2)])
def test_shards_find_all(n, centres, steps):
    points = clusters(n, centres, steps, n)
    want = plain_components([(k, int(p)) for k, p in enumerate(points)])
    at = {int(p): k for k, p in enumerate(points.view(np.int64))}

    def parts(links):
        parent = list(range(len(points)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            x, y = find(at[a]), find(at[b])
            assert x != y or tree  # within one group links never close a circle
            parent[max(x, y)] = min(x, y)
        return [find(k) for k in range(len(points))]

    tree = None
    assert parts(Shard(points, points[:0], 2, True).find()) == want
    tree = Tree.fit(points[::8], 9, 2)
    who, leaf, home = tree.places(points, 2)
    assert tree.leaves > 1 and sorted(who[home]) == list(range(len(points)))
    found = [x for k in range(tree.leaves) for x in Shard(points[who[home & (leaf == k)]], points[who[~home & (leaf == k)]], 2, True).find()]
    assert parts(found) == want


def test_branches_are_pruned():
    points = np.unique(np.random.default_rng(3).integers(0, 2**64, 40_000, dtype=np.uint64))
    shard = Shard(points, points[:0], 2, True)
    assert shard.find() == [] and shard.compared < 0.05 * len(points) ** 2


def test_blocks_of_a_shard(spark):
    """A shard of many blocks: 600 points of one cluster in blocks of 50."""
    points = clusters(2500, 3, 3, 8)[:600]
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "point long")
    found = [tuple(r) for r in simhash.links(frame, 2, shard_points=200, block_points=50).collect()]
    want = plain_components([(k, int(p)) for k, p in enumerate(points)])
    at = {int(p): k for k, p in enumerate(points.view(np.int64))}
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        x, y = find(at[a]), find(at[b])
        parent[max(x, y)] = min(x, y)
    assert [find(k) for k in range(len(points))] == want


def test_edges(spark):
    twelve = "the cat sat on the mat and the dog ran off again"
    texts = [(4, twelve), (2, None), (3, ""), (9, " \n\t "), (None, "null id text"), (5, "word " * 70000), (6, "x" * 30000), (4, twelve), (8, twelve.upper()), (7, "word word word"), (10, "one"), (None, "null id text"), (12, "É è")]
    docs = spark.createDataFrame([(*t, 1, 2, 3) for t in texts], "doc_id long, text string, point long, part long, first long")
    marks = [(i, plain_fingerprint(t)) for i, t in texts]
    want = sorted(((str(i), f"{p:016x}", str(c)) for (i, p), c in zip(marks, plain_components(marks))))
    assert sorted(tuple(map(str, r)) for r in simhash.near_duplicates(docs).collect()) == want
    assert [c for i, _, c in want if i in ("2", "3", "9")] == ["2"] * 3 and [c for i, _, c in want if i in ("4", "8")] == ["4"] * 3
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
