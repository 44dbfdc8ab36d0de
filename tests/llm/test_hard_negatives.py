"""Hard negatives against all scores written out, on tables with ties, repeated rows, clusters and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.llm import hard_negatives


def plain(rows, is_anchor, positives, negatives, least, most):
    """rows: (vec_id, label, v) in any order; a list of result rows."""
    out = []
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, (name, label, v) in enumerate(rows):
        if not is_anchor(name):
            continue
        others = sorted((-product(v, w), other, kind) for k, (other, kind, w) in enumerate(rows) if k != i)
        for score, positive, _ in [x for x in others if x[2] == label][:positives]:
            fit = [x for x in others if x[2] != label and least * -score <= 100 * -x[0] <= most * -score]
            out += [(name, positive, rank, negative, -score, -found) for rank, (found, negative, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, anchor, **options):
    frame = spark.createDataFrame(rows, "vec_id long, label long, v array<long>")
    return sorted(tuple(r) for r in hard_negatives.mine(frame, F.col("vec_id") % anchor == 0, **options).collect())


@pytest.mark.parametrize("spread", [3, 40, 2**28])
def test_equals_all_scores(spark, spread):
    """Small values tie, values of 2**28 do not fit doubles; an id in nine is shared, and a third of all rows are one vector."""
    draw = np.random.default_rng(spread % 97)
    rows = [(int(k - k % 9 // 8), int(draw.integers(0, 3)), [int(x) for x in draw.integers(-spread, spread + 1, 7)]) for k in range(150)]
    rows = [(i, label, rows[0][2] if k % 3 == 0 else v) for k, (i, label, v) in enumerate(rows)]
    found = mined(spark, rows, 10, positives=4, negatives=6, least=20, most=95, block_rows=40, chunk_anchors=6)
    assert found == plain(rows, lambda i: i % 10 == 0, 4, 6, 20, 95) and found


def test_clusters_prune(monkeypatch):
    """On vectors of a few strong dimensions most candidates leave before all columns are read."""
    draw = np.random.default_rng(5)
    rows = np.round(draw.normal(0, 1, (3000, 64)) * 100 / np.arange(1, 65) ** 1.5)
    block = hard_negatives.Columns(np.arange(3000), np.arange(3000), draw.integers(0, 5, 3000), rows)
    found, scores = block.best(rows[7], block.names != 7, 5)
    exact = rows @ rows[7]
    exact[7] = -np.inf
    assert scores.tolist() == sorted(exact.tolist())[::-1][:5] and found.tolist() == np.argsort(-exact, kind="stable")[:5].tolist()
    assert block.read < 0.3 * rows.size


def test_edges(spark):
    rows = [(0, 1, [0.5, -0.5]), (1, 1, None), (2, None, [0.5, 0.5]), (3, 1, [1.0, None]), (4, 1, [0.5, -0.5]), (5, 2, [float("inf"), 0.0]), (6, 2, [0.25, -0.25]), (None, 2, [1.0, 1.0]), (7, 2, []), (8, 2, [0.5])]
    vectors = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, label int, embedding array<double>, row int, block int, asks int")
    usable = hard_negatives.labelled_vectors(vectors, "vec_id", "embedding", "label", 256)
    found = [tuple(r) for r in hard_negatives.mine(usable, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(found) == [(0, 4, 1, 6, 32768, 16384), (0, 4, 2, 8, 32768, 16384)]
    assert hard_negatives.mine(usable.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert hard_negatives.mine(usable, F.col("vec_id") == 99).collect() == []
    # one label only, and a label of one row
    assert hard_negatives.mine(usable.where("label = 1"), F.col("vec_id") % 100 == 0).collect() == []
    assert hard_negatives.mine(usable.where("vec_id <> 4"), F.col("vec_id") % 100 == 0).collect() == []
    # only vectors without dimensions: all scores zero, and zero lies in its own window
    zero = usable.withColumn("v", F.array().cast("array<long>"))
    assert sorted(tuple(r) for r in hard_negatives.mine(zero, F.col("vec_id") == 0).collect()) == [(0, 4, 1, 6, 0, 0), (0, 4, 2, 7, 0, 0), (0, 4, 3, 8, 0, 0)]
