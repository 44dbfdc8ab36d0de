"""Leaf-wise trees against a plain version that grows one leaf at a time on whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.errors import EvaluationError
from tidegate.model import PurgedKFold
from tidegate.operators import boosting, mergeable, splits
from tidegate.plans import weekly


def plain(step, x, y, test, edges):
    """The leaf with the best split is split next, by direct sums over its rows."""
    score, out = np.full(len(y), y.mean()), np.full(len(test), y.mean())

    def best(rows, rest):
        found = (1e-12, None, None)
        for j in range(x.shape[1]):
            for edge in edges[j]:
                left = x[rows, j] <= edge
                n, m = left.sum(), (~left).sum()
                if n >= step.least and m >= step.least:
                    gain = rest[rows][left].sum() ** 2 / n + rest[rows][~left].sum() ** 2 / m - rest[rows].sum() ** 2 / (n + m)
                    if gain > found[0] * (1 + 1e-10):
                        found = (gain, j, edge)
        return found

    for _ in range(step.trees):
        rest = y - score
        leaves = [(np.arange(len(y)), np.arange(len(test)), 0)]
        splits_of = [best(leaves[0][0], rest)]
        while len(leaves) < step.leaves:
            can = [k for k, s in enumerate(splits_of) if s[1] is not None and leaves[k][2] < step.depth]
            if not can:
                break
            k = max(can, key=lambda k: splits_of[k][0])
            rows, held, level = leaves.pop(k)
            _, j, edge = splits_of.pop(k)
            for side in (x[rows, j] <= edge, x[rows, j] > edge):
                part = rows[side]
                leaves.append((part, held[(test[held, j] <= edge) == (x[part[0], j] <= edge)], level + 1))
                splits_of.append(best(part, rest))
        for rows, held, _ in leaves:
            score[rows] += step.rate * rest[rows].mean()
            out[held] += step.rate * rest[rows].mean()
    return out


def train(step, x, y, tasks):
    known = None
    for turn in range(step.rounds(x.shape[1])):
        state = None
        for k in range(tasks):
            part = step.partial(known, x[k::tasks], y[k::tasks], turn)
            state = part if state is None else step.merge(state, part, turn)
        known = step.advance(known, state, x.shape[1], turn)
    return known


@pytest.mark.parametrize(("leaves", "depth"), [(7, 3), (4, 4), (2, 1)])
def test_equals_growing_one_leaf_at_a_time(leaves, depth):
    draw = np.random.default_rng(leaves)
    x = np.column_stack([draw.normal(0, 1, 700), draw.integers(0, 4, 700), np.full(700, 3.0), draw.exponential(1, 700)])
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + 0.5 * (x[:, 1] == 2) * x[:, 3] + draw.normal(0, 0.1, 700)
    step = boosting.LeafwiseTrees(trees=6, leaves=leaves, depth=depth, rate=0.3, bins=16, least=15)
    known = train(step, x, y, 5)
    assert (known.feature != 2).all() and max(len(e) for e in known.edges) <= 15
    test = x + draw.normal(0, 0.05, x.shape)
    assert np.allclose(step.predict(known, test), plain(step, x, y, test, known.edges), rtol=1e-9)
    assert ((known.feature >= 0).sum(axis=1) <= leaves - 1).all()
    assert np.mean((step.predict(known, x) - y) ** 2) < 0.7 * y.var()


def test_folds_on_spark(spark, sf_dir):
    data, axis = weekly.modelled(spark, sf_dir)
    data = data.withColumn("square", F.col("ret") * F.col("ret")).cache()
    decided = splits.plan(data, axis, PurgedKFold(2, embargo=2)).cache()
    assigned = splits.assignments(data, decided).cache()
    step = boosting.LeafwiseTrees(trees=3, rate=0.5, bins=8)
    rows = mergeable.fit_predict(data, decided, assigned, ["ret", "square"], (mergeable.Standardise(), step)).orderBy("fold", "asset", "session").collect()
    for fold in range(2):
        take = lambda role: np.array([[r["ret"], r["square"], r["target"]] for r in assigned.where(f"fold = {fold} and role = '{role}'").orderBy("asset", "session").collect()])
        rows_in, rows_out = take("train"), take("test")
        mean, scale = rows_in[:, :2].mean(axis=0), rows_in[:, :2].std(axis=0)
        known = train(step, (rows_in[:, :2] - mean) / scale, rows_in[:, 2], 1)
        assert np.allclose([r["prediction"] for r in rows if r["fold"] == fold], step.predict(known, (rows_out[:, :2] - mean) / scale), rtol=1e-7, atol=1e-9)


def test_refusals():
    with pytest.raises(EvaluationError, match="positive"):
        boosting.LeafwiseTrees(leaves=1)
    with pytest.raises(EvaluationError, match="finite"):
        train(boosting.LeafwiseTrees(trees=1), np.array([[1.0], [np.nan]]), np.zeros(2), 1)
    flat = train(boosting.LeafwiseTrees(trees=2), np.ones((50, 2)), np.arange(50.0), 2)
    assert boosting.LeafwiseTrees(trees=2).predict(flat, np.ones((1, 2))).tolist() == [24.5]


def test_families_over_channels(spark, sf_dir):
    """Each family in each channel; the line's errors are those of the aggregate ridge, safe channels have no overlap."""
    from tidegate.plans.benchmarks import channel_benchmark, channel_folds, family_benchmark

    data, axis = weekly.modelled(spark, sf_dir)
    folds = channel_folds(data, axis, PurgedKFold(3, embargo=2), None, weekly.WALK, embargo=2)
    found = {(r["channel"], r["model"]): r for r in family_benchmark(data, folds, ["ret"], {"line": mergeable.RidgeSums(1.0), "trees": boosting.LeafwiseTrees(trees=1)}).collect()}
    assert len(found) == 2 * len(folds)
    for r in channel_benchmark(data, folds, ["ret"]).collect():
        line = found[r["channel"], "line"]
        assert abs(line["mse"] - r["mse"]) < 1e-12 and all(line[c] == r[c] == found[r["channel"], "trees"][c] for c in ("n", "overlap", "purged", "embargoed", "retained_min"))


def test_lags_skip_gaps(spark):
    rows = [("a", k, float(k)) for k in (1, 2, 3, 5, 6, 7)] + [("b", k, 10.0 * k) for k in (2, 3)]
    data, names = weekly.lagged(spark.createDataFrame(rows, "asset string, axis_pos long, ret double"), 3)
    assert names == ["lag2", "lag1", "lag0"] and sorted(tuple(r[n] for n in ("asset", *names)) for r in data.collect()) == [("a", 1.0, 2.0, 3.0), ("a", 5.0, 6.0, 7.0)]
