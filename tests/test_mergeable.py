"""Steps and measures from partial states against the same things computed on whole arrays."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.errors import EvaluationError
from tidegate.model import CombinatorialCV, PurgedKFold, data_digest
from tidegate.operators import evaluate, mergeable, splits
from tidegate.plans import weekly


@pytest.fixture(scope="module")
def world(spark, sf_dir):
    """Samples with three features, decided folds and assignments."""
    data, axis = weekly.modelled(spark, sf_dir)
    data = data.select("*", (F.col("ret") * F.col("ret")).alias("square"), F.lit(2.5).alias("flat")).cache()
    decided = splits.plan(data, axis, PurgedKFold(3, embargo=2)).cache()
    return data, axis, decided, splits.assignments(data, decided).cache()


FEATURES = ["ret", "square", "flat"]


def arrays(assigned, fold, role):
    rows = assigned.where(f"fold = {fold} and role = '{role}'").orderBy("asset", "session").collect()
    return np.array([[r[f] for f in FEATURES] for r in rows]), np.array([r["target"] for r in rows])


def whole(steps, x, y, test):
    """The steps on whole arrays, one after the other, with NumPy's own functions."""
    for step in steps:
        if isinstance(step, mergeable.QuantileClip):
            low, high = (np.quantile(x, q, axis=0, method="inverted_cdf") for q in (step.low, step.high))
            x, test = np.clip(x, low, high), np.clip(test, low, high)
        elif isinstance(step, mergeable.Standardise):
            mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1)
            x, test = (x - mean) / scale, (test - mean) / scale
        elif isinstance(step, mergeable.PrincipalComponents):
            mean = x.mean(axis=0)
            v = np.linalg.svd(x - mean, full_matrices=False)[2][: step.count]
            v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]
            x, test = (x - mean) @ v.T, (test - mean) @ v.T
        else:
            mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1)
            z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
            penalty = step.alpha * np.eye(z.shape[1])
            penalty[0, 0] = 0
            found = np.linalg.solve(z.T @ z + penalty, z.T @ y)
            return np.column_stack([np.ones(len(test)), (test - mean) / scale]) @ found
    return test


@pytest.mark.parametrize(
    "steps",
    [
        (mergeable.RidgeSums(3.0),),
        (mergeable.Standardise(), mergeable.RidgeSums()),
        (mergeable.QuantileClip(0.1, 0.8), mergeable.RidgeSums()),
        (mergeable.QuantileClip(), mergeable.Standardise(), mergeable.PrincipalComponents(2), mergeable.RidgeSums(0.5)),
    ],
)
def test_steps_equal_whole_arrays(world, steps):
    data, _, decided, assigned = world
    rows = mergeable.fit_predict(data, decided, assigned, FEATURES, steps).orderBy("fold", "asset", "session").collect()
    for fold in range(3):
        x, y = arrays(assigned, fold, "train")
        test, target = arrays(assigned, fold, "test")
        mine = [r for r in rows if r["fold"] == fold]
        assert np.allclose([r["target"] for r in mine], target)
        assert np.allclose([r["prediction"] for r in mine], whole(steps, x, y, test), rtol=1e-9, atol=1e-12)


def test_quantiles_are_exact_on_odd_values():
    """Ties, both zeros, denormals, negative and huge values, in any split into tasks."""
    draw = np.random.default_rng(1)
    x = np.concatenate([draw.normal(0, 1, 500), np.repeat([-3.0, 0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308], 30), draw.normal(0, 1e-300, 200)])[:, None]
    for low, high in ((0.0, 1.0), (0.25, 0.5), (0.001, 0.999), (0.333, 0.334)):
        step, known = mergeable.QuantileClip(low, high), None
        for turn in range(step.rounds(1)):
            parts = [step.partial(known, x[k::7], None, turn) for k in range(7)]
            known = step.advance(known, reduce(lambda a, b: step.merge(a, b, turn), parts), 1, turn)
        assert known.ravel().tolist() == np.quantile(x, [low, high], method="inverted_cdf").tolist()


def test_a_fold_learns_from_its_training_rows_only_and_folds_take_turns(world, monkeypatch):
    data, _, decided, assigned = world
    steps = (mergeable.QuantileClip(0.2, 0.7), mergeable.RidgeSums())
    first = mergeable.fit_predict(data, decided, assigned, FEATURES, steps).orderBy("fold", "asset", "session").collect()
    monkeypatch.setattr(mergeable, "AT_ONCE", 1)  # one fold a turn
    spoilt = data.join(decided.where("fold = 1 and role = 'test'").select("axis_pos", F.lit(True).alias("bad")).distinct(), "axis_pos", "left")
    spoilt = spoilt.withColumn("target", F.when(F.col("bad"), F.lit(1e6)).otherwise(F.col("target"))).drop("bad")
    again = mergeable.fit_predict(spoilt, decided, splits.assignments(spoilt, decided), FEATURES, steps).orderBy("fold", "asset", "session").collect()
    same = [abs(a["prediction"] - b["prediction"]) < 1e-9 for a, b in zip(first, again, strict=True) if a["fold"] == 1]
    assert all(same) and any(abs(a["prediction"] - b["prediction"]) > 1 for a, b in zip(first, again, strict=True) if a["fold"] == 0)


def test_refusals(world):
    data, axis, decided, assigned = world
    with pytest.raises(EvaluationError, match="transformers"):
        mergeable.learn(data, decided, FEATURES, (mergeable.RidgeSums(), mergeable.RidgeSums()))
    with pytest.raises(EvaluationError, match="no training rows"):
        mergeable.learn(data, decided.where("not (fold = 1 and role = 'candidate')"), FEATURES, (mergeable.RidgeSums(),))
    with pytest.raises(EvaluationError, match="more components"):
        mergeable.learn(data, decided, FEATURES, (mergeable.PrincipalComponents(4), mergeable.RidgeSums()))
    with pytest.raises(EvaluationError, match="rise"):
        mergeable.QuantileClip(0.6, 0.5)


def test_many_features_are_one_block(spark, world):
    """At 200 features products are one array, not 20,000 columns."""
    data, _, decided, _ = world
    wide = data.select("*", *[(F.sin(F.col("ret") * (3 + k)) + F.cos(F.hash("session", "asset") % (k + 7))).alias(f"w{k}") for k in range(200)])
    names = [f"w{k}" for k in range(200)]
    known = mergeable.learn(wide, decided, names, (mergeable.RidgeSums(5.0),)).known[0]
    rows = splits.assignments(wide, decided).where("fold = 0 and role = 'train'").select("target", *names).collect()
    x, y = np.array([r[1:] for r in rows]), np.array([r[0] for r in rows])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    slope = np.linalg.solve(z.T @ z + 5 * np.eye(200), z.T @ (y - y.mean())) / x.std(axis=0)
    assert np.allclose(known[0][1:], slope, rtol=1e-6, atol=1e-10)


def test_gradient_by_finite_differences():
    step = mergeable.SequenceModel(hidden=3)
    draw = np.random.default_rng(2)
    theta, x, y = draw.normal(0, 0.5, step.weights), draw.normal(0, 1, (7, 5)), draw.normal(0, 1, 7)
    found = step.gradient(theta, x, y)
    assert found[0] == 7
    for k in range(step.weights):
        up, down = theta.copy(), theta.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert abs((step.gradient(up, x, y)[1] - step.gradient(down, x, y)[1]) / 2e-6 - found[2 + k]) < 1e-5


def test_sequence_model_equals_one_process(world):
    """The same mini-batches on whole arrays, with Adam written out, give the same predictions."""
    data, _, decided, assigned = world
    step = mergeable.SequenceModel(hidden=4, epochs=2, batch=200, seed=5)
    rows = mergeable.fit_predict(data, decided, assigned, FEATURES, (step,)).orderBy("fold", "asset", "session").collect()
    sizes = [len(arrays(assigned, f, "train")[1]) for f in range(3)]
    step = step.planned(max(sizes))
    assert step.batches == -(-max(sizes) // 200) > 2
    part = F.pmod(F.xxhash64("asset", "session"), F.lit(step.batches))
    for fold in range(3):
        x, y = arrays(assigned, fold, "train")
        test, _ = arrays(assigned, fold, "test")
        of = np.array([r[0] for r in assigned.where(f"fold = {fold} and role = 'train'").orderBy("asset", "session").select(part).collect()])
        mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1)
        theta = np.random.default_rng(5).uniform(-0.5, 0.5, step.weights)
        m, v, t = np.zeros_like(theta), np.zeros_like(theta), 0
        for _ in range(2):
            for b in range(step.batches):
                _, _, *slope = step.gradient(theta, ((x - mean) / scale)[of == b], y[of == b])
                slope, t = np.array(slope) / (of == b).sum(), t + 1
                m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
                theta = theta - 0.005 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        want = step.forward(theta, (test - mean) / scale)[0]
        assert np.allclose([r["prediction"] for r in rows if r["fold"] == fold], want, rtol=1e-7, atol=1e-10)


def test_sequence_model_learns():
    """A sequence's last sign decides; the model gets far below the variance in few rounds."""
    draw = np.random.default_rng(4)
    x = draw.normal(0, 1, (2000, 6))
    y = np.sign(x[:, -1]) * 0.5 + 0.3 * x[:, -2]
    step, known = mergeable.SequenceModel(epochs=30, batch=250, rate=0.02).planned(2000), None
    for turn in range(step.rounds(6)):
        some = slice(None) if step.part(turn) is None else slice(step.part(turn), None, step.batches)
        known = step.advance(known, step.partial(known, x[some], y[some], turn), 6, turn)
    assert np.mean((step.predict(known, x) - y) ** 2) < 0.1 * y.var()


def test_measures(spark):
    draw = np.random.default_rng(7)
    y = draw.normal(0, 1, 300)
    p = 0.5 * y + draw.normal(0, 1, 300)
    rows = spark.createDataFrame([(float(a), float(b), k % 3, k % 2 if k % 5 else None) for k, (a, b) in enumerate(zip(y, p))], "target double, prediction double, fold_index long, path_index long").repartition(7)
    found = {(r["metric"], r["scope"], r["key"]): (r["value"], r["n"]) for r in evaluate.scores(rows, {"loss": mergeable.QuantileLoss(0.9), "agree": mergeable.Concordance(), "mse": evaluate.mse()}).collect()}
    assert len(found) == 3 * (1 + 3 + 2)
    for (metric, scope, key), (value, n) in found.items():
        at = np.array([scope == "overall" or (scope == "fold" and k % 3 == key) or (scope == "path" and bool(k % 5) and k % 2 == key) for k in range(300)])
        a, b = y[at], p[at]
        want = {"loss": np.maximum(0.9 * (a - b), 0.1 * (b - a)).mean(), "agree": 2 * np.cov(a, b, ddof=0)[0, 1] / (a.var() + b.var() + (a.mean() - b.mean()) ** 2), "mse": ((a - b) ** 2).mean()}
        assert n == at.sum() and abs(value - want[metric]) < 1e-12
    assert evaluate.scores(rows.limit(0), {"loss": mergeable.QuantileLoss()}).collect() == []
    same = spark.createDataFrame([(1.0, 1.0, 0, None)] * 3, rows.schema)
    assert {r["value"] for r in evaluate.scores(same, {"agree": mergeable.Concordance()}).collect()} == {1.0}


class Halves:
    """A splitter that states nothing about itself."""

    def plan(self, dataset, axis):
        return splits.plan(dataset, axis, PurgedKFold(2))


def test_identities_are_stated(world):
    data, axis, _, _ = world
    run = lambda **more: evaluate.Evaluator(**({"splitter": PurgedKFold(2), "model": evaluate.Mean(), "features": ("ret",)} | more)).evaluate(data, axis, "d")
    for bad in ({"splitter": Halves()}, {"model": lambda: None}, {"measures": {"m": lambda y, p: 0.0}}, {"transformers": (object,)}):
        with pytest.raises(EvaluationError, match="name and a version"):
            run(**bad)
    named = lambda version: evaluate.Named(Halves(), "halves", version, {"k": 2})
    ids = [run(splitter=named(v)).run_id for v in ("1", "1", "2")]
    assert ids[0] == ids[1] != ids[2]
    assert run(measures={"q": mergeable.QuantileLoss(0.1)}).run_id != run(measures={"q": mergeable.QuantileLoss(0.2)}).run_id
    assert evaluate.identity(mergeable.Standardise()) != evaluate.identity(mergeable.RidgeSums())


def test_evaluator_runs_steps_over_paths(world):
    """A combinatorial plan with transformers: every path whole, digests of the transformers in the ledger."""
    data, axis, _, _ = world
    steps = (mergeable.QuantileClip(0.05, 0.95), mergeable.Standardise())
    found = evaluate.Evaluator(CombinatorialCV(4, 2), evaluate.Ridge(), ("ret", "square"), {"agree": mergeable.Concordance()}, steps).evaluate(data, axis, data_digest(data))
    assert found.ledger.first()["transformer_spec_digests"] == [evaluate.identity(s) for s in steps]
    assert found.scores.where("scope = 'path'").count() == 3 and {r["n"] for r in found.scores.where("scope = 'path'").collect()} == {data.count()}
