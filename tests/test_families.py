"""Named models, boosted trees over executors, and absent libraries."""

from importlib.util import find_spec

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegate.errors import EvaluationError
from tidegate.operators import families
from tidegate.operators.evaluate import Mean, predict


@pytest.fixture(scope="module")
def assigned(spark):
    """Two folds of a step function, which a line cannot follow and trees can."""
    draw = np.random.default_rng(3)
    x = draw.uniform(-1, 1, (400, 2))
    y = np.where(x[:, 0] > 0.2, 2.0, -1.0) + draw.normal(0, 0.05, 400)
    rows = pd.DataFrame({"fold": np.arange(400) % 2, "asset": "A", "session": np.arange(400), "x0": x[:, 0], "x1": x[:, 1], "target": y})
    return spark.createDataFrame(pd.concat([rows.assign(role="train"), rows.assign(role="test", fold=1 - rows["fold"])]))


def test_boosted_trees(assigned):
    models, _ = families.family("mean", "ridge", "boosted-trees")
    error = {n: predict(assigned, ["x0", "x1"], m).agg(F.count("*"), F.avg((F.col("target") - F.col("prediction")) ** 2)).first() for n, m in models.items()}
    assert {e[0] for e in error.values()} == {400}
    assert error["boosted-trees"][1] < 0.2 * error["ridge"][1] < error["mean"][1]


def test_a_fold_learns_from_its_training_rows_only(assigned):
    trees = families.BoostedTrees(trees=3)
    found = predict(assigned, ["x0", "x1"], trees).orderBy("fold", "session").collect()
    spoilt = assigned.withColumn("target", F.when((F.col("fold") == 0) & (F.col("role") == "test"), F.lit(1e6)).otherwise(F.col("target")))
    again = predict(spoilt, ["x0", "x1"], trees).orderBy("fold", "session").collect()
    assert [r["prediction"] for r in found] == [r["prediction"] for r in again]
    with pytest.raises(EvaluationError, match="1 folds have no training rows"):
        predict(assigned.where("not (fold = 1 and role = 'train')"), ["x0", "x1"], trees)
    assert predict(assigned.limit(0), ["x0", "x1"], trees).collect() == []
    with pytest.raises(EvaluationError, match="features as they are"):
        predict(assigned, ["x0", "x1"], trees, (object,))


def test_names_and_absent_libraries(monkeypatch):
    monkeypatch.setattr(families, "find_spec", lambda name: None)
    with pytest.raises(EvaluationError, match="not installed: lightgbm"):
        families.family("mean", "lightgbm")
    models, missing = families.family("mean", "lightgbm", skip_missing=True)
    assert models == {"mean": Mean()} and missing == ["lightgbm"]
    for wrong in ((), ("mean", "mean"), ("nobody",)):
        with pytest.raises(EvaluationError):
            families.family(*wrong)


@pytest.mark.skipif(find_spec("lightgbm") is None, reason="lightgbm is absent")
def test_lightgbm(assigned):
    assert predict(assigned, ["x0", "x1"], families.LightGBM).count() == 400
