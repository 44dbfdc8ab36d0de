"""Models by name, boosted trees fitted by Spark ML, and what happens where a model's library is absent."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib.util import find_spec

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.errors import EvaluationError
from tidegate.operators.boosting import LeafwiseTrees
from tidegate.operators.evaluate import Mean, Ridge
from tidegate.operators.mergeable import SequenceModel
from tidegate.session import shared_path


@dataclass(frozen=True)
class BoostedTrees:
    """Gradient-boosted regression trees; each fold is fitted over all executors, so folds may have any size."""

    trees: int = 40
    depth: int = 3
    step: float = 0.05
    seed: int = 0

    def predict(self, assigned: DataFrame, features: list[str]) -> DataFrame:
        """Test rows with `prediction`. Folds are fitted one after the other, and each leaves its rows in a table.

        A fold without training rows is refused, as it has nothing to learn from.
        """
        spark, path = assigned.sparkSession, shared_path(assigned.sparkSession, "boosted")
        gather = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="error")
        counts = {r["fold"]: r["n"] for r in assigned.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("n")).collect()}  # a row for each fold
        if empty := sum(not n for n in counts.values()):
            raise EvaluationError(f"{empty} folds have no training rows")
        learner = GBTRegressor(featuresCol="_features", labelCol="target", maxIter=self.trees, maxDepth=self.depth, stepSize=self.step, seed=self.seed)
        for fold in sorted(counts):
            rows = assigned.where(F.col("fold") == fold)
            train = gather.transform(rows.where("role = 'train'")).select("_features", "target")
            fitted = learner.fit(train)
            fitted.transform(gather.transform(rows.where("role = 'test'"))).drop("_features").write.mode("append").parquet(path)
        schema = assigned.withColumn("prediction", F.lit(0.0)).schema
        return spark.read.schema(schema).parquet(path) if counts else spark.createDataFrame([], schema)


class LightGBM:
    """An estimator on the library `lightgbm`, one fold in one task; made only where that library is there."""

    name, version = "lightgbm", "1"

    def fit(self, features: np.ndarray, target: np.ndarray) -> LightGBM:
        from lightgbm import LGBMRegressor

        self.model = LGBMRegressor(n_estimators=40, max_depth=3, num_leaves=7, learning_rate=0.05, deterministic=True, n_jobs=1, random_state=0, verbose=-1).fit(features, target)
        return self

    def predict(self, features: np.ndarray) -> np.ndarray:
        return np.asarray(self.model.predict(features))


#: Name: (what the evaluator takes as its model, the library it needs). Boosted trees never stand in for lightgbm.
FAMILIES: dict[str, tuple[object, str | None]] = {
    "mean": (Mean(), None),
    "ridge": (Ridge(), None),
    "boosted-trees": (BoostedTrees(), None),
    "leafwise-trees": (LeafwiseTrees(), None),
    "sequence": (SequenceModel(), None),
    "lightgbm": (LightGBM, "lightgbm"),
}


def family(*names: str, skip_missing: bool = False) -> tuple[dict[str, object | Callable], list[str]]:
    """The named models in the given order, and the names left out because their library is absent.

    A missing library is an error unless `skip_missing`; unknown or repeated names always are.
    """
    if unknown := [n for n in names if n not in FAMILIES]:
        raise EvaluationError(f"{len(unknown)} unknown models; known are {', '.join(FAMILIES)}")
    if len(set(names)) < len(names) or not names:
        raise EvaluationError("name each model once, and one at least")
    missing = [n for n in names if FAMILIES[n][1] and find_spec(FAMILIES[n][1]) is None]
    if missing and not skip_missing:
        raise EvaluationError(f"not installed: {', '.join(FAMILIES[n][1] for n in missing)}")
    return {n: FAMILIES[n][0] for n in names if n not in missing}, missing
