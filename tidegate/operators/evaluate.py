"""Fold-local models and the out-of-sample ledger.

Built-in models are aggregates: a fold's ridge needs the sums of its features' products only, so a row for
each fold is solved and joined back. Steps of `mergeable` learn from partial states, so their folds have any size, too.
Any other estimator runs inside a grouped function, one fold at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, is_dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.errors import EvaluationError
from tidegate.functions.risk import mse
from tidegate.model import CombinatorialCV, digest
from tidegate.operators import governance, mergeable, metrics, splits
from tidegate.operators.paths import paths
from tidegate.session import kept

#: Rows that an opaque estimator or metric function gets at most, as these hold a whole fold in one task.
MOST_ROWS = 5_000_000


@dataclass(frozen=True)
class Mean:
    """The mean target of a fold's training rows; an aggregate, so folds may have any size."""


@dataclass(frozen=True)
class Ridge:
    """Ridge regression by sums of products; folds may have any size."""

    alpha: float = 1.0


@dataclass(frozen=True)
class Named:
    """A user's factory, function or splitter with the identity that evidence about it carries."""

    made: Any
    name: str
    version: str
    parameters: dict[str, Any] = field(default_factory=dict)

    def __call__(self, *args: Any) -> Any:
        return self.made(*args)

    def plan(self, dataset: DataFrame, axis: DataFrame) -> DataFrame:
        return self.made.plan(dataset, axis)

    @property
    def minimums(self) -> object:
        return getattr(self.made, "minimums", None)


def identity(thing: object) -> str:
    """A digest that is the same in every process: of a specification's fields, a column's text, or a stated name and version.

    What states none of these is refused, as its default text would hold a memory address.
    """
    if isinstance(thing, Named):
        stated = {"name": thing.name, "version": thing.version, "parameters": thing.parameters}
    elif isinstance(thing, Column):
        stated = {"column": str(thing)}
    elif is_dataclass(thing) and not isinstance(thing, type):
        stated = {"type": type(thing).__qualname__, "version": getattr(thing, "version", "1"), "fields": asdict(thing)}
    else:
        stated = {"name": getattr(thing, "name", None), "version": getattr(thing, "version", None), "parameters": getattr(thing, "parameters", {})}
    if not all(isinstance(stated.get(k, ""), str) and (k not in stated or stated[k]) for k in ("name", "version")):
        raise EvaluationError(f"a {type(thing).__name__} needs a name and a version; wrap it in Named")
    return digest(stated)


class Estimator(Protocol):
    def fit(self, features: np.ndarray, target: np.ndarray) -> object: ...

    def predict(self, features: np.ndarray) -> np.ndarray: ...


class Transformer(Protocol):
    def fit(self, features: np.ndarray, target: np.ndarray) -> object: ...

    def transform(self, features: np.ndarray) -> np.ndarray: ...


def mean_predictions(assigned: DataFrame) -> DataFrame:
    """Test rows with `prediction`, the mean target of their fold's training rows."""
    means = assigned.where("role = 'train'").groupBy("fold").agg(F.avg("target").alias("prediction"))
    return assigned.where("role = 'test'").join(F.broadcast(means), "fold")  # a row for each fold


def ridge_coefficients(assigned: DataFrame, features: list[str], alphas: tuple[float, ...] = (1.0,)) -> DataFrame:
    """(fold, alpha, intercept, slopes) of ridge on population-standardised features, the intercept unpenalised.

    One pass gathers each fold's means and covariances, from which every alpha is solved, a row for each fold.
    A constant feature counts as unscaled.
    """
    k = len(features)
    y = "target"
    sums = [F.count("*").cast("double").alias("n"), F.avg(y).alias("my"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.covar_pop(f, y).alias(f"y{i}") for i, f in enumerate(features)]]
    sums += [F.covar_pop(features[i], features[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                cross = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                scale = np.sqrt(np.maximum(np.diag(cross), 0))
                scale = np.where(scale <= 1e-12, 1.0, scale)
                right = np.array([r[f"y{i}"] for i in range(k)]) / scale * r["n"]
                for alpha in alphas:
                    slope = np.linalg.solve(cross / np.outer(scale, scale) * r["n"] + alpha * np.eye(k), right) / scale
                    out.append((r["fold"], alpha, r["my"] - float(slope @ np.array([r[f"m{i}"] for i in range(k)])), slope.tolist()))
            yield pd.DataFrame(out, columns=["fold", "alpha", "intercept", "slopes"])

    train = assigned.where("role = 'train'").groupBy("fold").agg(*sums)
    return train.mapInPandas(solve, "fold long, alpha double, intercept double, slopes array<double>")


def ridge_predictions(assigned: DataFrame, features: list[str], *alphas: float) -> DataFrame:
    """Test rows with the `prediction` of their fold's ridge, a row for each alpha (1.0 if none is given)."""
    fitted = ridge_coefficients(assigned, features, tuple(float(a) for a in alphas) or (1.0,))
    score = F.col("intercept")
    for i, f in enumerate(features):
        score = score + F.col("slopes")[i] * F.col(f)
    return assigned.where("role = 'test'").join(F.broadcast(fitted), "fold").withColumn("prediction", score).drop("intercept", "slopes")


def fit_predict(
    assigned: DataFrame, features: list[str], estimator: Callable[[], Estimator], transformers: tuple[Callable[[], Transformer], ...] = (), keys: tuple[str, ...] = ("asset", "session")
) -> DataFrame:
    """(fold, *keys, target, prediction, problem) of test rows by a fresh estimator for each fold.

    Transformers are fitted on training rows alone, in order. A failure inside a fold leaves no predictions and
    a code in `problem`, without data in it; `completed` raises for it. An estimator that is no aggregate needs its
    fold in one task, so folds of more than MOST_ROWS rows are refused: `Mean` and `Ridge` have no such limit.
    """
    within_limit(assigned.where("role <> 'excluded'"), "fold")
    if estimator() is estimator() or any(t() is t() for t in transformers):
        raise EvaluationError("factories must make a new object for each fold")
    kinds = dict(assigned.dtypes)
    schema = "fold long, " + ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", target double, prediction double, problem string"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(keys), kind="stable")
        train, test = rows[rows["role"] == "train"], rows[rows["role"] == "test"].copy()
        problem, predicted = None, np.full(len(test), np.nan)
        try:
            x, y, z = train[features].to_numpy(float), train["target"].to_numpy(float), test[features].to_numpy(float)
            for make in transformers:
                t = make()
                t.fit(x, y)
                a, b = np.asarray(t.transform(x)), np.asarray(t.transform(z))
                if len(a) != len(x) or len(b) != len(z):
                    raise ValueError
                x, z = a, b
            model = estimator()
            model.fit(x, y)
            predicted = np.asarray(model.predict(z), float)
            if predicted.shape != (len(test),) or not np.isfinite(predicted).all():
                problem, predicted = "bad-predictions", np.full(len(test), np.nan)
        except Exception as error:  # the class says what failed; its message may hold data
            problem = type(error).__name__
        test["prediction"], test["problem"] = predicted, problem
        return test[["fold", *keys, "target", "prediction", "problem"]]

    return assigned.where("role <> 'excluded'").groupBy("fold").applyInPandas(run, schema)


def within_limit(rows: DataFrame, *keys: str) -> None:
    if (most := rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > MOST_ROWS:
        raise EvaluationError(f"a group of {most} rows is too large for a function that needs it whole")


def predict(assigned: DataFrame, features: list[str], model: Mean | Ridge | Callable[[], Estimator], transformers: tuple[Callable[[], Transformer], ...] = (), keys: tuple[str, ...] = ("asset", "session")) -> DataFrame:
    """(fold, *keys, target, prediction) of all test rows: built-in models as aggregates, others by `fit_predict`.

    A model that predicts from frames itself, as `families.BoostedTrees` does, is asked to.
    """
    if not isinstance(model, type) and hasattr(model, "predict"):
        if transformers:
            raise EvaluationError("this model takes features as they are; transform them beforehand or pass an estimator")
        return model.predict(assigned, features).select("fold", *keys, "target", "prediction")
    if isinstance(model, Mean | Ridge) and not transformers:
        found = mean_predictions(assigned) if isinstance(model, Mean) else ridge_predictions(assigned, features, model.alpha)
        return found.select("fold", *keys, "target", "prediction")
    if isinstance(model, Mean | Ridge):
        raise EvaluationError("built-in models take features as they are; transform them beforehand or pass an estimator")
    return completed(fit_predict(assigned, features, model, transformers, keys))


def completed(predictions: DataFrame) -> DataFrame:
    """The predictions, or an error that names the folds and kinds of failure."""
    bad = predictions.where("problem is not null").select("fold", "problem").distinct().limit(20).collect()
    if bad:
        raise EvaluationError("; ".join(f"fold {r['fold']}: {r['problem']}" for r in sorted(bad)))
    return predictions.drop("problem")


LEDGER = ("run_id", "sample_id", "session", "asset_id", "fold_index", "split_id", "target", "prediction", "dataset_digest", "split_spec_digest", "model_digest",
          "pit_snapshot_digest", "feature_manifest_digest", "transformer_spec_digests", "evidence_channel", "combination_index", "group_index", "path_index")


def ledger(predictions: DataFrame, path_table: DataFrame | None = None, **identity: str | list[str] | None) -> DataFrame:
    """Predictions as ledger rows; combinatorial ones get the path of their (combination, group)."""
    rows = predictions
    if path_table is not None:
        rows = rows.join(F.broadcast(path_table), ["fold", "group"])
    combinatorial = path_table is not None
    digests = identity.get("transformer_spec_digests") or []
    known = {
        "sample_id": F.concat_ws("::", F.col("session").cast("string"), F.col("asset")),
        "session": F.col("session"),
        "asset_id": F.col("asset"),
        "fold_index": F.col("fold"),
        "split_id": F.sha2(F.concat_ws(":", F.lit(identity.get("split_spec_digest") or ""), F.col("fold").cast("string")), 256),
        "target": F.col("target"),
        "prediction": F.col("prediction"),
        "transformer_spec_digests": F.array(*[F.lit(d) for d in digests]).cast("array<string>"),
        "combination_index": F.col("fold") if combinatorial else F.lit(None).cast("long"),
        "group_index": F.col("group") if combinatorial else F.lit(None).cast("long"),
        "path_index": F.col("path") if combinatorial else F.lit(None).cast("long"),
    }
    return rows.select(*[known.get(n, F.lit(identity.get(n)).cast("string")).alias(n) for n in LEDGER])


def require_complete_paths(rows: DataFrame, expected: int) -> None:
    """Every path holds each sample exactly once."""
    bad = rows.groupBy("path_index").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("d")).where((F.col("n") != expected) | (F.col("d") != expected))
    if (count := bad.count()) > 0:
        raise EvaluationError(f"{count} paths do not cover every sample once")


def ledger_order(rows: DataFrame) -> DataFrame:
    """A ledger's rows by session, asset, path and combination, rows without the last two first."""
    return rows.orderBy("session", "asset_id", F.coalesce("path_index", F.lit(-1)), F.coalesce("combination_index", F.lit(-1)), "fold_index")


def scores(rows: DataFrame, measures: dict[str, Column | mergeable.Measure | Callable[[np.ndarray, np.ndarray], float]]) -> DataFrame:
    """(metric, scope, key, value, n) of a ledger, overall, by fold and, where it has paths, by path.

    A measure is an aggregate column over `target` and `prediction`, a mergeable measure, or a function of both as
    arrays. Only a function needs a group whole, so groups of more than MOST_ROWS rows are refused; a failure of it is
    an error.
    """
    scopes = {"overall": F.lit(-1), "fold": F.col("fold_index"), "path": F.col("path_index")}
    out = None
    if merged := {n: m for n, m in measures.items() if isinstance(m, mergeable.Measure)}:
        keyed = rows.select("target", "prediction", *[k.cast("long").alias(f"_{s}") for s, k in scopes.items()])
        out = mergeable.measured(keyed, merged, {s: f"_{s}" for s in scopes})
    for name, measure in ((n, m) for n, m in measures.items() if n not in merged):
        for scope, key in scopes.items():
            keyed = rows.select(key.cast("long").alias("key"), "target", "prediction").where(F.col("key").isNotNull())
            if isinstance(measure, Column):
                found = keyed.groupBy("key").agg(measure.alias("value"), F.count("*").alias("n"))
            else:
                within_limit(keyed, "key")
                found = keyed.groupBy("key").applyInPandas(_measured(measure), "key long, value double, n long")
            found = found.select(F.lit(name).alias("metric"), F.lit(scope).alias("scope"), "key", "value", "n")
            out = found if out is None else out.unionByName(found)
    return out


def _measured(function: Callable[[np.ndarray, np.ndarray], float]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["target", "prediction"], kind="stable")
        value = float(function(rows["target"].to_numpy(float), rows["prediction"].to_numpy(float)))
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "value": [value], "n": [len(rows)]})

    return run


@dataclass
class Evaluation:
    """Out-of-sample evidence of one plan: the ledger as a table, its scores, its coverage and its run's id."""

    ledger: DataFrame
    scores: DataFrame
    coverage: DataFrame
    run_id: str


@dataclass(frozen=True)
class Evaluator:
    """From a dataset to a complete ledger and its scores, or an error: nothing partial is returned."""

    splitter: object
    model: Mean | Ridge | mergeable.Estimator | Callable[[], Estimator]
    features: tuple[str, ...]
    measures: dict[str, Column | mergeable.Measure | Callable] = field(default_factory=lambda: {"mse": mse()})
    transformers: tuple[mergeable.Transformer | Callable[[], Transformer], ...] = ()
    channel: str = "model-selection"

    def evaluate(self, dataset: DataFrame, axis: DataFrame, dataset_digest: str, snapshot: governance.PITSnapshot | None = None) -> Evaluation:
        """`dataset` has asset, session, axis_pos, info_start, info_end, target and the features, one row a sample.

        Rows that carry decision and availability times need a point-in-time snapshot. Folds must meet the splitter's
        minimums, and every path of a combinatorial plan must test every sample once. Splitter, model, transformers and
        measures need an identity, see `identity`. With transformers of `mergeable` the model must be one, or `Ridge`.
        """
        spec, model, steps = identity(self.splitter), identity(self.model), [identity(t) for t in self.transformers]
        run_id = digest([dataset_digest, spec, model, {n: identity(m) for n, m in self.measures.items()}, steps, self.channel])
        if "feature_available" in dataset.columns:
            governance.require_point_in_time(dataset, snapshot)
        decided = kept(splits.plan(dataset, axis, self.splitter), "folds")
        if minimums := getattr(self.splitter, "minimums", None):
            splits.require(decided, minimums)
        combinatorial = isinstance(self.splitter, CombinatorialCV)
        table = paths(dataset.sparkSession, self.splitter.choices, self.splitter.n_groups) if combinatorial else None
        assigned = splits.assignments(dataset, decided)
        learner, keys = self.model, ("asset", "session", "group")
        if isinstance(learner, Ridge) and self.transformers:
            learner = mergeable.RidgeSums(learner.alpha)
        if isinstance(learner, mergeable.Estimator):
            made = mergeable.fit_predict(dataset, decided, assigned, list(self.features), (*self.transformers, learner), keys)
        else:
            made = predict(assigned, list(self.features), learner, self.transformers, keys)
        stated = {"run_id": run_id, "dataset_digest": dataset_digest, "split_spec_digest": spec, "model_digest": model, "evidence_channel": self.channel}
        rows = kept(ledger(made, table, **stated, transformer_spec_digests=steps, pit_snapshot_digest=digest(snapshot) if snapshot else None), "ledger")
        samples, folds = dataset.count(), decided.agg(F.count_distinct("fold")).first()[0]
        if rows.where(F.col("prediction").isNull() | F.isnan("prediction") | (F.abs("prediction") == float("inf"))).limit(1).count():
            raise EvaluationError("predictions are missing or not finite")
        if combinatorial:
            require_complete_paths(rows, samples)
        covered = metrics.coverage(rows.withColumnsRenamed({"asset_id": "asset", "fold_index": "fold"}), samples, folds)
        return Evaluation(rows, scores(rows, self.measures), covered, run_id)
