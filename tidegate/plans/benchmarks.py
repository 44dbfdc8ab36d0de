"""Whole comparisons: channels of splits, views of samples, and strategy reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.errors import DatasetError
from tidegate.functions.risk import sharpe
from tidegate.model import CombinatorialCV, PurgedKFold, WalkForward
from tidegate.operators import evaluate, mergeable, metrics, splits, strategy
from tidegate.operators.paths import paths
from tidegate.session import kept

#: Fold numbers of one channel, when several channels share a table.
CHANNEL_FOLDS = 100_000


def channel_folds(dataset: DataFrame, axis: DataFrame, kfold: PurgedKFold, cpcv: CombinatorialCV | None, walk: WalkForward, embargo: int = 0) -> dict[str, DataFrame]:
    """Decided folds of each channel; the first two are unsafe on purpose."""
    found = {
        "unsafe-shuffled-kfold": splits.decide(dataset, axis, splits.shuffled_roles(dataset, kfold.n_splits), purge=False),
        "chronological-no-purge": splits.decide(dataset, axis, splits.walk_forward_roles(dataset, walk), purge=False),
        "purged-kfold": splits.decide(dataset, axis, splits.kfold_roles(dataset, kfold)),
        "causal-walk-forward": splits.plan(dataset, axis, walk),
    }
    if embargo:
        found["purged-kfold-embargo"] = splits.decide(dataset, axis, splits.kfold_roles(dataset, kfold), embargo=embargo)
    if cpcv:
        found["cpcv"] = splits.plan(dataset, axis, cpcv)
    return found


def _decided(folds: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, Column]:
    """All channels' decided folds as one table, a row for each fold and distinct interval; their shape; the channel of a fold."""
    names = F.array(*[F.lit(name) for name in folds])
    channel = names[F.floor(F.col("fold") / CHANNEL_FOLDS).cast("int")]
    decided = kept(reduce(DataFrame.unionByName, [d.withColumn("fold", F.col("fold") + k * CHANNEL_FOLDS) for k, d in enumerate(folds.values())]), "channel-folds")
    shape = splits.summary(decided).join(splits.retained_overlap(decided), "fold").groupBy(channel.alias("channel")).agg(
        F.sum("overlap").alias("overlap"), F.sum("purged").alias("purged"), F.sum("embargoed").alias("embargoed"), F.min("retained").alias("retained_min")
    )
    return decided, shape, channel


def channel_benchmark(dataset: DataFrame, folds: dict[str, DataFrame], features: list[str], alphas: tuple[float, ...] = (1.0,)) -> DataFrame:
    """(channel, alpha, mse, n, overlap, purged, embargoed, retained_min): every channel's folds fitted in one job.

    The decided folds of all channels are one table first: a row for each fold and distinct interval.
    """
    decided, shape, channel = _decided(folds)
    scored = evaluate.ridge_predictions(splits.assignments(dataset, decided), features, *alphas).withColumn("channel", channel)
    return scored.groupBy("channel", "alpha").agg(metrics.mse().alias("mse"), F.count("*").alias("n")).join(F.broadcast(shape), "channel")  # a row for each channel


def family_benchmark(dataset: DataFrame, folds: dict[str, DataFrame], features: list[str], models: dict[str, mergeable.Estimator]) -> DataFrame:
    """(channel, model, mse, n, overlap, purged, embargoed, retained_min): every model on every channel's folds.

    A model learns all folds of all channels together: a sample is read once a round, whatever the number of folds.
    """
    decided, shape, channel = _decided(folds)
    assigned = splits.assignments(dataset, decided)
    made = [mergeable.fit_predict(dataset, decided, assigned, features, (model,)).withColumn("model", F.lit(name)) for name, model in models.items()]
    scored = reduce(DataFrame.unionByName, made).withColumn("channel", channel)
    return scored.groupBy("channel", "model").agg(metrics.mse().alias("mse"), F.count("*").alias("n")).join(F.broadcast(shape), "channel")  # a row for each channel


def leakage_decision(benchmark: DataFrame) -> dict[str, str]:
    """Whether safe channels are free of overlap, canaries show it, and the embargo removed anything."""
    rows = {r["channel"]: r for r in benchmark.dropDuplicates(["channel"]).collect()}  # a row for each channel
    canaries = [c for c in rows if c.startswith(("unsafe", "chronological"))]
    safe = [c for c in rows if c not in canaries]
    embargoed = max([rows[c]["embargoed"] for c in safe], default=0)
    return {
        "leakage": "PASS" if all(rows[c]["overlap"] == 0 for c in safe) else "FAIL",
        "canary": "DETECTED" if any(rows[c]["overlap"] > 0 for c in canaries) else "NOT_DETECTED",
        "embargo": "ACTIVE" if embargoed else "NO_INCREMENTAL_EXCLUSION",
    }


def effectiveness(dataset: DataFrame, axis: DataFrame, kfold: PurgedKFold, cpcv: CombinatorialCV, walk: WalkForward, features: list[str], clean: DataFrame | None = None, periods: float = 252.0, alpha: float = 1.0) -> DataFrame:
    """(channel, view, path, n, mse, ic, sharpe) for three channels and the views native, common and roll-clean.

    The common view keeps the samples that walk-forward scored; roll-clean those of `clean` (asset, session).
    """
    spark, n = dataset.sparkSession, cpcv.n_groups
    ridge = lambda spec: evaluate.ridge_predictions(splits.assignments(dataset, kept(splits.plan(dataset, axis, spec), "plan")), features, alpha)
    columns = ["path", "asset", "session", "target", "prediction"]
    one = F.lit(0).cast("long")
    rows = {
        "causal-walk-forward": ridge(walk).withColumn("path", one).select(columns),
        "model-selection": ridge(kfold).withColumn("path", one).select(columns),
        "cpcv-robustness": ridge(cpcv).join(F.broadcast(paths(spark, cpcv.choices, n)), ["fold", "group"]).select(columns),
    }
    # every fold is fitted once, whatever views ask for its predictions
    found = kept(reduce(DataFrame.unionByName, [r.withColumn("channel", F.lit(c)) for c, r in rows.items()]), "predictions")
    views = {"native": found, "common": found.join(found.where("channel = 'causal-walk-forward'").select("asset", "session").distinct(), ["asset", "session"], "left_semi")}
    if clean is not None:
        views["roll-clean"] = found.join(clean, ["asset", "session"], "left_semi")
    every = reduce(DataFrame.unionByName, [v.withColumn("view", F.lit(name)) for name, v in views.items()])
    return metrics.financial_metrics(every, ["channel", "view", "path"], periods)


def strategy_report(returns: DataFrame, periods: float, cscv_groups: int, cpcv: CombinatorialCV, minimum_train: int, windows: int, candidates: int) -> dict[str, object]:
    """Overfitting evidence of one return matrix: a few numbers on the driver."""
    least = max(2 * cscv_groups, 2 * cpcv.n_groups, minimum_train + 2 * windows)
    if (found := returns.agg(F.count_distinct("t")).first()[0]) < least:
        raise DatasetError(f"{found} sessions, where the partitions need {least}")
    over = strategy.overfitting_probability(strategy.cscv(returns, cscv_groups, periods)).first()
    deflated = strategy.deflated_statistic(returns, candidates).first()
    paths_found = strategy.combinatorial_selection(returns, cpcv.n_groups, cpcv.n_test_groups, cpcv.embargo, periods)
    spread = paths_found.agg(F.median("sharpe").alias("median"), F.percentile("sharpe", F.lit(0.1)).alias("p10"), F.min("sharpe").alias("worst"), (F.percentile("sharpe", F.lit(0.75)) - F.percentile("sharpe", F.lit(0.25))).alias("iqr")).first()
    selection = strategy.walk_forward_selection(returns, minimum_train, windows, periods)
    walk = strategy.walk_forward_track(returns, selection, minimum_train, windows).agg(sharpe("net", periods)).first()[0]
    top = strategy.candidate_metrics(returns, periods).agg(F.max("sharpe")).first()[0]
    return {
        "pbo": over["pbo"],
        "median_logit": over["median_logit"],
        "deflated_probability": strategy.deflated_probability(deflated["statistic"]),
        "required_sessions": strategy.required_sessions(deflated["periodic_sharpe"], deflated["expected_maximum"], deflated["skewness"], deflated["kurtosis"], 0.95),
        **{f"cpcv_{k}": spread[k] for k in ("median", "p10", "worst", "iqr")},
        "walk_forward": walk,
        "mean_regret": selection.agg(F.avg("regret")).first()[0],
        "selection_optimism": top - walk,
    }
