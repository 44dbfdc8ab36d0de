"""Scores of an out-of-sample ledger, by session, path and view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.errors import EvaluationError
from tidegate.functions.risk import mse, pearson, sharpe
from tidegate.operators.panel import average_rank


def scoped_mse(rows: DataFrame, path: str = "path") -> DataFrame:
    """(scope, key, value, n): overall, by fold and by path, in one pass of grouping sets."""
    sets = rows.groupingSets([[], [F.col("fold")], [F.col(path)]], F.col("fold"), F.col(path)).agg(mse().alias("value"), F.count("*").alias("n"), F.grouping_id().alias("gid"))
    return sets.select(
        F.when(F.col("gid") == 3, "overall").when(F.col("gid") == 1, "fold").otherwise("path").alias("scope"),
        F.coalesce(F.when(F.col("gid") == 1, F.col("fold")).when(F.col("gid") == 2, F.col(path)), F.lit(-1)).cast("long").alias("key"),
        "value",
        "n",
    )


def coverage(rows: DataFrame, samples: int, folds: int) -> DataFrame:
    """Shares of the samples and folds that have predictions."""
    return rows.agg((F.count_distinct("asset", "session") / samples).alias("sample_coverage"), (F.count_distinct("fold") / folds).alias("fold_coverage"))


def session_ic(rows: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Rank correlation of target and prediction within each session of at least `least` rows, null where constant."""
    at = [*keys, "session"]
    ranked = rows.withColumn("rank_t", average_rank("target", *at)).withColumn("rank_p", average_rank("prediction", *at))
    return ranked.groupBy(*at).agg(F.count("*").alias("n"), pearson("rank_t", "rank_p").alias("ic")).where((F.col("n") >= least) & F.col("ic").isNotNull())


def session_returns(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Diagnostic return of each session of two rows or more: targets weighted by centred predictions of unit gross size."""
    at = [*keys, "session"]
    centred = rows.withColumn("lean", F.col("prediction") - F.avg("prediction").over(Window.partitionBy(*at)))
    sums = centred.groupBy(*at).agg(F.count("*").alias("n"), F.sum(F.abs("lean")).alias("gross"), F.sum(F.col("lean") * F.col("target")).alias("won"))
    return sums.where((F.col("n") >= 2) & (F.col("gross") > 0)).select(*at, (F.col("won") / F.col("gross")).alias("ret"))


def financial_metrics(rows: DataFrame, keys: list[str], periods: float = 252.0) -> DataFrame:
    """(keys, n, mse, ic, sharpe) per path; null where a path has no such evidence."""
    error = rows.groupBy(*keys).agg(F.count("*").alias("n"), mse().alias("mse"))
    ic = session_ic(rows, keys).groupBy(*keys).agg(F.avg("ic").alias("ic"))
    ret = session_returns(rows, keys).groupBy(*keys).agg(F.when((F.count("*") >= 2) & (F.stddev_samp("ret") > 0), sharpe("ret", periods)).alias("sharpe"))
    return error.join(ic, keys, "left").join(ret, keys, "left")


def require_financial(metrics: DataFrame) -> DataFrame:
    if (bad := metrics.where("ic is null or sharpe is null").count()) > 0:
        raise EvaluationError(f"{bad} paths have no rank correlation or no dispersed returns")
    return metrics


def distribution(metrics: DataFrame, keys: list[str], names: tuple[str, ...] = ("mse", "ic", "sharpe")) -> DataFrame:
    """(keys, metric, median, worst, std, p10, p90) over paths; the worst error is the largest, other scores' the smallest."""
    long = metrics.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in names])).alias("x")).select(*keys, "x.metric", "x.v")
    return long.groupBy(*keys, "metric").agg(
        F.percentile("v", F.lit(0.5)).alias("median"),
        F.when(F.col("metric") == "mse", F.max("v")).otherwise(F.min("v")).alias("worst"),
        F.stddev_pop("v").alias("std"),
        F.percentile("v", F.lit(0.1)).alias("p10"),
        F.percentile("v", F.lit(0.9)).alias("p90"),
    )


def training_sufficiency(assigned: DataFrame) -> DataFrame:
    """Per fold: training observations, sessions and assets."""
    return assigned.where("role = 'train'").groupBy("fold").agg(
        F.count("*").alias("observations"), F.count_distinct("session").alias("sessions"), F.count_distinct("asset").alias("assets")
    )


def sufficiency_summary(per_fold: DataFrame) -> DataFrame:
    """Smallest, median and largest of each count over the folds."""
    names = ("observations", "sessions", "assets")
    return per_fold.agg(*[f(n).alias(f"{label}_{n}") for n in names for label, f in (("min", F.min), ("median", F.median), ("max", F.max))])


def group_breadth(dataset: DataFrame, grouped: DataFrame) -> DataFrame:
    """Per group: sessions, observations and assets; `grouped` has (axis_pos, group)."""
    return dataset.join(F.broadcast(grouped), "axis_pos").groupBy("group").agg(
        F.count_distinct("session").alias("sessions"), F.count("*").alias("observations"), F.count_distinct("asset").alias("assets")
    )


def regime_scores(rows: DataFrame, regimes: int = 3) -> DataFrame:
    """(model, regime, mse) over chronological chunks of the sessions; `rows` has model, session, target, prediction."""
    sessions = rows.select("session").distinct().withColumn("regime", F.ntile(regimes).over(Window.orderBy("session")).cast("long") - 1)
    return rows.join(F.broadcast(sessions), "session").groupBy("model", "regime").agg(mse().alias("mse"))


def model_ranks(scores: DataFrame, smaller_is_better: bool = True) -> DataFrame:
    """`scores` (model, regime, mse) with rank_in_regime, ties sharing their mean rank."""
    value = F.col("mse") if smaller_is_better else -F.col("mse")
    return scores.withColumn("v", value).withColumn("rank_in_regime", average_rank("v", "regime")).drop("v")


def rank_stability(ranks: DataFrame) -> DataFrame:
    """(regime_a, regime_b, correlation) of the models' ranks for each pair of regimes; equal ranks give 1, constant ones 0."""
    by_model = ranks.groupBy("model").agg(F.collect_list(F.struct("regime", "rank_in_regime")).alias("all"))  # a few regimes
    first = by_model.select("model", "all", F.explode("all").alias("x"))
    pairs = first.select("x", F.explode(F.filter("all", lambda z: z["regime"] > F.col("x.regime"))).alias("z"))
    pairs = pairs.select(F.col("x.regime").alias("regime_a"), F.col("x.rank_in_regime").alias("a"), F.col("z.regime").alias("regime_b"), F.col("z.rank_in_regime").alias("b"))
    same = F.bool_and(F.col("a") == F.col("b"))
    return pairs.groupBy("regime_a", "regime_b").agg(F.when(same, 1.0).otherwise(F.round(F.coalesce(pearson("a", "b"), F.lit(0.0)), 12)).alias("correlation"))


def model_summary(ranks: DataFrame) -> DataFrame:
    """Per model: median and worst rank and how often it comes first, the best median, then worst rank, then name first."""
    found = ranks.groupBy("model").agg(F.median("rank_in_regime").alias("median_rank"), F.max("rank_in_regime").alias("worst_rank"), F.count_if(F.col("rank_in_regime") == 1).alias("first_places"))
    return found.orderBy("median_rank", "worst_rank", "model")


def require_same_models(scores: DataFrame) -> DataFrame:
    """`scores` (model, regime, ...), if every regime has the same models, each once, and there are two of both at least."""
    seen = scores.groupBy("regime").agg(F.count("*").alias("rows"), F.sort_array(F.collect_set("model")).alias("models"))
    found = seen.agg(F.count("*").alias("regimes"), F.count_distinct("models").alias("sets"), F.max(F.col("rows") - F.size("models")).alias("repeats"), F.min(F.size("models")).alias("models")).first()
    if found["sets"] > 1 or found["repeats"]:
        raise EvaluationError("the regimes do not have the same models, each once")
    if found["regimes"] < 2 or found["models"] < 2:
        raise EvaluationError("a ranking needs two regimes and two models at least")
    return scores
