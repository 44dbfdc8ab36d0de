"""Trading-strategy tracks and what selecting among them overstates.

Tracks are one long table (t, session, cand_idx, candidate_id, gross, net, turnover). Choices of groups are
small tables of (split, group, side) that are broadcast and joined on the group; candidates are compared by
grouped aggregates, and the best one is the first of equals.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product
from math import ceil, sqrt
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.errors import DatasetError, EvaluationError
from tidegate.functions.risk import drawdowns, expected_maximum_factor, normal_cdf, normal_cdf_column, raw_kurtosis, sharpe, skew, total_return
from tidegate.operators.paths import path_table


@dataclass(frozen=True)
class Execution:
    """Periods in a year, volatility aimed at, and cost in basis points of turnover."""

    periods: float = 252.0
    target_vol: float = 0.10
    cost_bps: float = 0.0


@dataclass(frozen=True)
class Candidate:
    lookback: int
    vol_window: int
    rebalance: int
    cap: float

    @property
    def name(self) -> str:
        return f"tsmom-l{self.lookback:03d}-v{self.vol_window:03d}-r{self.rebalance:02d}-c{self.cap:g}"

    @property
    def warmup(self) -> int:
        return max(self.lookback, self.vol_window) + 1


def grid(lookbacks=(21, 63, 126, 252), windows=(20, 60), rebalances=(5, 21), caps=(2.0, 4.0)) -> list[Candidate]:
    return [Candidate(*c) for c in product(lookbacks, windows, rebalances, caps)]


def candidate_table(spark: SparkSession, candidates: list[Candidate]) -> DataFrame:
    rows = [(i, c.name, c.lookback, c.vol_window, c.rebalance, float(c.cap), c.warmup) for i, c in enumerate(candidates)]
    return spark.createDataFrame(rows, "cand_idx long, candidate_id string, lookback long, vol_window long, grid_rebalance long, cap double, warmup long")


def require_dense(panel: DataFrame) -> None:
    """Each session holds every asset once, prices are above 0 and returns above -1."""
    found = panel.agg(
        F.count("*"), F.count_distinct("t"), F.count_distinct("asset"), F.count_distinct("t", "asset"), F.count_if((F.col("price") <= 0) | F.isnan("price")), F.count_if((F.col("ret") <= -1) | F.isnan("ret"))
    ).first()
    rows, sessions, assets, cells, bad_prices, bad_returns = found
    if sessions < 3 or rows != cells or rows != sessions * assets:
        raise DatasetError("the panel is not dense or has fewer than 3 sessions")
    if bad_prices or bad_returns:
        raise DatasetError(f"{bad_prices} prices and {bad_returns} returns are out of range")


def require_returns(returns: DataFrame) -> None:
    """A return matrix (t, cand_idx, net, gross, turnover) is dense, of two candidates or more, in range, and finite."""
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows, sessions, candidates, cells, low, negative, strange = returns.agg(
        F.count("*"), F.count_distinct("t"), F.count_distinct("cand_idx"), F.count_distinct("t", "cand_idx"),
        F.count_if((F.col("net") <= -1) | (F.col("gross") <= -1)), F.count_if(F.col("turnover") < 0), F.count_if(odd("net") | odd("gross") | odd("turnover")),
    ).first()
    if candidates < 2 or rows != cells or rows != sessions * candidates:
        raise DatasetError("the return matrix is not dense or has fewer than 2 candidates")
    if low or negative or strange:
        raise DatasetError(f"{low} returns of -1 or less, {negative} negative turnovers and {strange} values not finite")
    if "session" in returns.columns:
        order = returns.groupBy("t").agg(F.min("session").alias("low"), F.max("session").alias("high"))
        bad = order.withColumn("before", F.lag("high").over(Window.orderBy("t"))).where("low <> high or before >= low").count()  # a row for each session
        if bad:
            raise DatasetError(f"{bad} sessions do not rise")


def scenario(tracked: DataFrame, cost_bps: float) -> DataFrame:
    """The tracks of the one cost scenario within 1e-12 of `cost_bps`; none or several are refused."""
    near = tracked.where(F.abs(F.col("cost_bps") - cost_bps) <= 1e-12)
    if (n := near.select("cost_bps").distinct().count()) != 1:
        raise EvaluationError(f"{n} cost scenarios of {cost_bps:g} basis points, where one is needed")
    return near


def weights(panel: DataFrame, candidates: list[Candidate], execution: Execution) -> DataFrame:
    """(t, session, asset, ret, cand_idx, candidate_id, weight) of time-series momentum.

    `panel` has t, session, asset, price, ret and is dense. At rebalances the sign of the price change over the
    lookback, up to the row before, is scaled to the volatility aimed at, capped and shared among the assets;
    weights are carried between rebalances and are 0 before the warm-up ends.
    """
    own = Window.partitionBy("asset").orderBy("t")
    seen = panel.withColumn("last_price", F.lag("price", 1).over(own))
    for n in sorted({c.lookback for c in candidates}):
        seen = seen.withColumn(f"price_{n}", F.lag("price", 1 + n).over(own))
    for v in sorted({c.vol_window for c in candidates}):
        seen = seen.withColumn(f"vol_{v}", F.stddev_samp("ret").over(own.rowsBetween(-v, -1)))
    pick = lambda name, column, values: F.coalesce(*[F.when(F.col(column) == x, F.col(f"{name}_{x}")) for x in values])
    table = candidate_table(panel.sparkSession, candidates)
    each = seen.join(F.broadcast(table))  # one row for each candidate of a grid
    each = each.withColumn("before", pick("price", "lookback", sorted({c.lookback for c in candidates}))).withColumn("vol", pick("vol", "vol_window", sorted({c.vol_window for c in candidates})))
    assets = panel.select(F.count_distinct("asset").alias("assets"))
    scale = F.when(F.col("vol") > 1e-12, F.least(F.lit(execution.target_vol) / (F.col("vol") * F.sqrt(F.lit(execution.periods))), F.col("cap"))).otherwise(0.0)
    due = (F.col("t") >= F.col("warmup")) & ((F.col("t") - F.col("warmup")) % F.col("grid_rebalance") == 0)
    set_now = each.join(F.broadcast(assets)).withColumn("chosen", F.when(due, F.signum(F.col("last_price") / F.col("before") - 1) * scale / F.col("assets")))
    carried = Window.partitionBy("cand_idx", "asset").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return set_now.withColumn("weight", F.coalesce(F.last("chosen", ignorenulls=True).over(carried), F.lit(0.0))).select("t", "session", "asset", "ret", "cand_idx", "candidate_id", "weight")


def tracks(weighted: DataFrame, costs: list[float]) -> DataFrame:
    """(cost_bps, t, session, cand_idx, candidate_id, gross, net, turnover): weights once, each cost as rows."""
    own = Window.partitionBy("cand_idx", "asset").orderBy("t")
    moved = weighted.withColumn("moved", F.abs(F.col("weight") - F.lag("weight", 1, 0.0).over(own)))
    free = moved.groupBy("t", "session", "cand_idx", "candidate_id").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"), F.sum("moved").alias("turnover"))
    return free.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs]))).withColumn("net", F.col("gross") - F.col("turnover") * F.col("cost_bps") / 10_000)


def candidate_metrics(returns: DataFrame, periods: float, keys: tuple[str, ...] = ("cand_idx", "candidate_id")) -> DataFrame:
    """Per candidate: Sharpe ratio, total return, largest drawdown and mean turnover of `net`."""
    keys = list(keys)
    base = returns.groupBy(*keys).agg(sharpe("net", periods).alias("sharpe"), total_return("net").alias("total_return"), F.avg("turnover").alias("mean_turnover"))
    return base.join(drawdowns(returns, "net", keys, "t"), keys)


def best(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """The row of the highest score for each key; of equals the smallest cand_idx.

    Scores count as equal to ten decimals, as sums of equal tracks differ with the order they were added in.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round(score, 10)), "cand_idx")
    return scored.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def grouped(returns: DataFrame, groups: int) -> DataFrame:
    """`returns` with `group`, chunks of rows in time of almost equal length."""
    rows = returns.select("t").distinct().withColumn("group", F.ntile(groups).over(Window.orderBy("t")).cast("long") - 1)
    return returns.join(F.broadcast(rows), "t")  # one row for each session


def cells(returns: DataFrame, *keys: str) -> DataFrame:
    """(cand_idx, keys, n, shift, gap, square): what the Sharpe ratio of any union of cells needs, a row for each cell.

    A cell's mean is `shift + gap`, with the candidate's overall mean as the shift, and `square` sums the squares of
    its deviations from the cell's mean. Splits, folds and windows combine cells, so no return row is copied for them.
    """
    made = returns.groupBy("cand_idx", *keys).agg(F.count("net").alias("n"), F.avg("net").alias("mean"), (F.var_pop("net") * F.count("net")).alias("square"))
    own = Window.partitionBy("cand_idx")
    shift = F.sum(F.col("n") * F.col("mean")).over(own) / F.sum("n").over(own)
    return made.withColumn("shift", shift).select("cand_idx", *keys, "n", "shift", (F.col("mean") - F.col("shift")).alias("gap"), "square")


def cells_sharpe(periods: float, where: Column | None = None) -> Column:
    """`risk.sharpe` over a group of cells, or over those that `where` holds for."""
    of = lambda c: F.sum(c if where is None else F.when(where, c))
    n, total, square = of(F.col("n")), of(F.col("n") * F.col("gap")), of(F.col("square") + F.col("n") * F.col("gap") * F.col("gap"))
    deviation = F.sqrt(F.greatest(square - total * total / n, F.lit(0.0)) / F.nullif(n - 1, F.lit(0)))
    return (F.first("shift") + total / n) / F.greatest(F.coalesce(deviation, F.lit(0.0)), F.lit(1e-12)) * F.lit(sqrt(periods))


def cscv_splits(spark: SparkSession, groups: int) -> DataFrame:
    """(split, group, side): every choice of half the groups as in-sample; split is the sum of 2 ** group of these."""
    rows = [(sum(1 << g for g in chosen), g, "in" if g in chosen else "out") for chosen in combinations(range(groups), groups // 2) for g in range(groups)]
    return spark.createDataFrame(rows, "split long, group long, side string")


def cscv(returns: DataFrame, groups: int, periods: float) -> DataFrame:
    """(split, cand_idx, in_sharpe, out_sharpe, rank, logit) of each split's in-sample winner.

    `rank` is the winner's mean-tie rank among all candidates out of sample, `logit` that of rank / (n + 1).
    """
    split = cells(grouped(returns, groups), "group").join(F.broadcast(cscv_splits(returns.sparkSession, groups)), "group")
    scored = split.groupBy("split", "cand_idx").agg(*[cells_sharpe(periods, F.col("side") == s).alias(f"{s}_exact") for s in ("in", "out")])
    scored = scored.select("split", "cand_idx", F.round("in_exact", 10).alias("in_sharpe"), F.round("out_exact", 10).alias("out_sharpe"))
    across, level = Window.partitionBy("split"), Window.partitionBy("split", "out_sharpe")
    ranked = scored.withColumn("rank", F.rank().over(across.orderBy("out_sharpe")) - 1 + (F.count("*").over(level) + 1) / 2).withColumn("n", F.count("*").over(across))
    share = F.col("rank") / (F.col("n") + 1)
    return best(ranked, ["split"], "in_sharpe").withColumn("logit", F.ln(share / (1 - share))).drop("n")


def overfitting_probability(winners: DataFrame) -> DataFrame:
    """(pbo, median_logit, splits): the share of splits whose winner ranks in the lower half out of sample."""
    return winners.agg((F.count_if(F.col("logit") <= 0) / F.count("*")).alias("pbo"), F.median("logit").alias("median_logit"), F.count("*").alias("splits"))


def deflated_statistic(returns: DataFrame, candidates: int) -> DataFrame:
    """(cand_idx, periodic_sharpe, expected_maximum, skewness, kurtosis, sessions, statistic) of the best candidate."""
    per = returns.groupBy("cand_idx").agg(
        sharpe("net", 1.0).alias("periodic_sharpe"), skew("net").alias("skewness"), raw_kurtosis("net").alias("kurtosis"), F.count("*").alias("sessions")
    )
    spread = per.agg(F.coalesce(F.stddev_samp("periodic_sharpe"), F.lit(0.0)).alias("deviation"))
    first = best(per.withColumn("all", F.lit(1)), ["all"], "periodic_sharpe").drop("all").join(F.broadcast(spread))
    s = F.col("periodic_sharpe")
    width = F.sqrt(F.greatest(1 - F.col("skewness") * s + (F.col("kurtosis") - 1) / 4 * s * s, F.lit(1e-12)))
    found = first.withColumn("expected_maximum", F.col("deviation") * expected_maximum_factor(candidates))
    return found.withColumn("statistic", (s - F.col("expected_maximum")) * F.sqrt(F.col("sessions") - 1) / width).drop("deviation")


def tested_sharpes(returns: DataFrame, n_groups: int, chosen: int, embargo: int, periods: float, minimum_train: int, windows: int) -> DataFrame:
    """One row: cpcv_median, cpcv_p10, cpcv_worst of the combinatorial paths, and walk_forward."""
    paths = combinatorial_selection(returns, n_groups, chosen, embargo, periods).agg(
        F.median("sharpe").alias("cpcv_median"), F.percentile("sharpe", F.lit(0.1)).alias("cpcv_p10"), F.min("sharpe").alias("cpcv_worst")
    )
    track = walk_forward_track(returns, walk_forward_selection(returns, minimum_train, windows, periods), minimum_train, windows)
    return paths.join(F.broadcast(track.agg(sharpe("net", periods).alias("walk_forward"))))  # two rows of one


def acceptance_evidence(
    tracked: DataFrame, candidates: int, periods: float, cscv_groups: int, n_groups: int, chosen: int, embargo: int, minimum_train: int, windows: int, cost: float = 3.0, stress: float = 5.0
) -> DataFrame:
    """One row with a column for each of RESEARCH_CHECKS, from two cost scenarios of `tracked`."""
    plain, hard = scenario(tracked, cost), scenario(tracked, stress)
    over = overfitting_probability(cscv(plain, cscv_groups, periods)).select("pbo")
    deflated = deflated_statistic(plain, candidates).select(normal_cdf_column(F.col("statistic")).alias("deflated_probability"))
    sharpes = lambda rows: tested_sharpes(rows, n_groups, chosen, embargo, periods, minimum_train, windows)
    stressed = sharpes(hard).select(F.col("cpcv_worst").alias("stress_cpcv_worst"), F.col("walk_forward").alias("stress_walk_forward"))
    return over.join(F.broadcast(deflated)).join(F.broadcast(sharpes(plain))).join(F.broadcast(stressed))  # rows of one


def deflated_probability(statistic: float) -> float:
    return normal_cdf(statistic)


def required_sessions(periodic_sharpe: float, expected_maximum: float, skewness: float, kurtosis: float, probability: float) -> int | None:
    """How long a track record reaches `probability`; None if the Sharpe ratio does not exceed the expected maximum."""
    excess = periodic_sharpe - expected_maximum
    if excess <= 0:
        return None
    width = sqrt(max(1 - skewness * periodic_sharpe + (kurtosis - 1) / 4 * periodic_sharpe**2, 1e-12))
    return ceil(1 + (NormalDist().inv_cdf(probability) * width / excess) ** 2)


def strategy_roles(spark: SparkSession, n_groups: int, chosen: int) -> DataFrame:
    """(fold, group, is_test) of every combination."""
    rows = [(f, g, g in c) for f, c in enumerate(combinations(range(n_groups), chosen)) for g in range(n_groups)]
    return spark.createDataFrame(rows, "fold long, group long, is_test boolean")


def combinatorial_selection(returns: DataFrame, n_groups: int, chosen: int, embargo: int, periods: float) -> DataFrame:
    """(path, sharpe, total_return, max_drawdown, n): each path strings together what its combinations' winners earned.

    Winners are picked on the rows outside the test groups, without the `embargo` rows after each test group.
    """
    spark = returns.sparkSession
    rows = grouped(returns, n_groups)
    roles = strategy_roles(spark, n_groups, chosen)
    # the groups after which a row comes too soon
    ends = rows.groupBy("group").agg(F.max("t").alias("end"))
    soon = ends.select(F.col("group").alias("after"), F.explode(F.sequence(F.col("end") + 1, F.col("end") + F.lit(max(embargo, 1)))).alias("t")).groupBy("t").agg(F.array_sort(F.collect_set("after")).alias("after"))
    marked = rows.join(F.broadcast(soon), "t", "left") if embargo else rows.withColumn("after", F.lit(None).cast("array<long>"))  # embargoed sessions only
    tests = roles.groupBy("fold").agg(F.collect_list(F.when(F.col("is_test"), F.col("group"))).alias("tests"))
    folds = roles.where("not is_test").join(tests, "fold").select("fold", "group", "tests")  # at most max_combinations folds
    train = cells(marked, "group", "after").join(F.broadcast(folds), "group").where(~F.coalesce(F.arrays_overlap("after", "tests"), F.lit(False)))
    winners = best(train.groupBy("fold", "cand_idx").agg(cells_sharpe(periods).alias("score")), ["fold"]).select("fold", "cand_idx")
    table = spark.createDataFrame(path_table(list(combinations(range(n_groups), chosen)), n_groups), "fold long, group long, path long")
    earned = rows.join(F.broadcast(table.join(winners, "fold")), ["group", "cand_idx"]).select("path", "t", "net", "turnover")
    return candidate_metrics(earned, periods, ("path",)).join(earned.groupBy("path").agg(F.count("*").alias("n")), "path")


def walk_forward_selection(returns: DataFrame, minimum_train: int, windows: int, periods: float) -> DataFrame:
    """(window, selected, hindsight, selected_sharpe, hindsight_sharpe, regret) of each later window.

    The selected candidate is the best on all rows before the window, the hindsight one the best in it.
    """
    later = returns.where(F.col("t") >= minimum_train).select("t").distinct().withColumn("window", F.ntile(windows).over(Window.orderBy("t")).cast("long") - 1)
    # every cell trains the windows after its own, rows before the first window all of them
    numbered = cells(returns.join(F.broadcast(later), "t", "left").withColumn("own", F.coalesce("window", F.lit(-1).cast("long"))), "own")
    train = numbered.withColumn("window", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(windows - 1).cast("long")), lambda w: w > F.col("own"))))
    picked = best(train.groupBy("window", "cand_idx").agg(cells_sharpe(periods).alias("score")), ["window"]).select("window", F.col("cand_idx").alias("selected"))
    inside = returns.join(F.broadcast(later), "t").groupBy("window", "cand_idx").agg(sharpe("net", periods).alias("score"))
    top = best(inside, ["window"]).select("window", F.col("cand_idx").alias("hindsight"), F.col("score").alias("hindsight_sharpe"))
    own = inside.join(picked.withColumnRenamed("selected", "cand_idx"), ["window", "cand_idx"]).select("window", F.col("cand_idx").alias("selected"), F.col("score").alias("selected_sharpe"))
    return own.join(top, "window").withColumn("regret", F.col("hindsight_sharpe") - F.col("selected_sharpe"))


def walk_forward_track(returns: DataFrame, selection: DataFrame, minimum_train: int, windows: int) -> DataFrame:
    """(t, net, turnover) of the selected candidates, window after window."""
    later = returns.where(F.col("t") >= minimum_train).select("t").distinct().withColumn("window", F.ntile(windows).over(Window.orderBy("t")).cast("long") - 1)
    chosen = later.join(selection.select("window", "selected"), "window")
    return returns.join(F.broadcast(chosen), "t").where("cand_idx = selected").select("t", "net", "turnover")


#: The checks of a research decision: name, whether a larger value is better, and its threshold.
RESEARCH_CHECKS = (
    ("pbo", False, 0.20), ("deflated_probability", True, 0.95), ("cpcv_median", True, 0.0), ("cpcv_p10", True, 0.0), ("cpcv_worst", True, 0.0),
    ("walk_forward", True, 0.0), ("stress_cpcv_worst", True, 0.0), ("stress_walk_forward", True, 0.0),
)


def acceptance_checks(evidence: DataFrame, checks=RESEARCH_CHECKS) -> DataFrame:
    """(check, value, threshold, passed) of one row of evidence; missing or NaN values fail."""
    each = [F.struct(F.lit(n).alias("check"), F.col(n).cast("double").alias("value"), F.lit(t).alias("threshold"), (F.col(n) >= t if up else F.col(n) <= t).alias("passed")) for n, up, t in checks]
    rows = evidence.select(F.explode(F.array(*each)).alias("c")).select("c.*")
    return rows.withColumn("passed", F.coalesce(F.col("passed") & ~F.isnan("value"), F.lit(False)))


def decision(checks: DataFrame, holdout: str = "NOT_RUN") -> tuple[str, str]:
    """(research, production) status; production needs an untouched holdout that passed."""
    research = "PASS" if checks.agg(F.bool_and("passed")).first()[0] else "FAIL"
    if research == "FAIL" or holdout in ("UNTOUCHED_FAIL", "REUSED"):
        return research, "FAIL"
    return research, "PASS" if holdout == "UNTOUCHED_PASS" else "INCONCLUSIVE"
