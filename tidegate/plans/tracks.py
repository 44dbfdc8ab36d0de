"""Queries on time-series momentum tracks of the weekly panel: selection, overfitting, acceptance."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.risk import expected_maximum_factor
from tidegate.operators import panel, strategy
from tidegate.operators.paths import path_table
from tidegate.plans.weekly import weekly_panel
from tidegate.session import kept

GRID = strategy.grid((5, 21), (5, 20), (5,), (0.12, 0.5))
EXECUTION = strategy.Execution(periods=52.0, target_vol=0.10)
COST = 3.0
GROUPS, TEST_GROUPS, EMBARGO, CSCV, MINIMUM, WINDOWS = 6, 2, 3, 8, 104, 4


def dense_panel(spark, sf_dir) -> DataFrame:
    """(t, session, asset, price, ret) of the weeks in which all assets trade; the first return is 0.

    Weeks in which an asset is missing are left out, where `strategy.require_dense` would refuse the panel: the tables
    have such weeks at both ends. Panel and dense rows are tables, so the base table is read once.
    """
    rows = kept(panel.dense_sessions(kept(weekly_panel(spark, sf_dir), "panel")), "dense")
    order = rows.select("session").distinct().withColumn("t", F.row_number().over(Window.orderBy("session")).cast("long") - 1)
    own = Window.partitionBy("asset").orderBy("t")
    return rows.join(F.broadcast(order), "session").withColumn("ret", F.coalesce(F.col("price") / F.lag("price", 1).over(own) - 1, F.lit(0.0)))


def returns(spark, sf_dir, costs=(COST,)) -> DataFrame:
    """The candidates' tracks as a table: a row for each session, candidate and cost."""
    return kept(strategy.tracks(strategy.weights(kept(dense_panel(spark, sf_dir), "dense"), GRID, EXECUTION), list(costs)), "tracks")


def _r(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + 0.0, places) for n in names})


def tsmom_grid(spark, sf_dir):
    """Each candidate and how many of the panel's sessions come after its warm-up."""
    length = dense_panel(spark, sf_dir).agg(F.count_distinct("t").alias("sessions"))
    table = strategy.candidate_table(spark, GRID)
    return table.join(F.broadcast(length)).select("cand_idx", "candidate_id", "lookback", "vol_window", "cap", "warmup", F.greatest(F.col("sessions") - F.col("warmup"), F.lit(0)).alias("tradable_sessions"))


def tsmom_weights(spark, sf_dir):
    return _r(strategy.weights(dense_panel(spark, sf_dir), GRID, EXECUTION), "weight", places=8).select("t", "asset", "cand_idx", "weight")


def tsmom_returns(spark, sf_dir):
    return _r(returns(spark, sf_dir), "gross", "net", "turnover", places=8).select("t", "cand_idx", "candidate_id", "gross", "net", "turnover")


def tsmom_cost_scenarios(spark, sf_dir):
    rows = returns(spark, sf_dir, (0.0, 1.0, 3.0, 5.0))
    found = strategy.candidate_metrics(rows, EXECUTION.periods, ("cost_bps", "cand_idx"))
    return _r(found, "sharpe", "total_return", "mean_turnover", "max_drawdown")


def candidate_metrics(spark, sf_dir):
    return _r(strategy.candidate_metrics(returns(spark, sf_dir), EXECUTION.periods), "sharpe", "total_return", "mean_turnover", "max_drawdown")


def max_drawdown(spark, sf_dir):
    from tidegate.functions.risk import drawdowns

    return _r(drawdowns(returns(spark, sf_dir), "net", ["cand_idx"], "t"), "max_drawdown", places=8)


def cscv_splits(spark, sf_dir):
    found = strategy.cscv(returns(spark, sf_dir), CSCV, EXECUTION.periods)
    return _r(found, "in_sharpe", "out_sharpe", "logit").select("split", "cand_idx", "in_sharpe", "out_sharpe", F.col("rank").cast("double").alias("rank"), "logit")


def pbo(spark, sf_dir):
    return _r(strategy.overfitting_probability(strategy.cscv(returns(spark, sf_dir), CSCV, EXECUTION.periods)), "pbo", "median_logit")


def deflated_sharpe_statistic(spark, sf_dir):
    return _r(strategy.deflated_statistic(returns(spark, sf_dir), len(GRID)), "periodic_sharpe", "skewness", "kurtosis", "expected_maximum", "statistic", places=6)


def cpcv_selected_paths(spark, sf_dir):
    found = strategy.combinatorial_selection(returns(spark, sf_dir), GROUPS, TEST_GROUPS, EMBARGO, EXECUTION.periods)
    return _r(found, "sharpe", "total_return", "max_drawdown", "mean_turnover")


def walk_forward_selection(spark, sf_dir):
    return _r(strategy.walk_forward_selection(returns(spark, sf_dir), MINIMUM, WINDOWS, EXECUTION.periods), "selected_sharpe", "hindsight_sharpe", "regret")


CHECKS = strategy.RESEARCH_CHECKS
STRESS = 5.0


def acceptance_checks(spark, sf_dir):
    """All checks of a research decision: six at the plain cost, two at the stressed one."""
    rows = returns(spark, sf_dir, (COST, STRESS))
    found = strategy.acceptance_evidence(rows, len(GRID), EXECUTION.periods, CSCV, GROUPS, TEST_GROUPS, EMBARGO, MINIMUM, WINDOWS, COST, STRESS)
    return _r(strategy.acceptance_checks(found, CHECKS), "value")


# --- SQL -----------------------------------------------------------------------------------------------------

_GRID = ", ".join(f"({i}, '{c.name}', {c.lookback}, {c.vol_window}, {c.rebalance}, {c.cap}::DOUBLE, {c.warmup})" for i, c in enumerate(GRID))
_LAGS = ", ".join(f"lag(price, {1 + n}) OVER w AS p{n}" for n in (5, 21))
_VOLS = ", ".join(f"stddev_samp(ret) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN {v} PRECEDING AND 1 PRECEDING) AS v{v}" for v in (5, 20))
P = EXECUTION.periods
TRACKS = f"""
p AS (SELECT date_trunc('week', l_shipdate)::DATE AS session, l_returnflag || l_linestatus AS asset, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY 1, 2),
full_weeks AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS t FROM (SELECT session FROM p GROUP BY session HAVING count(*) = (SELECT count(DISTINCT asset) FROM p))),
d AS (SELECT t, p.asset, price, coalesce(price / lag(price) OVER (PARTITION BY p.asset ORDER BY t) - 1, 0.0) AS ret FROM p JOIN full_weeks f ON p.session = f.session),
g(cand_idx, candidate_id, lookback, vol_window, rebalance, cap, warmup) AS (VALUES {_GRID}),
e AS (SELECT *, lag(price, 1) OVER w AS last_price, {_LAGS}, {_VOLS} FROM d WINDOW w AS (PARTITION BY asset ORDER BY t)),
c AS (SELECT t, asset, ret, cand_idx::BIGINT AS cand_idx, candidate_id, CASE WHEN t >= warmup AND (t - warmup) % rebalance = 0 THEN
   sign(last_price / CASE lookback WHEN 5 THEN p5 ELSE p21 END - 1) * CASE WHEN CASE vol_window WHEN 5 THEN v5 ELSE v20 END > 1e-12 THEN least({EXECUTION.target_vol} / (CASE vol_window WHEN 5 THEN v5 ELSE v20 END * sqrt({P})), cap) ELSE 0 END
   / (SELECT count(DISTINCT asset) FROM d) END AS chosen FROM e, g),
wt AS (SELECT *, coalesce(last_value(chosen IGNORE NULLS) OVER (PARTITION BY cand_idx, asset ORDER BY t ROWS UNBOUNDED PRECEDING), 0.0) AS weight FROM c),
mv AS (SELECT *, abs(weight - lag(weight, 1, 0.0) OVER (PARTITION BY cand_idx, asset ORDER BY t)) AS moved FROM wt),
free AS (SELECT t, cand_idx, candidate_id, sum(weight * ret) AS gross, sum(moved) AS turnover FROM mv GROUP BY 1, 2, 3),
r AS (SELECT *, gross - turnover * {COST} / 10000 AS net FROM free)"""
SHARPE = f"avg(net) / greatest(coalesce(stddev_samp(net), 0), 1e-12) * sqrt({P})"


def _metrics_sql(source: str, keys: str) -> str:
    on = " AND ".join(f"m.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    return f""", wl AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY {keys} ORDER BY t)) AS wealth FROM {source}), pk AS (SELECT *, greatest(max(wealth) OVER (PARTITION BY {keys} ORDER BY t), 1.0) AS peak FROM wl),
    mt AS (SELECT {", ".join("m." + k.strip() for k in keys.split(","))}, round(m.sharpe + 0.0, 6) AS sharpe, round(m.total_return + 0.0, 6) AS total_return, round(m.mean_turnover + 0.0, 6) AS mean_turnover, w.mdd, m.n, m.sharpe AS exact
      FROM (SELECT {keys}, {SHARPE} AS sharpe, product(1 + net) - 1 AS total_return, avg(turnover) AS mean_turnover, count(*) AS n FROM {source} GROUP BY {keys}) m JOIN (SELECT {keys}, max(1 - wealth / peak) AS mdd FROM pk GROUP BY {keys}) w ON {on})"""


CSCV_SQL = f""", gr AS (SELECT t, ntile({CSCV}) OVER (ORDER BY t) - 1 AS g FROM (SELECT DISTINCT t FROM r)), masks AS (SELECT m FROM (SELECT unnest(range({1 << CSCV})) AS m) WHERE bit_count(m::INTEGER) = {CSCV // 2}),
 io AS (SELECT m AS split, cand_idx, round(avg(net) FILTER (m >> g & 1 = 1) / greatest(coalesce(stddev_samp(net) FILTER (m >> g & 1 = 1), 0), 1e-12) * sqrt({P}), 10) AS in_sharpe,
   round(avg(net) FILTER (m >> g & 1 = 0) / greatest(coalesce(stddev_samp(net) FILTER (m >> g & 1 = 0), 0), 1e-12) * sqrt({P}), 10) AS out_sharpe FROM r JOIN gr ON r.t = gr.t, masks GROUP BY 1, 2),
 win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY in_sharpe DESC, cand_idx) AS place FROM io) WHERE place = 1),
 lg AS (SELECT w.split, w.cand_idx, w.in_sharpe, w.out_sharpe, (SELECT count(*) FROM io o WHERE o.split = w.split AND o.out_sharpe < w.out_sharpe) + ((SELECT count(*) FROM io o WHERE o.split = w.split AND o.out_sharpe = w.out_sharpe) + 1) / 2.0 AS rank FROM win w),
 cs AS (SELECT *, ln((rank / {len(GRID) + 1}.0) / (1 - rank / {len(GRID) + 1}.0)) AS logit FROM lg)"""

_PATHS = ", ".join(map(str, path_table(list(combinations(range(GROUPS), TEST_GROUPS)), GROUPS)))
CPCV_SQL = f""", g6 AS (SELECT t, ntile({GROUPS}) OVER (ORDER BY t) - 1 AS g FROM (SELECT DISTINCT t FROM r)), pt(fold, g, path) AS (VALUES {_PATHS}),
 fe AS (SELECT pt.fold, max(g6.t) AS fin FROM pt JOIN g6 ON pt.g = g6.g GROUP BY pt.fold, pt.g),
 tr AS (SELECT f.fold, r.* FROM r JOIN g6 ON r.t = g6.t, (SELECT DISTINCT fold FROM pt) f WHERE NOT EXISTS (SELECT 1 FROM pt WHERE pt.fold = f.fold AND pt.g = g6.g) AND NOT EXISTS (SELECT 1 FROM fe WHERE fe.fold = f.fold AND r.t > fe.fin AND r.t <= fe.fin + {EMBARGO})),
 wn AS (SELECT fold, cand_idx FROM (SELECT fold, cand_idx, row_number() OVER (PARTITION BY fold ORDER BY round({SHARPE}, 10) DESC, cand_idx) AS place FROM tr GROUP BY fold, cand_idx) WHERE place = 1),
 ea AS (SELECT pt.path::BIGINT AS path, r.t, r.net, r.turnover FROM pt JOIN wn ON pt.fold = wn.fold JOIN g6 ON g6.g = pt.g JOIN r ON r.t = g6.t AND r.cand_idx = wn.cand_idx)"""

WALK_SQL = f""", lt AS (SELECT t, ntile({WINDOWS}) OVER (ORDER BY t) - 1 AS win FROM (SELECT DISTINCT t FROM r WHERE t >= {MINIMUM})), st AS (SELECT win, min(t) AS start FROM lt GROUP BY win),
 sel AS (SELECT win, cand_idx AS selected FROM (SELECT win, cand_idx, row_number() OVER (PARTITION BY win ORDER BY round({SHARPE}, 10) DESC, cand_idx) AS place FROM r JOIN st ON r.t < st.start GROUP BY win, cand_idx) WHERE place = 1),
 ins AS (SELECT win, cand_idx, {SHARPE} AS score FROM r JOIN lt ON r.t = lt.t GROUP BY win, cand_idx),
 top AS (SELECT * FROM (SELECT win, cand_idx AS hindsight, score, row_number() OVER (PARTITION BY win ORDER BY round(score, 10) DESC, cand_idx) AS place FROM ins) WHERE place = 1),
 wf AS (SELECT sel.win AS "window", selected, hindsight, i.score AS selected_sharpe, top.score AS hindsight_sharpe, top.score - i.score AS regret FROM sel JOIN ins i ON i.win = sel.win AND i.cand_idx = sel.selected JOIN top ON top.win = sel.win)"""



def _tested_sql(cost: float) -> str:
    """The combinatorial and walk-forward Sharpe ratios at a cost, as one row of four."""
    return f"""(SELECT * FROM (WITH {TRACKS.replace(f"turnover * {COST}", f"turnover * {cost}")}{CPCV_SQL}{WALK_SQL},
      ps AS (SELECT path, {SHARPE} AS sharpe FROM ea GROUP BY path), tk AS (SELECT r.net FROM r JOIN lt ON r.t = lt.t JOIN sel ON sel.win = lt.win AND sel.selected = r.cand_idx)
      SELECT median(sharpe) AS med, quantile_cont(sharpe, 0.1) AS p10, min(sharpe) AS worst, (SELECT {SHARPE} FROM tk) AS walk FROM ps))"""


#: The normal distribution function of x: 1/2 + density * sum of x^(2k+1) / (1 * 3 * ... * (2k+1)), the double factorial by lgamma.
NORMAL = """0.5 + exp(-x * x / 2) / sqrt(2 * pi()) * sign(x) * coalesce((SELECT sum(exp((2 * k + 1) * ln(abs(x)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))) FROM range(121) q(k) WHERE x <> 0), 0)"""


def _acceptance_sql() -> str:
    levels = {n: (up, t) for n, up, t in CHECKS}
    rows = " UNION ALL ".join(f"""SELECT '{n}' AS "check", {v} AS value FROM ev""" for n, v in (
        ("pbo", "pbo"), ("deflated_probability", f"(SELECT {NORMAL} FROM (SELECT greatest(least(statistic, 7), -7) AS x FROM ev))"), ("cpcv_median", "med"), ("cpcv_p10", "p10"), ("cpcv_worst", "worst"),
        ("walk_forward", "walk"), ("stress_cpcv_worst", "hard_worst"), ("stress_walk_forward", "hard_walk"),
    ))
    least = " ".join(f"WHEN '{n}' THEN {t}" for n, (_, t) in levels.items())
    return f"""WITH ev AS (SELECT (SELECT count(*) FILTER (logit <= 0) / count(*) FROM (WITH {TRACKS}{CSCV_SQL} SELECT logit FROM cs)) AS pbo, (SELECT statistic FROM ({DEFLATED_SQL})) AS statistic,
      a.med, a.p10, a.worst, a.walk, b.worst AS hard_worst, b.walk AS hard_walk FROM {_tested_sql(COST)} a, {_tested_sql(STRESS)} b), c AS ({rows}), d AS (SELECT *, (CASE "check" {least} END)::DOUBLE AS threshold FROM c)
      SELECT "check", round(value + 0.0, 6) AS value, threshold, CASE WHEN "check" = 'pbo' THEN value <= threshold ELSE value >= threshold END AS passed FROM d"""


DEFLATED_SQL = f"""WITH {TRACKS}, q AS (SELECT cand_idx, avg(net) / greatest(coalesce(stddev_samp(net), 0), 1e-12) AS s, avg(net) AS m, stddev_pop(net) AS sd, count(*) AS sessions FROM r GROUP BY cand_idx),
      b AS (SELECT * FROM q ORDER BY round(s, 10) DESC, cand_idx LIMIT 1), mo AS (SELECT b.*, avg(pow((r.net - b.m) / b.sd, 3)) AS skewness, avg(pow((r.net - b.m) / b.sd, 4)) AS kurtosis FROM r JOIN b ON r.cand_idx = b.cand_idx GROUP BY ALL),
      x AS (SELECT *, (SELECT stddev_samp(s) FROM q) * {expected_maximum_factor(len(GRID))!r} AS em FROM mo)
      SELECT cand_idx, s, em, skewness, kurtosis, sessions, (s - em) * sqrt(sessions - 1) / sqrt(greatest(1 - skewness * s + (kurtosis - 1) / 4 * s * s, 1e-12)) AS statistic FROM x"""

SQL = {
    "tsmom_grid": f"WITH {TRACKS} SELECT cand_idx::BIGINT AS cand_idx, candidate_id, lookback::BIGINT AS lookback, vol_window::BIGINT AS vol_window, cap, warmup::BIGINT AS warmup, greatest((SELECT count(*) FROM full_weeks) - warmup, 0)::BIGINT AS tradable_sessions FROM g",
    "tsmom_weights": f"WITH {TRACKS} SELECT t, asset, cand_idx, round(weight + 0.0, 8) AS weight FROM wt",
    "tsmom_returns": f"WITH {TRACKS} SELECT t, cand_idx, candidate_id, round(gross + 0.0, 8) AS gross, round(net + 0.0, 8) AS net, round(turnover + 0.0, 8) AS turnover FROM r",
    "tsmom_cost_scenarios": f"WITH {TRACKS}, rc AS (SELECT t, cand_idx, turnover, cost_bps, gross - turnover * cost_bps / 10000 AS net FROM free, (SELECT unnest([0.0, 1.0, 3.0, 5.0])::DOUBLE AS cost_bps))"
    + _metrics_sql("rc", "cost_bps, cand_idx")
    + " SELECT cost_bps, cand_idx, sharpe, total_return, mean_turnover, round(mdd, 6) AS max_drawdown FROM mt",
    "candidate_metrics": f"WITH {TRACKS}" + _metrics_sql("r", "cand_idx, candidate_id") + " SELECT cand_idx, candidate_id, sharpe, total_return, mean_turnover, round(mdd, 6) AS max_drawdown FROM mt",
    "max_drawdown": f"WITH {TRACKS}" + _metrics_sql("r", "cand_idx") + " SELECT cand_idx, round(mdd, 8) AS max_drawdown FROM mt",
    "cscv_splits": f"WITH {TRACKS}{CSCV_SQL} SELECT split, cand_idx, round(in_sharpe + 0.0, 6) AS in_sharpe, round(out_sharpe + 0.0, 6) AS out_sharpe, rank::DOUBLE AS rank, round(logit + 0.0, 6) AS logit FROM cs",
    "pbo": f"WITH {TRACKS}{CSCV_SQL} SELECT round(count(*) FILTER (logit <= 0) / count(*), 6) AS pbo, round(median(logit) + 0.0, 6) AS median_logit, count(*) AS splits FROM cs",
    "deflated_sharpe_statistic": f"""WITH {TRACKS}, q AS (SELECT cand_idx, avg(net) / greatest(coalesce(stddev_samp(net), 0), 1e-12) AS s, avg(net) AS m, stddev_pop(net) AS sd, count(*) AS sessions FROM r GROUP BY cand_idx),
      b AS (SELECT * FROM q ORDER BY round(s, 10) DESC, cand_idx LIMIT 1), mo AS (SELECT b.*, avg(pow((r.net - b.m) / b.sd, 3)) AS skewness, avg(pow((r.net - b.m) / b.sd, 4)) AS kurtosis FROM r JOIN b ON r.cand_idx = b.cand_idx GROUP BY ALL),
      x AS (SELECT *, (SELECT stddev_samp(s) FROM q) * {expected_maximum_factor(len(GRID))!r} AS em FROM mo)
      SELECT cand_idx, round(s, 6) AS periodic_sharpe, round(em, 6) AS expected_maximum, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, sessions, round((s - em) * sqrt(sessions - 1) / sqrt(greatest(1 - skewness * s + (kurtosis - 1) / 4 * s * s, 1e-12)), 6) AS statistic FROM x""",
    "cpcv_selected_paths": f"WITH {TRACKS}{CPCV_SQL}" + _metrics_sql("ea", "path") + " SELECT path, n, sharpe, total_return, mean_turnover, round(mdd, 6) AS max_drawdown FROM mt",
    "walk_forward_selection": f'WITH {TRACKS}{WALK_SQL} SELECT "window", selected, hindsight, round(selected_sharpe, 6) AS selected_sharpe, round(hindsight_sharpe, 6) AS hindsight_sharpe, round(regret, 6) AS regret FROM wf',
    "acceptance_checks": _acceptance_sql(),
}
DATES: dict[str, tuple[str, ...]] = {}
QUERIES = {n: f for n, f in globals().items() if n in SQL}
