"""Queries on the weekly shipment-price panel: splits, models, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.model import CombinatorialCV, Minimums, PurgedKFold, WalkForward, data_digest
from tidegate.operators import evaluate, mergeable, metrics, panel, splits
from tidegate.operators.boosting import LeafwiseTrees
from tidegate.plans.benchmarks import channel_benchmark, channel_folds, effectiveness, family_benchmark
from tidegate.operators.paths import path_table, paths
from tidegate.plans import release
from tidegate.session import kept, shared_path

LOOKBACK, HORIZON = 4, 2
KFOLD = PurgedKFold(5, embargo=8)
CPCV = CombinatorialCV(6, 2, embargo=8)
WALK = WalkForward(5, test_sessions=20, gap=3)
SLIDING = WalkForward(4, test_sessions=15, gap=2, max_train_sessions=60)
PERIODS = 52.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, asset, price): mean extended price of each week and shipment state."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.date_trunc("week", "l_shipdate").cast("date").alias("session"), F.concat("l_returnflag", "l_linestatus").alias("asset"), "l_extendedprice"
    )
    return lines.groupBy("session", "asset").agg(F.round(F.avg("l_extendedprice"), 4).alias("price"))


def samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The panel's samples and its axis, as tables: whatever uses them often, the base table is read once."""
    prices = kept(weekly_panel(spark, sf_dir), "panel")
    axis = kept(panel.session_axis(prices), "axis")
    return kept(panel.axis_samples(prices, axis, LOOKBACK, HORIZON), "samples"), axis


def modelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Samples that have both a return and a target, for models."""
    data, axis = samples(spark, sf_dir)
    return data.where("ret is not null and target is not null"), axis


def _planned(data: DataFrame, axis: DataFrame, spec) -> DataFrame:
    """A splitter's decided folds as a table: a row for each fold and distinct interval."""
    return kept(splits.plan(data, axis, spec), "folds")


def purged_kfold_exclusions(spark, sf_dir):
    data, axis = samples(spark, sf_dir)
    return splits.summary(splits.plan(data, axis, KFOLD))


def purged_kfold_assignments(spark, sf_dir):
    data, axis = samples(spark, sf_dir)
    return splits.assignments(data, splits.plan(data, axis, KFOLD)).select("fold", "asset", "session", "role", "reason")


def cpcv_combinations(spark, sf_dir):
    data, _ = samples(spark, sf_dir)
    roles = splits.cpcv_roles(data, CPCV).where("role = 'test'")
    return roles.groupBy("fold").agg(F.min("group").alias("first_group"), F.max("group").alias("second_group"), F.count_distinct("axis_pos").alias("test_sessions"))


def cpcv_test_blocks(spark, sf_dir):
    data, _ = samples(spark, sf_dir)
    return splits.blocks(data, splits.cpcv_roles(data, CPCV))


def cpcv_exclusions(spark, sf_dir):
    data, axis = samples(spark, sf_dir)
    return splits.summary(splits.plan(data, axis, CPCV))


def cpcv_paths(spark, sf_dir):
    data, _ = samples(spark, sf_dir)
    sessions = splits.active_sessions(data, CPCV.n_groups)
    return paths(spark, CPCV.choices, CPCV.n_groups).join(sessions, "group").groupBy("fold", "group", "path").agg(F.count("*").alias("sessions"), F.min("session").alias("first_session"))


def cpcv_path_invariants(spark, sf_dir):
    """Per path: rows tested, distinct samples and combinations; each path tests every sample once."""
    data, axis = samples(spark, sf_dir)
    tests = splits.assignments(data, splits.plan(data, axis, CPCV)).where("role = 'test'")
    placed = tests.join(F.broadcast(paths(spark, CPCV.choices, CPCV.n_groups)), ["fold", "group"])
    return placed.groupBy("path").agg(F.count("*").alias("tested_rows"), F.count_distinct("asset", "session").alias("samples"), F.count_distinct("group").alias("groups"))


def walk_forward_exclusions(spark, sf_dir):
    data, axis = samples(spark, sf_dir)
    return splits.summary(splits.plan(data, axis, WALK))


def walk_forward_sliding(spark, sf_dir):
    data, axis = samples(spark, sf_dir)
    return splits.summary(splits.plan(data, axis, SLIDING))


def fold_validity(spark, sf_dir):
    data, axis = samples(spark, sf_dir)
    return splits.fold_validity(splits.plan(data, axis, KFOLD), Minimums(train_samples=1620, train_sessions=100, test_sessions=10))


def training_sufficiency(spark, sf_dir):
    data, axis = samples(spark, sf_dir)
    return metrics.training_sufficiency(splits.assignments(data, splits.plan(data, axis, WALK)))


def sufficiency_summary(spark, sf_dir):
    return metrics.sufficiency_summary(training_sufficiency(spark, sf_dir))


def group_breadth(spark, sf_dir):
    data, _ = samples(spark, sf_dir)
    return metrics.group_breadth(data, splits.active_sessions(data, CPCV.n_groups).select("axis_pos", "group"))


def chronological_no_purge_overlap(spark, sf_dir):
    data, axis = samples(spark, sf_dir)
    return splits.retained_overlap(splits.decide(data, axis, splits.walk_forward_roles(data, WALK), purge=False))


def unsafe_shuffled_overlap(spark, sf_dir):
    data, axis = samples(spark, sf_dir)
    return splits.retained_overlap(splits.decide(data, axis, splits.shuffled_roles(data, 5), purge=False))


def safe_channel_overlap(spark, sf_dir):
    """Retained training rows that meet a test interval, for each safe splitter; all zero."""
    data, axis = samples(spark, sf_dir)
    found = [splits.retained_overlap(splits.plan(data, axis, s)).agg(F.sum("overlap").alias("overlap")).select(F.lit(n).alias("channel"), "overlap") for n, s in (("kfold", KFOLD), ("cpcv", CPCV), ("walk", WALK))]
    return found[0].union(found[1]).union(found[2])


def holdout_split(spark, sf_dir):
    """Holdout: the last 40 sessions; development: rows whose information ends before any of the holdout begins."""
    data, _ = samples(spark, sf_dir)
    last = data.select("session").distinct().orderBy(F.desc("session")).limit(40)
    held = data.join(F.broadcast(last), "session", "left_semi")
    start = held.agg(F.min("info_start").alias("start"))
    rest = data.join(F.broadcast(last), "session", "left_anti").join(F.broadcast(start)).withColumn("part", F.when(F.col("info_end") < F.col("start"), "development").otherwise("between"))
    both = rest.select("part", "session").union(held.select(F.lit("holdout"), "session"))
    return both.groupBy("part").agg(F.count("*").alias("samples"), F.count_distinct("session").alias("sessions"))


def holdout_boundary(spark, sf_dir):
    data, _ = samples(spark, sf_dir)
    last = data.select("session").distinct().orderBy(F.desc("session")).limit(40)
    held = data.join(F.broadcast(last), "session", "left_semi").agg(F.min("session").alias("first_holdout"), F.min("info_start").alias("holdout_information"))
    rest = data.join(F.broadcast(last), "session", "left_anti").join(F.broadcast(held)).where("info_end < holdout_information")
    return rest.groupBy("first_holdout", "holdout_information").agg(F.max("session").alias("last_development"), F.max("info_end").alias("development_information"), F.count("*").alias("development_rows"))


def _kfold_assigned(spark, sf_dir):
    data, axis = modelled(spark, sf_dir)
    return splits.assignments(data, _planned(data, axis, KFOLD))


def mean_model_mse(spark, sf_dir):
    found = evaluate.mean_predictions(_kfold_assigned(spark, sf_dir))
    return found.groupBy("fold").agg(F.round(metrics.mse(), 9).alias("mse"), F.count("*").alias("n"))


def ridge1_predictions(spark, sf_dir):
    found = evaluate.ridge_predictions(_kfold_assigned(spark, sf_dir), ["ret"], 1.0)
    return found.select("fold", "asset", "session", F.round(F.col("prediction") + 0.0, 6).alias("prediction"))


def _cpcv_ledger(spark, sf_dir):
    data, axis = modelled(spark, sf_dir)
    found = evaluate.ridge_predictions(splits.assignments(data, _planned(data, axis, CPCV)), ["ret"], 1.0)
    return kept(found.join(F.broadcast(paths(spark, CPCV.choices, CPCV.n_groups)), ["fold", "group"]), "predictions")


def ridge_mse_grouping_sets(spark, sf_dir):
    """Errors overall, by fold and by group of the combinatorial ridge."""
    rows = _cpcv_ledger(spark, sf_dir).drop("path").withColumnRenamed("group", "path")
    return metrics.scoped_mse(rows).select(F.when(F.col("scope") == "path", "group").otherwise(F.col("scope")).alias("scope"), "key", F.round("value", 9).alias("value"), "n")


def _walk_ledger(spark, sf_dir):
    data, axis = modelled(spark, sf_dir)
    return kept(evaluate.ridge_predictions(splits.assignments(data, _planned(data, axis, WALK)), ["ret"], 1.0), "predictions")


def session_spearman_ic(spark, sf_dir):
    return metrics.session_ic(_walk_ledger(spark, sf_dir), ["fold"]).select("fold", "session", "n", F.round(F.col("ic") + 0.0, 8).alias("ic"))


def diagnostic_sharpe(spark, sf_dir):
    rows = metrics.session_returns(_walk_ledger(spark, sf_dir), ["fold"])
    return rows.groupBy("fold").agg(F.round(metrics.sharpe("ret", PERIODS), 6).alias("sharpe"), F.count("*").alias("sessions"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + 0.0, 6) for n in names})


def financial_metrics(spark, sf_dir):
    return _rounded(metrics.financial_metrics(_walk_ledger(spark, sf_dir), ["fold"], PERIODS), "mse", "ic", "sharpe")


def path_distribution(spark, sf_dir):
    """Spread over the combinations of the scores of each; paths partition the same rows."""
    found = metrics.financial_metrics(_cpcv_ledger(spark, sf_dir), ["fold"], PERIODS)
    return _rounded(metrics.distribution(found, []), "median", "worst", "std", "p10", "p90")


def common_view_metrics(spark, sf_dir):
    """The k-fold ridge scored on the samples that the walk-forward one scored."""
    scored = _walk_ledger(spark, sf_dir).select("asset", "session").distinct()
    rows = kept(evaluate.ridge_predictions(_kfold_assigned(spark, sf_dir), ["ret"], 1.0).join(scored, ["asset", "session"], "left_semi"), "predictions")
    return _rounded(metrics.financial_metrics(rows.withColumn("view", F.lit("common")), ["view"], PERIODS), "mse", "ic", "sharpe")


def _three_models(spark, sf_dir):
    assigned = _kfold_assigned(spark, sf_dir)
    mean = evaluate.mean_predictions(assigned).select(F.lit("mean").alias("model"), "session", "target", "prediction")
    ridge = evaluate.ridge_predictions(assigned, ["ret"], 1.0, 100.0)
    return kept(mean.union(ridge.select(F.format_string("ridge-%d", F.col("alpha").cast("int")).alias("model"), "session", "target", "prediction")), "predictions")


def regime_mse(spark, sf_dir):
    return _rounded(metrics.regime_scores(_three_models(spark, sf_dir)), "mse").withColumn("mse", F.round("mse", 6))


def ranking_stability(spark, sf_dir):
    ranks = metrics.model_ranks(metrics.regime_scores(_three_models(spark, sf_dir)))
    return _rounded(metrics.rank_stability(ranks), "correlation")


def model_summary(spark, sf_dir):
    return metrics.model_summary(metrics.model_ranks(metrics.regime_scores(_three_models(spark, sf_dir))))


def _channels(data, axis):
    return {
        "unsafe-shuffled-kfold": splits.decide(data, axis, splits.shuffled_roles(data, 5), purge=False),
        "chronological-no-purge": splits.decide(data, axis, splits.walk_forward_roles(data, WALK), purge=False),
        "purged-kfold": splits.plan(data, axis, KFOLD),
        "causal-walk-forward": splits.plan(data, axis, WALK),
    }


def four_channel_benchmark(spark, sf_dir):
    """Ridge error, rows scored and overlap left, for two unsafe and two safe ways to split."""
    data, axis = modelled(spark, sf_dir)
    found = channel_benchmark(data, _channels(data, axis), ["ret"])
    return found.select("channel", F.round("mse", 8).alias("mse"), "n", "overlap")


def six_channel_benchmark(spark, sf_dir):
    """Two ridge penalties over two unsafe and four safe ways to split, with what each removed and kept."""
    data, axis = modelled(spark, sf_dir)
    found = channel_benchmark(data, channel_folds(data, axis, KFOLD, CPCV, WALK, embargo=KFOLD.embargo), ["ret"], (1.0, 100.0))
    return found.withColumn("mse", F.round("mse", 8))


def lagged(data: DataFrame, lags: int) -> tuple[DataFrame, list[str]]:
    """Samples with the returns of the `lags` sessions up to each, oldest first; those with a gap in them go."""
    own = Window.partitionBy("asset").orderBy("axis_pos")
    names = [f"lag{k}" for k in range(lags - 1, -1, -1)]
    found = data.withColumns({f"lag{k}": F.when(F.lag("axis_pos", k).over(own) == F.col("axis_pos") - k, F.lag("ret", k).over(own)) for k in range(lags)})
    return kept(found.dropna(subset=names), "lagged"), names


def six_channel_families(spark, sf_dir):
    """A line, trees and a recurrent network over the same lags, each in two unsafe and four safe ways to split."""
    data, axis = modelled(spark, sf_dir)
    data, names = lagged(data, LOOKBACK)
    models = {"ridge": mergeable.RidgeSums(1.0), "leafwise-trees": LeafwiseTrees(trees=8, leaves=7, depth=3), "sequence": mergeable.SequenceModel(epochs=2)}
    return family_benchmark(data, channel_folds(data, axis, KFOLD, CPCV, WALK, embargo=KFOLD.embargo), names, models).withColumn("mse", F.round("mse", 8))


def effectiveness_comparison(spark, sf_dir):
    """Three channels scored on their own samples and on those that walk-forward scored, path by path."""
    data, axis = modelled(spark, sf_dir)
    return _rounded(effectiveness(data, axis, KFOLD, CPCV, WALK, ["ret"], periods=PERIODS), "mse", "ic", "sharpe")


def _mean_absolute(target, prediction):
    return abs(target - prediction).mean()


def _evaluated(spark, sf_dir) -> evaluate.Evaluation:
    data, axis = modelled(spark, sf_dir)
    judge = evaluate.Evaluator(CPCV, evaluate.Ridge(1.0), ("ret",), {"mse": metrics.mse(), "mae": evaluate.Named(_mean_absolute, "mean-absolute-error", "1")}, channel="cpcv-robustness")
    return judge.evaluate(data, axis, data_digest(data))


def evaluation_ledger(spark, sf_dir):
    rows = _evaluated(spark, sf_dir).ledger
    return rows.select("sample_id", "session", "asset_id", "fold_index", "combination_index", "group_index", "path_index", "evidence_channel", F.round(F.col("prediction") + 0.0, 6).alias("prediction"))


def evaluation_scores(spark, sf_dir):
    """A built-in measure and a user's function, overall, by fold and by path."""
    return _evaluated(spark, sf_dir).scores.withColumn("value", F.round("value", 8))


def evaluation_coverage(spark, sf_dir):
    return _evaluated(spark, sf_dir).coverage


def release_gate(spark, sf_dir):
    """Development, frozen choice, one attempt at the last 40 sessions, and its diagnostics."""
    data, axis = modelled(spark, sf_dir)
    development, held = release.parts(data.withColumn("sample_id", F.concat_ws("::", "asset", "session")), 40)
    gate = release.Gate(shared_path(spark, "release"), {"mean": evaluate.Mean(), "ridge-1": evaluate.Ridge(1.0), "ridge-100": evaluate.Ridge(100.0)}, ["ret"], WALK, PERIODS)
    scored = gate.develop(development, axis)["scores"]
    selected = gate.choose(development)["selected"]
    gate.attempt(development, held)
    found = gate.diagnose(held)
    numbers = [F.round(F.lit(float(found[n])) + 0.0, 6).alias(n) for n in ("mse", "cross_sectional_ic", "diagnostic_sharpe")] + [F.lit(found[n]).cast("long").alias(n) for n in ("observations", "sessions", "ic_sessions")]
    return held.limit(1).select(F.lit(selected).alias("selected"), F.round(F.lit(scored[selected]), 8).alias("development_mse"), *numbers)  # one row


def mergeable_scores(spark, sf_dir):
    """Returns clipped at quantiles and standardised fold by fold, ridge on them, and three mergeable or column measures."""
    data, axis = modelled(spark, sf_dir)
    measures = {"mse": metrics.mse(), "quantile-loss": mergeable.QuantileLoss(0.9), "concordance": mergeable.Concordance()}
    steps = (mergeable.QuantileClip(0.05, 0.95), mergeable.Standardise())
    judge = evaluate.Evaluator(KFOLD, evaluate.Ridge(1.0), ("ret",), measures, steps)
    return judge.evaluate(data, axis, data_digest(data)).scores.withColumn("value", F.round("value", 8))


def optimism_gap(spark, sf_dir):
    """How much smaller the error of each unsafe channel looks than that of its safe counterpart."""
    found = four_channel_benchmark(spark, sf_dir).agg(*[F.max(F.when(F.col("channel") == c, F.col("mse"))).alias(n) for c, n in (("unsafe-shuffled-kfold", "a"), ("purged-kfold", "b"), ("chronological-no-purge", "c"), ("causal-walk-forward", "d"))])
    return found.select(F.round(F.col("b") - F.col("a") + 0.0, 7).alias("shuffled_gap"), F.round(F.col("d") - F.col("c") + 0.0, 7).alias("chronological_gap"))


# --- SQL -----------------------------------------------------------------------------------------------------

BASE = f"""
p AS (SELECT date_trunc('week', l_shipdate)::DATE AS session, l_returnflag || l_linestatus AS asset, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY 1, 2),
axis AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS pos FROM (SELECT DISTINCT session FROM p)),
s0 AS (SELECT p.asset, p.session, a.pos, b.session AS info_start, e.session AS info_end, f.price / p.price - 1 AS target, p.price / g.price - 1 AS ret
       FROM p JOIN axis a ON p.session = a.session JOIN axis b ON b.pos = a.pos - {LOOKBACK} JOIN axis e ON e.pos = a.pos + {HORIZON}
       LEFT JOIN p f ON f.asset = p.asset AND f.session = e.session
       LEFT JOIN axis w ON w.pos = a.pos - 1 LEFT JOIN p g ON g.asset = p.asset AND g.session = w.session)"""
ALL, MODELLED = ", s AS (SELECT * FROM s0)", ", s AS (SELECT * FROM s0 WHERE ret IS NOT NULL AND target IS NOT NULL)"


def _act(groups: int) -> str:
    return f"act AS (SELECT pos, session, row_number() OVER (ORDER BY pos) - 1 AS place, ntile({groups}) OVER (ORDER BY pos) - 1 AS g FROM (SELECT DISTINCT pos, session FROM s))"


def _kfold_sql(k: int = KFOLD.n_splits) -> str:
    return f", {_act(k)}, roles AS (SELECT f.fold, pos, session, g, CASE WHEN g = f.fold THEN 'test' ELSE 'candidate' END AS role, CASE WHEN g = f.fold THEN 0 END AS block FROM act, (SELECT unnest(range({k})) AS fold) f)"


def _cpcv_sql() -> str:
    return f""", {_act(CPCV.n_groups)}, combos AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS fold, a, b FROM (SELECT unnest(range({CPCV.n_groups})) AS a) x, (SELECT unnest(range({CPCV.n_groups})) AS b) y WHERE a < b),
    roles AS (SELECT fold, pos, session, g, CASE WHEN g IN (a, b) THEN 'test' ELSE 'candidate' END AS role, CASE WHEN g = a THEN 0 WHEN g = b AND b = a + 1 THEN 0 WHEN g = b THEN 1 END AS block FROM act, combos)"""


def _walk_sql(spec: WalkForward) -> str:
    oldest = f"fst - {spec.max_train_sessions}" if spec.max_train_sessions else "0"
    return f""", {_act(1)}, win AS (SELECT fold, (SELECT count(*) FROM act) - ({spec.n_splits} - fold) * {spec.test_sessions} AS fst FROM (SELECT unnest(range({spec.n_splits})) AS fold) f),
    roles AS (SELECT fold, pos, session, 0 AS g, CASE WHEN place >= fst THEN 'test' ELSE 'candidate' END AS role, CASE WHEN place >= fst THEN 0 END AS block FROM act, win WHERE place < fst + {spec.test_sessions} AND place >= {oldest})"""


def _shuffled_sql() -> str:
    return """, act AS (SELECT pos, session, ntile(5) OVER (ORDER BY md5(strftime(session, '%Y-%m-%d'))) - 1 AS g FROM (SELECT DISTINCT pos, session FROM s)),
    roles AS (SELECT f.fold, pos, session, g, CASE WHEN g = f.fold THEN 'test' ELSE 'candidate' END AS role, CASE WHEN g = f.fold THEN 0 END AS block FROM act, (SELECT unnest(range(5)) AS fold) f)"""


def _decided_sql(embargo: int = 0, gap: int = 0, causal: bool = False, purge: bool = True) -> str:
    """Exclusions by a direct search for overlapping test rows."""
    return f""", x AS (SELECT s.*, r.fold, r.role, r.block, r.g FROM s JOIN roles r ON s.pos = r.pos), tst AS (SELECT DISTINCT fold, block, pos, session, info_start, info_end FROM x WHERE role = 'test'),
    blk AS (SELECT fold, block, max(info_end) AS last_information, min(pos) AS start_pos, min(session) AS start_session, max(session) AS end_session, count(DISTINCT pos) AS session_count FROM tst GROUP BY 1, 2),
    held AS (SELECT DISTINCT blk.fold, a.pos FROM blk JOIN axis a ON a.pos >= (SELECT count(*) FROM axis q WHERE q.session <= blk.last_information) AND a.pos < (SELECT count(*) FROM axis q WHERE q.session <= blk.last_information) + {embargo}),
    fst AS (SELECT fold, min(start_pos) AS fp, min(start_session) AS fs FROM blk GROUP BY 1),
    d AS (SELECT x.*, CASE WHEN role = 'test' THEN NULL
            WHEN {str(purge).lower()} AND EXISTS (SELECT 1 FROM tst t WHERE t.fold = x.fold AND t.info_start <= x.info_end AND x.info_start <= t.info_end) THEN 'purge-overlap'
            WHEN (x.fold, x.pos) IN (SELECT (fold, pos) FROM held) THEN 'embargo'
            WHEN {str(causal).lower()} AND x.info_end >= fst.fs THEN 'causal-future-information'
            WHEN {gap} > 0 AND x.pos BETWEEN fst.fp - {gap} AND fst.fp - 1 THEN 'pre-test-gap' END AS reason
          FROM x JOIN fst ON x.fold = fst.fold)"""


SUMMARY = """ SELECT fold, count(*) FILTER (role = 'test') AS test_rows, count(*) FILTER (role = 'candidate') AS candidates, count(*) FILTER (reason = 'purge-overlap') AS purged,
  count(*) FILTER (reason = 'embargo') AS embargoed, count(*) FILTER (reason = 'causal-future-information') AS noncausal, count(*) FILTER (reason = 'pre-test-gap') AS pre_test_gapped,
  count(*) FILTER (role = 'candidate' AND reason IS NULL) AS retained FROM d GROUP BY fold"""
OVERLAP = """ SELECT fold, count(*) FILTER (role = 'candidate' AND EXISTS (SELECT 1 FROM tst t WHERE t.fold = d.fold AND t.info_start <= d.info_end AND d.info_start <= t.info_end)) AS overlap
  FROM d WHERE reason IS NULL GROUP BY fold"""


def _decided(which: str, rows: str = ALL) -> str:
    at = {
        "kfold": _kfold_sql() + _decided_sql(embargo=KFOLD.embargo),
        "plain": _kfold_sql() + _decided_sql(),
        "cpcv": _cpcv_sql() + _decided_sql(embargo=CPCV.embargo),
        "walk": _walk_sql(WALK) + _decided_sql(gap=WALK.gap, causal=True),
        "sliding": _walk_sql(SLIDING) + _decided_sql(gap=SLIDING.gap, causal=True),
        "chronological": _walk_sql(WALK) + _decided_sql(purge=False),
        "shuffled": _shuffled_sql() + _decided_sql(purge=False),
    }
    return f"WITH {BASE}{rows}{at[which]}"


def _ridge_sql(alpha: float, tag: str = "") -> str:
    """Closed form for one standardised feature."""
    return f""", c{tag} AS (SELECT fold, avg(target) AS my, avg(ret) AS mx, count(*) AS n, greatest(sqrt(avg(ret * ret) - avg(ret) * avg(ret)), 0) AS sd, avg(ret * target) - avg(ret) * avg(target) AS cxy FROM d WHERE role = 'candidate' AND reason IS NULL GROUP BY fold),
    r{tag} AS (SELECT d.*, my + (n * cxy / sd) / (n + {alpha}) * (ret - mx) / sd AS prediction FROM d JOIN c{tag} ON d.fold = c{tag}.fold WHERE role = 'test')"""


MSE = "avg((target - prediction) * (target - prediction))"


def _financial_sql(keys: str, source: str = "r1") -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    on2 = on.replace("b.", "c.")
    return f""", rk AS (SELECT *, rank() OVER (PARTITION BY {keys}, session ORDER BY target) + (count(*) OVER (PARTITION BY {keys}, session, target) - 1) / 2.0 AS rt,
      rank() OVER (PARTITION BY {keys}, session ORDER BY prediction) + (count(*) OVER (PARTITION BY {keys}, session, prediction) - 1) / 2.0 AS rp, prediction - avg(prediction) OVER (PARTITION BY {keys}, session) AS lean FROM {source}),
    ses AS (SELECT {keys}, session, count(*) AS n, covar_pop(rt, rp) / nullif(stddev_pop(rt) * stddev_pop(rp), 0) AS ic, sum(lean * target) / nullif(sum(abs(lean)), 0) AS sret FROM rk GROUP BY {keys}, session),
    fm AS (SELECT a.*, b.ic, c.sharpe FROM (SELECT {keys}, count(*) AS n, {MSE} AS mse FROM {source} GROUP BY {keys}) a
      LEFT JOIN (SELECT {keys}, avg(ic) AS ic FROM ses WHERE n >= 3 AND ic IS NOT NULL GROUP BY {keys}) b ON {on}
      LEFT JOIN (SELECT {keys}, avg(sret) / stddev_samp(sret) * sqrt({PERIODS}) AS sharpe FROM ses WHERE n >= 2 AND sret IS NOT NULL GROUP BY {keys}) c ON {on2})"""


def _models_sql() -> str:
    mean = ", c0 AS (SELECT fold, avg(target) AS prediction FROM d WHERE role = 'candidate' AND reason IS NULL GROUP BY fold), r0 AS (SELECT d.*, c0.prediction FROM d JOIN c0 ON d.fold = c0.fold WHERE role = 'test')"
    union = " UNION ALL ".join(f"SELECT '{n}' AS model, session, target, prediction FROM r{t}" for n, t in (("mean", "0"), ("ridge-1", "1"), ("ridge-100", "100")))
    return _decided("kfold", MODELLED) + mean + _ridge_sql(1.0, "1") + _ridge_sql(100.0, "100") + f""", m AS ({union}), reg AS (SELECT session, ntile(3) OVER (ORDER BY session) - 1 AS regime FROM (SELECT DISTINCT session FROM m)),
    sc AS (SELECT model, regime, {MSE} AS mse FROM m JOIN reg ON m.session = reg.session GROUP BY 1, 2),
    rk AS (SELECT model, regime, rank() OVER (PARTITION BY regime ORDER BY mse) + (count(*) OVER (PARTITION BY regime, mse) - 1) / 2.0 AS k FROM sc)"""


def _four_sql() -> str:
    parts = []
    for name, which in (("unsafe-shuffled-kfold", "shuffled"), ("chronological-no-purge", "chronological"), ("purged-kfold", "kfold"), ("causal-walk-forward", "walk")):
        body = _decided(which, MODELLED) + _ridge_sql(1.0, "1")
        parts.append(f"(SELECT * FROM ({body} SELECT '{name}' AS channel, round({MSE}, 8) AS mse, count(*) AS n, (SELECT sum(overlap)::BIGINT FROM ({OVERLAP})) AS overlap FROM r1))")
    return " UNION ALL ".join(parts)


def _six_sql() -> str:
    parts = []
    for name, which in (
        ("unsafe-shuffled-kfold", "shuffled"), ("chronological-no-purge", "chronological"), ("purged-kfold", "plain"), ("purged-kfold-embargo", "kfold"), ("cpcv", "cpcv"), ("causal-walk-forward", "walk"),
    ):
        body = _decided(which, MODELLED) + _ridge_sql(1.0, "1") + _ridge_sql(100.0, "100")
        shape = f"""(SELECT sum(overlap)::BIGINT FROM ({OVERLAP})) AS overlap, (SELECT count(*) FROM d WHERE reason = 'purge-overlap') AS purged, (SELECT count(*) FROM d WHERE reason = 'embargo') AS embargoed,
          (SELECT min(n) FROM (SELECT count(*) AS n FROM d WHERE role = 'candidate' AND reason IS NULL GROUP BY fold)) AS retained_min"""
        both = " UNION ALL ".join(f"SELECT '{name}' AS channel, {a}.0::DOUBLE AS alpha, round({MSE}, 8) AS mse, count(*) AS n, {shape} FROM r{a}" for a in (1, 100))
        parts.append(f"(SELECT * FROM ({body} {both}))")
    return " UNION ALL ".join(parts)


PATHS_SQL = f"(VALUES {', '.join(map(str, path_table(CPCV.choices, CPCV.n_groups)))}) pt(fold, g, path)"


def _effectiveness_sql() -> str:
    columns, parts = "asset, session, target, prediction", []
    for name, which, path in (("causal-walk-forward", "walk", "0"), ("model-selection", "kfold", "0"), ("cpcv-robustness", "cpcv", "pt.path")):
        source = f"r1 JOIN {PATHS_SQL} ON r1.fold = pt.fold AND r1.g = pt.g" if which == "cpcv" else "r1"
        parts.append(f"(SELECT * FROM ({_decided(which, MODELLED)}{_ridge_sql(1.0, '1')} SELECT '{name}' AS channel, {path}::BIGINT AS path, {columns} FROM {source}))")
    return f"""WITH led AS ({" UNION ALL ".join(parts)}), vw AS (SELECT 'native' AS view, * FROM led UNION ALL SELECT 'common', * FROM led WHERE (asset, session) IN (SELECT (asset, session) FROM led WHERE channel = 'causal-walk-forward')){_financial_sql("channel, view, path", "vw")}
      SELECT channel, view, path, n, round(mse + 0.0, 6) AS mse, round(ic + 0.0, 6) AS ic, round(sharpe + 0.0, 6) AS sharpe FROM fm"""


EVALUATED = _decided("cpcv", MODELLED) + _ridge_sql(1.0, "1") + f", led AS (SELECT r1.*, pt.path FROM r1 JOIN {PATHS_SQL} ON r1.fold = pt.fold AND r1.g = pt.g)"


def _scores_sql() -> str:
    measures = (("mse", MSE), ("mae", "avg(abs(target - prediction))"))
    scopes = (("overall", "-1"), ("fold", "fold"), ("path", "path"))
    return EVALUATED + " UNION ALL ".join(f" SELECT '{m}' AS metric, '{s}' AS scope, {k}::BIGINT AS key, round({e}, 8) AS value, count(*) AS n FROM led GROUP BY 1, 2, 3" for m, e in measures for s, k in scopes)


def _mergeable_sql() -> str:
    clipped = """, qt AS (SELECT fold, quantile_disc(ret, 0.05) AS lo, quantile_disc(ret, 0.95) AS hi FROM d WHERE role = 'candidate' AND reason IS NULL GROUP BY fold),
    dc AS (SELECT d.* REPLACE (least(greatest(ret, lo), hi) AS ret) FROM d JOIN qt ON d.fold = qt.fold)"""
    ridge = _ridge_sql(1.0, "1").replace("FROM d ", "FROM dc ").replace("SELECT d.*", "SELECT dc.*").replace("ON d.fold", "ON dc.fold")
    measures = (
        ("mse", MSE), ("quantile-loss", "avg(greatest(0.9 * (target - prediction), -0.1 * (target - prediction)))"),
        ("concordance", "2 * covar_pop(target, prediction) / (var_pop(target) + var_pop(prediction) + (avg(target) - avg(prediction)) * (avg(target) - avg(prediction)))"),
    )
    scopes = (("overall", "-1"), ("fold", "fold"))
    return _decided("kfold", MODELLED) + clipped + ridge + " UNION ALL ".join(f" SELECT '{m}' AS metric, '{s}' AS scope, {k}::BIGINT AS key, round({e}, 8) AS value, count(*) AS n FROM r1 GROUP BY 1, 2, 3" for m, e in measures for s, k in scopes)


def _release_sql() -> str:
    base = """, m AS (SELECT * FROM s0 WHERE ret IS NOT NULL AND target IS NOT NULL), h AS (SELECT session FROM (SELECT DISTINCT session FROM m) ORDER BY session DESC LIMIT 40),
      b AS (SELECT min(info_start) AS start FROM m WHERE session IN (SELECT session FROM h)), s AS (SELECT m.* FROM m, b WHERE info_end < b.start)"""
    body = f"WITH {BASE}{base}{_walk_sql(WALK)}{_decided_sql(gap=WALK.gap, causal=True)}"
    body += ", c0 AS (SELECT fold, avg(target) AS prediction FROM d WHERE role = 'candidate' AND reason IS NULL GROUP BY fold), r0 AS (SELECT d.*, c0.prediction FROM d JOIN c0 ON d.fold = c0.fold WHERE role = 'test')"
    body += _ridge_sql(1.0, "1") + _ridge_sql(100.0, "100")
    names = (("mean", "0"), ("ridge-1", "1"), ("ridge-100", "100"))
    body += ", ov AS (" + " UNION ALL ".join(f"SELECT '{n}' AS model, {k} AS place, {MSE} AS mse FROM r{t}" for k, (n, t) in enumerate(names)) + "), sel AS (SELECT model, mse FROM ov ORDER BY mse, place LIMIT 1)"
    body += """, f AS (SELECT avg(target) AS my, avg(ret) AS mx, count(*) AS n, sqrt(avg(ret * ret) - avg(ret) * avg(ret)) AS sd, avg(ret * target) - avg(ret) * avg(target) AS cxy FROM s),
      q AS (SELECT 0 AS all_rows, m.session, m.target, CASE sel.model WHEN 'mean' THEN my WHEN 'ridge-1' THEN my + (n * cxy / sd) / (n + 1.0) * (ret - mx) / sd ELSE my + (n * cxy / sd) / (n + 100.0) * (ret - mx) / sd END AS prediction
            FROM m, f, sel WHERE m.session IN (SELECT session FROM h))"""
    body += _financial_sql("all_rows", "q")
    return body + f""" SELECT sel.model AS selected, round(sel.mse, 8) AS development_mse, round(fm.mse, 6) AS mse, round(coalesce(ic, 0.0) + 0.0, 6) AS cross_sectional_ic, round(coalesce(sharpe, 0.0) + 0.0, 6) AS diagnostic_sharpe, fm.n AS observations,
      (SELECT count(DISTINCT session) FROM q) AS sessions, (SELECT count(*) FROM ses WHERE n >= 3 AND ic IS NOT NULL) AS ic_sessions FROM fm, sel"""


HELD = ", h AS (SELECT session FROM (SELECT DISTINCT session FROM s) ORDER BY session DESC LIMIT 40), b AS (SELECT min(info_start) AS start, min(session) AS first_holdout FROM s WHERE session IN (SELECT session FROM h))"

SQL = {
    "purged_kfold_exclusions": _decided("kfold") + SUMMARY,
    "purged_kfold_assignments": _decided("kfold") + " SELECT fold, asset, session, CASE WHEN role = 'test' THEN 'test' WHEN reason IS NULL THEN 'train' ELSE 'excluded' END AS role, reason FROM d",
    "cpcv_combinations": _decided("cpcv") + " SELECT fold, min(g) AS first_group, max(g) AS second_group, count(DISTINCT pos) AS test_sessions FROM d WHERE role = 'test' GROUP BY fold",
    "cpcv_test_blocks": _decided("cpcv") + " SELECT fold, block, start_session, end_session, start_pos, session_count, last_information FROM blk",
    "cpcv_exclusions": _decided("cpcv") + SUMMARY,
    "cpcv_path_invariants": f"WITH {BASE}{ALL} SELECT p.path, count(*) AS tested_rows, count(DISTINCT (asset, session)) AS samples, {CPCV.n_groups}::BIGINT AS groups FROM s, (SELECT unnest(range(5)) AS path) p GROUP BY 1",
    "walk_forward_exclusions": _decided("walk") + SUMMARY,
    "walk_forward_sliding": _decided("sliding") + SUMMARY,
    "fold_validity": _decided("kfold")
    + """, v AS (SELECT fold, count(DISTINCT pos) FILTER (role = 'test') AS test_sessions, count(DISTINCT pos) FILTER (role = 'candidate' AND reason IS NULL) AS train_sessions, count(*) FILTER (role = 'candidate' AND reason IS NULL) AS train_samples FROM d GROUP BY fold)
    SELECT *, CASE WHEN test_sessions < 10 THEN 'minimum test sessions not met: ' || test_sessions || ' < 10' WHEN train_sessions < 100 THEN 'minimum training sessions not met: ' || train_sessions || ' < 100'
      WHEN train_samples < 1620 THEN 'minimum training samples not met: ' || train_samples || ' < 1620' END AS message FROM v""",
    "training_sufficiency": _decided("walk") + " SELECT fold, count(*) AS observations, count(DISTINCT session) AS sessions, count(DISTINCT asset) AS assets FROM d WHERE role = 'candidate' AND reason IS NULL GROUP BY fold",
    "sufficiency_summary": _decided("walk")
    + ", q AS (SELECT fold, count(*) AS observations, count(DISTINCT session) AS sessions, count(DISTINCT asset) AS assets FROM d WHERE role = 'candidate' AND reason IS NULL GROUP BY fold) SELECT "
    + ", ".join(f"{f}({n}) AS {f.replace('median', 'median')}_{n}" for n in ("observations", "sessions", "assets") for f in ("min", "median", "max"))
    + " FROM q",
    "group_breadth": f'WITH {BASE}{ALL}{_cpcv_sql()} SELECT act.g AS "group", count(DISTINCT s.session) AS sessions, count(*) AS observations, count(DISTINCT asset) AS assets FROM s JOIN act ON s.pos = act.pos GROUP BY 1',
    "chronological_no_purge_overlap": _decided("chronological") + OVERLAP,
    "unsafe_shuffled_overlap": _decided("shuffled") + OVERLAP,
    "safe_channel_overlap": " UNION ALL ".join(f"(SELECT * FROM ({_decided(n)} SELECT '{n}' AS channel, sum(overlap)::BIGINT AS overlap FROM ({OVERLAP})))" for n in ("kfold", "cpcv", "walk")),
    "holdout_split": f"WITH {BASE}{ALL}{HELD}, z AS (SELECT CASE WHEN session IN (SELECT session FROM h) THEN 'holdout' WHEN info_end < b.start THEN 'development' ELSE 'between' END AS part, session FROM s, b) SELECT part, count(*) AS samples, count(DISTINCT session) AS sessions FROM z GROUP BY 1",
    "holdout_boundary": f"WITH {BASE}{ALL}{HELD} SELECT b.first_holdout, b.start AS holdout_information, max(session) AS last_development, max(info_end) AS development_information, count(*) AS development_rows FROM s, b WHERE session NOT IN (SELECT session FROM h) AND info_end < b.start GROUP BY 1, 2",
    "mean_model_mse": _decided("kfold", MODELLED) + f", c0 AS (SELECT fold, avg(target) AS prediction FROM d WHERE role = 'candidate' AND reason IS NULL GROUP BY fold) SELECT d.fold, round({MSE}, 9) AS mse, count(*) AS n FROM d JOIN c0 ON d.fold = c0.fold WHERE role = 'test' GROUP BY d.fold",
    "ridge1_predictions": _decided("kfold", MODELLED) + _ridge_sql(1.0, "1") + " SELECT fold, asset, session, round(prediction + 0.0, 6) AS prediction FROM r1",
    "ridge_mse_grouping_sets": _decided("cpcv", MODELLED)
    + _ridge_sql(1.0, "1")
    + f" SELECT CASE WHEN grouping(fold) = 0 THEN 'fold' WHEN grouping(g) = 0 THEN 'group' ELSE 'overall' END AS scope, coalesce(fold, g, -1)::BIGINT AS key, round({MSE}, 9) AS value, count(*) AS n FROM r1 GROUP BY GROUPING SETS ((), (fold), (g))",
    "session_spearman_ic": _decided("walk", MODELLED) + _ridge_sql(1.0, "1") + _financial_sql("fold") + " SELECT fold, session, n, round(ic + 0.0, 8) AS ic FROM ses WHERE n >= 3 AND ic IS NOT NULL",
    "diagnostic_sharpe": _decided("walk", MODELLED) + _ridge_sql(1.0, "1") + _financial_sql("fold") + f" SELECT fold, round(avg(sret) / stddev_samp(sret) * sqrt({PERIODS}), 6) AS sharpe, count(*) AS sessions FROM ses WHERE n >= 2 AND sret IS NOT NULL GROUP BY fold",
    "financial_metrics": _decided("walk", MODELLED) + _ridge_sql(1.0, "1") + _financial_sql("fold") + " SELECT fold, n, round(mse + 0.0, 6) AS mse, round(ic + 0.0, 6) AS ic, round(sharpe + 0.0, 6) AS sharpe FROM fm",
    "path_distribution": _decided("cpcv", MODELLED)
    + _ridge_sql(1.0, "1")
    + _financial_sql("fold")
    + " , u AS (SELECT 'mse' AS metric, mse AS v FROM fm UNION ALL SELECT 'ic', ic FROM fm UNION ALL SELECT 'sharpe', sharpe FROM fm) SELECT metric, round(median(v), 6) AS median, round(CASE WHEN metric = 'mse' THEN max(v) ELSE min(v) END, 6) AS worst, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90 FROM u GROUP BY metric",
    "common_view_metrics": _decided("kfold", MODELLED)
    + _ridge_sql(1.0, "1")
    + f", act2 AS (SELECT session, row_number() OVER (ORDER BY session DESC) AS place FROM (SELECT DISTINCT session FROM s)), rc AS (SELECT 'common' AS view, r1.* FROM r1 WHERE session IN (SELECT session FROM act2 WHERE place <= {WALK.n_splits * WALK.test_sessions}))"
    + _financial_sql("view", "rc")
    + " SELECT view, n, round(mse + 0.0, 6) AS mse, round(ic + 0.0, 6) AS ic, round(sharpe + 0.0, 6) AS sharpe FROM fm",
    "regime_mse": _models_sql() + " SELECT model, regime, round(mse, 6) AS mse FROM sc",
    "ranking_stability": _models_sql()
    + " SELECT a.regime AS regime_a, b.regime AS regime_b, round(CASE WHEN bool_and(a.k = b.k) THEN 1.0 ELSE coalesce(covar_pop(a.k, b.k) / nullif(stddev_pop(a.k) * stddev_pop(b.k), 0), 0.0) END + 0.0, 6) AS correlation FROM rk a JOIN rk b ON a.model = b.model AND a.regime < b.regime GROUP BY 1, 2",
    "model_summary": _models_sql() + " SELECT model, median(k) AS median_rank, max(k) AS worst_rank, count(*) FILTER (k = 1) AS first_places FROM rk GROUP BY model",
    "four_channel_benchmark": _four_sql(),
    "six_channel_benchmark": _six_sql(),
    "effectiveness_comparison": _effectiveness_sql(),
    "evaluation_ledger": EVALUATED + " SELECT session::VARCHAR || '::' || asset AS sample_id, session, asset AS asset_id, fold AS fold_index, fold AS combination_index, g AS group_index, path::BIGINT AS path_index, 'cpcv-robustness' AS evidence_channel, round(prediction + 0.0, 6) AS prediction FROM led",
    "evaluation_scores": _scores_sql(),
    "mergeable_scores": _mergeable_sql(),
    "release_gate": _release_sql(),
    "evaluation_coverage": EVALUATED + f" SELECT count(DISTINCT (asset, session)) / (SELECT count(*) FROM s) AS sample_coverage, count(DISTINCT fold) / {len(CPCV.choices)}.0::DOUBLE AS fold_coverage FROM led",
    "optimism_gap": f"WITH q AS ({_four_sql()}) SELECT round((SELECT mse FROM q WHERE channel = 'purged-kfold') - (SELECT mse FROM q WHERE channel = 'unsafe-shuffled-kfold'), 7) AS shuffled_gap, round((SELECT mse FROM q WHERE channel = 'causal-walk-forward') - (SELECT mse FROM q WHERE channel = 'chronological-no-purge'), 7) AS chronological_gap",
}

DATES = {
    "purged_kfold_assignments": ("session",),
    "cpcv_test_blocks": ("start_session", "end_session", "last_information"),
    "holdout_boundary": ("first_holdout", "holdout_information", "last_development", "development_information"),
    "ridge1_predictions": ("session",),
    "session_spearman_ic": ("session",),
    "evaluation_ledger": ("session",),
}
QUERIES = {n: f for n, f in globals().items() if n in {*SQL, "cpcv_paths", "six_channel_families"}}
