"""Estimators, scores, strategies, governance, ledgers, holdout and sources on small cases."""

import datetime as dt
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from tidegate import cli
from tidegate.errors import DatasetError, EvaluationError, GovernanceError, HoldoutError, LedgerError, LimitError, PointInTimeError, SourceError
from tidegate.functions import risk
from tidegate.model import CombinatorialCV, data_digest, digest
from tidegate.operators import evaluate, forward, governance, holdout, metrics, panel, rolls, strategy
from tidegate.plans.benchmarks import channel_benchmark, channel_folds, effectiveness, leakage_decision, strategy_report
from tidegate.plans import weekly
from tidegate.sources import arrays, files, frame, sinks


@pytest.fixture(scope="module")
def assigned(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(200, 2))
    y = x @ [0.5, -1.0] + draw.normal(0, 0.1, 200) + 3
    rows = pd.DataFrame({"fold": np.arange(200) % 2, "asset": "A", "session": np.arange(200), "x0": x[:, 0], "x1": x[:, 1], "target": y})
    both = pd.concat([rows.assign(role="train"), rows.assign(role="test", fold=1 - rows["fold"])])
    return spark.createDataFrame(both)


class Ridge:
    def fit(self, x, y):
        self.m, self.s = x.mean(0), x.std(0)
        z = (x - self.m) / self.s
        self.b, self.w = y.mean(), np.linalg.solve(z.T @ z + 2.0 * np.eye(x.shape[1]), z.T @ (y - y.mean()))

    def predict(self, x):
        return self.b + (x - self.m) / self.s @ self.w


class Broken(Ridge):
    def predict(self, x):
        return np.full(len(x), np.nan)


def test_ridge_by_sums_equals_a_fitted_one(assigned):
    own = {(r["fold"], r["session"]): r["prediction"] for r in evaluate.ridge_predictions(assigned, ["x0", "x1"], 2.0).collect()}
    fitted = evaluate.completed(evaluate.fit_predict(assigned, ["x0", "x1"], Ridge))
    assert own == pytest.approx({(r["fold"], r["session"]): r["prediction"] for r in fitted.collect()})
    with pytest.raises(EvaluationError, match="bad-predictions"):
        evaluate.completed(evaluate.fit_predict(assigned, ["x0", "x1"], Broken))
    one = Ridge()
    with pytest.raises(EvaluationError):
        evaluate.fit_predict(assigned, ["x0", "x1"], lambda: one)


def test_perfect_predictions_score_perfectly(spark):
    rows = spark.createDataFrame([(0, s, f"a{a}", (a - 1) * (s + 1) / 100) for s in range(6) for a in range(3)], "path long, session long, asset string, target double").withColumn("prediction", F.col("target"))
    found = metrics.require_financial(metrics.financial_metrics(rows, ["path"])).first()
    assert found["mse"] == 0 and found["ic"] == pytest.approx(1)
    spread = {r["metric"]: r["median"] for r in metrics.distribution(metrics.financial_metrics(rows, ["path"]), []).collect()}
    assert spread["ic"] == pytest.approx(1)


def test_ranking_stability(spark):
    for flip, expected in ((False, 1.0), (True, -1.0)):
        rows = [(m, r, float(v if not (flip and r == 1) else 10 - v)) for r in range(2) for v, m in enumerate("abc")]
        ranks = metrics.model_ranks(spark.createDataFrame(rows, "model string, regime long, mse double"))
        assert metrics.rank_stability(ranks).first()["correlation"] == pytest.approx(expected)


def test_drawdown_and_moments(spark):
    rows = spark.createDataFrame([(0, t, r) for t, r in enumerate([0.1, -0.5, 0.2, 0.0])], "k long, t long, net double")
    assert risk.drawdowns(rows, "net", ["k"], "t").first()["max_drawdown"] == pytest.approx(0.5)
    flat = spark.createDataFrame([(0.5,)] * 3, "net double").agg(risk.skew("net"), risk.raw_kurtosis("net"), risk.sharpe("net", 252)).first()
    assert tuple(flat)[:2] == (0.0, 3.0)


def test_momentum_is_causal_and_grid_is_whole(spark):
    assert len({c.name for c in strategy.grid()}) == 32
    base = arrays.demo_panel(spark).where("t < 80 and asset_idx < 2")
    strategy.require_dense(base)
    spec, execution = [strategy.Candidate(5, 5, 5, 2.0), strategy.Candidate(10, 5, 5, 0.3)], strategy.Execution()
    changed = base.withColumn("price", F.when(F.col("t") >= 40, F.col("price") * (1 + F.col("t") / 50)).otherwise(F.col("price")))
    gross = [{(r["t"], r["cand_idx"]): r["gross"] for r in strategy.tracks(strategy.weights(p, spec, execution), [0.0]).collect()} for p in (base, changed)]
    assert all(gross[0][k] == gross[1][k] for k in gross[0] if k[0] <= 40) and gross[0] != gross[1]
    with pytest.raises(DatasetError):
        strategy.require_dense(base.where("not (t = 3 and asset_idx = 0)"))


def test_rank_reversal_shows_as_overfitting(spark):
    # each candidate earns in its own regime only, so the best of any half is poor in the other
    rows = [(t, t, c, f"c{c}", 0.0, (0.02 if t // 24 == c else -0.002) + 0.0005 * ((t * 7 + c) % 5), 0.0) for t in range(192) for c in range(8)]
    returns = spark.createDataFrame(rows, "t long, session long, cand_idx long, candidate_id string, gross double, net double, turnover double")
    assert strategy.overfitting_probability(strategy.cscv(returns, 8, 252.0)).first()["pbo"] >= 0.75
    found = strategy.combinatorial_selection(returns, 6, 2, 0, 252.0).collect()
    assert len(found) == 5 and {r["n"] for r in found} == {192}
    assert strategy.walk_forward_selection(returns, 96, 4, 252.0).count() == 4
    report = strategy_report(returns, 252.0, 8, CombinatorialCV(6, 2), 96, 4, 8)
    assert 0 <= report["pbo"] <= 1 and 0 <= report["deflated_probability"] <= 1


def test_required_sessions_and_decisions(spark):
    n = strategy.required_sessions(0.1, 0.05, 0.0, 3.0, 0.95)
    width = (1 + 0.5 * 0.01) ** 0.5
    assert n == int(np.ceil(1 + (NormalDist().inv_cdf(0.95) * width / 0.05) ** 2)) and strategy.required_sessions(0.1, 0.2, 0, 3, 0.95) is None
    names = [c[0] for c in strategy.RESEARCH_CHECKS]
    good = spark.createDataFrame([tuple(0.1 if n == "pbo" else 0.99 for n in names)], ", ".join(f"{n} double" for n in names))
    checks = strategy.acceptance_checks(good)
    assert [strategy.decision(checks, h) for h in ("NOT_RUN", "UNTOUCHED_PASS", "REUSED")] == [("PASS", "INCONCLUSIVE"), ("PASS", "PASS"), ("PASS", "FAIL")]
    assert strategy.decision(strategy.acceptance_checks(good.withColumn("pbo", F.lit(0.9))), "UNTOUCHED_PASS") == ("FAIL", "FAIL")


NOON = dt.datetime(2025, 1, 2, 12)
SNAPSHOT = governance.PITSnapshot("one", "a" * 64)


def upload(spark, late=(), **change):
    pdf = pd.DataFrame({"sid": [f"s{i}" for i in range(4)], "day": pd.to_datetime(["2025-01-02", "2025-01-02", "2025-01-03", "2025-01-06"]), "y": [0.1, 0.2, 0.3, 0.4], "f": [1.0, 2.0, 3.0, 4.0]})
    pdf["decided"] = pdf["day"] + pd.Timedelta(hours=12)
    pdf["seen"] = pdf["day"] + pd.to_timedelta([13 if i in late else 8 for i in range(4)], unit="h")
    for k, v in change.items():
        pdf[k] = v
    mapping = frame.FrameMapping("sid", "day", "day", "day", "y", ("f",), None, "decided", ("seen",))
    return frame.dataset_from_pandas(spark, pdf, mapping, ["2025-01-02", "2025-01-03", "2025-01-06"])


def manifest(**change):
    spec = dict(name="f", source_dataset="d", source_fields=("f",), source_digest="b" * 64, transformation="none", transformation_version="1", code_digest="c" * 64, lookback_sessions=2)
    return governance.FeatureManifest("a" * 64, (governance.FeatureDefinition(**(spec | change)),))


def test_governance(spark):
    data, axis = upload(spark)
    governance.require_valid(data, axis, 1)
    receipt = governance.govern(data, manifest(), SNAPSHOT)
    assert (receipt["observations"], receipt["availability_cells"], receipt["max_lookback_sessions"]) == (4, 4, 2)
    with pytest.raises(PointInTimeError, match="sample positions 2$"):
        governance.govern(upload(spark, late=(2,))[0], manifest(), SNAPSHOT)
    with pytest.raises(PointInTimeError):
        governance.govern(data, manifest(), governance.PITSnapshot("one", "a" * 64, "latest"))
    for change in ({"uses_target": True}, {"computation_scope": "fold-local"}, {"revision_policy": "latest"}):
        with pytest.raises(GovernanceError):
            governance.govern(data, manifest(**change), SNAPSHOT)


@pytest.mark.parametrize(("change", "rule"), [({"sid": ["s0", "s0", "s1", "s2"]}, "duplicate sample id"), ({"y": [0.1, float("inf"), 0.3, 0.4]}, "target not finite"), ({"f": [float("nan"), 1.0, 1.0, 1.0]}, "feature not finite"), ({"day": pd.to_datetime(["2025-01-02", "2025-01-02", "2025-01-03", "2025-02-06"])}, "off the axis"), ({"day": pd.to_datetime(["2025-01-03", "2025-01-02", "2025-01-03", "2025-01-06"])}, "out of order")])
def test_violations(spark, change, rule):
    data, axis = upload(spark, **change)
    with pytest.raises(DatasetError, match=rule):
        governance.require_valid(data, axis, 1)


def test_frames_are_refused(spark):
    pdf = pd.DataFrame({"a": [1], "b": [2]}, index=[0])
    mapping = frame.FrameMapping("a", "b", "b", "b", "missing", ())
    with pytest.raises(SourceError):
        frame.dataset_from_pandas(spark, pdf, mapping, [])
    with pytest.raises(SourceError):
        frame.dataset_from_pandas(spark, pd.concat([pdf, pdf]), mapping, [])
    with pytest.raises(SourceError):
        upload(spark, decided=pd.to_datetime(["2025-01-02"] * 4).tz_localize("UTC"))


def test_bars_and_rolls(spark):
    days = [d.date() for d in pd.bdate_range("2025-01-02", periods=10)]
    bars = spark.createDataFrame([(d, s, b + i, 1.0) for s, b in (("A", 100.0), ("B", 110.0)) for i, d in enumerate(days)], "date date, symbol string, close double, volume double")
    rows = frame.bars_dataset(bars, 2, 1).orderBy("session", "asset").collect()
    assert len(rows) == 16 and [r["sample_id"] for r in rows[:2]] == ["A::2025-01-03", "B::2025-01-03"]
    assert rows[0]["target"] == pytest.approx(102 / 101 - 1) and (rows[0]["info_start"].date(), rows[0]["info_end"].date()) == (days[0], days[2])
    with pytest.raises(DatasetError):
        frame.bars_dataset(bars.union(bars.limit(1)), 2, 1)
    series = [(days[i], "A_DOMINANT.X", 100.0 + i, "A", "c1" if i < 3 else "c2") for i in range(6)] + [(days[i], "A2503.X", 1.0, "A", "c") for i in range(2)] + [(days[i], "B_DOMINANT.X", 1.0, "B", "b") for i in range(2)]
    continuous = spark.createDataFrame(series, "date date, symbol string, close double, underlying_symbol string, dominant_id string")
    samples, audit = frame.continuous_dataset(continuous, 2, 1, 3)
    found = audit.first()
    assert (found["rows"], found["discarded"], found["transitions"], found["eligible"], found["label_cross"], found["interval_cross"]) == (6, 2, 1, 4, 1, 2)
    assert [not r["interval_cross"] for r in samples.orderBy("session").collect()] == [True, False, False, True]


def test_files(spark, tmp_path):
    schema = StructType().add("a", StringType()).add("b", DoubleType())
    (tmp_path / "x.csv").write_text("c,b,a\n1,2.5,z\n")
    assert [tuple(r) for r in files.read_upload(spark, str(tmp_path / "x.csv"), schema).collect()] == [("z", 2.5)]
    pd.DataFrame({"a": ["q"], "b": [1.0], "c": [3]}).to_parquet(tmp_path / "x.parquet")
    table = files.read_upload(spark, str(tmp_path / "x.parquet"), schema)
    assert table.columns == ["a", "b"] and "ReadSchema: struct<a:string,b:double>" in table._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(LimitError):
        files.read_upload(spark, str(tmp_path / "x.csv"), schema, files.Limits(file_bytes=3))
    with pytest.raises(SourceError):
        files.read_upload(spark, str(tmp_path / "x.csv"), schema.add("d", StringType()))
    pd.DataFrame({"v": [1.0]}).to_parquet(tmp_path / "ab_daily.parquet")
    found = files.daily_directory(spark, str(tmp_path / "*_daily.parquet"), "v double, w string").first()
    assert (found["asset"], found["v"], found["w"]) == ("AB", 1.0, None)
    assert len(files.source_digest(spark, str(tmp_path / "*_daily.parquet"))) == 64
    np.savez(tmp_path / "p.npz", sessions=np.arange("2020-01-01", "2020-01-04", dtype="datetime64[D]"), asset_ids=np.array(["x", "y"]), signal_prices=np.ones((3, 2)), tradable_returns=np.zeros((3, 2)))
    assert arrays.read_panel(spark, str(tmp_path / "p.npz")).count() == 6
    with pytest.raises(SourceError):
        arrays.read_returns(spark, str(tmp_path / "p.npz"))


def test_digests(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(50)], "a long, b string")
    assert data_digest(rows) == data_digest(rows.repartition(7)) != data_digest(rows.where("a > 0")) and digest({"b": 1, "a": 2}) == digest({"a": 2, "b": 1})


class Mean:
    def fit(self, x, y):
        self.m = y.mean()

    def predict(self, x):
        return np.full(len(x), self.m)


def test_holdout_is_used_once(spark, tmp_path):
    def rows(values, first):
        days = [dt.date(2025, first, 1 + i) for i in range(len(values))]
        return spark.createDataFrame([(f"{first}-{i}", d, d, d, 1.0, float(v)) for i, (d, v) in enumerate(zip(days, values))], "sample_id string, session date, info_start date, info_end date, x double, target double")

    train, held = rows([0, 0, 1, 1], 1), rows([0, 1], 2)
    mean, broken = evaluate.Named(Mean, "mean", "1"), evaluate.Named(Broken, "broken", "1")
    protocol = holdout.HoldoutProtocol.freeze("p", train, held, mean)
    for other in (holdout.HoldoutProtocol("p", "m", protocol.dataset_digest), holdout.HoldoutProtocol("p", protocol.model_digest, "d")):
        with pytest.raises(HoldoutError, match="the protocol's"):
            holdout.evaluate_once(train, held, other, str(tmp_path), ["x"], mean)
    with pytest.raises(HoldoutError, match="samples"):  # one target was changed since
        holdout.evaluate_once(train, held.replace(1.0, 2.0, "target"), protocol, str(tmp_path), ["x"], mean)
    assert holdout.evaluate_once(train, held, protocol, str(tmp_path), ["x"], mean)["score"] == 0.25
    with pytest.raises(HoldoutError, match="used"):
        holdout.evaluate_once(train, held, protocol, str(tmp_path), ["x"], mean)
    failing = holdout.HoldoutProtocol.freeze("q", train, held, broken)
    with pytest.raises(EvaluationError):
        holdout.evaluate_once(train, held, failing, str(tmp_path), ["x"], broken)
    with pytest.raises(HoldoutError, match="used"):
        holdout.evaluate_once(train, held, failing, str(tmp_path), ["x"], broken)
    with pytest.raises(HoldoutError, match="reaches"):
        holdout.evaluate_once(held, train, protocol, str(tmp_path), ["x"], mean)
    with pytest.raises(LedgerError):
        sinks.write_report(train, str(tmp_path / "r"))


def ledger(spark, predicted, settled):
    made = spark.createDataFrame([(f"{d}{a}", f"d{d}{a}", dt.date(2025, 1, d), dt.date(2025, 1, d + 1), dt.datetime(2025, 1, d + 1), dt.datetime(2025, 1, d, 12), p) for (d, a), p in predicted.items()], "sample_id string, prediction_digest string, decision_session date, label_end_session date, label_available_at timestamp, recorded_at timestamp, prediction double")
    done = spark.createDataFrame([(f"d{d}{a}", dt.datetime(2025, 1, d + 2), t) for (d, a), t in settled.items()], "prediction_digest string, settled_at timestamp, target double")
    return made, done


def test_forward_ledger(spark):
    predicted = {(d, a): p for d in (2, 3) for a, p in (("A", -0.1), ("B", 0.1))}
    settled = {k: 2 * v for k, v in predicted.items()}
    protocol = forward.ForwardProtocol("p", "2025-01-02", 4, 2)
    made, done = ledger(spark, predicted, settled)
    assert forward.report(made.limit(0), done, protocol).first()["status"] == "WAITING_FOR_FUTURE_DATA"
    assert forward.report(made, done.limit(0), protocol).first()["status"] == "COLLECTING"
    row = forward.report(made, done, protocol).first()
    assert row["status"] == "READY_FOR_REVIEW" and (row["mse"], row["zero_mse"], row["mean_ic"]) == (pytest.approx(0.01), pytest.approx(0.04), pytest.approx(1))
    assert forward.report(*ledger(spark, {k: -10 * v for k, v in predicted.items()}, settled), protocol).first()["status"] == "FAIL"
    forward.require_integrity(made, done, "2025-01-02")
    with pytest.raises(LedgerError, match="repeated-sample: 1"):
        forward.require_integrity(made.union(made.limit(1)), done, "2025-01-02")
    with pytest.raises(LedgerError, match="before-forward-start: 2"):
        forward.require_integrity(made, done, "2025-01-03")


def test_channels_and_views(spark, sf_dir):
    data, axis = (x.cache() for x in weekly.modelled(spark, sf_dir))  # as a user would pass a table
    folds = channel_folds(data, axis, weekly.KFOLD, weekly.CPCV, weekly.WALK, embargo=8)
    found = channel_benchmark(data, folds, ["ret"]).cache()
    assert found.count() == 6 and leakage_decision(found) == {"leakage": "PASS", "canary": "DETECTED", "embargo": "ACTIVE"}
    views = effectiveness(data, axis, weekly.KFOLD, weekly.CPCV, weekly.WALK, ["ret"], periods=52.0)
    counts = {(r["channel"], r["view"]): r["count"] for r in views.groupBy("channel", "view").count().collect()}
    assert counts[("cpcv-robustness", "native")] == 5 and len(counts) == 6


def test_rolls_that_change_back(spark):
    rows = spark.createDataFrame([("a", i, c) for i, c in enumerate("xyxxx")], "asset string, session long, contract string")
    found = {r["session"]: (r["label_cross"], r["eligible"]) for r in rolls.roll_flags(rows, 1, 2).collect()}
    assert found[0] == (True, True) and found[2] == (False, True) and found[4][1] is False


def test_next_position(spark):
    axis = spark.createDataFrame([(dt.date(2025, 1, d), i) for i, d in enumerate((2, 3, 6))], "session date, axis_pos long")
    asked = spark.createDataFrame([(dt.date(2025, 1, d),) for d in (1, 2, 4, 6, 9)], "at_day date")
    assert [r["next_pos"] for r in panel.next_position(axis, asked, "at_day").orderBy("at_day").collect()] == [0, 1, 2, 3, 3]
    assert [r["next_pos"] for r in panel.next_position(axis, asked, "at_day", inclusive=True).orderBy("at_day").collect()] == [0, 0, 2, 2, 3]


def test_command_line(spark, sf_dir, capsys):
    assert cli.main(["query", "bounded_projection_scan", sf_dir]) == 0
    assert cli.main(["query", "no_such", sf_dir]) == 2
    assert '"status": "error"' in capsys.readouterr().out
