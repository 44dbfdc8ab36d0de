"""The published example's figures, all checks of a decision, and what a return matrix must be."""

from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tidegate.errors import DatasetError, EvaluationError
from tidegate.functions.risk import normal_cdf_column
from tidegate.model import CombinatorialCV
from tidegate.operators import strategy
from tidegate.plans.benchmarks import strategy_report
from tidegate.session import kept
from tidegate.sources.arrays import demo_panel


@pytest.fixture(scope="module")
def demo(spark):
    panel = demo_panel(spark)
    strategy.require_dense(panel)
    return kept(strategy.tracks(strategy.weights(panel, strategy.grid(), strategy.Execution()), [0.0, 3.0, 5.0]), "demo")


def test_published_figures(demo):
    found = strategy_report(strategy.scenario(demo, 0.0), 252.0, 8, CombinatorialCV(6, 2), 63, 5, 32)
    expected = {"pbo": 0.8286, "deflated_probability": 0.8808, "cpcv_median": 0.9203, "cpcv_p10": 0.5826, "cpcv_worst": 0.5030, "walk_forward": 1.7504, "mean_regret": 1.8496}
    assert {k: round(found[k], 4) for k in expected} == expected
    assert round(found["selection_optimism"] + found["walk_forward"], 4) == 2.1351


def test_eight_checks_of_the_example(demo):
    evidence = strategy.acceptance_evidence(demo, 32, 252.0, 8, 6, 2, 0, 63, 5)
    row = evidence.first()
    expected = {"pbo": 0.8429, "deflated_probability": 0.8766, "cpcv_median": 0.8935, "cpcv_p10": 0.2939, "cpcv_worst": 0.1797, "walk_forward": 1.7259, "stress_cpcv_worst": 0.1614, "stress_walk_forward": 1.7096}
    assert {k: round(row[k], 4) for k in expected} == expected
    checks = strategy.acceptance_checks(evidence)
    assert {r["check"] for r in checks.where("not passed").collect()} == {"pbo", "deflated_probability"} and checks.count() == 8
    assert strategy.decision(checks) == ("FAIL", "FAIL")


def test_a_scenario_is_one(demo):
    with pytest.raises(EvaluationError, match="0 cost scenarios of 4"):
        strategy.scenario(demo, 4.0)
    with pytest.raises(EvaluationError, match="2 cost scenarios"):
        strategy.scenario(demo.unionByName(demo.withColumn("cost_bps", F.col("cost_bps") + 1e-13)), 3.0)


def test_return_matrix(demo):
    one = strategy.scenario(demo, 3.0)
    strategy.require_returns(one)
    for bad, message in (
        (one.where("cand_idx = 0"), "fewer than 2"), (one.where("not (t = 5 and cand_idx = 1)"), "not dense"), (one.withColumn("net", F.when(F.col("t") == 3, -1.0).otherwise(F.col("net"))), "32 returns"),
        (one.withColumn("turnover", -F.col("turnover")), "negative turnovers"), (one.withColumn("gross", F.lit(float("nan"))), "not finite"), (one.withColumn("t", -F.col("t")), "do not rise"),
    ):
        with pytest.raises(DatasetError, match=message):
            strategy.require_returns(bad)


def test_normal_distribution(spark):
    at = [-9.0, -3.2, -1.0, 0.0, 0.3, 1.96, 5.5, 8.0]
    found = spark.createDataFrame([(x,) for x in at], "x double").select("x", normal_cdf_column(F.col("x")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(NormalDist().cdf(r["x"]), abs=1e-10) for r in found)
