"""Uploads are refused for what their documents or files say, and splitters and measures may be the user's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.errors import EvaluationError, GovernanceError, LimitError, RequestError, SourceError, SplitError
from tidegate.model import PurgedKFold, digest
from tidegate.operators import evaluate, splits
from tidegate.plans import weekly
from tidegate.sources.files import Limits
from tidegate.sources.upload import load_upload

HEX = digest("x")
FEATURE = {
    "name": "a", "source_dataset": "d", "source_fields": ["f"], "source_digest": HEX, "transformation": "t", "transformation_version": "1", "code_digest": HEX, "parameters": {"k": 1},
    "lookback_sessions": 3, "computation_scope": "precomputed-stateless", "revision_policy": "point-in-time", "uses_target": False,
}
MANIFEST = {"schema_version": "1", "source_bundle_digest": HEX, "features": [FEATURE, FEATURE | {"name": "b"}]}
MAPPING = {
    "schema_version": "1", "sample_id_column": "id", "session_column": "at", "asset_id_column": None, "interval_start_column": "at", "interval_end_column": "until", "decision_time_column": "at",
    "target_column": "y", "feature_columns": ["a", "b"], "availability_columns": ["at", "at"], "session_axis": ["2024-01-01", "2024-01-02", "2024-01-03"],
    "pit_snapshot": {"snapshot_id": "s", "source_digest": HEX, "revision_policy": "point-in-time"},
}
LINES = "id,at,until,a,b,y,other\n1,2024-01-01,2024-01-02,1,2,3,x\n2,2024-01-02,2024-01-03,4,5,6,\n"


@pytest.fixture
def data(tmp_path):
    (tmp_path / "d.csv").write_text(LINES)
    return str(tmp_path / "d.csv")


def test_upload(spark, data, tmp_path):
    found = load_upload(spark, data, MANIFEST, MAPPING)
    assert found.receipt["observations"] == 2 and found.receipt["availability_cells"] == 4 and found.receipt["max_lookback_sessions"] == 3 and found.file_bytes == len(LINES)
    assert sorted((r["sample_id"], r["features"], r["axis_pos"]) for r in found.dataset.collect()) == [("1", [1.0, 2.0], 0), ("2", [4.0, 5.0], 1)]
    spark.read.csv(data, header=True, inferSchema=True).coalesce(1).write.parquet(str(tmp_path / "d.parquet"))
    assert load_upload(spark, str(tmp_path / "d.parquet"), MANIFEST, MAPPING).receipt == found.receipt


@pytest.mark.parametrize(("manifest", "mapping", "limits", "error", "message"), [
    ({}, {"feature_columns": ["b", "a"]}, {}, GovernanceError, "name or order"),
    ({"features": [FEATURE, FEATURE]}, {}, {}, GovernanceError, "repeat"),
    ({"features": [FEATURE]}, {}, {}, GovernanceError, "name or order"),
    ({"features": [FEATURE | {"uses_target": True}, FEATURE | {"name": "b"}]}, {}, {}, GovernanceError, "target"),
    ({"source_bundle_digest": digest("y")}, {}, {}, GovernanceError, "another source"),
    ({"extra": 1}, {}, {}, RequestError, "keys"),
    ({}, {"schema_version": "2"}, {}, RequestError, "version"),
    ({}, {"target_column": "gone"}, {}, SourceError, "missing"),
    ({}, {}, {"features": 1}, LimitError, "2 features"),
    ({}, {}, {"rows": 1}, LimitError, "too many rows"),
    ({}, {}, {"file_bytes": 10}, LimitError, "too large"),
    ({}, {}, {"columns": 3}, LimitError, "7 columns"),
])
def test_refused_uploads(spark, data, manifest, mapping, limits, error, message):
    with pytest.raises(error, match=message):
        load_upload(spark, data, MANIFEST | manifest, MAPPING | mapping, Limits(**limits))


def test_one_read_of_the_base_table(spark, sf_dir, monkeypatch):
    """The queries that once scanned it hundreds of times: one read, and no plan over it is left."""
    from tidegate.plans import tracks

    read, calls = weekly.read, []
    monkeypatch.setattr(weekly, "read", lambda s, d, name: calls.append(name) or read(s, d, name))
    for query in (weekly.four_channel_benchmark, weekly.financial_metrics, tracks.cpcv_selected_paths):
        calls.clear()
        plan = query(spark, sf_dir)._jdf.queryExecution().toString()
        assert calls == ["lineitem"] and "lineitem" not in plan


class EveryThird:
    """A user's splitter: sessions by their number modulo three, purged like any other."""

    def plan(self, dataset, axis):
        sessions = dataset.select("axis_pos", "session").distinct()
        folds = sessions.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("group", F.col("axis_pos") % 3)
        role = F.when(F.col("group") == F.col("fold"), "test").otherwise("candidate")
        return splits.decide(dataset, axis, folds.withColumn("role", role).withColumn("block", F.when(F.col("role") == "test", F.col("axis_pos"))), purge=False)


def test_user_splitter_and_measure(spark, sf_dir, monkeypatch):
    data, axis = weekly.modelled(spark, sf_dir)
    worst = lambda y, p: float(np.max(np.abs(y - p)))
    found = evaluate.Evaluator(evaluate.Named(EveryThird(), "every-third", "1"), evaluate.Mean(), ("ret",), {"worst": evaluate.Named(worst, "worst", "1")}).evaluate(data, axis, "d")
    assert found.coverage.first().asDict() == {"sample_coverage": 1.0, "fold_coverage": 1.0}
    value = {r["scope"]: r["value"] for r in found.scores.where("scope = 'overall'").collect()}
    assert value["overall"] == found.ledger.agg(F.max(F.abs(F.col("target") - F.col("prediction")))).first()[0]
    first = evaluate.ledger_order(found.ledger).select("session", "asset_id").limit(5).collect()
    assert [tuple(r) for r in first] == sorted(tuple(r) for r in found.ledger.select("session", "asset_id").collect())[:5]
    with pytest.raises(SplitError, match="lacks"):
        splits.plan(data, axis, type("Bad", (), {"plan": lambda self, d, a: d})())
    monkeypatch.setattr(evaluate, "MOST_ROWS", 10)
    with pytest.raises(EvaluationError, match="too large"):
        evaluate.scores(found.ledger, {"worst": worst})
    evaluate.Evaluator(PurgedKFold(3), evaluate.Ridge(), ("ret",)).evaluate(data, axis, "d")  # aggregates have no such limit
