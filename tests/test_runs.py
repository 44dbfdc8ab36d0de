"""Requests, limits, time limits, schemas and examples of bounded runs; folders of CSV files whose headers differ."""

import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidegate import cli, runs
from tidegate.errors import GovernanceError, InvalidFoldError, LimitError, RequestError, RunTimeout, SinkError, SourceError
from tidegate.model import CombinatorialCV, PurgedKFold, WalkForward, digest
from tidegate.plans import weekly
from tidegate.plans.benchmarks import effectiveness
from tidegate.sources.files import Limits, read_upload

PAIR = StructType([StructField("a", DoubleType()), StructField("b", DoubleType())])
REQUEST = {"schema_version": "1", "action": "audit", "data_path": "d.csv", "manifest_path": "m.json", "mapping_path": "p.json"}


def test_parts_of_a_folder_must_agree(spark, tmp_path):
    """Columns in another order were read by the first file's header once, without a word."""
    folder = tmp_path / "x.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text("a,b\n1,10\n")
    (folder / "part-1.csv").write_text("a,b\n2,20\n")
    assert sorted(tuple(r) for r in read_upload(spark, str(folder), PAIR).collect()) == [(1.0, 10.0), (2.0, 20.0)]
    (folder / "part-2.csv").write_text("b,a\n30,3\n")
    with pytest.raises(SourceError, match="headers differ"):
        read_upload(spark, str(folder), PAIR)


def test_sizes_of_parquet_folders_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "x.parquet")
    spark.range(1000).select(F.col("id").cast("double").alias("a"), F.rand(1).alias("b")).repartition(3).write.parquet(path)
    assert read_upload(spark, path, PAIR).count() == 1000
    with pytest.raises(LimitError, match="too large"):
        read_upload(spark, path, PAIR, Limits(uncompressed_bytes=8000))
    with pytest.raises(LimitError, match="too large"):
        read_upload(spark, path, PAIR, Limits(rows=999))


@pytest.mark.parametrize(("change", "message"), [
    ({"more": 1}, "keys"), ({"schema_version": "2"}, "version"), ({"action": "demo"}, "action"), ({"data_path": ""}, "texts"), ({"options": []}, "object"), ({"options": {"n_groups": 3}}, "does not have"),
    ({"action": "evaluate", "options": {"n_groups": 1}}, "too small"), ({"action": "evaluate", "options": {"embargo_sessions": 2.5}}, "integer"), ({"action": "evaluate", "options": {"ridge_alpha": 0}}, "too small"),
    ({"options": {"max_rows": True}}, "integer"), ({"timeout_seconds": 0}, "timeout"), ({"timeout_seconds": 3601}, "timeout"), ({"timeout_seconds": True}, "timeout"),
])
def test_refused_requests(change, message):
    with pytest.raises(RequestError, match=message):
        runs.checked(REQUEST | change)


def test_requests(tmp_path):
    found = runs.checked(REQUEST | {"action": "evaluate", "options": {"max_rows": 5, "embargo_sessions": 0, "ridge_alpha": 2}, "timeout_seconds": 9}, "/in")
    assert (found.limits.rows, found.plan.embargo_sessions, found.plan.ridge_alpha, found.seconds, found.data_path) == (5, 0, 2, 9, "/in/d.csv")
    assert found.digest != runs.checked(REQUEST).digest and runs.checked(REQUEST | {"data_path": "s3a://b/d.csv"}, "/in").data_path == "s3a://b/d.csv"
    for text, message in (("{", "not JSON"), (" " * 2**20 + " ", "too large")):
        (tmp_path / "r.json").write_text(text)
        with pytest.raises(RequestError, match=message):
            runs.read_request(str(tmp_path / "r.json"))
    with pytest.raises(RequestError, match="file"):
        runs.read_request(str(tmp_path / "none.json"))


def test_a_run_over_its_time_leaves_no_job(spark):
    slow = F.udf(lambda x: time.sleep(0.2) or x, "long")

    def work():
        while True:  # also between jobs the run must end
            spark.range(0, 400, 1, 4).select(slow("id").alias("x")).agg(F.sum("x")).collect()

    began = time.monotonic()
    with pytest.raises(RunTimeout, match="more than 2 seconds"):
        runs.bounded(spark, 2, work)
    time.sleep(1)
    assert time.monotonic() - began < 15 and list(spark.sparkContext.statusTracker().getActiveJobsIds()) == []
    assert runs.bounded(spark, 60, lambda: spark.range(5).count()) == 5
    with pytest.raises(ZeroDivisionError):
        runs.bounded(spark, 60, lambda: 1 / 0)


def test_examples_audit_and_export(spark, tmp_path, capsys):
    for name in runs.EXAMPLES:
        assert runs.export(runs.example(name), str(tmp_path / name)) == ["features.csv", "manifest.json", "mapping.json", "request.json"]
        request = runs.read_request(str(tmp_path / name / "request.json"))
        if name == "leak":
            with pytest.raises(GovernanceError, match="target"):
                runs.run(spark, request)
            continue
        found = runs.run(spark, request)
        assert (found["dataset"]["observations"], found["dataset"]["sessions"], found["dataset"]["assets"], found["governance"]["features"]) == (6, 2, 3, 1)
    before = (tmp_path / "level" / "features.csv").read_text()
    with pytest.raises(SinkError, match="exists"):
        runs.export({"features.csv": "other"}, str(tmp_path / "level"))
    with pytest.raises(SinkError):
        runs.export({"good.txt": "x", "bad/name.txt": "y"}, str(tmp_path / "half"))
    assert (tmp_path / "level" / "features.csv").read_text() == before and sorted(p.name for p in tmp_path.iterdir()) == ["change", "leak", "level"]
    assert cli.main(["schema", "--kind", "request"]) == 0 and json.loads(capsys.readouterr().out)["schema"]["required"] == sorted(runs.REQUIRED)
    with pytest.raises(SystemExit) as stopped:
        cli.main(["schema", "--kind", "other"])
    assert stopped.value.code == 2 and json.loads(capsys.readouterr().out)["status"] == "error"
    assert cli.main(["example", "--name", "level", "--output-dir", str(tmp_path / "level")]) == 2


@pytest.mark.parametrize("kind", ["request", "manifest", "mapping"])
def test_schemas_name_the_keys(kind):
    found = runs.schema(kind)
    sample = {"request": REQUEST, "manifest": json.loads(runs.example("level")["manifest.json"]), "mapping": json.loads(runs.example("level")["mapping.json"])}[kind]
    assert set(found["required"]) <= set(sample) <= set(found["properties"]) and found["additionalProperties"] is False


def test_evaluation_equals_the_channels(spark, sf_dir, tmp_path):
    """An upload of the weekly samples: the scores are those of the comparison itself, and minimums and limits refuse."""
    data, axis = weekly.modelled(spark, sf_dir)
    rows = data.select(F.concat_ws("::", "asset", "session").alias("id"), "asset", "session", "info_start", "info_end", "target", "ret")
    rows.orderBy("session", "asset").coalesce(1).write.option("header", True).csv(str(tmp_path / "d.csv"))
    feature = json.loads(runs.example("change")["manifest.json"])["features"][0] | {"name": "ret", "source_digest": digest("lines"), "lookback_sessions": 2}
    names = {"sample_id": "id", "session": "session", "asset_id": "asset", "interval_start": "info_start", "interval_end": "info_end", "decision_time": "session", "target": "target"}
    mapping = {f"{k}_column": v for k, v in names.items()} | {
        "schema_version": "1", "feature_columns": ["ret"], "availability_columns": ["session"], "session_axis": [str(r[0]) for r in axis.orderBy("axis_pos").select("session").collect()],
        "pit_snapshot": {"snapshot_id": "s", "source_digest": digest("lines"), "revision_policy": "point-in-time"},
    }
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": "1", "source_bundle_digest": digest("lines"), "features": [feature]}))
    (tmp_path / "p.json").write_text(json.dumps(mapping))
    options = {"n_groups": 4, "walk_forward_splits": 3, "embargo_sessions": 4, "pre_test_gap_sessions": 2, "min_train_observations": 50, "min_train_sessions": 20, "min_train_assets": 2, "ridge_alpha": 3.0}
    run = lambda **more: runs.run(spark, runs.checked(REQUEST | {"action": "evaluate", "options": options | more}, str(tmp_path)))
    found = run()
    sessions = data.select("session").distinct().count()
    want = effectiveness(data, axis, PurgedKFold(4, 4), CombinatorialCV(4, 2, 4), WalkForward(3, sessions // 4, 2), ["ret"], alpha=3.0).orderBy("channel", "view", "path").collect()
    assert [(r["channel"], r["view"], r["path"], r["n"]) for r in found["report"]] == [tuple(r[n] for n in ("channel", "view", "path", "n")) for r in want]
    assert all(abs(a["mse"] - b["mse"]) < 1e-9 for a, b in zip(found["report"], want, strict=True))
    assert found["dataset"]["observations"] == data.count() and all(t["sufficient"] for t in found["training"]) and found["evaluation"]["cpcv_combinations"] == 6
    with pytest.raises(LimitError, match="6 combinations"):
        run(max_combinations=5)
    with pytest.raises(InvalidFoldError, match="training samples"):
        run(min_train_observations=10_000)
