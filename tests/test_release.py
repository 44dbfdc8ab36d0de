"""A release gate's stages in order, and what each refuses."""

import json

import pytest
from pyspark.sql import functions as F

from tidegate.errors import HoldoutError
from tidegate.operators.evaluate import Mean, Ridge
from tidegate.plans import release, weekly


@pytest.fixture(scope="module")
def world(spark, sf_dir):
    data, axis = weekly.modelled(spark, sf_dir)
    return (*release.parts(data.withColumn("sample_id", F.concat_ws("::", "asset", "session")), 40), axis)


def gate(path, models=None):
    return release.Gate(str(path), models or {"mean": Mean(), "ridge": Ridge(1.0)}, ["ret"], weekly.WALK, 52.0)


def test_stages_follow_each_other(world, tmp_path):
    development, held, axis = world
    found = gate(tmp_path)
    for early in (lambda: found.choose(development), lambda: found.attempt(development, held), lambda: found.diagnose(held)):
        with pytest.raises(HoldoutError, match="missing"):
            early()
    first = found.develop(development, axis)
    with pytest.raises(HoldoutError, match="already"):
        found.develop(development, axis)
    with pytest.raises(HoldoutError, match="not those of the development"):
        found.choose(development.limit(100))
    with pytest.raises(HoldoutError, match="not those of the development"):
        gate(tmp_path, {"mean": Mean(), "ridge": Ridge(2.0)}).choose(development)
    chosen = found.choose(development)
    assert chosen["previous"] == first["digest"] and chosen["selected"] == release.smallest(first["scores"])
    with pytest.raises(HoldoutError, match="choice was made on"):
        found.attempt(development.limit(100), held)
    done = found.attempt(development, held)
    assert done["receipt"]["status"] == "scored" and done["receipt"]["samples"] == held.count()
    with pytest.raises(HoldoutError, match="used"):
        found.attempt(development, held)
    with pytest.raises(HoldoutError, match="not the one"):
        found.diagnose(held.limit(3))
    said = found.diagnose(held)
    assert abs(said["mse"] - done["receipt"]["score"]) < 1e-12 and said["observations"] == held.count() and said["sessions"] == 40


@pytest.mark.parametrize("tampered", ["development", "choice"])
def test_a_changed_stage_stops_the_next(world, tmp_path, tampered):
    development, held, axis = world
    found = gate(tmp_path)
    found.develop(development, axis)
    found.choose(development)
    path = tmp_path / f"{tampered}.json"
    document = json.loads(path.read_text())
    if tampered == "choice":
        document["selected"] = "ridge" if document["selected"] == "mean" else "mean"
    else:
        document["scores"]["mean"] = 0.0
    path.unlink()
    (tmp_path / f".{tampered}.json.crc").unlink(missing_ok=True)
    path.write_text(json.dumps(document))
    with pytest.raises(HoldoutError, match=f"{tampered} was changed"):
        found.attempt(development, held)


def test_defaults_and_ties(spark):
    assert release.smallest({"b": 1.0, "a": 1.0, "c": 2.0}) == "b"
    rows = spark.createDataFrame([("2024-01-01", 1.0, 0.5), ("2024-01-01", 2.0, 0.5), ("2024-01-02", 1.0, 0.1)], "session string, target double, prediction double")
    assert release.diagnostics(rows, 252.0).first().asDict() == {"mse": pytest.approx((0.25 + 2.25 + 0.81) / 3), "cross_sectional_ic": 0.0, "diagnostic_sharpe": 0.0, "observations": 3, "sessions": 2, "ic_sessions": 0}
