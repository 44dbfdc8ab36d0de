"""Ledger files that were renamed, altered or cut short are refused by name, in batches and in streams."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidegate.errors import LedgerError
from tidegate.sources import ledger_files
from tidegate.sources.forward_store import RECORDED, fields


@pytest.fixture
def folder(spark, tmp_path):
    """Three predictions, each a file named by its digest."""
    rows = [(f"s{k}", "A", date(2024, 1, 2), date(2024, 1, 9), datetime(2024, 1, 9, 1), 0.1 * k, "f", "p", datetime(2024, 1, 2, 3, 4, 5, 678900), None) for k in range(3)]
    made = spark.createDataFrame(rows, fields(RECORDED)).withColumn("prediction_digest", ledger_files.recorded_digest())
    for r in made.select("prediction_digest", ledger_files.document("predictions").alias("text")).collect():
        (tmp_path / f"{r[0]}.json").write_text(json.dumps(json.loads(r[1]), indent=1))
    return tmp_path


def faults(spark, folder):
    return {r["file_name"]: r["fault"] for r in ledger_files.read(spark, str(folder), "predictions").where("fault is not null").collect()}


def test_sound_files(spark, folder):
    assert faults(spark, folder) == {}
    assert sorted(r["sample_id"] for r in ledger_files.sound(ledger_files.read(spark, str(folder), "predictions")).collect()) == ["s0", "s1", "s2"]


@pytest.mark.parametrize("fault", ledger_files.FAULTS)
def test_each_fault_is_refused_by_name(spark, folder, fault):
    first = sorted(folder.glob("*.json"))[0]
    document, name = json.loads(first.read_text()), first.name
    if fault == "malformed":
        first.write_text(first.read_text()[:-9])
    elif fault == "unknown-key":
        first.write_text(json.dumps(document | {"more": 1}))
    elif fault == "missing-value":
        first.write_text(json.dumps({k: v for k, v in document.items() if k != "asset"}))
    elif fault == "altered":
        first.write_text(json.dumps(document | {"prediction": 9.0}))
    else:
        name = "0" * 64 + ".json"
        first.rename(folder / name)
    assert faults(spark, folder) == {name: fault}
    with pytest.raises(LedgerError, match=f"{fault}: {name}"):
        ledger_files.sound(ledger_files.read(spark, str(folder), "predictions"))


def test_streams_say_the_same(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    files = sorted(folder.glob("*.json"))
    files[1].write_text("[]")
    query = ledger_files.stream(spark, str(folder), "predictions", files_a_batch=1).writeStream.format("parquet").option("checkpointLocation", str(out / "c")).trigger(availableNow=True).start(str(out / "t"))
    query.awaitTermination()
    assert {r["file_name"]: r["fault"] for r in spark.read.parquet(str(out / "t")).collect()} == {f.name: "malformed" if f == files[1] else None for f in files}


def test_lines_and_settlements(spark, tmp_path):
    good = {"prediction_digest": "d", "target": 1.5, "target_source_digest": "t", "protocol_digest": "p", "settled_at": "2024-01-01T00:00:00Z"}
    (tmp_path / "turn.json").write_text("\n".join([json.dumps(good), "", json.dumps(good | {"target": "x"}), "nonsense", json.dumps(good | {"target": None})]))
    found = ledger_files.fault_counts(ledger_files.read(spark, str(tmp_path), "settlements", whole=False)).collect()
    assert {r["fault"]: r["rows"] for r in found} == {"none": 1, "malformed": 2, "missing-value": 1}
