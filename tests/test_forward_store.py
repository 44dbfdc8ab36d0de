"""A forward ledger from registration to its report, with every refusal on the way."""

import json
from dataclasses import replace
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegate import cli
from tidegate.errors import LedgerError
from tidegate.operators import forward
from tidegate.operators.forward import ForwardProtocol
from tidegate.sources.forward_store import PREDICTION, SETTLEMENT, ForwardStore, fields
from tidegate.sources.sinks import create_exclusive

START = datetime(2024, 1, 10, tzinfo=UTC)
PROTOCOL = ForwardProtocol("p", "2024-01-08", minimum_settled=4, minimum_sessions=2, minimum_assets=2, development_end="2024-01-05")


class Clock:
    def __init__(self):
        self.now = START

    def __call__(self):
        return self.now


@pytest.fixture
def store(spark, tmp_path):
    return ForwardStore(spark, str(tmp_path / "store"), Clock())


def predictions(spark, rows):
    """Rows of (sample, day of decision, prediction): the label ends two days on and is available a day after that."""
    made = [(s, s[0], date(2024, 1, d), date(2024, 1, d + 2), datetime(2024, 1, d + 3), p, "f") for s, d, p in rows]
    return spark.createDataFrame(made, fields(PREDICTION))


FOUR = [("a1", 9, 0.1), ("b1", 9, -0.1), ("a2", 10, 0.2), ("b2", 10, 0.3)]


def test_from_registration_to_report(spark, store):
    with pytest.raises(LedgerError, match="not registered"):
        store.record(PROTOCOL, predictions(spark, FOUR))
    assert store.register(PROTOCOL) == store.register(PROTOCOL)
    assert store.report(PROTOCOL).first()["status"] == "WAITING_FOR_FUTURE_DATA"
    made = {r["sample_id"]: r["prediction_digest"] for r in store.record(PROTOCOL, predictions(spark, FOUR)).collect()}
    assert len(set(made.values())) == 4 and store.report(PROTOCOL).first()["status"] == "COLLECTING"
    targets = {"a1": 0.2, "b1": -0.2, "a2": 0.2, "b2": 0.3}
    labels = spark.createDataFrame([(made[s], t, "t") for s, t in targets.items()], fields(SETTLEMENT))
    with pytest.raises(LedgerError, match="settled-early: 4"):
        store.settle(PROTOCOL, labels)
    store.clock.now += timedelta(days=5)
    store.settle(PROTOCOL, labels)
    row = store.report(PROTOCOL).first()
    assert (row["predictions"], row["settled"], row["sessions"], row["assets"], row["status"]) == (4, 4, 2, 2, "READY_FOR_REVIEW")
    assert row["mse"] == pytest.approx(0.005) and row["mean_ic"] == pytest.approx(1)
    with pytest.raises(LedgerError, match="settled-before: 4"):
        store.settle(PROTOCOL, labels)


def test_a_batch_is_taken_whole_or_not_at_all(spark, store):
    store.register(PROTOCOL)
    store.record(PROTOCOL, predictions(spark, FOUR))
    bad = [("c1", 7, 0.1), ("a1", 11, 0.1), ("d1", 11, float("nan")), ("e1", 11, 0.1), ("e1", 12, 0.1), ("f1", 11, None)]
    with pytest.raises(LedgerError) as refused:
        store.record(PROTOCOL, predictions(spark, bad))
    for said in ("before-forward-start: 1", "recorded-before: 1", "repeated-sample: 1", "missing-value: 1", "prediction-not-finite: 2"):
        assert said in str(refused.value)
    store.clock.now += timedelta(days=30)
    with pytest.raises(LedgerError, match="recorded-after-label: 1"):
        store.record(PROTOCOL, predictions(spark, [("g1", 11, 0.1)]))
    odd = spark.createDataFrame([("none", 0.1, "t"), ("none", float("inf"), "t"), (None, 0.1, "t")], fields(SETTLEMENT))
    with pytest.raises(LedgerError) as refused:
        store.settle(PROTOCOL, odd)
    for said in ("orphan-settlement: 3", "target-not-finite: 1", "missing-value: 1", "repeated-settlement: 1"):
        assert said in str(refused.value)
    assert store.predictions().count() == 4 and store.settlements().count() == 0


def test_one_writer_a_turn(spark, store):
    """Of two writers that saw the same ledger one is refused; a turn that was never finished stops the next."""
    store.register(PROTOCOL)
    first = store._next("predictions")
    store.record(PROTOCOL, predictions(spark, FOUR[:2]))
    with pytest.raises(LedgerError, match="already claimed"):
        store._write("predictions", first, store.predictions())
    create_exclusive(spark, f"{store.path}/claims/predictions/1.json", {})
    with pytest.raises(LedgerError, match="unfinished"):
        store.record(PROTOCOL, predictions(spark, FOUR[2:]))
    assert store.predictions().count() == 2


def test_what_was_changed_or_belongs_elsewhere_is_found(spark, store):
    store.register(PROTOCOL)
    rows = store.record(PROTOCOL, predictions(spark, FOUR))
    other = replace(PROTOCOL, protocol_id="q")
    store.register(other)
    with pytest.raises(LedgerError, match="foreign-protocol: 4"):
        store.report(other)
    store._write("predictions", 1, rows.limit(1).withColumn("prediction", F.lit(9.0)))
    with pytest.raises(LedgerError, match="changed-prediction: 1"):
        store.report(PROTOCOL)


def test_report_rules(spark):
    """An error equal to zero's is not worse; no rank correlation is no evidence."""
    at = datetime(2024, 1, 10)
    rows = [(f"s{k}", f"d{k}", date(2024, 1, 9), at, datetime(2024, 1, 9), p) for k, p in enumerate((0.0, 0.4))]
    made = spark.createDataFrame(rows, "sample_id string, prediction_digest string, decision_session date, label_available_at timestamp, recorded_at timestamp, prediction double")
    status = lambda targets, p: forward.report(made, spark.createDataFrame([(f"d{k}", at, t) for k, t in enumerate(targets)], "prediction_digest string, settled_at timestamp, target double"), p).first()["status"]
    protocol = ForwardProtocol("p", "2024-01-08")
    assert status((0.0, 0.2), protocol) == "READY_FOR_REVIEW"  # mse = zero_mse
    assert status((0.2, 0.2), protocol) == "FAIL" and status((0.5, 0.1), protocol) == "FAIL"
    assert status((0.0, 0.1), replace(protocol, require_mse=False)) == "READY_FOR_REVIEW" and status((0.0, 0.1), protocol) == "FAIL"
    for wrong in ({"minimum_assets": 0}, {"development_end": "2024-01-08"}, {"minimum_ic": 2.0}):
        with pytest.raises(LedgerError):
            replace(protocol, **wrong)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    say = lambda *more: (cli.main(["forward", more[0], "--protocol", str(tmp_path / "p.json"), "--store", str(tmp_path / "s"), *more[1:]]), json.loads(capsys.readouterr().out))
    assert say("init")[0] == 2
    (tmp_path / "p.json").write_text(json.dumps({"protocol_id": "p", "forward_start": "2024-01-08"}))
    assert say("status")[1]["error"] == "LedgerError"
    assert say("init")[1]["report"]["status"] == "WAITING_FOR_FUTURE_DATA"
    row = {"sample_id": "a", "asset": "A", "decision_session": "2024-01-09", "label_end_session": "2999-01-01", "label_available_at": "2999-01-02T00:00:00Z", "prediction": 0.1, "feature_snapshot_digest": "f"}
    (tmp_path / "b.json").write_text(json.dumps(row))
    code, found = say("record", "--batch", str(tmp_path / "b.json"))
    assert (code, found["rows"], found["report"]["predictions"], found["report"]["status"]) == (0, 1, 1, "COLLECTING")
    assert say("record", "--batch", str(tmp_path / "b.json"))[1]["message"] == "recorded-before: 1"
