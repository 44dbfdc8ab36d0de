"""The ledger's streams: rounds out of order, late rows, restarts, repeated batches, bounded state, and reports."""

import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegate.operators import forward
from tidegate.streaming.forward import PREDICTION, SETTLEMENT, LedgerStreams, prediction_fault, replay, shaped

DAY = datetime(2024, 1, 1)


def at(day):
    return DAY + timedelta(days=day)


def made(name, day, digest=None, value=0.5, asset="A"):
    """A prediction of day `day` whose label is there two days later."""
    return (name, digest or f"d-{name}", asset, (DAY + timedelta(days=day)).date(), at(day + 2), at(day), value)


def done(name, day, target=1.0):
    return (f"d-{name}", at(day), target)


@pytest.fixture(autouse=True)
def two_partitions(spark):
    """State stores for each partition are what takes the time here."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def feed(spark, streams, name, schema, time, rows):
    """Add rows to a side's source, and run ingestion and claims over what is new."""
    source = f"{streams.root}/{name}/source"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    streams.ingest(name, spark.readStream.schema(schema).parquet(source), time)
    return streams.claim(name, schema, "prediction_digest", time, prediction_fault("2024-01-01") if name == "predictions" else None)


def both(spark, streams, predictions, settlements):
    if predictions:
        feed(spark, streams, "predictions", PREDICTION, "recorded_at", predictions)
    if settlements:
        feed(spark, streams, "settlements", SETTLEMENT, "settled_at", settlements)
    return streams.settle()


def said(streams):
    return sorted((r["prediction_digest"], r["outcome"]) for r in streams.everything().collect())


def test_rounds_out_of_order_lose_nothing_and_state_is_bounded(spark, tmp_path):
    """Five rounds of predictions and settlements, some before their partner; what waits too long leaves, late rows are set aside."""
    streams = LedgerStreams(spark, str(tmp_path), lateness_hours=48, keep_days=20)
    held = []
    for k in range(5):
        day = 30 * k
        predictions = [made(f"{k}{n}", day + n) for n in range(4)] + ([made("old", 1)] if k == 4 else []) + ([made("00", 61)] if k == 2 else [])
        # the first settlement of a round comes a round after its prediction's, and another has no prediction
        settlements = [done(f"{k}1", day + 3), done(f"{k}2", day + 2), done(f"{k}x", day + 4)]
        query = both(spark, streams, predictions, settlements)
        held.append(sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]))
    both(spark, streams, [made("end", 400)], [done("finish", 400)])
    found = said(streams)
    for k in range(5):
        assert (f"d-{k}1", "settled") in found and (f"d-{k}2", "settled-early") in found and (f"d-{k}x", "orphan-settlement") in found and (f"d-{k}3", "unsettled") in found
    assert ("d-old", "late-prediction") in found and ("d-00", "unsettled") in found and found.count(("d-00", "unsettled")) == 2  # forgotten after twenty days, then taken again
    assert len(found) == 5 * 5 + 2  # four predictions and a lone settlement a round, the late row and the key that came again
    assert max(held) <= 16 and held[-1] <= held[1] + 4


def test_first_claims_duplicates_faults_and_a_restart(spark, tmp_path):
    """Each claim once, also when another process goes on from the checkpoint, or the last batch runs again."""
    first = LedgerStreams(spark, str(tmp_path), lateness_hours=240)
    late_label = ("f", "d-f", "A", date(2024, 1, 5), at(4), at(5), 0.5)
    feed(spark, first, "predictions", PREDICTION, "recorded_at", [made("a", 5), made("b", 6, "d-a"), late_label, made("n", 5, value=float("nan")), ("e", "d-e", "A", date(2023, 12, 31), at(9), at(5), 0.5)])
    second = LedgerStreams(spark, str(tmp_path), lateness_hours=240)
    feed(spark, second, "predictions", PREDICTION, "recorded_at", [made("c", 4, "d-a"), made("f", 7), made("g", 8)])
    claimed = lambda: sorted((r["sample_id"], r["outcome"]) for r in spark.read.parquet(f"{tmp_path}/predictions/claimed").collect())
    want = [("a", "accepted"), ("b", "duplicate"), ("c", "duplicate"), ("e", "before-forward-start"), ("f", "accepted"), ("f", "recorded-after-label"), ("g", "accepted"), ("n", "prediction-not-finite")]
    assert claimed() == want
    # the driver was lost before the last batch of ingestion was marked as done: it comes again and changes nothing
    commits = f"{tmp_path}/predictions/checkpoint-split/commits"
    last = max((n for n in os.listdir(commits) if n.isdigit()), key=int)
    os.remove(f"{commits}/{last}")
    if os.path.exists(f"{commits}/.{last}.crc"):
        os.remove(f"{commits}/.{last}.crc")
    feed(spark, second, "predictions", PREDICTION, "recorded_at", [made("h", 9)])
    assert claimed() == sorted([*want, ("h", "accepted")])
    assert spark.read.parquet(f"{tmp_path}/predictions/on-time").count() == 9


def test_claims_share_state_by_buckets(spark, tmp_path):
    """Three hundred keys are a few rows of state; each still has its own first row, and is forgotten at its own time."""
    streams = LedgerStreams(spark, str(tmp_path), keep_days=20, buckets=3)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"  # a bucket comes in parts
    before = spark.conf.get(setting)
    spark.conf.set(setting, "7")
    try:
        keys = [done(str(n), n / 50) for n in range(300)]
        ties = [done("tie", 1, 2.0), done("tie", 1, 1.0), done("100", 1.5, 7.0), done("20", 5, 7.0)]
        query = feed(spark, streams, "settlements", SETTLEMENT, "settled_at", [*ties[:1], *keys, *ties[1:]])
        assert sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]) <= 2 * 3  # keys and a timer for each bucket
        feed(spark, streams, "settlements", SETTLEMENT, "settled_at", [done("far", 22)])  # what was taken on the first day is forgotten
        nobody = [(None, at(22.2), 3.0), (None, at(22.1), 4.0)]
        query = feed(spark, streams, "settlements", SETTLEMENT, "settled_at", [done("0", 22.5, 8.0), done("49", 22.5, 8.0), done("51", 22.5, 8.0), done("299", 22.5, 8.0), *nobody])
    finally:
        spark.conf.set(setting, before)
    rows = spark.read.parquet(f"{tmp_path}/settlements/claimed").collect()
    assert len(rows) == 300 + 4 + 1 + 6
    said_of = lambda key: sorted((r["target"], r["outcome"]) for r in rows if r["prediction_digest"] == key)
    assert said_of("d-tie") == [(1.0, "accepted"), (2.0, "duplicate")]
    assert said_of("d-100") == [(1.0, "duplicate"), (7.0, "accepted")] and said_of("d-20") == [(1.0, "accepted"), (7.0, "duplicate")]
    assert all(said_of(k) == [(1.0, "accepted"), (8.0, "accepted")] for k in ("d-0", "d-49")) and all(said_of(k) == [(1.0, "accepted"), (8.0, "duplicate")] for k in ("d-51", "d-299"))
    assert said_of(None) == [(3.0, "duplicate"), (4.0, "accepted")]
    assert sum(r["outcome"] == "accepted" for r in rows) == 300 + 1 + 1 + 2 + 1


def test_report_after_every_batch(spark, tmp_path):
    """Each report is what the batch report says of all rows so far; a batch that runs again changes nothing."""
    streams = LedgerStreams(spark, str(tmp_path), lateness_hours=1000)
    protocol = forward.ForwardProtocol("p", "2024-01-01", minimum_settled=4, minimum_sessions=2, minimum_assets=2)
    rounds = [
        ([made("a", 1, value=0.1), made("b", 1, value=0.3, asset="B")], [done("zz", 9)]),
        ([made("c", 1, value=0.2, asset="C"), made("d", 2, value=0.4)], [done("a", 4, 0.1), done("b", 4, 0.2)]),
        ([made("e", 2, value=0.1, asset="B")], [done("c", 5, 0.3), done("d", 6, 0.5), done("e", 6, 0.2)]),
    ]
    seen = [[], []]
    reports = lambda: {r["batch"]: r for r in spark.read.parquet(f"{tmp_path}/report/reports").collect()}
    names = ("predictions", "settled", "sessions", "assets", "status", "mse", "zero_mse", "mean_ic")
    for predictions, settlements in rounds:
        seen[0] += predictions
        seen[1] += settlements
        both(spark, streams, predictions, settlements)
        streams.report(protocol)
        found = reports()
        last = found[max(found)]
        want = forward.report(spark.createDataFrame(seen[0], PREDICTION), spark.createDataFrame(seen[1], SETTLEMENT), protocol).first()
        assert [last[n] for n in names[:5]] == [want[n] for n in names[:5]]
        assert all(last[n] == want[n] or abs(last[n] - want[n]) < 1e-12 for n in names[5:])
    assert last["status"] == "READY_FOR_REVIEW" and last["settled"] == 5
    before, commits = reports(), f"{tmp_path}/report/checkpoint-report/commits"
    newest = max((n for n in os.listdir(commits) if n.isdigit()), key=int)
    for name in (newest, f".{newest}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    os.remove(f"{tmp_path}/report/reports/batch={int(newest):09d}/_SUCCESS")  # and its report was not finished
    streams.report(protocol)
    assert reports() == before


def test_replay_names_every_row(spark):
    """Tables with early, repeated, lone and timeless rows: each leaves with an outcome."""
    predictions = spark.createDataFrame([made("a", 1), made("b", 1), made("b2", 3, "d-b"), made("z", 2), ("t", "d-t", "A", None, None, None, 0.5)], PREDICTION)
    settlements = spark.createDataFrame([done("a", 2), done("b", 9, 2.0), done("b", 10), done("x", 3), ("d-y", None, 1.0)], SETTLEMENT)
    found = replay(predictions.drop("asset"), settlements, rounds=2).everything().collect()
    assert sorted((r["prediction_digest"], r["outcome"]) for r in found) == [
        ("d-a", "settled-early"), ("d-b", "duplicate-prediction"), ("d-b", "duplicate-settlement"), ("d-b", "settled"), ("d-t", "late-prediction"), ("d-x", "orphan-settlement"), ("d-y", "late-settlement"), ("d-z", "unsettled"),
    ]
    assert [r["target"] for r in found if r["outcome"] == "settled"] == [2.0] and {r["sample_id"] for r in found if r["outcome"] == "duplicate-prediction"} == {"b2"}


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert replay(none(PREDICTION), none(SETTLEMENT), rounds=1).everything().collect() == []
    assert shaped(none("a int"), SETTLEMENT).where(F.lit(True)).columns == ["prediction_digest", "settled_at", "target"]
