"""The forward ledger: predictions recorded before their labels exist, settled later, and reported."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.errors import LedgerError
from tidegate.operators.metrics import session_ic


@dataclass(frozen=True)
class ForwardProtocol:
    """What a forward test promises in advance."""

    protocol_id: str
    forward_start: str
    minimum_settled: int = 1
    minimum_sessions: int = 1
    minimum_ic: float = 0.0
    minimum_assets: int = 1
    require_mse: bool = True
    development_end: str | None = None
    model_digest: str | None = None
    dataset_digest: str | None = None

    def __post_init__(self) -> None:
        start = date.fromisoformat(self.forward_start)
        if self.development_end is not None and start <= date.fromisoformat(self.development_end):
            raise LedgerError("forward_start must be after development_end")
        if not self.protocol_id or min(self.minimum_settled, self.minimum_sessions, self.minimum_assets) < 1 or not -1 <= self.minimum_ic <= 1:
            raise LedgerError("a protocol needs an id, minimums of at least 1 and minimum_ic between -1 and 1")


def prediction_digest(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in columns]), 256)


def prediction_faults(predictions: DataFrame, forward_start: str) -> DataFrame:
    """`predictions` with `fault`: the first ledger rule a row breaks, or null. Repeated samples are found by `repeated`."""
    return predictions.withColumn(
        "fault",
        F.when(F.col("decision_session") < F.lit(forward_start).cast("date"), "before-forward-start")
        .when(F.col("label_end_session") <= F.col("decision_session"), "label-not-after-decision")
        .when(F.col("recorded_at") >= F.col("label_available_at"), "recorded-after-label")
        .when(~F.coalesce(F.abs("prediction") < float("inf"), F.lit(False)) | F.isnan("prediction"), "prediction-not-finite"),
    )


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def settled_pairs(predictions: DataFrame, settlements: DataFrame) -> DataFrame:
    """Predictions with their settlement, where the label was available and the prediction was there before."""
    pairs = predictions.join(settlements, "prediction_digest")
    return pairs.where((F.col("settled_at") >= F.col("label_available_at")) & (F.col("settled_at") > F.col("recorded_at")))


def integrity(predictions: DataFrame, settlements: DataFrame, forward_start: str) -> DataFrame:
    """(rule, violations) of a ledger."""
    faults = prediction_faults(predictions, forward_start).groupBy(F.col("fault").alias("rule")).agg(F.count("*").alias("violations")).where("rule is not null")
    count = lambda rows, name: rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
    found = faults.unionByName(count(repeated(predictions, "sample_id"), "repeated-sample"))
    found = found.unionByName(count(repeated(settlements, "prediction_digest"), "repeated-settlement"))
    orphans = settlements.join(predictions.select("prediction_digest"), "prediction_digest", "left_anti")
    early = predictions.join(settlements, "prediction_digest").where("settled_at < label_available_at or settled_at <= recorded_at")
    return found.unionByName(count(orphans, "orphan-settlement")).unionByName(count(early, "settled-early"))


def require_integrity(predictions: DataFrame, settlements: DataFrame, forward_start: str) -> None:
    bad = integrity(predictions, settlements, forward_start).where("violations > 0").collect()  # a row for each rule
    if bad:
        raise LedgerError("; ".join(f"{r['rule']}: {r['violations']}" for r in sorted(bad)))


def report(predictions: DataFrame, settlements: DataFrame, protocol: ForwardProtocol) -> DataFrame:
    """One row: predictions, settled, sessions, mse, zero_mse, mean_ic and status; also assets, where predictions name them.

    A mean squared error equal to that of forecasting zero is not worse than it; without any session that has a rank
    correlation the evidence fails.
    """
    pairs = settled_pairs(predictions, settlements).withColumnRenamed("decision_session", "session")
    made = predictions.agg(F.count("*").alias("predictions"))
    named = "asset" in predictions.columns
    done = pairs.agg(
        F.count("*").alias("settled"),
        F.count_distinct("session").alias("sessions"),
        *([F.count_distinct("asset").alias("assets")] if named else []),
        F.avg((F.col("target") - F.col("prediction")) * (F.col("target") - F.col("prediction"))).alias("mse"),
        F.avg(F.col("target") * F.col("target")).alias("zero_mse"),
    )
    ic = session_ic(pairs.withColumn("all", F.lit(1)), ["all"], least=2).agg(F.avg("ic").alias("mean_ic"))
    return with_status(made.join(F.broadcast(done)).join(F.broadcast(ic)), protocol)  # one row each


def with_status(row: DataFrame, protocol: ForwardProtocol) -> DataFrame:
    """One row of a report with `status`, by the protocol's minimums."""
    enough = (F.col("settled") >= protocol.minimum_settled) & (F.col("sessions") >= protocol.minimum_sessions)
    if "assets" in row.columns:
        enough &= F.col("assets") >= protocol.minimum_assets
    good = F.coalesce(F.col("mean_ic") >= protocol.minimum_ic, F.lit(False))
    if protocol.require_mse:
        good &= F.col("mse") <= F.col("zero_mse")
    status = F.when(F.col("predictions") == 0, "WAITING_FOR_FUTURE_DATA").when(~enough, "COLLECTING").when(good, "READY_FOR_REVIEW").otherwise("FAIL")
    return row.withColumn("status", status)
