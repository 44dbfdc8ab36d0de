"""The forward ledger in a folder on any file system: a protocol, then batches of predictions and of settlements.

A batch is one turn. A writer checks its rows against all finished turns, claims the next one by a file that must not
exist yet, and writes; so of two writers that saw the same ledger one is refused, and no sample is recorded twice.
A writer lost in between leaves a claimed, unfinished turn, and the store takes no more batches of that kind until
someone has looked at it and removed the claim.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.errors import LedgerError
from tidegate.model import digest
from tidegate.operators import forward
from tidegate.session import kept
from tidegate.sources.sinks import create_exclusive

PREDICTION = {
    "sample_id": "string", "asset": "string", "decision_session": "date", "label_end_session": "date",
    "label_available_at": "timestamp", "prediction": "double", "feature_snapshot_digest": "string",
}
SETTLEMENT = {"prediction_digest": "string", "target": "double", "target_source_digest": "string"}
RECORDED = PREDICTION | {"protocol_digest": "string", "recorded_at": "timestamp", "prediction_digest": "string"}
SETTLED = SETTLEMENT | {"protocol_digest": "string", "settled_at": "timestamp"}
_FINITE = "{0} is not null and not isnan({0}) and abs({0}) < double('inf')"


def fields(kinds: dict[str, str]) -> str:
    return ", ".join(f"{n} {k}" for n, k in kinds.items())


def _digest() -> Column:
    return forward.prediction_digest("protocol_digest", *PREDICTION, "recorded_at")


def _refuse(found: dict[str, int]) -> None:
    if bad := {k: v for k, v in found.items() if v}:
        raise LedgerError("; ".join(f"{k}: {v}" for k, v in sorted(bad.items())))


@dataclass(frozen=True)
class ForwardStore:
    """`clock` gives the present instant, with its time zone; tests hand in their own."""

    spark: SparkSession
    path: str
    clock: Callable[[], datetime] = lambda: datetime.now(UTC)

    def register(self, protocol: forward.ForwardProtocol) -> str:
        """Keep a protocol for good and return its digest; the same one may be registered again."""
        key = digest(protocol)
        if not self._exists(f"protocols/{key}.json"):
            create_exclusive(self.spark, f"{self.path}/protocols/{key}.json", protocol.__dict__)
        return key

    def record(self, protocol: forward.ForwardProtocol, batch: DataFrame) -> DataFrame:
        """Add predictions (the columns of PREDICTION), all or none, and return them with their digests.

        Refused are rows with a missing column, decisions before the protocol's start, labels that are available
        already or do not end after the decision, numbers that are not finite, and samples that were recorded before.
        """
        key, now, turn = self._registered(protocol), self._now(), self._next("predictions")
        rows = batch.select(*[F.col(n).cast(k).alias(n) for n, k in PREDICTION.items()], F.lit(key).alias("protocol_digest"), F.lit(now).alias("recorded_at"))
        rows = kept(rows.withColumn("prediction_digest", _digest()), "forward-batch")
        missing = " or ".join(f"{n} is null" for n in PREDICTION)
        faults = forward.prediction_faults(rows, protocol.forward_start).where("fault is not null").groupBy("fault").count().collect()  # a row for each rule
        _refuse({
            **{r["fault"]: r["count"] for r in faults},
            "missing-value": rows.where(missing).count(),
            "repeated-sample": forward.repeated(rows, "sample_id").count(),
            "recorded-before": rows.join(self.predictions().select("sample_id"), "sample_id", "left_semi").count(),
        })
        return self._write("predictions", turn, rows)

    def settle(self, protocol: forward.ForwardProtocol, batch: DataFrame) -> DataFrame:
        """Add labels (the columns of SETTLEMENT), all or none, to predictions whose label is available by now."""
        key, now, turn = self._registered(protocol), self._now(), self._next("settlements")
        rows = batch.select(*[F.col(n).cast(k).alias(n) for n, k in SETTLEMENT.items()], F.lit(key).alias("protocol_digest"), F.lit(now).alias("settled_at"))
        rows = kept(rows, "forward-batch")
        known = self.predictions().where(F.col("protocol_digest") == key).select("prediction_digest", "label_available_at", "recorded_at")
        early = rows.join(known, "prediction_digest").where("settled_at < label_available_at or settled_at <= recorded_at")
        _refuse({
            "missing-value": rows.where(" or ".join(f"{n} is null" for n in SETTLEMENT)).count(),
            "target-not-finite": rows.where(f"not ({_FINITE.format('target')})").count(),
            "orphan-settlement": rows.join(known, "prediction_digest", "left_anti").count(),
            "settled-early": early.count(),
            "repeated-settlement": forward.repeated(rows, "prediction_digest").count(),
            "settled-before": rows.join(self.settlements().select("prediction_digest"), "prediction_digest", "left_semi").count(),
        })
        return self._write("settlements", turn, rows)

    def report(self, protocol: forward.ForwardProtocol) -> DataFrame:
        """The protocol's evidence in one row, after every rule of the ledger has been checked on what is stored."""
        key = self._registered(protocol)
        predictions, settlements = self.predictions(), self.settlements()
        _refuse({
            "foreign-protocol": predictions.where(F.col("protocol_digest") != key).count() + settlements.where(F.col("protocol_digest") != key).count(),
            "changed-prediction": predictions.where(F.col("prediction_digest") != _digest()).count(),
        })
        forward.require_integrity(predictions, settlements, protocol.forward_start)
        return forward.report(predictions, settlements, protocol)

    def predictions(self) -> DataFrame:
        return self._read("predictions", RECORDED)

    def settlements(self) -> DataFrame:
        return self._read("settlements", SETTLED)

    def _now(self) -> datetime:
        now = self.clock()
        if now.utcoffset() is None:
            raise LedgerError("the clock must give instants with a time zone")
        return now

    def _registered(self, protocol: forward.ForwardProtocol) -> str:
        key = digest(protocol)
        if not self._exists(f"protocols/{key}.json"):
            raise LedgerError("the protocol is not registered")
        return key

    def _files(self, name: str) -> tuple:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _exists(self, name: str) -> bool:
        files, target = self._files(name)
        return files.exists(target)

    def _turns(self, kind: str) -> int:
        files, target = self._files(f"claims/{kind}")
        return sum(s.getPath().getName().endswith(".json") for s in files.listStatus(target)) if files.exists(target) else 0

    def _finished(self, kind: str, turn: int) -> bool:
        return self._exists(f"{kind}/turn={turn}/_SUCCESS")

    def _next(self, kind: str) -> int:
        turn = self._turns(kind)
        if turn and not self._finished(kind, turn - 1):
            raise LedgerError("a batch is being written, or was left unfinished")
        return turn

    def _write(self, kind: str, turn: int, rows: DataFrame) -> DataFrame:
        create_exclusive(self.spark, f"{self.path}/claims/{kind}/{turn}.json", {"turn": turn})
        try:
            rows.write.parquet(f"{self.path}/{kind}/turn={turn}")
        except PySparkException as error:
            raise LedgerError("the turn is claimed, but its rows could not be written") from error
        return rows

    def _read(self, kind: str, kinds: dict[str, str]) -> DataFrame:
        turns = [t for t in range(self._turns(kind)) if self._finished(kind, t)]
        if not turns:
            return self.spark.createDataFrame([], fields(kinds))
        return self.spark.read.schema(fields(kinds)).parquet(*[f"{self.path}/{kind}/turn={t}" for t in turns])
