"""One attempt at the holdout: claimed before anything is fitted, consumed even by a failure."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.errors import HoldoutError, LedgerError, TidegateError
from tidegate.functions.risk import mse
from tidegate.model import data_digest, digest
from tidegate.operators.evaluate import identity, predict
from tidegate.sources.sinks import create_exclusive


@dataclass(frozen=True)
class HoldoutProtocol:
    protocol_id: str
    model_digest: str
    dataset_digest: str

    @classmethod
    def freeze(cls, protocol_id: str, train: DataFrame, held: DataFrame, model: object) -> HoldoutProtocol:
        """The protocol of these very samples and this very model."""
        return cls(protocol_id, identity(model), digest([data_digest(train), data_digest(held)]))


def boundary(train: DataFrame, held: DataFrame) -> dict[str, object]:
    """What must not cross: sessions, information and sample ids."""
    last = train.agg(F.max("session").alias("session"), F.max("info_end").alias("info")).first()
    first = held.agg(F.min("session").alias("session"), F.min("info_start").alias("info")).first()
    shared = train.select("sample_id").intersect(held.select("sample_id")).count()
    return {"sessions_apart": last["session"] < first["session"], "information_apart": last["info"] < first["info"], "shared_ids": shared}


def evaluate_once(train: DataFrame, held: DataFrame, protocol: HoldoutProtocol, store: str, features: list[str], estimator: Callable, score=mse, predictions: str | None = None) -> dict[str, object]:
    """Fit on `train`, score `held` once and keep a receipt of counts, digests and the score.

    The claim is a file that only one attempt can create, written before any fit; a failed attempt is spent too.
    Before that, samples and model must be those that the protocol was frozen for. `estimator` may be `Mean()` or
    `Ridge()`, which are aggregates and take training data of any size. With `predictions` they are kept in that folder.
    """
    found = boundary(train, held)
    if not found["sessions_apart"] or not found["information_apart"] or found["shared_ids"]:
        raise HoldoutError("training reaches into the holdout")
    now = HoldoutProtocol.freeze(protocol.protocol_id, train, held, estimator)
    if now.model_digest != protocol.model_digest:
        raise HoldoutError("the model is not the protocol's")
    if now.dataset_digest != protocol.dataset_digest:
        raise HoldoutError("the samples are not the protocol's")
    key, spark = digest(protocol), train.sparkSession
    try:
        create_exclusive(spark, f"{store}/claims/{key}.json", {"protocol": key})
    except LedgerError as error:
        raise HoldoutError("this protocol's attempt is used") from error
    receipt: dict[str, object] = {"protocol": key, "status": "failed"}
    try:
        rows = train.withColumn("role", F.lit("train")).unionByName(held.withColumn("role", F.lit("test"))).withColumn("fold", F.lit(0).cast("long"))
        done = predict(rows, features, estimator, keys=("sample_id",))
        if predictions:
            done.select("sample_id", "target", "prediction").write.parquet(predictions)
            done = spark.read.parquet(predictions)
        value, n = done.agg(score().alias("score"), F.count("*").alias("n")).first()
        receipt |= {"status": "scored", "score": value, "samples": n}
        return receipt
    except TidegateError:
        raise
    finally:
        create_exclusive(spark, f"{store}/receipts/{key}.json", receipt)
