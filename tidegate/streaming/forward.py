"""The forward ledger as a chain of restartable streams over event time; the table of each stage is the next one's source.

1. `split_late` sets rows behind the watermark aside in a table of their own, so that no later stage drops any.
2. `claims` keeps the keys that rows took in RocksDB, by buckets, until a timer of event time ends, and labels later rows.
3. `outcomes` joins accepted predictions with accepted settlements inside a range of time, from both sides.
4. `report_stage` keeps per-session sums up to date batch by batch, and writes the ledger's report after each.

Every stage writes what a batch made under the batch's number, and a batch that comes again finds its rows there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidegate.operators.forward import ForwardProtocol, with_status
from tidegate.operators.metrics import session_ic
from tidegate.session import shared_path

#: How far a row may lie behind the newest of earlier batches, and how long a key or an unmatched row is remembered.
LATENESS_HOURS, KEEP_DAYS = 24, 400
#: Groups of keys in the state of claims: more for long-lived state and small batches, fewer for large ones.
BUCKETS = 1 << 16
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PREDICTION = "sample_id string, prediction_digest string, asset string, decision_session date, label_available_at timestamp, recorded_at timestamp, prediction double"
SETTLEMENT = "prediction_digest string, settled_at timestamp, target double"
OUTCOME = "prediction_digest string, sample_id string, asset string, decision_session date, recorded_at timestamp, label_available_at timestamp, prediction double, target double, settled_at timestamp, outcome string"


class Folders:
    """Folders of a stage with one entry for each batch, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *names: str) -> str:
        return "/".join([self.root, *names])

    def _place(self, path: str) -> tuple[Any, Any]:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def exists(self, path: str) -> bool:
        files, place = self._place(path)
        return bool(files.exists(place))

    def publish(self, staged: str, path: str) -> None:
        """Give a finished folder its name with one rename, unless an earlier try of the batch did."""
        if not self.exists(path) and self.exists(staged):
            files, target = self._place(path)
            files.mkdirs(target.getParent())
            if not files.rename(self._place(staged)[1], target) and not self.exists(path):
                raise OSError(f"could not publish {path}")


def batch_name(batch: int) -> str:
    return f"batch={batch:09d}"


def split_late(rows: DataFrame, time: str, root: str, lateness_hours: float = LATENESS_HOURS) -> DataStreamWriter:
    """Rows of a stream as two tables: root/on-time, and root/late for those behind the watermark or without a time.

    The watermark of a batch is the newest time of the batches before it less `lateness_hours`.
    """

    def write(batch_rows: DataFrame, batch: int) -> None:
        spark = batch_rows.sparkSession
        folders = Folders(spark, root)
        done = folders.path("newest", batch_name(batch))
        if folders.exists(f"{done}/_SUCCESS"):
            return
        newest = "newest timestamp"
        before = spark.read.schema(newest).parquet(folders.path("newest", batch_name(batch - 1))).first()[0] if batch else None
        late = F.col(time).isNull()
        if before is not None:
            late |= F.col(time) < F.lit(before) - F.expr(f"INTERVAL {round(lateness_hours * 3600)} SECONDS")
        staged = folders.path("staged", batch_name(batch))
        batch_rows.withColumn("_late", F.coalesce(late, F.lit(True))).write.mode("overwrite").partitionBy("_late").parquet(staged)
        for flag, name in (("true", "late"), ("false", "on-time")):
            folders.publish(f"{staged}/_late={flag}", folders.path(name, batch_name(batch)))
        taken = folders.path("on-time", batch_name(batch))
        times = spark.read.schema(f"{time} timestamp").parquet(taken) if folders.exists(taken) else spark.createDataFrame([], f"{time} timestamp")
        times.agg(F.greatest(F.max(time), F.lit(before).cast("timestamp")).alias("newest")).write.mode("overwrite").parquet(done)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint-split")


class FirstOfKey(StatefulProcessor):
    """Labels the first row of a key `accepted`, the others `duplicate`, until a timer ends `keep` after the first.

    A group is a bucket of keys and its state holds those taken, so that a call and its messages to the store serve many
    rows. `claims_key` is a row's key and `claims_until` the time, in milliseconds, when a key that it takes is free again;
    a bucket's timer is that of its earliest. A row with a `fault` is labelled by it and takes nothing.
    """

    def __init__(self, time: str) -> None:
        self.time = time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getValueState("taken", StructType([StructField("keys", ArrayType(StringType())), StructField("until", ArrayType(LongType()))]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """Of several new rows of a key the earliest is the first; one row for each new key is held back, whatever their number."""
        keys, until = self.taken.get() or ((), ())
        known, held = set(keys), None
        for part in rows:
            bad = part["fault"].notna()
            yield from self._said(part[bad], part["fault"][bad])
            part = part[~bad]
            old = part["claims_key"].isin(known)
            yield from self._said(part[old], "duplicate")
            part = part[~old]
            if len(part):
                part = self._in_order(part if held is None else pd.concat([held, part]))
                again = part.duplicated("claims_key")
                yield from self._said(part[again], "duplicate")
                held = part[~again]
        if held is not None:
            ends = held["claims_until"].astype("int64").tolist()
            self.taken.update(([*keys, *held["claims_key"]], [*until, *ends]))
            if not until or min(ends) < min(until):
                self.handle.registerTimer(min(ends))
            yield from self._said(held, "accepted")

    def _in_order(self, rows: pd.DataFrame) -> pd.DataFrame:
        """By time; ties of a key go by the rows' own text."""
        tied = rows.duplicated(["claims_key", self.time], keep=False)
        if not tied.any():
            return rows.sort_values(self.time)
        text = ["|".join(map(str, r)) if t else "" for t, r in zip(tied, rows.itertuples(index=False))]
        return rows.assign(_text=text).sort_values([self.time, "_text"]).drop(columns="_text")

    @staticmethod
    def _said(rows: pd.DataFrame, outcome: Any) -> Iterator[pd.DataFrame]:
        if len(rows):
            yield rows.assign(outcome=outcome).drop(columns=["claims_bucket", "claims_key", "claims_until"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Spark's timers end once the watermark has passed them."""
        keys, until = self.taken.get() or ((), ())
        left = [(k, u) for k, u in zip(keys, until) if u >= timerValues.getCurrentWatermarkInMs()]
        if left:
            keys, until = zip(*left)
            self.taken.update((list(keys), list(until)))
            self.handle.registerTimer(min(until))
        else:
            self.taken.clear()
        yield from ()

    def close(self) -> None:
        pass


def prediction_fault(forward_start: str | None = None) -> Column:
    """Why a recorded prediction claims nothing: a label that was there already, a value that is not finite, a session too early."""
    value = F.col("prediction")
    fault = F.when(F.col("recorded_at") >= F.col("label_available_at"), "recorded-after-label").when(~F.coalesce(F.abs(value) < float("inf"), F.lit(False)) | F.isnan(value), "prediction-not-finite")
    return fault if forward_start is None else fault.when(F.col("decision_session") < F.lit(forward_start).cast("date"), "before-forward-start")


def claims(rows: DataFrame, key: str, time: str, lateness_hours: float = LATENESS_HOURS, keep_days: float = KEEP_DAYS, fault: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows of a stream of on-time rows with `outcome`: accepted, duplicate where the key was taken before, or the `fault`.

    A key is forgotten once the watermark is `keep_days` past the row that took it. Null keys are one key. A batch reads and
    writes the state of the `buckets` of keys that it touches; their number stays as long as the checkpoint.
    """
    rows = rows.withColumn("fault", F.lit(None).cast("string") if fault is None else fault)
    kinds = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
    marked = rows.withWatermark(time, f"{round(lateness_hours * 3600)} seconds")
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    dealt = marked.withColumn("claims_key", named).withColumn("claims_until", F.unix_millis(time) + round(keep_days * 86_400_000)).withColumn("claims_bucket", F.pmod(F.xxhash64("claims_key"), F.lit(buckets)))
    return dealt.groupBy("claims_bucket").transformWithStateInPandas(FirstOfKey(time), f"{kinds}, outcome string", "Append", "eventTime").drop("fault")


def outcomes(predictions: DataFrame, settlements: DataFrame, lateness_hours: float = LATENESS_HOURS, keep_days: float = KEEP_DAYS) -> DataFrame:
    """One row, as OUTCOME, for each accepted prediction and each accepted settlement that finds none.

    settled: the label was available, and the prediction there before; settled-early: not so. Rows without a partner
    within `keep_days` of event time on either side leave the state when both watermarks have passed that, as unsettled
    and orphan-settlement.
    """
    delay, span = f"{round(lateness_hours * 3600)} seconds", F.expr(f"INTERVAL {round(keep_days * 86400)} SECONDS")
    left = predictions.withColumn("_made", F.lit(True)).withWatermark("recorded_at", delay)
    right = settlements.withColumnRenamed("prediction_digest", "_digest").withColumn("_done", F.lit(True)).withWatermark("settled_at", delay)
    near = (F.col("settled_at") >= F.col("recorded_at") - span) & (F.col("settled_at") <= F.col("recorded_at") + span)
    found = left.join(right, (F.col("prediction_digest") == F.col("_digest")) & near, "full_outer")
    ready = (F.col("settled_at") >= F.col("label_available_at")) & (F.col("settled_at") > F.col("recorded_at"))
    outcome = F.when(F.col("_made").isNull(), "orphan-settlement").when(F.col("_done").isNull(), "unsettled").when(ready, "settled").otherwise("settled-early")
    names = [c.split(" ")[0] for c in OUTCOME.split(", ")]
    return found.withColumn("outcome", outcome).withColumn("prediction_digest", F.coalesce("prediction_digest", "_digest")).select(names)


SESSIONS = "session date, settled long, squared double, zero double, ic double"


def report_stage(accepted: DataFrame, settled: DataFrame, protocol: ForwardProtocol, root: str) -> DataStreamWriter:
    """After each batch, one row in root/reports: what the batch report says of all rows so far.

    `accepted` streams predictions, `settled` outcomes. A batch recomputes the sums and the rank correlation of the
    sessions it touches, from their pairs; all other sessions stay as earlier batches left them.
    """
    both = accepted.select(F.lit(None).cast("string").alias("outcome"), *[F.lit(None).cast(k).alias(n) for n, k in (c.split(" ") for c in OUTCOME.split(", ")[:-1])])
    both = both.unionByName(settled.select("outcome", *[c.split(" ")[0] for c in OUTCOME.split(", ")[:-1]]))
    pair = "asset string, prediction double, target double"

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        folders = Folders(spark, root)
        at = batch_name(batch)
        if folders.exists(folders.path("reports", at, "_SUCCESS")):
            return
        new = rows.where("outcome = 'settled'").select(F.col("decision_session").alias("session"), "asset", "prediction", "target", F.lit(batch).alias("batch"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session", "batch").parquet(folders.path("pairs"))
        rows.where("outcome is null").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(folders.path("made", at))
        pairs = spark.read.schema(f"{pair}, session date, batch long").parquet(folders.path("pairs"))
        touched = [r[0] for r in pairs.where(F.col("batch") == batch).select("session").distinct().collect()]  # a date for each session
        mine = pairs.where(F.col("session").isin(touched) & (F.col("batch") <= batch)) if touched else pairs.limit(0)
        error = F.col("target") - F.col("prediction")
        sums = mine.groupBy("session").agg(F.count("*").alias("settled"), F.sum(error * error).alias("squared"), F.sum(F.col("target") * F.col("target")).alias("zero"))
        ic = session_ic(mine.withColumn("all", F.lit(1)), ["all"], least=2).select("session", "ic")
        sums.join(ic, "session", "left").write.mode("overwrite").parquet(folders.path("sessions", at))
        mine.where(F.col("batch") == batch).select("asset").distinct().write.mode("overwrite").parquet(folders.path("assets", at))
        report_so_far(spark, root, protocol, batch).coalesce(1).write.mode("overwrite").parquet(folders.path("reports", at))

    return both.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint-report")


def report_so_far(spark: SparkSession, root: str, protocol: ForwardProtocol, batch: int) -> DataFrame:
    """The report from the sums that batches up to `batch` left: the newest of each session counts."""
    upto = lambda name, schema: spark.read.schema(f"{schema}, batch long").parquet(f"{root}/{name}").where(F.col("batch") <= batch)
    newest = upto("sessions", SESSIONS)
    newest = newest.groupBy("session").agg(F.max_by(F.struct("settled", "squared", "zero", "ic"), "batch").alias("s")).select("session", "s.*")
    done = newest.agg(F.coalesce(F.sum("settled"), F.lit(0)).alias("settled"), F.count("*").alias("sessions"), (F.sum("squared") / F.sum("settled")).alias("mse"), (F.sum("zero") / F.sum("settled")).alias("zero_mse"), F.avg("ic").alias("mean_ic"))
    made = upto("made", "n long").agg(F.sum("n").alias("predictions"))
    assets = upto("assets", "asset string").agg(F.count_distinct("asset").alias("assets"))
    return with_status(made.join(F.broadcast(done)).join(F.broadcast(assets)), protocol)  # one row each


@dataclass(frozen=True)
class LedgerStreams:
    """All stages under one folder, each with its own checkpoint there; call them in order, or keep them running."""

    spark: SparkSession
    root: str
    lateness_hours: float = LATENESS_HOURS
    keep_days: float = KEEP_DAYS
    buckets: int = BUCKETS

    def _table(self, schema: str, *names: str) -> DataFrame:
        """A stage's table as a stream. Each trigger takes all batches that are there: half a batch would move the watermark past the rest."""
        path = "/".join([self.root, *names])
        folders = Folders(self.spark, path)
        folders._place(path)[0].mkdirs(folders._place(path)[1])
        return self.spark.readStream.schema(schema).parquet(path)

    def _start(self, writer: DataStreamWriter, forever: bool) -> StreamingQuery:
        """Start with RocksDB as the state store; without `forever` until the sources are used up."""
        setting = "spark.sql.streaming.stateStore.providerClass"
        before = self.spark.conf.get(setting, None)
        self.spark.conf.set(setting, ROCKSDB)
        try:
            query = writer.start() if forever else writer.trigger(availableNow=True).start()
        finally:
            self.spark.conf.unset(setting) if before is None else self.spark.conf.set(setting, before)
        if not forever:
            query.awaitTermination()
        return query

    def _to_table(self, rows: DataFrame, *names: str) -> DataStreamWriter:
        path = "/".join([self.root, *names])
        return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", f"{path}-checkpoint")

    def ingest(self, name: str, rows: DataFrame, time: str, forever: bool = False) -> StreamingQuery:
        return self._start(split_late(rows, time, f"{self.root}/{name}", self.lateness_hours), forever)

    def claim(self, name: str, schema: str, key: str, time: str, fault: Column | None = None, forever: bool = False) -> StreamingQuery:
        source = self._table(f"{schema}, batch string", name, "on-time").drop("batch")
        return self._start(self._to_table(claims(source, key, time, self.lateness_hours, self.keep_days, fault, self.buckets), name, "claimed"), forever)

    def accepted(self, name: str, schema: str) -> DataFrame:
        return self._table(f"{schema}, outcome string", name, "claimed").where("outcome = 'accepted'").drop("outcome")

    def settle(self, forever: bool = False) -> StreamingQuery:
        found = outcomes(self.accepted("predictions", PREDICTION), self.accepted("settlements", SETTLEMENT), self.lateness_hours, self.keep_days)
        return self._start(self._to_table(found, "outcomes"), forever)

    def report(self, protocol: ForwardProtocol, forever: bool = False) -> StreamingQuery:
        return self._start(report_stage(self.accepted("predictions", PREDICTION), self._table(OUTCOME, "outcomes"), protocol, f"{self.root}/report"), forever)

    def everything(self) -> DataFrame:
        """What became of every row so far, as OUTCOME: late, duplicate and faulty ones, too; those still open are absent."""
        folders = Folders(self.spark, self.root)

        def read(schema: str, *names: str) -> DataFrame:
            return self.spark.read.schema(schema).parquet(folders.path(*names)) if folders.exists(folders.path(*names)) else self.spark.createDataFrame([], schema)

        found = read(OUTCOME, "outcomes")
        for name, schema, kind in (("predictions", PREDICTION, "prediction"), ("settlements", SETTLEMENT, "settlement")):
            late = read(schema, name, "late").withColumn("outcome", F.lit(f"late-{kind}"))
            refused = read(f"{schema}, outcome string", name, "claimed").where("outcome <> 'accepted'")
            refused = refused.withColumn("outcome", F.when(F.col("outcome") == "duplicate", f"duplicate-{kind}").otherwise(F.col("outcome")))
            found = found.unionByName(late, allowMissingColumns=True).unionByName(refused, allowMissingColumns=True)
        return found.where(~F.coalesce(F.startswith("prediction_digest", F.lit(CLOSING)), F.lit(False)))


#: Rows of a replayed table for each partition of state, which lasts as long as its checkpoint.
ROWS_A_PARTITION = 200_000
#: Rows of the larger replayed table for each bucket of keys.
ROWS_A_BUCKET = 500
#: How the digests of rows begin that only move the watermarks of a replay to its end.
CLOSING = "closing-"


def shaped(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema; those that `rows` lacks are null."""
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(k).alias(n) for n, k in (c.split(" ") for c in schema.split(", "))])


def replay(predictions: DataFrame, settlements: DataFrame, lateness_hours: float = LATENESS_HOURS, keep_days: float = KEEP_DAYS, rounds: int = 2) -> LedgerStreams:
    """Feed two tables to the stages in `rounds` of event time, and let every row leave with an outcome.

    A last round has a row in each stream that is later than all others by more than state waits. Rows without a time
    come in the first round, and are late.
    """
    spark = predictions.sparkSession
    sides = (("predictions", shaped(predictions, PREDICTION), PREDICTION, "recorded_at"), ("settlements", shaped(settlements, SETTLEMENT), SETTLEMENT, "settled_at"))
    spans = [rows.agg(F.min(time), F.max(time), F.count("*")).first() for _, rows, _, time in sides]
    streams = LedgerStreams(spark, shared_path(spark, "ledger-streams"), lateness_hours, keep_days, 1 + max(s[2] for s in spans) // ROWS_A_BUCKET)
    first, last = min((s[0] for s in spans if s[0]), default=datetime(2000, 1, 1)), max((s[1] for s in spans if s[1]), default=datetime(2000, 1, 1))
    end = last + timedelta(days=2 * keep_days + 1, hours=2 * lateness_hours)
    cuts = [first + (last - first) * (k + 1) / rounds for k in range(rounds - 1)]
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(int(before), 2 + sum(s[2] for s in spans) // ROWS_A_PARTITION))
    try:
        for k in range(rounds + 1):
            for name, rows, schema, time in sides:
                _feed(streams, name, schema, time, _round(rows, schema, time, name, k, cuts, end))
            streams.settle()
    finally:
        spark.conf.set(setting, before)
    return streams


def _round(rows: DataFrame, schema: str, time: str, name: str, k: int, cuts: list[datetime], end: datetime) -> DataFrame:
    """The rows of a round between two cuts, or of the last one, which closes the stream."""
    if k > len(cuts):
        return shaped(rows.sparkSession.createDataFrame([(f"{CLOSING}{name}", end, 0.0)], f"prediction_digest string, {time} timestamp, prediction double"), schema)
    at = F.col(time)
    after, upto = at > cuts[k - 1] if k else F.lit(True), at <= cuts[k] if k < len(cuts) else F.lit(True)
    return rows.where(F.when(at.isNull(), F.lit(k == 0)).otherwise(after & upto))


def _feed(streams: LedgerStreams, name: str, schema: str, time: str, rows: DataFrame) -> None:
    source = f"{streams.root}/{name}/source"
    rows.write.mode("append").parquet(source)
    streams.ingest(name, streams.spark.readStream.schema(schema).parquet(source), time)
    streams.claim(name, schema, "prediction_digest", time, prediction_fault() if name == "predictions" else None)
