"""pandas frames and vendor daily bars as datasets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.errors import SourceError
from tidegate.operators import governance, panel, rolls


@dataclass(frozen=True)
class FrameMapping:
    """Which column or index level holds what; features and their availability in declared order."""

    sample_id: str
    session: str
    info_start: str
    info_end: str
    target: str
    features: tuple[str, ...]
    asset: str | None = None
    decision_time: str | None = None
    available: tuple[str, ...] = ()


def _checked(frame: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    if frame.index.has_duplicates:
        raise SourceError("the frame's index repeats")
    flat = frame.reset_index()
    if flat.columns.has_duplicates:
        raise SourceError("column and index names repeat")
    if missing := [n for n in names if n not in flat.columns]:
        raise SourceError(f"{len(missing)} mapped fields are missing")
    return flat[names].copy()


def _utc(values: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """Temporal columns as UTC without zone; they must share one zone, and hold no fraction of a microsecond."""
    zones = {str(getattr(pd.to_datetime(values[n]).dt, "tz", None)) for n in names}
    if len(zones) > 1:
        raise SourceError("temporal fields have different time zones")
    for n in names:
        stamp = pd.to_datetime(values[n])
        stamp = stamp.dt.tz_convert("UTC").dt.tz_localize(None) if stamp.dt.tz is not None else stamp
        if (stamp.dropna() != stamp.dropna().dt.floor("us")).any():
            raise SourceError("times finer than a microsecond would be cut")
        values[n] = stamp.astype("datetime64[us]")
    return values


def dataset_from_pandas(spark: SparkSession, frame: pd.DataFrame, mapping: FrameMapping, axis: Sequence) -> tuple[DataFrame, DataFrame]:
    """(dataset, axis); positions are the frame's order. `governance.require_valid` checks it."""
    times = [mapping.session, mapping.info_start, mapping.info_end, *([mapping.decision_time] if mapping.decision_time else []), *mapping.available]
    names = list(dict.fromkeys([mapping.sample_id, *times, mapping.target, *mapping.features, *([mapping.asset] if mapping.asset else [])]))
    flat = _utc(_checked(frame, names), list(dict.fromkeys(times)))
    flat["__position"] = range(len(flat))
    rows = spark.createDataFrame(flat)
    ntz = lambda n: F.col(f"`{n}`").cast("timestamp_ntz")
    dataset = rows.select(
        F.col("__position").cast("long").alias("position"),
        F.col(f"`{mapping.sample_id}`").cast("string").alias("sample_id"),
        ntz(mapping.session).alias("session"),
        (F.col(f"`{mapping.asset}`").cast("string") if mapping.asset else F.lit(None).cast("string")).alias("asset"),
        ntz(mapping.info_start).alias("info_start"),
        ntz(mapping.info_end).alias("info_end"),
        (ntz(mapping.decision_time) if mapping.decision_time else F.lit(None).cast("timestamp_ntz")).alias("decision_time"),
        (F.array(*map(ntz, mapping.available)) if mapping.available else F.lit(None).cast("array<timestamp_ntz>")).alias("feature_available"),
        F.array(*[F.col(f"`{n}`").cast("double") for n in mapping.features]).alias("features"),
        F.col(f"`{mapping.target}`").cast("double").alias("target"),
    )
    sessions = pd.DataFrame({"session": pd.to_datetime(list(axis)).astype("datetime64[us]"), "axis_pos": range(len(axis))})
    placed = spark.createDataFrame(sessions).select(F.col("session").cast("timestamp_ntz").alias("session"), F.col("axis_pos").cast("long"))
    return dataset.join(F.broadcast(placed), "session", "left").select(*dataset.columns, "axis_pos"), placed


def bars_dataset(bars: DataFrame, lookback: int, horizon: int, decision_minutes: int = 0) -> DataFrame:
    """Daily bars (date, symbol, close, volume) as samples whose features are close and volume, known at the decision."""
    rows = bars.select(F.date_trunc("DAY", "date").cast("timestamp_ntz").alias("session"), F.col("symbol").alias("asset"), F.col("close").cast("double").alias("price"), F.col("volume").cast("double").alias("volume"))
    governance.require_unique(rows, "asset", "session")
    placed = panel.label_geometry(rows, lookback, horizon, decision_minutes)
    return placed.select(
        F.concat_ws("::", "asset", F.date_format("session", "yyyy-MM-dd")).alias("sample_id"), "session", "asset", "info_start", "info_end", "decision_time",
        F.array("decision_time", "decision_time").alias("feature_available"), F.array("price", "volume").alias("features"), "target",
    )


def continuous_dataset(bars: DataFrame, lookback: int, horizon: int, minimum_sessions: int, marker: str = "_DOMINANT.") -> tuple[DataFrame, DataFrame]:
    """(samples, audit) of continuous contracts: rows of marked symbols, one series for each asset, enough history.

    `bars` has date, symbol, close, underlying_symbol and dominant_id (the contract then in use). Samples carry
    label_cross and interval_cross; the audit counts kept and discarded rows, transitions and crossings.
    """
    kept = bars.where(F.col("symbol").contains(marker))
    empty = kept.where((F.trim(F.coalesce("symbol", F.lit(""))) == "") | (F.trim(F.coalesce("dominant_id", F.lit(""))) == "")).count()
    several = kept.groupBy("underlying_symbol").agg(F.count_distinct("symbol").alias("n")).where("n > 1").count()
    if empty or several:
        raise SourceError(f"{empty} rows without identity, {several} assets with several series")
    rows = kept.select(F.date_trunc("DAY", "date").cast("timestamp_ntz").alias("session"), F.col("underlying_symbol").alias("asset"), F.col("close").cast("double").alias("price"), F.col("dominant_id").alias("contract"))
    governance.require_unique(rows, "asset", "session")
    long_enough = rows.groupBy("asset").agg(F.count("*").alias("n")).where(F.col("n") >= minimum_sessions).select("asset")
    chosen = rows.join(F.broadcast(long_enough), "asset", "left_semi")
    flagged = rolls.roll_flags(chosen, lookback, horizon)
    samples = panel.label_geometry(flagged, lookback, horizon).where("eligible")
    counts = rolls.roll_audit(flagged).crossJoin(bars.agg(F.count("*").alias("read"), F.count_if(~F.col("symbol").contains(marker)).alias("discarded")))
    return samples, counts
