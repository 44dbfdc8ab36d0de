"""NumPy archives of strategies, and a seeded demo panel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.sources import npz
from tidegate.sources.files import Limits

def _long(spark: SparkSession, found: dict[str, np.ndarray], names: dict[str, str], index: str, label: str) -> DataFrame:
    sessions, ids = found["sessions"], next(v for k, v in found.items() if k.endswith("_ids"))
    t, i = np.meshgrid(np.arange(len(sessions)), np.arange(len(ids)), indexing="ij")
    columns = {"t": t.ravel(), "session": pd.to_datetime(sessions[t.ravel()]), index: i.ravel(), label: ids[i.ravel()].astype(object)}
    return spark.createDataFrame(pd.DataFrame(columns | {new: found[old].ravel() for old, new in names.items()}))


def _archive(spark: SparkSession, path: str, kind: str, limits: Limits) -> DataFrame:
    """Headers and ids are checked here; executors read the values, and refuse those that are not finite."""
    npz.check(path, kind, limits)
    npz.register(spark)
    rows = spark.read.format("npz").option("kind", kind).option("file_bytes", limits.file_bytes).load(path)
    return rows.withColumn("session", F.col("session").cast("timestamp"))


def read_panel(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """(t, session, asset_idx, asset, price, ret) of an archive of sessions, asset_ids, signal_prices and tradable_returns."""
    return _archive(spark, path, "panel", limits)


def read_returns(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """(t, session, cand_idx, candidate_id, gross, net, turnover) of an archive of such members."""
    return _archive(spark, path, "returns", limits)


#: Fixed values of the published example, whose figures a test reproduces: seed, sessions, deviation of a day's
#: return, first day, and for each asset its first price and its drift before row 110, before row 220 and from there.
DEMO_SEED, DEMO_SESSIONS, DEMO_DEVIATION, DEMO_FIRST_DAY, DEMO_TURNS = 20260803, 320, 0.012, "2024-01-01", (110, 220)
DEMO_ASSETS = {
    "DEMO-A": (100.0, (0.0006, -0.0005, 0.0002)),
    "DEMO-B": (120.0, (-0.0003, 0.0005, -0.0002)),
    "DEMO-C": (80.0, (0.0002, -0.0002, 0.0004)),
}


def demo_panel(spark: SparkSession) -> DataFrame:
    """The example's panel, as `read_panel` gives it: random walks whose drift changes twice; the first return is 0."""
    noise = np.random.default_rng(DEMO_SEED).normal(0.0, DEMO_DEVIATION, size=(DEMO_SESSIONS, len(DEMO_ASSETS)))
    regime = np.searchsorted(DEMO_TURNS, np.arange(DEMO_SESSIONS), side="right")
    drift = np.array([drifts for _, drifts in DEMO_ASSETS.values()]).T[regime]
    ret = np.where(np.arange(DEMO_SESSIONS)[:, None] > 0, noise + drift, 0.0)
    price = np.array([first for first, _ in DEMO_ASSETS.values()]) * np.cumprod(1.0 + ret, axis=0)
    days = np.datetime64(DEMO_FIRST_DAY) + np.arange(DEMO_SESSIONS)
    found = {"sessions": days, "asset_ids": np.array(list(DEMO_ASSETS)), "signal_prices": price, "tradable_returns": ret}
    return _long(spark, found, {"signal_prices": "price", "tradable_returns": "ret"}, "asset_idx", "asset")
