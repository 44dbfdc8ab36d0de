"""Exclusive, redacted outputs."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidegate.errors import LedgerError


def create_exclusive(spark: SparkSession, path: str, payload: Any) -> None:
    """Write JSON to a path that must not exist yet, on any file system Spark knows: claims are made this way."""
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"), allow_nan=False, default=str)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = files.create(target, False)
    except Exception as error:  # the path exists
        raise LedgerError("already claimed") from error
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


ROW_COLUMNS = frozenset({"sample_id", "target", "prediction", "features", "asset", "asset_id"})


def write_report(df: DataFrame, path: str) -> None:
    """Keep an aggregate report; one that is there stays. Row-level columns are refused."""
    if found := ROW_COLUMNS & set(df.columns):
        raise LedgerError(f"{len(found)} row-level columns in a report")
    df.write.mode("ignore").parquet(path)
