"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegate.session import kept

#: A word: a run of characters other than space, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again, so that later jobs start from the table.

    Tables stay until their reader has been used up, which only the caller knows; a cluster clears the folder of an
    application when it ends.
    """
    return kept(df, name)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions, which a cluster sizes with its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
