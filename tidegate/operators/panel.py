"""Session axes, information intervals and supervised samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def session_axis(rows: DataFrame, column: str = "session") -> DataFrame:
    """(session, axis_pos): the distinct sessions in order, counted from 0."""
    return rows.select(F.col(column).alias("session")).distinct().withColumn("axis_pos", F.row_number().over(Window.orderBy("session")).cast("long") - 1)


def next_position(axis: DataFrame, instants: DataFrame, column: str, inclusive: bool = False) -> DataFrame:
    """`instants` with next_pos, the first axis position strictly after `column` (at or after it if inclusive).

    An as-of lookup without a range join: instants and axis are merged in one ordered window. Past the end of
    the axis the position is the axis' length.
    """
    keys = instants.select(F.col(column).cast("timestamp_ntz").alias("at")).distinct()
    marks = axis.select(F.col("session").cast("timestamp_ntz").alias("at"), "axis_pos", F.lit(0).alias("asks")).unionByName(
        keys.select("at", F.lit(None).cast("long").alias("axis_pos"), F.lit(1).alias("asks"))
    )
    # both sides are session-sized
    order = Window.orderBy("at", F.desc("asks") if inclusive else F.asc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    passed = marks.withColumn("next_pos", F.coalesce(F.max("axis_pos").over(order) + 1, F.lit(0))).where("asks = 1").select(F.col("at"), "next_pos")
    return instants.join(passed, F.col(column).cast("timestamp_ntz") == F.col("at")).drop("at")


def axis_samples(panel: DataFrame, axis: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """Samples of `panel` (session, asset, price) placed on the axis, so sessions that an asset misses still count.

    Adds axis_pos, info_start (lookback sessions before), info_end (horizon sessions after), target (relative
    change of the price over the horizon, null where the asset is missing then) and ret (over one session). Only
    positions with a full interval stay.
    """
    shift = lambda by, name: axis.select((F.col("axis_pos") - by).alias("axis_pos"), F.col("session").alias(name))
    placed = panel.join(F.broadcast(axis), "session")
    later = placed.select("asset", (F.col("axis_pos") - horizon).alias("axis_pos"), F.col("price").alias("later_price"))
    before = placed.select("asset", (F.col("axis_pos") + 1).alias("axis_pos"), F.col("price").alias("before_price"))
    return (
        placed.join(F.broadcast(shift(-lookback, "info_start")), "axis_pos")
        .join(F.broadcast(shift(horizon, "info_end")), "axis_pos")
        .join(later, ["asset", "axis_pos"], "left")
        .join(before, ["asset", "axis_pos"], "left")
        .withColumn("target", F.col("later_price") / F.col("price") - 1)
        .withColumn("ret", F.col("price") / F.col("before_price") - 1)
        .drop("later_price", "before_price")
    )


def dense_sessions(panel: DataFrame) -> DataFrame:
    """Rows of the sessions in which every asset occurs."""
    assets = panel.agg(F.count_distinct("asset").alias("assets"))
    full = panel.groupBy("session").agg(F.count_distinct("asset").alias("here")).join(F.broadcast(assets), F.col("here") == F.col("assets"))
    return panel.join(full.select("session"), "session", "left_semi")


def label_geometry(bars: DataFrame, lookback: int, horizon: int, decision_minutes: int = 0) -> DataFrame:
    """Per asset, by its own rows: feature start, label end, target and decision time; incomplete rows go."""
    own = Window.partitionBy("asset").orderBy("session")
    return (
        bars.withColumn("info_start", F.lag("session", lookback - 1).over(own) if lookback > 1 else F.col("session"))
        .withColumn("info_end", F.lead("session", horizon).over(own))
        .withColumn("target", F.lead("price", horizon).over(own) / F.col("price") - 1)
        .where(F.col("info_start").isNotNull() & F.col("info_end").isNotNull())
        .withColumn("decision_time", F.col("session").cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(decision_minutes)))
    )


def temporal_samples(panel: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """Per asset: the ordered array of the `lookback` returns before each row, its interval and its target.

    `panel` has session, asset, price and ret; only rows with a full history and horizon stay.
    """
    own = Window.partitionBy("asset").orderBy("session")
    return (
        panel.withColumn("features", F.collect_list("ret").over(own.rowsBetween(-lookback, -1)))
        .withColumn("feature_sessions", F.collect_list("session").over(own.rowsBetween(-lookback, -1)))
        .withColumn("info_start", F.lag("session", lookback).over(own))
        .withColumn("info_end", F.lead("session", horizon).over(own))
        .withColumn("target", F.lead("price", horizon).over(own) / F.col("price") - 1)
        .where((F.size("features") == lookback) & F.col("info_start").isNotNull() & F.col("info_end").isNotNull())
    )


def average_rank(value: str | Column, *partition: str) -> Column:
    """1-based rank over the partition; ties share their mean rank."""
    value = F.col(value) if isinstance(value, str) else value
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / 2
