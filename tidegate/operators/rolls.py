"""Contract rolls inside continuous series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def roll_flags(rows: DataFrame, lookback: int, horizon: int, asset: str = "asset", order: tuple[str, ...] = ("session",), contract: str = "contract") -> DataFrame:
    """`rows` with transition, eligible, label_cross and interval_cross.

    A label crosses a roll if any of the next `horizon` rows is of another contract, even if it changes back; an
    interval does if the contract changes anywhere from the first feature row to the label's end.
    """
    own = Window.partitionBy(asset).orderBy(*order)
    here = F.col(contract)
    flagged = rows.withColumn("transition", F.coalesce(F.lag(contract).over(own) != here, F.lit(False)))
    ahead = F.collect_list(contract).over(own.rowsBetween(1, horizon))
    changes = F.sum(F.col("transition").cast("int")).over(own.rowsBetween(-(lookback - 2), horizon))
    back = F.lag(contract, lookback - 1).over(own) if lookback > 1 else here
    return (
        flagged.withColumn("ahead", ahead)
        .withColumn("eligible", back.isNotNull() & F.lead(contract, horizon).over(own).isNotNull())
        .withColumn("label_cross", F.exists("ahead", lambda c: c != here))
        .withColumn("interval_cross", changes > 0)
        .drop("ahead")
    )


def roll_audit(flagged: DataFrame, *keys: str) -> DataFrame:
    """Counts of transitions, eligible rows, and eligible rows whose label or interval crosses a roll."""
    ok = F.col("eligible")
    return flagged.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if("transition").alias("transitions"), F.count_if(ok).alias("eligible"), F.count_if(ok & F.col("label_cross")).alias("label_cross"), F.count_if(ok & F.col("interval_cross")).alias("interval_cross")
    )
