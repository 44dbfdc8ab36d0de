"""Aggregate expressions of return tracks and scores."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAMMA = 0.5772156649015329


def mse(target: str = "target", prediction: str = "prediction") -> Column:
    return F.avg((F.col(target) - F.col(prediction)) * (F.col(target) - F.col(prediction)))


def pearson(x: str, y: str) -> Column:
    """Correlation, or null where either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def sharpe(column: str, periods: float) -> Column:
    """Mean over sample deviation, the latter at least 1e-12, times the root of the periods in a year."""
    return F.avg(column) / F.greatest(F.coalesce(F.stddev_samp(column), F.lit(0.0)), F.lit(1e-12)) * F.sqrt(F.lit(float(periods)))


def total_return(column: str) -> Column:
    return F.product(F.lit(1.0) + F.col(column)) - 1


def drawdowns(rows: DataFrame, column: str, keys: list[str], order: str) -> DataFrame:
    """(keys, max_drawdown): the largest fall of wealth from its peak so far, which starts at 1."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    wealth = rows.withColumn("wealth", F.product(F.lit(1.0) + F.col(column)).over(upto))
    peaked = wealth.withColumn("peak", F.greatest(F.max("wealth").over(upto), F.lit(1.0)))
    return peaked.groupBy(*keys).agg(F.max(1 - F.col("wealth") / F.col("peak")).alias("max_drawdown"))


def raw_kurtosis(column: str) -> Column:
    """3 for a normal; 3 as well for a constant."""
    return F.when(F.stddev_pop(column) > 1e-12, F.coalesce(F.kurtosis(column) + 3, F.lit(3.0))).otherwise(3.0)


def skew(column: str) -> Column:
    return F.when(F.stddev_pop(column) > 1e-12, F.coalesce(F.skewness(column), F.lit(0.0))).otherwise(0.0)


def expected_maximum_factor(trials: int) -> float:
    """Expected maximum of `trials` standard normals, in deviations, as used to deflate a best Sharpe ratio."""
    import math

    inverse = NormalDist().inv_cdf
    return (1 - GAMMA) * inverse(1 - 1 / trials) + GAMMA * inverse(1 - 1 / (trials * math.e))


def normal_cdf_column(x: Column) -> Column:
    """The normal distribution function as a column: 1/2 + density * (x + x^3/3 + x^5/(3*5) + ...), x within 7."""
    z = F.greatest(F.least(x.cast("double"), F.lit(7.0)), F.lit(-7.0))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(120)),
        F.struct(z.alias("term"), z.alias("total")),
        lambda s, k: F.struct((s["term"] * z * z / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * z * z / (2 * k + 1)).alias("total")),
    )
    return F.lit(0.5) + F.exp(-z * z / 2) / F.sqrt(F.lit(2.0) * F.pi()) * terms["total"]


def normal_cdf(x: float) -> float:
    return NormalDist().cdf(x)
