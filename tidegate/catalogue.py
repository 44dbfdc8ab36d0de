"""The registered queries of the engine and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegate.plans import ledgers, tracks, weekly

MODULES = (weekly, tracks, ledgers)


def _plain(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """Dates as text, so that results compare alike everywhere."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({n: df[n].cast("string") for n, kind in df.dtypes if kind == "date"})

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _plain(f) for m in MODULES for n, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for m in MODULES:
        for name, sql in m.SQL.items():
            dates = m.DATES.get(name, ())
            found[name] = f"SELECT * REPLACE ({', '.join(f'{d}::VARCHAR AS {d}' for d in dates)}) FROM ({sql})" if dates else sql
    return found
