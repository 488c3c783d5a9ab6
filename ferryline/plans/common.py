"""Short names that the plans share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.sources.tables import read_table


def t(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, d, name, list(columns) or None)


def money(c: str | Column) -> Column:
    """Two exact decimals, so that sums don't depend on their order."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def total(c: str | Column) -> Column:
    return F.sum(money(c)).cast("double")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table (maps and levels)."""
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], columns: str) -> str:
    """The same table for SQL."""
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({columns})"
