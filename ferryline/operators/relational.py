"""Relational operators of the source dialect that take more than one DataFrame call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryline.operators.staging import written


def cross_apply_top(left: DataFrame, right: DataFrame, key: str, right_key: str, order: list[Column], n: int = 1) -> DataFrame:
    """CROSS APPLY (SELECT TOP n ... ORDER BY ...): ranked once by key, then joined."""
    place = F.row_number().over(Window.partitionBy(right_key).orderBy(*order))
    best = right.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")
    return left.join(best, left[key] == best[right_key])


def outer_apply_agg(left: DataFrame, right: DataFrame, key: str, right_key: str, counts: dict[str, Column], others: dict[str, Column]) -> DataFrame:
    """OUTER APPLY of an aggregate: one row for each left row; counts are 0 and the rest null where nothing matches."""
    sums = right.groupBy(F.col(right_key).alias("_key")).agg(*[c.alias(k) for k, c in {**counts, **others}.items()])
    return left.join(sums, left[key] == F.col("_key"), "left").drop("_key").fillna(0, list(counts))


def not_in(left: DataFrame, column: str, right: DataFrame, right_column: str) -> DataFrame:
    """NOT IN (subquery) with its null rules: a null in the list leaves no rows, an empty list leaves all."""
    there = right.agg(F.count("*").alias("n"), F.count_if(F.col(right_column).isNull()).alias("nulls"))
    some = left.join(right.select(F.col(right_column).alias("_v")).distinct(), F.col(column) == F.col("_v"), "left_anti")
    some = some.crossJoin(F.broadcast(there))  # one row
    return some.filter((F.col("n") == 0) | ((F.col("nulls") == 0) & F.col(column).isNotNull())).drop("n", "nulls")


def numbered(df: DataFrame, order: list[Column], name: str = "_place", total: str | None = None) -> DataFrame:
    """Row numbers from 1 over a global order (and the number of all rows as ``total``), without one task for all rows.

    Rows are ranged by the order into as many parts as shuffles have, and
    written with their part's number: a second ranging would draw other bounds.
    Numbers inside each part continue after the parts before it. ``order`` must
    be unique for the numbers to be stable.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each part
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("_all"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + inside)
    return (out.withColumn(total, F.col("_all")) if total else out).drop("_part", "_before", "_all")


def top_percent(df: DataFrame, percent: float, order: list[Column]) -> DataFrame:
    """TOP n PERCENT, rounded up to whole rows; the rows stay spread over all parts."""
    place = numbered(df, order, "_place", "_total")
    return place.filter(F.col("_place") <= F.ceil(F.round(F.col("_total") * percent / 100, 6))).drop("_place", "_total")


def top_with_ties(df: DataFrame, n: int, order: list[str], descending: bool = True) -> DataFrame:
    """TOP n WITH TIES: all rows that sort no later than the n-th."""
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    last = df.select(*order).orderBy(*keys).limit(n).orderBy(*[F.col(c).asc() if descending else F.col(c).desc() for c in order]).limit(1)
    last = F.broadcast(last.select(F.struct(*order).alias("_last")))  # one row
    own = F.struct(*order)
    return df.crossJoin(last).filter(own >= F.col("_last") if descending else own <= F.col("_last")).drop("_last")


def offset_fetch(df: DataFrame, skip: int, n: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(n)


def optional_filter(df: DataFrame, **wanted) -> DataFrame:
    """(@p IS NULL OR col = @p) for each parameter."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def dynamic_search(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column, named at run time, has the value; unknown names are refused."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r}")
    return df.filter(F.col(column) == F.lit(value))
