"""Data migration: dependency order, type mapping, names, reseeding, reconciliation and constraint checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.operators.copying import copy_tables
from ferryline.operators.graphs import cycle_members, dependency_waves
from ferryline.operators.staging import written

__all__ = ["copy_tables", "cycle_members", "dependency_waves", "written"]


def select_tables(tables: DataFrame, wanted: list[str], schema_col: str = "schema_name", name_col: str = "table_name") -> DataFrame:
    return tables.filter(F.lower(F.concat_ws(".", schema_col, name_col)).isin([w.lower() for w in wanted]))


def rename_target(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def target_schema(c: Column) -> Column:
    """dbo becomes public, others keep their lower-cased name."""
    return F.when(F.lower(c) == "dbo", "public").otherwise(F.lower(c))


#: Source type, target type, needs review.
TYPE_MAP = [
    ("int", "integer", False), ("bigint", "bigint", False), ("smallint", "smallint", False), ("tinyint", "smallint", False), ("bit", "boolean", False),
    ("decimal", "numeric", False), ("numeric", "numeric", False), ("money", "numeric(19,4)", False), ("smallmoney", "numeric(10,4)", False), ("float", "double precision", False), ("real", "real", False),
    ("char", "char", False), ("nchar", "char", False), ("varchar", "varchar", False), ("nvarchar", "varchar", False), ("text", "text", False), ("ntext", "text", False),
    ("binary", "bytea", False), ("varbinary", "bytea", False), ("image", "bytea", False), ("rowversion", "bytea", False),
    ("datetime", "timestamp(3)", False), ("datetime2", "timestamp", False), ("smalldatetime", "timestamp(0)", False), ("datetimeoffset", "timestamptz", False), ("date", "date", False), ("time", "time", False),
    ("uniqueidentifier", "uuid", False), ("xml", "xml", False), ("sql_variant", "jsonb", True), ("hierarchyid", "text", True), ("geography", "text", True), ("geometry", "text", True), ("sysname", "varchar(128)", False),
]


def convert_types(columns: DataFrame, type_map: DataFrame) -> DataFrame:
    """``columns``: ..., data_type, prec, scale, max_length. Adds target_type, needs_review and extra_check."""
    j = columns.join(F.broadcast(type_map), F.lower("data_type") == F.col("source_type"), "left")  # a fixed map of some dozen rows
    base = F.col("mapped")
    sized = (
        F.when(base.isNull(), "text")
        .when((base == "numeric") & F.col("prec").isNotNull(), F.concat(F.lit("numeric("), F.col("prec"), F.lit(","), F.coalesce("scale", F.lit(0)), F.lit(")")))
        .when(base.isin("varchar", "char") & (F.col("max_length") < 0), "text")
        .when(base.isin("varchar", "char") & F.col("max_length").isNotNull(), F.concat(base, F.lit("("), F.col("max_length"), F.lit(")")))
        .when(base.isin("timestamp", "time") & F.col("scale").isNotNull(), F.concat(base, F.lit("("), F.least("scale", F.lit(6)), F.lit(")")))
        .otherwise(base)
    )
    check = F.when(F.lower("data_type") == "tinyint", "between 0 and 255")
    return j.select(*columns.columns, sized.alias("target_type"), F.coalesce("review", F.lit(True)).alias("needs_review"), check.alias("extra_check"))


def reseed(df: DataFrame, column: str) -> DataFrame:
    """Next identity value: one after the largest, 1 for an empty table."""
    return df.agg(F.coalesce(F.max(column) + 1, F.lit(1)).cast("long").alias("next_value"))


def reconcile_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """``source``, ``target``: table_name, n. Both counts, their difference, and whether they agree."""
    j = source.withColumnRenamed("n", "n_source").join(target.withColumnRenamed("n", "n_target"), "table_name", "full")
    n = lambda c: F.coalesce(c, F.lit(0))
    return j.select("table_name", n("n_source").alias("n_source"), n("n_target").alias("n_target"), (n("n_target") - n("n_source")).alias("delta"), (n("n_source") == n("n_target")).alias("equal"))


def content_hash(columns: list[str]) -> Column:
    """Hash of a row's values; nulls count by their place."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))]) if columns else F.lit(0).cast("long")


def reconcile_content(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing, extra or changed in the target; only keys and hashes are shuffled.

    A null is a value like any, in keys too. Rows that share a key are compared
    as a whole, in any order: by their number and the sum of their hashes.
    """
    rest = [c for c in source.columns if c not in keys]

    def summed(df, n):
        own = [F.col(k).alias(f"{n}_{i}") for i, k in enumerate(keys)]
        return df.groupBy(*own).agg(F.struct(F.count("*"), F.sum(content_hash(rest).cast("decimal(38,0)"))).alias(n))

    same = reduce(lambda x, y: x & y, [F.col(f"a_{i}").eqNullSafe(F.col(f"b_{i}")) for i in range(len(keys))])
    j = summed(source, "a").join(summed(target, "b"), same, "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    own = [F.when(F.col("a").isNull(), F.col(f"b_{i}")).otherwise(F.col(f"a_{i}")).alias(k) for i, k in enumerate(keys)]
    return j.select(*own, F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed").alias("difference"))


def reconcile_by_tree(source: DataFrame, target: DataFrame, keys: list[str], bits: tuple[int, ...] = (12, 20)) -> DataFrame:
    """``reconcile_content`` of tables that are nearly equal: rows are only shuffled where a hash tree says that something differs.

    The tree's nodes are ranges of the keys' hashes. Each level of ``bits`` cuts
    them into 2^bits ranges, whose rows' number and sum of hashes are added up
    within tasks first; only ranges that differ go down to the next level, and
    only their rows are compared. Equal tables ship one row for each task and
    range of the first level. The ranges that differ are at most 2^bits numbers,
    which travel to all tasks (20 bits: 8 MB); both tables are read once a level.
    """
    if not bits or list(bits) != sorted(set(bits)) or bits[-1] > 20:
        raise ValueError("levels must rise, to 20 bits at most")
    name, sides = content_hash(keys), [source, target]
    rest = [c for c in source.columns if c not in keys]
    for b in bits:
        at = F.shiftrightunsigned(name, 64 - b).alias("_node")
        left, right = (df.groupBy(at).agg(F.struct(F.count("*"), F.sum(content_hash([*keys, *rest]).cast("decimal(38,0)"))).alias(side)) for df, side in zip(sides, "ab"))
        differ = written(left.join(right, "_node", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("_node"))
        sides = [df.join(F.broadcast(differ), F.shiftrightunsigned(name, 64 - b) == F.col("_node"), "left_semi") for df in (source, target)]
    return reconcile_content(*sides, keys)


def fk_orphans(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Child rows whose key, if whole, isn't in the parent."""
    whole = child.dropna(subset=list(on))
    p = parent.select(*[F.col(v).alias(k) for k, v in on.items()])
    return whole.join(p, list(on), "left_anti")


def unique_breaches(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def check_breaches(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule (a null result doesn't), with the rule's name, one row for each breach."""
    broken = F.array_compact(F.array(*[F.when(~r, F.lit(k)) for k, r in rules.items()]))
    return df.withColumn("rule", F.explode(broken))
