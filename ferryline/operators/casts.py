"""Tables converted to the types that a catalog plans for them; values that don't fit are set aside with their column and reason."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base names of target types, and what holds them here.
SPARK_TYPES = {
    "integer": "int", "bigint": "bigint", "smallint": "smallint", "boolean": "boolean", "double precision": "double", "real": "float",
    "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "bytea": "binary", "varchar": "string", "char": "string", "text": "string", "uuid": "string", "time": "string", "xml": "string", "jsonb": "string",
}
_UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
_TIME = r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,7})?)?$"


def planned_cast(c: Column, target: str, extra_check: str | None = None) -> tuple[Column, Column]:
    """The value as ``target`` (a type as ``convert_types`` names it), and why it can't be (null if it can). Null values are always fine."""
    m = re.fullmatch(r"([a-z ]+?)\s*(?:\((\d+)(?:,\s*(\d+))?\))?", target.strip().lower())
    base, size, scale = (m[1], m[2] and int(m[2]), m[3] and int(m[3])) if m else (None, None, None)
    if base == "numeric":
        kind = f"decimal({min(size or 38, 38)},{scale or (0 if size else 10)})"
    elif base in SPARK_TYPES:
        kind = SPARK_TYPES[base]
    else:
        raise ValueError(f"unknown target type {target}")
    text = c.cast("string")
    new = c.cast("binary") if base == "bytea" else c.try_cast(kind)
    if base in ("integer", "bigint", "smallint"):  # a number with a fraction is no integer
        number = text.try_cast("decimal(38,10)")
        new = F.when(number == F.round(number), number.try_cast(kind))
    if base == "timestamp" and size is not None and size < 6:
        new = F.to_timestamp_ntz(F.date_format(new, "yyyy-MM-dd HH:mm:ss" + ("." + "S" * size if size else "")))
    reasons = [F.when(new.isNull(), f"no {target}")]
    if base in ("varchar", "char") and size is not None:
        reasons.append(F.when(F.length(new) > size, f"longer than {size}"))
    if base == "uuid":
        reasons.append(F.when(~new.rlike(_UUID), "no uuid"))
    if base == "time":
        reasons.append(F.when(~new.rlike(_TIME), "no time"))
    if base == "jsonb":
        reasons.append(F.when(F.try_parse_json(new).isNull(), "no json"))
    if extra_check:
        between = re.fullmatch(r"between (-?\d+) and (-?\d+)", extra_check)
        if not between:
            raise ValueError(f"unknown check {extra_check}")
        reasons.append(F.when(~new.between(int(between[1]), int(between[2])), f"not {extra_check}"))
    why = F.when(c.isNotNull(), F.coalesce(*reasons))
    return F.when(why.isNull(), new), why


def convert_table(df: DataFrame, plan: list[tuple[str, str, str | None]], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``plan``: column, target type, extra check; other columns stay as they are.

    Returns the rows whose values all fit, converted, and the others: ``keys``,
    column, value (as text) and reason, one row for each value that doesn't fit.
    One pass without a shuffle for each.
    """
    casts = {c: planned_cast(F.col(c), target, check) for c, target, check in plan}
    bad = F.array_compact(F.array(*[F.when(why.isNotNull(), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), why.alias("reason"))) for c, (_, why) in casts.items()]))
    if not casts:
        return df, df.select(*keys, F.lit("").alias("column"), F.lit("").alias("value"), F.lit("").alias("reason")).filter("false")
    kept = df.filter(F.size(bad) == 0).select(*[casts[c][0].alias(c) if c in casts else F.col(c) for c in df.columns])
    aside = df.select(*keys, F.explode(bad).alias("bad")).select(*keys, "bad.*")
    return kept, aside
