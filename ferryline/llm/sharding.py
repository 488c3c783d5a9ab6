"""Sharding by histogram sort.

Rows are sorted by (hash of the text, hash of id and text), so equal texts
stand together. For each shard boundary candidate keys are probed: all
partitions count the exact bytes below the candidates, the interval that holds
the target is probed again more finely, until a candidate is within tolerance.
Only then do the rows move, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryline.llm.common import stage

#: Bits probed in one round; a round returns at most 2 ** DIGIT counts for each boundary.
DIGIT = 12
#: (column, unsigned shift, width) of each digit of the sort key, highest first.
DIGITS = [(c, max(64 - DIGIT * (k + 1), 0), min(DIGIT, 64 - DIGIT * k)) for c in ("h", "g") for k in range(-(-64 // DIGIT))]
_TOP = 1 << 63


def _signed(x: int) -> int:
    """An unsigned 64-bit number as the signed one of the same rank."""
    return x - _TOP


def _digit(k: int) -> Column:
    c, shift, width = DIGITS[k]
    return F.shiftrightunsigned(c, shift).bitwiseAND((1 << width) - 1)


def _key(path: list[int]) -> tuple[int, int]:
    """Smallest sort key (two unsigned numbers) that begins with these digits."""
    out = {"h": 0, "g": 0}
    for (c, shift, _), d in zip(DIGITS, path):
        out[c] |= d << shift
    return out["h"], out["g"]


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """``rows``: h, g, size. Keys at which shards 1 and up begin, by rounds of exact counts."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    goals = [total * (j + 1) / shards for j in range(shards - 1)]
    slack = tolerance * total / shards
    paths: list[list[int]] = [[] for _ in goals]
    below = [0] * len(goals)
    found: dict[int, tuple[int, int]] = {}
    for k in range(len(DIGITS)):
        todo = [j for j in range(len(goals)) if j not in found]
        if not todo or not total:
            break
        distinct = sorted({tuple(paths[j]) for j in todo})
        inside = [F.when(F.lit(True) if not p else _all([_digit(i) == d for i, d in enumerate(p)]), F.lit(n)) for n, p in enumerate(distinct)]
        counts = rows.groupBy(F.coalesce(*inside).alias("at"), _digit(k).alias("d")).agg(F.sum("size").alias("b")).filter("at is not null").collect()
        at: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: r.d):
            at.setdefault(r["at"], []).append((r.d, r.b))
        for j in todo:
            cum = below[j]
            for d, b in at[distinct.index(tuple(paths[j]))]:
                if cum + b >= goals[j]:
                    break
                cum += b
            low, high = goals[j] - cum, cum + b - goals[j]
            if min(low, high) <= slack or k == len(DIGITS) - 1:
                found[j] = _key([*paths[j], d]) if low <= high else _after([*paths[j], d])
            paths[j], below[j] = [*paths[j], d], cum
    return [found[j] for j in range(len(goals))] if total else []


def _after(path: list[int]) -> tuple[int, int]:
    """Smallest key above all that begin with these digits."""
    h, g = _key(path)
    c, shift, _ = DIGITS[len(path) - 1]
    whole = (h << 64 | g) + (1 << (shift + (64 if c == "h" else 0)))
    return min(whole, (1 << 128) - 1) >> 64, min(whole, (1 << 128) - 1) & ((1 << 64) - 1)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of near equal bytes, and a gapless slot in its shard for every row.

    Returns id_col, size (UTF-8 bytes plus 1; null text: 1), text_crc32 (null:
    0), shard and slot. Shards differ from equal bytes by at most ``tolerance``
    of a shard at each boundary, or by the one row (or set of equal rows) that
    lies across it. Equal texts stay together unless they alone are larger than
    the tolerance. Repeated rows get slots of their own; rows of an empty table
    none. Other columns don't pass.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = stage(hashed.withColumn("g", F.xxhash64("id", "h")), "keys")
    cut = splitters(rows, shards, tolerance)
    h, g = (F.col(c).bitwiseXOR(F.lit(-_TOP)) for c in "hg")
    shard = F.lit(0)
    for a, b in cut:
        shard = shard + F.when((h > _signed(a)) | ((h == _signed(a)) & (g >= _signed(b))), 1).otherwise(0)
    n = rows.count()
    crowded = [r.d for r in rows.groupBy(_digit(0).alias("d")).count().filter(F.col("count") > max(1000, n // 512)).collect()]  # at most 512
    fine = F.when(_digit(0).isin(crowded), F.shiftrightunsigned("g", 58)).otherwise(F.lit(0)) if crowded else F.lit(0)
    keyed = rows.withColumns({"shard": shard.cast("int"), "bucket": (_digit(0) * 64 + fine).cast("int")})
    sizes = keyed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h", "g", "id", "size"))
    out = keyed.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("start") + place - 1)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
