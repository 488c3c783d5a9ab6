"""Writes as pure functions: each takes table states and returns the new state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryline.operators.relational import numbered


def insert_select(target: DataFrame, source: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """INSERT ... SELECT: columns that the source lacks take their default, or null."""
    for name in target.columns:
        if name not in source.columns:
            source = source.withColumn(name, (defaults or {}).get(name, F.lit(None)))
    rows = source.select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in target.columns])
    return target.unionByName(rows)


def unique_source(source: DataFrame, keys: list[str]) -> DataFrame:
    """The source; a key with several rows raises when it is read, as more than one match would be ambiguous."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return source.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.lit("several source rows for a key")).cast("boolean")).otherwise(True)).drop("_n")


def update_from(target: DataFrame, source: DataFrame, keys: list[str], sets: dict[str, Column]) -> DataFrame:
    """UPDATE ... SET ... FROM: ``sets`` may use target columns and source columns (named s_...)."""
    s = unique_source(source, keys).select(*[F.col(k) for k in keys], *[F.col(c).alias(f"s_{c}") for c in source.columns if c not in keys], F.lit(True).alias("_hit"))
    joined = target.join(s, keys, "left")
    return joined.select(*[F.when(F.col("_hit"), sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in target.columns])


def delete_using(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(source.select(*keys), keys, "left_anti")


def merge(target: DataFrame, source: DataFrame, keys: list[str], update: dict[str, Column] | None = None, insert: bool = True, delete_unmatched: Column | None = None, output: bool = False) -> DataFrame:
    """MERGE: matched rows take ``update`` (source columns are s_...), new rows are inserted, and target rows
    without a source row that fulfil ``delete_unmatched`` go.

    With ``output`` the result is one row for each change: action, keys, and the
    images before and after as structs.
    """
    rest = [c for c in target.columns if c not in keys]
    t = target.select(*keys, *[F.col(c).alias(f"t_{c}") for c in rest], F.lit(True).alias("_t"))
    s = unique_source(source, keys).select(*keys, *[F.col(c).alias(f"s_{c}") for c in source.columns if c not in keys], F.lit(True).alias("_s"))
    j = t.join(s, keys, "full_outer")
    both, new, gone = F.col("_t") & F.col("_s"), F.col("_t").isNull(), F.col("_s").isNull()
    drop = gone & F.coalesce(delete_unmatched, F.lit(False)) if delete_unmatched is not None else F.lit(False)
    action = F.when(new, "INSERT" if insert else None).when(drop, "DELETE").when(both & F.lit(bool(update)), "UPDATE")
    after = {c: F.when(new, F.col(f"s_{c}") if c in source.columns else F.lit(None)).when(both, (update or {}).get(c, F.col(f"t_{c}"))).otherwise(F.col(f"t_{c}")) for c in rest}
    j = j.withColumn("action", action)
    if output:
        changed = j.filter("action is not null")
        return changed.select("action", *keys, *[F.col(f"t_{c}").alias(f"before_{c}") for c in rest], *[F.when(F.col("action") != "DELETE", v).alias(f"after_{c}") for c, v in after.items()])
    kept = j.filter((F.col("action").isNull() & F.col("_t")) | F.col("action").isin("INSERT", "UPDATE"))
    return kept.select(*keys, *[v.alias(c) for c, v in after.items()]).select(*target.columns)


def identity_assign(rows: DataFrame, existing: DataFrame, column: str, order: list[Column], seed: int = 1, step: int = 1) -> DataFrame:
    """IDENTITY(seed, step): dense numbers after the largest existing one, in the given unique order."""
    last = existing.agg(F.max(column).alias("m")).first()["m"]
    first = seed if last is None else last + step
    return numbered(rows, order).withColumn(column, (F.col("_place") - 1) * step + first).drop("_place")


def audit_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows inserted, deleted or updated between two states: operation, keys, old and new values as JSON text."""
    rest = [c for c in before.columns if c not in keys]
    b = before.select(*keys, F.struct(*rest).alias("old"))
    a = after.select(*keys, F.struct(*rest).alias("new"))
    j = b.join(a, keys, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    op = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").otherwise("UPDATE")
    return j.select(op.alias("operation"), *keys, "old", "new")


def temporal_as_of(history: DataFrame, at: Column, start: str = "sys_start", end: str = "sys_end") -> DataFrame:
    """Rows valid at a time: start <= at < end."""
    return history.filter((F.col(start) <= at) & (at < F.col(end)))


def _next_in_time(df: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """Adds the next later ``at`` of the same key. Times of a key differ.

    Windows go over a key's rows of one day; what follows a day comes from the
    first times of its days, one row each. So a hot key is not one task's work.
    """
    days = df.withColumn("_day", F.to_date(at))
    firsts = days.groupBy(*keys, "_day").agg(F.min(at).alias("_first"))
    after = firsts.select(*keys, "_day", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_day")).alias("_after"))
    after = after.toDF(*[f"_j{i}" for i in range(len(keys) + 1)], "_after")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_j{i}")) for i, c in enumerate([*keys, "_day"])])
    inside = F.lead(at).over(Window.partitionBy(*keys, "_day").orderBy(at))
    return days.withColumn(name, inside).join(after, same).select(*df.columns, F.coalesce(name, "_after").alias(name))


def versioned_update(history: DataFrame, changes: DataFrame, keys: list[str], at: str, sequence: str, deleted: str | None = None, start: str = "sys_start", end: str = "sys_end") -> DataFrame:
    """A temporal table after ``changes``, in any order and however late.

    ``history``: keys, values, [start, end), whose periods don't overlap within
    a key. ``changes``: keys, the same values, ``at`` and ``sequence``. A change
    holds from ``at`` to the next version or change of its key: it closes the
    version that is open then and opens the next one, or splits an old period; at
    the very start of a version it replaces it. Of several changes at one time
    the last by ``sequence`` counts. Where ``deleted`` is true nothing holds from
    ``at`` on. Ends of old versions that none follows stay. Changes without
    ``at`` are ignored; null keys are keys like any. Keys without changes are not
    touched, nor shuffled by more than their keys.
    """
    values = [c for c in history.columns if c not in (*keys, start, end)]
    kind = history.schema[start].dataType
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    new = changes.filter(F.col(at).isNotNull()).select(*keys, F.col(at).cast(kind).alias("_at"), F.lit(2).alias("_kind"), F.col(sequence).cast("long").alias("_seq"), gone.alias("_gone"), F.struct(*[F.col(c).cast(history.schema[c].dataType).alias(c) for c in values]).alias("_v"))
    named = new.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    hit = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    old = history.join(named, hit, "left_semi")
    row = lambda time, what, gone: old.select(*keys, F.col(time).alias("_at"), F.lit(what).alias("_kind"), F.lit(0).cast("long").alias("_seq"), F.lit(gone).alias("_gone"), F.struct(*values).alias("_v"))
    # at one time a change outranks a version's start, and that the end of the one before
    points = new.unionByName(row(start, 1, False)).unionByName(row(end, 0, True))
    last = points.groupBy(*keys, "_at").agg(F.max_by(F.struct("_gone", "_v"), F.struct("_kind", "_seq")).alias("_p"))
    spliced = _next_in_time(last, keys, "_at", "_next").filter(~F.col("_p._gone"))
    forever = F.lit("9999-12-31").cast(kind)
    spliced = spliced.select(*keys, *[F.col(f"_p._v.{c}").alias(c) for c in values], F.col("_at").alias(start), F.coalesce("_next", forever).alias(end))
    return history.join(named, hit, "left_anti").unionByName(spliced.select(*history.columns))


def range_partition(c: Column, boundaries: list[Column]) -> Column:
    """Number of the partition, from 1; a boundary belongs to the partition on its right."""
    return F.lit(1) + reduce(lambda a, b: a + b, [F.when(c >= b, 1).otherwise(0) for b in boundaries])


def row_filter(df: DataFrame, allowed: DataFrame, on: list[str]) -> DataFrame:
    """Rows that a user's mapping lets through."""
    return df.join(allowed, on, "left_semi")


def batch_insert(target: DataFrame, batch: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """All rows of the batch, or none if any fails a check."""
    bad = batch.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    total = reduce(lambda a, b: a + b, [F.col(k) for k in checks])
    ok = F.broadcast(bad.select((total == 0).alias("_ok")))  # one row
    return target.unionByName(batch.crossJoin(ok).filter("_ok").select(*target.columns))


def capped_adjustment(rows: DataFrame, groups: DataFrame, key: str, group: str, amount: str, budget: str, percent: float) -> tuple[DataFrame, DataFrame]:
    """A cursor's updates as one set: ``amount`` raised by ``percent``, to the group's budget by head at most.

    ``groups``: group, budget. Returns the rows as they are afterwards, and
    history (key, old_amount, new_amount, reason) of all that were looked at:
    those with an amount above 0. Heads are counted over all rows of a group;
    rows of unknown groups have no cap.
    """
    heads = rows.groupBy(group).agg(F.count("*").alias("_heads"))
    cap = groups.join(heads, group).select(group, (F.col(budget) / F.col("_heads")).alias("_cap"))
    j = rows.join(cap, group, "left")
    money = rows.schema[amount].dataType
    raised = F.col(amount) * (1 + F.lit(percent) / 100)
    new = F.when(F.col(amount) > 0, F.least(raised, F.coalesce("_cap", raised))).otherwise(F.col(amount)).cast(money)
    j = j.withColumn("_new", new)
    history = j.filter(F.col(amount) > 0).select(key, F.col(amount).alias("old_amount"), F.col("_new").alias("new_amount"), F.lit(f"Annual adjustment {percent:.2f}%").alias("reason"))
    return j.withColumn(amount, F.col("_new")).select(*rows.columns), history


def queue_drain(queue: DataFrame, known: DataFrame, id_col: str, key: str, n: int, order: list[Column], status: str = "status") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first n pending entries are worked off: done, or failed where the key is unknown.

    Returns the entries with their result, the queue as it is afterwards, and
    the error log (id_col, message). ``order`` must be unique. n is the
    feature's limit; the rest of the queue stays as it is.
    """
    first = queue.filter(F.col(status) == "Pending").orderBy(*order).limit(n)
    hit = known.select(F.col(key)).distinct().withColumn("_hit", F.lit(True))
    done = first.join(hit, key, "left").withColumn("result", F.when(F.col("_hit"), "Completed").otherwise("Failed")).drop("_hit")
    after = queue.join(F.broadcast(done.select(id_col, "result")), id_col, "left").withColumn(status, F.coalesce("result", status)).select(*queue.columns)  # n rows at most
    errors = done.filter("result = 'Failed'").select(id_col, F.concat(F.lit("Queue item "), F.col(id_col), F.lit(": Employee not found for queue item")).alias("message"))
    return done, after, errors


def write_partitioned(df: DataFrame, path: str, c: str, boundaries: list[Column]) -> None:
    """Files by range of a column (``range_part``), so that readers that filter by it read those alone."""
    part = range_partition(F.col(c), boundaries)
    df.withColumn("range_part", part).repartition("range_part", F.pmod(F.xxhash64(c), F.lit(8))).write.mode("overwrite").partitionBy("range_part").parquet(path)


def read_between(df: DataFrame, c: str, low, high, boundaries: list) -> DataFrame:
    """Rows with low <= column < high of a table that ``write_partitioned`` wrote (boundaries as values): only partitions that can hold such rows are read."""
    first = 1 + sum(low >= b for b in boundaries)
    last = 1 + sum(high > b for b in boundaries)
    return df.filter(F.col("range_part").between(first, last) & (F.col(c) >= F.lit(low)) & (F.col(c) < F.lit(high)))
