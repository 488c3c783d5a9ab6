"""Planned casts on odd values, and the hash tree against the full comparison."""

import random

import pytest
from pyspark.sql import functions as F

from ferryline.operators import migrate as M
from ferryline.operators.casts import convert_table, planned_cast


def test_casts_of_odd_values(spark):
    cases = [
        ("integer", ["1", "-7", "2147483648", "1.5", "1e3", "", "x", None], [1, -7, None, None, 1000, None, None, None]),
        ("numeric(5,2)", ["1.234", "999.99", "1000", "-0"], [1.23, 999.99, None, 0]),
        ("varchar(3)", ["abc", "abcd", "", None, "äöü"], ["abc", None, "", None, "äöü"]),
        ("uuid", ["123e4567-e89b-12d3-a456-426614174000", "123"], ["123e4567-e89b-12d3-a456-426614174000", None]),
        ("boolean", ["1", "true", "maybe"], [True, True, None]),
        ("jsonb", ['{"a":1}', "{a"], ['{"a":1}', None]),
        ("time", ["23:59:59.1234567", "24:00"], ["23:59:59.1234567", None]),
        ("bytea", ["ab"], [b"ab"]),
    ]
    for target, texts, want in cases:
        df = spark.createDataFrame(list(enumerate(texts)), "k int, v string")
        new, why = planned_cast(F.col("v"), target)
        got = df.select("k", new.alias("n"), why.alias("w")).orderBy("k").collect()
        assert [float(r.n) if target.startswith("numeric") and r.n is not None else bytes(r.n) if target == "bytea" else r.n for r in got] == want, target
        assert [r.w is None for r in got] == [w is not None or t is None for t, w in zip(texts, want)], target
    with pytest.raises(ValueError):
        planned_cast(F.col("v"), "money")
    df = spark.createDataFrame([(1, "x", "300"), (2, "5", "30")], "k int, a string, b string")
    kept, aside = convert_table(df, [("a", "integer", None), ("b", "smallint", "between 0 and 255")], ["k"])
    assert [tuple(r) for r in kept.collect()] == [(2, 5, 30)]
    assert sorted(tuple(r) for r in aside.collect()) == [(1, "a", "x", "no integer"), (1, "b", "300", "not between 0 and 255")]
    assert kept.dtypes == [("k", "int"), ("a", "int"), ("b", "smallint")] and convert_table(df, [], ["k"])[1].count() == 0


def shuffled(spark, make):
    """Rows of ``make``, and how many rows its stages wrote into exchanges."""
    store = spark.sparkContext._jsc.sc().statusStore()
    count = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (lambda s: [s.apply(i) for i in range(s.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}
    before = count()
    rows = sorted(tuple(r) for r in make().collect())
    return rows, sum(n for k, n in count().items() if k not in before)


def test_hash_tree_finds_what_differs(spark):
    a = spark.range(60_000).select((F.col("id") % 59_000).alias("k"), F.col("id").cast("string").alias("v"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("w")).coalesce(2)
    change = F.when(F.col("k").isin(5, 777), "other").otherwise(F.col("v"))
    b = a.withColumn("v", change).filter("k != 40000").unionByName(spark.createDataFrame([(99_999, "new", None)], "k long, v string, w long"))
    want = sorted(tuple(r) for r in M.reconcile_content(a, b, ["k"]).collect())
    got, few = shuffled(spark, lambda: M.reconcile_by_tree(a, b, ["k"]))
    _, many = shuffled(spark, lambda: M.reconcile_content(a, b, ["k"]))
    assert got == want and len(got) == 4
    assert few < many / 2
    assert M.reconcile_by_tree(a, a, ["k"]).isEmpty() and M.reconcile_by_tree(a.limit(0), a.limit(0), ["k"]).isEmpty()


def test_hash_tree_with_nulls_and_repeats(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "x", "y"])) for _ in range(300)]
    other = rows[:250] + [(rng.choice([None, 3, 4, 90]), "z") for _ in range(40)]
    a, b = (spark.createDataFrame(r, "k int, v string") for r in (rows, other))
    key = lambda r: repr(tuple(r))
    assert sorted(M.reconcile_by_tree(a, b, ["k"], (3, 6)).collect(), key=key) == sorted(M.reconcile_content(a, b, ["k"]).collect(), key=key)
    with pytest.raises(ValueError):
        M.reconcile_by_tree(a, b, ["k"], (30,))
