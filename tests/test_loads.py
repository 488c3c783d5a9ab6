"""Copies at once, resumed; loads that may be repeated; reads in even parts (Derby, which comes with Spark)."""

import subprocess
import sys
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ferryline.operators.copying import copy_tables, read_summary
from ferryline.sources import loads
from ferryline.sources import tables as S

OPTIONS = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def test_waves_overlap_and_runs_resume(spark, tmp_path):
    tables = spark.createDataFrame([(n,) for n in ("a", "b", "c", "d", "e", "f")], "table_name string")
    edges = spark.createDataFrame([("d", "a"), ("e", "d"), ("f", "b")], "src string, dst string")
    spans, lock, bad, calls = {}, threading.Lock(), {"b": 2, "c": 99}, []

    def copy(name):
        start = time.time()
        with lock:
            calls.append(name)
            bad[name] = bad.get(name, 0) - 1
            fail = bad[name] >= 0
        n = spark.range(50).count()
        time.sleep(0.5)
        if fail:
            raise RuntimeError(f"{name} broke")
        with lock:
            spans[name] = (start, time.time())
        return n

    first = {r.table_name: r for r in copy_tables(spark, tables, edges, copy, tries=3, summary=f"file://{tmp_path}/s").collect()}
    assert {n: (r.wave, r.rows, r.status, r.attempts) for n, r in first.items()} == {"a": (0, 50, "ok", 1), "b": (0, 50, "ok", 3), "c": (0, None, "failed", 3), "d": (1, 50, "ok", 1), "e": (2, 50, "ok", 1), "f": (1, 50, "ok", 1)}
    assert first["c"].message == "c broke" and spans["a"][0] < spans["b"][1] and spans["d"][0] < spans["f"][1] and spans["f"][0] < spans["d"][1]
    assert spans["d"][0] >= spans["b"][1] and spans["e"][0] >= max(spans["d"][1], spans["f"][1])  # waves don't overlap
    calls.clear()
    bad["c"] = 0
    again = {r.table_name: r.status for r in copy_tables(spark, tables, edges, copy, summary=f"file://{tmp_path}/s").collect()}
    assert calls == ["c"] and set(again.values()) == {"ok"}
    assert {r.table_name: r.status for r in read_summary(spark, f"file://{tmp_path}/s").collect()} == again


def make(spark, url, sql):
    with loads.transaction(spark, url, **OPTIONS) as c:
        loads._run(c, sql)


def rows(spark, url, table="T"):
    return sorted(tuple(r) for r in S.read_jdbc(spark, url, table, ["ID", "NAME"], **OPTIONS).collect())


def test_loads_happen_once(spark, tmp_path, monkeypatch):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    make(spark, url, "CREATE TABLE T (ID INT, NAME VARCHAR(20))")
    df = spark.range(500).select((F.col("id") % 400).cast("int").alias("ID"), F.concat(F.lit("n"), F.col("id") % 400).alias("NAME")).repartition(3)
    want = sorted((i % 400, f"n{i % 400}") for i in range(500))  # repeated rows are rows like any
    moved, write = [], loads.write_jdbc

    def breaks(own, url, table, *args, **options):
        """The third part's tasks commit, some of them twice, and then the call is lost."""
        write(own, url, table, *args, **options)
        moved.append(table)
        if len(moved) == 3:
            write(own.limit(20), url, table, *args, **options)
            raise RuntimeError("lost")

    monkeypatch.setattr(loads, "write_jdbc", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        loads.load_once(df, url, "T", "b1", parts=5, **OPTIONS)
    assert 0 < len(rows(spark, url)) < 500
    before = len(rows(spark, url))

    def twice(own, url, table, *args, **options):
        """Every task commits two times."""
        write(own, url, table, *args, **options)
        write(own, url, table, *args, **options)

    monkeypatch.setattr(loads, "write_jdbc", twice)
    assert loads.load_once(df.repartition(7), url, "T", "b1", parts=5, **OPTIONS) == 500 - before
    assert rows(spark, url) == want
    assert loads.load_once(df, url, "T", "b1", parts=5, **OPTIONS) == 0 and rows(spark, url) == want
    # replacing: old and new rows change places in one transaction, once for each batch
    monkeypatch.setattr(loads, "write_jdbc", write)
    few = df.filter("ID < 3").distinct()
    assert loads.load_once(few, url, "T", "b2", replace=True, **OPTIONS) == 3 and loads.load_once(df, url, "T", "b2", replace=True, **OPTIONS) == 0
    assert rows(spark, url) == [(i, f"n{i}") for i in range(3)]
    too_long = few.withColumn("NAME", F.lpad("NAME", 30, "x"))
    with pytest.raises(Exception, match="truncat"):
        loads.load_once(too_long, url, "T", "b3", replace=True, **OPTIONS)
    assert rows(spark, url) == [(i, f"n{i}") for i in range(3)]
    assert loads.load_once(few.limit(0), url, "T", "b4", parts=2, **OPTIONS) == 0


SCRIPT = """
import sys; sys.path[:0] = [{repo!r}]
from pyspark import TaskContext
from pyspark.sql import SparkSession
from ferryline.sources import loads, tables as S
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
url, options = "jdbc:derby:{path}/db2;create=true", {{"driver": "org.apache.derby.jdbc.EmbeddedDriver"}}
with loads.transaction(spark, url, **options) as c:
    loads._run(c, "CREATE TABLE T (ID BIGINT)")

def flaky(batches):
    for b in batches:
        yield b
    if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
        raise RuntimeError("first try")

orig = loads.written
loads.written = lambda df: orig(df).mapInArrow(flaky, "ID long, load_no long, load_part int")  # the tasks that write to the database fail
n = loads.load_once(spark.range(0, 300, 1, 4).withColumnRenamed("id", "ID"), url, "T", "b", parts=2, **options)
got = sorted(r.ID for r in S.read_jdbc(spark, url, "T", ["ID"], **options).collect())
assert n == 300 and got == list(range(300)), (n, len(got))
print("fine")
"""


def test_a_task_that_fails_once(tmp_path):
    """In a session whose tasks are tried again."""
    code = SCRIPT.format(repo=str(Path(__file__).resolve().parent.parent), path=tmp_path)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_even_parts_of_a_skewed_key(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    k = F.when(F.col("id") % 20 == 0, F.col("id") * 1000).otherwise(F.col("id") % 997).cast("int")  # nearly all keys in a thousandth of the range
    df = spark.range(20_000).select(F.when(F.col("id") % 500 == 7, None).otherwise(k).alias("K"), F.expr("date_add(date'2020-01-01', cast(sqrt(id) as int))").alias("D"), F.expr("timestamp_seconds(id * id)").alias("S"))
    S.write_jdbc(df, url, "T", **OPTIONS)
    for key in ("K", "D", "S"):
        back = loads.read_jdbc_even(spark, url, "T", [key], key, 8, **OPTIONS)
        sizes = [r["n"] for r in back.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert back.rdd.getNumPartitions() == 8 and sum(sizes) == 20_000 and max(sizes) <= 2 * 20_000 / 8
        assert back.exceptAll(df.select(key)).isEmpty()
    wide = S.read_jdbc(spark, url, "T", ["K"], "K", (0, 20_000_000), 8, **OPTIONS)
    assert max(r["n"] for r in wide.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) > 5 * 20_000 / 8  # equal widths
    assert loads.read_jdbc_even(spark, url, "(SELECT * FROM T WHERE K < 0) x", ["K"], "K", 4, **OPTIONS).count() == 0
