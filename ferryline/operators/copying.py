"""Copies of many tables: in dependency order, those of one wave at once, with retries, and resumed where a run left off."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from itertools import groupby

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.operators.graphs import dependency_waves

SUMMARY = "table_name string, wave int, rows long, status string, message string, attempts int, started timestamp, ended timestamp"


def read_summary(spark: SparkSession, folder: str) -> DataFrame:
    """What the runs with this summary folder have done: one row for each table, its last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SUMMARY)
    return spark.read.schema(SUMMARY).parquet(f"{folder}/*")


def copy_tables(spark: SparkSession, tables: DataFrame, edges: DataFrame, copy: Callable[[str], int], most: int = 100_000, workers: int = 8, tries: int = 1, summary: str | None = None) -> DataFrame:
    """Copy each of ``tables`` (table_name) after those it refers to (``edges``: src refers to dst); one row for each, see ``SUMMARY``.

    ``copy`` moves one table, as a Spark job, and returns its number of rows; it
    must be safe to repeat (see ``loads.load_once``). Up to ``workers`` tables of
    a wave are copied at once, from threads of their own, in the scheduler's
    pool "copies": with ``spark.scheduler.mode`` FAIR they share the executors
    evenly. A table that fails is tried ``tries`` times; it doesn't stop others.
    Tables in or behind a cycle come last.

    With ``summary``, a shared folder, every table's row is written there as soon
    as it is known, and tables that a former run copied are not copied again.
    Names alone come to the driver, ``most`` at most: more is an error.
    """
    waves = dependency_waves(tables.select(F.col("table_name").alias("node")), edges)
    names = waves.orderBy(F.asc_nulls_last("wave"), "node").limit(most + 1).collect()
    if len(names) > most:
        raise ValueError(f"over {most} tables")
    known = {r.table_name: tuple(r) for r in read_summary(spark, summary).filter("status = 'ok'").collect()} if summary else {}

    def one(name: str, wave: int | None) -> tuple:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", "copies")
        started = datetime.now()
        for attempt in range(1, tries + 1):
            try:
                row = (name, wave, copy(name), "ok", None, attempt, started, datetime.now())
                break
            except Exception as e:  # noqa: BLE001  reported, by table
                row = (name, wave, None, "failed", str(e)[:200], attempt, started, datetime.now())
        if summary:
            own = hashlib.sha256(name.encode()).hexdigest()[:32]
            spark.createDataFrame([row], SUMMARY).coalesce(1).write.mode("overwrite").parquet(f"{summary}/{own}")
        return row

    out = []
    with ThreadPoolExecutor(workers) as pool:
        for wave, group in groupby(names, lambda r: r.wave):
            todo = [r.node for r in group]
            out += [known[n] for n in todo if n in known]
            # a wave ends before the next begins
            out += [f.result() for f in [pool.submit(inheritable_thread_target(spark)(one), n, wave) for n in todo if n not in known]]
    return spark.createDataFrame(out, SUMMARY)
