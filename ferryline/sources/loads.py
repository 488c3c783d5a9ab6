"""Database loads that can be repeated, and reads in parts of equal size."""

from __future__ import annotations

import hashlib
from contextlib import contextmanager
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.operators.staging import written
from ferryline.sources.tables import read_jdbc, write_jdbc


@contextmanager
def transaction(spark: SparkSession, url: str, **options: str):
    """A connection of the driver's own: committed at the end, rolled back on an error. For statements about tables, never for rows."""
    if "driver" in options:
        spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    properties = spark._jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in options:
            properties.setProperty(k, options[k])
    c = spark._jvm.java.sql.DriverManager.getConnection(url, properties)
    c.setAutoCommit(False)
    try:
        yield c
        c.commit()
    except BaseException:
        c.rollback()
        raise
    finally:
        c.close()


def _run(c, sql: str, *values) -> int:
    s = c.prepareStatement(sql)
    try:
        for i, v in enumerate(values, 1):
            s.setObject(i, v)
        return s.executeUpdate()
    finally:
        s.close()


def _exists(c, table: str) -> bool:
    tables = c.getMetaData().getTables(None, None, "%", None)
    while tables.next():
        if tables.getString("TABLE_NAME").lower() == table.lower():
            return True
    return False


def _finished(c, ledger: str, table: str, batch: str) -> set[int]:
    s = c.prepareStatement(f"SELECT load_part FROM {ledger} WHERE load_table = ? AND load_batch = ?")
    s.setString(1, table)
    s.setString(2, batch)
    rows, out = s.executeQuery(), set()
    while rows.next():
        out.add(rows.getInt(1))
    s.close()
    return out


def load_once(df: DataFrame, url: str, table: str, batch: str, parts: int = 8, keys: list[str] | None = None, replace: bool = False, ledger: str = "load_ledger", batch_size: int = 1000, **options: str) -> int:
    """Add the rows of ``df`` to a table exactly once, however often tasks or the whole call are repeated. Returns the rows that this call added.

    The frame is cut into ``parts`` by its ``keys`` (all columns, if none are
    named: what a run in the middle of a batch leaves undone, the next one cuts
    in the same way). Each part is written by Spark tasks into a staging table,
    with a number for each row; a task that is repeated after its commit only
    repeats numbers, and of equal numbers one is moved on: that with the smaller
    of two random marks. One transaction moves the rows and notes the part in ``ledger`` (load_table, load_batch, load_part, load_rows): both
    happen, or neither. Parts in the ledger are skipped.

    With ``replace`` the table's old rows go in the transaction that brings the
    new ones, as one part. An empty frame is noted too.
    """
    spark, columns = df.sparkSession, df.columns
    parts = 1 if replace else parts
    stage = f"stage_{hashlib.sha256(f'{table}/{batch}'.encode()).hexdigest()[:12]}"
    with transaction(spark, url, **options) as c:
        if not _exists(c, ledger):
            _run(c, f"CREATE TABLE {ledger} (load_table VARCHAR(200) NOT NULL, load_batch VARCHAR(200) NOT NULL, load_part INT NOT NULL, load_rows BIGINT NOT NULL, PRIMARY KEY (load_table, load_batch, load_part))")
        done = _finished(c, ledger, table, batch)
    todo = [p for p in range(parts) if p not in done]
    if not todo:
        return 0
    # numbers are written with the rows, so a repeated task reads the same ones
    part = F.pmod(F.xxhash64(*(keys or columns)), F.lit(parts)).cast("int")
    rows = written(df.withColumns({"load_no": F.monotonically_increasing_id(), "load_part": part}))
    mark = (F.java_method(F.lit("java.lang.Math"), F.lit("random")).cast("double") * 2**53).cast("long")  # drawn anew each time a task runs
    added = 0
    for p in todo:
        own = rows.filter(F.col("load_part") == p).drop("load_part").withColumn("load_mark", mark)
        with transaction(spark, url, **options) as c:
            if _exists(c, stage):
                _run(c, f"DROP TABLE {stage}")  # left by a call that was cut short
        write_jdbc(own, url, stage, batch_size, **options)
        with transaction(spark, url, **options) as c:
            if replace:
                _run(c, f"DELETE FROM {table}")
            q = c.getMetaData().getIdentifierQuoteString().strip()  # names as Spark wrote them
            names = ", ".join(f"{q}{n}{q}" for n in columns)
            once = f"SELECT {q}load_no{q} AS n, MIN({q}load_mark{q}) AS m FROM {stage} GROUP BY {q}load_no{q}"
            n = _run(c, f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage} s JOIN ({once}) o ON s.{q}load_no{q} = o.n AND s.{q}load_mark{q} = o.m")
            _run(c, f"INSERT INTO {ledger} (load_table, load_batch, load_part, load_rows) VALUES (?, ?, ?, ?)", table, batch, p, n)
            _run(c, f"DROP TABLE {stage}")
        added += n
    return added


def even_bounds(keys: DataFrame, key: str, parts: int, accuracy: int = 10_000) -> list:
    """Bounds that cut a key's values into ``parts`` of about equal numbers of rows, by approximate quantiles; fewer if values repeat."""
    found = keys.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], accuracy).alias("b")).first().b if parts > 1 else []
    return sorted(set(found or []))


def _literal(v) -> str:
    """Numbers as they are, dates and times in the form every JDBC driver reads."""
    if isinstance(v, datetime):
        return f"{{ts '{v:%Y-%m-%d %H:%M:%S.%f}'}}"
    if isinstance(v, date):
        return f"{{d '{v:%Y-%m-%d}'}}"
    if isinstance(v, (int, float, Decimal)):
        return str(v)
    raise TypeError(f"no bounds of {type(v).__name__}")


def read_jdbc_even(spark: SparkSession, url: str, table: str, columns: list[str], key: str, parts: int = 16, **options: str) -> DataFrame:
    """A database table in ``parts`` ranges that hold about as many rows each, however a key (number, date or time) is spread.

    The key's column alone is read first, for its quantiles. Rows without key
    are in the first part; equal keys stay together.
    """
    b = [_literal(v) for v in even_bounds(read_jdbc(spark, url, table, [key], **options), key, parts)]
    ranges = [f"{key} IS NULL OR {key} < {b[0]}", *[f"{key} >= {x} AND {key} < {y}" for x, y in zip(b, b[1:])], f"{key} >= {b[-1]}"] if b else ["1 = 1"]
    return spark.read.jdbc(url, table, predicates=ranges, properties={"fetchsize": "10000", **options}).select(*columns)
