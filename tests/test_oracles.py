"""Every registered query against its SQL, on the smallest tables, each within a time limit."""

import signal
from contextlib import contextmanager
from pathlib import Path

import duckdb
import pytest

from ferryline import registry

SF = "/root/testdata/sf0.001"
#: Seconds that a query may take here.
LIMIT = 60


@contextmanager
def limit(seconds):
    def stop(*_):
        raise TimeoutError(f"over {seconds} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(seconds)
    try:
        yield
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, con, name):
    with limit(LIMIT):
        df = registry.queries()[name](spark, SF)
        rows = [tuple(r) for r in df.collect()]
    cur = con.execute(registry.oracles()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(rows, df.columns) == plain(cur.fetchall(), names)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
