"""Versioned updates, sessions with state, and streams merged into a table."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ferryline.operators.dml import versioned_update
from ferryline.streaming import telemetry as X
from ferryline.streaming.upsert import Snapshot

T0 = datetime(2024, 1, 1)
END = datetime(9999, 12, 31)


def at(hours):
    return T0 + timedelta(hours=hours)


# ---- temporal tables


def replay(history, changes):
    """Value of each key at each hour, changes in order of time and number; then the periods."""
    out = []
    keys = {r[0] for r in history} | {r[0] for r in changes}
    for k in keys:
        points = {}
        for key, v, s, e in history:
            if key == k:
                points.setdefault(e, (0, 0, None))
                points[s] = max(points.get(s, (0, 0, None)), (1, 0, v), key=lambda p: p[:2])
        for key, v, when, seq, gone in changes:
            if key == k and when is not None:
                points[when] = max(points.get(when, (0, 0, None)), (2, seq, None if gone else v), key=lambda p: p[:2])
        times = sorted(points)
        out += [(k, points[a][2], a, b) for a, b in zip(times, [*times[1:], END]) if points[a][2] is not None]
    return sorted(out, key=repr)


def test_late_changes_split_old_periods(spark):
    rng = random.Random(3)
    history = [(k, f"v{k}-{i}", at(24 * i + k), at(24 * (i + 1) + k) if i < 3 or k % 2 else END) for k in range(6) for i in range(4)]
    history += [(None, "n", at(0), END), (99, "still", at(5), END)]
    changes = [(rng.choice([*range(8), None]), f"c{i}", at(rng.choice([rng.randrange(120), 24 * rng.randrange(5)])), i, rng.random() < 0.2) for i in range(80)] + [(1, "no time", None, 999, False)]
    h = spark.createDataFrame(history, "k int, v string, sys_start timestamp, sys_end timestamp")
    c = spark.createDataFrame(rng.sample(changes, len(changes)), "k int, v string, at timestamp, seq int, gone boolean").withColumn("extra", F.lit(1))
    got = sorted((tuple(r) for r in versioned_update(h, c, ["k"], "at", "seq", "gone").collect()), key=repr)
    assert got == replay(history, changes)
    line = sorted(got, key=lambda r: (repr(r[0]), r[2]))
    for a, b in zip(line, line[1:]):
        assert a[0] != b[0] or a[3] <= b[2]
    # all at once or one by one, the periods are the same
    step, some = h, [r for r in changes if not r[4]][:8]
    for row in some:
        step = spark.createDataFrame(versioned_update(step, spark.createDataFrame([row], c.drop("extra").schema), ["k"], "at", "seq").collect(), h.schema)
    assert sorted((tuple(r) for r in step.collect()), key=repr) == replay(history, some)
    assert versioned_update(h.limit(0), c.limit(0), ["k"], "at", "seq").count() == 0
    assert versioned_update(h, c.limit(0), ["k"], "at", "seq").count() == len(history)


# ---- sessions


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def test_sessions_end_when_nothing_is_heard(rocks, tmp_path):
    """A user that closes, one that never does, one whose close comes after the end, and one that is lost behind the watermark."""
    schema = "user_id string, ts timestamp, step int"
    batches = [
        [("a", at(0), 1), ("b", at(0), 1), ("b", at(0.1), 1), ("c", at(0), 1)],
        [("a", at(0.2), -1), ("x", at(3), 1)],  # moves the watermark to 2:50, past the end of b and c at 0:36 and 0:30
        [("c", at(3.0), -1), ("b", at(3.1), 1), ("d", at(3.1), -1), ("late", at(0.5), 1)],
        [("b", at(3.2), 1), ("x", at(3.3), -1)],
    ]
    for i, rows in enumerate(batches):
        rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i < len(batches):
            run(rocks, tmp_path)
    seen = [(r.user_id, r.event, r.active) for r in rocks.read.parquet(str(tmp_path / "out")).orderBy("n", "user_id", "event").collect()]
    assert [(e, n) for u, e, n in seen if u == "a"] == [("update", 1), ("update", 0)]
    assert [(e, n) for u, e, n in seen if u == "b"] == [("update", 2), ("expired", 0), ("update", 1), ("update", 2)]
    assert [(e, n) for u, e, n in seen if u == "c"] == [("update", 1), ("expired", 0), ("update", 0)]
    assert [(e, n) for u, e, n in seen if u == "d"] == [("update", 0)]
    assert not [s for s in seen if s[0] == "late"]
    end = {r.user_id: r["at"] for r in rocks.read.parquet(str(tmp_path / "out")).filter("event = 'expired'").collect()}
    assert end == {"b": at(0.1) + timedelta(minutes=30), "c": at(0.5)}
    every = rocks.createDataFrame([r for b in batches for r in b if r[0] != "late"], schema)
    twin = {r.user_id: (r.event, r.active) for r in X.idle_sessions(every).collect()}
    assert twin == {u: (e, n) for u, e, n in seen}


def run(spark, tmp_path):
    schema = "user_id string, ts timestamp, step int"
    source = X.read_stream(spark, str(tmp_path / "in"), schema, 100)
    write = lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))
    q = X.idle_sessions(source).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


# ---- merged streams

KIND = "id long, name string, ts long"


def state(snapshot):
    return sorted((tuple(r) for r in snapshot.read().collect()), key=repr)


def test_replayed_batches_change_nothing(spark, tmp_path):
    s = Snapshot(spark, f"file://{tmp_path}/t", KIND, ["id"], "ts", buckets=4)
    first = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (None, "n", 1)], KIND)
    second = spark.createDataFrame([(1, "c", 3), (3, "y", 1), (None, "m", 2), (2, "x", 9)], KIND).withColumn("gone", F.col("ts") == 9)
    assert state(s) == [] and s.merge(first, 0)
    assert state(s) == sorted([(1, "b", 2), (2, "x", 1), (None, "n", 1)], key=repr)
    assert s.merge(second, 1, "gone")
    want = sorted([(1, "c", 3), (3, "y", 1), (None, "m", 2)], key=repr)
    assert state(s) == want
    assert not s.merge(first, 0) and not s.merge(second, 1, "gone") and state(s) == want and s.batches() == [0, 1]
    assert s.merge(first.limit(0), 2) and state(s) == want


def test_a_batch_cut_short_is_merged_once(spark, tmp_path, monkeypatch):
    s = Snapshot(spark, f"file://{tmp_path}/t", KIND, ["id"], "ts", buckets=3)
    s.merge(spark.range(20).selectExpr("id", "'old' AS name", "0L AS ts"), 0)
    change = spark.range(10, 30).selectExpr("id", "'new' AS name", "1L AS ts")
    with monkeypatch.context() as m:
        m.setattr(Snapshot, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            s.merge(change, 1)
    assert s.batches() == [0] and {r[1] for r in state(s)} == {"old"} and len(state(s)) == 20
    assert s.merge(change, 1)
    assert {r[0]: r[1] for r in state(s)} == {i: "old" if i < 10 else "new" for i in range(30)}


def test_a_stream_is_merged(spark, tmp_path):
    rows = spark.range(400).selectExpr("id % 90 AS id", "concat('v', id) AS name", "id AS ts")
    rows.repartition(4, "ts").write.parquet(str(tmp_path / "in"))
    s = Snapshot(spark, f"file://{tmp_path}/t", KIND, ["id"], "ts", buckets=5)
    for _ in range(2):  # started again on its checkpoint, it has nothing to do
        q = s.follow(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in")), str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert {r[0]: r[2] for r in state(s)} == {i: max(x for x in range(400) if x % 90 == i) for i in range(90)}
    # a new query without its checkpoint replays numbers that are merged already
    before = state(s)
    q = s.follow(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert state(s) == before and q.exception() is None
