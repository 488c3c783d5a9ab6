"""Request telemetry per tumbling window. The same functions take batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ferryline.sources.tables import captured, shred_events


def _windowed(events: DataFrame, size: str, late: str) -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.withColumn("w", F.window("ts", size))


def request_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    c = _windowed(events, size, late).groupBy("w").agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return c.select(F.col("w.start").alias("start"), "requests", "errors")


#: Upper bounds of the duration buckets; the last takes the rest.
BUCKETS = [1, 5, 10, 50, 1_000_000]


def latency_buckets(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", value_col: str = "value") -> DataFrame:
    bucket = F.coalesce(*[F.when(F.col(value_col) < b, F.lit(b)) for b in BUCKETS[:-1]], F.lit(BUCKETS[-1]))
    c = _windowed(events, size, late).groupBy("w", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return c.select(F.col("w.start").alias("start"), "bucket", "n")


def hit_ratio(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    c = _windowed(events, size, late).groupBy("w").agg(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("hit_ratio"))
    return c.select(F.col("w.start").alias("start"), "hit_ratio")


def without_repeats(statements: DataFrame, key: str = "fingerprint", late: str = "10 minutes") -> DataFrame:
    """One of several equal statements within the watermark; of a batch frame one of all."""
    if not statements.isStreaming:
        return statements.dropDuplicates([key])
    return statements.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def active_sessions(events: DataFrame, key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """``events``: key, ts, step (+1 opens, -1 closes). key and active: open sessions so far.

    A batch frame gives the last state of each key; a stream an update for each
    key and trigger, from a running sum in the state store.
    """
    return events.groupBy(key).agg(F.sum("step").alias("active"))


class _Sessions(StatefulProcessor):
    """Open sessions of a key, with a timer that ends them when nothing was heard for ``idle`` seconds."""

    def __init__(self, key: str, idle: int):
        self.key, self.idle = key, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "active long, last_ms long, timer_ms long")

    def handleInputRows(self, key, rows, timerValues):
        active, last, timer = self.state.get() if self.state.exists() else (0, 0, 0)
        steps = sorted((r["ms"], -r["step"]) for r in rows)  # of one time, opens first
        for ms, step in steps:
            active, last = max(active - step, 0), max(last, ms)
        if timer:
            self.handle.deleteTimer(timer)
        if active:
            timer = last + self.idle * 1000
            self.handle.registerTimer(timer)
            self.state.update((active, last, timer))
        else:  # nothing is open: nothing to keep
            self.state.clear()
        yield Row(**{self.key: key[0]}, ms=last, event="update", active=active)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        yield Row(**{self.key: key[0]}, ms=expiredTimerInfo.getExpiryTimeInMs(), event="expired", active=0)

    def close(self) -> None:
        pass


def idle_sessions(events: DataFrame, key: str = "user_id", idle: int = 1800, late: str = "10 minutes") -> DataFrame:
    """``events``: key, ts, step (+1 opens, -1 closes). Open sessions of each key; sessions that are never closed end ``idle`` seconds after the last event.

    A close that finds nothing open (it came after the end, or its open was
    lost) changes nothing. A stream keeps state for keys with open sessions
    only, by event time, and drops events later than the watermark; it needs the
    RocksDB state store. It gives a row of key, at, event and active for each key
    and trigger, and one for each end. A batch frame gives the last of these
    rows for each key, as of the newest event of all less ``late``.
    """
    if events.isStreaming:
        kind = events.schema[key].dataType.simpleString()
        own = events.select(key, "ts", "step", F.unix_millis("ts").alias("ms")).withWatermark("ts", late).groupBy(key)
        out = own.transformWithState(_Sessions(key, idle), f"{key} {kind}, ms long, event string, active long", "Update", "eventTime")
        return out.select(key, F.timestamp_millis("ms").alias("at"), "event", "active")
    line = Window.partitionBy(key).orderBy("ts", F.desc("step"))
    gap = F.col("ts") > F.lag("ts").over(line) + F.make_dt_interval(secs=F.lit(idle))
    spell = F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.select(key, "ts", "step").withColumn("spell", spell)
    inner = Window.partitionBy(key, "spell").orderBy("ts", F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    # opens less closes that found one: the running sum above its lowest point so far
    rows = rows.withColumn("sum", F.sum("step").over(inner)).withColumn("active", F.col("sum") - F.least(F.lit(0), F.min("sum").over(inner)))
    last = rows.groupBy(key).agg(F.max("ts").alias("ts"), F.max_by("active", F.struct("ts", "spell", -F.col("step"), -F.col("sum"))).alias("active"))
    now = F.broadcast(events.agg((F.max("ts") - F.expr(f"interval {late}")).alias("now")))  # one row
    end = F.col("ts") + F.make_dt_interval(secs=F.lit(idle))
    over = (F.col("active") > 0) & (end <= F.col("now"))
    return last.crossJoin(now).select(key, F.when(over, end).otherwise(F.col("ts")).alias("at"), F.when(over, "expired").otherwise("update").alias("event"), F.when(over, 0).otherwise(F.col("active")).cast("long").alias("active"))


def ingest(events: DataFrame) -> DataFrame:
    """Event XML (batch or stream) to captured statements: relevant types, cut texts, rebuilt calls."""
    return captured(shred_events(events).withColumn("proc_name", F.col("object_name")))


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
