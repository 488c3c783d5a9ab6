"""Writes as table-to-table queries on states derived from orders, customers and events."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferryline.operators import dml
from ferryline.operators.staging import shared_folder
from ferryline.plans.common import money, t, total
from ferryline.registry import query

_NEW = "SELECT o_orderkey + 10000000 AS o_orderkey, o_custkey, 'N' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 = 0"
_SRC = "SELECT CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey, o_custkey, 'M' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0"
_OLD = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def _orders(s, d):
    return t(s, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _source(s, d):
    k = F.col("o_orderkey")
    return _orders(s, d).filter(k % 2 == 0).select(F.when(k % 4 == 0, k + 10000000).otherwise(k).alias("o_orderkey"), "o_custkey", F.lit("M").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))


@query(f"{_OLD} UNION ALL {_NEW}")
def insert_select(s, d):
    o = _orders(s, d)
    new = o.filter("o_orderkey % 10 = 0").select((F.col("o_orderkey") + 10000000).alias("o_orderkey"), "o_custkey", "o_totalprice")
    return dml.insert_select(o, new, {"o_orderstatus": F.lit("N")})


@query("SELECT c_custkey, CASE WHEN spent IS NULL THEN c_acctbal ELSE spent END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def update_from(s, d):
    spent = t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(total("o_totalprice").alias("spent"))
    return dml.update_from(t(s, d, "customer", "c_custkey", "c_acctbal"), spent, ["c_custkey"], {"c_acctbal": F.col("s_spent")})


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def delete_using(s, d):
    gone = t(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return dml.delete_using(t(s, d, "customer", "c_custkey", "c_name"), gone, ["c_custkey"])


@query(f"""WITH src AS ({_SRC}), tgt AS ({_OLD})
          SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN s.o_custkey ELSE t.o_custkey END AS o_custkey, CASE WHEN s.o_orderkey IS NULL THEN t.o_orderstatus ELSE s.o_orderstatus END AS o_orderstatus,
          CASE WHEN s.o_orderkey IS NULL THEN t.o_totalprice ELSE s.o_totalprice END AS o_totalprice FROM tgt t FULL OUTER JOIN src s ON t.o_orderkey = s.o_orderkey WHERE NOT (s.o_orderkey IS NULL AND t.o_orderkey % 3 = 0)""")
def merge_three_way(s, d):
    sets = {"o_orderstatus": F.col("s_o_orderstatus"), "o_totalprice": F.col("s_o_totalprice")}
    return dml.merge(_orders(s, d), _source(s, d), ["o_orderkey"], sets, delete_unmatched=F.col("o_orderkey") % 3 == 0)


@query(f"""WITH src AS ({_SRC}), tgt AS ({_OLD})
          SELECT CASE WHEN t.o_orderkey IS NULL THEN 'INSERT' WHEN s.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action, coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, t.o_orderstatus AS before_status, CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderstatus END AS after_status
          FROM tgt t FULL OUTER JOIN src s ON t.o_orderkey = s.o_orderkey WHERE s.o_orderkey IS NOT NULL OR t.o_orderkey % 3 = 0""")
def merge_output(s, d):
    sets = {"o_orderstatus": F.col("s_o_orderstatus")}
    out = dml.merge(_orders(s, d), _source(s, d), ["o_orderkey"], sets, delete_unmatched=F.col("o_orderkey") % 3 == 0, output=True)
    return out.select("action", "o_orderkey", F.col("before_o_orderstatus").alias("before_status"), F.col("after_o_orderstatus").alias("after_status"))


@query("SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY 1")
def temp_stage_report(s, d):
    """SELECT INTO #temp, then a report on it: a temporary view."""
    _orders(s, d).filter("o_orderstatus <> 'P'").createOrReplaceTempView("staged_orders")
    j = s.table("staged_orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("n"), total("o_totalprice").alias("spent"))


@query("SELECT e.event_id, m.k + row_number() OVER (ORDER BY e.event_id) AS o_orderkey FROM events e, (SELECT max(o_orderkey) AS k FROM orders) m WHERE event_type = 'purchase'")
def identity_assign(s, d):
    new = t(s, d, "events", "event_id", "event_type").filter("event_type = 'purchase'").select("event_id")
    return dml.identity_assign(new, t(s, d, "orders", "o_orderkey"), "o_orderkey", [F.col("event_id")]).select("event_id", F.col("o_orderkey").cast("long").alias("o_orderkey"))


@query(f"""WITH b AS ({_OLD}), a AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL {_NEW})
          SELECT CASE WHEN b.o_orderkey IS NULL THEN 'INSERT' WHEN a.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation, coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, b.o_orderstatus AS old_status, a.o_orderstatus AS new_status
          FROM b FULL OUTER JOIN a ON a.o_orderkey = b.o_orderkey WHERE b.o_orderkey IS NULL OR a.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus""")
def audit_diff(s, d):
    before, k = _orders(s, d), F.col("o_orderkey")
    after = before.filter(k % 7 != 0).withColumn("o_orderstatus", F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    new = before.filter(k % 10 == 0).withColumns({"o_orderkey": k + 10000000, "o_orderstatus": F.lit("N")})
    out = dml.audit_diff(before, after.unionByName(new), ["o_orderkey"])
    return out.select("operation", "o_orderkey", F.col("old.o_orderstatus").alias("old_status"), F.col("new.o_orderstatus").alias("new_status"))


@query("""SELECT c_custkey, c_acctbal + coalesce(d, 0) AS c_acctbal FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal FROM customer)
          LEFT JOIN (SELECT o_custkey, sum(CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS d FROM orders GROUP BY 1) ON o_custkey = c_custkey""".replace("c_acctbal + coalesce(d, 0) AS", "CAST(c_acctbal + coalesce(d, 0) AS DOUBLE) AS"))
def budget_rollup(s, d):
    """Trigger-style derived update: deltas of changed rows, summed by group, added to the parent."""
    delta = t(s, d, "orders").filter("o_orderkey % 5 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(money("o_totalprice")).alias("delta"))
    out = dml.update_from(t(s, d, "customer").select("c_custkey", money("c_acctbal").alias("c_acctbal")), delta, ["c_custkey"], {"c_acctbal": F.col("c_acctbal") + F.col("s_delta")})
    return out.select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))


_HISTORY = "SELECT event_id, user_id, value, ts AS sys_start, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '9999-12-31') AS sys_end FROM events"


def _history(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(s, d, "events").select("event_id", "user_id", "value", F.col("ts").alias("sys_start"), F.coalesce(F.lead("ts").over(w), F.expr("timestamp'9999-12-31'").cast(t(s, d, "events").schema["ts"].dataType)).alias("sys_end"))


@query(f"SELECT user_id, count(*) AS versions, max(sys_start) AS newest FROM ({_HISTORY}) GROUP BY 1")
def temporal_all(s, d):
    return _history(s, d).groupBy("user_id").agg(F.count("*").alias("versions"), F.max("sys_start").alias("newest"))


@query(f"SELECT user_id, event_id, value FROM ({_HISTORY}) WHERE sys_start <= TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-10' < sys_end")
def temporal_as_of(s, d):
    return dml.temporal_as_of(_history(s, d), F.expr("timestamp'2024-01-10'")).select("user_id", "event_id", "value")


#: Changes that come late and out of order: some at the very start of a version, some inside old periods, some twice at one time, some that end what holds, some of unknown keys.
_CHANGES = """SELECT user_id + CASE WHEN event_id % 101 = 0 THEN 1000000 ELSE 0 END AS user_id, -event_id AS event_id, value + 1 AS value, (event_id * 7919) % 1000003 AS seq, event_id % 9 = 4 AS deleted,
    CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 3 HOUR WHEN 2 THEN date_trunc('day', ts) ELSE ts + INTERVAL 90 DAY END AS "at" FROM events WHERE event_id % 3 = 0"""


@query(f"""WITH h AS ({_HISTORY}), h2 AS (SELECT * FROM h WHERE sys_start < sys_end), c AS ({_CHANGES}),
          p AS (SELECT user_id, "at", event_id, value, deleted, 2 AS kind, seq FROM c UNION ALL SELECT user_id, sys_start, event_id, value, false, 1, 0 FROM h2 UNION ALL SELECT user_id, sys_end, event_id, value, true, 0, 0 FROM h2),
          l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY user_id, "at" ORDER BY kind DESC, seq DESC) = 1),
          r AS (SELECT l.user_id, l."at" AS sys_start, l.event_id, l.value, l.deleted, (SELECT min(q."at") FROM l q WHERE q.user_id = l.user_id AND q."at" > l."at") AS sys_end FROM l)
          SELECT user_id, event_id, value, sys_start, coalesce(sys_end, TIMESTAMP '9999-12-31') AS sys_end FROM r WHERE NOT deleted""")
def temporal_update(s, d):
    """A year's versions, spliced with changes that arrive out of order."""
    k = F.col("event_id")
    at = F.when(k % 4 == 0, F.col("ts")).when(k % 4 == 1, F.col("ts") - F.expr("interval 3 hours")).when(k % 4 == 2, F.date_trunc("day", "ts").cast(t(s, d, "events").schema["ts"].dataType)).otherwise(F.col("ts") + F.expr("interval 90 days"))
    user = F.col("user_id") + F.when(k % 101 == 0, 1000000).otherwise(0)
    changes = t(s, d, "events").filter(k % 3 == 0).select(user.alias("user_id"), (-k).alias("event_id"), (F.col("value") + 1).alias("value"), (k * 7919 % 1000003).alias("seq"), (k % 9 == 4).alias("deleted"), at.alias("at"))
    return dml.versioned_update(_history(s, d).filter("sys_start < sys_end"), changes, ["user_id"], "at", "seq", "deleted")


@query("SELECT 1 + CASE WHEN o_orderdate >= TIMESTAMP '1994-01-01' THEN 1 ELSE 0 END + CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN 1 ELSE 0 END AS part, count(*) AS n FROM orders GROUP BY 1")
def range_partition_counts(s, d):
    part = dml.range_partition(F.col("o_orderdate"), [F.expr(f"timestamp'{y}-01-01'") for y in (1994, 1996)])
    return t(s, d, "orders").groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE'))")
def row_filter_by_region(s, d):
    allowed = t(s, d, "region").filter(F.col("r_name").isin("ASIA", "EUROPE")).select(F.col("r_regionkey").alias("n_regionkey"))
    c = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return dml.row_filter(c, allowed, ["n_regionkey"]).select("c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT s_suppkey + 1000000, s_acctbal FROM supplier")
def tvp_batch_insert(s, d):
    """Two batches: one passes its checks, of the other every row is refused because some fail."""
    c = t(s, d, "customer", "c_custkey", "c_acctbal")
    good = t(s, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    bad = t(s, d, "supplier").select(F.when(F.col("s_suppkey") > 1, F.col("s_suppkey")).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    checks = {"key": F.col("c_custkey").isNotNull()}
    return dml.batch_insert(dml.batch_insert(c, good, checks), bad, checks)


_RAISED = """(SELECT c_custkey, c_acctbal, c_nationkey, CASE WHEN c_acctbal > 0 THEN least(c_acctbal * 1.1, coalesce(budget / heads, c_acctbal * 1.1)) ELSE c_acctbal END AS raised
          FROM customer JOIN (SELECT c_nationkey, count(*) AS heads FROM customer GROUP BY 1) h USING (c_nationkey) LEFT JOIN (SELECT n_nationkey AS c_nationkey, n_nationkey * 20000.0 AS budget FROM nation WHERE n_nationkey <> 3) b USING (c_nationkey))"""


def _adjusted(s, d):
    """A tenth more for each customer, capped by its nation's budget; nation 3 has none."""
    c = t(s, d, "customer", "c_custkey", "c_acctbal", "c_nationkey").withColumn("c_acctbal", F.col("c_acctbal").cast("double"))
    n = t(s, d, "nation").filter("n_nationkey != 3").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") * 20000.0).alias("budget"))
    return dml.capped_adjustment(c, n, "c_custkey", "c_nationkey", "c_acctbal", "budget", 10.0)


@query(f"SELECT c_custkey, round(CAST(raised AS DOUBLE), 4) AS c_acctbal FROM {_RAISED}")
def capped_adjustment(s, d):
    return _adjusted(s, d)[0].select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


@query(f"SELECT c_custkey, round(CAST(c_acctbal AS DOUBLE), 4) AS old_amount, round(CAST(raised AS DOUBLE), 4) AS new_amount, 'Annual adjustment 10.00%' AS reason FROM {_RAISED} WHERE c_acctbal > 0")
def adjustment_history(s, d):
    return _adjusted(s, d)[1].select("c_custkey", F.round("old_amount", 4).alias("old_amount"), F.round("new_amount", 4).alias("new_amount"), "reason")


def _drained(s, d):
    e = t(s, d, "events")
    q = e.select("event_id", (F.col("user_id") * 7).alias("c_custkey"), "value", F.when(F.col("event_type") == "view", "Completed").otherwise("Pending").alias("status"))
    return dml.queue_drain(q, t(s, d, "customer"), "event_id", "c_custkey", 200, [F.desc("value"), F.asc("event_id")])


_FIRST = "(SELECT e.event_id, c_custkey FROM (SELECT event_id, user_id * 7 AS k FROM events WHERE event_type <> 'view' ORDER BY value DESC, event_id LIMIT 200) e LEFT JOIN customer ON c_custkey = k)"


@query(f"SELECT event_id, CASE WHEN c_custkey IS NULL THEN 'Failed' ELSE 'Completed' END AS result FROM {_FIRST}")
def queue_drain(s, d):
    return _drained(s, d)[0].select("event_id", "result")


@query(f"SELECT e.event_id, CASE WHEN e.event_type = 'view' THEN 'Completed' WHEN f.event_id IS NULL THEN 'Pending' WHEN c_custkey IS NULL THEN 'Failed' ELSE 'Completed' END AS status FROM events e LEFT JOIN {_FIRST} f USING (event_id)")
def queue_after(s, d):
    return _drained(s, d)[1].select("event_id", "status")


@query(f"SELECT event_id, 'Queue item ' || event_id || ': Employee not found for queue item' AS message FROM {_FIRST} WHERE c_custkey IS NULL")
def queue_errors(s, d):
    return _drained(s, d)[2]


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1994-06-01' AND o_orderdate < TIMESTAMP '1995-06-01'")
def range_partition_read(s, d):
    """Orders written by date range and read again: files of the one range that can hold such dates."""
    from datetime import datetime

    path = f"{shared_folder(s)}/ferryline/{uuid.uuid4().hex}"
    years = [datetime(y, 1, 1) for y in (1994, 1996)]
    dml.write_partitioned(t(s, d, "orders", "o_orderkey", "o_orderdate"), path, "o_orderdate", [F.lit(y) for y in years])
    return dml.read_between(s.read.parquet(path), "o_orderdate", datetime(1994, 6, 1), datetime(1995, 6, 1), years).select("o_orderkey", "o_orderdate")
