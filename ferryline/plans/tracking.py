"""Validation of object results derived from parts, and request telemetry derived from events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferryline.operators import validate as V
from ferryline.plans.common import sql_values, t, values
from ferryline.registry import query
from ferryline.streaming import telemetry as X

_TYPES = ["table", "view", "function", "procedure", "trigger"]
_MESSAGES = ["empty body", 'type "money2" does not exist', "function f(int) does not exist", "syntax error at or near BEGIN", 'relation "t" does not exist', "strange"]


def results(s, d, run: int):
    k = F.col("p_partkey")
    pick = lambda words, x: F.element_at(F.array(*[F.lit(w) for w in words]), (x % len(words) + 1).cast("int"))
    status = F.when(k % 6 == 5, "skip").when((k * run) % 7 < 2, "fail-syntax").when((k + run) % 11 == 0, "fail-convert").otherwise("pass")
    return t(s, d, "part").select(F.concat(F.lit("db"), k % 6).alias("database_name"), F.concat(F.lit("o"), k).alias("object_name"), pick(_TYPES, F.floor(k / 6)).alias("object_type"), status.alias("status"), F.when(status.startswith("fail"), pick(_MESSAGES, F.floor(k / 7))).alias("error_message"), F.sha2((k % (50 + run)).cast("string"), 256).alias("sha"))


def _sql(run: int) -> str:
    pick = lambda words, x: "CASE CAST(" + x + f" % {len(words)} AS INTEGER) " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"
    st = f"CASE WHEN p_partkey % 6 = 5 THEN 'skip' WHEN (p_partkey * {run}) % 7 < 2 THEN 'fail-syntax' WHEN (p_partkey + {run}) % 11 = 0 THEN 'fail-convert' ELSE 'pass' END"
    return f"(SELECT 'db' || (p_partkey % 6) AS database_name, 'o' || p_partkey AS object_name, {pick(_TYPES, 'floor(p_partkey / 6)')} AS object_type, {st} AS status, CASE WHEN {st} LIKE 'fail%' THEN {pick(_MESSAGES, 'floor(p_partkey / 7)')} END AS error_message, sha256(CAST(p_partkey % {50 + run} AS VARCHAR)) AS sha FROM part)"


def _score(run: int, *by: str) -> str:
    cols = "".join(f"{b}, " for b in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    n = "count(*) FILTER (WHERE status <> 'skip')"
    return f"SELECT {cols}count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status LIKE 'fail%') AS failed, count(*) FILTER (WHERE status = 'skip') AS skipped, CASE WHEN {n} > 0 THEN round_even(100.0 * count(*) FILTER (WHERE status = 'pass') / {n}, 1) END AS score FROM {_sql(run)}{group}"


@query(_score(1, "database_name"))
def compat_score(s, d):
    """Per database; db5 has only skips, so no score."""
    return V.compat_score(results(s, d, 1), "database_name")


@query(_score(1, "database_name", "object_type"))
def score_by_type(s, d):
    return V.compat_score(results(s, d, 1), "database_name", "object_type")


@query(f"SELECT a.database_name, a.score, b.score AS previous, round_even(a.score - b.score, 1) AS delta FROM ({_score(2, 'database_name')}) a LEFT JOIN ({_score(1, 'database_name')}) b USING (database_name)")
def score_delta(s, d):
    return V.score_delta(V.compat_score(results(s, d, 2), "database_name"), V.compat_score(results(s, d, 1), "database_name"), "database_name")


@query(f"SELECT object_type, count(*) AS n FROM {_sql(1)} WHERE status LIKE 'fail%' AND (SELECT score FROM ({_score(1)})) < 70 GROUP BY 1 ORDER BY n DESC, object_type LIMIT 5")
def top_failing_types(s, d):
    r = results(s, d, 1)
    overall = F.broadcast(V.compat_score(r).select("score"))  # one row
    bad = r.filter(F.col("status").startswith("fail")).groupBy("object_type").agg(F.count("*").alias("n"))
    return bad.crossJoin(overall).filter("score < 70").drop("score").orderBy(F.desc("n"), "object_type").limit(5)


_CAUSE = "CASE error_message WHEN 'empty body' THEN 'prompt deficiency' WHEN 'type \"money2\" does not exist' THEN 'type mapping gap' WHEN 'function f(int) does not exist' THEN 'function mapping gap' WHEN 'relation \"t\" does not exist' THEN 'dependency resolution failure' ELSE 'procedural pattern not handled' END"


@query(f"""WITH f AS (SELECT object_name, {_CAUSE} AS category FROM {_sql(1)} WHERE status LIKE 'fail%'), c AS (SELECT category, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, category) AS INTEGER) AS rank FROM f GROUP BY 1)
          SELECT object_name, category, n, rank FROM f JOIN c USING (category)""")
def root_cause(s, d):
    return V.ranked_causes(results(s, d, 1).filter(F.col("status").startswith("fail")))


@query(f"SELECT a.object_name, CASE WHEN a.status IN ('pass', 'skip') THEN a.status ELSE coalesce(b.status, 'fail-convert') END AS status FROM {_sql(1)} a LEFT JOIN (SELECT * FROM {_sql(3)} WHERE object_type <> 'view') b USING (object_name)")
def rerun_merge(s, d):
    return V.rerun_merge(results(s, d, 1), results(s, d, 3).filter("object_type != 'view'")).select("object_name", "status")


@query(f"""SELECT a.object_name, CASE WHEN b.object_name IS NULL THEN 'new' WHEN b.status LIKE 'fail%' THEN 'failed' ELSE 'changed' END AS reason FROM {_sql(2)} a LEFT JOIN (SELECT * FROM {_sql(1)} WHERE object_type <> 'trigger') b ON b.object_name = a.object_name
          WHERE b.object_name IS NULL OR (b.status <> 'skip' AND (b.status LIKE 'fail%' OR a.sha <> b.sha))""")
def changed_objects(s, d):
    before = results(s, d, 1).filter("object_type != 'trigger'").withColumn("status", F.when(F.col("status").startswith("fail"), "failed").when(F.col("status") == "skip", "reviewed").otherwise("converted")).withColumn("object_name", F.upper("object_name"))
    return V.changed_objects(results(s, d, 2), before).select("object_name", "reason")


@query(f"""WITH r AS (SELECT 'db' || r AS database_name, r = 2 AS broken FROM range(8) x(r)), c AS ({_score(1, 'database_name')})
          SELECT database_name, CASE WHEN broken OR passed IS NULL THEN 0 ELSE passed + failed + skipped END AS objects, CASE WHEN broken OR passed IS NULL THEN 0 ELSE passed END AS passed, CASE WHEN broken OR passed IS NULL THEN 0 ELSE failed END AS failed,
          CASE WHEN NOT broken THEN score END AS score, CASE WHEN broken OR passed IS NULL THEN 'ERROR' WHEN passed + failed = 0 THEN 'N/A' WHEN failed > 0 THEN 'WARN' ELSE 'OK' END AS state FROM r LEFT JOIN c USING (database_name)""")
def batch_summary(s, d):
    """Eight runs: db2 broke off, db6 and db7 left no results."""
    k = F.col("p_partkey") % 8
    runs = t(s, d, "part", "p_partkey").select(F.concat(F.lit("db"), k).alias("database_name"), F.when(k == 2, "connection lost").alias("error")).distinct()
    return V.batch_summary(runs, results(s, d, 1))


@query(f"""WITH r AS (SELECT database_name, count(*) FILTER (WHERE status = 'pass') / CAST(count(*) AS DOUBLE) AS ddl FROM {_sql(1)} GROUP BY 1)
          SELECT database_name, round_even(100 * CASE database_name WHEN 'db1' THEN ddl WHEN 'db2' THEN 0.57 * ddl + 0.43 * 0.9 ELSE 0.4 * ddl + 0.3 * 0.9 + 0.3 * 0.8 END, 1) AS score FROM r""")
def e2e_score(s, d):
    r = results(s, d, 1).groupBy("database_name").agg((F.count_if(F.col("status") == "pass") / F.count("*")).alias("ddl"))
    db = F.col("database_name")
    return r.select("database_name", V.e2e_score(F.col("ddl"), F.when(db != "db1", 0.9), F.when(db != "db2", 0.8)).alias("score"))


def entries(s, d):
    """Conversion results of parts: every fifth is flagged, some have review flags and notes."""
    k = F.col("p_partkey")
    status = F.when(k % 5 == 0, "flagged").when(k % 7 == 0, "failed").when(k % 11 == 0, "reviewed").otherwise("converted")
    note = lambda c, x: F.struct(F.lit(c).alias("category"), x.alias("description"))
    notes = F.array_compact(F.array(F.when(k % 2 == 0, note("types", F.concat(F.lit("kind "), k % 3))), F.when(k % 4 == 0, note("types", F.lit("kind 0"))), F.when(k % 6 == 0, note("dates", F.lit("zone")))))
    pick = F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (k % 5 + 1).cast("int"))
    return t(s, d, "part", "p_partkey").select(F.concat(F.lit("o"), k).alias("object_name"), status.alias("status"), F.when(k % 3 == 0, "rule").otherwise("assisted").alias("method"), pick.alias("object_type"), notes.alias("notes"), F.when(k % 13 == 0, F.array(F.lit("see loop"))).otherwise(F.array().cast("array<string>")).alias("flags"))


_ENTRIES = "(SELECT 'o' || p_partkey AS object_name, p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'flagged' WHEN p_partkey % 7 = 0 THEN 'failed' WHEN p_partkey % 11 = 0 THEN 'reviewed' ELSE 'converted' END AS status, CASE WHEN p_partkey % 3 = 0 THEN 'rule' ELSE 'assisted' END AS method, ['table', 'view', 'function', 'procedure', 'trigger'][p_partkey % 5 + 1] AS object_type FROM part)"


@query(f"""SELECT 'status' AS section, status AS name, CAST(count(*) AS DOUBLE) AS value FROM {_ENTRIES} GROUP BY 2 UNION ALL SELECT 'method', method, count(*) FROM {_ENTRIES} GROUP BY 2 UNION ALL SELECT 'type', object_type, count(*) FROM {_ENTRIES} GROUP BY 2
          UNION ALL SELECT 'summary', 'objects', count(*) FROM {_ENTRIES} UNION ALL SELECT 'summary', 'progress', round_even(100.0 * count(*) FILTER (WHERE status <> 'failed') / count(*), 1) FROM {_ENTRIES}""")
def conversion_summary(s, d):
    return V.conversion_report(entries(s, d))


@query("""SELECT category, description, count(*) AS objects FROM (SELECT p_partkey, 'types' AS category, 'kind ' || (p_partkey % 3) AS description FROM part WHERE p_partkey % 2 = 0 UNION SELECT p_partkey, 'types', 'kind 0' FROM part WHERE p_partkey % 4 = 0 UNION SELECT p_partkey, 'dates', 'zone' FROM part WHERE p_partkey % 6 = 0) GROUP BY 1, 2""")
def conversion_notes(s, d):
    return V.conversion_notes(entries(s, d))


@query(f"SELECT object_name, status FROM {_ENTRIES} WHERE status = 'flagged' OR k % 13 = 0")
def flagged_objects(s, d):
    return V.flagged_objects(entries(s, d)).select("object_name", "status")


@query("SELECT p_partkey, CASE WHEN p_partkey % 97 >= 70 AND p_partkey % 10 <> 3 THEN 'converted' ELSE 'flagged' END AS status, CASE WHEN p_partkey % 10 = 3 THEN 'AI confidence (unknown) is below threshold (0.70)' WHEN p_partkey % 97 < 70 THEN 'AI confidence (' || format('{:.2f}', (p_partkey % 97) / 100.0) || ') is below threshold (0.70)' END AS reason FROM part")
def confidence_flags(s, d):
    k = F.col("p_partkey")
    f = V.confidence_flag(F.when(k % 10 != 3, (k % 97) / F.lit(100.0)))
    return t(s, d, "part", "p_partkey").select("p_partkey", f.alias("f")).select("p_partkey", "f.*")


@query("SELECT 'orders' AS name, CAST(count(*) AS DOUBLE) AS actual, count(*) >= 10 AS passed FROM orders UNION ALL SELECT 'keys', CAST(max(o_orderkey) AS DOUBLE), max(o_orderkey) < 0 FROM orders")
def assertion_results(s, d):
    o = t(s, d, "orders")
    a = V.assertion(o, "rows", ">=", 10).select(F.lit("orders").alias("name"), "actual", "passed")
    return a.union(V.assertion(o.agg(F.max("o_orderkey")), "value", "<", 0).select(F.lit("keys"), "actual", "passed"))


@query("SELECT n_regionkey AS category, round_even(100.0 * count(*) FILTER (WHERE n >= 50) / count(*), 1) AS pass_rate FROM (SELECT n_regionkey, n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1")
def validation_pass_rate(s, d):
    n = t(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    j = t(s, d, "nation").join(n, "n_nationkey", "left")
    return j.groupBy(F.col("n_regionkey").alias("category")).agg(F.bround(100 * F.count_if(F.coalesce("n", F.lit(0)) >= 50) / F.count("*"), 1).alias("pass_rate"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'GETDATE' WHEN 1 THEN 'TOP' WHEN 2 THEN 'bracket' END AS residue, p_partkey % 3 = 0 AS unbalanced FROM part")
def residue_scan(s, d):
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 4 == 0, "select getdate()").when(k % 4 == 1, "SELECT TOP 3 a").when(k % 4 == 2, "select [a]").otherwise("select a"), F.lit(" from t where b = 'it(' and c in (1, 2"), F.when(k % 3 == 0, "").otherwise(")"))
    p = t(s, d, "part").select("p_partkey", text.alias("x"))
    return p.select("p_partkey", V.residue(F.col("x")).alias("residue"), V.unbalanced(F.col("x")).alias("unbalanced"))


@query(f"SELECT object_name, CASE WHEN p_size % 10 = 3 THEN 'rule' WHEN object_type IN ('procedure', 'function', 'trigger') THEN 'assisted' WHEN object_type = 'view' AND p_size % 2 = 0 THEN 'assisted' ELSE 'rule' END AS route FROM {_sql(1)} JOIN part ON object_name = 'o' || p_partkey")
def route_objects(s, d):
    r = results(s, d, 1).join(t(s, d, "part"), F.col("object_name") == F.concat(F.lit("o"), "p_partkey"))
    text = F.when(F.col("p_size") % 2 == 0, "select * from a cross apply f(b)").otherwise("select 1")
    return r.select("object_name", V.route(F.col("object_type"), text, F.when(F.col("p_size") % 10 == 3, "rule")).alias("route"))


#: Scripts and, read off by hand, what is wrong with them and where.
SCRIPTS = [
    ("CREATE TABLE t (a int, b text DEFAULT 'it''s (');", None, None),
    ("create or replace view v as\nselect 1", None, None),
    (" \n ", "DDL statement is empty or null", 1),
    ("CREATE TABLE t (a int\n, b int", "Unbalanced parentheses detected", 2),
    ("CREATE TABLE t (a int)\n)\n;", "Unbalanced parentheses detected", 2),
    ("CREATE VIEW v AS SELECT 'a\nb' AS x,\n'open", "Unclosed string literal detected", 3),
    ("SELECT 1", "DDL does not start with a valid PostgreSQL statement keyword", 1),
    ("CREATE TABLE t (a int);\nGO", "T-SQL batch separator 'GO' detected", 2),
    ("CREATE PROCEDURE p() AS\nSET NOCOUNT ON", "T-SQL 'SET NOCOUNT' detected", 2),
    ("CREATE TABLE t (\na nvarchar(10),\nb datetime)", "T-SQL data type 'NVARCHAR' detected (use VARCHAR in PostgreSQL)", 2),
    ("INSERT INTO t\nSELECT * FROM [a].[b]", "T-SQL bracket-quoted identifier detected", 2),
    ("CREATE TABLE t (a int IDENTITY(1, 1))", "T-SQL IDENTITY column detected (use SERIAL or GENERATED in PostgreSQL)", 1),
    ("DO $$\nDECLARE @x int", "T-SQL variable declaration with '@' prefix detected", 2),
]


@query(f"SELECT p_partkey, message, CAST(line AS INTEGER) AS line FROM part JOIN {sql_values([(i, m, n) for i, (_, m, n) in enumerate(SCRIPTS)], 'i, message, line')} ON i = p_partkey % {len(SCRIPTS)}")
def script_findings(s, d):
    m = F.broadcast(values(s, [(i, x) for i, (x, _, _) in enumerate(SCRIPTS)], "i int, script string"))  # a fixed list of some dozen rows
    p = t(s, d, "part", "p_partkey").withColumn("i", F.col("p_partkey") % len(SCRIPTS)).join(m, "i")
    return p.select("p_partkey", V.script_finding(F.col("script")).alias("f")).select("p_partkey", "f.*")


@query(f"""WITH RECURSIVE o AS (SELECT p_partkey AS k, object_name, CASE object_type WHEN 'table' THEN 0 WHEN 'view' THEN 1 WHEN 'function' THEN 2 WHEN 'procedure' THEN 3 ELSE 4 END AS r FROM {_sql(1)} JOIN part ON object_name = 'o' || p_partkey),
          e AS (SELECT a.k AS src, b.k AS dst FROM o a JOIN o b ON b.k = a.k // 10 WHERE a.k % 3 = 0 AND a.k >= 30), w AS (SELECT k, 0 AS wave FROM o WHERE k NOT IN (SELECT src FROM e) UNION ALL SELECT src, wave + 1 FROM w JOIN e ON dst = k),
          x AS (SELECT object_name, CASE WHEN o.k NOT IN (1, 2) THEN CAST(wave AS INTEGER) END AS wave, r FROM o JOIN w USING (k))
          SELECT object_name, wave, row_number() OVER (ORDER BY wave NULLS LAST, r, object_name) AS place FROM x""")
def apply_order(s, d):
    """Every third part needs that of a tenth of its number; o1 and o2 need each other."""
    k, o = F.col("p_partkey"), lambda c: F.concat(F.lit("o"), c)
    p = t(s, d, "part", "p_partkey")
    depends = p.filter("p_partkey % 3 = 0 and p_partkey >= 30").select(o(k).alias("src"), o(F.floor(k / 10)).alias("dst"))
    return V.apply_order(results(s, d, 1).select("object_name", "object_type"), depends.union(p.filter("p_partkey in (1, 2)").select(o(k), o(3 - k))))


# --- telemetry: the batch twins of the streaming queries ---


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def stream_request_counts(s, d):
    return X.request_counts(t(s, d, "events"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, CASE WHEN value < 1 THEN 1 WHEN value < 5 THEN 5 WHEN value < 10 THEN 10 WHEN value < 50 THEN 50 ELSE 1000000 END AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def stream_latency_buckets(s, d):
    return X.latency_buckets(t(s, d, "events"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, round(avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_ratio FROM events GROUP BY 1")
def stream_hit_ratio(s, d):
    return X.hit_ratio(t(s, d, "events").withColumn("hit", F.col("event_id") % 3 == 0)).withColumn("hit_ratio", F.round("hit_ratio", 6))


@query("SELECT event_id, CAST(sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active FROM events")
def active_sessions(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t(s, d, "events").select("event_id", F.sum(F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)).over(w).alias("active"))


_IDLE = """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE -1 END AS step FROM events),
          g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, step DESC)),
          s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, step DESC ROWS UNBOUNDED PRECEDING) AS spell FROM g),
          o AS (SELECT user_id, spell, list(step ORDER BY ts, step DESC) AS steps, max(ts) AS ts FROM s GROUP BY ALL),
          l AS (SELECT user_id, max(ts) AS ts, arg_max(list_reduce(list_prepend(0::BIGINT, CAST(steps AS BIGINT[])), lambda a, x: greatest(a + x, 0)), ts) AS active FROM o GROUP BY user_id),
          n AS (SELECT *, active > 0 AND ts + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) AS ended FROM l)"""


@query(f"{_IDLE} SELECT user_id, CASE WHEN ended THEN ts + INTERVAL 12 HOUR ELSE ts END AS \"at\", CASE WHEN ended THEN 'expired' ELSE 'update' END AS event, CASE WHEN ended THEN 0 ELSE active END AS active FROM n")
def idle_sessions(s, d):
    """Every third event opens a session, the others close one, if one is open; twelve quiet hours end what is open."""
    e = t(s, d, "events", "user_id", "ts", "event_id").withColumn("ts", F.col("ts").cast("timestamp"))
    return X.idle_sessions(e.withColumn("step", F.when(F.col("event_id") % 3 == 0, 1).otherwise(-1)), idle=12 * 3600)
