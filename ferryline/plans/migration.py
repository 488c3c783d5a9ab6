"""Copying, ordering and reconciling the supplied tables as if they were a database on the move."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferryline.operators import casts
from ferryline.operators import migrate as M
from ferryline.plans.common import sql_values, t, values
from ferryline.registry import query
from ferryline.sources import tables as S


@query("SELECT p_partkey AS node, CASE WHEN p_partkey = 0 THEN 0 ELSE CAST(floor(log2(greatest(p_partkey, 1))) AS INTEGER) + 1 END AS wave FROM part")
def dependency_waves(s, d):
    """Part k needs part k div 2: waves follow the tree's levels."""
    k = F.col("p_partkey")
    p = t(s, d, "part", "p_partkey")
    return M.dependency_waves(p.select(k.alias("node")), p.select(k.alias("src"), F.floor(k / 2).alias("dst")))


@query("SELECT p_partkey AS node, p_partkey % 10 = 9 AS self_loop FROM part WHERE p_partkey % 10 IN (1, 2, 3, 4, 5, 9) AND p_partkey - p_partkey % 10 + 5 <= (SELECT max(p_partkey) FROM part)")
def dependency_cycles(s, d):
    """In each ten of parts: 1-2 and 3-4-5 are cycles, 2 leads to 6 and 6 to 3 between them, 7 and 8 hang on, 9 needs itself."""
    p = t(s, d, "part", "p_partkey")
    top = F.broadcast(p.agg(F.max("p_partkey").alias("top")))  # one row
    tens = p.crossJoin(top).filter("p_partkey % 10 in (1, 2, 3, 4, 5, 9) and p_partkey - p_partkey % 10 + 5 <= top").select((F.col("p_partkey") - F.col("p_partkey") % 10).alias("t")).distinct()
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in [(1, 2), (2, 1), (3, 4), (4, 5), (5, 3), (2, 6), (6, 3), (7, 8), (9, 9)]])
    e = tens.select("t", F.explode(steps).alias("x")).select((F.col("t") + F.col("x.a")).alias("src"), (F.col("t") + F.col("x.b")).alias("dst"))
    return M.cycle_members(e).join(p, F.col("node") == F.col("p_partkey"), "left_semi")


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'public' ELSE 'sales' END AS target_schema FROM nation")
def rename_target(s, d):
    n = t(s, d, "nation").select(F.col("n_nationkey").alias("N_NationKey"), F.col("n_name").alias("N_Name"), F.when(F.col("n_nationkey") % 2 == 0, "dbo").otherwise("Sales").alias("Target_Schema"))
    return M.rename_target(n).withColumn("target_schema", M.target_schema(F.col("target_schema")))


_TYPES = [(i, *r) for i, r in enumerate(M.TYPE_MAP)]


@query(f"""WITH m AS (SELECT * FROM {sql_values(_TYPES, 'i, source_type, mapped, review')}), c AS (SELECT p_partkey AS column_id, source_type AS data_type, mapped, review, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 10 + p_size % 5 END AS prec, CASE WHEN p_partkey % 2 = 0 THEN p_size % 9 END AS scale,
          CASE WHEN p_partkey % 5 = 0 THEN -1 WHEN p_partkey % 5 = 1 THEN NULL ELSE p_size END AS max_length FROM part JOIN m ON i = p_partkey % {len(_TYPES)})
          SELECT column_id, data_type, CASE WHEN mapped = 'numeric' AND prec IS NOT NULL THEN 'numeric(' || prec || ',' || coalesce(scale, 0) || ')' WHEN mapped IN ('varchar', 'char') AND max_length < 0 THEN 'text'
          WHEN mapped IN ('varchar', 'char') AND max_length IS NOT NULL THEN mapped || '(' || max_length || ')' WHEN mapped IN ('timestamp', 'time') AND scale IS NOT NULL THEN mapped || '(' || least(scale, 6) || ')' ELSE mapped END AS target_type,
          review AS needs_review, CASE WHEN data_type = 'tinyint' THEN 'between 0 and 255' END AS extra_check FROM c""")
def type_map_columns(s, d):
    """A column catalog derived from part: one column for each part, all source types in turn."""
    kinds = values(s, _TYPES, "i int, source_type string, mapped string, review boolean")
    k, z = F.col("p_partkey"), F.col("p_size")
    p = t(s, d, "part").select(k.alias("column_id"), (k % len(_TYPES)).alias("i"), F.when(k % 3 != 0, 10 + z % 5).alias("prec"), F.when(k % 2 == 0, z % 9).alias("scale"), F.when(k % 5 == 0, -1).when(k % 5 != 1, z).alias("max_length"))
    c = p.join(F.broadcast(kinds.select("i", F.col("source_type").alias("data_type"))), "i").drop("i")
    return M.convert_types(c, kinds.drop("i")).select("column_id", "data_type", "target_type", "needs_review", "extra_check")


@query("SELECT 'orders' AS table_name, max(o_orderkey) + 1 AS next_value FROM orders UNION ALL SELECT 'part', max(p_partkey) + 1 FROM part UNION ALL SELECT 'none', 1")
def reseed_values(s, d):
    o, p = t(s, d, "orders"), t(s, d, "part")
    row = lambda name, df: df.select(F.lit(name).alias("table_name"), "next_value")
    return row("orders", M.reseed(o, "o_orderkey")).union(row("part", M.reseed(p, "p_partkey"))).union(row("none", M.reseed(p.filter("p_partkey < 0"), "p_partkey")))


@query("SELECT name AS table_name, a AS n_source, b AS n_target, b - a AS delta, a = b AS equal FROM (SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM orders WHERE o_orderkey % 9 <> 0) AS b UNION ALL SELECT 'part', (SELECT count(*) FROM part), (SELECT count(*) FROM part))")
def reconcile_counts(s, d):
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
    o, p = t(s, d, "orders", "o_orderkey"), t(s, d, "part", "p_partkey")
    return M.reconcile_counts(n("orders", o).union(n("part", p)), n("orders", o.filter("o_orderkey % 9 != 0")).union(n("part", p)))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'missing' ELSE 'changed' END AS difference FROM orders WHERE o_orderkey % 9 = 0 OR (o_orderkey % 10 = 0 AND o_orderstatus <> 'Z')
          UNION ALL SELECT o_orderkey + 10000000, 'extra' FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 9 <> 0""")
def reconcile_content(s, d):
    o, k = t(s, d, "orders"), F.col("o_orderkey")
    kept = o.filter(k % 9 != 0)
    changed = kept.withColumn("o_orderstatus", F.when(k % 10 == 0, "Z").otherwise(F.col("o_orderstatus")))
    return M.reconcile_content(o, changed.unionByName(kept.filter(k % 11 == 0).withColumn("o_orderkey", k + 10000000)), ["o_orderkey"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 900 = 0 THEN 'missing' ELSE 'changed' END AS difference FROM orders WHERE o_orderkey % 900 = 0 OR (o_orderkey % 1000 = 0 AND o_orderstatus <> 'Z')
          UNION ALL SELECT o_orderkey + 10000000, 'extra' FROM orders WHERE o_orderkey % 1100 = 0 AND o_orderkey % 900 <> 0""")
def reconcile_tree(s, d):
    """One row in some hundreds differs: the hash tree finds where."""
    o, k = t(s, d, "orders"), F.col("o_orderkey")
    kept = o.filter(k % 900 != 0)
    changed = kept.withColumn("o_orderstatus", F.when(k % 1000 == 0, "Z").otherwise(F.col("o_orderstatus")))
    return M.reconcile_by_tree(o, changed.unionByName(kept.filter(k % 1100 == 0).withColumn("o_orderkey", k + 10000000)), ["o_orderkey"])


def _texts(s, d):
    """Orders as text, as an export would have them, with values here and there that no longer fit."""
    k = F.col("o_orderkey")
    text = lambda c, odd: F.when(k % odd[0] == 0, odd[1]).otherwise(F.col(c).cast("string"))
    o = t(s, d, "orders")
    return o.select(k, text("o_custkey", (13, "12.5")).alias("cust"), text("o_totalprice", (17, "n/a")).alias("price"), text("o_orderdate", (19, "2024-02-30 00:00:00")).alias("placed"), F.when(k % 23 == 0, "FINISHED").when(k % 29 != 0, F.col("o_orderstatus")).alias("status"), (k % 300).cast("string").alias("tiny"))


_PLAN = [("cust", "integer", None), ("price", "numeric(12,2)", None), ("placed", "timestamp(0)", None), ("status", "varchar(4)", None), ("tiny", "smallint", "between 0 and 255")]


@query("""SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS cust, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS price, date_trunc('second', o_orderdate) AS placed, CASE WHEN o_orderkey % 29 <> 0 THEN o_orderstatus END AS status, CAST(o_orderkey % 300 AS SMALLINT) AS tiny
          FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AND o_orderkey % 23 <> 0 AND o_orderkey % 300 <= 255""")
def cast_kept(s, d):
    kept, _ = casts.convert_table(_texts(s, d), _PLAN, ["o_orderkey"])
    return kept.withColumn("price", F.col("price").cast("double"))


@query("""SELECT o_orderkey, v.* FROM orders, (VALUES ('cust', '12.5', 'no integer', 13), ('price', 'n/a', 'no numeric(12,2)', 17), ('placed', '2024-02-30 00:00:00', 'no timestamp(0)', 19), ('status', 'FINISHED', 'longer than 4', 23)) t(c, x, r, m), LATERAL (SELECT c AS "column", x AS value, r AS reason) v WHERE o_orderkey % m = 0
          UNION ALL SELECT o_orderkey, 'tiny', CAST(o_orderkey % 300 AS VARCHAR), 'not between 0 and 255' FROM orders WHERE o_orderkey % 300 > 255""")
def cast_set_aside(s, d):
    return casts.convert_table(_texts(s, d), _PLAN, ["o_orderkey"])[1]


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)")
def fk_orphans(s, d):
    parents = t(s, d, "customer", "c_custkey").filter("c_custkey % 4 != 0")
    return M.fk_orphans(t(s, d, "orders", "o_orderkey", "o_custkey"), parents, {"o_custkey": "c_custkey"}).select("o_orderkey", "o_custkey")


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def unique_breaches(s, d):
    return M.unique_breaches(t(s, d, "part"), ["p_brand", "p_size"])


@query("SELECT c_custkey, 'balance' AS rule FROM customer WHERE NOT c_acctbal >= 0 UNION ALL SELECT c_custkey, 'nation' FROM customer WHERE NOT c_nationkey < 20")
def check_breaches(s, d):
    return M.check_breaches(t(s, d, "customer"), {"balance": F.col("c_acctbal") >= 0, "nation": F.col("c_nationkey") < 20}).select("c_custkey", "rule")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def copy_roundtrip(s, d):
    """Written out and read back."""
    return M.written(t(s, d, "supplier"))


@query("SELECT p_partkey, CAST(i - 1 AS INTEGER) AS no, 'select ' || i || ' from ' || p_brand AS batch FROM part, (VALUES (1), (2), (3)) v(i) WHERE i <> 2")
def ddl_split_batches(s, d):
    b = F.col("p_brand")
    script = F.concat(F.lit("select 1 from "), b, F.lit("\nGO\n  \n go \r\nselect 3 from "), b, F.lit("\n"))
    return S.split_batches(t(s, d, "part").select(F.col("p_partkey"), script.alias("text")), "p_partkey").select("p_partkey", "no", "batch")


@query("SELECT l_orderkey AS object_id, string_agg('c' || l_partkey, ',' ORDER BY l_linenumber, 'c' || l_partkey) AS columns FROM lineitem GROUP BY 1")
def catalog_index_fold(s, d):
    li = t(s, d, "lineitem").select(F.col("l_orderkey").alias("object_id"), "l_linenumber", F.concat(F.lit("c"), "l_partkey").alias("column_name"))
    return S.fold_columns(li, ["object_id"], "l_linenumber", "column_name", "columns").withColumn("columns", F.array_join("columns", ","))


@query("SELECT l_orderkey AS fk_id, l_suppkey AS parent_id, string_agg('k' || l_linenumber, ',' ORDER BY l_linenumber) AS key_columns FROM lineitem GROUP BY 1, 2")
def catalog_fk_fold(s, d):
    li = t(s, d, "lineitem").select(F.col("l_orderkey").alias("fk_id"), F.col("l_suppkey").alias("parent_id"), "l_linenumber", F.concat(F.lit("k"), "l_linenumber").alias("c"))
    return S.fold_columns(li, ["fk_id", "parent_id"], "l_linenumber", "c", "key_columns").withColumn("key_columns", F.array_join("key_columns", ","))


@query("""SELECT DISTINCT event_id % 500 AS query_id, 'select ' || (event_id % 500) AS sql_text, '0x' || upper(lpad(to_hex(event_id % 500), 4, '0')) AS query_hash, event_id AS plan_id, 1 + event_id % 7 AS executions, round(value * 10) / 1000 AS avg_duration_ms FROM events""")
def workload_store(s, d):
    e = t(s, d, "events")
    q = F.col("event_id") % 500
    texts = e.select(q.alias("text_id"), F.concat(F.lit("select "), q).alias("sql_text")).distinct()
    queries = e.select(q.alias("text_id"), q.alias("query_id"), F.unhex(F.lpad(F.hex(q), 4, "0")).alias("query_hash")).distinct()
    plans = e.select(q.alias("query_id"), F.col("event_id").alias("plan_id"))
    stats = e.select(F.col("event_id").alias("plan_id"), (1 + F.col("event_id") % 7).alias("executions"), F.round(F.col("value") * 10).alias("duration_us"), F.lit(0).alias("cpu_us"), F.lit(0).alias("logical_reads"))
    return S.workload_store(texts, queries, plans, stats).select("query_id", "sql_text", "query_hash", "plan_id", "executions", "avg_duration_ms")


@query("""SELECT 'rpc_completed' AS event_name, 'select ' || event_id AS sql_text, event_id * 3 AS duration_us, 'db' || user_id AS database_name, CASE WHEN event_id % 4 = 0 THEN '@a:int=' || event_id || ';@p1:unknown=' || repeat('x', 4000) ELSE '' END AS params FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0""")
def events_xml_shred(s, d):
    """Events of other kinds or without text go; of two durations the later counts; the second parameter has no name, no type and too long a value."""
    k = F.col("event_id")
    name = F.when(k % 3 == 0, "wait_info").otherwise("rpc_completed")
    text = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("<data name='statement'><value>select "), k, F.lit("</value></data>")))
    call = F.when(k % 4 == 0, F.concat(F.lit("<data name='parameters'><value><parameter name='@a' type='int'>"), k, F.lit(f"</parameter><parameter>{'x' * 4010}</parameter></value></data>"))).otherwise("")
    doc = F.concat(F.lit("<event name='"), name, F.lit("' timestamp='2024-01-01T00:00:00Z'>"), text, F.lit("<data name='duration'><value>1</value></data><data name='duration'><value>"), k * 3, F.lit("</value></data>"), call, F.lit("<action name='database_name'><value>db"), F.col("user_id"), F.lit("</value></action></event>"))
    shown = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(":"), p["type"], F.lit("="), p["value"])), ";")
    return S.shred_events(t(s, d, "events").select(doc.alias("event_xml"))).select("event_name", "sql_text", "duration_us", "database_name", shown.alias("params"))


def _catalog(s, d):
    """A catalog of parts: a table for each, system ones too, with features by their number."""
    k = F.col("p_partkey")
    p = t(s, d, "part", "p_partkey")
    schema = F.when(k % 10 == 0, "sys").otherwise("dbo")
    tables = p.select(schema.alias("schema_name"), F.concat(F.lit("t"), k).alias("table_name"), (k % 7 == 0).cast("int").alias("is_tracked_by_cdc"), (k % 3).alias("filestream_data_space_id"), (k % 2).alias("temporal_type"), (k % 11 == 0).cast("int").alias("is_memory_optimized"))
    columns = p.select(schema.alias("schema_name"), F.concat(F.lit("t"), k).alias("table_name"), F.explode(F.array(F.lit(2), F.lit(1))).alias("ordinal")).select("*", F.concat(F.lit("c"), "ordinal").alias("column_name"), F.lit("int").alias("data_type"), (F.col("ordinal") == 2).alias("is_nullable"))
    modules = p.select(schema.alias("schema_name"), F.concat(F.lit("p"), k).alias("object_name"), F.lit("procedure").alias("object_type"), F.lit("body").alias("body"), (k % 13 == 0).cast("int").alias("uses_native_compilation"))
    assemblies = p.select((k % 5 == 0).cast("int").alias("is_user_defined"))
    services = p.select(F.concat(F.when(k % 2 == 0, "http://").otherwise("s"), k).alias("name"))
    return {"tables": tables, "columns": columns, "modules": modules, "assemblies": assemblies, "services": services, "change_tracking_tables": p.filter("p_partkey % 9 = 0"), "xml_indexes": p.filter("false")}


@query("""SELECT * FROM (SELECT 0 AS ordinal, 'SQL CLR' AS category, count(*) FILTER (WHERE p_partkey % 5 = 0) AS n, true AS accessible FROM part UNION ALL SELECT 1, 'Service Broker', count(*) FILTER (WHERE p_partkey % 2 = 1), false FROM part UNION ALL SELECT 2, 'Agent Jobs', 0, false UNION ALL SELECT 3, 'CDC', count(*) FILTER (WHERE p_partkey % 7 = 0), true FROM part
          UNION ALL SELECT 4, 'Change Tracking', count(*) FILTER (WHERE p_partkey % 9 = 0), true FROM part UNION ALL SELECT 5, 'Replication', 0, false UNION ALL SELECT 6, 'Linked Servers', 0, false UNION ALL SELECT 7, 'Full Text Search', 0, false UNION ALL SELECT 8, 'FileStream', count(*) FILTER (WHERE p_partkey % 3 <> 0), false FROM part
          UNION ALL SELECT 9, 'XML Indexes', 0, true UNION ALL SELECT 10, 'Temporal Tables', count(*) FILTER (WHERE p_partkey % 2 <> 0), true FROM part UNION ALL SELECT 11, 'Memory Optimized', count(*) FILTER (WHERE p_partkey % 11 = 0) + count(*) FILTER (WHERE p_partkey % 13 = 0), true FROM part UNION ALL SELECT 12, 'Partitioning', 0, false)""")
def server_feature_counts(s, d):
    return S.feature_counts(s, _catalog(s, d))


@query("SELECT 't' || p_partkey AS table_name, 'c1:false,c2:true' AS columns FROM part WHERE p_partkey % 10 <> 0")
def catalog_tables(s, d):
    shown = F.array_join(F.transform("columns", lambda c: F.concat(c["column_name"], F.lit(":"), c["is_nullable"].cast("string"))), ",")
    return S.read_catalog(_catalog(s, d))["tables"].select("table_name", shown.alias("columns"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'EXEC p @a = ''' || user_id || ''', @b = ''' || event_type || '''' ELSE 'exec p long statement text that says more than its parameters do' END AS sql_text, CAST(1 AS BIGINT) AS execution_count FROM events")
def captured_statements(s, d):
    e = t(s, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "exec p").otherwise("exec p long statement text that says more than its parameters do").alias("sql_text"), F.lit("p").alias("proc_name"), F.array(F.struct(F.lit("@a").alias("name"), F.col("user_id").cast("string").alias("value")), F.struct(F.lit("@b").alias("name"), F.col("event_type").alias("value"))).alias("params"))
    return S.captured(e).select("event_id", "sql_text", "execution_count")
