"""Operators at sizes and on cases that the queries on small tables don't show."""

import json

import pytest
from pyspark.sql import functions as F

from ferryline.functions import dialect as X_
from ferryline.operators import assess as A
from ferryline.operators import migrate as M
from ferryline.operators import validate as V
from ferryline.operators.relational import numbered, top_percent
from ferryline.sources import tables as S
from ferryline.streaming import telemetry as X

SF = "/root/testdata/sf0.001"


def test_numbers_are_gapless_on_many_rows(spark):
    """Well above what a ranging samples; the second column makes plans of the two uses differ."""
    n = 2_500_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    out = numbered(df, [F.asc("k")], "no", "all")
    got = out.agg(F.count("*").alias("n"), F.count_distinct("no").alias("d"), F.min("no").alias("lo"), F.max("no").alias("hi"), F.max("all").alias("all"), F.count("payload").alias("p")).first()
    assert tuple(got) == (n, n, 1, n, n, n)
    # in order: the numbers ascend with the keys
    from pyspark.sql import Window

    bad = out.repartition(8, F.floor(F.col("no") / 1000)).withColumn("last", F.lag("k").over(Window.partitionBy(F.floor(F.col("no") / 1000)).orderBy("no"))).filter("last >= k")
    assert bad.isEmpty()


def test_top_percent_rounds_up(spark):
    df = spark.range(1001)
    assert sorted(r.id for r in top_percent(df, 1, [F.desc("id")]).collect()) == list(range(990, 1001))
    assert top_percent(df.filter("false"), 10, [F.asc("id")]).count() == 0


def test_content_with_nulls_and_repeated_keys(spark):
    kind = "k int, a string, b string"
    old = [(1, None, "x"), (2, "x", None), (3, "same", None), (None, "n", "n"), (5, "p", "q"), (5, "r", "s"), (6, "once", ""), (7, "gone", "")]
    new = [(1, "x", None), (2, "x", None), (3, "same", None), (None, "n", "n"), (5, "r", "s"), (5, "p", "q"), (6, "once", ""), (6, "once", ""), (8, "new", "")]
    got = {(r.k, r.difference) for r in M.reconcile_content(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), ["k"]).collect()}
    assert got == {(1, "changed"), (6, "changed"), (7, "missing"), (8, "extra")}


def test_cycles(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)]
    edges = [*ring, ("a", "b"), ("b", "a"), ("b", "r0"), ("x", "a"), ("r3", "y"), ("y", "z"), ("s", "s"), ("p", "q"), ("q", "p2"), ("p2", "p"), ("r0", "a2"), ("a2", "b2"), ("b2", "a2")]
    got = {r.node: r.self_loop for r in M.cycle_members(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {**{f"r{i}": False for i in range(40)}, "a": False, "b": False, "s": True, "p": False, "q": False, "p2": False, "a2": False, "b2": False}


def test_statements_that_begin_oddly(spark):
    rows = [
        ("; WITH a AS (SELECT ((1)) x), b AS (SELECT 2 y) INSERT INTO t SELECT x FROM a", "Insert", "; WITH A AS (SELECT ((?)) X), B AS (SELECT ? Y) INSERT INTO T SELECT X FROM A"),
        ("/* it's */ select 'it''s', '' -- '", "Select", "SELECT ?, ?"),
        ("BEGIN SELECT 1 END", "Procedural", "BEGIN SELECT ? END"),
        ("BEGIN TRY SELECT 1 END TRY", "Unknown", "BEGIN TRY SELECT ? END TRY"),
        ("begin tran", "Tcl", "BEGIN TRAN"),
        ("create unique index i on t (a)", "Ddl", "CREATE UNIQUE INDEX I ON T (A)"),
        (None, "Unknown", None),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "sql_text string")
    got = df.select("sql_text", A.classify(F.col("sql_text")).alias("c"), A.fingerprint(F.col("sql_text")).alias("f")).collect()
    assert {r.sql_text: (r.c, r.f) for r in got} == {s: (c, f) for s, c, f in rows}
    assert sorted(len(r.features) for r in A.tagged(df).collect())[0] == 0 and A.tagged(df).count() == len(rows)


def test_nested_comments_and_quoted_names(spark):
    deep = "/*" * 12 + " exec " + "*/" * 12
    rows = [
        ("/* a /* b */ EXEC x */ SELECT 1", []),
        (f"SELECT 1 {deep}", []),
        ("SELECT [PRINT], [a merge], [x]]EXEC] FROM [#tmp]", ["TEMP_TABLE"]),
        ('SELECT "nolock", "a""exec" FROM t', []),
        ("SELECT '/*' EXEC p '*/'", ["DYNAMIC_SQL"]),
        ("/* " + "*/ /* " * 3 + "*/ EXEC p", ["DYNAMIC_SQL"]),
        ("/*" + "*" * 20_000 + "/ PRINT 1", ["PRINT_STATEMENT"]),
        ("/* " + "long / * text " * 5_000 + "*/ PRINT 1 -- " + "x" * 50_000, ["PRINT_STATEMENT"]),
        ("SELECT '" + "it''s " * 3_000 + "' EXEC p", ["DYNAMIC_SQL"]),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "sql_text string")
    assert {r.sql_text: [f.tag for f in r.features] for r in A.tagged(df).collect()} == dict(rows)


def test_json_paths(spark):
    doc = '{"a":{"x":1,"l":[1,2]},"b c":[{"k":true}],"n":null}'
    one = lambda path, value, d=doc: spark.createDataFrame([(d,)], "d string").select(X_.json_modify(F.col("d"), path, value)).first()[0]
    same = lambda text, want: json.loads(text) == want
    base = json.loads(doc)
    assert same(one("$.a.x", F.lit("v")), {**base, "a": {"x": "v", "l": [1, 2]}})
    assert same(one('$."b c"[0].k', F.lit(3)), {**base, "b c": [{"k": 3}]})
    assert same(one("$.a.l[1]", F.lit(None).cast("string")), {**base, "a": {"x": 1, "l": [1, None]}})
    assert same(one("append $.a.l", F.lit(3)), {**base, "a": {"x": 1, "l": [1, 2, 3]}})
    assert same(one("append $.new", F.lit(3)), {**base, "new": [3]})
    assert same(one("$.a.l[9]", F.lit(3)), base) and same(one("$.no.x", F.lit(3)), base) and same(one("$.a.x.y", F.lit(3)), base)
    assert same(one("$.a", F.lit(None).cast("string")), {k: v for k, v in base.items() if k != "a"})
    assert same(one("strict $.a.x", F.lit(None).cast("string")), {**base, "a": {"x": None, "l": [1, 2]}})
    assert one("$.a", F.lit(1), None) is None and one("$.a", F.lit(1), "no json") is None
    with pytest.raises(Exception, match="nothing at"):
        one("strict $.no", F.lit(1))
    with pytest.raises(ValueError):
        one("a.b", F.lit(1))


def test_cross_references_of_many_items(spark):
    items = spark.range(2500).select(F.format_string("i%05d", "id").alias("item"), F.when(F.col("id") < 2490, "hot").when(F.col("id") == 2499, None).otherwise("cold").alias("object"))
    got = A.related_items(items, "item", "object")
    sizes = got.groupBy("item").agg(F.sum(F.size("related")).alias("n"), F.max(F.size("related")).alias("most")).collect()
    assert len(sizes) == 2499 and all(r.n == (2489 if r.item < "i02490" else 8) and r.most < 1300 for r in sizes)


def test_objects_of_texts_that_many_bodies_hold(spark):
    """The first object that holds a text, whether all bodies do, the last one only, or none."""
    from ferryline.operators.inventory import resolve_objects

    n = 700
    own = lambda i: f"update stock set amount = {i} where item = {i * 7919}"
    bodies = [(i * 3, f"o{i}", f"create procedure p{i} as select everything from everywhere; {own(i)}" + (" select the rare one from here" if i == n - 1 else "")) for i in range(n)] + [(5000, "opaque", None)]
    texts = ["select everything from everywhere", own(0), own(n - 1), own(430), "select the rare one from here", "no object holds this statement text", "short", None, "select  everything\nfrom everywhere"]
    got = resolve_objects(spark.createDataFrame([(t,) for t in texts], "sql_text string"), spark.createDataFrame(bodies, "ordinal int, object_name string, body string"))
    assert {r.sql_text: r.object_name for r in got.collect()} == dict(zip(texts, ["o0", "o0", f"o{n - 1}", "o430", f"o{n - 1}", None, None, None, "o0"]))


def test_errors_of_checks(spark):
    good = V.assert_no_error(spark, "fine", lambda: spark.range(3)).first()
    bad = V.assert_no_error(spark, "broken", lambda: spark.sql("select raise_error('no')")).first()
    worse = V.assert_no_error(spark, "missing", lambda: spark.table("no_such_table")).first()
    assert good.passed and not bad.passed and not worse.passed and worse.message


def test_copies_in_waves(spark):
    tables = spark.createDataFrame([(t,) for t in ("line", "order", "customer", "odd")], "table_name string")
    edges = spark.createDataFrame([("line", "order"), ("order", "customer")], "src string, dst string")
    seen = []

    def copy(name):
        seen.append(name)
        if name == "odd":
            raise RuntimeError("no such table")
        return len(name)

    got = {r.table_name: (r.wave, r.rows, r.status) for r in M.copy_tables(spark, tables, edges, copy).collect()}
    assert got == {"customer": (0, 8, "ok"), "odd": (0, None, "failed"), "order": (1, 5, "ok"), "line": (2, 4, "ok")}
    assert seen.index("customer") < seen.index("order") < seen.index("line")


def test_sessions_reports_and_audits(spark, tmp_path):
    folder = tmp_path / "session"
    folder.mkdir()
    for name, text in (("a", '{"name": "a",\n "n": 1}'), ("b", '{"name": "b"'), ("c", "not json"), ("d", '{"name": "d", "n": 4}')):
        (folder / f"{name}.json").write_text(text)
    with pytest.warns(UserWarning, match="2 session files"):
        good, bad = S.read_session(spark, str(folder), "name string, n int")
    assert sorted((r.name, r.n) for r in good.collect()) == [("a", 1), ("d", 4)] and bad.count() == 2
    S.write_report({"scores": spark.createDataFrame([("x", None), ("y", 2.5)], "name string, score double"), "empty": spark.range(0)}, str(tmp_path / "report"))
    got = S.read_report(spark, str(tmp_path / "report"), "scores", "name string, score double")
    assert sorted(tuple(r) for r in got.collect()) == [("x", None), ("y", 2.5)]
    audit = spark.range(2000).select("id", F.repeat(F.lit("x"), 100).alias("what"))
    for _ in range(2):
        S.append_audit(audit, str(tmp_path / "audit"), most_bytes=50_000)
    files = list((tmp_path / "audit").glob("part-*"))
    assert sum(len(f.read_text().splitlines()) for f in files) == 4000 and max(f.stat().st_size for f in files) < 60_000
    assert json.loads(files[0].read_text().splitlines()[0])["what"] == "x" * 100
    ddl = tmp_path / "ddl"
    ddl.mkdir()
    (ddl / "one.sql").write_text("create table a (x int)\nGO\ncreate table b (y int)\ngo\n")
    assert sorted(r.batch for r in S.read_ddl_files(spark, str(ddl)).collect()) == ["create table a (x int)", "create table b (y int)"]
    assert M.select_tables(spark.createDataFrame([("dbo", "Orders"), ("x", "Orders")], "schema_name string, table_name string"), ["DBO.orders"]).count() == 1


def test_database_tables(spark, tmp_path):
    """Derby comes with Spark: written in batches, read in ranges, emptied first."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.range(1000).select(F.col("id").cast("int").alias("ID"), F.concat(F.lit("n"), "id").alias("NAME"))
    S.write_jdbc(df, url, "T", 100, **options)
    S.write_jdbc(df.filter("ID < 10"), url, "T", 100, **options)
    back = S.read_jdbc(spark, url, "T", ["ID"], "ID", (0, 1000), 4, **options)
    assert back.columns == ["ID"] and back.count() == 1010 and back.rdd.getNumPartitions() == 4
    S.write_jdbc(df.filter("ID < 5"), url, "T", 100, truncate_first=True, **options)
    assert S.read_jdbc(spark, url, "T", ["ID", "NAME"], **options).count() == 5


# ---- streams against their batch twins


def streamed(spark, make, source, tmp_path, name, mode="complete"):
    q = make(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_streams_equal_batches(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").withColumns({"ts": F.col("ts").cast("timestamp"), "hit": F.col("event_id") % 3 == 0, "step": F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)}).repartition(4).write.parquet(str(tmp_path / "events"))
    batch = spark.read.parquet(str(tmp_path / "events"))
    source = lambda: X.read_stream(spark, str(tmp_path / "events"), batch.schema, 1)
    for name, make in (("requests", X.request_counts), ("latency", X.latency_buckets), ("hits", X.hit_ratio), ("sessions", X.active_sessions)):
        assert rows_of(streamed(spark, make, source(), tmp_path, name)) == rows_of(make(batch)), name


def test_statements_stream_in_once(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    k = F.col("event_id")
    doc = F.concat(F.lit("<event name='"), F.when(k % 3 == 0, "wait_info").otherwise("rpc_completed"), F.lit("'><data name='object_name'><value>p</value></data><data name='statement'><value>exec p</value></data><data name='parameters'><value><parameter name='@a' type='int'>"), k % 7, F.lit("</parameter></value></data></event>"))
    e.select(doc.alias("event_xml"), F.lit("2024-01-01").cast("timestamp").alias("ts")).repartition(3).write.parquet(str(tmp_path / "xml"))
    batch = spark.read.parquet(str(tmp_path / "xml"))
    got = streamed(spark, X.ingest, X.read_stream(spark, str(tmp_path / "xml"), batch.schema), tmp_path, "ingested", "append")
    assert rows_of(got) == rows_of(X.ingest(batch)) and got.filter("sql_text like 'EXEC p @a = %'").count() == got.count() > 0
    stamped = lambda df: df.select("ts", F.sha2("event_xml", 256).alias("fingerprint"))
    once = streamed(spark, lambda df: X.without_repeats(stamped(df)), X.read_stream(spark, str(tmp_path / "xml"), batch.schema), tmp_path, "once", "append")
    assert once.count() == X.without_repeats(stamped(batch)).count() == batch.select("event_xml").distinct().count() < batch.count()


def test_json_modify_parses_a_document_once(spark):
    """However deep the path, the plan names the parse of the document once; else each step repeats the steps before it."""
    df = spark.createDataFrame([('{"a":{"b":{"c":{"d":[1,{"e":2}]}}}}',)], "doc string")
    out = df.select(X_.json_modify(F.col("doc"), "$.a.b.c.d[1].e", F.lit(7)).alias("m"))
    assert out.first().m == '{"a":{"b":{"c":{"d":[1,{"e":7}]}}}}'
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("doc#") <= 3 and len(plan) < 20_000
