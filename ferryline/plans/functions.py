"""Functions that came later: formats, current times, identifiers, JSON and XML rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferryline.functions import dialect as X
from ferryline.plans.common import t
from ferryline.registry import query


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%-m/%-d/%Y') AS d, dayname(o_orderdate) || ', ' || monthname(o_orderdate) || ' ' || day(o_orderdate) || ', ' || year(o_orderdate) AS long_d, strftime(o_orderdate, '%I:%M %p') AS hm,
          format('{:,.2f}', CAST(o_totalprice AS DOUBLE)) AS n2, '$' || format('{:,.2f}', CAST(o_totalprice AS DOUBLE)) AS c2, format('{:.1f}', CAST(o_totalprice AS DOUBLE)) AS f1, format('{:,.0f}', (o_orderkey % 100) * 100.0) || '%' AS p0, lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(8, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS d8 FROM orders""")
def fn_format(s, d):
    o, k, p = F.col("o_orderdate"), F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    dates = {"iso": "yyyy-MM-dd", "d": "d", "long_d": "D", "hm": "hh:mm tt"}
    numbers = {"n2": (p, "N2"), "c2": (p, "C2"), "f1": (p, "F1"), "p0": ((k % 100).cast("double"), "P0"), "d8": (k, "D8")}
    return t(s, d, "orders").select("o_orderkey", *[X.format_date(o, f).alias(c) for c, f in dates.items()], *[X.format_number(x, f).alias(c) for c, (x, f) in numbers.items()])


@query("SELECT o_orderkey, o_orderdate < now() AS past, true AS same_zone FROM orders")
def fn_getdate(s, d):
    """Current times can only be compared: with dates of the table, and with each other."""
    apart = F.abs(F.unix_timestamp(X.now()) - F.unix_timestamp(F.from_utc_timestamp(X.now(utc=True), F.current_timezone())))
    return t(s, d, "orders").select("o_orderkey", (F.col("o_orderdate") < X.now()).alias("past"), (apart < 60).alias("same_zone"))


@query("SELECT count(*) AS n, count(*) AS different, count(*) AS well_formed FROM orders")
def fn_newid(s, d):
    ids = t(s, d, "orders").select(X.newid().alias("id"))
    return ids.agg(F.count("*").alias("n"), F.count_distinct("id").alias("different"), F.count_if(F.col("id").rlike("^[0-9A-F]{8}(-[0-9A-F]{4}){3}-[0-9A-F]{12}$")).alias("well_formed"))


@query("SELECT o_orderkey, round(pi() * o_orderkey, 6) AS p, true AS inside FROM orders")
def fn_pi_rand(s, d):
    r = X.rand()
    return t(s, d, "orders").select("o_orderkey", F.round(F.pi() * F.col("o_orderkey"), 6).alias("p"), r.alias("r")).select("o_orderkey", "p", ((F.col("r") >= 0) & (F.col("r") < 1)).alias("inside"))


_STYLES = {20: "%Y-%m-%d %H:%M:%S", 21: "%Y-%m-%d %H:%M:%S.%g", 105: "%d-%m-%Y", 110: "%m-%d-%Y", 121: "%Y-%m-%d %H:%M:%S.%g", 126: "%Y-%m-%dT%H:%M:%S.%g"}


@query(f"""SELECT event_id, {', '.join(f"strftime(ts, '{f}') AS s{k}" for k, f in _STYLES.items())}, CAST(ts AS DATE) AS back FROM events""")
def fn_convert_more_styles(s, d):
    """The other styles, and a date read back by one (what isn't one gives null)."""
    ts = F.col("ts")
    back = F.coalesce(X.parse_style(F.lit("31.31.2024"), 104), X.parse_style(X.convert_style(ts, 103), 103))
    return t(s, d, "events").select("event_id", *[X.convert_style(ts, k).alias(f"s{k}") for k in _STYLES], F.to_date(back).alias("back"))


def _documents(s, d):
    k = F.col("o_orderkey").cast("string")
    doc = F.concat(F.lit('{"a":{"x":'), k, F.lit('},"b":[1,2],"c":"t'), k, F.lit('","d":null,"n":'), k, F.lit(',"z":true}'))
    return t(s, d, "orders", "o_orderkey").select("o_orderkey", doc.alias("doc"))


@query("""SELECT o_orderkey, '{"x":' || o_orderkey || '}' AS a, '[1,2]' AS b, CAST(NULL AS VARCHAR) AS c, CAST(o_orderkey AS VARCHAR) AS n, 'new' AS changed, CAST(NULL AS VARCHAR) AS gone, '[1,2]' AS kept, '7' AS added FROM orders""")
def fn_json_query_modify(s, d):
    doc = F.col("doc")
    x = _documents(s, d).withColumns({"m": X.json_modify(doc, "$.c", F.lit("new")), "g": X.json_modify(doc, "$.c", F.lit(None).cast("string")), "p": X.json_modify(doc, "$.q", F.lit(7))})
    return x.select("o_orderkey", X.json_query(doc, "$.a").alias("a"), X.json_query(doc, "$.b").alias("b"), X.json_query(doc, "$.c").alias("c"), F.get_json_object("m", "$.n").alias("n"), F.get_json_object("m", "$.c").alias("changed"), F.get_json_object("g", "$.c").alias("gone"), X.json_query(F.col("m"), "$.b").alias("kept"), F.get_json_object("p", "$.q").alias("added"))


@query("""SELECT o_orderkey, '{"x":7}' AS deep, '{"x":' || o_orderkey || ',"y":"k' || o_orderkey || '"}' AS added, '{}' AS gone, '[1,"two"]' AS item, '[1,2,"' || o_orderkey || '"]' AS appended, true AS nowhere FROM orders""")
def fn_json_modify_path(s, d):
    doc, k = F.col("doc"), F.col("o_orderkey").cast("string")
    m = {
        "deep": X.json_query(X.json_modify(doc, "$.a.x", F.lit(7)), "$.a"),
        "added": X.json_query(X.json_modify(doc, "lax $.a.y", F.concat(F.lit("k"), k)), "$.a"),
        "gone": X.json_query(X.json_modify(doc, "$.a.x", F.lit(None).cast("string")), "$.a"),
        "item": X.json_query(X.json_modify(doc, "$.b[1]", F.lit("two")), "$.b"),
        "appended": X.json_query(X.json_modify(doc, "append $.b", k), "$.b"),
        "nowhere": F.to_json(F.parse_json(X.json_modify(doc, "$.no.way", F.lit(1)))) == F.to_json(F.parse_json(doc)),
    }
    return _documents(s, d).select("o_orderkey", *[v.alias(c) for c, v in m.items()])


@query("""SELECT o_orderkey, key, CASE key WHEN 'a' THEN '{"x":' || o_orderkey || '}' WHEN 'b' THEN '[1,2]' WHEN 'c' THEN 't' || o_orderkey WHEN 'n' THEN CAST(o_orderkey AS VARCHAR) WHEN 'z' THEN 'true' END AS value, type FROM orders, (VALUES ('a', 5), ('b', 4), ('c', 1), ('d', 0), ('n', 2), ('z', 3)) v(key, type)""")
def fn_openjson_types(s, d):
    return _documents(s, d).select("o_orderkey", F.explode(X.openjson(F.col("doc"))).alias("e")).select("o_orderkey", "e.*")


@query("SELECT l_orderkey, l_linenumber AS no, CAST(l_partkey AS BIGINT) AS part, CASE WHEN l_linenumber % 2 = 0 THEN 'even' END AS note FROM lineitem")
def fn_openjson_with(s, d):
    """Lines folded into one JSON array for each order (FOR JSON), and taken apart again by a schema."""
    line = F.struct(F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"), F.when(F.col("l_linenumber") % 2 == 0, "even").alias("note"))
    docs = t(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(line))).alias("doc"))
    return docs.select("l_orderkey", F.explode(X.openjson_with(F.col("doc"), "no int, part bigint, note string")).alias("r")).select("l_orderkey", "r.*")


@query("SELECT o_orderkey, CAST(i AS INTEGER) AS q, 'p' || (o_orderkey + i) AS part FROM orders, (VALUES (1), (2), (3)) v(i) WHERE i <= 1 + o_orderkey % 3")
def fn_xml_nodes(s, d):
    k = F.col("o_orderkey")
    item = lambda i: F.when(F.lit(i) <= 1 + k % 3, F.concat(F.lit(f"<i q='{i}'><p>p"), k + i, F.lit("</p></i>"))).otherwise("")
    x = t(s, d, "orders", "o_orderkey").select("o_orderkey", F.concat(F.lit("<o><items>"), *[item(i) for i in (1, 2, 3)], F.lit("</items></o>")).alias("doc"))
    nodes = X.xml_nodes(F.col("doc"), "items struct<i: array<struct<_q: int, p: string>>>", "items", "i")
    return x.select("o_orderkey", F.explode(nodes).alias("n")).select("o_orderkey", F.col("n._q").alias("q"), F.col("n.p").alias("part"))


@query("SELECT n_regionkey, string_agg('<r><n_name>' || n_name || '</n_name>' || CASE WHEN n_nationkey % 2 = 0 THEN '<x>a &lt; b &amp; c</x>' ELSE '' END || '</r>', '' ORDER BY n_name) AS doc FROM nation GROUP BY 1")
def fn_for_xml_path(s, d):
    n = t(s, d, "nation").withColumn("x", F.when(F.col("n_nationkey") % 2 == 0, "a < b & c"))
    return n.groupBy("n_regionkey").agg(X.for_xml("r", ["n_name", "x"]).alias("doc"))
