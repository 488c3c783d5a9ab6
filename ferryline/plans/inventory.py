"""Objects, columns and items derived from parts, with the statement log: inventory and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferryline.operators import assess as A
from ferryline.operators import inventory as I
from ferryline.operators import validate as V
from ferryline.plans import tracking as K
from ferryline.plans.assessment import _GROUPS, _HOURS, _STRIP, _TAGS, TEMPLATES, _groups, analyzed
from ferryline.plans.common import sql_values, t, values
from ferryline.registry import query

_N = len(TEMPLATES)


def objects(s, d):
    """A procedure for each part; its body holds a template, every 17th has no readable body."""
    k = F.col("p_partkey")
    m = F.broadcast(values(s, TEMPLATES, "i int, tpl string"))  # a fixed list of some dozen rows
    body = F.concat(F.lit("CREATE PROCEDURE p AS\n BEGIN  "), F.replace("tpl", F.lit("{n}"), (k % 10).cast("string")), F.lit("; END"))
    return t(s, d, "part", "p_partkey").withColumn("i", k % _N).join(m, "i").select(k.alias("ordinal"), F.concat(F.lit("o"), k).alias("object_name"), F.when(k % 17 != 0, body).alias("body"))


_LINE = lambda x: rf"upper(trim(regexp_replace({x}, '\s+', ' ', 'g')))"
_RESOLVED = f"""{_TAGS}, ob AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 17 <> 0 THEN {_LINE("'CREATE PROCEDURE p AS BEGIN ' || replace(tpl, '{n}', CAST(p_partkey % 10 AS VARCHAR)) || '; END'")} END AS body FROM part JOIN {sql_values(TEMPLATES, 'i, tpl')} ON i = p_partkey % {_N}),
          st AS (SELECT DISTINCT {_LINE(_STRIP)} AS line FROM log), hit AS (SELECT line, min(k) AS k FROM st JOIN ob ON contains(body, line) WHERE length(line) >= 20 GROUP BY 1),
          res AS (SELECT event_id, 'o' || k AS object_name FROM log LEFT JOIN hit ON hit.line = {_LINE(_STRIP)})"""


@query(f"WITH {_RESOLVED} SELECT * FROM res")
def resolve_objects(s, d):
    return I.resolve_objects(analyzed(s, d), objects(s, d)).select("event_id", "object_name")


@query(f"""WITH {_RESOLVED}, g AS (SELECT coalesce(object_name, 'Ad Hoc') AS object_name, object_name IS NULL AS ad_hoc, count(*) AS statements, CAST(max(risk) AS INTEGER) AS risk FROM res JOIN an USING (event_id) GROUP BY 1, 2),
          gt AS (SELECT coalesce(object_name, 'Ad Hoc') AS object_name, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM res JOIN tags USING (event_id) GROUP BY 1)
          SELECT g.*, coalesce(tags, '') AS tags, CASE WHEN risk <= 2 THEN 'automatic' WHEN risk = 3 THEN 'semi-automatic' ELSE 'manual' END AS conversion FROM g LEFT JOIN gt USING (object_name)
          UNION ALL SELECT 'o' || k, false, 0, 3, '', 'manual' FROM ob WHERE body IS NULL""")
def object_inventory(s, d):
    o = objects(s, d)
    return I.object_inventory(I.resolve_objects(analyzed(s, d), o), o).withColumn("tags", F.array_join("tags", ","))


_KINDS = list(enumerate(["uniqueidentifier", "datetime", "nvarchar(50)", "NVARCHAR(MAX)", "varbinary(max)", "int", "money", "text", "decimal(10,2)"]))


def findings(s, d):
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(x) for _, x in _KINDS]), (k % len(_KINDS) + 1).cast("int"))
    p = t(s, d, "part", "p_partkey").select(k.alias("object"), kind.alias("data_type"), F.lit(None).cast("int").alias("max_length"), (k % 10 == 0).alias("is_identity"), F.when(k % 15 == 0, "a + b").alias("computed"), F.when(k % 4 == 0, "clustered").otherwise("NONCLUSTERED").alias("index_type"))
    return I.schema_findings(p, p)


_FINDINGS = """(SELECT p_partkey AS object, 'DataType' AS issue, 2 AS risk, CASE CAST(p_partkey % 9 AS INTEGER) WHEN 0 THEN 'UUID' WHEN 1 THEN 'TIMESTAMPTZ' WHEN 3 THEN 'TEXT' WHEN 4 THEN 'BYTEA' ELSE 'NUMERIC(19,4)' END AS target FROM part WHERE p_partkey % 9 IN (0, 1, 3, 4, 6)
          UNION ALL SELECT p_partkey, 'Identity', 2, 'GENERATED ALWAYS AS IDENTITY' FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT p_partkey, 'ComputedColumn', 3, 'STORED' FROM part WHERE p_partkey % 15 = 0
          UNION ALL SELECT p_partkey, 'Collation', 3, 'citext' FROM part WHERE p_partkey % 9 IN (2, 3, 7) UNION ALL SELECT p_partkey, 'ClusteredIndex', 3, 'CLUSTER' FROM part WHERE p_partkey % 4 = 0)"""


@query(f"SELECT * FROM {_FINDINGS}")
def schema_findings(s, d):
    return findings(s, d)


@query(f"SELECT count(*) AS findings, greatest(1, CAST(ceil(round(sum(CASE WHEN risk <= 2 THEN 0.1 ELSE 0.25 END), 6)) AS INTEGER)) AS min_hours, greatest(2, CAST(ceil(round(sum(CASE WHEN risk <= 2 THEN 0.25 ELSE 0.75 END), 6)) AS INTEGER)) AS max_hours FROM {_FINDINGS}")
def schema_effort(s, d):
    return I.schema_effort(findings(s, d))


_EFFORT = f"""{_GROUPS}, h AS (SELECT * FROM {sql_values(_HOURS, 'risk, lo, hi, ratio')}), u AS (SELECT text_hash, database_name, sum(lo) AS lo, sum(hi) AS hi, max(tag_risk) AS top FROM (SELECT DISTINCT sha256(sql_text) AS text_hash, database_name, tag, tag_risk FROM tags) x JOIN h ON h.risk = tag_risk GROUP BY 1, 2),
          eff AS (SELECT grp.risk, round(greatest(u.lo, u.hi / h.ratio) * (1 - power(0.7, statements)) / 0.3 + 1e-9, 4) AS min_hours, round(u.hi * (1 - power(0.7, statements)) / 0.3 + 1e-9, 4) AS max_hours FROM grp JOIN u USING (text_hash, database_name) JOIN h ON h.risk = u.top)"""


@query(f"""WITH {_EFFORT} SELECT CASE WHEN risk <= 2 THEN 'High' WHEN risk = 3 THEN 'Medium' ELSE 'Low' END AS confidence, count(*) AS items, CAST(sum(CAST(min_hours AS DECIMAL(18,4))) AS DOUBLE) AS min_hours, CAST(sum(CAST(max_hours AS DECIMAL(18,4))) AS DOUBLE) AS max_hours,
          'Global temp table usage requires architectural review before effort can be scoped. XML/CLR features require replacement strategy selection (e.g., native PostgreSQL XML or application-layer migration) before estimates can be narrowed. Linked server / OPENQUERY usage requires target connectivity architecture decisions (e.g., foreign data wrappers, ETL, or API integration).' AS notes FROM eff GROUP BY 1""")
def confidence_summary(s, d):
    lo, hi = A.item_effort(F.col("tags"), F.col("statements"))
    return I.confidence_summary(_groups(s, d).select("risk", "tags", F.round(lo + 1e-9, 4).alias("min_hours"), F.round(hi + 1e-9, 4).alias("max_hours")))


@query(f"WITH {_GROUPS} SELECT text_hash, database_name, risk FROM grp WHERE risk >= 3 ORDER BY weighted DESC, text_hash, database_name LIMIT 20")
def limited_items(s, d):
    return I.limited_items(_groups(s, d), [F.desc("weighted"), F.asc("text_hash"), F.asc("database_name")], 20, 3).select("text_hash", "database_name", "risk")


@query(f"WITH {_GROUPS} SELECT a.text_hash, a.database_name, CAST(0 AS BIGINT) AS block, string_agg(b.text_hash, ',' ORDER BY b.text_hash) AS related FROM grp a JOIN grp b ON a.database_name = b.database_name AND a.text_hash <> b.text_hash GROUP BY 1, 2")
def related_items(s, d):
    return A.related_items(_groups(s, d), "text_hash", "database_name").withColumn("related", F.array_join("related", ","))


@query("""WITH i AS (SELECT p_partkey AS item, p_partkey % 5 AS e, p_partkey % 50 AS ob, p_partkey % 2 AS tg, p_partkey % 5 + 1 AS risk, p_partkey % 4 - 1 AS lo, p_partkey % 3 * 2 AS hi FROM part)
          SELECT item, 'empty equivalent' AS warning FROM i WHERE e = 0 UNION ALL SELECT item, 'malformed equivalent' FROM i WHERE e = 1 UNION ALL SELECT item, 'unknown object' FROM i WHERE ob NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 40)
          UNION ALL SELECT item, 'no shared feature' FROM i JOIN supplier ON s_suppkey = ob AND s_suppkey < 40 WHERE tg <> s_suppkey % 2 AND tg = 1 UNION ALL SELECT item, 'negative hours' FROM i WHERE lo < 0 UNION ALL SELECT item, 'inverted hours' FROM i WHERE hi < lo
          UNION ALL SELECT item, 'wide range' FROM i WHERE lo > 0 AND hi / CAST(lo AS DOUBLE) > CASE WHEN risk <= 2 THEN 1.5 WHEN risk = 3 THEN 2 ELSE 3 END""")
def item_warnings(s, d):
    k, own = F.col("p_partkey"), F.col("s_suppkey")
    some = lambda c: F.when(c == 1, F.array(F.lit("TOP"))).otherwise(F.array(F.lit("MERGE"), F.lit("TOP")))
    items = t(s, d, "part", "p_partkey").select(k.alias("item"), F.when(k % 5 == 0, " ").when(k % 5 == 1, "select (1").otherwise("select 1").alias("equivalent"), F.concat(F.lit("O"), k % 50).alias("object_name"), some(k % 2).alias("tags"), (k % 5 + 1).cast("int").alias("risk"), (k % 4 - 1).cast("double").alias("min_hours"), (k % 3 * 2).cast("double").alias("max_hours"))
    known = t(s, d, "supplier", "s_suppkey").filter("s_suppkey < 40").select(F.concat(F.lit("o"), own).alias("object_name"), F.when(own % 2 == 1, F.array(F.lit("TOP"))).otherwise(F.array(F.lit("MERGE"))).alias("tags"))
    return I.item_warnings(items, known)


@query("SELECT DISTINCT CASE s_suppkey % 5 WHEN 0 THEN 'view' ELSE 'procedure' END AS object_type FROM supplier WHERE (s_suppkey % 3 = 0 OR s_suppkey % 11 = 0) AND s_suppkey % 5 < 2")
def changed_types(s, d):
    """Every third file changed, every eleventh is new; notes concern no type."""
    k = F.col("s_suppkey")
    name = F.concat(F.when(k % 5 == 0, "view.").when(k % 5 == 1, "stored-procedure.").otherwise("notes."), k, F.lit(".md"))
    f = t(s, d, "supplier", "s_suppkey").select(k, name.alias("file_name"))
    now = f.select("file_name", F.sha2(F.when(k % 3 == 0, "new").otherwise("old"), 256).alias("sha"))
    return V.changed_types(now, f.filter("s_suppkey % 11 != 0").select("file_name", F.sha2(F.lit("old"), 256).alias("sha")))


_CATEGORY = "CASE object_type WHEN 'table' THEN 3 WHEN 'function' THEN 5 WHEN 'procedure' THEN 5 WHEN 'trigger' THEN 6 ELSE 7 END"


@query(f"""WITH o AS (SELECT p_partkey AS k, object_name, {_CATEGORY} AS c FROM {K._sql(1)} JOIN part ON object_name = 'o' || p_partkey), e AS (SELECT DISTINCT * FROM (SELECT k AS a, k - 1 AS b FROM o UNION ALL SELECT k, k // 2 FROM o)),
          n AS (SELECT a.object_name, count(*) AS n FROM e JOIN o a ON a.k = e.a JOIN o b ON b.k = e.b WHERE a.c = b.c GROUP BY 1),
          x AS (SELECT object_name, false AS is_wrapper, c, coalesce(n, 0) AS n FROM o LEFT JOIN n USING (object_name) UNION ALL SELECT object_name, true, 8, 0 FROM o WHERE c = 5)
          SELECT object_name, is_wrapper, row_number() OVER (ORDER BY c, n, object_name) AS place FROM x""")
def script_order(s, d):
    k, o = F.col("p_partkey"), lambda c: F.concat(F.lit("o"), c)
    p = t(s, d, "part", "p_partkey")
    depends = p.select(o(k).alias("src"), o(k - 1).alias("dst")).union(p.select(o(k), o(F.floor(k / 2))))
    kinds = K.results(s, d, 1).select("object_name", "object_type")
    return V.script_order(kinds, depends, F.col("object_type").isin("function", "procedure")).withColumn("place", F.col("place").cast("long"))
