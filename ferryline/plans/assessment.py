"""Assessment of a statement log derived from events: each event runs one of the templates below."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ferryline.operators import assess as A
from ferryline.operators.rationale import SENTENCES
from ferryline.operators.staging import shared_folder
from ferryline.plans.common import sql_values, t, values
from ferryline.registry import query
from ferryline.sources.tables import read_report, write_report

TEMPLATES = list(enumerate([
    "SELECT TOP 10 * FROM orders WHERE id = {n}",
    "SELECT TOP 5 a FROM t ORDER BY a",
    "select isnull(a, 'x; top'), getdate() from t where k = {n}",
    "MERGE INTO t USING s ON t.id = s.id WHEN MATCHED THEN UPDATE SET a = {n} OUTPUT inserted.id;",
    "SELECT * FROM a CROSS APPLY (SELECT TOP 1 * FROM b WHERE b.k = a.k ORDER BY d) x",
    "SELECT * FROM a OUTER APPLY f(a.k) x WHERE n > {n}",
    "SELECT * FROM s PIVOT (SUM(v) FOR m IN ([1],[2])) p",
    "SELECT * FROM s UNPIVOT (v FOR m IN ([1],[2])) p",
    "EXEC dbo.usp_report @id = {n}, @name = 'abc'",
    "(@p0 int, @p1 nvarchar(20)) SELECT a FROM t WITH (NOLOCK) WHERE k = @p0",
    "UPDATE t WITH (ROWLOCK, UPDLOCK) SET a = {n} WHERE b = 2",
    "SELECT a FROM t FOR XML PATH('r')",
    "SELECT 'a' + name FROM t WHERE cust_id = '{n}'",
    "SELECT DATEADD(day, {n}, d), DATEDIFF(day, a, b), DATEPART(year, d) FROM t",
    "SELECT CHARINDEX('a', b), PATINDEX('%a%', b), STUFF(b, 1, 2, 'x') FROM t",
    "SELECT value FROM STRING_SPLIT('a,b', ',')",
    "SELECT * FROM OPENJSON(@j) WHERE JSON_VALUE(x, '$.a') = '{n}'",
    "SELECT * FROM OPENQUERY(srv, 'select 1')",
    "SELECT x.doc.value('(/a)[1]', 'int') FROM t x",
    "SELECT a INTO #tmp FROM t WHERE k > {n}",
    "INSERT INTO ##shared SELECT 1",
    "DECLARE @v TABLE (a int)",
    "BEGIN TRY UPDATE t SET a = {n} END TRY BEGIN CATCH THROW END CATCH",
    "BEGIN TRANSACTION; SAVE TRANSACTION s1",
    "INSERT INTO t (a) VALUES ({n})",
    "DELETE FROM t WHERE a = {n} -- top select",
    "CREATE TABLE t (a int)",
    "CREATE PROCEDURE p AS SELECT 1",
    "GRANT SELECT ON t TO u",
    "COMMIT",
    "RAISERROR('bad', 16, 1)",
    "SELECT a, b FROM t WHERE k = {n} ORDER BY a OFFSET {n} ROWS FETCH NEXT 5 ROWS ONLY",
    "PRINT 'done {n}'",
    "WITH c AS (SELECT a, max(k) AS m FROM t GROUP BY a) SELECT a FROM c WHERE m = {n}",
    "-- it's a comment\nSELECT a FROM t /* don't; select top 1 */ WHERE k = {n}",
    "UPDATE t SET a = 'it''s top; exec' WHERE k = {n}",
    "WITH c (k) AS (SELECT k FROM (SELECT 1 AS k) s) DELETE FROM c WHERE k = {n}",
    "DROP PROCEDURE p",
    "SELECT [it's], \"a--b\" FROM t WHERE s = '/* no comment */' AND k = {n}",
    "TRUNCATE TABLE t",
    "SELECT a /* old: /* b */ EXEC x */ FROM t WHERE k = {n}",
    "SELECT [PRINT], [MERGE x].[top], \"NOLOCK\" FROM [#t] WHERE [k]]EXEC] = {n}",
    "/***** /* /* one */ two */ ***** / SELECT TOP 1 */ DELETE FROM [exec] WHERE a = {n} /**/",
]))


def statement_log(s, d):
    e, k = t(s, d, "events", "event_id", "user_id", "event_type", "value"), F.col("event_id")
    m = F.broadcast(values(s, TEMPLATES, "i int, tpl string"))  # a fixed list of some dozen rows
    j = e.withColumn("i", k % len(TEMPLATES)).join(m, "i")
    return j.select("event_id", "i", F.replace("tpl", F.lit("{n}"), (k % 10).cast("string")).alias("sql_text"), (1 + k % 7).alias("execution_count"), (k % 6).alias("importance"), F.concat(F.lit("db"), F.col("user_id") % 5).alias("database_name"), (k % 101 == 0).alias("failed"))


_LOG = f"""log AS (SELECT event_id, i, replace(tpl, '{{n}}', CAST(event_id % 10 AS VARCHAR)) AS sql_text, 1 + event_id % 7 AS execution_count, event_id % 6 AS importance, 'db' || (user_id % 5) AS database_name, event_id % 101 = 0 AS failed
          FROM events JOIN {sql_values(TEMPLATES, 'i, tpl')} ON i = event_id % {len(TEMPLATES)})"""
_STRIP = r"regexp_replace(sql_text, '^\s*\(@(?:[^()]|\([^()]*\))*\)\s*', '')"
#: What each template is, read off by hand: class and tags. The SQL rests on this list, not on the operators' patterns.
EXPECTED = [
    ("Select", "TOP TOP_WITHOUT_ORDER"),
    ("Select", "TOP"),
    ("Select", "GETDATE ISNULL"),
    ("Merge", "MERGE OUTPUT"),
    ("Select", "TOP CROSS_APPLY"),
    ("Select", "OUTER_APPLY"),
    ("Select", "PIVOT"),
    ("Select", "UNPIVOT"),
    ("Unknown", "DYNAMIC_SQL"),
    ("Select", "NOLOCK"),
    ("Update", "ROWLOCK UPDLOCK"),
    ("Select", "FOR_XML"),
    ("Select", "STRING_CONCAT_PLUS IMPLICIT_CONVERSION"),
    ("Select", "DATEADD DATEDIFF DATEPART"),
    ("Select", "CHARINDEX PATINDEX STUFF"),
    ("Select", "STRING_SPLIT"),
    ("Select", "OPENJSON JSON_METHOD"),
    ("Select", "OPENQUERY"),
    ("Select", "XML_METHOD"),
    ("Select", "TEMP_TABLE"),
    ("Insert", "GLOBAL_TEMP_TABLE"),
    ("Unknown", "TABLE_VARIABLE"),
    ("Unknown", "TRY_CATCH THROW"),
    ("Tcl", "EXPLICIT_TRANSACTION SAVEPOINT"),
    ("Insert", ""),
    ("Delete", ""),
    ("Ddl", ""),
    ("Procedural", ""),
    ("Dcl", ""),
    ("Tcl", ""),
    ("Unknown", "RAISERROR"),
    ("Select", "OFFSET_FETCH"),
    ("Unknown", "PRINT_STATEMENT"),
    ("Select", ""),
    ("Select", ""),
    ("Update", ""),
    ("Delete", ""),
    ("Unknown", ""),
    ("Select", ""),
    ("Ddl", ""),
    ("Select", ""),
    ("Select", "TEMP_TABLE"),
    ("Delete", ""),
]
#: Tag, category and risk of the tags above, for the SQL, in the order in which statements list them.
TAGS = [
    ("TOP", "query", 2), ("TOP_WITHOUT_ORDER", "query", 2), ("OFFSET_FETCH", "query", 2), ("MERGE", "query", 4), ("OUTPUT", "query", 3), ("CROSS_APPLY", "query", 3), ("OUTER_APPLY", "query", 3), ("PIVOT", "query", 4), ("UNPIVOT", "query", 4), ("DYNAMIC_SQL", "query", 3),
    ("NOLOCK", "query", 4), ("ROWLOCK", "query", 4), ("UPDLOCK", "query", 4), ("FOR_XML", "query", 4), ("PRINT_STATEMENT", "query", 2), ("STRING_CONCAT_PLUS", "query", 2), ("IMPLICIT_CONVERSION", "query", 2),
    ("GETDATE", "function", 2), ("DATEADD", "function", 2), ("DATEDIFF", "function", 2), ("DATEPART", "function", 2), ("ISNULL", "function", 2), ("CHARINDEX", "function", 2), ("PATINDEX", "function", 2), ("STUFF", "function", 2), ("STRING_SPLIT", "function", 2), ("OPENJSON", "function", 4), ("JSON_METHOD", "function", 3), ("OPENQUERY", "function", 5), ("XML_METHOD", "function", 5),
    ("TEMP_TABLE", "temporary", 3), ("GLOBAL_TEMP_TABLE", "temporary", 4), ("TABLE_VARIABLE", "temporary", 4), ("TRY_CATCH", "transaction", 3), ("EXPLICIT_TRANSACTION", "transaction", 3), ("SAVEPOINT", "transaction", 3), ("RAISERROR", "transaction", 3), ("THROW", "transaction", 2),
]
_TEMPLATE_TAGS = [(i, o, *t) for i, (_, tags) in enumerate(EXPECTED) for o, t in enumerate(TAGS) if t[0] in tags.split()]
_TAGS = f"""{_LOG}, tags AS (SELECT log.*, tag, category, o, tag_risk FROM log JOIN {sql_values(_TEMPLATE_TAGS, 'ti, o, tag, category, tag_risk')} ON ti = i),
          an AS (SELECT log.*, CASE WHEN log.failed THEN 3 ELSE coalesce(m, 1) END AS risk, CASE WHEN log.failed THEN 3 ELSE coalesce(m, 1) END * log.execution_count * greatest(least(log.importance, 5), 1) AS weighted_risk
                 FROM log LEFT JOIN (SELECT event_id, max(tag_risk) AS m FROM tags GROUP BY 1) x ON x.event_id = log.event_id)"""


def analyzed(s, d):
    return A.analyzed(statement_log(s, d), failed=F.col("failed"))


@query(f"WITH {_LOG} SELECT event_id, {_STRIP} AS body FROM log")
def normalize_sql(s, d):
    return statement_log(s, d).select("event_id", A.strip_params(F.col("sql_text")).alias("body"))


_NO_CODE = r"""'('')(?:[^'']|'''')*('')|--[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|(\[[^\]]*\]|"[^"]*")'"""


#: The nested comments of the templates, read off by hand: SQL's patterns can't nest.
_UNNESTED = f"replace(replace({_STRIP}, '/* old: /* b */ EXEC x */', ''), '/***** /* /* one */ two */ ***** / SELECT TOP 1 */', '')"


@query(rf"WITH {_LOG} SELECT upper(trim(regexp_replace(regexp_replace(replace(regexp_replace({_UNNESTED}, {_NO_CODE}, '\1\2\3', 'g'), chr(39) || chr(39), '?'), '\b[0-9]+(\.[0-9]+)?\b', '?', 'g'), '\s+', ' ', 'g'))) AS fp, count(*) AS n, CAST(sum(execution_count) AS BIGINT) AS executions FROM log GROUP BY 1")
def fingerprint_counts(s, d):
    return statement_log(s, d).groupBy(A.fingerprint(F.col("sql_text")).alias("fp")).agg(F.count("*").alias("n"), F.sum("execution_count").alias("executions"))


@query(f"WITH {_LOG} SELECT event_id, class FROM log JOIN {sql_values([(i, c) for i, (c, _) in enumerate(EXPECTED)], 'ti, class')} ON ti = i")
def classify_statements(s, d):
    return statement_log(s, d).select("event_id", A.classify(F.col("sql_text")).alias("class"))


@query(f"WITH {_TAGS} SELECT event_id, tag, category FROM tags")
def feature_tags(s, d):
    return A.tagged(statement_log(s, d)).select("event_id", F.explode("features").alias("f")).select("event_id", "f.*")


@query(f"WITH {_TAGS} SELECT event_id, CAST(risk AS INTEGER) AS risk FROM an")
def risk_score(s, d):
    return analyzed(s, d).select("event_id", "risk")


@query(f"WITH {_TAGS} SELECT database_name, CAST(sum(weighted_risk) AS BIGINT) AS weighted_risk, CAST(max(weighted_risk) AS BIGINT) AS largest FROM an GROUP BY 1")
def weighted_risk(s, d):
    return analyzed(s, d).groupBy("database_name").agg(F.sum("weighted_risk").alias("weighted_risk"), F.max("weighted_risk").alias("largest"))


_SCORE = "CAST(round_even(greatest(least(100 * (1 - sum(weighted_risk) / sum(weighted_risk / risk * 5)), 100), 0), 0) AS INTEGER)"
_BAND = "CASE WHEN score >= 90 THEN 'Excellent Candidate' WHEN score >= 76 THEN 'Good Candidate' WHEN score >= 51 THEN 'Moderate Candidate - Significant Work Required' WHEN score >= 26 THEN 'High Risk' ELSE 'Not Recommended for Migration' END"


@query(f"WITH {_TAGS} SELECT score, {_BAND} AS band FROM (SELECT {_SCORE} AS score FROM an)")
def readiness_score(s, d):
    return A.readiness(analyzed(s, d))


@query(f"WITH {_TAGS} SELECT CAST(v.risk AS INTEGER) AS risk, count(an.risk) AS n, round_even(100.0 * count(an.risk) / (SELECT count(*) FROM an), 1) AS pct FROM (VALUES (1), (2), (3), (4), (5)) v(risk) LEFT JOIN an ON an.risk = v.risk GROUP BY 1")
def risk_distribution(s, d):
    return A.risk_distribution(analyzed(s, d))


@query(f"WITH {_TAGS} SELECT event_id, left(sql_text, 50) AS name, CAST(risk AS INTEGER) AS risk, CAST(weighted_risk AS BIGINT) AS weighted_risk FROM an ORDER BY weighted_risk DESC, risk DESC, event_id LIMIT 10")
def top_challenges(s, d):
    a = analyzed(s, d).orderBy(F.desc("weighted_risk"), F.desc("risk"), "event_id").limit(10)
    return a.select("event_id", F.left("sql_text", F.lit(50)).alias("name"), "risk", F.col("weighted_risk").cast("long").alias("weighted_risk"))


@query(f"""WITH {_TAGS}, c AS (SELECT count(*) FILTER (WHERE risk = 3) AS r3, count(*) FILTER (WHERE risk = 4) AS r4, count(*) FILTER (WHERE risk = 5) AS r5 FROM an), k AS (SELECT *, CAST(floor(r3 * 0.5 + r4 * 4 + r5 * 40) AS INTEGER) AS code_min, CAST(r3 * 4 + r4 * 40 + r5 * 200 AS INTEGER) AS code_max FROM c),
          m AS (SELECT 5 AS schema_min, 25 AS schema_max, code_min, code_max, CAST(floor(code_min * 1.5) AS INTEGER) AS test_min, CAST(floor(code_max * 1.5) AS INTEGER) AS test_max, 20 AS data_min, 80 AS data_max, CAST((r4 + r5) * 2 AS INTEGER) AS tune_min, CAST((r4 + r5) * 8 AS INTEGER) AS tune_max FROM k)
          SELECT *, CASE WHEN schema_max + code_max + test_max + data_max + tune_max <= 100 THEN 'Small' WHEN schema_max + code_max + test_max + data_max + tune_max <= 500 THEN 'Medium' WHEN schema_max + code_max + test_max + data_max + tune_max <= 2000 THEN 'Large' ELSE 'Enterprise' END AS size FROM m""")
def effort_estimate(s, d):
    return A.effort(analyzed(s, d), tables=20, schema_objects=50)


@query(f"""WITH {_TAGS}, p AS (SELECT database_name, {_SCORE} AS score, count(*) FILTER (WHERE risk = 5) AS critical FROM an GROUP BY 1)
          SELECT database_name, score, critical, CASE WHEN score >= 76 AND critical = 0 THEN 'Direct PostgreSQL Migration' WHEN score >= 51 AND critical <= 5 THEN 'PostgreSQL Migration with Compatibility Middleware' WHEN score >= 26 THEN 'Partial Migration' ELSE 'Remain on SQL Server' END AS advice FROM p""")
def recommendation(s, d):
    most = F.sum(F.col("weighted_risk") / F.col("risk") * 5)
    p = analyzed(s, d).groupBy("database_name").agg(F.bround(F.greatest(F.least(100 * (1 - F.sum("weighted_risk") / most), F.lit(100.0)), F.lit(0.0)), 0).cast("int").alias("score"), F.count_if(F.col("risk") == 5).alias("critical"))
    return p.withColumn("advice", A.recommendation(F.col("score"), F.col("critical")))


_WHY = f"""{_TAGS}, top AS (SELECT event_id, arg_min(tag, lpad(CAST(9 - tag_risk AS VARCHAR), 2, '0') || tag) AS feature FROM tags GROUP BY 1),
          why AS (SELECT an.*, feature, coalesce(sentence, 'Standard DML with no SQL Server-specific features detected.') AS rationale FROM an LEFT JOIN top USING (event_id) LEFT JOIN {sql_values(list(SENTENCES.items()), 'name, sentence')} ON name = feature)"""


@query(f"WITH {_WHY} SELECT event_id, feature, rationale FROM why")
def risk_rationale(s, d):
    """The feature that decides (highest risk, ties by name), and its sentence."""
    a = analyzed(s, d)
    return a.select("event_id", A.top_feature(F.col("features")).alias("feature"), A.rationale(F.col("features"), F.col("risk")).alias("rationale"))


@query(f"WITH {_WHY} SELECT event_id, CAST(risk AS INTEGER) AS risk, CAST(weighted_risk AS BIGINT) AS weighted_risk, CASE WHEN risk <= 2 THEN 'automatic' WHEN risk = 3 THEN 'semi-automatic' ELSE 'manual' END AS conversion, coalesce((SELECT string_agg(tag, ',' ORDER BY o) FROM tags WHERE tags.event_id = why.event_id), '') AS tags, rationale FROM why")
def statement_detail(s, d):
    return analyzed(s, d).select("event_id", "risk", F.col("weighted_risk").cast("long").alias("weighted_risk"), A.conversion(F.col("risk")).alias("conversion"), F.array_join(F.transform("features", lambda f: f.tag), ",").alias("tags"), A.rationale(F.col("features"), F.col("risk")).alias("rationale"))


_GROUPS = f"""{_TAGS}, g AS (SELECT sha256(sql_text) AS text_hash, database_name, count(*) AS statements, CAST(sum(execution_count) AS BIGINT) AS executions, CAST(sum(weighted_risk) AS BIGINT) AS weighted, CAST(max(risk) AS INTEGER) AS risk,
          arg_max(event_id, weighted_risk * 1e12 - event_id) AS primary_id, left(min(sql_text), 500) AS pattern FROM an WHERE event_id IN (SELECT event_id FROM tags) GROUP BY 1, 2), gt AS (SELECT sha256(sql_text) AS text_hash, database_name, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, arg_min(tag, lpad(CAST(9 - tag_risk AS VARCHAR), 2, '0') || tag) AS primary_feature FROM tags GROUP BY 1, 2),
          grp AS (SELECT * FROM g JOIN gt USING (text_hash, database_name))"""


def _groups(s, d):
    return A.statement_groups(analyzed(s, d))


@query(f"WITH {_GROUPS} SELECT * FROM grp")
def statement_groups(s, d):
    return _groups(s, d).withColumn("tags", F.array_join("tags", ","))


@query(f"WITH {_GROUPS}, o AS (SELECT *, row_number() OVER (ORDER BY weighted DESC, text_hash, database_name) AS n FROM grp) SELECT text_hash, database_name, 'WI-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS item, primary_id, pattern, weighted AS priority FROM o")
def work_items(s, d):
    return A.work_items(_groups(s, d)).select("text_hash", "database_name", "item", "primary_id", "pattern", "priority")


@query(f"""WITH {_GROUPS}, o AS (SELECT *, row_number() OVER (ORDER BY weighted DESC, risk DESC, statements DESC, text_hash, database_name) AS p, count(*) OVER () AS n FROM grp)
          SELECT text_hash, database_name, CASE WHEN p <= ceil(round(n * 0.1, 6)) THEN 'Critical' WHEN p <= ceil(round(n * 0.3, 6)) THEN 'High' WHEN p <= ceil(round(n * 0.7, 6)) THEN 'Medium' ELSE 'Low' END AS priority FROM o""")
def priority_labels(s, d):
    order = [F.desc("weighted"), F.desc("risk"), F.desc("statements"), F.asc("text_hash"), F.asc("database_name")]
    return A.priority_labels(_groups(s, d), order).select("text_hash", "database_name", "priority")


#: Risk, least and most hours, ratio; for the SQL.
_HOURS = [(1, 0.08, 0.17, 1.5), (2, 0.25, 0.75, 1.5), (3, 1.0, 3.0, 2.0), (4, 4.0, 12.0, 3.0), (5, 12.0, 32.0, 3.0)]


@query(f"""WITH {_GROUPS}, h AS (SELECT * FROM {sql_values(_HOURS, 'risk, lo, hi, ratio')}), u AS (SELECT text_hash, database_name, sum(lo) AS lo, sum(hi) AS hi, max(tag_risk) AS top FROM (SELECT DISTINCT sha256(sql_text) AS text_hash, database_name, tag, tag_risk FROM tags) x JOIN h ON h.risk = tag_risk GROUP BY 1, 2)
          SELECT text_hash, database_name, round(greatest(u.lo, u.hi / h.ratio) * (1 - power(0.7, statements)) / 0.3 + 1e-9, 4) AS min_hours, round(u.hi * (1 - power(0.7, statements)) / 0.3 + 1e-9, 4) AS max_hours FROM grp JOIN u USING (text_hash, database_name) JOIN h ON h.risk = u.top""")
def item_effort(s, d):
    lo, hi = A.item_effort(F.col("tags"), F.col("statements"))
    return _groups(s, d).select("text_hash", "database_name", F.round(lo + 1e-9, 4).alias("min_hours"), F.round(hi + 1e-9, 4).alias("max_hours"))


@query(f"WITH {_TAGS} SELECT event_id, 'risk-' || risk || ',' || 'c' || (event_id % 2) || ',' || CASE WHEN risk <= 2 THEN 'automatic' WHEN risk = 3 THEN 'semi-automatic' ELSE 'manual' END || CASE WHEN risk = 5 THEN ',requires-research' ELSE '' END AS tags FROM an")
def item_tags(s, d):
    category = F.concat(F.lit("c"), F.col("event_id") % 2)
    return analyzed(s, d).select("event_id", F.array_join(A.tags_of(F.col("risk"), category, F.col("risk") == 5), ",").alias("tags"))


def _own_tags(d_templates, k):
    return sorted({x for i in (k % d_templates, k * 7 % d_templates) for x in EXPECTED[i][1].split()})


_AD_HOC = ["TOP", "NOLOCK", "STUFF"]
_OBJECT_TAGS = [(k, tag) for k in range(len(TEMPLATES)) for tag in _own_tags(len(TEMPLATES), k)]


def readable_objects(s, d):
    """For each supplier an object that has the tags of two templates and runs up to 60 statements."""
    k = F.col("s_suppkey")
    m = values(s, [(i, _own_tags(len(TEMPLATES), i)) for i in range(len(TEMPLATES))], "i int, tags array<string>")  # a fixed list of some dozen rows
    o = t(s, d, "supplier", "s_suppkey").select(k.alias("ordinal"), F.concat(F.lit("o"), k).alias("object_name"), (k % 4 * 20).cast("long").alias("statements"), (k % len(TEMPLATES)).cast("int").alias("i"))
    return o.join(F.broadcast(m), "i").drop("i")


@query(f"""WITH {_TAGS}, x AS (SELECT event_id, sql_text, list_sort(list(DISTINCT tag)) AS tags FROM tags GROUP BY 1, 2),
          ob AS (SELECT s_suppkey AS ordinal, 'o' || s_suppkey AS object_name, s_suppkey % 4 * 20 AS cap, list(DISTINCT tag) AS own FROM supplier JOIN {sql_values(_OBJECT_TAGS, 'k, tag')} ON k = s_suppkey % {len(TEMPLATES)} GROUP BY 1, 2, 3),
          best AS (SELECT tags, arg_min(ordinal, len(own) * 1e9 + ordinal) AS ordinal FROM (SELECT DISTINCT tags FROM x) y JOIN ob ON list_has_all(own, tags) GROUP BY 1),
          c AS (SELECT x.event_id, x.sql_text, x.tags, object_name, cap, risk FROM x JOIN best USING (tags) JOIN ob USING (ordinal) JOIN an ON an.event_id = x.event_id),
          tx AS (SELECT object_name, sql_text, count(*) AS copies, max(len(tags)) AS overlap, max(risk) AS risk, max(CASE WHEN list_has_any(tags, {_AD_HOC}) THEN 1 ELSE 0 END) AS shared, max(cap) AS cap FROM c GROUP BY 1, 2),
          r AS (SELECT *, coalesce(sum(copies) OVER (PARTITION BY object_name ORDER BY copies, overlap DESC, risk DESC, sql_text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, max(shared) OVER (PARTITION BY object_name) AS capped FROM tx),
          p AS (SELECT event_id, c.object_name, row_number() OVER (PARTITION BY c.object_name, c.sql_text ORDER BY event_id) AS place, before, r.cap, capped FROM c JOIN r ON r.object_name = c.object_name AND r.sql_text = c.sql_text)
          SELECT event_id, object_name FROM p WHERE capped = 0 OR before + place <= cap""")
def attribute_by_features(s, d):
    return A.attribute_by_features(analyzed(s, d), readable_objects(s, d), _AD_HOC)


_RELOADED_CLASS = "CASE WHEN word LIKE 'SELECT%' THEN 'Select' WHEN word LIKE 'INSERT%' THEN 'Insert' WHEN word LIKE 'UPDATE%' THEN 'Update' WHEN word LIKE 'DELETE%' THEN 'Delete' WHEN word LIKE 'MERGE%' THEN 'Merge' WHEN word LIKE 'CREATE%' OR word LIKE 'DROP%' THEN 'Ddl' WHEN word LIKE 'GRANT%' THEN 'Dcl' WHEN word LIKE 'BEGIN%' OR word LIKE 'COMMIT%' THEN 'Tcl' ELSE 'Unknown' END"


@query(f"""WITH {_TAGS}, r AS (SELECT event_id, string_agg(CASE WHEN tag IN ('ISNULL', 'GETDATE', 'CHARINDEX', 'PATINDEX', 'STUFF', 'DATEADD', 'DATEDIFF', 'DATEPART', 'XML_METHOD') THEN 'function' WHEN tag IN ('TEMP_TABLE', 'GLOBAL_TEMP_TABLE') THEN 'temporary'
          WHEN tag IN ('UPDLOCK', 'ROWLOCK', 'NOLOCK', 'TRY_CATCH', 'DYNAMIC_SQL') THEN 'transaction' ELSE 'query' END, ',' ORDER BY o) AS categories FROM tags GROUP BY 1), w AS (SELECT event_id, upper(trim({_STRIP})) AS word FROM log)
          SELECT event_id, {_RELOADED_CLASS} AS class, coalesce(categories, '') AS categories FROM w LEFT JOIN r USING (event_id)""")
def reloaded_report(s, d):
    """The log's statements written as a report of cut texts and tags, and read again."""
    path = f"{shared_folder(s)}/ferryline/{uuid.uuid4().hex}"
    a = A.tagged(statement_log(s, d)).select("event_id", F.left("sql_text", F.lit(60)).alias("sql_text"), F.transform("features", lambda f: f.tag).alias("tags"))
    write_report({"statements": a}, path)
    back = A.reloaded(read_report(s, path, "statements", "event_id long, sql_text string, tags array<string>"))
    return back.select("event_id", "class", F.array_join(F.transform("features", lambda f: f.category), ",").alias("categories"))
