"""Workload assessment: captured statements to tags, risk, readiness, effort and work items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryline.operators.rationale import SENTENCES, STANDARD
from ferryline.operators.relational import numbered
from ferryline.operators.staging import written

#: Features of each risk; a feature that isn't named has risk 1.
RISK = {
    2: ["TOP", "ISNULL", "GETDATE", "LEN", "CHARINDEX", "PATINDEX", "STUFF", "DATEADD", "DATEDIFF", "DATEPART", "OFFSET_FETCH", "STRING_CONCAT", "STRING_CONCAT_PLUS", "TOP_WITHOUT_ORDER", "PRINT_STATEMENT", "THROW", "IMPLICIT_CONVERSION", "STRING_SPLIT"],
    3: ["TRY_CATCH", "DYNAMIC_SQL", "EXPLICIT_TRANSACTION", "SAVEPOINT", "TEMP_TABLE", "OUTPUT", "CROSS_APPLY", "OUTER_APPLY", "JSON_METHOD", "IDENTITY", "CTE", "RAISERROR"],
    4: ["MERGE", "TABLE_VALUED_PARAMETER", "TABLE_VARIABLE", "GLOBAL_TEMP_TABLE", "NOLOCK", "ROWLOCK", "UPDLOCK", "PIVOT", "UNPIVOT", "OPENJSON", "FOR_XML"],
    5: ["OPENQUERY", "OPENROWSET", "XML_METHOD", "SQL_CLR", "SERVICE_BROKER", "LINKED_SERVER", "REPLICATION", "FILESTREAM", "MEMORY_OPTIMIZED"],
}
#: Hours (least, most) for one statement of each risk.
BASE_HOURS = {1: (0.08, 0.17), 2: (0.25, 0.75), 3: (1.0, 3.0), 4: (4.0, 12.0), 5: (12.0, 32.0)}
#: Most / least hours by risk (confidence high up to 2, medium 3, low above), and what a repeat still costs.
RANGE_RATIO = {1: 1.5, 2: 1.5, 3: 2.0, 4: 3.0, 5: 3.0}
REPEAT = 0.7

#: Tag, category, pattern that must match, pattern that must not; on upper-cased text without literals and comments.
FEATURES = [
    ("TOP", "query", r"\bSELECT\s+(DISTINCT\s+)?TOP\b", None),
    ("TOP_WITHOUT_ORDER", "query", r"\bSELECT\s+(DISTINCT\s+)?TOP\b", r"\bORDER\s+BY\b"),
    ("OFFSET_FETCH", "query", r"\bOFFSET\s+\S+\s+ROWS?\b", None),
    ("MERGE", "query", r"^\s*MERGE\b", None),
    ("OUTPUT", "query", r"\bOUTPUT\s+(INSERTED|DELETED)\b", None),
    ("CROSS_APPLY", "query", r"\bCROSS\s+APPLY\b", None),
    ("OUTER_APPLY", "query", r"\bOUTER\s+APPLY\b", None),
    ("PIVOT", "query", r"\bPIVOT\s*\(", None),
    ("UNPIVOT", "query", r"\bUNPIVOT\s*\(", None),
    ("DYNAMIC_SQL", "query", r"\bEXEC(UTE)?\b", None),
    ("NOLOCK", "query", r"\bNOLOCK\b", None),
    ("ROWLOCK", "query", r"\bROWLOCK\b", None),
    ("UPDLOCK", "query", r"\bUPDLOCK\b", None),
    ("FOR_XML", "query", r"\bFOR\s+XML\b", None),
    ("PRINT_STATEMENT", "query", r"\bPRINT\b", None),
    ("STRING_CONCAT_PLUS", "query", r"''\s*\+|\+\s*''", None),
    ("IMPLICIT_CONVERSION", "query", r"[A-Z_]+(ID|KEY|NUM)\s*=\s*''", None),
    ("GETDATE", "function", r"\bGETDATE\s*\(", None),
    ("DATEADD", "function", r"\bDATEADD\s*\(", None),
    ("DATEDIFF", "function", r"\bDATEDIFF\s*\(", None),
    ("DATEPART", "function", r"\bDATEPART\s*\(", None),
    ("ISNULL", "function", r"\bISNULL\s*\(", None),
    ("CHARINDEX", "function", r"\bCHARINDEX\s*\(", None),
    ("PATINDEX", "function", r"\bPATINDEX\s*\(", None),
    ("STUFF", "function", r"\bSTUFF\s*\(", None),
    ("STRING_SPLIT", "function", r"\bSTRING_SPLIT\s*\(", None),
    ("OPENJSON", "function", r"\bOPENJSON\s*\(", None),
    ("JSON_METHOD", "function", r"\bJSON_(VALUE|QUERY|MODIFY)\s*\(", None),
    ("OPENQUERY", "function", r"\bOPENQUERY\s*\(", None),
    ("OPENROWSET", "function", r"\bOPENROWSET\s*\(", None),
    ("XML_METHOD", "function", r"\.(VALUE|QUERY|EXIST|NODES)\s*\(", None),
    ("TEMP_TABLE", "temporary", r"(^|[^#])#_?[A-Z]", None),
    ("GLOBAL_TEMP_TABLE", "temporary", r"##_?[A-Z]", None),
    ("TABLE_VARIABLE", "temporary", r"\bDECLARE\s+@\S+\s+(AS\s+)?TABLE\b", None),
    ("TABLE_VALUED_PARAMETER", "temporary", r"\bREADONLY\b", None),
    ("TRY_CATCH", "transaction", r"\bBEGIN\s+TRY\b", None),
    ("EXPLICIT_TRANSACTION", "transaction", r"\bBEGIN\s+TRAN(SACTION)?\b", None),
    ("SAVEPOINT", "transaction", r"\bSAVE\s+TRAN(SACTION)?\b", None),
    ("RAISERROR", "transaction", r"\bRAISERROR\b", None),
    ("THROW", "transaction", r"\bTHROW\b", None),
]
#: First words of each statement class, in the order of testing; a statement that begins with WITH is classed by what its common tables serve.
CLASSES = [
    ("Select", r"^SELECT\b"),
    ("Insert", r"^INSERT\b"),
    ("Update", r"^UPDATE\b"),
    ("Delete", r"^DELETE\b"),
    ("Merge", r"^MERGE\b"),
    ("Tcl", r"^(BEGIN\s+TRAN|COMMIT|ROLLBACK|SAVE\s+TRAN)"),
    ("Procedural", r"^(CREATE|ALTER)\s+(PROC|PROCEDURE|FUNCTION)\b|^BEGIN\b(?!\s+(TRY|DIALOG|CONVERSATION|DISTRIBUTED)\b)|^(WHILE|IF)\b|^DECLARE\b(?!\s+@\S+\s+(AS\s+)?TABLE\b)(?!\s+\S+\s+(\S+\s+)*CURSOR\b)"),
    ("Dcl", r"^(GRANT|DENY|REVOKE)\b"),
    ("Ddl", r"^(CREATE|ALTER|DROP)\s+(UNIQUE\s+)?((NON)?CLUSTERED\s+)?(TABLE|VIEW|INDEX|SCHEMA|SEQUENCE|TRIGGER|TYPE|DATABASE|STATISTICS)\b|^TRUNCATE\s+TABLE\b"),
]
#: Nesting of block comments inside block comments that is looked through.
_COMMENT_DEPTH = 12


def _comment(depth: int) -> str:
    """A block comment that holds others, so many levels deep. Possessive, so that long comments don't use up the stack."""
    inner = f"|{_comment(depth - 1)}" if depth else ""
    return rf"/\*[^*/]*+(?:(?:\*++(?!/)|/(?!\*){inner})[^*/]*+)*+\*++/"


#: What isn't code, whichever begins first: a literal (its quotes are kept), a comment, or a quoted name (kept).
_NO_CODE = rf"(')[^']*+(?:''[^']*+)*+(')|--[^\n]*|{_comment(_COMMENT_DEPTH)}|(\[[^\]]*+(?:\]\][^\]]*+)*+\]|\"[^\"]*+(?:\"\"[^\"]*+)*+\")"
#: A quoted name, where literals and comments are gone already; the beginning of a word in a bracketed name.
_QUOTED, _WORD_IN_NAME = r"\[([^\]]*+)\]|\"([^\"]*+(?:\"\"[^\"]*+)*+)\"", r"(?<=\[[^\]]{0,128})\b(?=\w)"
#: Nesting of parentheses inside common tables that classes look through.
_DEPTH = 12


def strip_params(sql: Column) -> Column:
    """Without the parameter list (types may have sizes) that stands before a parameterised statement."""
    return F.regexp_replace(sql, r"^\s*\(@(?:[^()]|\([^()]*\))*\)\s*", "")


def bare(sql: Column) -> Column:
    """Upper-cased, string literals emptied, comments gone, nested ones too; words of quoted names begin with _, so that none is taken for a keyword."""
    code = F.replace(F.regexp_replace(sql, _NO_CODE, "$1$2$3"), F.lit("]]"), F.lit("_"))
    return F.upper(F.regexp_replace(F.regexp_replace(code, _QUOTED, "[$1$2]"), _WORD_IN_NAME, "_"))


def fingerprint(sql: Column) -> Column:
    """Literals become ?, comments go, white space one blank, upper case."""
    s = F.replace(F.regexp_replace(strip_params(sql), _NO_CODE, "$1$2$3"), F.lit("''"), F.lit("?"))
    s = F.regexp_replace(s, r"\b[0-9]+(\.[0-9]+)?\b", "?")
    return F.upper(F.trim(F.regexp_replace(s, r"\s+", " ")))


def classify(sql: Column) -> Column:
    text = F.regexp_replace(bare(strip_params(sql)), r"^[\s;]+", "")
    flat = text
    for _ in range(_DEPTH):
        flat = F.regexp_replace(flat, r"\([^()]*\)", " ")
    served = F.regexp_extract(flat, r"(?s)^WITH\b.*?\b((?:SELECT|INSERT|UPDATE|DELETE|MERGE)\b.*)", 1)
    text = F.when(text.rlike(r"^WITH\b"), served).otherwise(text)
    return F.coalesce(*[F.when(text.rlike(p), F.lit(c)) for c, p in CLASSES], F.lit("Unknown"))


def features_of(text: Column) -> Column:
    """Array of (tag, category) of bare text, in the order of FEATURES."""
    hit = [F.when(text.rlike(p) & (~text.rlike(n) if n else F.lit(True)), F.struct(F.lit(t).alias("tag"), F.lit(c).alias("category"))) for t, c, p, n in FEATURES]
    return F.array_compact(F.array(*hit))


def risk_of(tag: Column) -> Column:
    return F.coalesce(*[F.when(tag.isin(names), F.lit(r)) for r, names in RISK.items()], F.lit(1))


def tagged(statements: DataFrame, sql_col: str = "sql_text") -> DataFrame:
    """Adds features and risk (that of the worst feature, 1 without any). Each different text is taken apart once, however often it was run; null texts have no features.

    Statements and tags meet by two hashes of the text. Where tags are few, as in
    a log of templates, their written size shows it and they travel to the
    statements, which are not shuffled at all.
    """
    named = {"_a": F.xxhash64(sql_col), "_b": F.xxhash64(F.lit(1), sql_col)}
    texts = statements.select(F.col(sql_col).alias("_sql")).distinct().withColumn("_bare", bare(strip_params(F.col("_sql"))))
    texts = texts.select(F.xxhash64("_sql").alias("_a"), F.xxhash64(F.lit(1), "_sql").alias("_b"), features_of(F.col("_bare")).alias("features"))
    texts = texts.withColumn("risk", F.coalesce(F.array_max(F.transform("features", lambda f: risk_of(f.tag))), F.lit(1)))
    texts = written(texts)  # else filters on features would move below the distinct and run for each statement
    out = statements.withColumns(named).join(texts, ["_a", "_b"]).drop("_a", "_b")
    return out.withColumns({"features": F.coalesce("features", F.array().cast("array<struct<tag:string,category:string>>")), "risk": F.coalesce("risk", F.lit(1))})


def analyzed(statements: DataFrame, sql_col: str = "sql_text", failed: Column | None = None) -> DataFrame:
    """Adds features, risk (3 where parsing failed, 1 without features) and weighted_risk.

    Needs execution_count and importance.
    """
    s = tagged(statements, sql_col)
    if failed is not None:
        s = s.withColumn("risk", F.when(failed, 3).otherwise(F.col("risk")))
    return s.withColumn("weighted_risk", weighted_risk(F.col("risk"), F.col("execution_count"), F.col("importance")))


def top_feature(features: Column) -> Column:
    """The feature that decides: of the highest risk, the first by name; null without features."""
    return F.array_min(F.transform(features, lambda f: F.struct((-risk_of(f.tag)).alias("r"), f.tag.alias("tag")))).getField("tag")


def rationale(features: Column, risk: Column) -> Column:
    """Sentence of the feature that decides."""
    top = top_feature(features)
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    # fixed values: the sentences of features without one of their own, by risk
    other = F.when(risk >= 4, F.concat(top, F.lit(" requires manual conversion; no direct PostgreSQL equivalent available."))).when(risk == 3, F.concat(top, F.lit(" requires procedural restructuring for PostgreSQL compatibility."))).when(risk == 2, F.concat(top, F.lit(" requires simple function substitution with no behavioral change."))).otherwise(STANDARD)
    return F.when(F.size(features) == 0, STANDARD).otherwise(F.coalesce(F.element_at(known, top), other))


def weighted_risk(risk: Column, count: Column, importance: Column) -> Column:
    return risk * F.greatest(count, F.lit(1)) * F.greatest(F.least(importance, F.lit(5)), F.lit(1))


def readiness(analyzed_: DataFrame) -> DataFrame:
    """score and band, from the share of the largest possible weighted risk; no statements: 0, remain."""
    most = F.sum(F.col("weighted_risk") / F.col("risk") * 5)
    s = analyzed_.agg(F.sum("weighted_risk").alias("w"), most.alias("m"), F.count("*").alias("n"))
    raw = F.when(F.col("m") == 0, 100.0).otherwise(100 * (1 - F.col("w") / F.col("m")))
    score = F.when(F.col("n") == 0, 0).otherwise(F.bround(F.greatest(F.least(raw, F.lit(100.0)), F.lit(0.0)), 0).cast("int"))
    return s.select(score.alias("score")).withColumn("band", band(F.col("score")))


def band(score: Column) -> Column:
    """Bands of the score and their names."""
    return F.when(score >= 90, "Excellent Candidate").when(score >= 76, "Good Candidate").when(score >= 51, "Moderate Candidate - Significant Work Required").when(score >= 26, "High Risk").otherwise("Not Recommended for Migration")


def risk_distribution(analyzed_: DataFrame) -> DataFrame:
    """Counts and percentages of risks 1 to 5, absent ones too."""
    n = analyzed_.agg(*[F.count_if(F.col("risk") == r).alias(str(r)) for r in range(1, 6)], F.count("*").alias("all"))
    levels = F.explode(F.array(*[F.struct(F.lit(r).alias("risk"), F.col(str(r)).alias("n")) for r in range(1, 6)]))
    out = n.select("all", levels.alias("x")).select("all", "x.*")
    return out.select("risk", "n", F.when(F.col("all") == 0, 0.0).otherwise(F.bround(100 * F.col("n") / F.col("all"), 1)).alias("pct"))


def effort(analyzed_: DataFrame, tables: int, schema_objects: int) -> DataFrame:
    """Hours (least, most) of each kind of work, and the size class of the most."""
    c = analyzed_.agg(*[F.count_if(F.col("risk") == r).alias(f"r{r}") for r in (3, 4, 5)])
    whole = lambda x: F.floor(x).cast("int")
    r3, r4, r5 = (F.col(f"r{r}") for r in (3, 4, 5))
    c = c.withColumns({"schema_min": F.lit(int(schema_objects * 0.1)), "schema_max": F.lit(int(schema_objects * 0.5)), "code_min": whole(r3 * 0.5 + r4 * 4 + r5 * 40), "code_max": whole(r3 * 4 + r4 * 40 + r5 * 200)})
    c = c.withColumns({"test_min": whole(F.col("code_min") * 1.5), "test_max": whole(F.col("code_max") * 1.5), "data_min": F.lit(tables), "data_max": F.lit(tables * 4), "tune_min": ((r4 + r5) * 2).cast("int"), "tune_max": ((r4 + r5) * 8).cast("int")})
    most = F.col("schema_max") + F.col("code_max") + F.col("test_max") + F.col("data_max") + F.col("tune_max")
    return c.withColumn("size", F.when(most <= 100, "Small").when(most <= 500, "Medium").when(most <= 2000, "Large").otherwise("Enterprise")).drop("r3", "r4", "r5")


def recommendation(score: Column, critical: Column) -> Column:
    """Advice by score and number of statements of risk 5."""
    return F.when((score >= 76) & (critical == 0), "Direct PostgreSQL Migration").when((score >= 51) & (critical <= 5), "PostgreSQL Migration with Compatibility Middleware").when(score >= 26, "Partial Migration").otherwise("Remain on SQL Server")


def conversion(risk: Column) -> Column:
    return F.when(risk <= 2, "automatic").when(risk == 3, "semi-automatic").otherwise("manual")


def statement_groups(analyzed_: DataFrame, least_risk: int = 1, sql_col: str = "sql_text", object_col: str = "database_name", id_col: str = "event_id") -> DataFrame:
    """Groups by (text, object): text_hash, statements, executions, weighted, risk, tags, primary_feature (highest risk, then by name), primary_id (heaviest statement, of equal ones the first) and pattern (its first 500 characters).

    Statements without features are left out. All of a group have one text and
    so the same features: one aggregation, and tags are sorted once for each group.
    """
    g = analyzed_.filter((F.col("risk") >= least_risk) & (F.size("features") > 0))
    heaviest = F.max(F.struct(F.col("weighted_risk"), -F.col(id_col))).getField("col2")
    g = g.groupBy(sql_col, object_col).agg(F.count("*").alias("statements"), F.sum("execution_count").alias("executions"), F.sum("weighted_risk").alias("weighted"), F.max("risk").alias("risk"), F.first("features").alias("features"), (-heaviest).alias("primary_id"))
    tags = F.array_sort(F.array_distinct(F.transform("features", lambda f: f.tag)))
    return g.select(F.sha2(sql_col, 256).alias("text_hash"), object_col, "statements", "executions", "weighted", "risk", tags.alias("tags"), top_feature(F.col("features")).alias("primary_feature"), "primary_id", F.left(sql_col, F.lit(500)).alias("pattern"))


def item_effort(tags: Column, n: Column) -> tuple[Column, Column]:
    """Hours of n statements with these features: a geometric series for each feature, the range then narrowed from below."""
    series = (1 - F.pow(F.lit(REPEAT), n)) / (1 - REPEAT)
    hours = lambda tag, k: F.element_at(F.array(*[F.lit(BASE_HOURS[r][k]) for r in range(1, 6)]), risk_of(tag))
    least = F.aggregate(tags, F.lit(0.0), lambda a, tag: a + hours(tag, 0)) * series
    most = F.aggregate(tags, F.lit(0.0), lambda a, tag: a + hours(tag, 1)) * series
    top = F.array_max(F.transform(tags, risk_of))
    ratio = F.element_at(F.array(*[F.lit(RANGE_RATIO[r]) for r in range(1, 6)]), top)
    return F.greatest(least, most / ratio), most


def priority_labels(items: DataFrame, order: list[Column]) -> DataFrame:
    """Critical for the first tenth, High to three tenths, Medium to seven, else Low; counts rounded up.

    Items are groups, far fewer than statements; they are numbered by ranges.
    """
    place = numbered(items, order, "place", "_n")
    upto = lambda share: F.ceil(F.round(F.col("_n") * share, 6))
    label = F.when(F.col("place") <= upto(0.1), "Critical").when(F.col("place") <= upto(0.3), "High").when(F.col("place") <= upto(0.7), "Medium").otherwise("Low")
    return place.withColumn("priority", label).drop("_n")


def work_items(groups: DataFrame) -> DataFrame:
    """Ids WI-001, WI-002 ... by weighted risk; a group's priority is the sum of its statements' weighted risks."""
    out = numbered(groups, [F.desc("weighted"), F.asc("text_hash"), F.asc("database_name")])
    number = F.col("_place").cast("string")
    return out.withColumns({"item": F.concat(F.lit("WI-"), F.when(F.col("_place") < 1000, F.lpad(number, 3, "0")).otherwise(number)), "priority": F.col("weighted")}).drop("_place")


def tags_of(risk: Column, category: Column, research: Column) -> Column:
    return F.array_compact(F.array(F.concat(F.lit("risk-"), risk), category, conversion(risk), F.when(research, "requires-research")))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


#: Ids in one row of cross-references.
REFERENCES = 1000


def related_items(items: DataFrame, item_col: str, object_col: str) -> DataFrame:
    """Other items of the same object: item_col, object_col, block and related (sorted ids).

    Items without an object, or alone in theirs, have none. A row has about
    ``REFERENCES`` ids: the items of an object are dealt into blocks by the
    hash of their id, one where they are few, so no list grows with an object.
    """
    known = items.filter(F.col(object_col).isNotNull()).select(item_col, object_col)
    size = known.groupBy(object_col).agg(F.count("*").alias("_n")).filter("_n > 1")
    block = F.when(F.col("_n") <= REFERENCES, 0).otherwise(F.pmod(F.xxhash64(item_col), F.ceil(F.col("_n") / REFERENCES)))
    blocks = known.join(size, object_col).groupBy(object_col, block.cast("long").alias("block")).agg(F.sort_array(F.collect_list(item_col)).alias("_ids"))
    out = known.join(blocks, object_col).withColumn("related", F.array_except("_ids", F.array(item_col)))
    return out.filter(F.size("related") > 0).select(item_col, object_col, "block", "related")


def attribute_by_features(statements: DataFrame, objects: DataFrame, ad_hoc: list[str], id_col: str = "event_id", sql_col: str = "sql_text") -> DataFrame:
    """Objects of statements whose bodies can't be read: id_col, object_name; other statements are absent.

    ``statements``: id_col, sql_col, features, risk; ``objects``: ordinal,
    object_name, tags, statements (how many it runs). A statement goes to the
    object with the fewest tags that has all of its features (of equal ones
    the first). Where features of an object's statements also occur ad hoc,
    it takes no more than it runs: texts with few copies first, then of higher
    risk, then by text; of a text that doesn't fit whole the first statements.
    """
    s = statements.filter(F.size("features") > 0).select(id_col, sql_col, "risk", F.array_sort(F.array_distinct(F.transform("features", lambda f: f.tag))).alias("_set"))
    sets = s.select("_set").distinct().withColumn("_key", F.try_element_at("_set", F.lit(1)))
    own = objects.filter(F.size("tags") > 0).select("ordinal", "object_name", "tags", F.col("statements").alias("_cap"), F.explode(F.array_distinct("tags")).alias("_key"))
    fits = sets.join(own, "_key").filter(F.size(F.array_except("_set", "tags")) == 0)
    best = fits.groupBy("_set").agg(F.min(F.struct(F.size(F.array_distinct("tags")), "ordinal", "object_name", "_cap")).alias("m")).select("_set", "m.object_name", "m._cap")
    found = s.join(best, "_set")
    texts = found.groupBy("object_name", sql_col).agg(F.count("*").alias("_copies"), F.size(F.first("_set")).alias("_overlap"), F.max("risk").alias("_risk"), F.first("_cap").alias("_cap"), F.max(F.arrays_overlap("_set", F.array(*[F.lit(x) for x in ad_hoc]).cast("array<string>"))).alias("_shared"))
    w = Window.partitionBy("object_name").orderBy("_copies", F.desc("_overlap"), F.desc("_risk"), sql_col)
    texts = texts.withColumn("_before", F.coalesce(F.sum("_copies").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_capped", F.max("_shared").over(Window.partitionBy("object_name")))
    room = F.when(F.col("_capped"), F.least("_copies", F.greatest(F.col("_cap") - F.col("_before"), F.lit(0)))).otherwise(F.col("_copies"))
    texts = texts.withColumn("_room", room).filter("_room > 0").select("object_name", sql_col, "_room", "_copies")
    found = found.select(id_col, sql_col, "object_name").join(texts, ["object_name", sql_col])
    whole = found.filter("_room = _copies").select(id_col, "object_name")
    part = found.filter("_room < _copies").withColumn("_place", F.row_number().over(Window.partitionBy("object_name", sql_col).orderBy(id_col))).filter("_place <= _room")
    return whole.unionByName(part.select(id_col, "object_name"))


#: Categories that a reloaded report's tags have; a tag that isn't named is of queries.
RELOADED = {
    "query": ["TOP", "MERGE", "CROSS_APPLY", "OUTER_APPLY", "PIVOT", "UNPIVOT", "OPENQUERY", "OPENROWSET"],
    "function": ["ISNULL", "GETDATE", "LEN", "CHARINDEX", "PATINDEX", "STUFF", "DATEADD", "DATEDIFF", "DATEPART", "XML_METHOD"],
    "temporary": ["TEMP_TABLE", "GLOBAL_TEMP_TABLE"],
    "transaction": ["UPDLOCK", "ROWLOCK", "NOLOCK", "TABLOCK", "HOLDLOCK", "TRY_CATCH", "DYNAMIC_SQL", "OUTPUT_CLAUSE"],
}
#: First words of a reloaded report's statements, which may be cut, and their classes.
FIRST_WORDS = {"Select": ["SELECT"], "Insert": ["INSERT"], "Update": ["UPDATE"], "Delete": ["DELETE"], "Merge": ["MERGE"], "Ddl": ["CREATE", "ALTER", "DROP"], "Dcl": ["GRANT", "REVOKE", "DENY"], "Tcl": ["BEGIN", "COMMIT", "ROLLBACK"]}


def reloaded(statements: DataFrame, text_col: str = "sql_text", tags_col: str = "tags") -> DataFrame:
    """Statements of a report, whose texts may be cut and whose tags have no category: adds class, by the first word, and features (tag, category)."""
    first = F.regexp_extract(F.upper(strip_params(F.coalesce(text_col, F.lit("")))), r"^\s*([A-Z]+)", 1)
    starts = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: first.startswith(w))
    kind = F.coalesce(*[F.when(starts(words), F.lit(c)) for c, words in FIRST_WORDS.items()], F.lit("Unknown"))
    category = lambda tag: F.coalesce(*[F.when(F.upper(tag).isin(names), F.lit(c)) for c, names in RELOADED.items()], F.lit("query"))
    return statements.withColumns({"class": kind, "features": F.transform(F.coalesce(tags_col, F.array().cast("array<string>")), lambda t: F.struct(t.alias("tag"), category(t).alias("category")))})
