"""Conversion tracking and validation scores."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferryline.operators.migrate import dependency_waves
from ferryline.operators.relational import numbered


def changed_objects(current: DataFrame, previous: DataFrame, key: str = "object_name", hash_col: str = "sha", **only: str) -> DataFrame:
    """Objects that are new, pending, failed or changed; manually reviewed ones are left out.

    ``previous`` has status too. Names are compared in lower case. ``only``:
    columns of ``current`` (schema, type, name) and the value they must have,
    in any case; % and _ stand for any characters.
    """
    for column, like in only.items():
        current = current.filter(F.lower(column).like(like.lower()))
    p = previous.select(F.lower(key).alias("_k"), F.col(hash_col).alias("_h"), F.col("status").alias("_s"))
    j = current.join(p, F.lower(key) == F.col("_k"), "left")
    reason = F.when(F.col("_k").isNull(), "new").when(F.col("_s") == "reviewed", None).when(F.col("_s").isin("pending", "failed"), F.col("_s")).when(F.col("_h") != F.col(hash_col), "changed")
    return j.withColumn("reason", reason).filter("reason is not null").drop("_k", "_h", "_s")


def compat_score(results: DataFrame, *by: str) -> DataFrame:
    """pass, fail, skip and score (percent of passes among what wasn't skipped; null where all was)."""
    s = F.col("status")
    c = results.groupBy(*by).agg(F.count_if(s == "pass").alias("passed"), F.count_if(s.startswith("fail")).alias("failed"), F.count_if(s == "skip").alias("skipped"))
    n = F.col("passed") + F.col("failed")
    return c.withColumn("score", F.when(n > 0, F.bround(100 * F.col("passed") / n, 1)))


def score_delta(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    b = before.select(key, F.col("score").alias("previous"))
    return now.select(key, "score").join(b, key, "left").withColumn("delta", F.bround(F.col("score") - F.col("previous"), 1))


#: Categories of root causes and their patterns, in the order of testing; the last is the default.
CAUSES = [
    ("prompt deficiency", r"(?i)(empty|placeholder|todo|not implemented)"),
    ("type mapping gap", r"(?i)type .*(does not exist|unknown|undefined)"),
    ("function mapping gap", r"(?i)(function .*does not exist|unknown function|undefined function)"),
    ("procedural pattern not handled", r"(?i)syntax error.*(BEGIN|DECLARE|LOOP|RAISE)"),
    ("dependency resolution failure", r"(?i)(relation|table|view) .*(does not exist|not found)"),
]


def root_cause(message: Column) -> Column:
    return F.coalesce(*[F.when(message.rlike(p), F.lit(c)) for c, p in CAUSES], F.lit("procedural pattern not handled"))


def ranked_causes(failures: DataFrame, key: str = "object_name", message: str = "error_message") -> DataFrame:
    """category, n and rank (most objects first, then by name) of each failing object: a category's list is its rows."""
    f = failures.select(key, root_cause(F.col(message)).alias("category"))
    n = f.groupBy("category").agg(F.count("*").alias("n"))  # at most as many rows as categories
    return f.join(F.broadcast(n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "category")))), "category")


def rerun_merge(previous: DataFrame, rerun: DataFrame, key: str = "object_name") -> DataFrame:
    """Passes and skips stay; failures take the rerun's result, or count as fail-convert without one."""
    p = previous.join(rerun.select(key, F.col("status").alias("_new")), key, "left")
    kept = F.col("status").isin("pass", "skip")
    return p.withColumn("status", F.when(kept, F.col("status")).otherwise(F.coalesce("_new", F.lit("fail-convert")))).drop("_new")


def e2e_score(ddl: Column, data: Column | None, tests: Column | None, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> Column:
    """Weighted percent of the three rates (0 to 1). Without data the DDL rate alone counts; without tests .57 and .43."""
    if abs(sum(weights) - 1) > 0.01:
        raise ValueError("weights must sum to 1")
    a, b, c = weights
    data = F.lit(None).cast("double") if data is None else data
    tests = F.lit(None).cast("double") if tests is None else tests
    return F.bround(100 * F.when(data.isNull(), ddl).when(tests.isNull(), 0.57 * ddl + 0.43 * data).otherwise(a * ddl + b * data + c * tests), 1)


def assertion(df: DataFrame, kind: str, op: str, wanted: float) -> DataFrame:
    """rows or value of a result, compared: name, actual, passed."""
    actual = F.count("*").cast("double") if kind == "rows" else F.first(F.col(df.columns[0])).cast("double")
    a = df.agg(actual.alias("actual"))
    c, w = F.col("actual"), F.lit(float(wanted))
    return a.withColumn("passed", {">": c > w, ">=": c >= w, "<": c < w, "<=": c <= w, "=": c == w}[op])


def assert_no_error(spark: SparkSession, name: str, make) -> DataFrame:
    """name, actual (0, or 1 where making or running the frame fails), passed and message of one check."""
    try:
        make().write.format("noop").mode("overwrite").save()
        row = (name, 0.0, True, None)
    except (PySparkException, Py4JJavaError) as e:
        row = (name, 1.0, False, str(e).split("\n")[0][:500])
    return spark.createDataFrame([row], "name string, actual double, passed boolean, message string")


def residue(text: Column) -> Column:
    """First leftover of the source dialect, or null."""
    found = [("GETDATE", r"(?i)\bGETDATE\s*\("), ("ISNULL", r"(?i)\bISNULL\s*\("), ("TOP", r"(?i)\bSELECT\s+TOP\b"), ("bracket", r"\[[A-Za-z_]+\]"), ("GO", r"(?im)^\s*GO\s*$"), ("NOLOCK", r"(?i)\bNOLOCK\b")]
    return F.coalesce(*[F.when(text.rlike(p), F.lit(n)) for n, p in found])


def unbalanced(text: Column) -> Column:
    """More of one parenthesis than of the other, or an odd number of quotes, outside string literals."""
    bare = F.regexp_replace(text, r"'[^']*'", "")
    count = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
    return (count("(") != count(")")) | (count("'") % 2 == 1)


#: How a converted script may begin.
STARTS = [
    r"CREATE\s+(OR\s+REPLACE\s+)?(TABLE|VIEW|FUNCTION|PROCEDURE|TRIGGER|INDEX|SCHEMA|TYPE|SEQUENCE|EXTENSION)",
    r"ALTER\s+(TABLE|VIEW|FUNCTION|PROCEDURE|TRIGGER|SCHEMA|TYPE|SEQUENCE)",
    r"DROP\s+(TABLE|VIEW|FUNCTION|PROCEDURE|TRIGGER|INDEX|SCHEMA|TYPE|SEQUENCE)",
    r"DO\s+\$",
    r"BEGIN\s*;",
    r"COMMENT\s+ON",
    r"GRANT\s+",
    r"REVOKE\s+",
    r"SET\s+",
    r"INSERT\s+INTO",
    r"CREATE\s+(UNIQUE\s+)?INDEX",
]
#: Leftovers of the source dialect on a line, in the order of testing, and what is said of them.
LEFTOVERS = [
    (r"\bGO\b\s*$", "T-SQL batch separator 'GO' detected"),
    (r"\bSET\s+NOCOUNT\b", "T-SQL 'SET NOCOUNT' detected"),
    (r"\bDECLARE\s+@", "T-SQL variable declaration with '@' prefix detected"),
    (r"\bEXEC\s+sp_", "T-SQL system stored procedure call detected"),
    (r"\[\w+\]\.\[", "T-SQL bracket-quoted identifier detected"),
    (r"\bNVARCHAR\b", "T-SQL data type 'NVARCHAR' detected (use VARCHAR in PostgreSQL)"),
    (r"\bDATETIME\b", "T-SQL data type 'DATETIME' detected (use TIMESTAMP in PostgreSQL)"),
    (r"\bUNIQUEIDENTIFIER\b", "T-SQL data type 'UNIQUEIDENTIFIER' detected (use UUID in PostgreSQL)"),
    (r"\bIDENTITY\s*\(", "T-SQL IDENTITY column detected (use SERIAL or GENERATED in PostgreSQL)"),
]


def _lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def script_finding(text: Column) -> Column:
    """First thing wrong with a converted script as (message, line), or null.

    In this order: nothing in it; parentheses (counted outside literals: at the
    line of the first one too many, or at the last line); a literal without an
    end (at its first line); a start that no statement has; leftovers.
    """
    found = lambda message, line: F.struct(F.lit(message).alias("message"), line.cast("int").alias("line"))
    # whole literals go, but for their line ends; an open one takes what follows
    whole = F.regexp_replace(text, r"'(?:[^']|'')*'", "\u0001")
    hidden = F.regexp_extract_all(text, F.lit(r"('(?:[^']|'')*')"))
    ends = F.transform(hidden, lambda x: F.repeat(F.lit("\n"), _lines(x) - 1))
    parts = F.split(whole, "\u0001")
    plain = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(ends, i), F.lit("")))), "")
    code = F.substring_index(plain, "'", 1)
    signs = F.transform(F.split(code, ""), lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0))
    state = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("line"), F.lit(None).cast("int").alias("bad"))
    chars = F.arrays_zip(F.split(code, "").alias("c"), signs.alias("s"))

    def step(a, x):
        depth = a.depth + x.s
        line = a.line + F.when(x.c == "\n", 1).otherwise(0)
        return F.struct(depth.alias("depth"), line.alias("line"), F.coalesce(a.bad, F.when(depth < 0, line)).alias("bad"))

    walk = F.aggregate(F.filter(chars, lambda x: (x.s != 0) | (x.c == "\n")), state, step)
    counts = F.struct(walk.depth.alias("depth"), walk.bad.alias("bad"), _lines(text).alias("last"), F.when(plain.contains("'"), _lines(code)).alias("open"))
    rows = F.split(text, "\n")
    left = [F.when(F.exists(rows, lambda r: r.rlike("(?i)" + p)), found(m, F.array_position(F.transform(rows, lambda r: r.rlike("(?i)" + p)), F.lit(True)))) for p, m in LEFTOVERS]  # noqa: B023
    one = F.lit(1)
    start = F.trim(F.regexp_replace(text, r"^\s+", "")).rlike("(?i)^(" + "|".join(STARTS) + ")")
    wrong = lambda c: (
        F.when(c.bad.isNotNull(), found("Unbalanced parentheses detected", c.bad))
        .when(c.depth != 0, found("Unbalanced parentheses detected", c.last))
        .when(c.open.isNotNull(), found("Unclosed string literal detected", c.open))
        .when(~start, found("DDL does not start with a valid PostgreSQL statement keyword", one))
        .otherwise(F.coalesce(*left))
    )
    return F.when(F.coalesce(F.trim(F.regexp_replace(text, r"\s+", "")), F.lit("")) == "", found("DDL statement is empty or null", one)).otherwise(F.transform(F.array(counts), wrong)[0])


def route(kind: Column, text: Column, override: Column | None = None) -> Column:
    """rule or assisted: an override first; procedures, functions and triggers need assistance; views only with dialect features."""
    by_kind = F.when(kind.isin("procedure", "function", "trigger"), "assisted").when((kind == "view") & text.rlike(r"(?i)\b(APPLY|PIVOT|FOR\s+XML|OPENJSON)\b"), "assisted").otherwise("rule")
    return by_kind if override is None else F.coalesce(override, by_kind)


def confidence_flag(confidence: Column, threshold: float = 0.7) -> Column:
    """status (converted, or flagged below the threshold) and the reason of a flag; an unknown confidence is flagged."""
    low = ~F.coalesce(confidence >= threshold, F.lit(False))
    reason = F.concat(F.lit("AI confidence ("), F.coalesce(F.format_number(confidence, 2), F.lit("unknown")), F.lit(f") is below threshold ({threshold:.2f})"))
    return F.struct(F.when(low, "flagged").otherwise("converted").alias("status"), F.when(low, reason).alias("reason"))


#: States of a conversion that count as done.
DONE = ["converted", "flagged", "reviewed", "out-of-scope"]


def conversion_report(entries: DataFrame) -> DataFrame:
    """``entries``: status, method, object_type. section, name and value: counts by status, method and type, all objects, and progress (percent done, half to even).

    One pass: rows are counted by the three together before they are summed up.
    """
    few = entries.groupBy("status", "method", "object_type").agg(F.count("*").alias("n"))
    by = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(c).alias("name")) for s, c in (("status", "status"), ("method", "method"), ("type", "object_type"))]))
    counts = few.select("n", by.alias("x")).groupBy("x.section", "x.name").agg(F.sum("n").cast("double").alias("value"))
    n = few.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("status").isin(DONE), F.col("n"))), F.lit(0)).alias("done"))
    share = F.when(F.col("n") == 0, 0.0).otherwise(F.bround(100 * F.col("done") / F.col("n"), 1))
    whole = n.select(F.explode(F.array(F.struct(F.lit("objects").alias("name"), F.col("n").cast("double").alias("value")), F.struct(F.lit("progress").alias("name"), share.alias("value")))).alias("x"))
    return counts.unionByName(whole.select(F.lit("summary").alias("section"), "x.name", "x.value"))


def conversion_notes(entries: DataFrame) -> DataFrame:
    """``entries``: notes (array of (category, description)). Each different note once, and how many objects have it."""
    return entries.select("object_name", F.explode(F.array_distinct("notes")).alias("n")).groupBy("n.category", "n.description").agg(F.count("*").alias("objects"))


def flagged_objects(entries: DataFrame) -> DataFrame:
    """Entries that are flagged or have a review flag."""
    return entries.filter((F.col("status") == "flagged") | (F.size("flags") > 0))


def batch_summary(runs: DataFrame, results: DataFrame, key: str = "database_name") -> DataFrame:
    """A row for each run of ``runs`` (key, error): objects, passed, failed, score and state.

    A run with an error, or without results, is ERROR and has no score; others
    are not affected: N/A where all was skipped, WARN with failures, else OK.
    """
    c = runs.join(compat_score(results, key), key, "left")
    objects = F.coalesce(F.col("passed") + F.col("failed") + F.col("skipped"), F.lit(0))
    broken = F.col("error").isNotNull() | F.col("passed").isNull()
    state = F.when(broken, "ERROR").when(F.col("skipped") == objects, "N/A").when(F.col("failed") > 0, "WARN").otherwise("OK")
    zero = lambda n: F.when(broken, 0).otherwise(F.col(n)).cast("long").alias(n)
    return c.select(key, F.when(broken, 0).otherwise(objects).cast("long").alias("objects"), zero("passed"), zero("failed"), F.when(~broken, F.col("score")).alias("score"), state.alias("state"))


#: Order in which object types are applied.
APPLY_ORDER = ["table", "view", "function", "procedure", "trigger"]


def type_rank(kind: Column, order: list[str] | None = None) -> Column:
    order = order or APPLY_ORDER
    return F.coalesce(*[F.when(kind == k, F.lit(i)) for i, k in enumerate(order)], F.lit(len(order)))


def apply_order(objects: DataFrame, depends: DataFrame) -> DataFrame:
    """object_name, wave and place of each object: what it needs first, then by type and name; cycles come last.

    ``objects``: object_name, object_type; ``depends``: src needs dst. Unknown
    names are ignored.
    """
    edges = depends.select("src", "dst")
    waves = dependency_waves(objects.select(F.col("object_name").alias("node")), edges).withColumnRenamed("node", "object_name")
    o = objects.join(waves, "object_name").withColumn("_rank", type_rank(F.col("object_type")))
    return numbered(o, [F.asc_nulls_last("wave"), F.asc("_rank"), F.asc("object_name")], "place").select("object_name", "wave", F.col("place").cast("long").alias("place"))


#: Object types, and the types that each configuration file concerns, by the pattern of its name.
ALL_TYPES = ["function", "procedure", "table", "trigger", "view"]
CONFIG_FILES = [
    (r"^(type|function|schema)-mappings\.json$", ALL_TYPES),
    (r"^stored-procedure\..*\.md$", ["procedure"]),
    (r"^function\..*\.md$", ["function"]),
    (r"^view\..*\.md$", ["view"]),
    (r"^trigger\..*\.md$", ["trigger"]),
    (r"^complex-object\..*\.md$", ALL_TYPES),
]


def changed_types(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Object types that added, removed or changed configuration files (file_name, sha) concern."""
    p = previous.select("file_name", F.col("sha").alias("_was"))
    j = current.select("file_name", "sha").join(p, "file_name", "full").filter(~F.col("sha").eqNullSafe(F.col("_was")))
    kinds = F.coalesce(*[F.when(F.col("file_name").rlike(x), F.array(*[F.lit(k) for k in kinds])) for x, kinds in CONFIG_FILES])
    return j.select(F.explode(kinds).alias("object_type")).distinct()


#: Category of each object type in the order of scripts; wrappers are 8, other types last.
SCRIPT_ORDER = {"schema": 0, "type": 1, "sequence": 2, "table": 3, "constraint": 3, "index": 4, "function": 5, "procedure": 5, "trigger": 6, "view": 7, "synonym": 7, "permission": 9}


def script_order(objects: DataFrame, depends: DataFrame, wrapped: Column) -> DataFrame:
    """object_name, is_wrapper and place of each script: by category, dependencies inside it, name.

    ``objects``: object_name, object_type; ``depends``: src, dst. Where
    ``wrapped`` holds there is a wrapper script besides the main one.
    """
    category = F.coalesce(*[F.when(F.col("object_type") == k, F.lit(i)) for k, i in SCRIPT_ORDER.items()], F.lit(10))
    o = objects.withColumn("category", category).withColumn("_wrapped", wrapped)
    src, dst = (o.select(F.lower("object_name").alias(k), F.col("category").alias(f"c_{k}")) for k in ("src", "dst"))
    edges = depends.select(F.lower("src").alias("src"), F.lower("dst").alias("dst")).distinct()
    inside = edges.join(src, "src").join(dst, "dst").filter("c_src = c_dst").groupBy("src").agg(F.count("*").alias("n"))
    main = o.join(inside, F.lower("object_name") == F.col("src"), "left").select("object_name", F.lit(False).alias("is_wrapper"), "category", F.coalesce("n", F.lit(0)).alias("n"))
    wrapper = o.filter("_wrapped").select("object_name", F.lit(True).alias("is_wrapper"), F.lit(8).alias("category"), F.lit(0).cast("long").alias("n"))
    return numbered(main.unionByName(wrapper), [F.asc("category"), F.asc("n"), F.asc("object_name")], "place").select("object_name", "is_wrapper", "place")
