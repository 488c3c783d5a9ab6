"""Schema findings, statements attributed to objects, object inventory, and checks of work items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryline.operators.assess import RANGE_RATIO, conversion, strip_params
from ferryline.operators.rationale import NO_NOTE, NOTES
from ferryline.operators.relational import numbered
from ferryline.operators.staging import Appended, written

#: Target type and risk of the types that need a finding.
TYPE_FINDINGS = {"UNIQUEIDENTIFIER": ("UUID", 2), "DATETIME": ("TIMESTAMPTZ", 2), "SMALLDATETIME": ("TIMESTAMPTZ", 2), "DATETIME2": ("TIMESTAMPTZ", 1), "BIT": ("BOOLEAN", 1), "IMAGE": ("BYTEA", 2), "MONEY": ("NUMERIC(19,4)", 2), "SMALLMONEY": ("NUMERIC(10,4)", 2), "TINYINT": ("SMALLINT", 1)}
#: Hours (least, most) of a finding by risk, 5 as well for what is above.
FINDING_HOURS = {1: (0.1, 0.25), 2: (0.1, 0.25), 3: (0.25, 0.75), 4: (0.5, 2.0), 5: (1.0, 4.0)}
#: Fixed value: statements shorter than this aren't attributed.
LEAST_CHARS = 20
#: Characters of the runs that texts are looked up by.
RUN = 12


def column_findings(data_type: Column, max_length: Column, identity: Column, computed: Column) -> Column:
    """Array of (issue, risk, target) of one column of a table."""
    kind = F.upper(F.trim(F.split_part(data_type, F.lit("("), F.lit(1))))
    one = lambda issue, risk, target: F.struct(F.lit(issue).alias("issue"), F.lit(risk).alias("risk"), (target if isinstance(target, Column) else F.lit(target)).alias("target"))
    low = F.upper(data_type)
    mapped = [F.when(kind == k, one("DataType", risk, target)) for k, (target, risk) in TYPE_FINDINGS.items()]
    largest = F.when((max_length == -1) | low.contains("MAX"), one("DataType", 2, F.when(low.contains("BINARY"), "BYTEA").otherwise("TEXT")))
    collated = F.when(low.contains("CHAR") | low.contains("TEXT"), one("Collation", 3, "citext"))
    return F.array_compact(F.array(F.coalesce(*mapped, largest), F.when(identity, one("Identity", 2, "GENERATED ALWAYS AS IDENTITY")), F.when(F.trim(computed) != "", one("ComputedColumn", 3, "STORED")), collated))


def schema_findings(columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """``columns``: object, data_type, max_length, is_identity, computed; ``indexes``: object, index_type. object, issue, risk, target."""
    found = F.explode(column_findings(F.col("data_type"), F.col("max_length"), F.col("is_identity"), F.col("computed")))
    clustered = indexes.filter(F.upper("index_type") == "CLUSTERED")
    return columns.select("object", found.alias("f")).select("object", "f.*").unionByName(clustered.select("object", F.lit("ClusteredIndex").alias("issue"), F.lit(3).alias("risk"), F.lit("CLUSTER").alias("target")))


def schema_effort(findings: DataFrame) -> DataFrame:
    """Findings, and hours rounded up: at least 1 and 2, or none without findings."""
    c = findings.agg(F.count("*").alias("findings"), *[F.count_if(F.least("risk", F.lit(5)) == r).alias(f"r{r}") for r in FINDING_HOURS])
    hours = lambda i: F.ceil(F.round(sum((F.col(f"r{r}") * h[i] for r, h in FINDING_HOURS.items()), F.lit(0.0)), 6)).cast("int")
    none = F.col("findings") == 0
    return c.select("findings", F.when(none, 0).otherwise(F.greatest(F.lit(1), hours(0))).alias("min_hours"), F.when(none, 0).otherwise(F.greatest(F.lit(2), hours(1))).alias("max_hours"))


def one_line(sql: Column) -> Column:
    """Parameters stripped, white space one blank, upper case."""
    return F.upper(F.trim(F.regexp_replace(strip_params(sql), r"\s+", " ")))


def _once(x: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _marks(text: Column) -> Column:
    """The marks of a text of ``LEAST_CHARS`` characters or more: of each ``LEAST_CHARS`` neighbours the smallest hash of their runs of ``RUN``.

    Two texts that share ``LEAST_CHARS`` neighbouring characters share a mark;
    about one in five characters begins one.
    """
    wide = LEAST_CHARS - RUN + 1
    places = lambda chars, n: F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1)))
    runs = lambda chars: F.transform(places(chars, RUN), lambda i: F.xxhash64(F.array_join(F.slice(chars, i, RUN), "")))
    least = lambda chars, r: F.array_distinct(F.transform(places(chars, LEAST_CHARS), lambda i: F.array_min(F.slice(r, i, wide))))
    return _once(F.split(text, ""), lambda chars: _once(runs(chars), lambda r: least(chars, r)))


def _marked(df: DataFrame, text: str) -> DataFrame:
    return df.filter(F.length(text) >= LEAST_CHARS).withColumn("_marks", _marks(F.col(text)))


#: Objects that a text is compared with first, and how much larger each further block is.
FIRST_BLOCK, LARGER = 64, 4


def resolve_objects(statements: DataFrame, objects: DataFrame, sql_col: str = "sql_text") -> DataFrame:
    """The statements and object_name: the first object (by ordinal) whose body contains the text, else null.

    ``objects``: ordinal (each once), object_name, body. Each different text is
    looked up once, and of equal bodies the first stands for all. A body that
    contains a text has all of its marks: the rarest of them leads a text to the
    bodies to compare it with. Bodies are tried in blocks, in order of their
    ordinals; a text that is found goes no further, so one that all bodies hold
    meets a first block only. Blocks grow, so their number follows the logarithm
    of the bodies'. Texts of under ``LEAST_CHARS`` characters, and null ones,
    get none. Statements meet their text by two hashes, as in ``tagged``.
    """
    named = {"_a": F.xxhash64(sql_col), "_b": F.xxhash64(F.lit(1), sql_col)}
    # written, else lines would be made for each statement and object, and again wherever they are filtered
    texts = written(statements.select(F.col(sql_col).alias("_sql")).distinct())
    texts = written(texts.select(F.xxhash64("_sql").alias("_a"), F.xxhash64(F.lit(1), "_sql").alias("_b"), one_line(F.col("_sql")).alias("_text")))
    first = F.min(F.struct("ordinal", "object_name")).alias("o")
    bodies = written(objects.filter("body is not null").groupBy("body").agg(first))
    bodies = bodies.select("o", one_line(F.col("body")).alias("_body")).groupBy("_body").agg(F.min("o").alias("o"))
    bodies = written(numbered(bodies.select("o.*", "_body"), [F.asc("ordinal")], "no", "all"))
    keys = written(_marked(bodies, "_body").select("no", F.explode("_marks").alias("key")))
    ways = _marked(texts.select("_text").distinct(), "_text").select("_text", F.size("_marks").alias("all"), F.explode("_marks").alias("key"))
    often = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("no").alias("last"))
    rarest = ways.join(often, "key").groupBy("_text").agg(F.count("*").alias("met"), F.max("all").alias("all"), F.min(F.struct("n", "key", "last")).alias("k"))
    left = written(rarest.filter("met = all").select("_text", "k.key", "k.last"))
    found = Appended(bodies.select(F.col("_body").alias("_text"), "object_name"))
    low, size = 0, FIRST_BLOCK
    while not left.isEmpty():
        block = lambda df: df.filter(F.col("no").between(low + 1, low + size))  # noqa: E731, B023
        near = left.join(block(keys), "key").select("_text", "no").join(block(bodies), "no").filter(F.col("_body").contains(F.col("_text")))
        hit = found.add(near.groupBy("_text").agg(F.min_by("object_name", "no").alias("object_name")))
        low, size = low + size, size * LARGER
        left = written(left.filter(F.col("last") > low).join(hit, "_text", "left_anti"))
    named_texts = written(texts.join(found.read(), "_text").select("_a", "_b", "object_name"))
    return statements.withColumns(named).join(named_texts, ["_a", "_b"], "left").drop("_a", "_b")


def object_inventory(resolved: DataFrame, objects: DataFrame) -> DataFrame:
    """statements, risk, tags and conversion of each object with statements; the rest is "Ad Hoc" (ad_hoc sorts it last).

    Objects without a readable body have risk 3 and are converted by hand.
    """
    name = F.coalesce("object_name", F.lit("Ad Hoc"))
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("features", lambda f: f.tag)))))  # sets of known tags only
    seen = resolved.groupBy(name.alias("object_name"), F.col("object_name").isNull().alias("ad_hoc")).agg(F.count("*").alias("statements"), F.max("risk").alias("risk"), tags.alias("tags")).withColumn("conversion", conversion(F.col("risk")))
    opaque = objects.filter("body is null").select("object_name", F.lit(False).alias("ad_hoc"), F.lit(0).cast("long").alias("statements"), F.lit(3).alias("risk"), F.array().cast("array<string>").alias("tags"), F.lit("manual").alias("conversion"))
    return seen.unionByName(opaque)


def confidence(risk: Column) -> Column:
    return F.when(risk <= 2, "High").when(risk == 3, "Medium").otherwise("Low")


def confidence_summary(items: DataFrame) -> DataFrame:
    """Items and hours by confidence, and the notes that all items' tags call for. Needs risk, tags, min_hours and max_hours."""
    hours = lambda c: F.sum(F.col(c).cast("decimal(18,4)")).cast("double").alias(c)
    has = lambda names: F.arrays_overlap("tags", F.array(*[F.lit(x) for x in names]))
    c = items.groupBy(confidence(F.col("risk")).alias("confidence")).agg(F.count("*").alias("items"), hours("min_hours"), hours("max_hours"), *[F.max(has(names)).alias(f"_{i}") for i, (names, _) in enumerate(NOTES)])
    every = Window.partitionBy(F.lit(0))  # three rows at most
    notes = F.concat_ws(" ", *[F.when(F.max(f"_{i}").over(every), note) for i, (_, note) in enumerate(NOTES)])
    return c.select("confidence", "items", "min_hours", "max_hours", F.when(notes == "", NO_NOTE).otherwise(notes).alias("notes"))


def item_warnings(items: DataFrame, inventory: DataFrame, item_col: str = "item") -> DataFrame:
    """One row for each warning: item, warning.

    ``items``: equivalent, object_name, tags, risk, min_hours, max_hours;
    ``inventory``: object_name, tags. Names are compared in lower case.
    """
    from ferryline.operators.validate import unbalanced

    known = inventory.select(F.lower("object_name").alias("_k"), F.col("tags").alias("_tags")).dropDuplicates(["_k"])
    j = items.join(known, F.lower("object_name") == F.col("_k"), "left")
    text, lo, hi = F.coalesce("equivalent", F.lit("")), F.col("min_hours"), F.col("max_hours")
    ratio = F.element_at(F.array(*[F.lit(r) for r in RANGE_RATIO.values()]), F.greatest(F.lit(1), F.least(F.lit(5), F.col("risk"))))
    blank = F.trim(text) == ""
    rules = [
        ("empty equivalent", blank),
        ("malformed equivalent", ~blank & unbalanced(text)),
        ("unknown object", F.col("_k").isNull()),
        ("no shared feature", (F.size("tags") > 0) & (F.size("_tags") > 0) & ~F.arrays_overlap("tags", "_tags")),
        ("negative hours", lo < 0),
        ("inverted hours", hi < lo),
        ("wide range", (lo > 0) & (hi / F.when(lo > 0, lo) > ratio)),
    ]
    return j.select(item_col, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))).alias("warning"))


def limited_items(items: DataFrame, order: list[Column], most: int, least_risk: int = 1) -> DataFrame:
    """The first ``most`` items of at least this risk: a report's limit."""
    if not 1 <= least_risk <= 5:
        raise ValueError("least_risk must be 1 to 5")
    return items.filter(F.col("risk") >= least_risk).orderBy(*order).limit(most)
