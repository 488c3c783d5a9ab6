"""Tables in and out: Parquet and JDBC with explicit columns, scripts, sessions, reports and audit logs."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, source: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table of a Parquet folder; only the named columns are read."""
    df = spark.read.parquet(f"{source}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, columns: list[str], key: str | None = None, bounds: tuple | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database table, read in ``parts`` ranges of a numeric or date key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize="10000", **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load().select(*columns)


def write_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 1000, truncate_first: bool = False, **options: str) -> None:
    """Batched inserts; with ``truncate_first`` the table keeps its definition and loses its rows, those of tables that refer to it too."""
    first = str(truncate_first).lower()
    writer = df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch_size), truncate=first, cascadeTruncate=first, **options)
    writer.mode("overwrite" if truncate_first else "append").save()


def read_session(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """One JSON object per file: path and the columns of ``schema``, and the paths that were skipped because they don't hold such an object.

    A warning says how many were skipped.
    """
    files = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("_text"))
    read = F.from_json("_text", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = files.withColumn("_o", read)
    bad = F.col("_o._bad").isNotNull() | F.col("_o").isNull()
    skipped = rows.filter(bad).select("path")
    n = skipped.count()
    if n:
        warnings.warn(f"{n} session files were skipped", stacklevel=2)
    return rows.filter(~bad).select("path", "_o.*").drop("_bad"), skipped


def split_batches(scripts: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Scripts cut at lines that only say GO: path, no, batch; empty batches are left out."""
    parts = scripts.select(path_col, F.posexplode(F.split(text_col, r"(?im)^[ \t]*GO[ \t]*\r?$")).alias("no", "batch"))
    return parts.withColumn("batch", F.trim(F.regexp_replace("batch", r"^\s+|\s+$", ""))).filter("batch != ''")


def read_ddl_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return split_batches(files)


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """A report as JSON lines: section, and its rows as they are. Sections of any size are written by all tasks."""
    out = None
    for name, df in sections.items():
        rows = df.select(F.lit(name).alias("section"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    out.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    """The rows of a section of a report that ``write_report`` wrote."""
    rows = spark.read.schema("section string, row string").json(path).filter(F.col("section") == section)
    return rows.select(F.from_json("row", schema).alias("r")).select("r.*")


#: Bytes after which a new audit file begins.
AUDIT_BYTES = 50 * 1024 * 1024


def append_audit(df: DataFrame, path: str, most_bytes: int = AUDIT_BYTES) -> None:
    """Append-only JSON lines, in files of about ``most_bytes``: rows are dealt into as many files as their bytes call for, and none gets more rows than fit."""
    lines = df.select(F.to_json(F.struct("*")).alias("value"))
    size = lines.agg(F.sum(F.octet_length("value") + 1).alias("b"), F.count("*").alias("n"), F.max(F.octet_length("value") + 1).alias("m")).first()
    if not size.n:
        return
    files = -(-size.b // most_bytes)
    rows = max(1, most_bytes * size.n // size.b)
    lines.repartition(int(files)).write.mode("append").option("maxRecordsPerFile", int(rows)).text(path)


def workload_store(texts: DataFrame, queries: DataFrame, plans: DataFrame, stats: DataFrame) -> DataFrame:
    """Captured statements of a query store: microseconds become milliseconds, hashes 0x text."""
    j = texts.join(queries, "text_id").join(plans, "query_id").join(stats, "plan_id")
    return j.select("query_id", "sql_text", F.concat(F.lit("0x"), F.hex("query_hash")).alias("query_hash"), "plan_id", "executions", (F.col("duration_us") / 1000).alias("avg_duration_ms"), (F.col("cpu_us") / 1000).alias("cpu_ms"), "logical_reads").distinct()


#: Event types that carry a statement.
EVENT_TYPES = ["sql_batch_completed", "sql_batch_starting", "rpc_completed", "rpc_starting", "sql_statement_completed", "sql_statement_starting", "sp_statement_completed", "sp_statement_starting", "module_end", "error_reported"]
#: Longest statement, longest parameter value, most parameters.
TEXT_LIMIT, VALUE_LIMIT, PARAMETER_LIMIT = 65_536, 4_000, 128


def _field(name: str, kind: str = "data") -> Column:
    return F.expr(f"""nullif(xpath_string(event_xml, 'event/{kind}[@name="{name}"][last()]/value'), '')""")


#: An event as one parse sees it, and texts that only the XPath form reads rightly: other roots, comments, CDATA, instructions.
_EVENT = "_name string, _timestamp string, " + ", ".join(f"{kind} array<struct<_name: string, value: array<string>>>" for kind in ("data", "action"))
_PLAIN = r"^<event[\s>]"


def _parsed_field(event: Column, name: str, kind: str = "data") -> Column:
    """The same as ``_field``, of a parsed event; a value with markup of its own, or a "<", is read by XPath."""
    value = F.get(F.get(F.reverse(F.filter(event[kind], lambda f: f["_name"] == name)), F.lit(0))["value"], F.lit(0))
    return F.when(value.contains("<"), _field(name, kind)).otherwise(F.nullif(value, F.lit("")))


def _parameters() -> Column:
    """Array of (name, type, value) of a procedure call: at most PARAMETER_LIMIT, values cut at VALUE_LIMIT; without a name @p and their number, without a type unknown."""
    block = lambda name: F.regexp_extract("event_xml", rf"(?s)<data name=['\"]{name}['\"][^>]*>\s*<value>(.*?)</value>", 1)
    once = lambda x, use: F.get(F.transform(F.array(x), use), F.lit(0))
    inner = once(block("parameters"), lambda b: F.when(b != "", b).otherwise(block("input_parameters")))
    found = once(inner, lambda b: F.when(b != "", F.from_xml(F.concat(F.lit("<v>"), b, F.lit("</v>")), "parameter array<struct<_name: string, _type: string, _VALUE: string>>").getField("parameter")))
    one = lambda p, i: F.struct(F.coalesce(p["_name"], F.concat(F.lit("@p"), i)).alias("name"), F.coalesce(p["_type"], F.lit("unknown")).alias("type"), F.left(F.coalesce(p["_VALUE"], F.lit("")), F.lit(VALUE_LIMIT)).alias("value"))
    return F.transform(F.slice(F.coalesce(found, F.array().cast("array<struct<_name:string,_type:string,_VALUE:string>>")), 1, PARAMETER_LIMIT), one)


def shred_events(events: DataFrame) -> DataFrame:
    """``event_xml`` to columns; events of other types, or without a statement, are left out. An event is parsed once."""

    def shred(name: Column, time: Column, field) -> Column:
        text = F.coalesce(field("statement"), field("batch_text"), field("sql_text", "action"))
        numbers = [field(c).try_cast("long").alias(n) for n, c in (("duration_us", "duration"), ("cpu_us", "cpu_time"), ("logical_reads", "logical_reads"))]
        texts = [field("object_name").alias("object_name"), field("database_name", "action").alias("database_name"), field("username", "action").alias("principal")]
        row = F.struct(name.alias("event_name"), time.alias("event_time"), F.substring(text, 1, TEXT_LIMIT).alias("sql_text"), *numbers, *texts, _parameters().alias("params"))
        return F.when(name.isin(EVENT_TYPES), row)

    plain = F.col("event_xml").rlike(_PLAIN) & ~F.col("event_xml").contains("<!") & ~F.col("event_xml").contains("<?")
    event = F.from_xml("event_xml", _EVENT, {"ignoreSurroundingSpaces": "false", "mode": "FAILFAST"})
    # lambdas: a parsed event is used many times, and computed once
    parsed = F.transform(F.array(event), lambda e: shred(F.coalesce(e["_name"], F.lit("")), F.coalesce(e["_timestamp"], F.lit("")), lambda name, kind="data": _parsed_field(e, name, kind)))
    named = F.col("event_xml").rlike("|".join(EVENT_TYPES)) | F.col("event_xml").contains("&")  # an entity may hide a name
    path = lambda a: F.expr(f"xpath_string(event_xml, 'event/@{a}')")
    found = F.when(plain & ~named, None).when(plain, parsed).otherwise(F.array(shred(path("name"), path("timestamp"), _field)))
    return events.select(F.explode(F.filter(found, lambda r: r["sql_text"].isNotNull())).alias("r")).select("r.*")


def captured(events: DataFrame, params: str = "params", name: str = "proc_name") -> DataFrame:
    """Statements with their hash; a procedure call is rebuilt from its parameters where that says more."""
    some = F.slice(F.col(params), 1, PARAMETER_LIMIT)
    call = F.concat(F.lit("EXEC "), F.col(name), F.lit(" "), F.array_join(F.transform(some, lambda p: F.concat(p["name"], F.lit(" = '"), F.substring(p["value"], 1, VALUE_LIMIT), F.lit("'"))), ", "))
    text = F.when(F.length(call) > F.length("sql_text"), call).otherwise(F.col("sql_text"))
    return events.withColumn("sql_text", text).withColumns({"query_hash": F.upper(F.substring(F.sha2("sql_text", 256), 1, 16)), "execution_count": F.lit(1).cast("long")})


def fold_columns(rows: DataFrame, keys: list[str], ordinal: str, column: str, name: str) -> DataFrame:
    """Catalog child rows (index or key columns) to one row with the ordered list of columns."""
    listed = F.array_sort(F.collect_list(F.struct(ordinal, column)))
    return rows.groupBy(*keys).agg(F.transform(listed, lambda x: x[column]).alias(name))


#: Schemas of the source that aren't a user's.
SYSTEM_SCHEMAS = ["sys", "INFORMATION_SCHEMA", "guest", "db_owner", "db_accessadmin", "db_securityadmin", "db_ddladmin", "db_backupoperator", "db_datareader", "db_datawriter", "db_denydatareader", "db_denydatawriter"]


def read_catalog(catalog: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Catalog tables to one frame for each kind of object; children are folded into lists by their ordinal, system schemas are left out.

    ``catalog``: tables (schema_name, table_name), columns (schema_name,
    table_name, ordinal, column_name, data_type, is_nullable), index_columns
    (schema_name, table_name, index_name, index_type, is_unique, ordinal,
    column_name), foreign_key_columns (schema_name, table_name, key_name,
    parent_schema, parent_table, ordinal, column_name, parent_column), modules
    (schema_name, object_name, object_type, body) and synonyms (schema_name,
    synonym_name, base_object). Kinds that aren't given are left out.
    """
    kinds = ["tables", "columns", "index_columns", "foreign_key_columns", "modules", "synonyms"]
    own = {k: catalog[k].filter(~F.lower("schema_name").isin([x.lower() for x in SYSTEM_SCHEMAS])) for k in kinds if k in catalog}

    def fold(df: DataFrame, keys: list[str], name: str, *columns: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("ordinal", *columns)))
        return df.groupBy(*keys).agg(F.transform(rows, lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(name))

    out = {}
    if "tables" in own:
        at = ["schema_name", "table_name"]
        columns = fold(own["columns"], at, "columns", "column_name", "data_type", "is_nullable")
        out["tables"] = own["tables"].join(columns, at, "left")
    if "index_columns" in own:
        out["indexes"] = fold(own["index_columns"], ["schema_name", "table_name", "index_name", "index_type", "is_unique"], "columns", "column_name")
    if "foreign_key_columns" in own:
        out["foreign_keys"] = fold(own["foreign_key_columns"], ["schema_name", "table_name", "key_name", "parent_schema", "parent_table"], "columns", "column_name", "parent_column")
    return out | {k: own[k] for k in ("modules", "synonyms") if k in own}


#: Categories of server features, in the order of reports.
FEATURE_CATEGORIES = ["SQL CLR", "Service Broker", "Agent Jobs", "CDC", "Change Tracking", "Replication", "Linked Servers", "Full Text Search", "FileStream", "XML Indexes", "Temporal Tables", "Memory Optimized", "Partitioning"]
#: Category, catalog table, and the rows of it that count.
FEATURE_SOURCES = [
    ("SQL CLR", "assemblies", "is_user_defined = 1"),
    ("Service Broker", "service_queues", "lower(schema_name) != 'sys'"),
    ("Service Broker", "services", "name not like 'http://%' and name not like 'InternalMailQueue%' and name != 'ExternalMailQueue'"),
    ("Service Broker", "service_contracts", "name not like 'http://%' and name != 'DEFAULT'"),
    ("Agent Jobs", "job_steps", "database_name = current_database_name"),
    ("CDC", "tables", "is_tracked_by_cdc = 1"),
    ("Change Tracking", "change_tracking_tables", "true"),
    ("Replication", "articles", "true"),
    ("Replication", "publications", "true"),
    ("Replication", "subscriptions", "true"),
    ("Linked Servers", "server_references", "server_id != 0"),
    ("Full Text Search", "fulltext_catalogs", "true"),
    ("Full Text Search", "fulltext_indexes", "true"),
    ("Full Text Search", "fulltext_index_columns", "true"),
    ("FileStream", "data_spaces", "type = 'FD'"),
    ("FileStream", "tables", "filestream_data_space_id != 0"),
    ("XML Indexes", "xml_indexes", "true"),
    ("Temporal Tables", "tables", "temporal_type != 0"),
    ("Memory Optimized", "tables", "is_memory_optimized = 1"),
    ("Memory Optimized", "modules", "uses_native_compilation = 1"),
    ("Partitioning", "partition_schemes", "true"),
    ("Partitioning", "partition_functions", "true"),
]


def feature_counts(spark: SparkSession, catalog: dict[str, DataFrame]) -> DataFrame:
    """category, n and accessible for all server feature categories, absent ones with 0.

    ``catalog``: catalog tables by name. A category whose tables couldn't be
    read, all or some, isn't accessible; what could be read is counted.
    """
    order = spark.createDataFrame([(i, c, all(s in catalog for k, s, _ in FEATURE_SOURCES if k == c)) for i, c in enumerate(FEATURE_CATEGORIES)], "ordinal int, category string, accessible boolean")
    hits = [catalog[s].filter(rule).groupBy(F.lit(c).alias("category")).agg(F.count("*").alias("n")) for c, s, rule in FEATURE_SOURCES if s in catalog]
    counted = reduce(DataFrame.unionByName, hits, spark.createDataFrame([], "category string, n long")).groupBy("category").agg(F.sum("n").alias("n"))
    return order.join(counted, "category", "left").select("ordinal", "category", F.coalesce("n", F.lit(0)).alias("n"), "accessible")
