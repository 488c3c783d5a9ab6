"""A database's own catalog as the frames that ``tables.read_catalog`` takes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ferryline.operators.staging import written
from ferryline.sources.loads import transaction

#: By product, queries for the bodies of views, triggers and routines, and for synonyms; the column names are those of the frames.
MODULES = {
    "Apache Derby": """SELECT s.SCHEMANAME AS "schema_name", t.TABLENAME AS "object_name", 'VIEW' AS "object_type", v.VIEWDEFINITION AS "body" FROM SYS.SYSVIEWS v JOIN SYS.SYSTABLES t ON t.TABLEID = v.TABLEID JOIN SYS.SYSSCHEMAS s ON s.SCHEMAID = t.SCHEMAID
        UNION ALL SELECT s.SCHEMANAME AS "schema_name", r.TRIGGERNAME AS "object_name", 'TRIGGER' AS "object_type", r.TRIGGERDEFINITION AS "body" FROM SYS.SYSTRIGGERS r JOIN SYS.SYSSCHEMAS s ON s.SCHEMAID = r.SCHEMAID""",
    "Microsoft SQL Server": """SELECT s.name AS "schema_name", o.name AS "object_name", o.type_desc AS "object_type", m.definition AS "body" FROM sys.sql_modules m JOIN sys.objects o ON o.object_id = m.object_id JOIN sys.schemas s ON s.schema_id = o.schema_id""",
}
SYNONYMS = {
    "Microsoft SQL Server": """SELECT s.name AS "schema_name", y.name AS "synonym_name", y.base_object_name AS "base_object" FROM sys.synonyms y JOIN sys.schemas s ON s.schema_id = y.schema_id""",
}
SHAPES = {
    "tables": "schema_name string, table_name string",
    "columns": "schema_name string, table_name string, ordinal int, column_name string, data_type string, is_nullable boolean",
    "index_columns": "schema_name string, table_name string, index_name string, index_type string, is_unique boolean, ordinal int, column_name string",
    "foreign_key_columns": "schema_name string, table_name string, key_name string, parent_schema string, parent_table string, ordinal int, column_name string, parent_column string",
    "modules": "schema_name string, object_name string, object_type string, body string",
    "synonyms": "schema_name string, synonym_name string, base_object string",
}


def _rows(result, *columns: tuple[str, str]) -> Iterator[tuple]:
    while result.next():
        yield tuple(getattr(result, f"get{kind}")(name) for name, kind in columns)
    result.close()


def read_database(spark: SparkSession, url: str, modules: str | None = None, synonyms: str | None = None, most: int = 1_000_000, **options: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Frames of the catalog for ``read_catalog``, and what could not be read: kind, object, message.

    Tables, columns, indexes and foreign keys come from the driver's own
    metadata; bodies and synonyms from a query (``modules``, ``synonyms``, or
    that known for the product). A kind that can't be read at all is left out of
    the frames, a table whose indexes or keys can't be read is left out of
    those; either is one row of the second frame. Descriptions alone pass the
    Spark driver, ``most`` for each kind: more is an error.
    """
    found, failed = {}, []
    with transaction(spark, url, **options) as c:
        meta = c.getMetaData()
        product = meta.getDatabaseProductName()

        def kind(name: str, rows: Callable[[], Iterator[tuple]]) -> None:
            try:
                out = []
                for r in rows():
                    out.append(r)
                    if len(out) > most:
                        raise ValueError(f"over {most} rows")
                found[name] = out
            except Exception as e:  # noqa: BLE001  reported, by kind
                failed.append((name, None, str(e)[:500]))

        def each(name: str, rows: Callable[[str, str], Iterator[tuple]]) -> Iterator[tuple]:
            for schema, table in found.get("tables", []):
                try:
                    yield from list(rows(schema, table))
                except Exception as e:  # noqa: BLE001  reported, by table
                    failed.append((name, f"{schema}.{table}", str(e)[:500]))

        def columns() -> Iterator[tuple]:
            for s, t, at, name, type_, size, digits, nullable in _rows(meta.getColumns(None, None, "%", "%"), ("TABLE_SCHEM", "String"), ("TABLE_NAME", "String"), ("ORDINAL_POSITION", "Int"), ("COLUMN_NAME", "String"), ("TYPE_NAME", "String"), ("COLUMN_SIZE", "Int"), ("DECIMAL_DIGITS", "Int"), ("NULLABLE", "Int")):
                sized = {"CHAR": f"({size})", "VARCHAR": f"({size})", "NCHAR": f"({size})", "NVARCHAR": f"({size})", "DECIMAL": f"({size},{digits})", "NUMERIC": f"({size},{digits})"}
                yield s, t, at, name, type_.lower() + sized.get(type_.upper(), ""), nullable != 0

        def indexes(schema: str, table: str) -> Iterator[tuple]:
            for name, other, at, column, type_ in _rows(meta.getIndexInfo(None, schema, table, False, True), ("INDEX_NAME", "String"), ("NON_UNIQUE", "Boolean"), ("ORDINAL_POSITION", "Int"), ("COLUMN_NAME", "String"), ("TYPE", "Int")):
                if name is not None:  # else statistics
                    yield schema, table, name, {1: "clustered", 2: "hashed"}.get(type_, "other"), not other, at, column

        def keys(schema: str, table: str) -> Iterator[tuple]:
            for name, ps, pt, at, column, parent in _rows(meta.getImportedKeys(None, schema, table), ("FK_NAME", "String"), ("PKTABLE_SCHEM", "String"), ("PKTABLE_NAME", "String"), ("KEY_SEQ", "Int"), ("FKCOLUMN_NAME", "String"), ("PKCOLUMN_NAME", "String")):
                yield schema, table, name, ps, pt, at, column, parent

        only = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 1)
        only[0] = "TABLE"
        kind("tables", lambda: _rows(meta.getTables(None, None, "%", only), ("TABLE_SCHEM", "String"), ("TABLE_NAME", "String")))
        kind("columns", columns)
        kind("index_columns", lambda: each("index_columns", indexes))
        kind("foreign_key_columns", lambda: each("foreign_key_columns", keys))
    frames = {k: spark.createDataFrame(rows, SHAPES[k]) for k, rows in found.items()}
    for name, sql in (("modules", modules or MODULES.get(product)), ("synonyms", synonyms or SYNONYMS.get(product))):
        if sql:
            try:  # bodies are read by tasks, and once
                frames[name] = written(spark.read.format("jdbc").options(url=url, query=sql, **options).load())
            except Exception as e:  # noqa: BLE001  reported, by kind
                failed.append((name, None, str(e)[:500]))
    return frames, spark.createDataFrame(failed, "kind string, object string, message string")
