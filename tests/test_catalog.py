"""The catalog of a live database (Derby, which comes with Spark)."""

from ferryline.sources import loads
from ferryline.sources.catalog import SHAPES, read_database
from ferryline.sources.tables import read_catalog

OPTIONS = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
DDL = [
    "CREATE SCHEMA SHOP",
    "CREATE TABLE SHOP.CUSTOMER (ID INT NOT NULL PRIMARY KEY, NAME VARCHAR(40), CREDIT DECIMAL(9,2))",
    "CREATE TABLE SHOP.ORDERS (A INT NOT NULL, B INT NOT NULL, CUST INT CONSTRAINT OF_CUSTOMER REFERENCES SHOP.CUSTOMER, PRIMARY KEY (B, A))",
    "CREATE TABLE SHOP.LINES (X INT, Y INT, N BIGINT, CONSTRAINT OF_ORDER FOREIGN KEY (Y, X) REFERENCES SHOP.ORDERS (B, A))",
    "CREATE UNIQUE INDEX SHOP.BY_NAME ON SHOP.CUSTOMER (NAME, ID)",
    "CREATE VIEW SHOP.RICH AS SELECT NAME FROM SHOP.CUSTOMER WHERE CREDIT > 100",
    "CREATE TRIGGER SHOP.GONE AFTER DELETE ON SHOP.LINES FOR EACH STATEMENT VALUES 1",
]


def test_catalog_of_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    with loads.transaction(spark, url, **OPTIONS) as c:
        for sql in DDL:
            loads._run(c, sql)
    frames, failed = read_database(spark, url, **OPTIONS)
    assert failed.count() == 0 and set(frames) == {"tables", "columns", "index_columns", "foreign_key_columns", "modules"}
    out = read_catalog(frames)
    tables = {r.table_name: [tuple(c) for c in r.columns] for r in out["tables"].filter("schema_name = 'SHOP'").select("table_name", "columns").collect()}
    assert tables == {"CUSTOMER": [("ID", "integer", False), ("NAME", "varchar(40)", True), ("CREDIT", "decimal(9,2)", True)], "ORDERS": [("A", "integer", False), ("B", "integer", False), ("CUST", "integer", True)], "LINES": [("X", "integer", True), ("Y", "integer", True), ("N", "bigint", True)]}
    keys = {r.key_name: (r.table_name, r.parent_table, [tuple(c) for c in r.columns]) for r in out["foreign_keys"].collect()}
    assert keys == {"OF_CUSTOMER": ("ORDERS", "CUSTOMER", [("CUST", "ID")]), "OF_ORDER": ("LINES", "ORDERS", [("Y", "B"), ("X", "A")])}
    index = {r.index_name: (r.is_unique, [c.column_name for c in r.columns]) for r in out["indexes"].collect()}
    assert index["BY_NAME"] == (True, ["NAME", "ID"]) and (True, ["B", "A"]) in index.values()
    assert {(r.object_name, r.object_type.strip()) for r in out["modules"].collect()} == {("RICH", "VIEW"), ("GONE", "TRIGGER")}
    assert "CREDIT > 100" in out["modules"].filter("object_name = 'RICH'").first().body


def test_what_cannot_be_read_is_told(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    with loads.transaction(spark, url, **OPTIONS) as c:
        loads._run(c, "CREATE TABLE T (ID INT)")
    frames, failed = read_database(spark, url, modules="SELECT * FROM NO_SUCH_TABLE", most=5, **OPTIONS)
    told = {r.kind: r.message for r in failed.collect()}
    assert set(told) == {"modules", "columns"} and "over 5 rows" in told["columns"] and "modules" not in frames and [r.table_name for r in frames["tables"].collect()] == ["T"]
    assert all(frames[k].dtypes == spark.createDataFrame([], SHAPES[k]).dtypes for k in frames)
