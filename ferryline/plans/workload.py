"""End-to-end queries: the reports and procedures that users of the source system run."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferryline.functions import dialect as X
from ferryline.operators import relational as R
from ferryline.plans.common import money, t, total
from ferryline.registry import query

_DAY = "1998-12-31"


@query("SELECT o_orderkey, o_orderdate, o_totalprice, coalesce(o_orderstatus, 'none') AS status, c_name || ' (' || CAST(c_custkey AS VARCHAR) || ')' AS customer FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def recent_orders(s, d):
    """Top 100 before the join: the join is by key and keeps each order, so only 100 rows meet the customers."""
    last = t(s, d, "orders").join(t(s, d, "customer", "c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    last = last.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)
    return last.select("o_orderkey", "o_orderdate", "o_totalprice", X.isnull(F.col("o_orderstatus"), F.lit("none")).alias("status"), X.concat(F.col("c_name"), F.lit(" ("), F.col("c_custkey"), F.lit(")")).alias("customer"))


@query(f"""SELECT c_custkey, c_name, coalesce(n, 0) AS n_orders, coalesce(spent, 0) AS spent, date_diff('day', last_day, TIMESTAMP '{_DAY}') AS days_since FROM customer
          LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent, max(o_orderdate) AS last_day FROM orders GROUP BY 1) ON o_custkey = c_custkey ORDER BY coalesce(spent, 0) DESC, c_custkey LIMIT 50""")
def top_customers(s, d):
    o = t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), total("o_totalprice").alias("sp"), F.max("o_orderdate").alias("last_day"))
    c = t(s, d, "customer", "c_custkey", "c_name").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    c = c.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("sp", F.lit(0.0)).alias("spent"), X.datediff("day", F.col("last_day"), F.lit(_DAY).cast("timestamp")).cast("long").alias("days_since"))
    return c.orderBy(F.desc("spent"), "c_custkey").limit(50)


@query("SELECT n_name, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) = 1995 AND month(o_orderdate) = 3 GROUP BY 1")
def monthly_report(s, d):
    """The month is filtered as a range, which reaches the scan."""
    staged = t(s, d, "orders").filter("o_orderdate >= timestamp'1995-03-01' and o_orderdate < timestamp'1995-04-01'")
    c, n = t(s, d, "customer"), t(s, d, "nation")
    return staged.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), total("o_totalprice").alias("revenue"))


_B = ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22"]


@query(f"SELECT month(l_shipdate) AS m, {', '.join(f'CAST(sum(CASE WHEN p_brand = {chr(39)}{b}{chr(39)} THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS {b.replace(chr(35), chr(95)).lower()}' for b in _B)} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def pivot_month_revenue(s, d):
    j = t(s, d, "lineitem").join(t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    j = j.select(F.month("l_shipdate").alias("m"), "p_brand", "l_extendedprice").groupBy("m").pivot("p_brand", _B).agg(total("l_extendedprice"))
    return j.select("m", *[F.col(f"`{b}`").alias(b.replace("#", "_").lower()) for b in _B])


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders GROUP BY 1")
def daily_totals(s, d):
    return t(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), total("o_totalprice").alias("spent"))


@query("SELECT n_name, count(c_custkey) AS heads, coalesce(CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE), 0) AS balance, max(c_acctbal) AS top_balance FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def group_summary(s, d):
    c = t(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("heads"), total("c_acctbal").alias("balance"), F.max("c_acctbal").alias("top_balance"))
    return t(s, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("heads", F.lit(0)).alias("heads"), F.coalesce("balance", F.lit(0.0)).alias("balance"), "top_balance")


@query(f"""WITH a AS (SELECT c_custkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey), b AS (SELECT a.*, r_name FROM a JOIN region ON r_regionkey = n_regionkey)
          SELECT o_orderkey, c_custkey, n_name, r_name, CAST(date_diff('month', o_orderdate, TIMESTAMP '{_DAY}') AS BIGINT) AS age FROM b JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 200000""")
def nested_views(s, d):
    a = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "n_regionkey")
    b = a.join(t(s, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    o = t(s, d, "orders").filter("o_totalprice > 200000")
    return o.join(b, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "n_name", "r_name", X.datediff("month", F.col("o_orderdate"), F.lit(_DAY).cast("timestamp")).cast("long").alias("age"))


@query("SELECT s_suppkey, s_name, count(l_orderkey) AS lines, count(DISTINCT l_orderkey) AS orders, CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,2))), 0) AS DOUBLE) AS hours FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2")
def overview_left_agg(s, d):
    li = t(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.count_distinct("l_orderkey").alias("orders"), total("l_quantity").alias("hours"))
    j = t(s, d, "supplier").join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return j.select("s_suppkey", "s_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lines", "orders")], F.coalesce("hours", F.lit(0.0)).alias("hours"))


@query("SELECT p_brand, count(DISTINCT p_partkey) AS products, CAST(sum(p_size) AS BIGINT) AS stock, coalesce(CAST(sum(moved) AS DOUBLE), 0) AS moved FROM part LEFT JOIN (SELECT l_partkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS moved FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1")
def stock_summary(s, d):
    li = t(s, d, "lineitem").groupBy("l_partkey").agg(F.sum(money("l_quantity")).alias("moved"))
    j = t(s, d, "part").join(li, F.col("p_partkey") == F.col("l_partkey"), "left")
    return j.groupBy("p_brand").agg(F.count_distinct("p_partkey").alias("products"), F.sum("p_size").alias("stock"), F.coalesce(F.sum("moved").cast("double"), F.lit(0.0)).alias("moved"))


@query("SELECT o_orderkey, c_name, o_totalprice, CASE WHEN o_totalprice >= 300000 THEN 'top' WHEN o_totalprice >= 200000 THEN 'high' ELSE 'mid' END AS class FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 150000")
def high_value_orders(s, d):
    j = t(s, d, "orders").filter("o_totalprice > 150000").join(t(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return j.select("o_orderkey", "c_name", "o_totalprice", price_class(F.col("o_totalprice")).alias("class"))


def price_class(price):
    """A scalar user function: a column expression, no UDF."""
    return F.when(price >= 300000, "top").when(price >= 200000, "high").otherwise("mid")


@query("SELECT p_partkey, CAST(p_size * CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS v, CASE WHEN p_size * p_retailprice < 10000 THEN 'low' WHEN p_size * p_retailprice < 40000 THEN 'medium' ELSE 'high' END AS band FROM part")
def value_bands(s, d):
    v = F.col("p_size") * F.col("p_retailprice")
    return t(s, d, "part").select("p_partkey", (F.col("p_size") * money("p_retailprice")).cast("double").alias("v"), F.when(v < 10000, "low").when(v < 40000, "medium").otherwise("high").alias("band"))


@query(f"SELECT o_orderkey, CAST(date_diff('year', o_orderdate, TIMESTAMP '{_DAY}') AS BIGINT) AS years, CASE WHEN date_diff('year', o_orderdate, TIMESTAMP '{_DAY}') >= 5 THEN 10 WHEN date_diff('year', o_orderdate, TIMESTAMP '{_DAY}') >= 3 THEN 7 ELSE 5 END AS pct FROM orders")
def tenure_bonus(s, d):
    y = X.datediff("year", F.col("o_orderdate"), F.lit(_DAY).cast("timestamp"))
    return t(s, d, "orders").select("o_orderkey", y.cast("long").alias("years"), F.when(y >= 5, 10).when(y >= 3, 7).otherwise(5).alias("pct"))


@query("SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rk FROM customer")
def rank_in_group(s, d):
    return t(s, d, "customer").select("c_custkey", "c_nationkey", F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))).cast("long").alias("rk"))


@query("""SELECT n_name, coalesce(used, 0) AS used, CASE WHEN coalesce(used, 0) > 100000 THEN 'over' WHEN coalesce(used, 0) > 50000 THEN 'near' ELSE 'ok' END AS state
          FROM nation LEFT JOIN (SELECT c_nationkey, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS used FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""")
def budget_utilisation(s, d):
    c = t(s, d, "customer").groupBy("c_nationkey").agg(total("c_acctbal").alias("u"))
    used = F.coalesce("u", F.lit(0.0))
    return t(s, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", used.alias("used"), F.when(used > 100000, "over").when(used > 50000, "near").otherwise("ok").alias("state"))


def dashboard(s, d):
    """Several result sets of one procedure."""
    return {"totals": dashboard_totals(s, d), "status": dashboard_status(s, d), "top": dashboard_top(s, d), "groups": group_summary(s, d)}


@query("SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders")
def dashboard_totals(s, d):
    return t(s, d, "orders").agg(F.count("*").alias("n"), total("o_totalprice").alias("spent"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def dashboard_status(s, d):
    return t(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def dashboard_top(s, d):
    return t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(10)


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def dynamic_search(s, d):
    return R.dynamic_search(t(s, d, "customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_name")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def fn_table_valued(s, d):
    return orders_of_nation(s, d, 3)


def orders_of_nation(s, d, nation: int):
    """A table-valued function: parameters in, a DataFrame out."""
    c = t(s, d, "customer").filter(F.col("c_nationkey") == nation)
    return t(s, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 300000 THEN 'top' WHEN c_acctbal >= 200000 THEN 'high' ELSE 'mid' END AS class FROM customer")
def fn_scalar(s, d):
    return t(s, d, "customer").select("c_custkey", price_class(F.col("c_acctbal")).alias("class"))


@query("SELECT o_orderstatus, count(*) AS n_rows, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def proc_outputs(s, d):
    """Output parameters of a procedure, here one set for each status."""
    return t(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.max("o_orderkey").alias("last_key"))
