"""Predicates, joins, aggregates, windows, sorting, sets and scalar functions on the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferryline.functions import dialect as X
from ferryline.operators import relational as R
from ferryline.operators.staging import written
from ferryline.plans.common import money, t, total
from ferryline.registry import query

# --- projections and predicates ---


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'")
def scan_projected(s, d):
    return t(s, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").filter("o_orderdate >= timestamp'1995-01-01'").drop("o_orderdate")


@query("SELECT DISTINCT p_brand, p_size FROM part WHERE p_size BETWEEN 5 AND 30 AND p_size NOT IN (7, 9) AND p_type LIKE '%E%' AND NOT (p_size > 25) AND p_name IS NOT NULL AND NOT (p_retailprice < 905)")
def predicates(s, d):
    c = F.col
    p = t(s, d, "part").filter(c("p_size").between(5, 30) & ~c("p_size").isin(7, 9) & c("p_type").like("%E%") & ~(c("p_size") > 25) & c("p_name").isNotNull() & (c("p_retailprice") >= 905))
    return p.select("p_brand", "p_size").distinct()


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%#0000_1%' ESCAPE '!' AND regexp_matches(c_name, '^Customer#[0-9]*[13579]$')")
def like_classes(s, d):
    return t(s, d, "customer", "c_custkey", "c_name").filter("c_name like '%#0000_1%' escape '!'").filter(X.like(F.col("c_name"), "Customer#%[13579]"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def optional_filter(s, d):
    return R.optional_filter(t(s, d, "orders", "o_orderkey", "o_orderstatus", "o_custkey"), o_orderstatus="F", o_custkey=None).drop("o_custkey")


@query("SELECT event_id, props FROM events WHERE TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) = 42")
def implicit_conversion(s, d):
    return t(s, d, "events", "event_id", "props").filter(X.try_equals_number(F.regexp_extract("props", "[0-9]+", 0), F.lit(42)))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_orderkey // 7 AS BIGINT) AS q, CAST(l_orderkey % 7 AS BIGINT) AS r, CAST(l_orderkey & 12 AS BIGINT) AS b_and, CAST(l_orderkey | 12 AS BIGINT) AS b_or,
          CAST(xor(l_orderkey, 12) AS BIGINT) AS b_xor, CAST(~l_orderkey AS BIGINT) AS b_not, CAST(-l_orderkey AS BIGINT) AS neg FROM lineitem""")
def arith_bitwise(s, d):
    k = F.col("l_orderkey")
    return t(s, d, "lineitem", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", X.divide(k, F.lit(7)).alias("q"), (k % 7).alias("r"), k.bitwiseAND(12).alias("b_and"), k.bitwiseOR(12).alias("b_or"), k.bitwiseXOR(12).alias("b_xor"), F.bitwise_not(k).alias("b_not"), (-k).alias("neg"))


def _mixed(c, k):
    """The text in upper, lower and its own case in turn."""
    return F.when(k % 3 == 0, F.upper(c)).when(k % 3 == 1, F.lower(c)).otherwise(c)


_MIXED = "CASE c_custkey % 3 WHEN 0 THEN upper(c_mktsegment) WHEN 1 THEN lower(c_mktsegment) ELSE c_mktsegment END"


def _segments(s, d):
    k = F.col("c_custkey")
    return t(s, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment").select("c_custkey", "c_nationkey", _mixed(F.col("c_mktsegment"), k).alias("segment"))


@query(f"SELECT c_custkey, segment FROM (SELECT c_custkey, {_MIXED} AS segment FROM customer) WHERE lower(segment) = 'building' OR lower(segment) > 'household' AND lower(segment) <= 'machinery'")
def collate_compare(s, d):
    x = X.collated(F.col("segment"))
    return _segments(s, d).filter((x == "Building") | (x > "HOUSEHOLD") & (x <= "machinerY")).select("c_custkey", "segment")


@query(f"SELECT lower(segment) AS segment, count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM (SELECT c_nationkey, {_MIXED} AS segment FROM customer) GROUP BY 1")
def collate_group(s, d):
    g = _segments(s, d).groupBy(X.collated(F.col("segment")).alias("g")).agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("nations"))
    return g.select(F.lower(F.collate("g", "UTF8_BINARY")).alias("segment"), "n", "nations")


@query(f"SELECT c.c_custkey, n_nationkey FROM (SELECT c_custkey, {_MIXED.replace('c_mktsegment', 'n_name')} AS name FROM customer JOIN nation ON c_nationkey = n_nationkey) c JOIN nation ON lower(name) = lower(n_name)")
def collate_join(s, d):
    """Joined by names whose case differs."""
    n = t(s, d, "nation", "n_nationkey", "n_name")
    c = t(s, d, "customer", "c_custkey", "c_nationkey").join(n.withColumnRenamed("n_name", "own"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", _mixed(F.col("own"), F.col("c_custkey")).alias("name"))
    return c.join(n, X.collated(F.col("name")) == X.collated(F.col("n_name"))).select("c_custkey", "n_nationkey")


@query(f"SELECT c_custkey, segment, dense_rank() OVER (ORDER BY lower(segment)) AS place, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(segment), c_custkey) AS own FROM (SELECT c_custkey, c_nationkey, {_MIXED} AS segment FROM customer)")
def collate_order(s, d):
    """Ranks in an order regardless of case; the few different texts are ranked, not the rows."""
    c = _segments(s, d).withColumn("x", X.collated(F.col("segment")))
    ranks = c.groupBy("x").agg(F.count("*").alias("n")).select("x", F.dense_rank().over(Window.orderBy("x")).alias("place"))
    own = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("x", "c_custkey"))
    return c.withColumn("own", own).join(ranks, "x").select("c_custkey", "segment", "place", "own")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, 9007199254740993 + l_orderkey * 8 + l_linenumber AS k FROM lineitem)
          SELECT l_orderkey, l_linenumber, k // 1 AS q1, k // 3 AS q3, -(k // 3) AS minus, k // (k - 1) AS one, CAST(NULL AS BIGINT) AS by_zero FROM b""")
def divide_large(s, d):
    """Quotients of keys above 2^53, which a double can't hold."""
    k = F.lit(9007199254740993) + F.col("l_orderkey") * 8 + F.col("l_linenumber")
    q = {"q1": X.divide(k, F.lit(1)), "q3": X.divide(k, F.lit(3)), "minus": X.divide(-k, F.lit(3)), "one": X.divide(k, k - 1), "by_zero": X.divide(k, F.lit(0))}
    return t(s, d, "lineitem", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", *[v.alias(c) for c, v in q.items()])


@query("""SELECT l_suppkey, CAST(sum(CAST(9223372036854775807 - l_orderkey AS HUGEINT)) // count(*) AS BIGINT) AS large, CAST(-(sum(CAST(9223372036854775807 - l_orderkey AS HUGEINT)) // count(*)) AS BIGINT) AS small, CAST(NULL AS BIGINT) AS none FROM lineitem GROUP BY l_suppkey""")
def avg_large(s, d):
    """Averages near the ends of the 64-bit range: their sums don't fit."""
    k = F.lit(9223372036854775807) - F.col("l_orderkey")
    return t(s, d, "lineitem", "l_suppkey", "l_orderkey").groupBy("l_suppkey").agg(X.avg_int(k).alias("large"), X.avg_int(-k).alias("small"), X.avg_int(F.lit(None).cast("long")).alias("none"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 ELSE 0 END AS code,
          CASE WHEN p_retailprice > 1000 THEN 'dear' ELSE 'cheap' END AS price FROM part""")
def case_iif(s, d):
    size, brand = F.col("p_size"), F.col("p_brand")
    return t(s, d, "part").select("p_partkey", F.when(size < 10, "small").when(size < 30, "medium").otherwise("large").alias("band"), F.when(brand == "Brand#11", 1).when(brand == "Brand#12", 2).otherwise(0).alias("code"), F.when(F.col("p_retailprice") > 1000, "dear").otherwise("cheap").alias("price"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey AS VARCHAR) AS k, TRY_CAST(o_orderpriority AS INTEGER) AS p, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS q FROM orders")
def casts(s, d):
    return t(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderpriority").try_cast("int").alias("p"), F.substring("o_orderpriority", 1, 1).try_cast("int").alias("q"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_nationkey = 1")
def bit_compare(s, d):
    c = t(s, d, "customer").withColumn("active", F.col("c_acctbal") > 0)
    return c.filter(X.equals_one(F.col("active"), "boolean") & X.equals_one(F.col("c_nationkey"), "int")).select("c_custkey")


@query("SELECT p_partkey, p_size, CAST(p_size * CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS total_value FROM part")
def computed_column(s, d):
    return t(s, d, "part").select("p_partkey", "p_size", (F.col("p_size") * money("p_retailprice")).cast("double").alias("total_value"))


# --- joins ---


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 100000")
def join_inner_multi(s, d):
    o, c, n, r = t(s, d, "orders").filter("o_totalprice > 100000"), t(s, d, "customer"), t(s, d, "nation"), t(s, d, "region")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey * 3")
def join_outer(s, d):
    c, p = t(s, d, "customer", "c_custkey"), t(s, d, "supplier", "s_suppkey")
    return c.join(p, c.c_custkey == p.s_suppkey * 3, "full")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(s, d):
    return t(s, d, "nation", "n_name").crossJoin(F.broadcast(t(s, d, "region", "r_name")))


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey > n_nationkey AND s_suppkey % 5 = n_nationkey % 5")
def join_theta(s, d):
    a, n = t(s, d, "supplier", "s_suppkey", "s_nationkey"), t(s, d, "nation", "n_nationkey")
    return a.join(n, (a.s_nationkey > n.n_nationkey) & (a.s_suppkey % 5 == n.n_nationkey % 5)).select("s_suppkey", "n_nationkey")


@query("SELECT a.p_partkey AS child, b.p_partkey AS parent, b.p_name AS parent_name FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey // 2")
def join_self(s, d):
    a = t(s, d, "part", "p_partkey").withColumnRenamed("p_partkey", "child").withColumn("up", F.expr("child div 2"))
    b = t(s, d, "part").select(F.col("p_partkey").alias("parent"), F.col("p_name").alias("parent_name"))
    return a.join(b, F.col("up") == F.col("parent"), "left").drop("up")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) ON o_custkey = c_custkey AND rn = 1")
def cross_apply_top1(s, d):
    c, o = t(s, d, "customer", "c_custkey"), t(s, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    return R.cross_apply_top(c, o, "c_custkey", "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, spent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def outer_apply_agg(s, d):
    return R.outer_apply_agg(t(s, d, "customer", "c_custkey"), t(s, d, "orders"), "c_custkey", "o_custkey", {"n_orders": F.count("*")}, {"spent": total("o_totalprice")})


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def semi_exists(s, d):
    o = t(s, d, "orders").filter("o_orderstatus = 'O'")
    return t(s, d, "customer", "c_custkey", "c_name").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_not_exists(s, d):
    return t(s, d, "customer", "c_custkey", "c_name").join(t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) UNION ALL SELECT -c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END FROM orders)")
def not_in_null_aware(s, d):
    c, o = t(s, d, "customer", "c_custkey"), t(s, d, "orders", "o_orderkey", "o_custkey")
    holes = o.select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("o_custkey"))
    return R.not_in(c, "c_custkey", o.filter("o_orderkey % 2 = 0"), "o_custkey").union(R.not_in(c, "c_custkey", holes, "o_custkey").select(-F.col("c_custkey")))


@query("SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def join_cross_schema(s, d):
    """Two schemas (sales here, purchasing in a folder of its own) meet in the shared nation table; each side is counted before the join."""
    n = t(s, d, "nation")
    c = t(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_distinct("c_custkey").alias("customers"))
    p = written(t(s, d, "supplier", "s_suppkey", "s_nationkey")).groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_distinct("s_suppkey").alias("suppliers"))
    return n.join(c, "n_nationkey", "left").join(p, "n_nationkey", "left").groupBy("n_name").agg(F.coalesce(F.sum("customers"), F.lit(0)).alias("customers"), F.coalesce(F.sum("suppliers"), F.lit(0)).alias("suppliers"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders)")
def scalar_subquery(s, d):
    o = t(s, d, "orders", "o_orderkey", "o_totalprice")
    mean = F.broadcast(o.agg((F.sum(money("o_totalprice")).cast("double") / F.count("*")).alias("m")))  # one row
    return o.crossJoin(mean).filter("o_totalprice > m").select("o_orderkey")


# --- aggregates ---


@query("SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders GROUP BY 1, 2 HAVING count(*) > 5")
def group_having(s, d):
    return t(s, d, "orders").groupBy("o_orderstatus", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), total("o_totalprice").alias("spent")).filter("n > 5")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_tax) AS n_tax, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
          CAST(trunc(sum(l_linenumber) / count(*)) AS BIGINT) AS avg_line FROM lineitem GROUP BY 1, 2""")
def agg_basic(s, d):
    return t(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count("l_tax").alias("n_tax"), total("l_quantity").alias("qty"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), X.avg_int(F.col("l_linenumber")).alias("avg_line"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def agg_distinct(s, d):
    return t(s, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.sum_distinct("o_custkey").alias("keys"))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def string_agg(s, d):
    return t(s, d, "nation").groupBy("n_regionkey").agg(F.expr("listagg(n_name, ', ') within group (order by n_name)").alias("names"))


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders")
def agg_global(s, d):
    return t(s, d, "orders").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), total("o_totalprice").alias("spent"), F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"))


_MONTHS = ", ".join(f"CAST(sum(CASE WHEN month(o_orderdate) = {m} THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS m{m}" for m in range(1, 13))


@query(f"SELECT year(o_orderdate) AS y, {_MONTHS} FROM orders GROUP BY 1")
def pivot_month(s, d):
    o = t(s, d, "orders").select(F.year("o_orderdate").alias("y"), F.concat(F.lit("m"), F.month("o_orderdate")).alias("m"), "o_totalprice")
    return o.groupBy("y").pivot("m", [f"m{m}" for m in range(1, 13)]).agg(total("o_totalprice"))


@query("SELECT year(o_orderdate) AS y, 'm' || month(o_orderdate) AS m, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders GROUP BY 1, 2")
def unpivot_months(s, d):
    return pivot_month(s, d).unpivot(["y"], [f"m{m}" for m in range(1, 13)], "m", "spent").filter("spent is not null")


# --- windows ---


@query("""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr
          FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def win_ranking(s, d):
    w, p = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t(s, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(p).cast("long").alias("rk"), F.dense_rank().over(p).cast("long").alias("dr"))


@query("SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quartile FROM customer")
def win_ntile(s, d):
    return t(s, d, "customer").select("c_custkey", F.ntile(4).over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")).cast("long").alias("quartile"))


@query("SELECT event_id, lag(event_id, 1, -1) OVER w AS before, lead(event_id, 2) OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lag_lead(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(s, d, "events").select("event_id", F.lag("event_id", 1, -1).over(w).alias("before"), F.lead("event_id", 2).over(w).alias("later"))


@query("""SELECT event_id, first_value(event_type) OVER w AS first_type, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_type
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_first_last(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(s, d, "events").select("event_id", F.first_value("event_type").over(w).alias("first_type"), F.last_value("event_type").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last_type"))


@query("SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders")
def win_running_sum(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t(s, d, "orders").select("o_orderkey", F.sum(money("o_totalprice")).over(w).cast("double").alias("running"))


@query("""SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS DOUBLE) AS near,
          count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS upto, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rest FROM lineitem""")
def win_frames(s, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    near = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    q = F.sum(money("l_quantity"))
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", q.over(w.rowsBetween(-1, 1)).cast("double").alias("near"), F.count("*").over(near.rangeBetween(-2, 0)).alias("upto"), q.over(w.rowsBetween(0, Window.unboundedFollowing)).cast("double").alias("rest"))


# --- sort and limit ---


@query("SELECT c_custkey, v FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) ORDER BY v ASC NULLS FIRST, c_custkey DESC LIMIT 40")
def order_nulls(s, d):
    c = t(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("v"))
    return c.orderBy(F.asc_nulls_first("v"), F.desc("c_custkey")).limit(40)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_n(s, d):
    return t(s, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) WHERE rn <= ceil(n * 3 / 100.0)")
def top_percent(s, d):
    return R.top_percent(t(s, d, "orders", "o_orderkey", "o_totalprice"), 3, [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey")


@query("SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS rk FROM part) WHERE rk <= 10")
def top_with_ties(s, d):
    return R.top_with_ties(t(s, d, "part", "p_partkey", "p_size"), 10, ["p_size"])


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 30")
def offset_fetch(s, d):
    return R.offset_fetch(t(s, d, "orders", "o_orderkey", "o_orderdate"), 30, 20, [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_orderkey")


# --- sets ---


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(s, d):
    return t(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(t(s, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(s, d):
    return union_all(s, d).distinct()


@query("SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT c_custkey FROM customer")
def intersect(s, d):
    return t(s, d, "orders").select(F.col("o_custkey").alias("k")).intersectAll(t(s, d, "customer").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_(s, d):
    return t(s, d, "customer").select(F.col("c_custkey").alias("k")).subtract(t(s, d, "orders").select("o_custkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def except_all(s, d):
    return t(s, d, "orders").select(F.col("o_custkey").alias("k")).exceptAll(t(s, d, "customer").select("c_custkey"))


# --- functions ---


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, '-') AS a, nullif(o_orderstatus, 'F') AS b, coalesce(NULL, nullif(o_orderpriority, '1-URGENT'), 'none') AS c FROM orders")
def fn_null(s, d):
    c = F.col
    return t(s, d, "orders").select("o_orderkey", X.isnull(F.when(c("o_orderkey") % 2 == 0, c("o_orderstatus")), F.lit("-")).alias("a"), F.nullif(c("o_orderstatus"), F.lit("F")).alias("b"), F.coalesce(F.nullif(c("o_orderpriority"), F.lit("1-URGENT")), F.lit("none")).alias("c"))


@query("""SELECT p_partkey, CAST(length(rtrim(p_name || '  ')) AS INTEGER) AS n, CAST(octet_length(encode(p_name)) AS INTEGER) AS bytes, substr(p_name, 1, 3) AS l, right(p_name, 2) AS r, upper(p_name) AS u, lower(p_brand) AS lo, trim('  ' || p_brand || ' ') AS tr,
          reverse(p_name) AS rev, replace(p_type, 'E', 'e') AS rep, substr(p_name, 1, 2) AS sub, CAST(instr(p_name, 'a') AS INTEGER) AS pos, substr(p_brand, 1, 1) || 'XY' || substr(p_brand, 4) AS stuffed, repeat(p_brand, 2) AS twice FROM part""")
def fn_string(s, d):
    n, b = F.col("p_name"), F.col("p_brand")
    return t(s, d, "part").select(
        "p_partkey", X.len_(F.concat(n, F.lit("  "))).alias("n"), X.datalength(n).alias("bytes"), F.left(n, F.lit(3)).alias("l"), F.right(n, F.lit(2)).alias("r"), F.upper(n).alias("u"), F.lower(b).alias("lo"), F.trim(F.concat(F.lit("  "), b, F.lit(" "))).alias("tr"),
        F.reverse(n).alias("rev"), F.replace(F.col("p_type"), F.lit("E"), F.lit("e")).alias("rep"), X.substring(n, -1, 4).alias("sub"), X.charindex("a", n).alias("pos"), X.stuff(b, 2, 2, "XY").alias("stuffed"), F.repeat(b, 2).alias("twice"),
    )


@query("SELECT c_custkey, CAST(CASE WHEN regexp_matches(c_name, '[1-9]') THEN length(regexp_extract(c_name, '^[^1-9]*')) + 1 ELSE 0 END AS INTEGER) AS pos FROM customer")
def fn_patindex(s, d):
    return t(s, d, "customer").select("c_custkey", X.patindex("%[1-9]%", F.col("c_name")).alias("pos"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus || '/' || o_orderpriority END AS added, concat(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END, '/', o_orderpriority) AS joined,
          concat_ws('-', CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END, o_orderpriority) AS ws FROM orders""")
def fn_concat(s, d):
    a, b = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")), F.col("o_orderpriority")
    return t(s, d, "orders").select("o_orderkey", X.plus(a, F.lit("/"), b).alias("added"), X.concat(a, F.lit("/"), b).alias("joined"), X.concat_ws("-", a, b).alias("ws"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def fn_string_split(s, d):
    return t(s, d, "part").select("p_partkey", X.string_split(F.col("p_name"), " ").alias("word"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS num, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS dt FROM orders")
def fn_isnumeric(s, d):
    k = F.col("o_orderkey")
    return t(s, d, "orders").select("o_orderkey", X.isnumeric(F.when(k % 2 == 0, k.cast("string")).otherwise(F.lit("1x"))).alias("num"), X.isdate(F.when(k % 3 == 0, F.lit("2023-02-30")).otherwise(F.col("o_orderdate").cast("string"))).alias("dt"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate - INTERVAL 2 YEAR AS y, o_orderdate + INTERVAL 10 DAY AS d, o_orderdate + INTERVAL 5 HOUR AS h, o_orderdate + INTERVAL 3 MONTH AS q, o_orderdate + INTERVAL 14 DAY AS w FROM orders")
def fn_dateadd(s, d):
    o = F.col("o_orderdate")
    return t(s, d, "orders").select("o_orderkey", *[X.dateadd(p, n, o).alias(a) for a, p, n in (("m", "month", 1), ("y", "year", -2), ("d", "day", 10), ("h", "hour", 5), ("q", "quarter", 1), ("w", "week", 2))])


@query("""SELECT l_orderkey, l_linenumber, CAST(date_diff('year', o_orderdate, l_shipdate) AS BIGINT) AS y, CAST(date_diff('quarter', o_orderdate, l_shipdate) AS BIGINT) AS q, CAST(date_diff('month', o_orderdate, l_shipdate) AS BIGINT) AS m,
          CAST(date_diff('day', o_orderdate, l_shipdate) AS BIGINT) AS d, CAST(date_diff('day', date_trunc('week', o_orderdate + INTERVAL 1 DAY), date_trunc('week', l_shipdate + INTERVAL 1 DAY)) // 7 AS BIGINT) AS w, CAST(date_diff('hour', o_orderdate, l_shipdate + INTERVAL 90 MINUTE) AS BIGINT) AS h
          FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def fn_datediff(s, d):
    a, b = F.col("o_orderdate"), F.col("l_shipdate")
    j = t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", *[X.datediff(p, a, b).cast("long").alias(p[0]) for p in ("year", "quarter", "month", "day", "week")], X.datediff("hour", a, b + F.expr("interval 90 minutes")).cast("long").alias("h"))


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(quarter(ts) AS INTEGER) AS q, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(dayofyear(ts) AS INTEGER) AS dy, CAST(dayofweek(ts) + 1 AS INTEGER) AS dw, CAST(hour(ts) AS INTEGER) AS h, monthname(ts) AS mn, dayname(ts) AS dn FROM events")
def fn_datepart(s, d):
    ts = F.col("ts")
    return t(s, d, "events").select("event_id", *[X.datepart(p, ts).alias(a) for a, p in (("y", "year"), ("q", "quarter"), ("m", "month"), ("d", "day"), ("dy", "dayofyear"), ("dw", "dw"), ("h", "hour"))], X.datename("month", ts).alias("mn"), X.datename("weekday", ts).alias("dn"))


@query("SELECT event_id, strftime(ts, '%m/%d/%Y') AS s101, strftime(ts, '%Y.%m.%d') AS s102, strftime(ts, '%d/%m/%Y') AS s103, strftime(ts, '%d.%m.%Y') AS s104, strftime(ts, '%Y%m%d') AS s112, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s120, strftime(ts, '%H:%M:%S') AS s108 FROM events")
def fn_convert_style(s, d):
    return t(s, d, "events").select("event_id", *[X.convert_style(F.col("ts"), k).alias(f"s{k}") for k in (101, 102, 103, 104, 112, 120, 108)])


@query("""SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(round(CAST(c_acctbal AS DECIMAL(18,2)), 1) AS DOUBLE) AS r, round(power(c_nationkey, 2), 4) AS p, CAST(c_nationkey * c_nationkey AS INTEGER) AS sq,
          round(sqrt(c_custkey), 6) AS s, CAST(sign(c_acctbal) AS INTEGER) AS sg, CASE WHEN c_custkey > 0 THEN round(ln(c_custkey), 6) END AS l, CASE WHEN c_custkey > 0 THEN round(log10(c_custkey), 6) END AS l10 FROM customer""")
def fn_math(s, d):
    b, k, n = F.col("c_acctbal"), F.col("c_custkey"), F.col("c_nationkey")
    return t(s, d, "customer").select("c_custkey", F.abs(b).alias("a"), F.ceil(b).alias("c"), F.floor(b).alias("f"), F.round(b.cast("decimal(18,2)"), 1).cast("double").alias("r"), F.round(F.pow(n, 2), 4).alias("p"), X.square(n).alias("sq"), F.round(F.sqrt(k), 6).alias("s"), F.signum(b).cast("int").alias("sg"), F.round(F.ln(k), 6).alias("l"), F.round(F.log10(k), 6).alias("l10"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract(props, '$.k') AS INTEGER) + 1 AS k1 FROM events")
def fn_json(s, d):
    p = F.col("props")
    changed = F.to_json(F.struct((F.get_json_object(p, "$.k").cast("int") + 1).alias("k")))
    return t(s, d, "events").select("event_id", F.get_json_object(p, "$.k").alias("k"), F.get_json_object(changed, "$.k").cast("int").alias("k1"))


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def fn_openjson(s, d):
    e = t(s, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return e.filter("value is not null")


@query("SELECT o_orderkey, 'Rail' || (o_orderkey % 3) AS method, o_orderkey % 2 = 0 AS gift, 'a' || o_orderkey AS first_item, 2 AS items FROM orders")
def fn_xml(s, d):
    k = F.col("o_orderkey")
    doc = F.concat(F.lit("<order><shipping><method>Rail"), k % 3, F.lit("</method></shipping>"), F.when(k % 2 == 0, F.lit("<gift/>")).otherwise(F.lit("")), F.lit("<items><i>a"), k, F.lit("</i><i>b</i></items></order>"))
    x = t(s, d, "orders").select("o_orderkey", doc.alias("doc"))
    return x.select("o_orderkey", F.xpath_string("doc", F.lit("order/shipping/method")).alias("method"), F.xpath_boolean("doc", F.lit("order/gift")).alias("gift"), F.xpath_string("doc", F.lit("order/items/i[1]")).alias("first_item"), F.size(F.xpath("doc", F.lit("order/items/i/text()"))).alias("items"))


@query("SELECT n_regionkey, '[' || string_agg('{\"n\":\"' || n_name || '\"}', ',' ORDER BY n_name) || ']' AS doc FROM nation GROUP BY 1")
def fn_for_xml(s, d):
    rows = F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("n"))))
    return t(s, d, "nation").groupBy("n_regionkey").agg(F.to_json(rows).alias("doc"))
