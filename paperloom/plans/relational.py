"""The relational surface: joins, groupings, windows and set operations on the star schema and `events`."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.plans.registry import query, table

M = lambda c, n=2: F.round(c, n)


@query("rel_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY 1, 2")
def pricing(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02 00:00:00").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(M(F.sum("l_quantity")).alias("sum_qty"), M(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue"), M(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("j01_star_join", "SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def star(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), M(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue"))


@query("j02_left_join", "SELECT c_custkey, coalesce(count(o_orderkey), 0) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), M(F.coalesce("s", F.lit(0.0))).alias("total"))


@query("j03_semi_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("j04_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000)")
def anti(spark, d):
    """Customers without a large urgent order."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 100000")
    return table(spark, d, "customer").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("j14_null_safe_join", "WITH a AS (SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE s_nationkey END AS k FROM supplier), b AS (SELECT k, count(*) AS n FROM a GROUP BY k) SELECT s_suppkey, n FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def null_safe(spark, d):
    a = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") % 5 != 0, F.col("s_nationkey")).alias("k"))
    b = a.groupBy(F.col("k").alias("k2")).agg(F.count("*").alias("n"))
    return a.join(b, F.col("k").eqNullSafe(F.col("k2"))).select("s_suppkey", "n")


@query("j16_asof_join", "SELECT e.event_id, b.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON e.user_id = b.user_id AND e.ts >= b.ts")
def asof(spark, d):
    """The last view at or before each purchase: one window over both kinds by user, no pairs."""
    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "view"))
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    w = Window.partitionBy("user_id").orderBy("ts", (F.col("event_type") == "purchase").cast("int"), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.withColumn("last_view", F.last(view, True).over(w)).where("event_type = 'purchase'").select("event_id", "last_view")


@query("a31_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), M(F.sum("l_quantity")).alias("qty"))


@query("a31_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority) HAVING count(*) > 10")
def cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).where("n > 10")


@query("a31_grouping_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def sets(spark, d):
    c = table(spark, d, "customer")
    return c.groupingSets([[c.c_mktsegment], [c.c_nationkey], []], c.c_mktsegment, c.c_nationkey).agg(F.count("*").alias("n"))


@query("w12_lag_lead", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, ntile(4) OVER w AS quarter, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def lag_lead(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"), F.ntile(4).over(w).cast("long").alias("quarter"), M(F.sum("o_totalprice").over(w.rowsBetween(-2, 0))).alias("last3"))


@query("u01_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("u03_intersect_except", "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def intersect(spark, d):
    o = table(spark, d, "orders")
    both = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))
    return both.subtract(table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey"))


@query("u04_symmetric_difference", "WITH a AS (SELECT p_partkey AS k, p_name AS n FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN upper(p_name) ELSE p_name END AS n FROM part WHERE p_partkey % 4 <> 0) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'gone' WHEN a.k IS NULL THEN 'new' ELSE 'renamed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.n <> b.n")
def symmetric(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n1"))
    b = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 10 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("n2"))
    j = a.join(b, "k", "full_outer").where("n1 is null or n2 is null or n1 <> n2")
    return j.select("k", F.when(F.col("n2").isNull(), "gone").when(F.col("n1").isNull(), "new").otherwise("renamed").alias("change"))


@query("t01_top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("a05_union_stats", "WITH u AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size < 10 UNION SELECT l_partkey FROM lineitem WHERE l_discount > 0.05) SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS total, round(max(p_retailprice), 2) AS most FROM u JOIN part ON p_partkey = k GROUP BY p_brand")
def union_stats(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    # each branch has its own rows once before the union
    keys = li.where("l_returnflag = 'R' or l_discount > 0.05").select(F.col("l_partkey").alias("p_partkey")).union(p.where("p_size < 10").select("p_partkey"))
    return p.join(keys, "p_partkey", "left_semi").groupBy("p_brand").agg(F.count("*").alias("n"), M(F.sum("p_retailprice")).alias("total"), M(F.max("p_retailprice")).alias("most"))
