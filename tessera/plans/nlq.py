"""The relational forms the assistant's generated SQL uses.

Each query is written with the DataFrame API the way generated SQL would be
planned by Catalyst: aggregate before joining (partial aggregation runs map
side), let AQE / table statistics pick broadcast vs sort-merge joins, limit
only where top-k is the question itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources.tables import read_table, register_views


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("nlq_top_customers", ids="J5 J7 J9", oracle="""
SELECT c_custkey, c_name, count(*) AS n_orders
FROM customer JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey, c_name
ORDER BY n_orders DESC, c_custkey
LIMIT 5""")
def nlq_top_customers(spark, sf):
    """"Which 5 customers have the most orders?" """
    per_cust = (read_table(spark, sf, "orders").groupBy("o_custkey")
                .agg(F.count(F.lit(1)).alias("n_orders")))
    cust = read_table(spark, sf, "customer").select("c_custkey", "c_name")
    return (per_cust.join(cust, per_cust.o_custkey == cust.c_custkey)
            .select("c_custkey", "c_name", "n_orders")
            .orderBy(F.desc("n_orders"), "c_custkey").limit(5))


@query("nlq_top_products_revenue", ids="J7 J9", oracle="""
SELECT p_partkey, p_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_partkey, p_name
ORDER BY revenue DESC, p_partkey
LIMIT 10""")
def nlq_top_products_revenue(spark, sf):
    """"First 10 products by revenue." """
    rev = (read_table(spark, sf, "lineitem").groupBy("l_partkey")
           .agg(F.round(F.sum(revenue()), 4).alias("revenue")))
    part = read_table(spark, sf, "part").select("p_partkey", "p_name")
    return (rev.join(part, rev.l_partkey == part.p_partkey)
            .select("p_partkey", "p_name", "revenue")
            .orderBy(F.desc("revenue"), "p_partkey").limit(10))


@query("nlq_revenue_by_type_nation", ids="J5 J7 J8", oracle="""
SELECT p_type, n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem
JOIN part ON l_partkey = p_partkey
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
GROUP BY p_type, n_name
HAVING sum(l_extendedprice * (1 - l_discount)) > 5000""")
def nlq_revenue_by_type_nation(spark, sf):
    """"Total revenue by product category and customer country, only above 5000." """
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", revenue().alias("rev"))
    part = read_table(spark, sf, "part").select("p_partkey", "p_type")
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cust = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf, "nation").select("n_nationkey", "n_name")
    # orders -> customer -> nation first: shrinks the order side to (orderkey, n_name)
    order_nation = (orders.join(cust, orders.o_custkey == cust.c_custkey)
                    .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
                    .select("o_orderkey", "n_name"))
    return (li.join(part, li.l_partkey == part.p_partkey)
            .join(order_nation, li.l_orderkey == order_nation.o_orderkey)
            .groupBy("p_type", "n_name")
            .agg(F.sum("rev").alias("total"))
            .where(F.col("total") > 5000)
            .select("p_type", "n_name", F.round("total", 4).alias("revenue")))


@query("nlq_customers_no_recent_orders", ids="J6 J13", oracle="""
SELECT c_custkey, c_name
FROM customer
WHERE NOT EXISTS (
  SELECT 1 FROM orders
  WHERE o_custkey = c_custkey
    AND o_orderdate > (SELECT max(o_orderdate) - INTERVAL 3 MONTH FROM orders))""")
def nlq_customers_no_recent_orders(spark, sf):
    """"Customers with no orders in the last quarter" (relative to the latest order)."""
    orders = read_table(spark, sf, "orders")
    cutoff = orders.select(F.max("o_orderdate") - F.expr("INTERVAL 3 MONTH")).scalar()
    recent = orders.where(F.col("o_orderdate") > cutoff).select("o_custkey")
    cust = read_table(spark, sf, "customer").select("c_custkey", "c_name")
    return cust.join(recent, cust.c_custkey == recent.o_custkey, "left_anti")


@query("nlq_count", ids="J11", oracle="SELECT count(*) AS n FROM customer")
def nlq_count(spark, sf):
    return read_table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n"))


@query("nlq_any_rows", ids="J1 J10 J15", oracle="""
SELECT o_orderkey, o_custkey, o_totalprice
FROM orders WHERE o_orderstatus = 'F'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 5""")
def nlq_any_rows(spark, sf):
    """Projection + filter + ordered limit ("5 records")."""
    return (read_table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
            .select("o_orderkey", "o_custkey", "o_totalprice")
            .orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5))


@query("sql_predicates", ids="J2 J3", oracle="""
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice
FROM part
WHERE ((p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3'))
       OR p_name LIKE '%green%')
  AND p_type NOT LIKE 'ECON%'
  AND p_retailprice IS NOT NULL
  AND p_retailprice > 950""")
def sql_predicates(spark, sf):
    part = read_table(spark, sf, "part")
    cond = (((F.col("p_size").between(10, 20) & F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"))
             | F.col("p_name").like("%green%"))
            & ~F.col("p_type").like("ECON%")
            & F.col("p_retailprice").isNotNull()
            & (F.col("p_retailprice") > 950))
    return part.where(cond).select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query("sql_union_distinct", ids="J12 J14 J15", oracle="""
SELECT DISTINCT n_name, kind
FROM (SELECT s_nationkey AS nk, 'supplier' AS kind FROM supplier
      UNION ALL
      SELECT c_nationkey AS nk, 'customer' AS kind FROM customer) u
JOIN nation ON nk = n_nationkey""")
def sql_union_distinct(spark, sf):
    sup = read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nk"), F.lit("supplier").alias("kind"))
    cus = read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("nk"), F.lit("customer").alias("kind"))
    nation = read_table(spark, sf, "nation")
    # distinct before the join: partial aggregation collapses each side map-side
    u = sup.unionByName(cus).distinct()
    return u.join(nation, u.nk == nation.n_nationkey).select("n_name", "kind").distinct()


@query("sql_params", ids="J7 J8 J16 J17", oracle="""
SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS avg_bal,
       max(CAST(c_nationkey AS VARCHAR)) AS max_nation_text
FROM customer
WHERE c_acctbal > 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')
GROUP BY c_mktsegment
HAVING count(*) > 10""")
def sql_params(spark, sf):
    """Named parameters bound by ``spark.sql(args=...)``, never spliced into text."""
    register_views(spark, sf, ["customer"])
    return spark.sql("""
        SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS avg_bal,
               max(CAST(c_nationkey AS STRING)) AS max_nation_text
        FROM customer
        WHERE c_acctbal > :min_bal AND c_mktsegment IN (:s1, :s2, :s3)
        GROUP BY c_mktsegment
        HAVING count(*) > :min_n""",
                     args={"min_bal": 1000, "s1": "BUILDING", "s2": "MACHINERY",
                           "s3": "AUTOMOBILE", "min_n": 10})


@query("sql_cte_scalar", ids="J13 J7", oracle="""
WITH per_nation AS (
  SELECT c_nationkey, count(*) AS n_cust, sum(c_acctbal) AS bal
  FROM customer GROUP BY c_nationkey)
SELECT n_name, r_name, n_cust, round(bal, 4) AS bal
FROM per_nation
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
WHERE n_cust > (SELECT avg(n_cust) FROM per_nation)""")
def sql_cte_scalar(spark, sf):
    """CTE + uncorrelated scalar subquery, both planned once by Catalyst."""
    cust = read_table(spark, sf, "customer")
    per_nation = cust.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_cust"),
                                                 F.sum("c_acctbal").alias("bal"))
    avg_n = per_nation.select(F.avg("n_cust")).scalar()
    nation = read_table(spark, sf, "nation")
    region = read_table(spark, sf, "region")
    return (per_nation.where(F.col("n_cust") > avg_n)
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_name", "r_name", "n_cust", F.round("bal", 4).alias("bal")))


@query("sql_outer_joins", ids="J5 J2", oracle="""
SELECT n_name, s_name, CAST(coalesce(s_suppkey, -1) AS BIGINT) AS s_suppkey, side FROM (
  SELECT n_name, s_name, s_suppkey, 'left' AS side FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000
  UNION ALL
  SELECT n_name, s_name, s_suppkey, 'right' FROM nation RIGHT JOIN supplier ON s_nationkey = n_nationkey AND n_regionkey = 1) u
WHERE s_name IS NULL OR n_name IS NULL OR side = 'left'""")
def sql_outer_joins(spark, sf):
    """Left and right joins with a condition on the optional side, and IS NULL tests on their result."""
    nation = read_table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    sup = read_table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    same = F.col("s_nationkey") == F.col("n_nationkey")
    left = nation.join(sup, same & (F.col("s_acctbal") > 5000), "left").withColumn("side", F.lit("left"))
    right = nation.join(sup, same & (F.col("n_regionkey") == 1), "right").withColumn("side", F.lit("right"))
    cols = ["n_name", "s_name", "s_suppkey", "side"]
    both = left.select(cols).unionByName(right.select(cols))
    return (both.where(F.col("s_name").isNull() | F.col("n_name").isNull() | (F.col("side") == "left"))
            .withColumn("s_suppkey", F.coalesce("s_suppkey", F.lit(-1)).cast("bigint")))


@query("sql_not_in_aggregates", ids="J2 J7 J8", oracle="""
SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS least, min(o_orderdate) AS earliest
FROM orders
WHERE o_orderstatus NOT IN ('P', 'X') AND o_custkey IS NOT NULL AND NOT (o_totalprice IS NULL)
GROUP BY o_orderpriority""")
def sql_not_in_aggregates(spark, sf):
    """NOT IN, IS (NOT) NULL, MIN and COUNT(DISTINCT)."""
    o = read_table(spark, sf, "orders").where(~F.col("o_orderstatus").isin("P", "X") & F.col("o_custkey").isNotNull() & ~F.col("o_totalprice").isNull())
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"),
                                            F.min("o_totalprice").alias("least"), F.min("o_orderdate").alias("earliest"))


@query("sql_array_membership", ids="J3 J4", oracle="""
WITH seen AS (SELECT user_id, list(DISTINCT event_type) AS types FROM events GROUP BY user_id),
kinds AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT s.user_id, k.event_type, k.n FROM seen s JOIN kinds k ON list_contains(s.types, k.event_type)
WHERE list_contains(s.types, 'click') AND NOT list_contains(s.types, 'no_such_type')""")
def sql_array_membership(spark, sf):
    """Membership in an array column as a filter and as a join condition.

    The join explodes the (short, distinct) array and equi-joins its elements, instead of testing every pair.
    """
    ev = read_table(spark, sf, "events")
    seen = ev.groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    seen = seen.where(F.array_contains("types", "click") & ~F.array_contains("types", "no_such_type"))
    kinds = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return seen.select("user_id", F.explode("types").alias("event_type")).join(kinds, "event_type").select("user_id", "event_type", "n")
