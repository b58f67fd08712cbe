"""Filters, joins, set operations and pages over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators.pages import interleaved, keyset_page, offset_page
from skein.operators import joining
from skein.plans.registry import query
from skein.session import table


@query("""
SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
WHERE event_type IN ('click', 'view', 'purchase') AND value >= 10 AND CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0
""")
def filter_conjunctive_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conjunction of optional filters, one on a JSON path."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "purchase") & (F.col("value") >= 10))
    return rows.select("event_id", "user_id", "event_type", "value", k.alias("k")).where("k % 2 = 0")


@query("""
SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'near' WHEN p_size <= 10 THEN 'mid' ELSE 'far' END AS perimeter,
CASE WHEN p_retailprice >= 1500 THEN 'strong' WHEN p_retailprice >= 1200 THEN 'context' ELSE 'watch' END AS strength FROM part
""")
def ordered_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification by ordered rules: the first that holds wins."""
    perimeter = F.when(F.lower("p_type").contains("brass"), "near").when(F.col("p_size") <= 10, "mid").otherwise("far")
    strength = F.when(F.col("p_retailprice") >= 1500, "strong").when(F.col("p_retailprice") >= 1200, "context").otherwise("watch")
    return table(spark, sf_dir, "part").select("p_partkey", perimeter.alias("perimeter"), strength.alias("strength"))


@query("""
SELECT c_custkey, count(o_orderkey) AS n_open, count(DISTINCT o_orderpriority) AS priorities FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey
""")
def left_join_filter_in_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join whose filter stands on the right side, so that keys without rows stay."""
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    return table(spark, sf_dir, "customer").select("c_custkey").join(open_, "c_custkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_open"), F.countDistinct("o_orderpriority").alias("priorities"))


@query("""
SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY n_name
""")
def semi_and_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    kept = table(spark, sf_dir, "customer").join(orders.where("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(orders.where("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti")
    return kept.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT user_id, row_number() OVER (ORDER BY sum(value) DESC, user_id) AS r FROM events WHERE event_type = 'click' GROUP BY user_id),
b AS (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) AS r FROM events WHERE event_type = 'view' GROUP BY user_id),
f AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, a.r AS ra, b.r AS rb FROM (SELECT * FROM a WHERE r <= 50) a FULL JOIN (SELECT * FROM b WHERE r <= 50) b ON a.user_id = b.user_id)
SELECT user_id, ra, rb, round(coalesce(1.0 / (60 + ra), 0) + coalesce(1.0 / (60 + rb), 0), 8) AS score FROM f
""")
def full_outer_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked arms of 50 fused by reciprocal ranks over a full outer join."""
    events = table(spark, sf_dir, "events")

    def arm(kind: str, measure, name: str) -> DataFrame:
        top = events.where(F.col("event_type") == kind).groupBy("user_id").agg(measure.alias("m")).orderBy(F.desc("m"), "user_id").limit(50)
        return top.select("user_id", F.row_number().over(Window.orderBy(F.desc("m"), "user_id")).alias(name))

    fused = arm("click", F.sum("value"), "ra").join(arm("view", F.count("*"), "rb"), "user_id", "full")
    part = lambda c: F.coalesce(1.0 / (60 + F.col(c)), F.lit(0.0))
    return fused.select("user_id", "ra", "rb", F.round(part("ra") + part("rb"), 8).alias("score"))


@query("""
SELECT c_custkey, o.o_orderkey, o.o_orderdate FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o ON o.o_custkey = c_custkey
""")
def lateral_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of the right side for each left row: one aggregate instead of a sorted window."""
    latest = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("o"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(latest, "c_custkey", "left").select("c_custkey", "o.o_orderkey", "o.o_orderdate")


@query("""
SELECT a.c_custkey FROM customer a WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey IS NOT DISTINCT FROM a.c_nationkey AND s.s_acctbal > a.c_acctbal)
""")
def null_safe_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of which no partner under a null-safe key is larger: the partner side is first reduced to its largest."""
    most = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.max("s_acctbal").alias("most"))
    c = table(spark, sf_dir, "customer")
    return c.join(most, c["c_nationkey"].eqNullSafe(most["nation"]) & (F.col("most") > F.col("c_acctbal")), "left_anti").select("c_custkey")


@query("""
WITH RECURSIVE t(id, name, parent, path, level) AS (
SELECT 'r' || r_regionkey, r_name, CAST(NULL AS VARCHAR), r_name, 1 FROM region
UNION ALL SELECT x.id, x.name, x.parent, t.path || '/' || x.name, t.level + 1 FROM t JOIN (
  SELECT 'n' || n_nationkey AS id, n_name AS name, 'r' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 's' || s_suppkey, s_name, 'n' || s_nationkey FROM supplier) x ON x.parent = t.id)
SELECT id, name, parent, path, level FROM t
""")
def topic_tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The materialised path of every node of a tree of regions, nations and suppliers."""
    region, nation, supplier = (table(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    node = lambda df, kind, key, name, parent: df.select(F.concat(F.lit(kind), key).alias("id"), F.col(name).alias("name"), parent.alias("parent"))
    nodes = node(region, "r", F.col("r_regionkey"), "r_name", F.lit(None).cast("string"))
    nodes = nodes.unionByName(node(nation, "n", F.col("n_nationkey"), "n_name", F.concat(F.lit("r"), "n_regionkey"))).unionByName(node(supplier, "s", F.col("s_suppkey"), "s_name", F.concat(F.lit("n"), "s_nationkey")))
    above = joining.ancestors(nodes, "id", "parent").where("depth is not null").join(nodes.select(F.col("id").alias("ancestor"), F.col("name").alias("part")), "ancestor")
    paths = above.groupBy(F.col("node").alias("id")).agg(F.max("depth").alias("depth"), F.sort_array(F.collect_list(F.struct("depth", "part")), False).alias("p"))
    return nodes.join(paths, "id").select("id", "name", "parent", F.array_join("p.part", "/").alias("path"), (F.col("depth") + 1).alias("level"))


@query("""
WITH e AS (SELECT DISTINCT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey AND l_returnflag = 'R')
SELECT n, count(*) AS degree FROM (SELECT a AS n FROM e UNION ALL SELECT b FROM e) GROUP BY n
""")
def symmetric_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links stored once in id order and read from both ends."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    pairs = (
        lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .where("c_nationkey <> s_nationkey")
    )
    links = pairs.select(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).distinct()
    return links.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("degree"))


@query("""
SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS pending
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY r_name
""")
def left_chain_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of left joins with counts that the fan-out must not multiply: each level is counted before it is joined."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    customers = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), zero("orders"), zero("pending"))
    nations = table(spark, sf_dir, "nation").join(customers, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("nations"), zero("customers"), zero("orders"), zero("pending"))
    regions = table(spark, sf_dir, "region").join(nations, "r_regionkey", "left")
    return regions.groupBy("r_name").agg(zero("nations"), zero("customers"), zero("orders"), zero("pending"))


@query("""
WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'union_all', count(*) FROM (SELECT k FROM a UNION ALL SELECT k FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    # one full join of the two key sets answers all four
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "k", "full").agg(
        F.count("*").alias("union"), (F.count("a") + F.count("b")).alias("union_all"), F.count_if(F.col("b").isNull()).alias("except"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("intersect")
    )
    return both.select(F.expr("stack(4, 'union', union, 'union_all', union_all, 'except', `except`, 'intersect', intersect) AS (op, n)"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' OR (o_orderdate = TIMESTAMP '1998-01-01' AND o_orderkey < 1000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21")
def keyset_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 20 before a compound key, and one row more to tell whether there is another."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return keyset_page(orders, "o_orderdate", "o_orderkey", F.lit("1998-01-01").cast("timestamp"), F.lit(1000), 20)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def offset_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offset_page(table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey"), 50, 25).select("c_custkey", "c_name")


@query("""
WITH a AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part),
m AS (SELECT id, 2 * r AS place FROM a WHERE r <= 10 UNION ALL SELECT id, 2 * r + 1 FROM b WHERE r <= 10)
SELECT id, min(place) AS place FROM m GROUP BY id ORDER BY place LIMIT 5
""")
def interleaved_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists taken in turns, each id once, five in all."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    return interleaved(part.orderBy(F.desc("p_retailprice"), "id").limit(10).select("id", "p_retailprice"), part.orderBy(F.desc("p_size"), "id").limit(10).select("id", "p_size"), "id", 5)


@query("""
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderdate DESC NULLS LAST, o_orderkey LIMIT 40
""")
def severity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").orderBy(rank, F.desc_nulls_last("o_orderdate"), "o_orderkey")
    return rows.limit(40).select("o_orderkey", "o_orderpriority")
