"""Queries of window frames, latest rows, orders, limits and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import frames, ranges
from skein.plans.registry import query
from skein.session import table


@query("""
WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, sum(n) OVER w7 AS week, sum(n) OVER w30 AS month, round(avg(n) OVER w7, 4) AS mean FROM d
WINDOW w7 AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), w30 AS (ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)
""")
def moving_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the last 7 and 30 days at every day; the window runs over one row a day."""
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    week, month = frames.last_days("day", 7), frames.last_days("day", 30)
    return daily.select("day", "n", F.sum("n").over(week).alias("week"), F.sum("n").over(month).alias("month"), F.round(F.avg("n").over(week), 4).alias("mean"))


@query("""
SELECT l_orderkey, l_linenumber, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(3) OVER t AS third, lead(l_quantity) OVER t AS next, first_value(l_partkey) OVER t AS first, last_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, round(percent_rank() OVER w, 6) AS pr FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_returnflag), t AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)
""")
def ranking_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ranks and neighbours of a line within its order, from one sort for each order of rows."""
    by_flag, by_line = Window.partitionBy("l_orderkey").orderBy("l_returnflag"), Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    whole = by_line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.rank().over(by_flag).alias("r"), F.dense_rank().over(by_flag).alias("dr"), F.ntile(3).over(by_line).alias("third"), F.lead("l_quantity").over(by_line).alias("next"),
        F.first("l_partkey").over(by_line).alias("first"), F.last("l_partkey").over(whole).alias("last"), F.round(F.percent_rank().over(by_flag), 6).alias("pr"),
    )


@query("""
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE nth = greatest(1, n // 2)
""")
def middle_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle part of each whole."""
    place = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(place).alias("nth"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    return rows.where("nth = greatest(1, n div 2)").select("conv_id", "turn", "role")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events WHERE event_type <> 'error'), h AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events)
SELECT r.user_id, r.event_id AS latest, r.value, h.event_id AS first_view FROM r LEFT JOIN h ON h.user_id = r.user_id AND h.event_type = 'view' AND h.nth = 1 WHERE r.nth = 1
""")
def latest_of_a_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key among those that count, filtered before it is chosen, and the first of two keys; both by maxima that merge before the shuffle."""
    events = table(spark, sf_dir, "events")
    latest = frames.latest(events.where("event_type <> 'error'"), ["user_id"], ["ts", "event_id"], ["event_id", "value"])
    first = frames.earliest(events.where("event_type = 'view'"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id"]).select("user_id", F.col("event_id").alias("first_view"))
    return latest.withColumnRenamed("event_id", "latest").join(first, "user_id", "left")


@query("""
WITH b AS (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) AS nth FROM lineitem) SELECT l_orderkey, l_partkey, l_quantity FROM b WHERE nth = 1 ORDER BY l_quantity DESC, l_orderkey LIMIT 40
""")
def best_then_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of each key, then the best forty of those."""
    best = frames.latest(table(spark, sf_dir, "lineitem").withColumn("_less", -F.col("l_partkey")), ["l_orderkey"], ["l_quantity", "_less"], ["l_partkey", "l_quantity"])
    return best.orderBy(F.desc("l_quantity"), "l_orderkey").limit(40)


@query("""
SELECT day, n, row_number() OVER (ORDER BY day) AS issue FROM (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1)
""")
def issue_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days numbered in order; only one row a day is numbered."""
    daily = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return daily.withColumn("issue", F.row_number().over(Window.orderBy("day")))


@query("""
WITH r AS (SELECT o_orderkey, o_orderdate::DATE AS day, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) - 1 AS sort_order FROM orders) SELECT o_orderkey, day, sort_order, 'm_' || left(sha256('material:' || strftime(day, '%Y-%m-%d') || ':' || sort_order), 20) AS id FROM r
""")
def numbered_within_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's place within its day, from 0, and the id that follows from both. A day may have any number of rows: they are counted in ranges."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.lit(1).alias("one"))
    counted = ranges.running(ranges.ranged(rows, ["day"], ["o_orderkey"]), ["day"], ["o_orderkey"], "one", "place")
    rows = counted.select("o_orderkey", "day", (F.col("place") - 1).alias("sort_order"))
    return rows.withColumn("id", F.concat(F.lit("m_"), F.left(F.sha2(F.concat(F.lit("material:"), F.col("day").cast("string"), F.lit(":"), F.col("sort_order").cast("string")), 256), F.lit(20))))


@query("""
SELECT o_orderkey FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 60
""")
def four_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixty rows by priority, price, date and id, the number asked for held below a hard limit."""
    urgency = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return frames.page(table(spark, sf_dir, "orders"), [urgency, F.desc("o_totalprice"), F.desc("o_orderdate"), F.col("o_orderkey")], 60, 500).select("o_orderkey")


@query("""
SELECT user_id, event_id FROM events WHERE event_type = 'click' ORDER BY sha256(user_id || ':' || event_id), event_id LIMIT 100
""")
def blind_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order that tells nothing of the rows: by a digest of their keys."""
    return table(spark, sf_dir, "events").where("event_type = 'click'").orderBy(F.sha2(F.concat_ws(":", "user_id", "event_id"), 256), "event_id").limit(100).select("user_id", "event_id")


@query("""
WITH s AS (SELECT l_orderkey, max(l_shipdate) FILTER (WHERE l_returnflag = 'R') AS returned, max(l_shipdate) FILTER (WHERE l_linestatus = 'F') AS done FROM lineitem GROUP BY 1)
SELECT l_orderkey, greatest(returned, done)::DATE AS at FROM s ORDER BY greatest(returned, done) DESC NULLS LAST, l_orderkey LIMIT 50
""")
def greatest_of_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the later of two dates, either of which may be missing, those with neither last."""
    dates = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("returned"), F.max(F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))).alias("done"))
    return dates.select("l_orderkey", F.greatest("returned", "done").alias("at")).orderBy(F.desc_nulls_last("at"), "l_orderkey").limit(50).select("l_orderkey", F.to_date("at").alias("at"))


@query("""
WITH c AS (SELECT conv_id, turn, length(text) AS chars, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS upto FROM conversations) SELECT conv_id, turn, CASE WHEN upto <= 1200 THEN chars ELSE chars - (upto - 1200) END AS kept FROM c WHERE upto - chars < 1200
""")
def budget_fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turns of a conversation that fit a budget of characters, the earliest of them cut to what is left."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"), (-F.col("turn")).alias("back"))
    return frames.within_budget(rows, ["conv_id"], ["back"], "chars", 1200).select("conv_id", "turn", "kept")


@query("""
WITH p AS (SELECT event_id, user_id, event_type, ts, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS late FROM events), f AS (SELECT *, row_number() OVER (ORDER BY late, ts, event_id) AS nth FROM p) SELECT event_id, nth, nth <= 80 AS chosen FROM f WHERE nth <= 120
""")
def batch_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows put off before come first, then by time; the next ones are shown with them. Only those are numbered."""
    late = F.when(F.col("event_type") == "error", 0).otherwise(1)
    top = table(spark, sf_dir, "events").select("event_id", "ts", late.alias("late")).orderBy("late", "ts", "event_id").limit(120)
    ranked = top.withColumn("nth", F.row_number().over(Window.orderBy("late", "ts", "event_id")))
    return ranked.select("event_id", "nth", (F.col("nth") <= 80).alias("chosen"))


@query("""
WITH m AS (SELECT l_orderkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS nth FROM lineitem), g AS (SELECT l_suppkey, max(l_quantity) AS top, list(l_orderkey ORDER BY nth) AS best FROM m WHERE nth <= 6 GROUP BY 1)
SELECT l_suppkey, top, array_to_string(best, ',') AS best FROM g ORDER BY top DESC, l_suppkey LIMIT 30
""")
def groups_by_their_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in the order of their best member, with their six best members. A group's rows are cut within salted parts first."""
    order = [F.desc("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")]
    best = frames.top_of_each(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_orderkey", "l_linenumber"), ["l_suppkey"], order, 6, "l_orderkey")
    groups = best.groupBy("l_suppkey").agg(F.max("l_quantity").alias("top"), F.array_sort(F.collect_list(F.struct("nth", "l_orderkey"))).alias("b"))
    return groups.orderBy(F.desc("top"), "l_suppkey").limit(30).select("l_suppkey", "top", F.array_join(F.transform("b", lambda x: x["l_orderkey"].cast("string")), ",").alias("best"))


@query("""
WITH s AS (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY len(regexp_extract_all(lower(text), 'the ')) DESC, doc_id) AS nth FROM documents WHERE contains(lower(text), 'the ')) SELECT lang, doc_id, nth FROM s WHERE nth <= 10
""")
def ranked_within_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best matches of each language, ranked among the rows that match at all."""
    hits = table(spark, sf_dir, "documents").select("lang", "doc_id", F.regexp_count(F.lower("text"), F.lit("the ")).alias("n")).where("n > 0")
    return frames.top_of_each(hits, ["lang"], [F.desc("n"), F.col("doc_id")], 10, "doc_id").select("lang", "doc_id", "nth")
