"""Period windows, statistics and series over dated rows (orders as issues, events as a log)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import frames, ranges
from skein.operators.periods import anchored, day_spine, with_previous_day
from skein.plans.registry import query
from skein.session import table


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))


@query("""
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus, o_totalprice FROM orders),
a AS (SELECT max(day) AS anchor FROM o),
spine AS (SELECT CAST(d AS DATE) AS day FROM a, generate_series(a.anchor - INTERVAL 29 DAY, a.anchor, INTERVAL 1 DAY) AS t(d)),
agg AS (SELECT day, count(*) AS viewed, count(*) FILTER (WHERE o_orderstatus = 'F') AS included, count(*) FILTER (WHERE o_orderstatus <> 'F') AS cut, sum(o_totalprice) AS total FROM o GROUP BY day)
SELECT spine.day, coalesce(viewed, 0) AS viewed, coalesce(included, 0) AS included, coalesce(cut, 0) AS cut, round(coalesce(total, 0), 2) AS total
FROM spine LEFT JOIN agg USING (day)
""")
def window_series_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 30 days up to the latest issue, with days that have none."""
    issues = _issues(spark, sf_dir)
    daily = anchored(issues, "day", 30).groupBy("day").agg(
        F.count("*").alias("viewed"), F.count_if(F.col("o_orderstatus") == "F").alias("included"), F.count_if(F.col("o_orderstatus") != "F").alias("cut"), F.sum("o_totalprice").alias("total")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return day_spine(issues, "day", 30).join(daily, "day", "left").select("day", zero("viewed").alias("viewed"), zero("included").alias("included"), zero("cut").alias("cut"), F.round(zero("total"), 2).alias("total"))


@query("""
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 90)
SELECT day, n, sum(n) OVER (ORDER BY day) AS running FROM d
""")
def series_last_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 90 days that have rows (not zero-filled), with a running sum over those 90 rows."""
    last = _issues(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(90)
    return last.withColumn("running", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


@query("""
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1),
p AS (SELECT d.day, max(e.day) AS previous FROM d LEFT JOIN d e ON e.day < d.day GROUP BY d.day)
SELECT d.day, p.previous, d.n, x.n AS n_before, d.n - coalesce(x.n, 0) AS change FROM d JOIN p USING (day) LEFT JOIN d x ON x.day = p.previous
""")
def day_against_previous_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day against the previous day that has rows, not the calendar's."""
    return with_previous_day(_issues(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n")), "day", "n")


@query("""
WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders), a AS (SELECT max(day) AS anchor FROM o)
SELECT p.period, coalesce(sum(o_totalprice), 0) AS total, count(o_orderkey) AS n, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS urgent
FROM (VALUES ('day', 0), ('7d', 6), ('30d', 29)) p(period, back) CROSS JOIN a LEFT JOIN o ON o.day BETWEEN a.anchor - p.back * INTERVAL 1 DAY AND a.anchor GROUP BY p.period
""")
def period_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sums over three windows that end at the latest issue."""
    issues = _issues(spark, sf_dir)
    parts = []
    for name, days in (("day", 1), ("7d", 7), ("30d", 30)):
        sums = anchored(issues, "day", days).agg(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("total"), F.count("o_orderkey").alias("n"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("urgent"))
        parts.append(sums.select(F.lit(name).alias("period"), "*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2
""")
def events_tumbling_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").start.alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("users"))


@query("""
WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, session
""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user: events no more than 30 minutes after the one before."""
    order = ["ts", "event_id"]
    parted = ranges.ranged(table(spark, sf_dir, "events").select("user_id", *order), ["user_id"], order)
    gap = F.col("ts") - F.col("previous.ts")
    fresh = ranges.previous(parted, ["user_id"], order, ["ts"]).withColumn("fresh", F.when(gap <= F.expr("INTERVAL '30' MINUTE"), 0).otherwise(1))
    numbered = ranges.running(fresh, ["user_id"], order, "fresh", "session")
    return numbered.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


@query("""
SELECT event_id, user_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current view of an append-only log: the latest row of each key wins."""
    return frames.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "ts"])


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice, nth FROM r WHERE nth <= 6
""")
def top_six_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most six samples of each group, the best first."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return frames.top_of_each(rows, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 6, "o_orderkey")


@query("""
WITH e AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE before IS NOT NULL AND event_id <> before + 1) AS gaps FROM e GROUP BY user_id
""")
def contiguity_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = ranges.ranged(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"])
    rows = ranges.previous(parted, ["user_id"], ["event_id"], ["event_id"]).withColumn("before", F.col("previous.event_id"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("before").isNotNull() & (F.col("event_id") != F.col("before") + 1)).alias("gaps"))


@query("""
WITH c AS (SELECT (CAST(ts AS DATE))::DATE AS day, event_type, count(*) AS c FROM events GROUP BY 1, 2),
w AS (SELECT event_type, sum(CASE WHEN day > (SELECT max(day) FROM c) - INTERVAL 7 DAY THEN c ELSE 0 END) AS cur, sum(CASE WHEN day <= (SELECT max(day) FROM c) - INTERVAL 7 DAY AND day > (SELECT max(day) FROM c) - INTERVAL 14 DAY THEN c ELSE 0 END) AS prev FROM c GROUP BY 1),
t AS (SELECT sum(cur) AS tc, sum(prev) AS tp, count(*) AS r FROM w)
SELECT event_type, CAST(cur AS BIGINT) AS cur, CAST(prev AS BIGINT) AS prev, round(100 * ln(((cur + 1.0) / (tc + r)) / ((prev + 1.0) / (tp + r))), 4) AS idx,
CASE WHEN 100 * ln(((cur + 1.0) / (tc + r)) / ((prev + 1.0) / (tp + r))) > 10 THEN 'up' WHEN 100 * ln(((cur + 1.0) / (tc + r)) / ((prev + 1.0) / (tp + r))) < -10 THEN 'down' ELSE 'flat' END AS direction,
CASE WHEN tc < r THEN 'low' WHEN cur + prev >= 10 AND tc >= 30 THEN 'high' WHEN cur + prev >= 4 AND tc >= 10 THEN 'medium' ELSE 'low' END AS confidence
FROM w, t
""")
def rubric_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laplace-smoothed share of each class against the window before, as a log ratio, with direction and confidence."""
    days = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    last = days.agg(F.max("day").alias("last"))
    aged = days.join(F.broadcast(last)).withColumn("age", F.datediff("last", "day"))
    counts = aged.groupBy("event_type").agg(F.count_if(F.col("age") < 7).alias("cur"), F.count_if((F.col("age") >= 7) & (F.col("age") < 14)).alias("prev"))
    totals = counts.agg(F.sum("cur").alias("tc"), F.sum("prev").alias("tp"), F.count("*").alias("r"))
    share = lambda c, t: (F.col(c) + 1.0) / (F.col(t) + F.col("r"))
    out = counts.join(F.broadcast(totals)).withColumn("raw", 100 * F.log(share("cur", "tc") / share("prev", "tp")))
    support = F.col("cur") + F.col("prev")
    confidence = F.when(F.col("tc") < F.col("r"), "low").when((support >= 10) & (F.col("tc") >= 30), "high").when((support >= 4) & (F.col("tc") >= 10), "medium").otherwise("low")
    direction = F.when(F.col("raw") > 10, "up").when(F.col("raw") < -10, "down").otherwise("flat")
    return out.select("event_type", "cur", "prev", F.round("raw", 4).alias("idx"), direction.alias("direction"), confidence.alias("confidence"))
