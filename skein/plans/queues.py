"""Queries over the event log as a work queue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import queue
from skein.plans.registry import query
from skein.session import table
from skein.streaming import events as stream
from skein.streaming import tasks
from skein.tables import shared_folder


@query("""
WITH r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events WHERE event_type <> 'purchase')
SELECT event_id, user_id, ts FROM r WHERE turn <= 2 ORDER BY ts, event_id LIMIT 100
""")
def claim_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 longest waiting tasks, two of a host at most."""
    tasks = table(spark, sf_dir, "events").where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return queue.claimable(tasks, "event_id", "user_id", "ts", F.lit("9999-01-01").cast("timestamp"), 2, 100)


@query("""
SELECT user_id, count(*) AS attempts, CAST(least(1440, 5 * pow(2, least(count(*), 20) - 1)) AS INTEGER) AS wait FROM events WHERE event_type = 'click' GROUP BY user_id
""")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = table(spark, sf_dir, "events").where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("attempts"))
    return tries.select("user_id", "attempts", queue.retry_minutes(F.col("attempts")).alias("wait"))


@query("""
WITH w AS (SELECT unnest([date_trunc('hour', ts) + CASE WHEN minute(ts) >= 30 THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END, date_trunc('hour', ts) + CASE WHEN minute(ts) >= 30 THEN INTERVAL 0 MINUTE ELSE INTERVAL (-30) MINUTE END]) AS start, event_type, value FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2
""")
def hopping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator over the same rows as a batch."""
    return stream.hopping_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""
WITH e AS (SELECT user_id AS task, epoch_us(ts) // 1000 AS at_ms, CASE event_type WHEN 'view' THEN 'claimed' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS kind, event_id FROM events), o AS (SELECT *, row_number() OVER w AS n, lead(at_ms) OVER w AS following FROM e WINDOW w AS (PARTITION BY task ORDER BY at_ms, kind, event_id)),
u AS (SELECT max(at_ms) - 3600000 AS until FROM e), b AS (SELECT *, count(*) FILTER (WHERE kind = 'done') OVER (PARTITION BY task ORDER BY n) AS span FROM o), f AS (SELECT *, CASE WHEN kind = 'failed' THEN 1 + (row_number() OVER (PARTITION BY task, span, kind ORDER BY n) - 1) % 6 END AS failure FROM b),
g AS (SELECT *, coalesce(last_value(failure IGNORE NULLS) OVER (PARTITION BY task, span ORDER BY n), 0) % 6 AS so_far FROM f), d AS (SELECT *, CASE WHEN kind = 'claimed' THEN at_ms + 1800000 WHEN kind = 'failed' AND failure < 6 THEN at_ms + least(86400000, 300000 * 2 ** (failure - 1))::BIGINT END AS due FROM g)
SELECT task, due AS at_ms, CASE kind WHEN 'claimed' THEN 'lease over' ELSE 'again' END AS step, so_far::INT AS failures FROM d, u WHERE due <= until AND at_ms <= until AND (following IS NULL OR following > until OR due <= following)
UNION ALL SELECT task, at_ms, 'given up', 6 FROM d, u WHERE failure = 6 AND at_ms <= until
""")
def task_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream of tasks' rows: leases that ran out, retries that came due, tasks given up, up to the watermark."""
    events = table(spark, sf_dir, "events")
    folder = f"{shared_folder(spark)}/skein-tasks-{uuid.uuid4().hex}"
    kind = F.when(F.col("event_type") == "view", "claimed").when(F.col("event_type") == "purchase", "done").otherwise("failed")
    events.select(F.col("user_id").alias("task"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind")).write.parquet(f"{folder}/in")
    before = spark.conf.get(tasks.STORE[0])
    spark.conf.set(*tasks.STORE)
    try:
        rows = spark.readStream.schema("task long, ts timestamp, kind string").parquet(f"{folder}/in")
        run = tasks.steps(rows).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(tasks.STORE[0], before)
    return spark.read.schema(tasks.OUT).parquet(f"{folder}/out")
