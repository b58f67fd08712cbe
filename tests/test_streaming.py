"""A stream over the files gives what the batch gives."""

import random

from pyspark.sql import functions as F

from skein.streaming import events as stream
from skein.streaming import tasks

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    folder = str(tmp_path / "in")
    rows.repartition(4).write.parquet(folder)
    run = stream.hopping_counts(stream.source(spark, folder), late="3650 days").writeStream.format("memory").queryName("hops").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.table("hops").collect()}
    assert got == {(r.start, r.event_type): r.n for r in stream.hopping_counts(rows).collect()}


def test_first_seen_drops_repeats(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    folder = str(tmp_path / "in")
    rows.unionByName(rows).repartition(3).write.parquet(folder)
    run = stream.first_seen(stream.source(spark, folder), late="3650 days").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("seen").count() == rows.count()


def _by_hand(rows, until):
    """The machine by its rules, over the rows of each task in order."""
    out = []
    for task in {r[0] for r in rows}:
        failures, due, step = 0, None, None
        for at, kind in sorted((at, kind) for t, at, kind in rows if t == task and at <= until) + [(None, None)]:
            if due is not None and due <= until and (at is None or due <= at):
                out.append((task, due, step, failures))
            due = None
            if kind == "claimed":
                due, step = at + tasks.LEASE_MS, "lease over"
            elif kind == "failed":
                failures += 1
                if failures == tasks.TRIES:
                    out.append((task, at, "given up", failures))
                    failures = 0
                else:
                    due, step = at + tasks.wait_ms(failures), "again"
            elif kind == "done":
                failures = 0
    return sorted(out)


def test_timers_equal_the_rules_across_a_restart_and_without_late_rows(spark, tmp_path):
    rng = random.Random(5)
    start, minute = 1_700_000_000_000, 60_000
    rows = [(rng.randint(1, 6) if rng.random() < 0.6 else 1, start + rng.randint(0, 3000) * minute, rng.choice(["claimed", "failed", "failed", "done", "queued"])) for _ in range(400)]
    rows.sort(key=lambda r: r[1] + rng.randint(0, 40) * minute)  # out of order, within the hour
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    before = spark.conf.get(tasks.STORE[0])
    spark.conf.set(*tasks.STORE)

    def add(some):
        df = spark.createDataFrame(some, "task long, at long, kind string")
        df.select("task", F.timestamp_millis("at").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema("task long, ts timestamp, kind string").parquet(folder)
        tasks.steps(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(120)

    try:
        add(rows[:200])
        run()
        add(rows[200:])
        run()  # from the checkpoint
        add([(1, start + minute, "claimed"), (1, start + 2 * minute, "failed"), (None, start, "claimed")])  # far too late
        run()
    finally:
        spark.conf.set(tasks.STORE[0], before)
    got = sorted(tuple(r) for r in spark.read.schema(tasks.OUT).parquet(out).collect())
    assert got == _by_hand(rows, max(r[1] for r in rows) - 60 * minute)
    assert {"lease over", "again", "given up"} == {r[2] for r in got}
