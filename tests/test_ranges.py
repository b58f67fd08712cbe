"""Ranged windows against Spark's own, with a key that holds most rows, null keys and null values."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import frames, joining, queue, ranges


@pytest.fixture
def rows(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows would be one part
    made = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"),
        F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("at"), "id", F.when(F.col("id") % 5 == 0, F.col("id")).alias("value"),
    )
    yield made
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_ranged_windows(rows):
    order = ["at", "id"]
    parted = ranges.ranged(rows, ["key"], order)
    assert parted.where("key = 'hot'").select(ranges.PART).distinct().count() > 1
    found = ranges.running(ranges.latest_known(ranges.previous(parted, ["key"], order, ["id", "value"]), ["key"], order, "value", "known"), ["key"], order, "value", "total")
    w = Window.partitionBy("key").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = rows.select("id", F.lag("id").over(w), F.lag("value").over(w), F.last("value", ignorenulls=True).over(upto), F.coalesce(F.sum("value").over(upto), F.lit(0)))
    assert sorted(map(tuple, found.select("id", "previous.id", "previous.value", "known", "total").collect())) == sorted(map(tuple, plain.collect()))
    assert ranges.previous(ranges.ranged(rows.where("false"), ["key"], order), ["key"], order, ["id"]).count() == 0


def test_uses_of_hot_keys(rows):
    left, right = rows.where("id % 2 = 0").select("key", "at", "id"), rows.where("id % 2 = 1").select("key", "at", F.col("id").alias("other"))
    found = {r.id: r.other for r in joining.as_of(left.where("key is not null"), right, ["key"], "at", ["other"]).collect()}
    given = {}
    for r in right.collect():
        given.setdefault(r.key, []).append((r.at, r.other))
    for r in left.where("key is not null").collect():
        before = [x for x in given.get(r.key, []) if x[0] <= r.at]
        best = max(before)[0] if before else None
        assert found[r.id] in {o for a, o in before if a == best} if before else found[r.id] is None
    kept = frames.within_budget(rows.withColumn("size", F.lit(10)), ["key"], ["at", "id"], "size", 95)
    assert {(r.key, r.n, r.s) for r in kept.groupBy("key").agg(F.count("*").alias("n"), F.sum("kept").alias("s")).where("key = 'hot' or key is null").collect()} == {("hot", 10, 95), (None, 10, 95)}
    taken = queue.claimable(rows.where("key is not null"), "id", "key", "at", F.lit(50_000), 2, 10_000)
    assert taken.groupBy("key").count().agg(F.max("count")).first()[0] == 2
