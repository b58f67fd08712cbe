"""Reports: nested counts, groups with examples, percentiles by place, one-row aggregates side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nested_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(first key, counts, n): counts by the other keys as maps within maps. Every level is grouped from the one below."""
    level = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("counts", F.col("n"))
    for depth in range(len(keys) - 1, 0, -1):
        entry = F.struct(F.col(keys[depth]).cast("string").alias("key"), F.col("counts").alias("value"))
        level = level.groupBy(*keys[:depth]).agg(F.map_from_entries(F.collect_list(entry)).alias("counts"), F.sum("n").alias("n"))
    return level


def side_by_side(parts: list[DataFrame]) -> DataFrame:
    """One-row tables as one row."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)


def with_examples(rows: DataFrame, keys: list[str], example: str, most: int, *more: Column) -> DataFrame:
    """(keys, n, more, examples): groups with their `most` smallest examples.

    The examples are cut within salted parts of a group before they meet, so a large group never lies in one task.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(example), F.lit(64)))
    part = Window.partitionBy(*keys, "_salt").orderBy(example)
    few = salted.select(*keys, "_salt", example).withColumn("_nth", F.row_number().over(part)).where(F.col("_nth") <= most)
    few = few.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(example)), 1, most).alias("examples"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), *more)
    return counts.join(few, keys)


def percentiles_by_place(rows: DataFrame, keys: list[str], value: str, places: dict[str, tuple[int, int]]) -> DataFrame:
    """(keys, a column for each place, last): the value at place n * a // b of the sorted values, counted from 0.

    Equal values are counted first; the running sum goes over distinct values only.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    placed = counts.select(*keys, value, upto.alias("_upto"), total.alias("_total"))
    at = lambda a, b: F.least(F.col("_total") - 1, F.floor(F.col("_total") * a / b))
    return placed.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") > at(a, b), F.col(value))).alias(name) for name, (a, b) in places.items()], F.max(value).alias("last"))
