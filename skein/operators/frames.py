"""Latest rows, moving frames, budgets, and the best few of each group without bringing a group together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from skein.operators import ranges

SALTS = 64


def last_days(day: str, days: int) -> WindowSpec:
    """The last so many days up to each row's own. For tables of one row a day, which one task can hold."""
    return Window.orderBy(F.date_diff(F.col(day), F.lit("1970-01-01").cast("date"))).rangeBetween(1 - days, 0)


def latest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """(keys, values) of the row with the greatest order in each key: one maximum, merged before the shuffle, so that no key's rows meet."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(order)], F.struct(*values).alias("_v"))).alias("_m"))
    return best.select(*keys, *[F.col(f"_m._v.{v}").alias(v) for v in values])


def earliest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """As latest, of the row with the smallest order."""
    best = rows.groupBy(*keys).agg(F.min(F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(order)], F.struct(*values).alias("_v"))).alias("_m"))
    return best.select(*keys, *[F.col(f"_m._v.{v}").alias(v) for v in values])


def top_of_each(rows: DataFrame, keys: list[str], order: list[Column], most: int, salt: str) -> DataFrame:
    """The first `most` rows of each key with their place `nth`. A key's rows are first cut in SALTS parts, so a hot key never lies in one task."""
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    few = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS))).withColumn("nth", F.row_number().over(part)).where(F.col("nth") <= most).drop("_salt", "nth")
    return few.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= most)


def page(rows: DataFrame, order: list[Column], asked: int, most: int) -> DataFrame:
    """The first rows in an order, as many as asked for but never more than `most`."""
    return rows.orderBy(*order).limit(min(max(asked, 1), most))


def within_budget(rows: DataFrame, keys: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Rows of each key, in order, while their sizes (whole numbers) fit a budget, with `kept`: the size, of the last one what is left of the budget."""
    upto = ranges.running(ranges.ranged(rows, keys, order), keys, order, size, "_upto").drop(ranges.PART)
    taken = upto.where(F.col("_upto") - F.col(size) < budget)
    return taken.withColumn("kept", F.when(F.col("_upto") <= budget, F.col(size)).otherwise(F.col(size) - (F.col("_upto") - budget))).drop("_upto")
