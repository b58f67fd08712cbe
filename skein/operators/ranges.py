"""Rows in the order of their keys, as windows see them, for keys that may hold a third of all rows.

A window brings all rows of a key into one task. Here rows are placed by ranges of key and order, so that a large key
lies in many parts; a window runs within each part, and what it needs of the parts before comes from a table with a row
for each part of such keys: less than two a part, plus one for each further part of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.tables import written

PART = "_part"


def ranged(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows in parts by ranges of key and order, as a written table with the part's number, which a second run of a task could not repeat."""
    return written(rows.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def _carried(parted: DataFrame, keys: list[str], value: Column, empty: Column, merge) -> DataFrame:
    """(keys, part, _from) for the second and later parts of each key: the values of the parts before it, merged in their order."""
    ends = parted.groupBy(*keys, PART).agg(value.alias("_end"))
    spans = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(PART, "_end"))).alias("_all")).where(F.size("_all") > 1)
    upto = lambda k: F.aggregate(F.slice("_all", F.lit(1), k), empty, lambda so_far, part: merge(so_far, part["_end"]))
    later = F.transform(F.sequence(F.lit(1), F.size("_all") - 1), lambda k: F.struct(F.get("_all", k)[PART].alias(PART), upto(k).alias("_from")))
    return spans.select(*keys, F.explode(later).alias("_x")).select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col(f"_x.{PART}").alias("_at"), "_x._from")


def _joined(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return rows.join(F.broadcast(carried), [F.col(PART) == F.col("_at"), *same], "left").drop("_at", *[f"_key_{k}" for k in keys])


def previous(parted: DataFrame, keys: list[str], order: list[str], values: list[str], name: str = "previous") -> DataFrame:
    """The rows of a ranged table with a struct of the values of the row before in their key; null for a key's first. Order must be unique in a key."""
    own = F.struct(*values)
    kind = parted.select(own.alias("s")).schema[0].dataType
    within = parted.withColumn("_own", F.lag(own).over(Window.partitionBy(PART, *keys).orderBy(*order)))
    carried = _carried(parted, keys, F.max_by(own, F.struct(*order)), F.lit(None).cast(kind), lambda so_far, part: part)
    return _joined(within, carried, keys).withColumn(name, F.coalesce("_own", "_from")).drop("_own", "_from")


def latest_known(parted: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The rows of a ranged table with the last value that isn't null, of their own row or the ones before in their key. Order decides; of rows equal in it, any may be last."""
    kind = parted.schema[value].dataType
    frame = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = parted.withColumn("_own", F.last(value, ignorenulls=True).over(frame))
    end = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    carried = _carried(parted, keys, end, F.lit(None).cast(kind), lambda so_far, part: F.coalesce(part, so_far))
    return _joined(within, carried, keys).withColumn(name, F.coalesce("_own", "_from")).drop("_own", "_from")


def running(parted: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The rows of a ranged table with the sum of a whole number over their key's rows up to their own. Order must be unique in a key."""
    frame = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    number = F.coalesce(F.col(value).cast("long"), F.lit(0).cast("long"))
    within = parted.withColumn("_own", F.sum(number).over(frame))
    carried = _carried(parted, keys, F.sum(number), F.lit(0).cast("long"), lambda so_far, part: so_far + part)
    return _joined(within, carried, keys).withColumn(name, F.col("_own") + F.coalesce("_from", F.lit(0).cast("long"))).drop("_own", "_from")
