"""How many rows of a key fall within a time before each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recent(rows: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """rows with `n`, the number of rows of the same key within so many seconds up to their own (in whole seconds).

    A key's time is cut into spans of that length. A row's time before reaches over one border at most, so a span and the
    one before it are put together; a hot key thus parts into its spans, and rows of one second are counted before.
    """
    counts = rows.groupBy(key, at).agg(F.count("*").alias("_c")).withColumn("_span", F.floor(F.col(at) / seconds))
    twice = counts.withColumn("_to", F.explode(F.array("_span", F.col("_span") + 1)))
    frame = Window.partitionBy(key, "_to").orderBy(at).rangeBetween(-(seconds - 1), 0)
    sums = twice.withColumn("n", F.sum("_c").over(frame)).where("_to = _span").select(key, at, "n")
    return rows.join(sums, [key, at])
