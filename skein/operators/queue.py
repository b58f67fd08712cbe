"""Work queues as batch steps: claiming, retry delays, carrying over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retry_minutes(attempt: Column, base: int = 5, most: int = 1440) -> Column:
    """base * 2^(attempt - 1) minutes, a day at most."""
    return F.least(F.lit(most), (base * F.pow(F.lit(2), F.least(attempt, F.lit(20)) - 1)).cast("int"))


def claimable(tasks: DataFrame, key: str, host: str, due: str, now: Column, per_host: int, most: int) -> DataFrame:
    """The tasks to take now: due ones, so many of a host, the longest waiting first. A host's tasks are cut in salted parts, then together, before the overall limit."""
    from skein.operators.frames import top_of_each

    return top_of_each(tasks.where(F.col(due) <= now), [host], [F.col(due), F.col(key)], per_host, key).orderBy(due, key).limit(most).drop("nth")


def carried_over(deferred: DataFrame, fresh: DataFrame, key: str, count: str) -> DataFrame:
    """Deferred rows that are not among the fresh ones, their count one higher, with the fresh ones."""
    late = deferred.join(fresh.select(key), key, "left_anti").withColumn(count, F.col(count) + 1)
    return late.unionByName(fresh.withColumn(count, F.lit(0)), allowMissingColumns=True)


def claimed_with_leases(tasks: DataFrame, key: str, host: str, now: Column, per_host: int, most: int) -> DataFrame:
    """tasks(key, host, due, status, lease) to take now, with their turn `nth`: queued ones, and running ones whose lease has run out.

    A host gets so many at a time, less those it is still at work on. Its tasks are cut in salted parts before they are
    ranked, so that a hot host never lies in one task.
    """
    from skein.operators.frames import top_of_each

    running = (F.col("status") == "running") & (F.col("lease") >= now) & (F.col("due") <= now)
    busy = tasks.groupBy(host).agg(F.count_if(running).alias("_busy"))
    free = tasks.where(((F.col("status") == "queued") | (F.col("status") == "running") & (F.col("lease") < now)) & (F.col("due") <= now))
    ranked = top_of_each(free, [host], [F.col("due"), F.col(key)], per_host, key)
    return ranked.join(busy, host).where(F.col("nth") + F.col("_busy") <= per_host).orderBy("due", key).limit(most)


def requeued(tasks: DataFrame, again: Column) -> DataFrame:
    """Failed tasks for which `again` holds are queued anew, without the attempts they had."""
    back = (F.col("status") == "failed") & again
    return tasks.withColumns({"status": F.when(back, "queued").otherwise(F.col("status")), "attempts": F.when(back, 0).otherwise(F.col("attempts"))})
