"""Events against their history, and decisions that name all their failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import ranges


def with_parent(events: DataFrame, key: str, same: list[str], at: str, repeat_days: float, history_days: float) -> DataFrame:
    """Each event with the latest earlier one of the same subject inside the history window: a repeat (soon after it), a follow-up, or new.

    No pairs: only the latest earlier event can be the nearest. A subject's events may lie in many parts (see ranges).
    """
    parted = ranges.previous(ranges.ranged(events, same, [at, key]), same, [at, key], [at, key], "_before").drop(ranges.PART)
    before = parted.withColumns({"_key": F.col(f"_before.{key}"), "_days": (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(f"_before.{at}").cast("timestamp"))) / 86_400_000_000}).drop("_before")
    inside = F.col("_days") <= history_days
    state = F.when(inside & (F.col("_days") <= repeat_days), "repeat").when(inside, "follow-up").otherwise("new")
    return before.withColumns({"parent": F.when(inside, F.col("_key")), "state": state}).drop("_key", "_days")


def failures(conditions: dict[str, Column]) -> Column:
    """The names of all conditions that don't hold (null counts as not), in their order."""
    return F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in conditions.items()]), lambda x: x.isNotNull())
