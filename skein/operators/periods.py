"""Windows in days that end at the latest row's day (never at today's)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def anchor(df: DataFrame, day: str) -> DataFrame:
    return df.agg(F.max(day).alias("anchor"))


def anchored(df: DataFrame, day: str, days: int) -> DataFrame:
    """Rows of the last `days` days up to the latest one. The anchor is one row, so broadcasting it is bounded."""
    last = F.broadcast(anchor(df, day))
    return df.join(last, (F.col(day) <= F.col("anchor")) & (F.col(day) > F.date_sub(F.col("anchor"), days))).drop("anchor")


def day_spine(df: DataFrame, day: str, days: int) -> DataFrame:
    """One row for each of the last `days` days up to the latest one."""
    return anchor(df, day).where("anchor is not null").select(F.explode(F.sequence(F.date_sub("anchor", days - 1), F.col("anchor"))).alias(day))


def with_previous_day(daily: DataFrame, day: str, value: str) -> DataFrame:
    """Adds the previous day that has a row, its value and the change. `daily` has one row a day, so a single ordered window is bounded by the calendar."""
    w = Window.orderBy(day)
    before = F.lag(value).over(w)
    return daily.select(day, F.lag(day).over(w).alias("previous"), value, before.alias(f"{value}_before"), (F.col(value) - F.coalesce(before, F.lit(0))).alias("change"))


def optional_filters(rows: DataFrame, equal: dict[str, tuple], least: dict[str, object], search: tuple[str | None, list[str]]) -> DataFrame:
    """rows under the filters that are given: None is no filter, nor is a value outside the allowed ones; the search term is in any of its columns."""
    for column, (value, allowed) in equal.items():
        if value is not None and (allowed is None or value in allowed):
            rows = rows.where(F.col(column) == value)
    for column, value in least.items():
        if value is not None:
            rows = rows.where(F.col(column) >= value)
    term, columns = search
    if term:
        rows = rows.where(reduce(lambda a, b: a | b, [F.lower(c).contains(term.lower()) for c in columns]))
    return rows
