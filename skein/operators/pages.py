"""Pages and merges of ordered rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keyset_page(df: DataFrame, first: str, second: str, before_first: Column, before_second: Column, size: int) -> DataFrame:
    """The rows before a compound key in descending order, one more than the page holds; the key's filter reaches the scan."""
    older = (F.col(first) < before_first) | ((F.col(first) == before_first) & (F.col(second) < before_second))
    return df.where(older).orderBy(F.desc(first), F.desc(second)).limit(size + 1)


def offset_page(ordered: DataFrame, offset: int, size: int) -> DataFrame:
    return ordered.offset(offset).limit(size)


def interleaved(left: DataFrame, right: DataFrame, key: str, most: int) -> DataFrame:
    """(key, place) of two short ranked lists (each with its measure second, the largest first) taken in turns."""

    def placed(df: DataFrame, side: int) -> DataFrame:
        measure = df.columns[1]
        return df.select(key, (2 * F.row_number().over(Window.orderBy(F.desc(measure), key)) + side).alias("place"))

    both = placed(left, 0).unionByName(placed(right, 1))
    return both.groupBy(key).agg(F.min("place").alias("place")).orderBy("place").limit(most)


def cursor(query: str, **place: Column) -> Column:
    """An opaque mark of a row's place in a query's order: its values and what the query asks, as base64 of JSON."""
    return F.base64(F.to_json(F.struct(F.lit(_signature(query)).alias("query"), *[p.cast("string").alias(n) for n, p in sorted(place.items())])).cast("binary"))


def opened(mark: Column, query: str, names: list[str]) -> Column:
    """The place that a cursor names, as a struct of strings; null for marks of another query and for what is no mark."""
    text = F.try_to_binary(mark, F.lit("base64")).cast("string")
    held = F.from_json(text, "struct<query: string, " + ", ".join(f"{n}: string" for n in sorted(names)) + ">")
    return F.when(held["query"] == _signature(query), F.struct(*[held[n].alias(n) for n in names]))


def _signature(query: str) -> str:
    return hashlib.sha256(query.encode()).hexdigest()[:16]
