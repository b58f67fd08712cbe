"""Elements of releases and what names them: digests that don't depend on the order or place of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elements(rows: DataFrame, kind: str, key: Column, parts: list[Column]) -> DataFrame:
    """(kind, key, digest): one element a row; the digest is of its parts, a line each, null as an empty one."""
    text = F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return rows.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.sha2(text, 256).alias("digest"))


def composed(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def digest_of_rows(line: Column) -> Column:
    """An aggregate over any number of rows: the digest of their count and of the sums of the eight 32-bit words of each line's SHA-256.

    The same lines give the same digest in every order, so no sort puts all lines in one task and partial sums meet in the shuffle.
    """
    words = [F.sum(F.conv(F.substring(F.sha2(line, 256), 1 + 8 * k, 8), 16, 10).cast("decimal(10,0)")).cast("decimal(38,0)").cast("string") for k in range(8)]
    return F.sha2(F.concat_ws("-", F.count("*").cast("string"), *words), 256)


def identities(parts: DataFrame, by: list[str]) -> DataFrame:
    """Elements and identity of each group of elements."""
    return parts.groupBy(*by).agg(F.count("*").alias("elements"), digest_of_rows(F.concat_ws(" ", "kind", "key", "digest")).alias("identity"))


def identity(parts: DataFrame) -> str:
    """The identity of a whole release."""
    return parts.agg(digest_of_rows(F.concat_ws(" ", "kind", "key", "digest"))).first()[0]
