"""Whole-number vectors, their matrices, and the best few of scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators.tiling import matrix, widths

_MOST = float(1 << 62)


def whole_numbers(vectors: DataFrame, key: str, vector: str, *others: str, scale: int = 256) -> DataFrame:
    """(key, v, others) of the vectors that have an id and no null or non-finite component: each component x becomes floor(scale * x), x as double.

    The id is taken to be a key: of rows that share one, the row with the smallest vector, then the smallest other columns, takes part.
    """
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    v = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & good).select(F.col(key).cast("long").alias(key), v.alias("v"), *others)
    best = rows.groupBy(key).agg(F.min(F.struct("v", *others)).alias("_row"))
    return best.select(key, "_row.*")


def matrices(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Two columns of vectors as matrices of one width: of int64 where every inner product of them is sure to fit, else of Python's whole numbers."""
    width = max([1, *(int(widths(c).max(initial=0)) for c in (a, b))])
    x, y = matrix(a, width, np.int64), matrix(b, width, np.int64)
    # a step of bounds may add up twice the largest product
    if float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(y.astype(float)).max(initial=0)) * width * 4 >= _MOST:
        return x.astype(object), y.astype(object)
    return x, y


def as_long(scores: np.ndarray) -> np.ndarray:
    """Scores as int64; what a long can't hold becomes the largest or smallest long."""
    return scores if scores.dtype == np.int64 else np.clip(scores, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best_first(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` largest scores, ties by smaller id; ids are in ascending order."""
    if len(scores) > 4 * most and scores.dtype == np.int64:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.argsort(-scores[some], kind="stable")][:most]


def ranked(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key, numbered; each task cuts what it has before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
