"""Work on every pair of a block of queries and a block of vectors, as an equal join of the tiles' numbers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most vectors, and most queries, of a block: what a task holds at a time.
VECTORS, QUERIES = 8192, 4096
#: Tasks that pairs of blocks are dealt to, at most.
MOST_TASKS = 1 << 12


def tiled(queries: DataFrame, vectors: DataFrame, key: str, function: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """function(queries, vectors), two Arrow tables, for every pair of a block of queries and a block of vectors, the latter in order of key.

    Blocks are hashes of the ids, so no value of another column makes one large, and they hold about QUERIES and VECTORS
    rows at most whatever the tables' sizes. A query goes to all blocks of vectors and a vector to all blocks of
    queries; one task holds one tile. Both tables are read twice and should be written ones.
    """
    rows, asked = vectors.count(), queries.count()
    down = max(1, -(-rows // VECTORS))
    across = max(1, -(-asked // QUERIES), min(-(-asked // 64), -(-3 * vectors.sparkSession.sparkContext.defaultParallelism // down)))
    block = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(block(across).alias("_q"), all_of(down).alias("_v"), *[F.col(c).alias(c) for c in queries.columns]).groupBy("_q", "_v")
    right = vectors.select(all_of(across).alias("_q"), block(down).alias("_v"), *[F.col(c).alias(c) for c in vectors.columns]).groupBy("_q", "_v")
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    names = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(some: pa.Table, block: pa.Table) -> pa.Table:
        if not some.num_rows or not block.num_rows:
            return names.empty_table()
        return function(some, block.sort_by(key)).cast(names)

    return left.cogroup(right).applyInArrow(run, schema)


def met(rows: DataFrame, key: str, size: int, function: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What function(x, y, same) yields for every pair of blocks of about `size` rows, once each; a block also meets itself (`same`), with the same rows as x and y.

    Blocks are hashes of the key, so rows of one key are in one block. What is shuffled is each row, once for each
    block, and never a pair of rows; a task holds two blocks. rows is read twice and should be a written table.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-rows.count() // size), math.isqrt(4 * cores))
    own = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)).cast("int")
    placed = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    placed = placed.select(F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") > F.col("_other")).alias("_second"), *rows.columns)

    def run(place: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        if place[0].as_py() == place[1].as_py():
            yield from function(both, both, True)
            return
        x, y = both.filter(pc.invert(both["_second"])), both.filter(both["_second"])
        if x.num_rows and y.num_rows:
            yield from function(x, y, False)

    # a task for about each pair of blocks: they hold few bytes but much work, and would be put into as many tasks as there are cores
    return placed.repartition(min(blocks * (blocks + 1) // 2, MOST_TASKS), "_i", "_j").groupBy("_i", "_j").applyInArrow(run, schema)


def postings(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The items of a column of lists of longs in ascending order, and the row of each."""
    items = column.combine_chunks().flatten().to_numpy()
    rows = np.repeat(np.arange(len(column)), widths(column))
    order = np.argsort(items, kind="stable")
    return items[order], rows[order]


def matrix(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    """A column of lists of numbers as the rows of a matrix; shorter ones end in zeros."""
    lists = column.combine_chunks()
    sizes = widths(column)
    out = np.zeros((len(sizes), width), kind)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return out


def widths(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
