"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are dealt into partitions by a hash, whatever files they come from. How many rows each partition sends to each shard
is drawn from the exact distribution that a uniform shuffle of all rows would have. The matrix is drawn down a tree:
the driver draws it for at most FAN groups of partitions, and each group is then split among its FAN parts, in tasks,
until single partitions are reached; given a group's row, its parts' rows are hypergeometric again. Each partition
permutes its rows and sends the first so many to shard 0, the next to shard 1, and so on; each shard permutes what it
got, in blocks of a hash's range so that no task holds a whole shard. Rows get a number when they are written first, which
parts even wholly equal rows; all draws follow from the seed and that table, so a lost task comes out the same again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.tables import written

#: Rows of a partition and of a block of a shard, about.
BLOCK_ROWS = 4096
#: Parts of one group in the tree of partitions.
FAN = 256
#: Sizes that numpy's sampler takes.
NUMPY_MOST = 10**9


def communication(counts: list[int], left: list[int], rng: np.random.Generator) -> np.ndarray:
    """Rows that each part sends to each shard: a random matrix with these row and column sums, as a uniform shuffle would give it."""
    left, out = np.array(left, np.int64), np.zeros((len(counts), len(left)), np.int64)
    for k, need in enumerate(counts):
        # one shard after the other: the conditional draw is hypergeometric
        ahead = int(left.sum())
        for s in range(len(left)):
            ahead -= int(left[s])
            out[k, s] = hypergeometric(rng, int(left[s]), ahead, need)
            need -= int(out[k, s])
        left -= out[k]
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int, most: int = NUMPY_MOST) -> int:
    """How many of `good` are in a sample from good and bad.

    Beyond numpy's range by inversion: the law's ratios of neighbouring terms are multiplied up and down from the mode,
    over more than twelve standard deviations, beyond which less than a double's resolution lies.
    """
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    if max(good, bad) < most:
        return int(rng.hypergeometric(good, bad, sample))
    total = good + bad
    mode = min(high, max(low, (sample + 1) * (good + 1) // (total + 2)))
    spread = (sample * (good / total) * (bad / total) * ((total - sample) / max(1, total - 1))) ** 0.5
    reach = int(13 * spread) + 50
    low, high = max(low, mode - reach), min(high, mode + reach)
    up = np.arange(mode, high, dtype=np.float64)  # the ratio of the term after each to it
    down = np.arange(mode, low, -1, dtype=np.float64)
    above = np.cumprod((good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1)))
    below = np.cumprod(down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1)))
    weight = np.concatenate([below[::-1], [1.0], above])
    upto = np.cumsum(weight)
    return low + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def _matrix(counts: DataFrame, many: int, shards: int, total: int, seed: int) -> DataFrame:
    """(part, sent) of every partition with rows in counts(part, n): how many rows it sends to each shard."""
    levels, width = [counts], many
    while width > FAN:
        width = -(-width // FAN)
        above = levels[-1].groupBy(F.floor(F.col("part") / FAN).cast("long").alias("part")).agg(F.sum("n").alias("n"))
        levels.append(written(above, "shard-level"))
    top = levels[-1].orderBy("part").collect()  # FAN rows at most
    left = [total // shards + (k < total % shards) for k in range(shards)]
    drawn = communication([r["n"] for r in top], left, np.random.default_rng([seed, len(levels)]))
    spark = counts.sparkSession
    sent = spark.createDataFrame([(r["part"], row.tolist()) for r, row in zip(top, drawn, strict=True)], "part long, sent array<long>")
    for depth in range(len(levels) - 2, -1, -1):
        parts = levels[depth].withColumn("up", F.floor(F.col("part") / FAN).cast("long")).join(sent.withColumnRenamed("part", "up"), "up")
        sent = written(parts.groupBy("up").applyInPandas(_split(seed, depth), "part long, sent array<long>"), "shard-matrix")
    return sent


def _split(seed: int, depth: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def split(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")  # FAN rows at most
        rng = np.random.default_rng([seed, depth, int(group["up"].iloc[0])])
        rows = communication(group["n"].tolist(), list(group["sent"].iloc[0]), rng)
        return pd.DataFrame({"part": group["part"].to_numpy(), "sent": rows.tolist()})

    return split


def shards(rows: DataFrame, shards: int = 16, seed: int = 20, partitions: int | None = None) -> DataFrame:
    """rows with shard and slot: shards hold all rows, sizes at most one apart; slots of a shard run from 0 without gaps.

    Rows are shuffled whatever they hold: repeated rows and nulls are rows like others. An empty table gives no rows.
    Columns shard and slot, and those beginning with _skein_, are replaced. The rows are written once and shuffled
    twice, so give narrow ones (ids) where the texts are long.
    """
    rows = written(rows.drop("shard", "slot").withColumn("_skein_id", F.monotonically_increasing_id()), "shard-rows")
    total = rows.count()
    many = partitions or max(1, -(-total // BLOCK_ROWS))
    mark = lambda name: F.xxhash64(F.lit(seed), F.lit(name), "_skein_id")
    dealt = rows.withColumn("_skein_part", F.pmod(mark("deal"), F.lit(many)))
    counts = written(dealt.groupBy(F.col("_skein_part").alias("part")).agg(F.count("*").alias("n")), "shard-counts")
    sent = _matrix(counts, many, shards, total, seed).select(F.col("part").alias("_skein_part"), "sent")
    upto = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice("sent", F.lit(1), k), F.lit(0).cast("long"), lambda s, x: s + x))
    sent = sent.select("_skein_part", upto.alias("_skein_upto"))
    local = Window.partitionBy("_skein_part").orderBy(mark("local"), "_skein_id")
    placed = dealt.withColumn("_skein_rank", F.row_number().over(local)).join(sent, "_skein_part")
    placed = placed.withColumn("shard", F.array_size(F.filter("_skein_upto", lambda u: u < F.col("_skein_rank"))).cast("int"))
    blocks = max(1, -(-total // (shards * BLOCK_ROWS)))
    order = mark("order")
    # blocks are ranges of the hash, so that blocks in order make the shard's order
    placed = placed.withColumn("_skein_block", F.floor((F.shiftrightunsigned(order, 33) * blocks) / F.lit(1 << 31)).cast("int")).drop("_skein_part", "_skein_rank", "_skein_upto")
    placed = written(placed, "shard-placed")
    within = placed.groupBy("shard", "_skein_block").count().withColumn(
        "_skein_before", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("_skein_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inner = Window.partitionBy("shard", "_skein_block").orderBy(order, "_skein_id")
    ranked = placed.withColumn("_skein_nth", F.row_number().over(inner)).join(within.drop("count"), ["shard", "_skein_block"])
    return ranked.withColumn("slot", (F.col("_skein_before") + F.col("_skein_nth") - 1).cast("long")).drop("_skein_id", "_skein_block", "_skein_before", "_skein_nth")
