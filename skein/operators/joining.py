"""Joins beyond equality: as-of, intervals, shared parts of sets, ancestors, per-column comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import ranges, tiling
from skein.tables import broadcast_below, looked_up, written

#: Rows of a block whose pairs with another block are one task, and items shared by pairs that it counts at a time.
BLOCK_ROWS, PAIRS = 1 << 16, 1 << 20


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """left with the values of the last row of right with the same keys and a time not after its own; null before the first.

    Both sides are put into one sequence a key, and the values are carried forward along it, from part to part where a
    key has many rows; no pair of rows is made. Right rows come before left rows of the same time.
    """
    carried = F.struct(*values)
    marked = left.withColumns({"_side": F.lit(1), "_carried": F.lit(None).cast(right.select(carried.alias("s")).schema[0].dataType)})
    given = right.select(*keys, at, F.lit(0).alias("_side"), carried.alias("_carried"))
    both = marked.unionByName(given, allowMissingColumns=True)
    order = [at, "_side"]
    found = ranges.latest_known(ranges.ranged(both, keys, order), keys, order, "_carried", "_last").where("_side = 1")
    return found.select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def within_intervals(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of a point and an interval that holds it (start <= at < end), all as seconds.

    Time is cut into buckets of `width`; an interval enters each bucket that it touches and a point its own, so the join
    is on the bucket, and the bounds are checked on what meets there.
    """
    cut = lambda c: F.floor(F.col(c) / width)
    placed = intervals.withColumn("_bucket", F.explode(F.sequence(cut(start), F.floor((F.col(end) - 1) / width))))
    return points.withColumn("_bucket", cut(at)).join(placed, "_bucket").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")


def sharing(rows: DataFrame, key: str, items: str, least: int, most_common: int, need: str | None = None) -> DataFrame:
    """(a, b, shared) of rows that share `least` items or more, where items that over `most_common` rows have are no evidence.

    With `need`, a column of numbers, a pair must also share as many as one of its two rows needs. Common items are left
    out before the rows meet, so no item brings together more than most_common rows. Rows meet in pairs of blocks
    (tiling.met): pairs are counted where they meet, and only those of the result leave a task.
    """
    flat = rows.select(key, F.lit(0.0).alias("_need") if need is None else F.col(need).cast("double").alias("_need"), F.explode(F.array_distinct(items)).alias("item"))
    flat = written(flat.where("item is not null").select(key, "_need", F.xxhash64("item").alias("h")), "sharing-items")
    counts = flat.groupBy("h").agg(F.count("*").alias("df")).where(F.col("df").between(2, most_common))
    kept = flat.where(F.col(key).isNotNull()).join(broadcast_below(counts.select("h"), 500_000), "h")
    sets = written(kept.groupBy(F.col(key).alias("k")).agg(F.min("_need").alias("need"), F.collect_list("h").alias("h")), "sharing-sets")
    kind = sets.schema["k"].dataType.simpleString()
    return tiling.met(sets, "k", BLOCK_ROWS, lambda x, y, same: _shared(x, y, same, least), f"a {kind}, b {kind}, shared long")


def _shared(x: pa.Table, y: pa.Table, same: bool, least: int) -> Iterator[pa.RecordBatch]:
    """(a, b, shared) of the pairs of two blocks that share enough; some rows of x at a time."""
    items, columns = tiling.postings(y["h"])
    mine, rows = x["h"].combine_chunks().flatten().to_numpy(), np.repeat(np.arange(x.num_rows), tiling.widths(x["h"]))
    low, high = np.searchsorted(items, mine, "left"), np.searchsorted(items, mine, "right")
    upto = np.concatenate([[0], np.cumsum(np.bincount(rows, high - low, x.num_rows))])
    bounds = np.searchsorted(rows, np.arange(x.num_rows + 1))
    needx, needy = x["need"].to_numpy(), y["need"].to_numpy()
    at = 0
    while at < x.num_rows:
        end = min(x.num_rows, max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1))
        part = slice(bounds[at], bounds[end])
        n = (high - low)[part]
        starts = np.repeat(low[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        pairs, shared = np.unique(np.repeat(rows[part], n) * y.num_rows + columns[starts + np.arange(len(starts))], return_counts=True)
        r, c = np.divmod(pairs, y.num_rows)
        good = (shared >= least) & (shared >= np.minimum(needx[r], needy[c]))
        a, b = x["k"].take(pa.array(r[good])), y["k"].take(pa.array(c[good]))
        first, last = pc.if_else(pc.less(a, b), a, b), pc.if_else(pc.less(a, b), b, a)
        found = pa.table({"a": first, "b": last, "shared": pa.array(shared[good], pa.int64())})
        yield from found.filter(pc.less(a, b) if same else pc.not_equal(a, b)).to_batches()
        at = end


def sharing_two(rows: DataFrame, key: str, items: str) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of rows that share two items or more.

    Rows that hold the same two items are all linked to each other; an edge from each to the smallest of them says the
    same, so a pair of items that many rows hold gives an edge a row. Keys of pairs are counted and cut to their
    smallest row before the shuffle; keys that may be hot are joined through tables.looked_up.
    """
    sets = written(rows.select(key, F.array_sort(F.array_distinct(items)).alias("s")).where(F.size("s") > 1), "shared-sets")
    each = F.flatten(F.transform("s", lambda x, k: F.transform(F.slice("s", k + 2, F.size("s")), lambda y: F.xxhash64(x, y))))
    flat = written(sets.select(F.col(key).alias("b"), F.explode(each).alias("two")), "shared-pairs")
    groups = written(flat.groupBy("two").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1"), "shared-groups")
    return looked_up(flat, groups, "two", "n", flat.count()).where("a <> b").select("a", "b").distinct()


def ancestors(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(node, ancestor, depth) of every node, itself included at depth 0. A node on a cycle of parents, or below one, has one row with neither ancestor nor depth.

    Steps up are doubled on written tables: after n rounds each node knows the node 2^n levels above it, so the rounds
    are the logarithm of the depth, or of the number of nodes where steps still lead on after as many as there are
    nodes, which only a cycle allows. The ancestors of all other nodes are then gathered by the same steps.
    """
    # all tables here grow with the nodes but are small in files, so joins are told not to send them through the driver
    own = written(nodes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("node")).agg(F.max(parent).alias("up")), "nodes")
    many, steps = own.count(), [written(own.where("up is not null").select("node", "up"), "steps")]
    while 1 << (len(steps) - 1) <= many and steps[-1].limit(1).count():
        last = steps[-1]
        steps.append(written(last.join(last.select(F.col("node").alias("up"), F.col("up").alias("further")).hint("merge"), "up").select("node", F.col("further").alias("up")), "steps"))
    endless = steps[-1].select("node").hint("merge")
    level = own.join(endless, "node", "left_anti").select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    found = written(level, "ancestors")
    for n, step in enumerate(steps[:-1]):  # known: ancestors of a depth below 2^n
        above = found.select(F.col("node").alias("up"), "ancestor", F.col("depth").alias("more"))
        roots = step.join(own.select(F.col("node").alias("up")).hint("merge"), "up", "left_anti").select("up").distinct().select("up", F.col("up").alias("ancestor"), F.lit(0).alias("more"))  # parents that are no nodes themselves
        further = step.join(endless, "node", "left_anti").join(above.unionByName(roots).hint("merge"), "up").select("node", "ancestor", (F.col("more") + (1 << n)).alias("depth"))
        found = written(found.unionByName(further), "ancestors")
    kind = found.schema["ancestor"].dataType
    return found.unionByName(endless.select("node", F.lit(None).cast(kind).alias("ancestor"), F.lit(None).cast("int").alias("depth")))


def differing(columns: list[str], a: str = "a", b: str = "b") -> Column:
    """The names of the columns in which two rows, given as structs, differ."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), F.lit(c)) for c in columns]))
