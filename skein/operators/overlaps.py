"""Pairs of sets that overlap enough, joined by their rarest items only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.tables import written


def candidates(sets: DataFrame, key: str, items: str, need: str, both: bool) -> DataFrame:
    """(a, b), once each, of sets that may share `need` items or more: every such pair is among them.

    need is a column of the sets, at least 1. A set that shares so many of its n items with another shares one of its
    n - need + 1 rarest, so only those are joined. With `both` a pair must share what each of the two needs, and rare
    items meet rare items, in one order of rarity; without, what the smaller set needs (of equals, the one with the
    smaller key), and its rare items meet all items of the larger. Frequent items are joined only where a set has no rarer ones.
    """
    flat = written(sets.select(key, F.size(items).alias("n"), need, F.explode(items).alias("item")), "items")
    counts = flat.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    # items that no other set has are the rarest, and join nothing: they only count
    shared = flat.join(counts, "item").groupBy(key, "n", need).agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("r"))
    rare = written(shared.select(F.col(key).alias("k"), "n", "r", (F.size("r") - F.col(need) + 1).alias("few")).where("few > 0"), "rare")
    first = lambda name, k: rare.select(F.col("k").alias(k), F.col("n").alias(f"n{k}"), F.explode(name).alias("x")).select(k, f"n{k}", F.col("x.item").alias("item"))
    prefix = F.slice("r", F.lit(1), F.col("few").cast("int"))
    if both:
        return first(prefix, "a").join(first(prefix, "b"), "item").where("a < b").select("a", "b").distinct()
    whole = shared.select(F.col(key).alias("b"), F.col("n").alias("nb"), F.explode("r").alias("x")).select("b", "nb", F.col("x.item").alias("item"))
    met = first(prefix, "a").join(whole, "item").where("na < nb or na = nb and a < b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
