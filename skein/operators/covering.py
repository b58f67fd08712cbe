"""A small sample that meets named requirements: greedy cover of how many of each are still wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.tables import written


def shown_by(rows: DataFrame, key: str, requirements: dict[str, tuple[int, Column]]) -> DataFrame:
    """(key, mask): which requirements a row meets, bit k for the k-th. Rows that meet none are left out."""
    mask = F.lit(0).cast("long")
    for k, (_, holds) in enumerate(requirements.values()):
        mask = mask + F.when(holds, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.select(key, mask.alias("mask")).where("mask <> 0")


def sample(rows: DataFrame, key: str, requirements: dict[str, tuple[int, Column]]) -> DataFrame:
    """(key, turn, gain): rows that together meet each requirement (name: least number, condition) as often as it asks, if the rows can: in each turn the one that meets most of what is still wanted, the smallest key of equals.

    What a row gains depends only on which requirements it meets, so of every such set of requirements the first few keys
    are all that can be chosen: as many as the requirements ask for in all. That table, a row for each set and place, is
    cut in tasks before it is shuffled; its size depends on the requirements and not on the rows, and the turns are
    played on it.
    """
    wanted = [least for least, _ in requirements.values()]
    if len(wanted) > 20 or sum(wanted) > 1000:
        raise ValueError("at most 20 requirements and 1000 rows")
    most = sum(wanted)
    shown = shown_by(rows.where(F.col(key).isNotNull()), key, requirements)
    from skein.operators.frames import top_of_each

    few = top_of_each(shown.distinct(), ["mask"], [F.col(key)], most, key).select("mask", key)
    groups = {r["mask"]: sorted(r["keys"]) for r in few.groupBy("mask").agg(F.collect_list(key).alias("keys")).toLocalIterator()}
    chosen, turn = [], 0
    while any(n > 0 for n in wanted):
        gain = {mask: sum(n > 0 and mask >> k & 1 for k, n in enumerate(wanted)) for mask, keys in groups.items() if keys}
        best = max(gain.values(), default=0)
        if not best:
            break
        mask = min((m for m, g in gain.items() if g == best), key=lambda m: groups[m][0])
        turn += 1
        chosen.append((groups[mask].pop(0), turn, best))
        wanted = [n - (mask >> k & 1) for k, n in enumerate(wanted)]
    kind = rows.schema[key].dataType.simpleString()
    return written(rows.sparkSession.createDataFrame(chosen, f"{key} {kind}, turn int, gain int"), "sample")


def met(rows: DataFrame, chosen: DataFrame, key: str, requirements: dict[str, tuple[int, Column]]) -> DataFrame:
    """(requirement, least, found, possible) of each requirement: how many of the chosen rows, and of all, meet it."""
    inside = rows.join(F.broadcast(chosen.select(key, F.lit(True).alias("_in"))), key, "left")
    counts = [F.struct(F.lit(name).alias("requirement"), F.lit(least).alias("least"), F.count_if(holds & F.col("_in")).alias("found"), F.count_if(holds).alias("possible")) for name, (least, holds) in requirements.items()]
    return inside.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
