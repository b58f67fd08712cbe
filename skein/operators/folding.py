"""State machines over ordered events, in blocks, so that no key's events meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.tables import written

#: Most events, or blocks of events, that are folded at once.
BLOCK = 500


def final_states(events: DataFrame, key: str, order: list[str], event: str, transitions: dict[tuple[str, str], str], start: str) -> DataFrame:
    """(key, state, events, refused): where each key's machine ends after its events in order. An event with no transition from the state it meets is refused and leaves it.

    A block of events is a function from the state before it to the state after it and the number refused, so blocks are
    folded apart for every state they may meet, and the functions of neighbouring blocks are composed, level by level,
    until a key has one. Rows are placed by ranges of key and order: a key with a third of all events is spread over many
    tasks, and one array holds BLOCK entries at most. Order must be unique within a key; rows without a key are left out.
    """
    states = sorted({a for a, _ in transitions} | set(transitions.values()) | {start})
    target = F.create_map(*[F.lit(x) for (a, e), b in sorted(transitions.items()) for x in (f"{a}>{e}", b)])
    single = [F.struct(F.coalesce(F.try_element_at(target, F.concat(F.lit(f"{s}>"), F.col(event))), F.lit(s)).alias("to"), F.try_element_at(target, F.concat(F.lit(f"{s}>"), F.col(event))).isNull().cast("long").alias("refused")) for s in states]
    level = events.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.struct(*order).alias("_at"), F.lit(1).cast("long").alias("_n"), F.array(*single).alias("_map"))
    place = F.create_map(*[x for k, s in enumerate(states, 1) for x in (F.lit(s), F.lit(k))])

    def composed(blocks: Column, state: str) -> Column:
        zero = F.struct(F.lit(state).alias("to"), F.lit(0).cast("long").alias("refused"))

        def step(so_far: Column, block: Column) -> Column:
            then = F.element_at(block["_map"], F.element_at(place, so_far["to"]))
            return F.struct(then["to"].alias("to"), (so_far["refused"] + then["refused"]).alias("refused"))

        return F.aggregate(blocks, zero, step)

    parts: list[int] = []
    while True:
        placed = level.repartitionByRange(*parts, "_key", "_at").sortWithinPartitions("_key", "_at")
        numbered = placed.withColumn("_block", F.struct(F.spark_partition_id().alias("p"), F.floor((F.monotonically_increasing_id() % F.lit(1 << 33)) / BLOCK).alias("b")))
        blocks = numbered.groupBy("_key", "_block").agg(F.min("_at").alias("_at"), F.sum("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_at", "_map"))).alias("_rows"))
        level = written(blocks.select("_key", "_at", "_n", F.array(*[composed(F.col("_rows"), s) for s in states]).alias("_map")), "fold")
        most = level.groupBy("_key").count().agg(F.max("count")).first()[0] or 0
        if most <= BLOCK:
            break
        # Parts of many blocks' rows, so that each level leaves a small share of the one before.
        parts = [1 + level.count() // (20 * BLOCK)]
    last = level.groupBy("_key").agg(F.sum("_n").alias("events"), F.array_sort(F.collect_list(F.struct("_at", "_map"))).alias("_rows"))
    return last.select(F.col("_key").alias(key), composed(F.col("_rows"), start).alias("_end"), "events").select(key, F.col("_end.to").alias("state"), "events", F.col("_end.refused").alias("refused"))
