"""Feeds merged into a state: upserts with a policy for each column, inserts of what is new, versions, retention, ladders.

A state is a table; a merge gives the next state, which the caller writes beside the old one and then points to
(`skein.sources.states`), so that readers of the old state are never disturbed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(state: DataFrame, feed: DataFrame, keys: list[str], order: list[str], kept: list[str] = (), lowest: list[str] = (), highest: list[str] = ()) -> DataFrame:
    """The state after a feed: the feed's last row of a key (by `order`) takes the place of the state's.

    On a conflict columns `kept` keep the state's value, `lowest` and `highest` take the lesser and the greater of the
    known ones (nulls are not known). Keys are compared null-safe. The feed may hold a key many times; its rows are
    reduced to one a key before they meet the state.
    """
    columns = state.columns
    rest = [c for c in columns if c not in keys]
    extremes = [F.min(c).alias(f"_low_{c}") for c in lowest] + [F.max(c).alias(f"_high_{c}") for c in highest]
    new = feed.groupBy(*keys).agg(F.max(F.struct(*order, F.struct(*[c for c in rest]).alias("_row"))).alias("_new"), *extremes)
    old = state.select(*keys, F.struct(*rest).alias("_old"))
    same = [old[k].eqNullSafe(new[k]) for k in keys]
    both = old.join(new, same, "full").select(*[F.coalesce(old[k], new[k]).alias(k) for k in keys], "_old", F.col("_new._row").alias("_row"), *[f"_low_{c}" for c in lowest], *[f"_high_{c}" for c in highest])

    def value(c: str) -> Column:
        if c in lowest:
            return F.least(F.col(f"_old.{c}"), F.col(f"_low_{c}"))
        if c in highest:
            return F.greatest(F.col(f"_old.{c}"), F.col(f"_high_{c}"))
        own = F.when(F.col("_row").isNotNull(), F.col(f"_row.{c}")).otherwise(F.col(f"_old.{c}"))
        return F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_row.{c}")) if c in kept else own

    return both.select(*[F.col(c) if c in keys else value(c).alias(c) for c in columns])


def inserted(state: DataFrame, feed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The state with the feed's rows of keys it lacks, the first of a key by `order`; what is there stays as it is. Keys are compared null-safe."""
    rest = [c for c in state.columns if c not in keys]
    new = feed.select(*keys, F.struct(*order, F.struct(*rest).alias("_row")).alias("_new")) if rest else feed.select(*keys)
    # the known keys are grouped along with the feed's, so that no task sorts both for a join after it has sorted the feed for the grouping
    both = new.withColumn("_known", F.lit(0)).unionByName(state.select(*keys, F.lit(1).alias("_known")), allowMissingColumns=True)
    if rest:  # rows that are sorted for a grouping are small in a shuffle and large in memory: by a fixed number their parts are not put together by size
        both = both.repartition(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    first = both.groupBy(*keys).agg(F.max("_known").alias("_known"), *([F.min("_new").alias("_new")] if rest else [])).where("_known = 0")
    return state.unionByName(first.select(*[F.col(c) if c in keys else F.col(f"_new._row.{c}").alias(c) for c in state.columns]))


def replaced(state: DataFrame, feed: DataFrame, part: str) -> DataFrame:
    """The state with all rows of each part that the feed names replaced by the feed's."""
    return state.join(feed.select(part).distinct(), part, "left_anti").select(*state.columns).unionByName(feed.select(*state.columns))


def appended_if_changed(log: DataFrame, feed: DataFrame, keys: list[str], at: str, compared: list[str]) -> DataFrame:
    """The log with those rows of the feed that differ, in the compared columns, from the log's latest row of their key."""
    last = log.groupBy(*keys).agg(F.max(F.struct(at, *compared)).alias("_last"))
    known = feed.join(last, keys, "left")
    same = F.col("_last").isNotNull()
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"_last.{c}"))
    return log.unionByName(known.where(~same).select(*log.columns))


def stale(rows: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """The rows whose digest is not the stored one: new or changed ones, which alone are worked on again."""
    return rows.join(stored.select(key, digest), [key, digest], "left_anti")


def retention(rows: DataFrame, referred: DataFrame, key: str, at: str, as_of: Column, days: int, newest: int) -> DataFrame:
    """(key, state): protected if referred to, among the `newest` ones or younger than so many days, else eligible for removal."""
    marked = rows.join(referred.select(key).distinct().withColumn("_used", F.lit(True)), key, "left")
    latest = rows.orderBy(F.desc(at), F.desc(key)).limit(newest).select(key).withColumn("_new", F.lit(True))
    marked = marked.join(F.broadcast(latest), key, "left")
    state = F.when(F.col("_used"), "referred to").when(F.col("_new"), "newest").when(F.col(at) > F.date_sub(as_of, days), "young").otherwise("eligible")
    return marked.select(key, state.alias("state"))


def laddered(rows: DataFrame, tried: str, rungs: list[str], succeeded: str) -> DataFrame:
    """rows with `next`, the first rung not yet tried, and `decision`: done, try or give up."""
    untried = F.filter(F.array(*[F.lit(r) for r in rungs]), lambda r: ~F.array_contains(tried, r))
    decision = F.when(F.col(succeeded), "done").when(F.size(untried) > 0, "try").otherwise("give up")
    return rows.withColumns({"next": F.when(~F.col(succeeded), F.try_element_at(untried, F.lit(1))), "decision": decision})


def applied_with_fence(base: DataFrame, delta: DataFrame, target: DataFrame, key: str, expected: int) -> DataFrame:
    """The state after a delta (key, op, before, after) if it is the one the delta was made for.

    The fence is the sum of the rows' hashes; a state that has another is returned as it is, as is one whose rows have
    other hashes than those the delta says it had before (then no row is changed: all or nothing).
    """
    from skein.operators import changes

    hashed = base.select("*", changes.row_hash(base.columns).alias("_now"))
    state = hashed.agg(F.sum(F.xxhash64("_now") % 1_000_003).alias("_state"))
    conflict = delta.join(hashed.select(key, "_now"), key, "left").agg(F.coalesce(F.bool_or(~F.col("before").eqNullSafe(F.col("_now"))), F.lit(False)).alias("_conflict"))
    fits = F.broadcast(state.join(conflict).select((F.col("_state").eqNullSafe(expected) & ~F.col("_conflict")).alias("_fits")))
    left = hashed.join(delta.select(key, "op"), key, "left").join(fits).where("op is null or not _fits").select(*base.columns)
    fresh = target.join(delta.where("op <> 'delete'").select(key), key, "left_semi").join(fits).where("_fits").select(*base.columns)
    return left.unionByName(fresh)
