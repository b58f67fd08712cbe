"""Append-only journals whose entries are chained by digests, built and verified in blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.articles import let
from skein.tables import broadcast_below, written

#: Entries of a block.
BLOCK = 256
SEED = "0"
#: What comes before each block is broadcast to so many of them at most.
PREFIXES = 200_000


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _in_one_chain(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """rows(key, at, value) as _chained gives them where a key is one block, however long: read through in order, with no more than the last digest kept."""
    named = rows.select(key, at, value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, done = (), SEED
        for batch in batches:
            chain, above = [], []
            for k, v in zip(batch[key].tolist(), batch[value].tolist(), strict=True):
                if (k,) != last:
                    last, done = (k,), SEED
                above.append(done)
                done = hashlib.sha256((done + v).encode()).hexdigest()
                chain.append(done)
            yield batch.assign(before=SEED, chain=chain, above=above)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema] + ["before string", "chain string", "above string"])
    return named.repartition(key).sortWithinPartitions(key, at).mapInPandas(run, schema)


def _packed(rows: DataFrame, key: str, value: Callable[[Column], Column], *more: Column) -> DataFrame:
    """(key, _block, _rows, _last, more) as a written table: a row a block with its rows in their order, and the digest of all its values. rows: key, _block and the struct `_row` with `_at`; value: of such a row."""
    place = lambda x, y: F.when(x["_at"] < y["_at"], -1).when(x["_at"] > y["_at"], 1).when(value(x) < value(y), -1).when(value(x) > value(y), 1).otherwise(0)
    packed = rows.groupBy(key, "_block").agg(F.array_sort(F.collect_list("_row"), place).alias("_rows"), *more)
    last = F.aggregate("_rows", F.lit(SEED), lambda done, x: _digest(done, value(x)))
    return written(packed.withColumn("_last", last), "journal-blocks")


def _bound(packed: DataFrame, key: str, value: Callable[[Column], Column], block: int, levels: int | None = None) -> DataFrame:
    """The rows of _packed with `before`, a digest of all values of the key before the block.

    A block's last digest stands for it on the next level, where the blocks are chained in the same way, so a key of n
    rows takes log(n) levels and no task sees more than a block. With `levels`, the last of so many levels is one chain
    of all of a key's blocks, whose order leaves it to one task.
    """
    blocks = packed.select(key, F.col("_block").alias("_at"), F.col("_last").alias("_value"))
    if blocks.where("_at > 0").limit(1).count():
        above = _chained(blocks, key, "_at", "_value", block, levels and levels - 1)
        # what the blocks before this one come to: on the level above, the value before it and all before that
        prefix = above.select(F.col(key).alias("_k"), F.col("_at").alias("_b"), F.when(F.col("_at") == 0, SEED).otherwise(_digest(F.col("before"), F.col("above"))).alias("before"))
        prefix = broadcast_below(written(prefix, "journal-prefixes"), PREFIXES)
        packed = packed.join(prefix, packed[key].eqNullSafe(prefix["_k"]) & (packed["_block"] == prefix["_b"])).drop("_k", "_b")
    else:
        packed = packed.withColumn("before", F.lit(SEED))
    return packed


def _each(value: Callable[[Column], Column], of: Callable[[Column, Column, Column], Column]) -> Column:
    """of(row, chain, above) of each row of a block: the digests of the block's values up to the row and before it. They are made once a block, wherever Spark moves the expression."""
    links = F.aggregate("_rows", F.array(F.lit(SEED)), lambda done, x: F.concat(done, F.array(_digest(F.element_at(done, -1), value(x)))))
    return let(links, lambda done: F.transform("_rows", lambda x, k: of(x, F.get(done, k + 1), F.get(done, k))))


def _chained(rows: DataFrame, key: str, at: str, value: str, block: int, levels: int | None = None) -> DataFrame:
    """rows(key, at, value) with `before`, a digest of all values of the key before the row's block, and `chain` and `above`, digests of the block's values up to the row and before it."""
    if levels == 1:
        return _in_one_chain(rows, key, at, value)
    own = lambda x: x["_value"]
    packed = _packed(rows.select(key, F.floor(F.col(at) / block).alias("_block"), F.struct(F.col(at).alias("_at"), F.col(value).alias("_value")).alias("_row")), key, own)
    each = _each(own, lambda x, chain, above: F.struct(x["_at"].alias(at), x["_value"].alias(value), chain.alias("chain"), above.alias("above")))
    flat = _bound(packed, key, own, block, levels).select(key, "before", F.explode(each).alias("x"))
    return flat.select(key, f"x.{at}", f"x.{value}", "before", "x.chain", "x.above")


def linked(rows: DataFrame, key: str, at: str, payload: str, block: int = BLOCK, levels: int | None = None) -> DataFrame:
    """rows(key, at, payload) with `link`, a digest that binds an entry to all entries of its journal before it. Entries are numbered from 0 in `at`; a null payload counts as an empty one.

    Blocks are bound in blocks of blocks, as many levels as a journal takes; with `levels`, in so many at most. A
    block's rows are shuffled once, whole, and stay together until they have their links.
    """
    rest = [c for c in rows.columns if c not in (key, at)]
    value = lambda x: F.sha2(F.coalesce(x["_rest"][payload], F.lit("")), 256)
    number = F.col(at).cast("long")
    entry = F.struct(number.alias("_at"), F.struct(*rest).alias("_rest"))
    packed = _packed(rows.where(number.isNotNull()).select(key, F.floor(number / block).alias("_block"), entry.alias("_row")), key, value)
    each = _each(value, lambda x, chain, above: F.struct(x.alias("row"), chain.alias("chain")))
    flat = _bound(packed, key, value, block, levels).select(key, "before", F.explode(each).alias("x"))
    got = flat.select(key, F.col("x.row._at").cast(rows.schema[at].dataType).alias(at), "x.row._rest.*", _digest(F.col("before"), F.col("x.chain")).alias("link"))
    return got.select(*rows.columns, "link")


def first_breaks(stored: DataFrame, heads: DataFrame, key: str, at: str, payload: str, block: int = BLOCK) -> DataFrame:
    """(key, at, fault) of the first entry of each journal that is not as it was written; journals that are whole have no row.

    stored has key, at, payload and link; heads has key and `many`, how many entries were written. The fault is
    `lost` if an entry is missing or comes twice, `swapped` if its link fits the payload of the entry after it, else
    `changed`. Links are made anew in blocks, and each is compared with the stored one. Entries are shuffled once, to
    their blocks; of a block, only its first entry and what is wrong with it leave it.
    """
    number = F.col(at).cast("long")
    own = F.unhex(F.sha2(F.coalesce(F.col(payload), F.lit("")), 256))
    entries = stored.where(number.isNotNull()).select(key, F.floor(number / block).alias("_block"), number.alias("_at"), own.alias("_own"), "link")
    # by block, which serves both groupings
    counted = entries.repartition(key, "_block").groupBy(key, "_block", "_at").agg(F.count("*").alias("_times"), F.min("_own").alias("_own"), F.min("link").alias("link"))
    value = lambda x: F.lower(F.hex(x["_own"]))
    twice = F.min(F.when(F.col("_times") > 1, F.col("_at"))).alias("_twice")
    packed = _packed(counted.withColumn("_row", F.struct("_at", "_own", "link")), key, value, twice)
    # the first number that is missing, or comes twice: in blocks, numbers below a block's end
    full = F.sequence(F.col("_block") * block, (F.col("_block") + 1) * block - 1)
    first = F.get("_rows", F.lit(0))
    ends = packed.select(F.col(key).alias("_j"), "_block", "_twice", F.array_min(F.array_except(full, F.transform("_rows", lambda x: x["_at"]))).alias("_gap"), first["_at"].alias("_first"), value(first).alias("_next"))
    ends = written(ends, "journal-ends")
    spine = heads.select(F.col(key).alias("_k"), "many", F.explode(F.sequence(F.lit(0), F.floor((F.col("many") - 1) / block))).alias("_b")).where("many > 0")
    met = spine.join(ends, F.col("_k").eqNullSafe(F.col("_j")) & (F.col("_b") == F.col("_block")), "left")
    gap = F.when(F.col("_block").isNull(), F.col("_b") * block).when(F.col("_gap") < F.col("many"), F.col("_gap"))
    lost = met.select(F.col("_k").alias(key), F.least(gap, F.col("_twice")).alias("_at")).groupBy(key).agg(F.min("_at").alias("_at")).where("_at is not null")
    each = _each(value, lambda x, chain, above: F.struct(x["_at"].alias("_at"), x["link"].alias("link"), chain.alias("chain"), above.alias("above")))
    bad = _bound(packed, key, value, block).select(key, "_block", "before", F.get(F.filter(each, lambda x: ~x["link"].eqNullSafe(_digest(F.col("before"), x["chain"]))), F.lit(0)).alias("x"), "_rows")
    then = F.get(F.filter("_rows", lambda y: y["_at"] == F.col("x._at") + 1), F.lit(0))
    bad = bad.select(key, "_block", F.struct("before", "x.*", F.when(then.isNotNull(), value(then)).alias("then")).alias("x"))
    bad = bad.groupBy(key).agg(F.min_by(F.struct("_block", "x"), F.when(F.col("x._at").isNotNull(), F.col("_block"))).alias("f")).select(key, "f._block", "f.x").where("x is not null")
    # the entry after it, which may begin the next block
    after = ends.select("_j", (F.col("_block") - 1).alias("_b"), F.col("_first").alias("_n"), "_next")
    bad = bad.join(after, F.col(key).eqNullSafe(F.col("_j")) & (F.col("_block") == F.col("_b")) & (F.col("x._at") + 1 == F.col("_n")), "left")
    following = F.coalesce("x.then", "_next")
    fault = F.when(F.col("x.link") == _digest(F.col("x.before"), _digest(F.col("x.above"), following)), "swapped").otherwise("changed")
    every = lost.withColumn("fault", F.lit("lost")).unionByName(bad.select(key, F.col("x._at").alias("_at"), fault.alias("fault")))
    found = every.groupBy(key).agg(F.min(F.struct(F.col("_at"), F.when(F.col("fault") == "lost", 0).otherwise(1).alias("o"), "fault")).alias("f"))
    return found.select(key, F.col("f._at").alias(at), "f.fault")
