"""Row-level changes between two states of a table: build, apply, reconcile, hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the row as JSON with its columns in order of name; nulls are written."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def delta(base: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(key, op, before, after): insert, update or delete of each row that differs, with the hashes on both sides."""
    a = base.select(key, row_hash(base.columns).alias("before"))
    b = target.select(key, row_hash(target.columns).alias("after"))
    both = a.join(b, key, "full").where(~F.col("before").eqNullSafe(F.col("after")))
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return both.select(key, op.alias("op"), "before", "after")


def applied(base: DataFrame, changes: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """base with the changes, new rows taken from target. A change whose before-hash isn't the row's is refused: it is left as it is."""
    fits = base.select("*", row_hash(base.columns).alias("_now")).join(changes.select(key, "op", "before"), key, "left")
    kept = fits.where(F.col("op").isNull() | ~F.col("_now").eqNullSafe(F.col("before"))).select(*base.columns)
    good = fits.where(F.col("op").isNotNull() & F.col("_now").eqNullSafe(F.col("before"))).select(key)
    fresh = changes.where("op = 'insert'").select(key).join(base.select(key), key, "left_anti")
    changed = changes.where("op = 'update'").select(key).join(good, key, "left_semi").unionByName(fresh)
    return kept.unionByName(target.join(changed, key, "left_semi").select(*base.columns))


def reconciled(ours: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): missing, unexpected or changed."""
    both = ours.select(key, F.col(value).alias("x")).withColumn("o", F.lit(1)).join(theirs.select(key, F.col(value).alias("y")).withColumn("t", F.lit(1)), key, "full")
    state = F.when(F.col("o").isNull(), "missing").when(F.col("t").isNull(), "unexpected").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return both.select(key, state.alias("state")).where("state is not null")
