"""Graph projection: nodes and relations of many tables as two tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Bits of a node's number below those of its kind.
BITS = 56


def numbered(kind: int, key: Column) -> Column:
    """A node of the kind of that place in a list, with a key from 0 to 2^56 - 1, as one number, which is joined and shuffled faster than a name."""
    return F.lit(kind << BITS).cast("long") + key.cast("long")


def named(node: Column, kinds: list[str]) -> Column:
    """The name of a numbered node: its kind and its key."""
    return F.concat(F.get(F.array(*map(F.lit, kinds)), F.shiftright(node, BITS).cast("int")), F.lit(":"), node.bitwiseAND(F.lit((1 << BITS) - 1)).cast("string"))


def nodes(sources: list[DataFrame]) -> DataFrame:
    """(id, kind, label) of all sources; of rows with one id that of the earliest source stays, and in it the least. Counts merge before the shuffle."""
    tagged = [s.select("id", F.struct(F.lit(k).alias("k"), "kind", "label").alias("row")) for k, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, tagged).where("id is not null").groupBy("id").agg(F.min("row").alias("row")).select("id", "row.kind", "row.label")


def relations(sources: list[DataFrame]) -> DataFrame:
    """Distinct (src, dst, relation) of all sources, without loops."""
    return reduce(DataFrame.unionByName, [s.select("src", "dst", "relation") for s in sources]).where("src <> dst").distinct()


def attached(edges: DataFrame, known: DataFrame) -> DataFrame:
    """The relations whose two ends are nodes."""
    ids = known.select("id")
    return edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")


def dangling(edges: DataFrame, known: DataFrame) -> DataFrame:
    """The relations with an end that is no node, and which end."""
    a, b = known.select(F.col("id").alias("src"), F.lit(True).alias("has_src")), known.select(F.col("id").alias("dst"), F.lit(True).alias("has_dst"))
    ends = edges.join(a, "src", "left").join(b, "dst", "left").where("has_src is null or has_dst is null")
    return ends.select("src", "dst", "relation", F.when(F.col("has_src").isNull() & F.col("has_dst").isNull(), "both").when(F.col("has_src").isNull(), "src").otherwise("dst").alias("lost"))


def neighbourhood(edges: DataFrame, node: str, most: int) -> DataFrame:
    """(way, relation, neighbour, hidden): a node's first neighbours of each relation and direction, and how many more there are.

    A hub's neighbours are counted map-side, and cut to the first ones before they are shuffled.
    """
    out = edges.where(F.col("src") == node).select(F.lit("out").alias("way"), "relation", F.col("dst").alias("neighbour"))
    near = out.unionByName(edges.where(F.col("dst") == node).select(F.lit("in").alias("way"), "relation", F.col("src").alias("neighbour")))
    shown = near.withColumn("nth", F.row_number().over(Window.partitionBy("way", "relation").orderBy("neighbour"))).where(F.col("nth") <= most).drop("nth")
    more = near.groupBy("way", "relation").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("hidden"))
    return shown.join(more, ["way", "relation"])
