"""Lexical and vector retrieval: postings, BM25, nearest vectors, reciprocal rank fusion, evaluation."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import tiling
from skein.tables import broadcast_below, written

#: Letters, digits and underscore of any script, in Java's notation.
WORD = r"[\p{L}\p{N}_]+"
RRF_K = 60
K1, B = 1.2, 0.75
#: Terms that a search of many questions looks for inside arrays of words.
LISTED = 5000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def term_counts(text: Column, terms: list[str]) -> list[Column]:
    """How often each term stands in a text as a word of its own."""
    low = F.lower(text)
    edge = WORD[:-1]
    return [F.when(low.contains(t), F.regexp_count(low, F.lit(f"(?<!{edge})\\Q{t}\\E(?!{edge})"))).otherwise(0) for t in terms]


def prefixes_matched(text: Column, asked: str, most: int = 8) -> Column:
    """How many of the asked words, the first `most` of them, begin a word of the text."""
    low, edge = F.lower(text), WORD[:-1]
    prefixes = list(dict.fromkeys(re.findall(r"\w+", asked.lower())))[:most]
    return reduce(lambda x, y: x + y, [F.coalesce(low.rlike(rf"(?<!{edge})\Q{p}\E").cast("int"), F.lit(0)) for p in prefixes], F.lit(0))


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of documents with any of the terms.

    The texts are read once: their length and the terms' counts are written as narrow rows, from which the totals (one
    row) and the scores are taken.
    """
    rows = written(docs.select(key, F.regexp_count(text, F.lit(WORD)).alias("length"), *[c.alias(f"tf{k}") for k, c in enumerate(term_counts(F.col(text), terms))]), "bm25")
    totals = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    joined = rows.where(reduce(lambda x, y: x | y, [F.col(f"tf{k}") > 0 for k in range(len(terms))])).join(F.broadcast(totals))
    part = [weight(F.col(f"tf{k}"), F.col(f"df{k}"), F.col("length"), F.col("n"), F.col("mean"), k1, b) for k in range(len(terms))]
    return joined.select(key, reduce(lambda x, y: x + y, part).alias("score"))


def weight(tf: Column, df: Column, length: Column, n: Column, mean: Column, k1: float = K1, b: float = B) -> Column:
    """What a term adds to a document's BM25 score."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, length) of every word of every document, counted where the document is read: equal words stand together once its words are sorted."""
    words = docs.select(key, F.sort_array(tokens(F.col(text))).alias("t"))
    ends = words.select(key, "t", F.array_compact(F.transform("t", lambda w, i: F.when(~w.eqNullSafe(F.get("t", i + 1)), i + 1))).alias("ends"))
    each = F.transform("ends", lambda end, k: F.struct(F.get("t", end - 1).alias("term"), (end - F.coalesce(F.get("ends", k - 1), F.lit(0))).cast("long").alias("tf")))
    # exploded as an expression: of a column Spark would filter the empty ones first, and part the texts into words once more for that
    return ends.select(key, F.size("t").alias("length"), F.explode(each).alias("x")).select("x.term", key, "x.tf", "length")


def indexed(docs: DataFrame, key: str, text: str, folder: str, buckets: int = 64) -> None:
    """Writes the postings as an index: parted by a hash of the term and sorted by term in each part, so a search reads a few row groups. Postings are shuffled once."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    lengths = docs.select(F.regexp_count(text, F.lit(WORD)).alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    # a salt parts each bucket into several files, so no task holds the postings of all frequent terms
    rows = postings(docs, key, text).repartition(bucket, F.pmod(F.xxhash64(key), F.lit(8))).withColumn("bucket", bucket)
    rows.sortWithinPartitions("bucket", "term", key).write.partitionBy("bucket").parquet(f"{folder}/postings")
    lengths.write.parquet(f"{folder}/totals")


def from_index(spark: SparkSession, folder: str, key: str, terms: list[str], buckets: int = 64) -> DataFrame:
    """(key, score) of documents with any of the terms, from an index: only the terms' parts are read."""
    rows = spark.read.parquet(f"{folder}/postings")
    asked = rows.where(F.col("term").isin(terms) & F.col("bucket").isin([_bucket(spark, t, buckets) for t in terms]))
    totals = spark.read.parquet(f"{folder}/totals")
    df = asked.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as terms
    scored = asked.join(F.broadcast(df), "term").join(F.broadcast(totals))
    return scored.groupBy(key).agg(F.sum(weight(F.col("tf"), F.col("df"), F.col("length"), F.col("n"), F.col("mean"))).alias("score"))


def _bucket(spark: SparkSession, term: str, buckets: int) -> int:
    return spark.range(1).select(F.pmod(F.xxhash64(F.lit(term)), F.lit(buckets)).cast("int").alias("b")).first()["b"]


def batch_search(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int) -> DataFrame:
    """(query, key, score, nth): the k best documents by BM25 of each of queries(query, terms).

    A document is parted into words once; only its length and the words that are asked for leave that step. Up to
    LISTED distinct terms are looked for inside the documents' arrays; more are joined to their words. Scores are cut to
    k a query within salted parts.
    """
    from skein.operators.frames import top_of_each

    asked = written(queries.select("query", F.explode(F.array_distinct("terms")).alias("term")), "asked")
    terms = asked.select("term").distinct()
    few = [r["term"] for r in terms.limit(LISTED + 1).collect()]
    words = docs.select(key, tokens(F.col(text)).alias("t"))
    if len(few) <= LISTED:
        kept = F.filter("t", lambda x: x.isin(few)) if few else F.array().cast("array<string>")
        found = written(words.select(key, F.size("t").alias("length"), kept.alias("t")), "asked-words")
        flat, lengths = found.select(key, "length", F.explode("t").alias("term")), found
    else:
        lengths = written(words.select(key, F.size("t").alias("length"), "t"), "words")
        flat = lengths.select(key, "length", F.explode("t").alias("term")).join(broadcast_below(terms, 200_000), "term")
    rows = written(flat.groupBy(key, "length", "term").agg(F.count("*").alias("tf")), "postings")
    totals = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    weighted = rows.join(broadcast_below(df, 200_000), "term").join(F.broadcast(totals)).select(key, "term", weight(F.col("tf"), F.col("df"), F.col("length"), F.col("n"), F.col("mean")).alias("w"))
    scores = weighted.join(asked, "term").groupBy("query", key).agg(F.round(F.sum("w"), 6).alias("score"))
    return top_of_each(scores, ["query"], [F.desc("score"), F.col(key)], k, key)


def fused(arms: dict[str, DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """(key, score, arms): reciprocal rank fusion of arms with (key, r), as a union and one sum."""
    parts = [df.select(key, (1.0 / (k + F.col("r"))).alias("part"), F.lit(name).alias("arm")) for name, df in arms.items()]
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(key).agg(F.sum("part").alias("score"), F.array_join(F.array_sort(F.collect_set("arm")), ",").alias("arms"))


def evaluation(ranks: DataFrame, k: int) -> DataFrame:
    """Recall@k, mean reciprocal rank and nearest-rank percentiles of (kind, rank, ms), rank null where nothing was found."""
    hit = F.col("rank") <= k
    return ranks.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.avg(F.coalesce(hit.cast("int"), F.lit(0))).alias("recall"),
        F.avg(F.coalesce(F.when(hit, 1.0 / F.col("rank")), F.lit(0.0))).alias("mrr"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ms)").alias("p50"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95"),
    )


def package(hits: DataFrame, key: str, score: str, size: int, floor: float) -> DataFrame:
    """The strongest hits from a floor on, numbered from 1; only so many rows reach the numbering."""
    chosen = hits.where(F.col(score) >= floor).orderBy(F.desc(score), key).limit(size)
    return chosen.withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc(score), key)))


def nearest_to_queries(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, group: str | None = None, most_distance: float | None = None, larger_only: bool = False) -> DataFrame:
    """(query, hit, cosine, nth): the k vectors most like each query, ties by key, a query itself left out; within the query's group if one is given.

    Tiles of queries and vectors are multiplied in tasks, and each keeps k hits a query, so only those are shuffled and
    no pair of rows is made. Rows without a key or vector, or with a component that is null or no number, take no part;
    nor do rows without a group where groups are asked for. Vectors of another length end in zeros. With larger_only a
    hit's key must be larger than the query's.
    """
    part = F.xxhash64(group) if group else F.lit(0).cast("long")  # groups of any type

    def fit(rows: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        good = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return rows.where(good & F.col(group).isNotNull() if group else good).select(F.col(key).cast("long").alias("key"), part.alias("part"), v.alias("v"))

    rows, asked = written(fit(vectors), "vectors"), written(fit(queries), "questions")
    found = tiling.tiled(asked, rows, "key", _nearest_in_tile(k, most_distance, larger_only), "query long, hit long, cosine double")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "hit"))  # k rows of a query from each tile, cut before the shuffle
    return found.withColumn("nth", best).where(F.col("nth") <= k)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(1e-300, np.sqrt((v * v).sum(axis=1, keepdims=True)))


def _nearest_in_tile(k: int, most_distance: float | None, larger_only: bool):
    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        width = max(1, int(tiling.widths(asked["v"]).max()), int(tiling.widths(block["v"]).max()))
        names, groups, keys, own = asked["key"].to_numpy(), asked["part"].to_numpy(), block["key"].to_numpy(), block["part"].to_numpy()
        queries, vectors = (_unit(tiling.matrix(t["v"], width, np.float64)) for t in (asked, block))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for q in range(len(names)):
            like = vectors @ queries[q]
            fits = (own == groups[q]) & (keys > names[q] if larger_only else keys != names[q])
            if most_distance is not None:
                fits &= 1 - like <= most_distance
            some = np.flatnonzero(fits)
            if len(some) > 4 * k:
                some = some[like[some] >= np.partition(like[some], len(some) - k)[len(some) - k]]
            some = some[np.argsort(-like[some], kind="stable")][:k]  # keys ascend, so ties are in their order
            out.append((np.full(len(some), names[q]), keys[some], like[some]))
        return pa.table(dict(zip(("query", "hit", "cosine"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run
