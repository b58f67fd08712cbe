"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, html, language, merkle, negatives, pieces, quality, sharding, simhash, tokens, topk, toxicity, variants
from skein.llm.common import fold

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    text = pages.select("page_id", "url", html.main_text(F.col("html")).alias("text"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    model = toxicity.trained(docs, _table(spark, sf_dir, "labels"), held_out)
    scored = toxicity.toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = quality.trained(docs, _table(spark, sf_dir, "labels"), held_out)
    scored = quality.quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "top_passage", "top_weight")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = tokens.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.token_counts(_table(spark, sf_dir, "documents"), tokenizer, limit=1024)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pieces.coded(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("round_trip"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    found = language.language(docs.select("doc_id", "text"), language.trained(docs, held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.shards(rows, shards=16)  # the texts are read once; what is shuffled is narrow
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_groups(_table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    found = (op1_html, op2_toxicity, op3_merkle, op4_simhash, op5_quality, op6_decontaminate, op7_tokens, op8_sentencepiece, op9_language, op10_sharding, op11_variants, op12_negatives, op13_topk)
    return {f.__name__: f for f in found}


# A whole-number vector takes part if it and all of its components are there and finite.
_VECTORS = "SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_PRODUCT = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT"

# crc32 of the bytes of a string, bit by bit
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)),
 lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)), 4294967295)"""

_SQL = {
    "op11_variants": f"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
r AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS k, count(*) AS times FROM d WHERE length(run) >= 6 GROUP BY ALL), h AS (SELECT run, times, {_CRC32.format("k")} AS h FROM r),
v AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM h),
w AS (SELECT word, sum(times)::BIGINT AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
x AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near FROM x a JOIN x b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word UNION SELECT x.word, w.word FROM x JOIN w ON x.cut = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.cut = w.word),
b AS (SELECT p.word, count(*) AS n_near, arg_min(near, (-w.n, near)) AS best, max(w.n) AS best_n FROM p JOIN w ON w.word = p.near GROUP BY p.word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM w LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root, form AS further FROM f UNION ALL SELECT c.word, c.further, f.form FROM c JOIN f ON f.word = c.further)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.further IS NULL
""",
    "op12_negatives": f"""
WITH e AS ({_VECTORS} AND label IS NOT NULL), r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM e), s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, {_PRODUCT} AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
""",
    "op13_topk": f"""
WITH r AS ({_VECTORS}), s AS (SELECT a.vec_id AS query_id, b.vec_id, {_PRODUCT} AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5
""",
}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express: no trained model, and no hash that DuckDB lacks."""
    return _SQL
