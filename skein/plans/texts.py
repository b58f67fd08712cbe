"""Queries over documents, pages, benchmark, labels, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import tables, urls
from skein.operators import changes, duplicates, ranges, retrieval
from skein.plans.registry import query
from skein.session import table

TERMS = ["the", "worthless", "ertion"]
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(rf"""
WITH d AS (SELECT doc_id, {_TOK} AS t FROM documents), r AS (SELECT doc_id, len(t) AS length, t FROM d), c AS (SELECT count(*) AS n, avg(length) AS mean FROM r),
q AS (SELECT unnest(['the', 'worthless', 'ertion']) AS term), p AS (SELECT doc_id, length, term, len(list_filter(t, lambda x: x = term)) AS tf FROM r, q), f AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM p GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 5) AS score FROM p JOIN f USING (term), c GROUP BY doc_id HAVING sum(tf) > 0
""")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS).select("doc_id", F.round("score", 5).alias("score"))


@query("""
SELECT doc_id, lang FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'src1') AND contains(lower(concat_ws(' ', source, lang, text)), 'the ')
""")
def card_search_all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of the search is a substring of the card's visible text."""
    card = F.lower(F.concat_ws(" ", "source", "lang", "text"))
    return table(spark, sf_dir, "documents").where(card.contains("src1") & card.contains("the ")).select("doc_id", "lang")


@query("""
WITH p AS (SELECT q.vec_id AS query, v.vec_id AS hit, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query, hit, round(c, 5) AS cosine, nth FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, hit) AS nth FROM p) WHERE nth <= 50
""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 vectors most like each vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    found = retrieval.nearest_to_queries(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 50)
    return found.select("query", "hit", F.round("cosine", 5).alias("cosine"), "nth")


@query("""
WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.vec_id % 50 = 0)
SELECT a, b, round(d, 5) AS distance, nth FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS nth FROM p WHERE d <= 0.9) WHERE nth <= 3
""")
def nearest_within_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of the same label with a larger id, of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    found = retrieval.nearest_to_queries(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 3, group="label", most_distance=0.9, larger_only=True)
    return found.select(F.col("query").alias("a"), F.col("hit").alias("b"), F.round(1 - F.col("cosine"), 5).alias("distance"), "nth")


@query(rf"""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY len(list_filter({_TOK}, lambda x: x = 'the')) DESC, doc_id) AS r FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents),
u AS (SELECT doc_id, 1.0 / (60 + r) AS part, 'lexical' AS arm FROM a WHERE r <= 50 UNION ALL SELECT doc_id, 1.0 / (60 + r), 'length' FROM b WHERE r <= 50)
SELECT doc_id, round(sum(part), 8) AS score, string_agg(DISTINCT arm, ',' ORDER BY arm) AS arms FROM u GROUP BY doc_id
""")
def rank_fusion_by_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    the = F.size(F.filter(retrieval.tokens(F.col("text")), lambda x: x == "the"))

    def arm(measure) -> DataFrame:
        top = docs.select("doc_id", measure.alias("m")).orderBy(F.desc("m"), "doc_id").limit(50)
        return top.select("doc_id", F.row_number().over(Window.orderBy(F.desc("m"), "doc_id")).alias("r"))

    return retrieval.fused({"lexical": arm(the), "length": arm(F.col("n_chars"))}, "doc_id").select("doc_id", F.round("score", 8).alias("score"), "arms")


@query("""
WITH r AS (SELECT event_type AS kind, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 17 + 1 END AS rank, value AS ms FROM events)
SELECT kind, count(*) AS n, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS recall, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95 FROM r GROUP BY kind
""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.when(F.col("event_id") % 4 == 0, None).otherwise(F.col("event_id") % 17 + 1).alias("rank"), F.col("value").alias("ms"))
    out = retrieval.evaluation(ranks, 10)
    return out.withColumns({"recall": F.round("recall", 6), "mrr": F.round("mrr", 6)})


@query("SELECT sha256(text) AS digest, min(doc_id) AS first, count(*) AS members FROM documents GROUP BY 1 HAVING count(*) > 1")
def hash_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.hash_clusters(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(rf"""
WITH f AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text), w AS (SELECT doc_id, {_TOK} AS t FROM f),
s AS (SELECT DISTINCT doc_id, array_to_string(t[k:k+4], ' ') AS h FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 3, 1))) AS k FROM w)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id HAVING count(*) >= 40),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b, shared, round(shared / (x.n + y.n - shared), 5) AS jaccard, round(shared / least(x.n, y.n), 5) AS containment FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
WHERE shared / (x.n + y.n - shared) >= 0.8 OR shared / least(x.n, y.n) >= 0.75
""")
def shingle_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copies by overlap of word shingles: Jaccard from 0.8 or containment from 0.75."""
    found = duplicates.shingle_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("a", "b", "shared", F.round("jaccard", 5).alias("jaccard"), F.round("containment", 5).alias("containment"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM customer JOIN supplier ON c_custkey % 97 = s_suppkey % 97 WHERE c_nationkey % 5 = s_nationkey % 5 AND c_nationkey <> s_nationkey),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), t(node, root) AS (SELECT a, a FROM u UNION SELECT u.b, t.root FROM t JOIN u ON u.a = t.node)
SELECT node, min(root) AS root FROM t GROUP BY node
""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    near = c.select(F.col("c_nationkey").alias("a"), (F.col("c_custkey") % 97).alias("k")).distinct().join(s.select(F.col("s_nationkey").alias("b"), (F.col("s_suppkey") % 97).alias("k")).distinct(), "k")
    return duplicates.components(near.where("a % 5 = b % 5 and a <> b").select("a", "b").distinct())


_SUFFIXES = ", ".join(f"'{x}'" for x in urls.COMPOUND)


@query(rf"""
WITH h AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages), r AS (SELECT *, string_split(host || '.' || ([{_SUFFIXES}])[1 + page_id % {len(urls.COMPOUND)}], '.') AS p FROM h)
SELECT page_id, host, array_to_string((string_split(host, '.'))[-2:], '.') AS domain, array_to_string(CASE WHEN array_to_string(p[-2:], '.') IN ({_SUFFIXES}) THEN p[-3:] ELSE p[-2:] END, '.') AS regional, left(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 60) AS slug, 'page_' || left(sha256('pages:' || url), 24) AS id FROM r
""")
def page_hosts_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, the domains under which they are registered (also of the same hosts under every compound suffix), slugs and ids."""
    name = urls.host(F.col("url"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in urls.COMPOUND]), (1 + F.col("page_id") % len(urls.COMPOUND)).cast("int"))
    regional = urls.registrable_domain(F.concat(name, F.lit("."), suffix))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("host"), urls.registrable_domain(name).alias("domain"), regional.alias("regional"), urls.slug(F.col("url")).alias("slug"), urls.deterministic_id("page", "pages", F.col("url")).alias("id"))


@query("""
WITH b AS (SELECT o_orderkey AS k, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0), t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(b.k, t.k) AS k, CASE WHEN b.k IS NULL THEN 'insert' WHEN t.k IS NULL THEN 'delete' ELSE 'update' END AS op FROM b FULL JOIN t ON b.k = t.k WHERE b.k IS NULL OR t.k IS NULL OR b.o_orderstatus <> t.o_orderstatus
""")
def row_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.delta(*_two_states(spark, sf_dir), "k").select("k", "op")


def _two_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_totalprice")
    return orders.where("k % 10 <> 0"), orders.where("k % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0")
def row_delta_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applying the changes to the old state gives the new one."""
    base, target = _two_states(spark, sf_dir)
    return changes.applied(base, changes.delta(base, target, "k"), target, "k")


@query("""
WITH o AS (SELECT conv_id, turn, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars, count(*) FILTER (WHERE role = before) AS repeats, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, bool_or(text = '') AS has_empty FROM o GROUP BY conv_id
""")
def conversation_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("chars"), (F.col("text") == "").alias("empty"))
    rows = ranges.previous(ranges.ranged(turns, ["conv_id"], ["turn"]), ["conv_id"], ["turn"], ["role"]).withColumn("before", F.col("previous.role"))
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.sum("chars").alias("chars"), F.count_if(F.col("role") == F.col("before")).alias("repeats"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.bool_or("empty").alias("has_empty")
    )


@query("""
SELECT source, count(*) AS n, sum(n_chars) AS chars, count(DISTINCT text) AS texts, count(quality) AS judged, round(avg(quality), 6) AS quality, count(*) FILTER (WHERE toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
""")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("digest"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("digest").alias("texts"), F.count("quality").alias("judged"), F.round(F.avg("quality"), 6).alias("quality"), F.count_if(F.col("toxic") == 1).alias("toxic")
    )


@query("""
WITH d AS (SELECT sha256(text) AS h, source, doc_id FROM documents), c AS (SELECT h, min(doc_id) AS first FROM d GROUP BY h)
SELECT source, count(*) AS docs, count(DISTINCT c.first) AS clusters, count(DISTINCT c.first) FILTER (WHERE d.doc_id = c.first) AS independent FROM d JOIN c USING (h) GROUP BY source
""")
def source_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source, after copies collapse to one, and those it was first with. Copies are one row a source before they meet, so no text has more rows than there are sources."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    of_source = docs.groupBy("h", "source").agg(F.count("*").alias("docs"), F.min("doc_id").alias("low"))
    ranked = of_source.withColumn("first", F.min("low").over(Window.partitionBy("h")))
    return ranked.groupBy("source").agg(F.sum("docs").alias("docs"), F.count("*").alias("clusters"), F.count_if(F.col("low") == F.col("first")).alias("independent"))


@query("""
SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())
""")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text <> ''), w AS (SELECT doc_id, text, n, unnest(range(0, 1 + greatest(0, ceil((n - 400) / 250.0))::INT)) AS ordinal FROM d)
SELECT doc_id, ordinal::INT AS ordinal, (ordinal * 250)::INT AS char_start, least(n, ordinal * 250 + 400)::INT AS char_end, md5(substr(text, (ordinal * 250 + 1)::INT, 400)) AS digest FROM w
""")
def windows_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of all texts by a table function that is called for each row."""
    tables.registered(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = spark.sql("SELECT d.doc_id, w.* FROM {docs} d, LATERAL text_windows(d.text, 400, 250, true) w", docs=docs)
    return found.select("doc_id", "ordinal", "char_start", "char_end", F.md5("text").alias("digest"))
