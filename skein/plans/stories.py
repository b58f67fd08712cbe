"""Queries of events told more than once: copies, names, groups by complete link, pairs for review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import stories
from skein.operators.retrieval import tokens
from skein.plans.registry import query
from skein.session import table



def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the telling of an event: its first words are its title, and what they say gives the other fields."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", tokens(F.coalesce("text", F.lit(""))).alias("w"))
    part = lambda a, n: F.slice("w", a, n)
    word = lambda k: F.get("w", F.lit(k - 1))
    action = F.get(F.array(F.lit("launch"), F.lit("research"), F.lit("policy")), F.coalesce(F.length(word(2)), F.lit(0)) % 3)
    date = F.when((F.length(word(1)) % 6 > 0) & (F.size("w") > 5), F.date_add(F.lit("2026-01-01").cast("date"), F.length(word(3)) * 7 + F.length(word(5))))
    return docs.select(
        F.col("doc_id").alias("id"), F.array_join(part(1, 8), " ").alias("title"), F.array_join(part(9, 32), " ").alias("summary"), F.lit("").alias("evidence"),
        F.coalesce(F.get(F.filter(part(1, 8), lambda x: F.length(x) > 4), F.lit(0)), F.lit("")).alias("subject"), action.alias("action"), F.coalesce(word(8), F.lit("")).alias("object"), action.alias("event_type"), date.alias("event_date"),
        F.slice(F.array_distinct(F.filter(part(1, 20), lambda x: F.length(x) > 8)), 1, 2).alias("products"), F.array().cast("array<string>").alias("organizations"), F.slice(part(1, 40), 1, 3).alias("facts"),
        (F.col("n_chars") > 500).alias("full"), F.when(F.col("source") == "src1", "primary").when(F.col("source") == "src2", "news").otherwise("review").alias("source_type"),
    )


@query()
def event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the one that stands for its group by complete link, and the group's name (tested against a plain greedy)."""
    events = _events(spark, sf_dir)
    members, _ = stories.merged(events)
    names = events.select(F.col("id"), stories.cluster_key().alias("name")).join(members, "id")
    group = names.groupBy("chosen").agg(F.min("name").alias("name"), F.count("*").alias("members"))
    return members.join(group, "chosen").select("id", "chosen", "name", "members")


@query()
def event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of groups that a person must look at, and why (tested against all pairs)."""
    return stories.for_review(_events(spark, sf_dir))[1]


@query(r"""
WITH p AS (SELECT doc_id AS id, nullif(text, '') AS k0, CASE WHEN length(text) >= 40 THEN lower(left(text, 40)) || '|' || coalesce(lang, '') END AS k1 FROM documents),
a AS (SELECT k0, min(id) AS first FROM p WHERE k0 IS NOT NULL GROUP BY k0 HAVING count(DISTINCT id) > 1), b AS (SELECT k1, min(id) AS first FROM p WHERE k1 IS NOT NULL GROUP BY k1 HAVING count(DISTINCT id) > 1)
SELECT id, coalesce(a.first, b.first) AS first, CASE WHEN a.first IS NOT NULL THEN 'text' ELSE 'lead and language' END AS reason FROM p LEFT JOIN a USING (k0) LEFT JOIN b USING (k1) WHERE a.first IS NOT NULL OR b.first IS NOT NULL
""")
def exact_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are exact copies of another by their text, or by lead and language, and the smallest of them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    lead = F.when(F.length("text") >= 40, F.concat_ws("|", F.lower(F.left("text", F.lit(40))), F.coalesce("lang", F.lit(""))))
    return stories.exact_copies(docs, [("text", F.when(F.col("text") != "", F.col("text"))), ("lead and language", lead)])


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


@query(rf"""
WITH t AS (SELECT conv_id * 100 + turn AS id, {_WORDS} AS w, role FROM conversations), e AS (SELECT id, array_to_string(w[1:2], ' ') AS subject, role AS action, array_to_string(w[3:4], ' ') AS object, CASE WHEN id % 3 > 0 THEN '2026-01-0' || (1 + id % 9) END AS day, list_sort(list_distinct(list_filter(w[1:12], lambda x: length(x) > 8))) AS products, array_to_string(w[1:20], ' ') AS evidence FROM t),
f AS (SELECT id, list_concat([subject, action, object, coalesce(day, '')], products, CASE WHEN day IS NULL THEN [evidence] ELSE [] END) AS fields FROM e)
SELECT id, 'evt_' || left(sha256('["' || array_to_string(fields, '","') || '"]'), 24) AS name FROM f
""")
def event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for each telling, made from what its event is."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), tokens(F.coalesce("text", F.lit(""))).alias("w"), "role")
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    day = F.when(F.col("id") % 3 > 0, F.concat(F.lit("2026-01-0"), 1 + F.col("id") % 9))
    events = turns.select("id", part(1, 2).alias("subject"), F.col("role").alias("action"), part(3, 2).alias("object"), day.alias("event_date"), F.filter(F.slice("w", 1, 12), lambda x: F.length(x) > 8).alias("products"), part(1, 20).alias("evidence"))
    return events.select("id", stories.cluster_key().alias("name"))
