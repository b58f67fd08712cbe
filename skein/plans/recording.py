"""Queries of batches recorded beside what was recorded before; each gives the rows of all its tables, with the table's name as `sink`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import recording
from skein.plans.registry import query
from skein.session import table
from skein.tables import written


def _all(tables: recording.Tables, **columns: dict[str, Column]) -> DataFrame:
    """The tables under each other: each table's columns of the result are given by name."""
    return reduce(DataFrame.unionByName, [tables[sink].select(F.lit(sink).alias("sink"), *[c.alias(name) for name, c in chosen.items()]) for sink, chosen in columns.items()])


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


@query("""
WITH due AS (SELECT o_orderkey AS run, o_orderkey % 4 AS s, CASE WHEN o_orderkey % 4 >= 2 THEN o_orderkey % 3 + 1 ELSE 0 END AS so_far, o_orderpriority = '1-URGENT' AS cut FROM orders WHERE o_orderkey % 4 <> 1),
i AS (SELECT l_orderkey AS run, l_linenumber AS item, CASE WHEN bool_or(l_returnflag = 'N') THEN NULL ELSE min(l_returnflag) END AS reason FROM lineitem GROUP BY ALL), f AS (SELECT i.* FROM i JOIN due USING (run) WHERE NOT cut)
SELECT 'runs' AS sink, run, NULL::INT AS item, CASE WHEN cut THEN 'failed' ELSE 'succeeded' END AS what, so_far + 1 AS n FROM due UNION ALL SELECT 'runs', o_orderkey, NULL, 'succeeded', o_orderkey % 3 + 1 FROM orders WHERE o_orderkey % 4 = 1
UNION ALL SELECT 'evidence', o_orderkey, 0, NULL, NULL FROM orders WHERE o_orderkey % 4 = 1 UNION ALL SELECT 'evidence', run, item, NULL, NULL FROM f WHERE reason IS NULL
UNION ALL SELECT 'candidates', o_orderkey, 0, CASE WHEN o_orderkey % 4 = 1 THEN 'earlier, open' ELSE 'earlier, discarded' END, NULL FROM orders WHERE o_orderkey % 4 > 0
UNION ALL SELECT 'candidates', run, item, reason || ', open', NULL FROM f WHERE reason IS NOT NULL UNION ALL SELECT 'candidates', run, NULL, 'cut off, open', NULL FROM due WHERE cut
""")
def recorded_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of runs over fragments, some of which ran before: what is placed is evidence, the rest are candidates, and runs that failed are tried again."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    run = F.col("o_orderkey").alias("run")
    before = orders.where("o_orderkey % 4 > 0")
    recorded = {
        "runs": before.select(run, F.when(F.col("o_orderkey") % 4 == 1, "succeeded").otherwise("failed").alias("status"), (F.col("o_orderkey") % 3 + 1).alias("attempts")),
        "evidence": before.where("o_orderkey % 4 = 1").select(run, F.lit(0).alias("item")),
        "candidates": before.select(run, F.lit(0).alias("item"), F.lit("earlier").alias("reason"), F.lit("open").alias("status")),
    }
    attempts = orders.select(run, F.when(F.col("o_orderpriority") == "1-URGENT", "cut off").alias("failure"))
    items = lines.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("int").alias("item"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("reason"))
    after = recording.extraction(recorded, attempts, items)
    what = F.concat_ws(", ", "reason", "status")
    names = ("run", "item", "what", "n")
    return _all(
        after,
        runs=dict(zip(names, (F.col("run"), _null("int"), F.col("status"), F.col("attempts")), strict=True)),
        evidence=dict(zip(names, (F.col("run"), F.col("item"), _null("string"), _null("long")), strict=True)),
        candidates=dict(zip(names, (F.col("run"), F.col("item"), what, _null("long")), strict=True)),
    )


_WORDS = "[a-z]{6,}"
_TURNS = f"t AS (SELECT conv_id * 100 + turn AS statement, role AS kind, CASE WHEN length(text) < 60 THEN 'rejected' WHEN length(text) < 200 THEN 'doubtful' ELSE 'admitted' END AS admission, DATE '2026-01-01' + (turn % 28)::INT AS dated, list_sort(list_distinct(regexp_extract_all(text, '{_WORDS}'))) AS named, turn % 2 = 0 AS old FROM conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text")
    admission = F.when(size < 60, "rejected").when(size < 200, "doubtful").otherwise("admitted")
    dated = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("turn") % 28).cast("int"))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("statement"), F.col("role").alias("kind"), admission.alias("admission"), dated.alias("dated"), F.regexp_extract_all("text", F.lit(f"({_WORDS})"), 1).alias("named"), "turn")


@query(f"""
WITH {_TURNS}, known AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORDS}')) AS subject FROM benchmark WHERE item_id % 4 > 0), p AS (SELECT statement, subject FROM (SELECT statement, unnest(named) AS subject FROM t) JOIN known USING (subject)),
r AS (SELECT *, dated + CASE kind WHEN 'user' THEN 30 WHEN 'assistant' THEN 365 END AS until FROM t)
SELECT 'readings' AS sink, statement, CASE WHEN old THEN 'read before' ELSE kind || ', ' || admission || coalesce(', until ' || until::DATE::VARCHAR, '') END AS what FROM r
UNION ALL SELECT 'placements', statement, subject FROM p UNION ALL SELECT 'gaps', statement, CASE WHEN len(named) > 0 THEN 'not known: ' || array_to_string(named, ', ') ELSE 'no subject named' END FROM t WHERE admission <> 'rejected' AND statement NOT IN (SELECT statement FROM p)
""")
def recorded_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of all turns, half of which were read before; the words of the benchmark are the known subjects."""
    turns = _turns(spark, sf_dir)
    recorded = {
        "readings": turns.where("turn % 2 = 0").select("statement", F.lit("read before").alias("kind"), F.lit("").alias("admission"), _null("date").alias("valid_until")),
        "placements": turns.select("statement", _null("string").alias("subject")).limit(0),
        "gaps": turns.select("statement", _null("string").alias("missing")).limit(0),
    }
    benchmark = table(spark, sf_dir, "benchmark")
    subjects = benchmark.select(F.explode(F.regexp_extract_all("text", F.lit(f"({_WORDS})"), 1)).alias("subject"), (F.col("item_id") % 4 > 0).alias("accepted"))
    after = recording.readings(recorded, turns.drop("turn"), subjects, {"user": 30, "assistant": 365})
    until = F.when(F.col("valid_until").isNotNull(), F.concat(F.lit("until "), F.col("valid_until").cast("string")))
    what = F.concat_ws(", ", "kind", F.nullif("admission", F.lit("")), until)
    return _all(after, readings={"statement": F.col("statement"), "what": what}, placements={"statement": F.col("statement"), "what": F.col("subject")}, gaps={"statement": F.col("statement"), "what": F.col("missing")})


@query("""
WITH f AS (SELECT DISTINCT conv_id * 100 + turn AS statement, role AS kind, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS form FROM conversations), m AS (SELECT statement, kind, regexp_replace(lower(form), '(ions?|s)$', '') AS name, min(form) AS form FROM f GROUP BY ALL)
SELECT 'entities' AS sink, NULL::BIGINT AS statement, kind, name, NULL AS form FROM m GROUP BY kind, name UNION ALL SELECT 'mentions', statement, kind, name, form FROM m UNION ALL SELECT DISTINCT 'aliases', NULL::BIGINT, kind, name, form FROM m WHERE lower(form) <> name
UNION ALL SELECT 'reads', conv_id * 100 + turn, NULL, NULL, NULL FROM conversations
""")
def recorded_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What turns name, recorded in two batches of which the second holds all of the first again."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("statement"), F.col("role").alias("kind"), F.explode_outer(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), 1)).alias("form"), "turn")
    name = F.regexp_replace(F.lower("form"), "(ions?|s)$", "")
    batch = turns.withColumns({"name": name, "role": F.lit("named")})
    none = batch.limit(0)
    recorded = {"entities": none.select("kind", "name"), "mentions": none.select("statement", "kind", "name", "role", "form"), "aliases": none.select("kind", "name", F.col("form").alias("alias")), "reads": none.select("statement")}
    first = batch.where("turn % 2 = 0")
    recorded = recording.mentions(recorded, first, first)
    after = recording.mentions(recorded, batch, batch)
    empty = {"statement": _null("long"), "kind": _null("string"), "name": _null("string"), "form": _null("string")}
    named = {"kind": F.col("kind"), "name": F.col("name")}
    return _all(after, entities=empty | named, mentions=empty | named | {"statement": F.col("statement"), "form": F.col("form")}, aliases=empty | named | {"form": F.col("alias")}, reads=empty | {"statement": F.col("statement")})


@query("""
WITH j AS (SELECT l_partkey AS a, l_suppkey AS b, CASE WHEN l_returnflag <> 'N' THEN l_linestatus END AS link, l_linenumber % 2 = 0 AS old FROM lineitem WHERE l_partkey IS NOT NULL)
SELECT 'links' AS sink, a, b, link, CASE WHEN bool_or(old) THEN 'first' ELSE 'second' END AS judge FROM j WHERE link IS NOT NULL GROUP BY ALL UNION ALL SELECT 'alone', a, b, NULL, CASE WHEN bool_or(old) THEN 'first' ELSE 'second' END FROM j WHERE link IS NULL GROUP BY a, b
""")
def recorded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged pairs of parts and suppliers in two batches: links, and pairs left alone; who judged first stays."""
    lines = table(spark, sf_dir, "lineitem")
    judged = lines.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.when(F.col("l_returnflag") != "N", F.col("l_linestatus")).alias("link"), "l_linenumber")
    none = judged.limit(0).withColumn("judge", F.lit(""))
    recorded = {"links": none.select("a", "b", "link", "judge"), "alone": none.select("a", "b", "judge")}
    first = recording.links(recorded, judged.where("l_linenumber % 2 = 0").withColumn("judge", F.lit("first")))
    recorded = {name: written(rows, f"recorded-{name}") for name, rows in first.items()}  # the next batch reads it twice
    after = recording.links(recorded, judged.withColumn("judge", F.lit("second")))
    pair = {"a": F.col("a"), "b": F.col("b")}
    return _all(after, links=pair | {"link": F.col("link"), "judge": F.col("judge")}, alone=pair | {"link": _null("string"), "judge": F.col("judge")})


@query("""
WITH m AS (SELECT DISTINCT l_partkey AS part, l_orderkey AS statement FROM lineitem), s AS (SELECT l_partkey AS part, l_orderkey AS statement, min(nullif(l_suppkey % 5, 0)) AS source FROM lineitem GROUP BY ALL),
g AS (SELECT part, count(*) AS statements, count(DISTINCT source) AS sources, count(*) FILTER (WHERE source IS NULL) AS unknown, left(sha256(concat_ws(':', count(*), min(statement), max(statement), sum(('0x' || left(sha256(statement::VARCHAR), 10))::BIGINT))), 24) AS idea FROM s GROUP BY part),
o AS (SELECT idea, min((part, statements, sources, unknown)) AS r FROM g GROUP BY idea)
SELECT 'ideas' AS sink, idea, r.statements AS statements, r.sources AS sources, r.unknown AS unknown, r.sources >= 2 AS admitted, NULL::BIGINT AS statement FROM (SELECT idea, struct_pack(part := r[1], statements := r[2], sources := r[3], unknown := r[4]) AS r FROM o)
UNION ALL SELECT 'evidence', o.idea, NULL, NULL, NULL, NULL, m.statement FROM o JOIN m ON m.part = o.r[1]
""")
def recorded_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's orders as one idea with its verdict, in two batches; groups with the same members are one idea."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("statement"), F.nullif(F.col("l_suppkey") % 5, F.lit(0)).alias("source"))
    none = lines.limit(0)
    recorded = {"ideas": none.select(F.lit("").alias("idea"), F.lit(0).cast("long").alias("statements"), F.lit(0).cast("long").alias("sources"), F.lit(0).cast("long").alias("unknown"), F.lit(True).alias("admitted")), "evidence": none.select(F.lit("").alias("idea"), "statement")}
    after = recording.ideas(recording.ideas(recorded, lines), lines)
    counts = ("statements", "sources", "unknown")
    return _all(after, ideas={"idea": F.col("idea")} | {c: F.col(c) for c in counts} | {"admitted": F.col("admitted"), "statement": _null("long")}, evidence={"idea": F.col("idea")} | {c: _null("long") for c in counts} | {"admitted": _null("boolean"), "statement": F.col("statement")})


@query(f"""
WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id), d AS (SELECT doc_id AS claim, lang <> 'en' AND NOT regexp_matches(text, '[0-9]') AS waits, length(text) = n_chars AS exact, toxic, quality, NOT contains(text, chr(10)) AS one, CASE WHEN lang <> 'en' THEN length(regexp_replace(text, '[^0-9]', '', 'g')) % 2 = 0 END AS figures FROM documents LEFT JOIN l USING (doc_id)),
c AS (SELECT *, [CASE WHEN NOT exact THEN '{recording.CONDITIONS[0]}' END, CASE WHEN quality IS NULL THEN '{recording.CONDITIONS[1]}' END, CASE WHEN quality IS NOT NULL AND toxic = 1 THEN '{recording.CONDITIONS[2]}' END, CASE WHEN NOT one THEN '{recording.CONDITIONS[3]}' END, CASE WHEN NOT figures THEN '{recording.CONDITIONS[4]}' END] AS fails FROM d),
f AS (SELECT claim, waits, unnest(fails) AS condition FROM c), n AS (SELECT claim, waits, count(condition) AS failed FROM f GROUP BY ALL), p AS (SELECT claim FROM n WHERE NOT waits AND failed = 0), q AS (SELECT doc_id AS claim, '{recording.CONDITIONS[2]}' AS condition FROM l WHERE quality = 0)
SELECT 'published' AS sink, claim, NULL AS condition, NULL AS state FROM p UNION ALL SELECT 'waiting', claim, NULL, NULL FROM n WHERE waits
UNION ALL SELECT 'quarantine', claim, condition, CASE WHEN claim IN (SELECT claim FROM p) THEN 'closed' ELSE 'open' END FROM q
UNION ALL SELECT 'quarantine', claim, condition, 'open' FROM f WHERE NOT waits AND condition IS NOT NULL AND (claim, condition) NOT IN (SELECT (claim, condition) FROM q)
""")
def recorded_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a quotation: published, waiting for a translation, or in quarantine with what it fails; entries of what is published now are closed."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "n_chars").join(labels, "doc_id", "left")
    block = F.when(F.col("quality").isNull(), "provenance missing").when(F.col("toxic") == 1, "blocked")
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    batch = docs.select(F.col("doc_id").alias("claim"), F.col("lang").alias("language"), F.col("text").rlike("[0-9]").alias("translated"), (F.length("text") == F.col("n_chars")).alias("exact"), block.alias("block"), (~F.col("text").contains("\n")).alias("one_paragraph"), F.when(F.col("lang") != "en", digits % 2 == 0).alias("figures"), F.lit(1).alias("sources"))
    recorded = {"published": batch.select("claim", "sources").limit(0), "quarantine": labels.where("quality = 0").select(F.col("doc_id").alias("claim"), F.lit("blocked").alias("condition"), F.lit("open").alias("state"))}
    after = recording.quotations(recorded, batch, "en")
    none = {"claim": F.col("claim"), "condition": _null("string"), "state": _null("string")}
    return _all(after, published=none, waiting=none, quarantine={c: F.col(c) for c in none})
