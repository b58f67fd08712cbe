"""Queries of reports on what a base of documents holds, and of lists that wait for a reviewer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import urls
from skein.operators.frames import top_of_each
from skein.plans.registry import query
from skein.session import table

_NAMES = "n AS (SELECT DISTINCT conv_id * 100 + turn AS statement, CASE role WHEN 'user' THEN 'asked' ELSE 'told' END AS kind, unnest(regexp_extract_all(text, '[A-Z][a-z]{4,}')) AS name FROM conversations)"


@query(f"""
WITH {_NAMES}, t AS (SELECT 'kind' AS section, kind AS name, count(DISTINCT name) AS n FROM n GROUP BY kind), m AS (SELECT 'most named' AS section, kind || ': ' || name AS name, count(*) AS n FROM n GROUP BY kind, n.name ORDER BY n DESC, 2 LIMIT 15)
SELECT * FROM t UNION ALL SELECT * FROM m UNION ALL SELECT 'reach', 'mentions', count(*) FROM n UNION ALL SELECT 'reach', 'statements', count(DISTINCT statement) FROM n
""")
def entity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What turns name: entities of each kind, the fifteen named most, mentions, and turns that name anything. A turn's mentions are made distinct in the turn, so what is shuffled are counts."""
    kind = F.when(F.col("role") == "user", "asked").otherwise("told")
    turns = table(spark, sf_dir, "conversations").select(kind.alias("kind"), F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{4,})"), 1)).alias("names"))
    mentions = turns.select("kind", F.explode("names").alias("name")).groupBy("kind", "name").agg(F.count("*").alias("n"))
    kinds = mentions.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("section"), "name", "n")
    most = mentions.select(F.lit("most named").alias("section"), F.concat_ws(": ", "kind", "name").alias("name"), "n").orderBy(F.desc("n"), "name").limit(15)
    total = mentions.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("reach").alias("section"), F.lit("mentions").alias("name"), "n")
    reach = turns.agg(F.count_if(F.size("names") > 0).alias("n")).select(F.lit("reach").alias("section"), F.lit("statements").alias("name"), "n")
    return kinds.unionByName(most).unionByName(total).unionByName(reach)


@query("""
WITH d AS (SELECT lang, length(text) >= 200 AS long, quality = 1 AS good, toxic = 0 AS clean FROM documents LEFT JOIN labels USING (doc_id))
SELECT coalesce(lang, '?') AS lang, count(*) AS documents, count(*) FILTER (WHERE long AND good AND clean) AS published, count(*) FILTER (WHERE good IS NULL OR clean IS NULL) AS unread, count(*) FILTER (WHERE NOT long) AS short, count(*) FILTER (WHERE NOT good) AS poor, count(*) FILTER (WHERE NOT clean) AS toxic, round(100.0 * count(*) FILTER (WHERE long AND good AND clean) / count(*), 2) AS share FROM d GROUP BY 1
""")
def publication_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language: how much is published, and how much each condition holds back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.length("text") >= 200).alias("long"))
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 0).alias("clean")), "doc_id", "left")
    out = F.col("long") & F.col("good") & F.col("clean")
    counts = rows.groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count("*").alias("documents"), F.count_if(out).alias("published"), F.count_if(F.col("good").isNull() | F.col("clean").isNull()).alias("unread"), F.count_if(~F.col("long")).alias("short"), F.count_if(~F.col("good")).alias("poor"), F.count_if(~F.col("clean")).alias("toxic"))
    return counts.withColumn("share", F.round(100.0 * F.col("published") / F.col("documents"), 2))


@query("""
WITH t AS (SELECT conv_id, role, length(text) AS n, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations), c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS asked, count(*) FILTER (WHERE role = 'user' AND following IS DISTINCT FROM 'user' AND following IS NOT NULL) AS answered, sum(n) AS chars FROM t GROUP BY conv_id)
SELECT CASE WHEN asked = 0 THEN 'nothing asked' WHEN answered = asked THEN 'read' WHEN answered = 0 THEN 'unread' ELSE 'partly' END AS state, count(*) AS conversations, sum(asked)::BIGINT AS asked, sum(answered)::BIGINT AS answered, sum(chars)::BIGINT AS chars FROM c GROUP BY 1
""")
def reading_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions of conversations have an answer after them, by the state that this leaves a conversation in."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("following"))
    rows = turns.join(after, ["conv_id", "turn"], "left")
    user = F.col("role") == "user"
    each = rows.groupBy("conv_id").agg(F.count_if(user).alias("asked"), F.count_if(user & (F.col("following") != "user")).alias("answered"), F.sum("n").alias("chars"))
    state = F.when(F.col("asked") == 0, "nothing asked").when(F.col("asked") == F.col("answered"), "read").when(F.col("answered") == 0, "unread").otherwise("partly")
    return each.groupBy(state.alias("state")).agg(F.count("*").alias("conversations"), F.sum("asked").alias("asked"), F.sum("answered").alias("answered"), F.sum("chars").alias("chars"))


@query("""
SELECT p_type AS topic, count(DISTINCT l_orderkey) FILTER (WHERE l_returnflag <> 'N') AS known, count(DISTINCT l_orderkey) AS named, count(DISTINCT p_partkey) AS concepts FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_type
""")
def knowledge_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each topic: statements that are knowledge, all statements, and concepts; counted without a row of one multiplying the others. Distinct statements are cut in tasks first."""
    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("topic"), "p_partkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", (F.col("l_returnflag") != "N").cast("int").alias("known"))
    once = parts.join(lines, "p_partkey").groupBy("topic", "l_orderkey").agg(F.max("known").alias("known"))
    of_statements = once.groupBy("topic").agg(F.sum("known").alias("known"), F.count("*").alias("named"))
    return parts.groupBy("topic").agg(F.count_distinct("p_partkey").alias("concepts")).join(of_statements, "topic", "left").select("topic", F.coalesce("known", F.lit(0)).alias("known"), F.coalesce("named", F.lit(0)).alias("named"), "concepts")


@query(r"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages), a AS (SELECT DISTINCT host FROM h WHERE page_id % 7 = 0), r AS (SELECT DISTINCT host FROM h WHERE page_id % 11 = 0)
SELECT host, count(*) AS pages, min(page_id) AS first FROM h WHERE host <> '' AND host NOT IN (SELECT host FROM a) AND host NOT IN (SELECT host FROM r) GROUP BY host
""")
def pending_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that belong to no family yet and were not rejected, with their pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"), F.min("page_id").alias("first"), F.bool_or((F.col("page_id") % 7 == 0) | (F.col("page_id") % 11 == 0)).alias("settled"))
    return hosts.where("host <> '' and not settled").select("host", "pages", "first")


@query("""
WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'), e AS (SELECT l_orderkey AS o_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS nth FROM lineitem), s AS (SELECT o_orderkey, string_agg(l_linenumber, ',' ORDER BY nth) AS sample FROM e WHERE nth <= 6 GROUP BY 1), c AS (SELECT o_orderkey, count(*) AS evidence FROM e GROUP BY 1)
SELECT o_orderkey, sample, evidence FROM o JOIN s USING (o_orderkey) JOIN c USING (o_orderkey)
""")
def pending_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders with how much evidence they have and the six strongest pieces; an order's lines are cut to six before they meet."""
    open_rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    few = top_of_each(lines, ["o_orderkey"], [F.desc("l_quantity"), F.col("l_linenumber")], 6, "l_linenumber")
    sample = few.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("nth", "l_linenumber"))).alias("s")).select("o_orderkey", F.array_join(F.transform("s", lambda x: x["l_linenumber"].cast("string")), ",").alias("sample"))
    return open_rows.join(sample, "o_orderkey").join(lines.groupBy("o_orderkey").agg(F.count("*").alias("evidence")), "o_orderkey")


@query(f"""
WITH {_NAMES}, c AS (SELECT name, count(*) AS n FROM n GROUP BY name), k AS (SELECT name, n, left(lower(name), 5) AS stem FROM c), b AS (SELECT stem, arg_max(name, (n, name)) AS canonical, count(*) AS many FROM k GROUP BY stem HAVING count(*) > 1)
SELECT k.name AS alias, b.canonical, k.n FROM k JOIN b USING (stem) WHERE k.name <> b.canonical
""")
def pending_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that begin like a more frequent one, which they may stand for."""
    mentions = table(spark, sf_dir, "conversations").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{4,})"), 1))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    keyed = mentions.withColumn("stem", F.left(F.lower("name"), F.lit(5)))
    best = keyed.groupBy("stem").agg(F.max(F.struct("n", "name")).alias("b")).select("stem", F.col("b.name").alias("canonical"))
    return keyed.join(best, "stem").where("name <> canonical").select(F.col("name").alias("alias"), "canonical", "n")


@query("""
WITH g AS (SELECT sha256(text) AS digest, min(doc_id) AS first, count(*) AS members, count(DISTINCT source) AS sources FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1), v AS (SELECT doc_id, quality FROM labels)
SELECT first, members, sources, CASE WHEN v.quality IS NULL THEN 'open' WHEN v.quality = 1 THEN 'accepted' ELSE 'rejected' END AS verdict FROM g LEFT JOIN v ON v.doc_id = g.first
""")
def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts with the verdict that was given on their first member, if any."""
    docs = table(spark, sf_dir, "documents").where("text <> ''").select(F.sha2("text", 256).alias("digest"), "doc_id", "source")
    once = docs.groupBy("digest", "source").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    groups = once.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("members"), F.count("source").alias("sources")).where("members > 1")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("first"), "quality")
    verdict = F.when(F.col("quality").isNull(), "open").when(F.col("quality") == 1, "accepted").otherwise("rejected")
    return groups.join(labels, "first", "left").select("first", "members", "sources", verdict.alias("verdict"))
