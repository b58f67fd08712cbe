"""Queries of reviews: coverage of one text by another, chains in both directions, backlogs, cursors, labelled prose, lists in JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import dates, texts
from skein.operators import evidence, frames, pages, ranges, retrieval
from skein.operators.reports import side_by_side
from skein.plans.registry import query
from skein.session import table
from skein.tables import written

_WORDS = r"[a-z]{4,}"
_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_PLACE = "orders by price, status F"


@query(rf"""
WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '{_WORDS}')) AS words FROM conversations), p AS (SELECT *, lag(words) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM w),
c AS (SELECT conv_id, turn, len(words) AS words, len(list_intersect(words, coalesce(before, []))) AS shared FROM p), r AS (SELECT *, CASE WHEN words > 0 THEN round(shared / words, 6) END AS coverage FROM c)
SELECT *, CASE WHEN coverage >= 0.6 THEN 'covered' WHEN coverage >= 0.3 THEN 'partly' ELSE 'open' END AS band FROM r
""")
def coverage_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of a turn's words the turn before it has, in three bands."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"({_WORDS})"), 1))
    turns = ranges.ranged(table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("words")), ["conv_id"], ["turn"])
    both = ranges.previous(turns, ["conv_id"], ["turn"], ["words"])
    shared = F.coalesce(F.size(F.array_intersect("words", "previous.words")), F.lit(0))
    counted = both.select("conv_id", "turn", F.size("words").alias("words"), F.when(F.col("previous").isNull(), 0).otherwise(shared).alias("shared"))
    covered = counted.withColumn("coverage", F.when(F.col("words") > 0, F.round(F.col("shared") / F.col("words"), 6)))
    return covered.withColumn("band", F.when(F.col("coverage") >= 0.6, "covered").when(F.col("coverage") >= 0.3, "partly").otherwise("open"))


@query(rf"""
WITH w AS (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '{_WORDS}') AS w FROM conversations), s AS (SELECT conv_id, turn, role, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w),
p AS (SELECT *, lag(s) OVER (PARTITION BY conv_id, role ORDER BY turn) AS b FROM s), c AS (SELECT conv_id, turn, len(s) AS n, len(b) AS m, len(list_intersect(s, b)) AS shared FROM p WHERE b IS NOT NULL)
SELECT conv_id, turn, CASE WHEN n + m > 0 THEN round(shared / (n + m - shared), 6) END AS likeness, coalesce(shared >= 0.5 * (n + m - shared) AND n + m > 0, false) AS repeats FROM c
""")
def repeated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeness of a turn to the one before of the same role: Jaccard of three-word shingles; at a half it repeats it."""
    keys = ["conv_id", "role"]
    words = table(spark, sf_dir, "conversations").select(*keys, "turn", F.regexp_extract_all(F.lower("text"), F.lit(f"({_WORDS})"), 1).alias("w"))
    parted = ranges.ranged(words.select(*keys, "turn", texts.word_shingles(F.col("w"), 3).alias("s")), keys, ["turn"])
    both = ranges.previous(parted, keys, ["turn"], ["s"]).where("previous is not null")
    counted = both.select("conv_id", "turn", (F.size("s") + F.size("previous.s")).alias("all"), F.size(F.array_intersect("s", "previous.s")).alias("shared"))
    union = F.col("all") - F.col("shared")
    return counted.select("conv_id", "turn", F.when(F.col("all") > 0, F.round(F.col("shared") / union, 6)).alias("likeness"), ((F.col("all") > 0) & (F.col("shared") >= 0.5 * union)).alias("repeats"))


@query("""
WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents), m AS (SELECT doc_id, (SELECT count(*) FROM (VALUES ('ab'), ('leau'), ('que'), ('der'), ('zz')) v(p) WHERE len(list_filter(w, lambda x: starts_with(x, p))) > 0) AS matched FROM t)
SELECT doc_id, matched FROM m WHERE matched > 0
""")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a word that begins with any of the asked words, eight of them at most, and how many of those they match."""
    hits = table(spark, sf_dir, "documents").select("doc_id", retrieval.prefixes_matched(F.col("text"), "Ab leau, que; der zz").alias("matched"))
    return hits.where("matched > 0")


@query("""
WITH m AS (SELECT o_orderkey, 'F' = o_orderstatus AS same, '{"query":"' || left(sha256('orders by price, status ' || CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'other' END), 16) || '","key":"' || o_orderkey || '","status":"' || o_orderstatus || '"}' AS held FROM orders)
SELECT o_orderkey, base64(encode(held)) AS mark, CASE WHEN same THEN o_orderkey END AS resumes_after FROM m
""")
def opaque_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark of each row's place that only the query which gave it can open."""
    place = {"key": F.col("o_orderkey"), "status": F.col("o_orderstatus")}
    mark = F.when(F.col("o_orderstatus") == "F", pages.cursor(_PLACE, **place)).otherwise(pages.cursor("orders by price, status other", **place))
    marked = table(spark, sf_dir, "orders").select("o_orderkey", mark.alias("mark"))
    return marked.withColumn("resumes_after", pages.opened(F.col("mark"), _PLACE, ["key", "status"])["key"].cast("long"))


@query("""
WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag FROM lineitem)
SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(DISTINCT l_orderkey) FROM l WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS with_lines, (SELECT count(DISTINCT l_orderkey) FROM l WHERE l_returnflag = 'R') AS with_returns,
(SELECT count(*) FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS lines_of_no_order, (SELECT count(*) FROM l WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) AS lines_of_no_part, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM l)) AS parts_unused, (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM l)) AS suppliers_unused
""")
def traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain counted in both directions: what leads on, and what leads back to nothing."""
    orders, parts, suppliers = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "supplier").select("s_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    of_orders = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("returned")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "full")
    forward = of_orders.agg(F.count("o_orderkey").alias("orders"), F.count_if(F.col("o_orderkey").isNotNull() & F.col("n").isNotNull()).alias("with_lines"), F.count_if("returned").alias("with_returns"), F.coalesce(F.sum(F.when(F.col("o_orderkey").isNull(), F.col("n"))), F.lit(0)).alias("lines_of_no_order"))

    def back(side: DataFrame, key: str, other: str) -> DataFrame:
        return lines.groupBy(other).agg(F.count("*").alias("n")).join(side, F.col(key) == F.col(other), "full")

    of_parts = back(parts, "p_partkey", "l_partkey").agg(F.coalesce(F.sum(F.when(F.col("p_partkey").isNull(), F.col("n"))), F.lit(0)).alias("lines_of_no_part"), F.count_if(F.col("p_partkey").isNotNull() & F.col("n").isNull()).alias("parts_unused"))
    of_suppliers = back(suppliers, "s_suppkey", "l_suppkey").agg(F.count_if(F.col("s_suppkey").isNotNull() & F.col("n").isNull()).alias("suppliers_unused"))
    return side_by_side([forward, of_parts, of_suppliers])


@query("""
SELECT 'documents without a label' AS step, count(*) AS pending FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'documents without a vector', count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'orders without a line', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'customers without an order', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'customers without an event', count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)
""")
def catch_up_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each step of the work has still to do."""
    steps = [
        ("documents without a label", "documents", "doc_id", "labels", "doc_id"),
        ("documents without a vector", "documents", "doc_id", "embeddings", "vec_id"),
        ("orders without a line", "orders", "o_orderkey", "lineitem", "l_orderkey"),
        ("customers without an order", "customer", "c_custkey", "orders", "o_custkey"),
        ("customers without an event", "customer", "c_custkey", "events", "user_id"),
    ]

    def pending(step: str, rows: str, key: str, done: str, other: str) -> DataFrame:
        finished = table(spark, sf_dir, done).select(F.col(other).alias(key)).distinct()
        return table(spark, sf_dir, rows).select(key).join(finished, key, "left_anti").agg(F.lit(step).alias("step"), F.count("*").alias("pending"))

    return reduce(DataFrame.unionByName, [pending(*s) for s in steps])


@query("""
SELECT year(o_orderdate) AS year, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS unsettled, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS close, count(*) FILTER (WHERE lines IS NULL) AS empty, count(*) FILTER (WHERE last > o_orderdate + INTERVAL 90 DAY) AS late, count(DISTINCT o_custkey) AS customers
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines, max(l_shipdate) AS last FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1
""")
def period_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a review, for each year."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.max("l_shipdate").alias("last"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("unsettled"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("close"), F.count_if(F.col("lines").isNull()).alias("empty"),
        F.count_if(F.col("last") > F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("late"), F.countDistinct("o_custkey").alias("customers"),
    )


@query("""
WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[' || user_id || ', 3, ' || event_id % 9 || ', 3]' WHEN 1 THEN '[]' WHEN 2 THEN '[' || user_id END AS given FROM events),
p AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN from_json(given, '["BIGINT"]') ELSE [] END AS items FROM r), u AS (SELECT event_id, items, list_sort(list_distinct(list_concat(items, [1, 2, 3]))) AS known FROM p)
SELECT event_id, len(items) AS n, array_to_string(items[1:3], ',') AS shown, array_to_string(known, ',') AS known FROM u
""")
def lists_in_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists as JSON strings, empty where there is none or it can't be read: the first three items, and the sorted union with the known ones."""
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    given = F.when(k % 4 == 0, F.concat(F.lit("["), user, F.lit(", 3, "), (k % 9).cast("string"), F.lit(", 3]"))).when(k % 4 == 1, "[]").when(k % 4 == 2, F.concat(F.lit("["), user))
    rows = table(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json(given, "array<bigint>"), F.array().cast("array<bigint>")).alias("items"))
    union = F.array_sort(F.array_union("items", F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)])))
    joined = lambda x: F.array_join(x.cast("array<string>"), ",")
    return rows.select("event_id", F.size("items").alias("n"), joined(F.slice("items", 1, 3)).alias("shown"), joined(union).alias("known"))


@query("""
WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT day, day(day) || ' ' || (['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'])[month(day)] || ' ' || year(day) AS label, n || ' ' || CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN 'zakaz' WHEN n % 10 IN (2, 3, 4) AND n % 100 NOT IN (12, 13, 14) THEN 'zakaza' ELSE 'zakazov' END AS counted FROM d
""")
def day_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and their counts in words."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return days.select("day", dates.label(F.col("day"), _MONTHS).alias("label"), F.concat_ws(" ", "n", texts.plural(F.col("n"), "zakaz", "zakaza", "zakazov")).alias("counted"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS day, l_partkey % 1200 AS valid FROM lineitem)
SELECT l_orderkey, l_linenumber, (day + to_months((valid // 365 * 12 + valid % 365 // 30)::INT) + to_days((valid % 365 % 30)::INT))::DATE AS until FROM l
""")
def repaired_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day until which a statement holds: its length in days counted in years, months and days."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", dates.after(F.to_date("l_shipdate"), F.col("l_partkey") % 1200).alias("until"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN 'worth ' || o_custkey || chr(10) || 'in two lines' END AS why, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey * 1000 + 7 END AS viewed FROM orders
""")
def labelled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block under its label, up to the next label, and a counter with blanks among its digits, as reports write them."""
    k = F.col("o_orderkey")
    why = F.when(k % 5 > 0, F.concat(F.lit("worth "), F.col("o_custkey").cast("string"), F.lit("\nin two lines  \n"))).otherwise(" \n")
    viewed = F.when(k % 3 > 0, F.concat(F.lit("Viewed: "), F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(" 007"))).otherwise(F.concat(k.cast("string"), F.lit("007"))), F.lit(" items"))).otherwise("Viewed: none")
    report = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Title: a\n  why it matters: "), why, F.lit("Source: b\n"), viewed).alias("report"))
    return report.select("o_orderkey", texts.block(F.col("report"), ["Meaning", "Why it matters"], ["Source", "Title", "Viewed"]).alias("why"), texts.counter(F.col("report"), "viewed").alias("viewed"))


@query("""
WITH r AS (SELECT event_type, event_id, CASE WHEN event_id % 3 > 0 THEN value END AS strength FROM events) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY strength DESC NULLS LAST, event_id) AS nth FROM r) WHERE nth <= 60
""")
def sixty_of_each_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixty strongest rows of each kind, those of unknown strength last."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("strength"))
    return frames.top_of_each(rows, ["event_type"], [F.desc_nulls_last("strength"), F.col("event_id")], 60, "event_id")


@query("""
SELECT doc_id, sha256('document' || chr(10) || '{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS digest FROM documents
""")
def payload_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of a row as JSON with its names in order, apart for each kind of payload."""
    names = sorted(["source", "doc_id", "n_chars", "lang"])
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.sha2(F.concat(F.lit("document\n"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"})), 256).alias("digest"))


_SAID = r"""t AS (SELECT conv_id, turn, conv_id * 100 + turn AS id, replace(replace(coalesce(text, ''), 'The ', '1,234.5% '), ' in ', ' 17 $ ') AS text FROM conversations), x AS (SELECT id, conv_id, turn, unnest(list_concat(list_transform(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])([0-9]+(?:[.,\x{A0} ][0-9]{3})*(?:[.,][0-9]+)?)', 1), lambda v: 'number ' || replace(regexp_replace(v, '[.,\x{A0} ]([0-9]{3})', '\1', 'g'), ',', '.')),
list_transform(regexp_extract_all(text, '([%‰°§±$€£¥₽])', 1), lambda v: 'symbol ' || v), list_transform(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])([A-Z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*)', 1), lambda v: 'name ' || v))) AS token FROM t), n AS (SELECT id, conv_id, turn, token, count(*) AS n FROM x GROUP BY ALL)"""


@query(f"""
WITH {_SAID}, c AS (SELECT DISTINCT a.id, b.id AS source FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn - 1), h AS (SELECT c.id, token, sum(n) AS had FROM c JOIN n ON n.id = c.source GROUP BY ALL)
SELECT n.id, split_part(n.token, ' ', 1) AS kind, split_part(n.token, ' ', 2) AS token, n.n AS wanted FROM n LEFT JOIN h ON h.id = n.id AND h.token = n.token WHERE h.had IS NULL
""")
def unsupported_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers, symbols and names of every turn that the two turns before it don't have."""
    said = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("The "), F.lit("1,234.5% ")), F.lit(" in "), F.lit(" 17 $ "))
    turns = written(table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 100 + F.col("turn")).alias("id"), said.alias("text")), "turns")
    before = turns.select("conv_id", F.col("id").alias("source"), F.explode(F.array(F.col("turn") + 1, F.col("turn") + 2)).alias("turn"))
    cited = turns.select("conv_id", "turn", "id").join(before, ["conv_id", "turn"]).select("id", "source")
    found = evidence.unsupported(turns.select("id", "text"), cited, turns.select(F.col("id").alias("source"), "text"), "id", "source", "text")
    return found.select("id", "kind", "token", "wanted")
