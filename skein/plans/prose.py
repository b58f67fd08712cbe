"""Queries of JSON-lines sources, states, quotes, spans, titles, dates and numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import pages, quotes
from skein.operators import merging, ranges
from skein.plans.registry import query
from skein.session import table
from skein.sources import jsonl
from skein.sources.files import FILE_ROWS
from skein.sources.states import State
from skein.tables import shared_folder

_ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("value", T.DoubleType())])


def _files(spark: SparkSession, sf_dir: str) -> str:
    """Events as JSON lines: ids that come again, and lines that are no rows."""
    events = table(spark, sf_dir, "events")
    row = F.to_json(F.struct((F.col("event_id") % 400).alias("id"), F.col("event_type").alias("kind"), "value"))
    broken = F.when(F.col("event_id") % 17 == 0, F.left(row, F.lit(9))).when(F.col("event_id") % 19 == 0, '{"kind": "no id"}').otherwise(row)
    path = f"{shared_folder(spark)}/skein-lines-{uuid.uuid4().hex}"
    events.select("event_id", broken.alias("value")).orderBy("event_id").select("value").write.text(path)
    return path


_LINES = "l AS (SELECT event_id, event_id % 400 AS id, event_type AS kind, value FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0)"


@query(f"WITH {_LINES} SELECT id, arg_max(kind, event_id) AS kind, arg_max(value, event_id) AS value FROM l GROUP BY id")
def jsonl_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry in JSON-lines files: the last line of an id counts, bad lines are skipped."""
    return jsonl.registry(spark, _files(spark, sf_dir), _ROW, "id")


@query(f"WITH {_LINES} SELECT kind, count(*) AS n, round(sum(value), 3) AS total, (SELECT count(*) FROM events WHERE event_id % 17 = 0 OR event_id % 19 = 0) AS bad FROM l GROUP BY kind")
def jsonl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of JSON-lines files, repeated ids included, and how many lines were skipped."""
    path = _files(spark, sf_dir)
    bad = jsonl.malformed(spark, path, _ROW, "id").agg(F.sum("bad").alias("bad"))
    return jsonl.rows(spark, path, _ROW, "id").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).join(F.broadcast(bad))


@query("""
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS k, 'late' AS status, o_totalprice + 1 AS price FROM orders WHERE o_orderkey % 3 = 0)
SELECT 'current' AS version, k, b.status IS NOT NULL AS fed, coalesce(b.price, a.price) AS price FROM a FULL JOIN b USING (k) UNION ALL SELECT 'rolled back', k, false, price FROM a
""")
def state_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state that outlives its run: written, merged with a feed into a new version, and the first version read again."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    state = State(spark, f"{shared_folder(spark)}/skein-state-{uuid.uuid4().hex}")
    first = state.replace(orders.where("k % 2 = 0"))
    feed = orders.where("k % 3 = 0").select("k", F.lit("late").alias("status"), (F.col("price") + 1).alias("price"))
    state.replace(merging.upserted(state.read(), feed, ["k"], ["price"]))
    now = state.read().select(F.lit("current").alias("version"), "k", (F.col("status") == "late").alias("fed"), "price")
    state.rolled_back(first)
    return now.unionByName(state.read().select(F.lit("rolled back").alias("version"), "k", F.lit(False).alias("fed"), "price"))


@query(r"""
WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<meta[^>]*\bproperty\s*=\s*["'']og:title["''][^>]*\bcontent\s*=\s*["'']([^"'']*)', 1) AS og, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS h1, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, html FROM pages)
SELECT page_id, coalesce(nullif(trim(og), ''), nullif(h1, ''), nullif(title, '')) AS title, CASE WHEN trim(og) <> '' THEN 'og' WHEN h1 <> '' THEN 'h1' WHEN title <> '' THEN 'title' END AS source FROM t
""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.title(F.col("html")).alias("t")).select("page_id", "t.title", "t.source")


@query("""
WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS as_of, CASE o_orderkey % 6 WHEN 0 THEN 'Today' WHEN 1 THEN 'yesterday' WHEN 2 THEN (o_orderkey % 30) || ' days ago' WHEN 3 THEN (o_orderkey % 9) || ' weeks ago' WHEN 4 THEN '1 month ago' ELSE 'soon' END AS said FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN as_of WHEN 1 THEN as_of - 1 WHEN 2 THEN as_of - (o_orderkey % 30)::INT WHEN 3 THEN as_of - 7 * (o_orderkey % 9)::INT WHEN 4 THEN (as_of - INTERVAL 1 MONTH)::DATE END AS day FROM d
""")
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    said = F.when(k % 6 == 0, "Today").when(k % 6 == 1, "yesterday").when(k % 6 == 2, F.concat(k % 30, F.lit(" days ago"))).when(k % 6 == 3, F.concat(k % 9, F.lit(" weeks ago"))).when(k % 6 == 4, "1 month ago").otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", pages.relative_date(said, F.to_date("o_orderdate")).alias("day"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS plain, l_extendedprice AS german, l_extendedprice AS english FROM lineitem
""")
def numbers_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in three styles and read again."""
    english = F.format_number("l_extendedprice", 2)
    german = F.translate(english, ",.", ".,")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", pages.number(F.format_string("%.2f", "l_extendedprice")).alias("plain"), pages.number(german).alias("german"), pages.number(english).alias("english"))


def _plain(column: str) -> str:
    """SQL for a text in plain signs and single blanks."""
    without = f"regexp_replace({column}, '[\\x{{feff}}\\x{{ad}}\\x{{200b}}-\\x{{200d}}]', '', 'g')"
    signs = "'" + "“”„«»‘’‚–—−‐‑" + "', '" + '"' * 5 + "''" * 3 + "-" * 5 + "'"
    return f"trim(regexp_replace(translate({without}, {signs}), '[\\s\\x{{a0}}\\x{{2007}}\\x{{202f}}\\x{{2009}}]+', ' ', 'g'))"


@query(rf"""
WITH d AS (SELECT doc_id, {_plain("coalesce(text, '')")} AS t, CASE doc_id % 7 WHEN 0 THEN 'no such words anywhere' WHEN 1 THEN left(text, 5) ELSE substr(text, 1 + (doc_id % 50)::INT, 60) END AS own FROM documents),
q AS (SELECT doc_id, t, {_plain("own")} AS q FROM d), p AS (SELECT *, strpos(t, q) AS place FROM q)
SELECT doc_id, CASE WHEN q IS NULL OR length(q) < 12 THEN 'too short' WHEN place = 0 THEN 'not found' WHEN strpos(substr(t, place + 1), q) > 0 THEN 'ambiguous' WHEN doc_id % 7 = 2 THEN 'outside the window' ELSE 'exact' END AS reason,
CASE WHEN length(q) >= 12 AND place > 0 AND strpos(substr(t, place + 1), q) = 0 AND doc_id % 7 <> 2 THEN q END AS words FROM p
""")
def quote_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with other marks, dashes and white space than their texts: found, ambiguous, too short, outside a window, not found; and the words at the offsets."""
    k, text = F.col("doc_id"), F.col("text")
    own = F.translate(F.regexp_replace(F.substr(text, (1 + k % 50).cast("int"), F.lit(60)), " ", "  \n"), "\"'-", "„’—")
    quote = F.when(k % 7 == 0, "no such words anywhere").when(k % 7 == 1, F.left(text, F.lit(5))).otherwise(own)
    window = (F.when(k % 7 == 2, 1_000_000_000).otherwise(0), F.lit(2_000_000_000))
    found = table(spark, sf_dir, "documents").select("doc_id", "text", quotes.aligned(text, quote, window).alias("q"))
    return found.select("doc_id", F.col("q.reason").alias("reason"), quotes.plain(F.substr("text", F.col("q.start") + 1, F.col("q.end") - F.col("q.start"))).alias("words"))


@query(r"""
SELECT key, count(*) AS claims, min(id) AS first FROM (SELECT conv_id * 100 + turn AS id, lower(trim(regexp_replace(concat_ws(' ', trim(role), trim(left(text, 40))), '[\s\x{a0}\x{2007}\x{202f}\x{2009}]+', ' ', 'g'))) AS key FROM conversations) GROUP BY key
""")
def claim_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that are the same in their plain form: how many, and the first."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), quotes.claim_key(F.col("role"), F.left("text", F.lit(40))).alias("key"))
    return turns.groupBy("key").agg(F.count("*").alias("claims"), F.min("id").alias("first"))


@query()
def widened_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each text grown to whole sentences of their paragraph (tested against a plain version)."""
    start = (F.length("text") / 3).cast("int")
    end = F.least(start + 40, F.length("text"))
    return table(spark, sf_dir, "documents").select("doc_id", quotes.widened(F.col("text"), start, end).alias("s")).select("doc_id", "s.start", "s.end", "s.reason")


@query(r"""
SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS question FROM conversations WHERE role = 'user'
""")
def question_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", pages.question_key(F.col("text")).alias("question"))


_SAID = """d AS (SELECT o_orderkey AS k, o_orderdate::DATE AS day, o_orderkey % 9 AS kind FROM orders)"""


def _said(day) -> F.Column:
    """A day as feeds and searches write it, in nine ways."""
    k = F.col("o_orderkey") % 9
    iso = F.date_format(day, "yyyy-MM-dd")
    name = lambda style: F.date_format(day, style)
    forms = [iso, F.concat(iso, F.lit("T23:30:00-02:00")), F.concat(name("yyyy-MM"), F.lit("-??")), F.concat(name("d MMM yyyy"), F.lit(" 10:20:30 +0000")), name("MMMM d, yyyy"), F.concat(name("MMM d, yyyy")), name("d MMMM yyyy"), F.concat((F.col("o_orderkey") % 12 + 1).cast("string"), F.lit(" months ago")), F.lit("some day")]
    return F.coalesce(*[F.when(k == n, form) for n, form in enumerate(forms)])


@query(f"""
WITH {_SAID} SELECT k AS o_orderkey, CASE kind WHEN 1 THEN day + 1 WHEN 2 THEN date_trunc('month', day)::DATE WHEN 7 THEN DATE '2026-01-01' - ((k % 12 + 1) * 30)::INT WHEN 8 THEN NULL ELSE day END AS day FROM d
""")
def flexible_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of all orders as feeds write them, read again."""
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.to_date(pages.flexible_time(_said(F.col("o_orderdate")), F.lit("2026-01-01"))).alias("day"))


@query(f"""
WITH {_SAID}, r AS (SELECT k, day, (k // 9) % 6 AS place, CASE kind WHEN 1 THEN day + 1 WHEN 2 THEN date_trunc('month', day)::DATE WHEN 7 THEN NULL WHEN 8 THEN NULL ELSE day END AS said, kind, CASE WHEN k % 2 = 0 THEN day - 3 END AS registered FROM d),
f AS (SELECT k, registered, CASE place WHEN 0 THEN 'article:published_time' WHEN 1 THEN 'pubdate' WHEN 2 THEN 'time' WHEN 3 THEN 'linked data' WHEN 4 THEN 'header' END AS source, CASE place WHEN 0 THEN 0.95 WHEN 1 THEN 0.82 WHEN 2 THEN 0.75 WHEN 3 THEN 0.93 WHEN 4 THEN 0.78 END AS sure, CASE WHEN place = 5 THEN NULL WHEN place = 4 AND kind = 1 THEN day WHEN place = 4 AND kind = 2 THEN NULL ELSE said END AS page FROM r)
SELECT k AS o_orderkey, coalesce(page, registered) AS date, CASE WHEN page IS NOT NULL THEN source WHEN registered IS NOT NULL THEN 'registry' ELSE 'none' END AS source, CASE WHEN page IS NOT NULL THEN sure WHEN registered IS NOT NULL THEN 0.45 ELSE 0 END::DOUBLE AS confidence, CASE WHEN page IS NOT NULL THEN 'resolved' WHEN registered IS NOT NULL THEN 'low confidence' ELSE 'unresolved' END AS status FROM f
""")
def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all orders that hold their day in one of five places or none: the date found, where, how sure, and what the registry gives else."""
    said, place = _said(F.col("o_orderdate")), F.floor(F.col("o_orderkey") / 9) % 6
    forms = [("<meta property=\"article:published_time\" content=\"", "\">"), ("<meta name='pubdate' content='", "'>"), ("<time class=x datetime=\"", "\">then</time>"), ("<script type=\"application/ld+json\">{\"dateCreated\": \"", "\"}</script>"), ("<div><h1>Title</h1><p>on ", "</p></div>")]
    held = F.coalesce(*[F.when(place == n, F.concat(F.lit(a), said, F.lit(b))) for n, (a, b) in enumerate(forms)], F.lit(""))
    registered = F.when(F.col("o_orderkey") % 2 == 0, F.date_sub(F.to_date("o_orderdate"), 3))
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("<html><body>"), held, F.lit("<p>Words.</p></body></html>")).alias("html"), registered.alias("registered"))
    return found.select("o_orderkey", "registered", pages.publication_date(F.col("html")).alias("p")).select("o_orderkey", pages.settled(F.col("p"), F.col("registered")).alias("s")).select("o_orderkey", "s.*")


@query(f"""
WITH {_SAID}, r AS (SELECT k, CASE WHEN k % 3 = 0 THEN CASE kind WHEN 1 THEN day + 1 WHEN 2 THEN date_trunc('month', day)::DATE WHEN 7 THEN day + 9 - ((k % 12 + 1) * 30)::INT WHEN 8 THEN NULL ELSE day END END AS issue, CASE WHEN k % 4 = 0 THEN day - 5 END AS material, day + 9 AS found FROM d)
SELECT k AS o_orderkey, coalesce(issue, material) AS date, CASE WHEN issue IS NOT NULL THEN 'issue' WHEN material IS NOT NULL THEN 'material' WHEN k % 3 = 0 THEN 'issue' ELSE 'none' END AS source, coalesce(issue, material, found) AS shown, CASE WHEN coalesce(issue, material) IS NULL THEN 'first seen' ELSE 'published' END AS kind FROM r
""")
def shown_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date to show: the issue's, else the material's, else the day of finding."""
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, _said(F.col("o_orderdate"))).alias("issue"), F.when(k % 4 == 0, F.date_sub(day, 5).cast("string")).alias("material"), F.date_add(day, 9).cast("timestamp").alias("found"))
    return rows.select("o_orderkey", pages.shown_date(F.col("issue"), F.col("material"), F.col("found")).alias("s")).select("o_orderkey", "s.*")


@query(r"""
WITH t AS (SELECT page_id, CASE WHEN page_id % 3 > 0 THEN url ELSE '' END AS url, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM pages), k AS (SELECT page_id, url, trim(regexp_replace(lower(left(title, 300)), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM t)
SELECT left(sha256(CASE WHEN url <> '' THEN url ELSE key || '|2026' END), 16) AS id, count(*) AS pages, min(page_id) AS first FROM k GROUP BY 1
""".replace("\\\\", "\\"))
def material_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the id of their material, from their URL or, without one, from title and date."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 > 0, F.col("url")).otherwise("").alias("url"), F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    ids = rows.select("page_id", pages.material_id(F.col("url"), F.col("title"), F.lit("2026")).alias("id"))
    return ids.groupBy("id").agg(F.count("*").alias("pages"), F.min("page_id").alias("first"))


_ORDERED = T.StructType([T.StructField("id", T.LongType()), T.StructField("day", T.StringType()), T.StructField("status", T.StringType())])


@query("""
WITH o AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END AS status FROM orders) SELECT id, status, row_number() OVER (ORDER BY day DESC, id) AS nth FROM o
""")
def registry_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry that is merged with a feed and written anew, newest first, as JSON lines beside the old one, and read in the order of its lines."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").cast("string").alias("day"), F.col("o_orderstatus").alias("status"))
    folder = f"{shared_folder(spark)}/skein-registry-{uuid.uuid4().hex}"
    jsonl.write(orders, f"{folder}/v1", [F.desc("day"), F.col("id")])
    feed = orders.where("id % 5 = 0").withColumn("status", F.lit("F"))
    old = jsonl.registry(spark, f"{folder}/v1", _ORDERED, "id")
    jsonl.write(merging.upserted(old, feed, ["id"], ["day"]), f"{folder}/v2", [F.desc("day"), F.col("id")])
    placed = jsonl.lines(spark, f"{folder}/v2").select("file", "place", F.from_json("line", _ORDERED).alias("r"), F.lit(1).alias("one"), F.lit("all").alias("key"))
    counted = ranges.running(ranges.ranged(placed, ["key"], ["file", "place"]), ["key"], ["file", "place"], "one", "nth")
    return counted.select("r.id", "r.status", "nth")


@query("""
SELECT o_orderkey AS id, sha256('{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS line_sha256, 1 AS digests FROM orders
""")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a manifest in JSON lines with the digest of each line, a file for each million of rows; a file has one digest, whatever the order of its lines."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    folder = f"{shared_folder(spark)}/skein-manifest-{uuid.uuid4().hex}"
    dealt = orders.repartition(-(-orders.count() // FILE_ROWS) or 1, "id")  # the same lines in the files of both, in other orders
    dealt.write.json(f"{folder}/a")
    dealt.sortWithinPartitions(F.desc("id")).write.json(f"{folder}/b")
    schema = T.StructType(_ORDERED.fields[:1] + _ORDERED.fields[2:])
    both = jsonl.manifest(spark, f"{folder}/*", schema, "id")
    return both.groupBy("id", "line_sha256").agg(F.count_distinct("file_digest").cast("int").alias("digests"))
