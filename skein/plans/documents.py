"""Queries over canonical text, chunks, sentences, dates, URL keys, histories and the graph projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import dates, texts, urls
from skein.operators import changes, graph, history, retrieval
from skein.plans.registry import query
from skein.session import table

TERMS = ["the", "der", "les"]
TERM_DAYS = {"1-URGENT": 30, "2-HIGH": 90, "3-MEDIUM": 365}
_CANONICAL = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\x00', '�', 'g'), '\r\n?', chr(10), 'g'), '" + texts.SPACES + r"', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{4,}', repeat(chr(10), 3), 'g'), ' ' || chr(10))"
)
_END = r"CASE WHEN n <= {a} + 4000 THEN n WHEN regexp_matches(substr(text, {a} + 2001, 2000), '[ \n]') THEN {a} + 2000 + length(regexp_extract(substr(text, {a} + 2001, 2000), '(?s)^.*[ \n]')) ELSE {a} + 4000 END"
_LOCALES = ", ".join(f"'{x}'" for x in urls.LOCALES)
_TRACKING = ", ".join(f"'{x}'" for x in urls.TRACKING)


@query(f"SELECT doc_id, length({_CANONICAL}) AS n_chars, sha256({_CANONICAL}) AS digest FROM documents")
def canonical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", texts.canonical(F.col("text")).alias("text"))
    return docs.select("doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


@query(rf"""
WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text <> ''),
c AS (SELECT doc_id, 0 AS ordinal, 0::BIGINT AS a, ({_END.format(a=0)})::BIGINT AS b FROM t UNION ALL SELECT doc_id, ordinal + 1, b, ({_END.format(a="b")})::BIGINT FROM c JOIN t USING (doc_id) WHERE b < n)
SELECT doc_id, ordinal, a AS char_start, b AS char_end, sha256(substr(text, a + 1, b - a)) AS text_sha256 FROM c JOIN t USING (doc_id)
""")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document; joined in order they are its text."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(texts.chunks(F.col("text"))).alias("ordinal", "c"))
    return parts.select("doc_id", "ordinal", "c.char_start", "c.char_end", F.sha2("c.text", 256).alias("text_sha256"))


@query(r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS k FROM s), c AS (SELECT *, 3 * length(s) - length(replace(lower(s), 'the', '')) - length(replace(lower(s), 'der', '')) - length(replace(lower(s), 'les', '')) AS score FROM e),
m AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS n FROM m WHERE score > 0 OR top = 0),
b AS (SELECT doc_id, string_agg(s, ' ' ORDER BY n) AS best FROM r WHERE n <= 5 GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(best, '') END AS best FROM documents LEFT JOIN b USING (doc_id)
""")
def relevant_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", texts.relevant_sentences(F.col("text"), TERMS).alias("best"))


@query(r"""
SELECT doc_id, len(string_split_regex(text, '[^0-9]+')) - 1 AS number_runs, list_transform(range(0, 16), lambda n: md5(substr(text, 1 + (n * greatest(length(text) - 120, 0)) // 16, 120))) AS signature,
length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[^А-Яа-яЁё]', '', 'g')) AS cyrillic, CASE WHEN length(text) > 120 THEN left(text, 119) || '…' ELSE text END AS label FROM documents
""")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", texts.number_runs(text).alias("number_runs"), texts.window_signature(text).alias("signature"), texts.letters(text, "A-Za-z").alias("latin"), texts.letters(text, "А-Яа-яЁё").alias("cyrillic"), texts.label(text).alias("label")
    )


@query(r"""
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-??') WHEN 4 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 6 THEN strftime(o_orderdate, '%Y-13-45') END AS raw FROM orders),
p AS (SELECT o_orderkey, raw, try_cast(CASE WHEN regexp_full_match(raw, '\d{4}-\d{2}-\d{2}') THEN raw END AS DATE) AS d, try_strptime(raw, '%B %d, %Y')::DATE AS w, CASE WHEN regexp_full_match(raw, '\d{4}-\d{2}(-\?\?)?') THEN try_cast(left(raw, 7) || '-01' AS DATE) END AS m, CASE WHEN regexp_full_match(raw, '\d{4}') THEN try_cast(raw || '-01-01' AS DATE) END AS y FROM r)
SELECT o_orderkey, coalesce(d, w, m, y) AS day, CASE WHEN coalesce(d, w) IS NOT NULL THEN 'day' WHEN m IS NOT NULL THEN 'month' WHEN y IS NOT NULL THEN 'year' ELSE 'none' END AS precision FROM p
""")
def dates_with_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in the ways of sources, read back."""
    day, way = F.col("o_orderdate"), F.col("o_orderkey") % 7
    raw = F.when(way == 0, F.date_format(day, "yyyy-MM-dd"))
    for k, form in ((1, "yyyy-MM"), (2, "yyyy"), (3, "yyyy-MM-'??'"), (4, "MMMM d, yyyy"), (6, "yyyy-'13-45'")):
        raw = raw.when(way == k, F.date_format(day, form))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", dates.published(F.col("raw")).alias("p"))
    return rows.select("o_orderkey", F.col("p.date").alias("day"), "p.precision")


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE o_orderpriority WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 90 WHEN '3-MEDIUM' THEN 365 END AS valid_until FROM orders
""")
def valid_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.valid_until(F.col("o_orderdate"), F.col("o_orderpriority"), TERM_DAYS).alias("valid_until"))


@query(rf"""
WITH u AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\.', '') AS server, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS parts,
array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ({_TRACKING}) AND lower(p) <> 'output=amp')), '&') AS q FROM pages),
l AS (SELECT *, CASE WHEN split_part(lower(parts[1]), '-', 1) IN ({_LOCALES}) THEN split_part(lower(parts[1]), '-', 1) END AS locale FROM u)
SELECT page_id, locale, 'https://' || server || regexp_replace(regexp_replace('/' || array_to_string(CASE WHEN locale IS NULL THEN parts ELSE parts[2:] END, '/'), '(?i:(^|/)amp$)|\.amp$', '\1'), '(.)/$', '\1') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url_key FROM l
""")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.locale(F.col("url")).alias("locale"), urls.url_key(F.col("url")).alias("url_key"))


@query("""
WITH b AS (SELECT event_id, user_id, event_type, lag(event_id) OVER w AS before, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 86400000000.0 AS days FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id, CASE WHEN days <= 45 THEN before END AS parent, CASE WHEN days <= 7 THEN 'repeat' WHEN days <= 45 THEN 'follow-up' ELSE 'new' END AS state FROM b
""")
def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats within 7 days and follow-ups within 45 of the same user and kind."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return history.with_parent(events, "event_id", ["user_id", "event_type"], "ts", 7, 45).select("event_id", "parent", "state")


@query("""
SELECT doc_id, list_filter([CASE WHEN length(text) >= 200 THEN NULL ELSE 'short' END, CASE WHEN lang IN ('en', 'de', 'fr') THEN NULL ELSE 'language' END, CASE WHEN quality = 1 THEN NULL ELSE 'quality' END, CASE WHEN toxic = 0 THEN NULL ELSE 'toxic' END], lambda x: x IS NOT NULL) AS failures FROM documents LEFT JOIN labels USING (doc_id)
""")
def publication_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every condition that a document fails, not only the first."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    wanted = {"short": F.length("text") >= 200, "language": F.col("lang").isin("en", "de", "fr"), "quality": F.col("quality") == 1, "toxic": F.col("toxic") == 0}
    return docs.select("doc_id", history.failures(wanted).alias("failures"))


_NODES = """
n AS (SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS label FROM region UNION SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation UNION SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer WHERE c_acctbal > 0 UNION SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier),
e AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'in' AS relation FROM nation UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'of' FROM customer UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'of' FROM supplier
UNION SELECT 'customer:' || o_custkey, 'supplier:' || l_suppkey, 'bought' FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
"""


GRAPH_KINDS = ["region", "nation", "customer", "supplier"]


def _named(edges: DataFrame) -> DataFrame:
    return edges.select(graph.named(F.col("src"), GRAPH_KINDS).alias("src"), graph.named(F.col("dst"), GRAPH_KINDS).alias("dst"), "relation")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = {name: table(spark, sf_dir, name) for name in ("region", "nation", "customer", "supplier", "orders", "lineitem")}
    ref = lambda kind, key: graph.numbered(GRAPH_KINDS.index(kind), F.col(key))
    node = lambda kind, key, name: t[kind].select(ref(kind, key).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("label"))
    edge = lambda df, src, dst, relation: df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"))
    t["customer"], people = t["customer"].where("c_acctbal > 0"), t["customer"]
    nodes = [node("region", "r_regionkey", "r_name"), node("nation", "n_nationkey", "n_name"), node("customer", "c_custkey", "c_name"), node("supplier", "s_suppkey", "s_name")]
    bought = t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey")
    edges = [
        edge(t["nation"], ref("nation", "n_nationkey"), ref("region", "n_regionkey"), "in"),
        edge(people, ref("customer", "c_custkey"), ref("nation", "c_nationkey"), "of"),
        edge(t["supplier"], ref("supplier", "s_suppkey"), ref("nation", "s_nationkey"), "of"),
        edge(bought, ref("customer", "o_custkey"), ref("supplier", "l_suppkey"), "bought"),
    ]
    return graph.nodes(nodes), graph.relations(edges)


@query(f"WITH {_NODES} SELECT src, dst, relation FROM e WHERE src <> dst AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def graph_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return _named(graph.attached(edges, nodes))


@query(f"WITH {_NODES}, d AS (SELECT relation, src IN (SELECT id FROM n) AS s, dst IN (SELECT id FROM n) AS t FROM e WHERE src <> dst) SELECT relation, CASE WHEN NOT s AND NOT t THEN 'both' WHEN NOT s THEN 'src' ELSE 'dst' END AS lost, count(*) AS n FROM d WHERE NOT s OR NOT t GROUP BY 1, 2")
def dangling_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return graph.dangling(edges, nodes).groupBy("relation", "lost").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, list_sort(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) AS numbers, CASE WHEN length(text) <= 80 THEN text ELSE rtrim(regexp_replace(left(text, 79), ' [^ ]*$', ''), ' ') || '…' END AS short FROM documents")
def numbers_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", texts.numbers(F.col("text")).alias("numbers"), texts.cut_at_word(F.col("text"), 80).alias("short"))


@query(rf"""
WITH h AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\.', '') AS host, count(*) OVER (PARTITION BY regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\.', '')) AS n FROM pages)
SELECT array_to_string((string_split(host, '.'))[-2:], '.') AS domain, count(*) AS hosts, CAST(sum(n) AS BIGINT) AS pages, min(host) AS first FROM h GROUP BY 1
""")
def source_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and pages of each registrable domain."""
    hosts = table(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return hosts.groupBy(urls.registrable_domain(F.col("host")).alias("domain")).agg(F.count("*").alias("hosts"), F.sum("n").alias("pages"), F.min("host").alias("first"))


@query(f"""
WITH {_NODES}, h AS (SELECT 'out' AS way, relation, dst AS neighbour FROM e WHERE src = 'supplier:7' AND dst IN (SELECT id FROM n) UNION ALL SELECT 'in', relation, src FROM e WHERE dst = 'supplier:7' AND src IN (SELECT id FROM n)),
r AS (SELECT *, row_number() OVER (PARTITION BY way, relation ORDER BY neighbour) AS nth, count(*) OVER (PARTITION BY way, relation) AS total FROM h) SELECT way, relation, neighbour, greatest(total - 20, 0) AS hidden FROM r WHERE nth <= 20
""")
def one_hop_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    hub = graph.numbered(GRAPH_KINDS.index("supplier"), F.lit(7))
    near = edges.where((F.col("src") == hub) | (F.col("dst") == hub))
    return graph.neighbourhood(_named(graph.attached(near, nodes)), "supplier:7", 20)


@query("""
WITH l AS (SELECT l_orderkey || ':' || l_linenumber AS k, l_orderkey AS o, l_partkey, l_suppkey, l_returnflag FROM lineitem),
a AS (SELECT k, sha256(l_partkey || '|' || l_suppkey || '|' || l_returnflag) AS h FROM l WHERE o % 10 <> 0), b AS (SELECT k, sha256(l_partkey || '|' || l_suppkey || '|' || CASE WHEN o % 7 = 0 THEN 'R' ELSE l_returnflag END) AS h FROM l WHERE o % 11 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unexpected' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.h <> b.h
""")
def release_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a release that the present state has lost, added or changed."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("k"), "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    digest = lambda flag: F.sha2(F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), flag), 256).alias("h")
    flag = F.col("l_returnflag")
    release = lines.where("l_orderkey % 10 <> 0").select("k", digest(flag))
    state = lines.where("l_orderkey % 11 <> 0").select("k", digest(F.when(F.col("l_orderkey") % 7 == 0, "R").otherwise(flag)))
    return changes.reconciled(state, release, "k", "h")


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents), r AS (SELECT doc_id, len(t) AS length, t FROM d), c AS (SELECT count(*) AS n, avg(length) AS mean FROM r),
q AS (SELECT unnest(['the', 'worthless', 'ertion']) AS term), p AS (SELECT doc_id, length, term, len(list_filter(t, lambda x: x = term)) AS tf FROM r, q), f AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM p GROUP BY term),
s AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 5) AS score FROM p JOIN f USING (term), c GROUP BY doc_id HAVING sum(tf) > 0)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS ordinal FROM s WHERE score >= 0.5 ORDER BY score DESC, doc_id LIMIT 8
""")
def evidence_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight strongest hits of a search, from a floor on."""
    hits = retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ["the", "worthless", "ertion"]).select("doc_id", F.round("score", 5).alias("score"))
    return retrieval.package(hits, "doc_id", "score", 8, 0.5)
