"""Queries of joins: anti, as-of, interval, lateral, blocked pairs, comparison of two stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import rules, texts, urls
from skein.operators import clustering, joining, retrieval
from skein.plans.registry import query
from skein.session import table
from skein.tables import broadcast_below, looked_up, written


@query("""
SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)
""")
def double_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    owing = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(returned, "o_orderkey", "left_anti").join(owing, "o_custkey", "left_anti").select("o_orderkey")


@query("""
WITH b AS (SELECT user_id, ts, value AS price FROM events WHERE event_type = 'purchase'), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')
SELECT event_id, price, date_diff('second', date_trunc('second', bought), date_trunc('second', ts)) AS seconds FROM (SELECT e.event_id, b.price, b.ts AS bought, e.ts FROM e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts >= b.ts)
""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the last purchase of its user before it."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("price"), F.col("ts").alias("bought"))
    found = joining.as_of(events.where("event_type = 'error'").select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", ["price", "bought"])
    return found.select("event_id", "price", (F.unix_timestamp("ts") - F.unix_timestamp("bought")).alias("seconds"))


@query("""
WITH s AS (SELECT event_id AS session, epoch(date_trunc('second', ts))::BIGINT AS a, epoch(date_trunc('second', ts))::BIGINT + 600 + event_id % 7 * 300 AS z FROM events WHERE event_type = 'signup'), p AS (SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS t FROM events WHERE event_type = 'click')
SELECT session, count(*) AS clicks, min(event_id) AS first FROM s JOIN p ON t >= a AND t < z GROUP BY session
""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks within the interval that each signup opens; time buckets make it an equi-join."""
    events = table(spark, sf_dir, "events").withColumn("t", F.unix_timestamp("ts"))
    opened = events.where("event_type = 'signup'").select(F.col("event_id").alias("session"), F.col("t").alias("a"), (F.col("t") + 600 + F.col("event_id") % 7 * 300).alias("z"))
    found = joining.within_intervals(events.where("event_type = 'click'").select("event_id", "t"), opened, "t", "a", "z", 1800)
    return found.groupBy("session").agg(F.count("*").alias("clicks"), F.min("event_id").alias("first"))


@query("""
SELECT o_orderkey, l_linenumber AS attempt, l_quantity FROM orders, LATERAL (SELECT l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F' AND l_quantity > 10 ORDER BY l_shipdate, l_linenumber LIMIT 1) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
""")
def earliest_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest attempt that succeeded, of rows that have none on record: a minimum of structs, merged before the shuffle.

    Of attempts of one day and number, which the order leaves open, the smallest quantity counts.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    barred = orders.where("o_orderstatus = 'P'").select("o_orderkey")
    # as NOT IN has it: a key with a row on record is out with all its rows, and an unknown key on record leaves nothing
    open_rows = orders.select("o_orderkey").join(barred, "o_orderkey", "left_anti")
    open_rows = open_rows.join(F.broadcast(barred.where("o_orderkey is null").limit(1).select(F.lit(True).alias("unknown"))), how="left").where("unknown is null").select("o_orderkey")
    good = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F' and l_quantity > 10")
    order = F.struct(F.isnull("l_shipdate").alias("undated"), "l_shipdate", F.isnull("l_linenumber").alias("unnumbered"), "l_linenumber", "l_quantity")
    first = good.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(order).alias("f"))
    return open_rows.join(first, "o_orderkey").select("o_orderkey", F.col("f.l_linenumber").alias("attempt"), F.col("f.l_quantity").alias("l_quantity"))


@query("""
WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT q.vec_id AS query, v.vec_id AS hit, list_cosine_similarity(q.e, v.embedding::DOUBLE[]) AS c FROM q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id)
SELECT query, hit, round(c, 5) AS cosine, nth FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, hit) AS nth FROM p) WHERE nth <= 5
""")
def nearest_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of the same label for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    found = retrieval.nearest_to_queries(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 5, group="label")
    return found.select("query", "hit", F.round("cosine", 5).alias("cosine"), "nth")


@query("""
WITH t AS (SELECT p_partkey, p_brand, p_type FROM part), q AS (SELECT * FROM (VALUES ('Brand#13', 'ECONOMY'), ('Brand#5', 'ECONOMY'), ('Brand#5', 'STANDARD')) v(root, child))
SELECT DISTINCT p_partkey, root FROM t JOIN q ON p_brand IN (root, child) OR p_type IN (root, child)
""")
def or_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on either of two columns against either of two keys, as one equi-join over the keys each row has."""
    wanted = spark.createDataFrame([("Brand#13", "ECONOMY"), ("Brand#5", "ECONOMY"), ("Brand#5", "STANDARD")], "root string, child string")
    keyed = wanted.select("root", F.explode(F.array("root", "child")).alias("key")).distinct()
    parts = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array("p_brand", "p_type")).alias("key"))
    return parts.join(F.broadcast(keyed), "key").select("p_partkey", "root").distinct()


@query("""
WITH l AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 48) SELECT a, b, c_name, s_name, c_nationkey = s_nationkey AS same_nation FROM l JOIN customer ON c_custkey = a JOIN supplier ON s_suppkey = b
""")
def both_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the rows at both of their ends."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("b"))
    links = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("a")).join(lines, "o_orderkey").select("a", "b").distinct()
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), "c_name", "c_nationkey")
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b"), "s_name", "s_nationkey")
    return links.join(left, "a").join(right, "b").select("a", "b", "c_name", "s_name", (F.col("c_nationkey") == F.col("s_nationkey")).alias("same_nation"))


@query(r"""
WITH h AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages), d AS (SELECT DISTINCT split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages WHERE page_id % 5 = 0), r AS (SELECT host, 'known' AS rule FROM d)
SELECT page_id, host, coalesce(rule, 'default') AS rule FROM h LEFT JOIN r USING (host)
""")
def rule_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the rule of its host, derived on both sides, or the default."""
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    known = pages.where("page_id % 5 = 0").select("host").distinct().withColumn("rule", F.lit("known"))
    return pages.join(broadcast_below(known, 500_000), "host", "left").select("page_id", "host", F.coalesce("rule", F.lit("default")).alias("rule"))


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 5))"


@query(f"""
WITH w AS (SELECT conv_id * 100 + turn AS item_id, unnest({_WORDS}) AS word FROM conversations), f AS (SELECT word FROM w GROUP BY word HAVING count(*) BETWEEN 2 AND 400), k AS (SELECT * FROM w JOIN f USING (word))
SELECT x.item_id AS a, y.item_id AS b, count(*) AS shared FROM k x JOIN k y ON x.word = y.word AND x.item_id < y.item_id GROUP BY ALL HAVING count(*) >= 2
""")
def inverted_index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of turns that share two words or more, through an index of words that no more than 400 turns have."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1), lambda w: F.length(w) > 5)
    return joining.sharing(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), words.alias("words")), "item_id", "words", 2, 400)


@query("""
WITH RECURSIVE f AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE text <> '' GROUP BY text), w AS (SELECT DISTINCT doc_id, unnest(list_transform(range(0, 16), lambda n: md5(substr(text, 1 + (n * greatest(length(text) - 120, 0)) // 16, 120)))) AS h FROM f),
p AS (SELECT x.doc_id, x.h AS h1, y.h AS h2 FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.h < y.h), g AS (SELECT h1, h2, min(doc_id) AS a FROM p GROUP BY h1, h2 HAVING count(*) > 1), l AS (SELECT DISTINCT a, doc_id AS b FROM p JOIN g USING (h1, h2) WHERE a <> doc_id),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), c(node, root) AS (SELECT a, a FROM u UNION SELECT u.b, c.root FROM c JOIN u ON u.a = c.node), r AS (SELECT node, min(root) AS root FROM c GROUP BY node),
m AS (SELECT doc_id, count(*) AS shared FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.root, f.doc_id) AS class_id, coalesce(m.shared, 0) AS shared FROM documents d JOIN f ON f.text = d.text LEFT JOIN r ON r.node = f.doc_id LEFT JOIN m ON m.doc_id = f.doc_id
""")
def window_signature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in classes of texts linked by two or more equal digests of windows spread over them, and how many of a text's windows another text has. No window is too frequent to count."""
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text")
    first = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min(F.struct("doc_id", "text")).alias("d")).select("d.*")
    signed = written(first.select("doc_id", F.array_distinct(texts.window_signature(F.col("text"))).alias("s")), "signatures")
    classes = clustering.near_copy_classes(docs, "doc_id", "text", joining.sharing_two(signed, "doc_id", "s")).select("doc_id", "class_id")
    flat = signed.select(F.col("doc_id").alias("first"), F.explode("s").alias("h"))
    counts = written(flat.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "signature-counts")
    shared = looked_up(flat, counts, "h", "n", flat.count()).groupBy("first").agg(F.count("*").alias("shared"))
    digests = written(docs.select("doc_id", F.sha2("text", 256).alias("digest")), "digests")
    own = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).join(shared, "first", "left")
    own = written(own.select("digest", "rows", F.coalesce("shared", F.lit(0)).alias("shared")), "shared")
    return classes.join(looked_up(digests, own, "digest", "rows", digests.count()).select("doc_id", "shared"), "doc_id")


_SIDES = """a AS (SELECT o_orderkey AS k, o_orderstatus AS status, round(o_totalprice) AS price, o_orderpriority AS priority FROM orders WHERE o_orderkey % 8 <> 0),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS status, round(o_totalprice + CASE WHEN o_orderkey % 10 = 0 THEN 5 ELSE 0 END) AS price, o_orderpriority AS priority FROM orders WHERE o_orderkey % 9 <> 0)"""


def _two_branches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    a = orders.where("o_orderkey % 8 <> 0").select(k.alias("k"), F.col("o_orderstatus").alias("status"), F.round("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    b = orders.where("o_orderkey % 9 <> 0").select(k.alias("k"), F.when(k % 6 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.round(F.col("o_totalprice") + F.when(k % 10 == 0, 5).otherwise(0)).alias("price"), F.col("o_orderpriority").alias("priority"))
    return a, b


@query(f"""
WITH {_SIDES} SELECT k, array_to_string(list_filter([CASE WHEN a.priority IS DISTINCT FROM b.priority THEN 'priority' END, CASE WHEN a.price IS DISTINCT FROM b.price THEN 'price' END, CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END], lambda x: x IS NOT NULL), ',') AS fields,
CASE WHEN b.k IS NULL THEN 'only ours' WHEN a.k IS NULL THEN 'only theirs' WHEN a.price IS DISTINCT FROM b.price THEN 'conflict' WHEN a.status IS DISTINCT FROM b.status THEN 'drift' ELSE 'same' END AS verdict FROM a FULL JOIN b USING (k)
""")
def branch_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two branches of the same rows: fields that differ, and the first verdict that applies."""
    a, b = _two_branches(spark, sf_dir)
    pack = lambda df, name: df.select("k", F.struct("priority", "price", "status").alias(name))
    both = pack(a, "a").join(pack(b, "b"), "k", "full").withColumn("fields", joining.differing(["priority", "price", "status"]))
    has = lambda f: F.array_contains("fields", f)
    verdict = rules.first_of([("only ours", F.col("b").isNull()), ("only theirs", F.col("a").isNull()), ("conflict", has("price")), ("drift", has("status"))], "same")
    return both.select("k", F.array_join("fields", ",").alias("fields"), verdict.alias("verdict"))


@query(f"""
WITH {_SIDES}, l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber = 4), u AS (SELECT coalesce(a.k, b.k, l.k) AS k, a.k IS NOT NULL AS x, b.k IS NOT NULL AS y, l.k IS NOT NULL AS z FROM a FULL JOIN b ON a.k = b.k FULL JOIN l ON l.k = coalesce(a.k, b.k))
SELECT concat_ws('+', CASE WHEN x THEN 'files' END, CASE WHEN y THEN 'store' END, CASE WHEN z THEN 'members' END) AS layers, count(*) AS n, min(k) AS first FROM u GROUP BY 1
""")
def layers_of_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which of three stores each row is, and how many rows each combination has: one grouping of the union instead of joins."""
    a, b = _two_branches(spark, sf_dir)
    members = table(spark, sf_dir, "lineitem").where("l_linenumber = 4").select(F.col("l_orderkey").alias("k")).distinct()
    parts = [df.select("k", F.lit(1 << n).alias("bit")) for n, df in enumerate((a, b, members))]
    seen = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("k").agg(F.bit_or("bit").alias("bits"))
    layers = F.concat_ws("+", *[F.when(F.col("bits").bitwiseAND(1 << n) > 0, name) for n, name in enumerate(("files", "store", "members"))])
    return seen.groupBy(layers.alias("layers")).agg(F.count("*").alias("n"), F.min("k").alias("first"))


@query(f"""
WITH {_SIDES} SELECT k, CASE WHEN k % 9 = 0 AND status = 'P' THEN 'pending' WHEN price > 300000 THEN 'too large' WHEN priority = '5-LOW' THEN 'low priority' ELSE 'unexplained' END AS reason FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = a.k)
""")
def missing_rows_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_branches(spark, sf_dir)
    lost = a.join(b.select("k"), "k", "left_anti")
    return lost.select("k", rules.first_of([("pending", (F.col("k") % 9 == 0) & (F.col("status") == "P")), ("too large", F.col("price") > 300000), ("low priority", F.col("priority") == "5-LOW")], "unexplained").alias("reason"))


@query("""
WITH c AS (SELECT 'n_' || left(sha256('nation:' || n_name), 16) AS id, n_name FROM nation) SELECT c_custkey, id, c.n_name FROM customer JOIN nation n ON n.n_nationkey = c_nationkey JOIN c ON c.id = 'n_' || left(sha256('nation:' || n.n_name), 16)
""")
def lookup_by_hashed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows found again by an id that both sides derive from the same key."""
    derived = lambda c: F.concat(F.lit("n_"), F.left(F.sha2(F.concat(F.lit("nation:"), c), 256), F.lit(16)))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    catalogue = nations.select(derived(F.col("n_name")).alias("id"), "n_name")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nations.select(F.col("n_nationkey").alias("c_nationkey"), derived(F.col("n_name")).alias("id"))), "c_nationkey")
    return rows.join(F.broadcast(catalogue), "id").select("c_custkey", "id", "n_name")


@query("""
WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events WHERE event_type = 'purchase'), r AS (SELECT DISTINCT ts::DATE AS day FROM events WHERE event_type = 'error' AND user_id = 3), b AS (SELECT max(ts)::DATE - 13 AS since FROM events)
SELECT min(day) AS day FROM d, b WHERE day >= since AND day NOT IN (SELECT day FROM r)
""")
def catch_up_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest day of the last fourteen that has an export and no report."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "user_id")
    since = days.agg(F.date_sub(F.max("day"), 13).alias("since"))
    reported = days.where("event_type = 'error' and user_id = 3").select("day").distinct()
    exported = days.where("event_type = 'purchase'").select("day").distinct()
    return exported.join(reported, "day", "left_anti").join(F.broadcast(since)).where("day >= since").agg(F.min("day").alias("day"))


@query("""
WITH RECURSIVE n AS (SELECT p_partkey AS k, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS up FROM part), t AS (SELECT k AS node, k AS ancestor, 0 AS depth FROM n UNION ALL SELECT node, up, depth + 1 FROM t JOIN n ON n.k = ancestor WHERE up IS NOT NULL)
SELECT node, max(depth) AS depth, string_agg(ancestor, '/' ORDER BY depth DESC) AS path, max(ancestor) FILTER (WHERE depth = (SELECT max(depth) FROM t t2 WHERE t2.node = t.node) - 1) AS branch FROM t GROUP BY node
""")
def tree_of_any_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's depth, path from the root and branch below it; levels are followed until there is none."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 3)).alias("up"))
    found = joining.ancestors(parts, "k", "up").where("depth is not null")
    paths = found.groupBy("node").agg(F.max("depth").alias("depth"), F.sort_array(F.collect_list(F.struct("depth", "ancestor")), False).alias("p"))
    return paths.select("node", "depth", F.array_join(F.transform("p", lambda x: x["ancestor"].cast("string")), "/").alias("path"), F.when(F.size("p") > 1, F.col("p")[1]["ancestor"]).alias("branch"))


@query("""
WITH RECURSIVE n AS (SELECT p_partkey AS k, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS up, p_retailprice AS price FROM part), t AS (SELECT k AS node, k AS ancestor FROM n UNION ALL SELECT node, up FROM t JOIN n ON n.k = ancestor WHERE up IS NOT NULL)
SELECT ancestor AS topic, count(*) AS members, round(sum(price), 2) AS total FROM t JOIN n ON n.k = node GROUP BY ancestor HAVING count(*) > 1
""")
def subtree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums over whole subtrees, from the map of nodes to ancestors."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 3)).alias("up"), "p_retailprice")
    found = joining.ancestors(parts, "k", "up").where("depth is not null").join(parts.select(F.col("k").alias("node"), "p_retailprice"), "node")
    return found.groupBy(F.col("ancestor").alias("topic")).agg(F.count("*").alias("members"), F.round(F.sum("p_retailprice"), 2).alias("total")).where("members > 1")


@query("""
WITH RECURSIVE n AS (SELECT p_partkey AS k, CASE p_partkey % 50 WHEN 1 THEN p_partkey + 1 WHEN 2 THEN p_partkey + 2 WHEN 4 THEN p_partkey - 3 ELSE p_partkey // 3 END AS up FROM part), c(node, ancestor) AS (SELECT k, up FROM n UNION SELECT node, up FROM c JOIN n ON n.k = c.ancestor), y AS (SELECT node FROM c WHERE node = ancestor)
SELECT k AS node, bool_or(y.node IS NOT NULL) AS endless, CASE WHEN NOT bool_or(y.node IS NOT NULL) THEN count(c.ancestor) END AS depth FROM n LEFT JOIN c ON c.node = k AND c.ancestor IS NOT NULL LEFT JOIN y ON y.node = c.ancestor GROUP BY k
""")
def parent_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's depth, and the nodes whose parents lead into a cycle, which have none."""
    k = F.col("p_partkey")
    up = F.when(k % 50 == 1, k + 1).when(k % 50 == 2, k + 2).when(k % 50 == 4, k - 3).otherwise(F.floor(k / 3))
    found = joining.ancestors(table(spark, sf_dir, "part").select(k.alias("k"), up.alias("up")), "k", "up")
    return found.groupBy("node").agg(F.max("depth").cast("long").alias("depth")).select("node", F.col("depth").isNull().alias("endless"), "depth")


@query("""
WITH s AS (SELECT max(o_orderdate) AS moment FROM orders WHERE o_orderstatus = 'F'), m AS (SELECT o_orderkey, o_custkey FROM orders, s WHERE o_orderdate >= moment - INTERVAL 90 DAY), b AS (SELECT l_orderkey, max(l_shipdate) AS latest, arg_max(l_linenumber, (l_shipdate, l_linenumber)) AS best FROM lineitem GROUP BY 1)
SELECT m.o_orderkey, best, latest::DATE AS latest, c_mktsegment FROM m JOIN b ON l_orderkey = m.o_orderkey JOIN customer ON c_custkey = o_custkey
""")
def slice_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain: the latest source, its members, the best version of each, and where they come from."""
    orders = table(spark, sf_dir, "orders")
    latest = orders.where("o_orderstatus = 'F'").agg(F.max("o_orderdate").alias("at"))
    members = orders.join(F.broadcast(latest)).where("o_orderdate >= at - interval 90 days").select("o_orderkey", "o_custkey")
    best = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.struct("l_shipdate", "l_linenumber")).alias("b"))
    rows = members.join(best, "o_orderkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return rows.select("o_orderkey", F.col("b.l_linenumber").alias("best"), F.to_date("b.l_shipdate").alias("latest"), "c_mktsegment")


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\.', '') || regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS k FROM pages WHERE url IS NOT NULL), g AS (SELECT k, list_sort(list(page_id)) AS ids FROM p GROUP BY k)
SELECT unnest(ids) AS page_id, ids[1] AS first, len(ids) AS copies FROM g
""")
def copies_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the first of its address and how many there are: an address with many rows is not listed in one, nor met in one task."""
    server = F.regexp_replace(F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1)), r"^www\.", "")
    keyed = written(table(spark, sf_dir, "pages").where("url is not null").select("page_id", F.concat(server, urls.path(F.col("url"))).alias("k")), "addresses")
    groups = written(keyed.groupBy("k").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"), F.count("*").alias("rows")), "first-of-address")
    return looked_up(keyed, groups, "k", "rows", keyed.count()).select("page_id", "first", "copies")
