"""Queries of states: upserts, inserts, versions, registries, queues, retention, ladders, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import changes, merging, queue, ranges, rates
from skein.plans.registry import query
from skein.session import table

_OLD = "old AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS first_seen, o_orderdate AS last_seen FROM orders WHERE o_orderkey % 3 <> 0)"
_NEW = "feed AS (SELECT l_orderkey AS k, l_linestatus AS status, l_extendedprice AS price, l_shipdate AS first_seen, l_shipdate AS last_seen, l_linenumber AS n, l_partkey AS p FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey % 2 = 0)"


def _state_and_feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("last_seen"))
    feed = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3 and l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("first_seen"), F.col("l_shipdate").alias("last_seen"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))
    return old, feed


@query(f"""
WITH {_OLD}, {_NEW}, f AS (SELECT k, arg_max(status, (n, p, price)) AS status, arg_max(price, (n, p, price)) AS price, min(first_seen) AS a, max(last_seen) AS z FROM feed GROUP BY k)
SELECT coalesce(o.k, f.k) AS k, CASE WHEN o.k IS NULL THEN f.status ELSE o.status END AS status, CASE WHEN f.k IS NULL THEN o.price ELSE f.price END AS price, least(o.first_seen, f.a) AS first_seen, greatest(o.last_seen, f.z) AS last_seen FROM old o FULL JOIN f ON o.k = f.k
""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed merged into a state: some columns keep the old value, times widen, others take the feed's last."""
    state, feed = _state_and_feed(spark, sf_dir)
    return merging.upserted(state, feed, ["k"], ["n", "p", "price"], kept=["status"], lowest=["first_seen"], highest=["last_seen"])


@query(f"""
WITH {_OLD}, {_NEW}, f AS (SELECT k, arg_min(status, (n, p, price)) AS status, arg_min(price, (n, p, price)) AS price, arg_min(first_seen, (n, p, price)) AS first_seen FROM feed GROUP BY k)
SELECT k, status, price, first_seen, last_seen FROM old UNION ALL SELECT k, status, price, first_seen, first_seen FROM f WHERE k NOT IN (SELECT k FROM old)
""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, feed = _state_and_feed(spark, sf_dir)
    return merging.inserted(state, feed, ["k"], ["n", "p", "price"])


@query("""
WITH s AS (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey % 2 = 0), f AS (SELECT l_orderkey, l_partkey, l_quantity + 100 AS l_quantity FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber = 1)
SELECT * FROM s WHERE l_orderkey NOT IN (SELECT l_orderkey FROM f) UNION ALL SELECT * FROM f
""")
def replace_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the keys that a feed names replaced by the feed's."""
    lines = table(spark, sf_dir, "lineitem")
    state = lines.where("l_orderkey % 2 = 0").select("l_orderkey", "l_partkey", "l_quantity")
    feed = lines.where("l_orderkey % 5 = 0 and l_linenumber = 1").select("l_orderkey", "l_partkey", (F.col("l_quantity") + 100).alias("l_quantity"))
    return merging.replaced(state, feed, "l_orderkey")


@query("""
WITH log AS (SELECT user_id, ts, event_type FROM events WHERE event_id % 2 = 0), last AS (SELECT user_id, arg_max(event_type, (ts, event_type)) AS t FROM log GROUP BY 1), feed AS (SELECT user_id, ts, event_type FROM events WHERE event_id % 2 = 1 AND event_id % 3 = 0)
SELECT * FROM log UNION ALL SELECT feed.* FROM feed LEFT JOIN last USING (user_id) WHERE t IS NULL OR t <> event_type
""")
def append_if_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that takes only rows that say something else than its latest of the same key."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    log, feed = events.where("event_id % 2 = 0").drop("event_id"), events.where("event_id % 2 = 1 and event_id % 3 = 0").drop("event_id")
    return merging.appended_if_changed(log, feed, ["user_id"], "ts", ["event_type"])


@query("""
WITH stored AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE sha256(text) END AS digest FROM documents WHERE doc_id % 5 <> 0) SELECT doc_id, sha256(text) AS digest FROM documents d WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.doc_id = d.doc_id AND s.digest = sha256(d.text))
""")
def stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to be worked on again: new ones and those whose text has another digest than is stored."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    stored = rows.where("doc_id % 5 <> 0").withColumn("digest", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("digest")))
    return merging.stale(rows, stored, "doc_id", "digest")


@query("""
WITH v AS (SELECT l_orderkey AS doc, l_linenumber AS version, l_shipdate AS fetched, l_linestatus = 'F' AS complete, l_partkey AS p FROM lineitem) SELECT doc, count(*) AS versions, arg_max(version, (fetched, version, p)) FILTER (WHERE complete) AS best, max(fetched) AS latest FROM v GROUP BY doc
""")
def best_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many versions a document has, and its best: the latest of the complete ones."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("version"), F.col("l_shipdate").alias("fetched"), (F.col("l_linestatus") == "F").alias("complete"), F.col("l_partkey").alias("p"))
    best = F.max(F.when(F.col("complete"), F.struct("fetched", "version", "p"))).alias("b")
    return v.groupBy("doc").agg(F.count("*").alias("versions"), best, F.max("fetched").alias("latest")).select("doc", "versions", F.col("b.version").alias("best"), "latest")


@query("""
WITH r AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day FROM orders), u AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 49), n AS (SELECT id FROM r ORDER BY day DESC, id DESC LIMIT 10), m AS (SELECT max(day) AS today FROM r)
SELECT id, CASE WHEN id IN (SELECT id FROM u) THEN 'referred to' WHEN id IN (SELECT id FROM n) THEN 'newest' WHEN day > today - 365 THEN 'young' ELSE 'eligible' END AS state FROM r, m
""")
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be removed: nothing that is referred to, among the newest or young."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("at"))
    rows = rows.join(F.broadcast(rows.agg(F.max("at").alias("today"))))
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("id"))
    return merging.retention(rows, used, "id", "at", F.col("today"), 365, 10)


@query("""
WITH t AS (SELECT user_id, list(DISTINCT event_type) AS tried, bool_or(event_type = 'purchase' AND value > 200) AS done FROM events WHERE value >= 90 GROUP BY user_id), n AS (SELECT *, list_filter(['view', 'click', 'signup', 'purchase'], lambda r: NOT list_contains(tried, r)) AS untried FROM t)
SELECT user_id, CASE WHEN NOT done THEN untried[1] END AS next, CASE WHEN done THEN 'done' WHEN len(untried) > 0 THEN 'try' ELSE 'give up' END AS decision FROM n
""")
def acquisition_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to try next for each user, whose costly events are the tries: the first rung it hasn't tried, until one succeeds or none is left."""
    rows = table(spark, sf_dir, "events").where("value >= 90").groupBy("user_id").agg(F.collect_set("event_type").alias("tried"), F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 200)).alias("done"))
    return merging.laddered(rows, "tried", ["view", "click", "signup", "purchase"], "done").select("user_id", "next", "decision")


_LEASES = "t AS (SELECT event_id, user_id % 5 AS host, ts AS due, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'done' END AS status, ts + INTERVAL 30 MINUTE AS lease, 1 + event_id % 6 AS attempts FROM events), n AS (SELECT timestamp '2024-01-20 00:00:00' AS now)"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    status = F.when(k % 4 == 0, "queued").when(k % 4 == 1, "running").when(k % 4 == 2, "failed").otherwise("done")
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("host"), F.col("ts").alias("due"), status.alias("status"), (F.col("ts") + F.expr("interval 30 minutes")).alias("lease"), (1 + k % 6).alias("attempts"))


@query(f"""
WITH {_LEASES}, r AS (SELECT t.*, status = 'queued' OR status = 'running' AND lease < now AS free, now FROM t, n), b AS (SELECT host, count(*) FILTER (WHERE status = 'running' AND lease >= now AND due <= now) AS busy FROM r GROUP BY host),
q AS (SELECT event_id, r.host, row_number() OVER (PARTITION BY r.host ORDER BY due, event_id) AS nth, busy, due FROM r JOIN b USING (host) WHERE free AND due <= now) SELECT event_id, host, nth FROM q WHERE nth + busy <= 12 ORDER BY due, event_id LIMIT 50
""")
def claim_with_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks to take now: queued ones and those whose lease has run out, so many a host less what it is at work on."""
    return queue.claimed_with_leases(_tasks(spark, sf_dir), "event_id", "host", F.lit("2024-01-20 00:00:00").cast("timestamp"), 12, 50).select("event_id", "host", "nth")


@query(f"""
WITH {_LEASES} SELECT event_id, CASE WHEN status = 'failed' AND attempts < 5 THEN 'queued' ELSE status END AS status, CASE WHEN status = 'failed' AND attempts < 5 THEN 0 ELSE attempts END AS attempts FROM t
""")
def requeue_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.requeued(_tasks(spark, sf_dir), F.col("attempts") < 5).select("event_id", "status", "attempts")


@query("""
WITH d AS (SELECT event_id AS id, ts AS since, event_id % 3 AS times FROM events WHERE event_type = 'error'), f AS (SELECT event_id AS id, ts AS since FROM events WHERE event_type = 'error' AND event_id % 4 = 0 OR event_type = 'signup')
SELECT id, since, times + 1 AS times FROM d WHERE id NOT IN (SELECT id FROM f) UNION ALL SELECT id, since, 0 FROM f
""")
def carried_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was put off and hasn't come again is carried over once more; what has come begins anew."""
    events = table(spark, sf_dir, "events")
    deferred = events.where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("ts").alias("since"), (F.col("event_id") % 3).alias("times"))
    fresh = events.where("event_type = 'error' and event_id % 4 = 0 or event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("ts").alias("since"))
    return queue.carried_over(deferred, fresh, "id", "times")


@query("""
WITH o AS (SELECT user_id, event_type AS source FROM events WHERE ts < timestamp '2024-01-15'), n AS (SELECT user_id, event_type AS source FROM events WHERE ts >= timestamp '2024-01-15'), a AS (SELECT user_id, count(DISTINCT source) AS before FROM o GROUP BY 1), b AS (SELECT user_id, count(DISTINCT source) AS sources FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY 1)
SELECT user_id, sources, CASE WHEN before IS NULL THEN 'new' WHEN before <> sources THEN 'updated' ELSE 'same' END AS change FROM b LEFT JOIN a USING (user_id)
""")
def registry_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry after a feed: which keys are new and which have more sources, in one grouping of both."""
    old = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("source"), old.alias("old"))
    counts = rows.groupBy("user_id", "source").agg(F.bool_or("old").alias("old")).groupBy("user_id").agg(F.count("*").alias("sources"), F.count_if("old").alias("before"))
    return counts.select("user_id", "sources", F.when(F.col("before") == 0, "new").when(F.col("before") != F.col("sources"), "updated").otherwise("same").alias("change"))


@query("""
WITH e AS (SELECT event_id, user_id, ts FROM events), k AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'purchase'), s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 480)
SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = e.user_id AND k.day = e.ts::DATE) AND user_id NOT IN (SELECT user_id FROM s)
""")
def not_reported_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that were not reported in either of two forms: by key and day, or by key alone."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    by_day = events.where("event_type = 'purchase'").select("user_id", "day").distinct()
    by_key = events.where("event_type = 'error' and value > 480").select("user_id").distinct()
    return events.join(by_day, ["user_id", "day"], "left_anti").join(by_key, "user_id", "left_anti").select("event_id")


_DELTA = "b AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 0), t AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0)"


@query(f"""
WITH {_DELTA} SELECT o_orderkey, o_orderstatus, 'fits' AS run FROM t UNION ALL SELECT o_orderkey, o_orderstatus, 'other state' FROM b
""")
def fenced_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delta applied to the state that it was made for, and refused as a whole by another."""
    orders = table(spark, sf_dir, "orders")
    base = orders.where("o_orderkey % 10 <> 0")
    target = orders.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    delta = changes.delta(base, target, "o_orderkey")
    state = base.select(changes.row_hash(base.columns).alias("h")).agg(F.sum(F.xxhash64("h") % 1_000_003)).first()[0]
    runs = [merging.applied_with_fence(base, delta, target, "o_orderkey", fence).select("o_orderkey", "o_orderstatus", F.lit(name).alias("run")) for name, fence in (("fits", state), ("other state", (state or 0) + 1))]
    return runs[0].unionByName(runs[1])


@query("""
WITH e AS (SELECT event_id, user_id, epoch(date_trunc('second', ts))::BIGINT AS t FROM events), w AS (SELECT event_id, user_id, t, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n FROM e) SELECT event_id, n, n > 4 AS limited FROM w
""")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each row, how many of its key came in the time before it, and whether that is too many."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp("ts").alias("t"))
    return rates.recent(rows, "user_id", "t", 86_400).select("event_id", "n", (F.col("n") > 4).alias("limited"))


@query("""
WITH a AS (SELECT event_id, lower(trim(event_type)) AS question, coalesce(nullif(CASE WHEN user_id % 3 = 0 THEN NULL ELSE (user_id % 3)::VARCHAR END, ''), '') AS release, value > 50 AS answered, ts FROM events)
SELECT question, release, event_id AS answer, answered FROM (SELECT *, row_number() OVER (PARTITION BY question, release ORDER BY answered DESC, ts DESC, event_id DESC) AS nth FROM a) WHERE nth = 1
""")
def answer_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer that is given again for a question and release (none is a release too): answers before refusals, then the newest."""
    release = F.coalesce(F.when(F.col("user_id") % 3 != 0, (F.col("user_id") % 3).cast("string")), F.lit(""))
    rows = table(spark, sf_dir, "events").select(F.lower(F.trim("event_type")).alias("question"), release.alias("release"), (F.col("value") > 50).alias("answered"), "ts", "event_id")
    best = rows.groupBy("question", "release").agg(F.max(F.struct("answered", "ts", "event_id")).alias("b"))
    return best.select("question", "release", F.col("b.event_id").alias("answer"), F.col("b.answered").alias("answered"))


@query("""
WITH m AS (SELECT event_id AS seq, user_id AS k, CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'noop' ELSE 'set' END AS op, value FROM events), v AS (SELECT * FROM m WHERE op <> 'noop' AND NOT (op = 'set' AND value < 5))
SELECT k, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS nth FROM v) WHERE nth = 1 AND op = 'set'
""")
def mutations_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after a log of mutations: the last valid one of each key decides."""
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "noop").otherwise("set")
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), op.alias("op"), "value")
    valid = log.where("op <> 'noop' and not (op = 'set' and value < 5)")
    return valid.groupBy("k").agg(F.max(F.struct("seq", "op", "value")).alias("m")).where("m.op = 'set'").select("k", F.col("m.value").alias("value"))


@query(f"""
WITH {_DELTA} SELECT coalesce(b.o_orderkey, t.o_orderkey) AS k, CASE WHEN b.o_orderkey IS NULL THEN 'insert' WHEN t.o_orderkey IS NULL THEN 'delete' ELSE 'upsert' END AS op, CASE WHEN t.o_orderkey IS NULL THEN 3 WHEN b.o_orderkey IS NULL THEN 1 ELSE 2 END AS priority FROM b FULL JOIN t ON b.o_orderkey = t.o_orderkey WHERE b.o_orderkey IS NULL OR t.o_orderkey IS NULL OR b.o_orderstatus <> t.o_orderstatus
""")
def desired_state_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mutation for each row in which the wanted state differs, in the order in which references allow them."""
    orders = table(spark, sf_dir, "orders")
    target = orders.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    delta = changes.delta(orders.where("o_orderkey % 10 <> 0"), target, "o_orderkey")
    op = F.when(F.col("op") == "update", "upsert").otherwise(F.col("op"))
    return delta.select(F.col("o_orderkey").alias("k"), op.alias("op"), F.when(F.col("op") == "insert", 1).when(F.col("op") == "update", 2).otherwise(3).alias("priority"))


@query("""
WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts - INTERVAL (event_id % 60) DAY END AS published FROM events), m AS (SELECT max(ts) AS until FROM events) SELECT event_id, published IS NULL AS unknown FROM e, m WHERE published IS NULL OR published >= until - INTERVAL 30 DAY
""")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows are left out, rows of unknown date are kept."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_id") % 13 != 0, F.expr("ts - make_dt_interval(cast(event_id % 60 as int))")).alias("published"))
    until = F.broadcast(rows.agg(F.max("ts").alias("until")))
    return rows.join(until).where("published is null or published >= until - interval 30 days").select("event_id", F.col("published").isNull().alias("unknown"))


@query("""
WITH l AS (SELECT user_id, event_id AS seq, event_type || ':' || coalesce(floor(value)::INT, 0) AS entry FROM events) SELECT user_id, seq, sha256(string_agg(entry, '|') OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS link FROM l
""")
def audit_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of each user, in which each entry is bound to the two before it by a digest."""
    log = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.concat_ws(":", "event_type", F.coalesce(F.floor("value").cast("int"), F.lit(0)).cast("string")).alias("entry"))
    one = ranges.previous(ranges.ranged(log, ["user_id"], ["seq"]), ["user_id"], ["seq"], ["entry"], "one")
    two = ranges.previous(one, ["user_id"], ["seq"], ["one"], "two")
    return two.select("user_id", "seq", F.sha2(F.concat_ws("|", "two.one.entry", "one.entry", "entry"), 256).alias("link"))
