"""Queries of reports: counts, shares, nested counts, percentiles, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import reports
from skein.plans.registry import query
from skein.session import table
from skein.tables import broadcast_below


@query("""
WITH e AS (SELECT ts::DATE AS day, event_type, value, (props::JSON ->> '$.k')::INT AS k FROM events), s AS (SELECT day, count(*) FILTER (WHERE event_type <> 'error') AS included, count(*) FILTER (WHERE event_type IN ('error', 'view')) AS viewed, count(*) FILTER (WHERE k < 50 AND event_type <> 'error') AS near, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS bought FROM e GROUP BY day)
SELECT day, included, greatest(viewed, included) AS viewed, near, greatest(viewed, included) - included AS cut, bought FROM s
""")
def daily_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of each day folded in one pass; what was viewed is never less than what was included."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    kind = F.col("event_type")
    daily = e.groupBy("day").agg(F.count_if(kind != "error").alias("included"), F.count_if(kind.isin("error", "view")).alias("seen"), F.count_if((F.col("k") < 50) & (kind != "error")).alias("near"), F.round(F.sum(F.when(kind == "purchase", F.col("value")).otherwise(0.0)), 4).alias("bought"))
    viewed = F.greatest("seen", "included")
    return daily.select("day", "included", viewed.alias("viewed"), "near", (viewed - F.col("included")).alias("cut"), "bought")


@query("""
WITH c AS (SELECT o_orderdate::DATE AS day, count(*) AS computed FROM orders GROUP BY 1), s AS (SELECT l_shipdate::DATE AS day, count(*) AS stored FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT day, coalesce(stored, computed) AS n, stored IS NULL AS is_computed FROM c LEFT JOIN s USING (day)
""")
def stored_or_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored figure where there is one, else the computed one."""
    computed = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("computed"))
    stored = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("stored"))
    return computed.join(stored, "day", "left").select("day", F.coalesce("stored", "computed").alias("n"), F.col("stored").isNull().alias("is_computed"))


@query("""
SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', '') AS host, count(*) AS pages, sum(length(html)) AS size FROM pages GROUP BY 1 ORDER BY pages DESC, host LIMIT 20
""")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty hosts with the most pages, equals by name."""
    from skein.functions import urls

    counts = table(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("size"))
    return counts.orderBy(F.desc("pages"), "host").limit(20)


@query("""
SELECT lang, count(*) AS n, count(quality) AS judged, round(avg(CASE WHEN quality = 1 THEN n_chars END), 4) AS good_chars, round(count(*) FILTER (WHERE quality = 1) * 1.0 / nullif(count(quality), 0), 6) AS share, min(doc_id) AS first, max(doc_id) AS last FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
""")
def conditional_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, an average over some rows only, and a share that is null where nothing was judged."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    good = F.col("quality") == 1
    return rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.count("quality").alias("judged"), F.round(F.avg(F.when(good, F.col("n_chars"))), 4).alias("good_chars"), F.round(F.count_if(good) / F.nullif(F.count("quality"), F.lit(0)), 6).alias("share"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
    )


@query("""
WITH c AS (SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT o_orderstatus, o_orderpriority, string_agg(y || ':' || n, ',' ORDER BY y) AS years, sum(n) AS n FROM c GROUP BY ALL)
SELECT o_orderstatus AS status, string_agg(o_orderpriority || '={' || years || '}', ';' ORDER BY o_orderpriority) AS nested, sum(n) AS n FROM m GROUP BY o_orderstatus
""")
def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by three keys as maps within maps; each level is grouped from the level below, so one scan gives all."""
    nested = reports.nested_counts(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y")), ["o_orderstatus", "o_orderpriority", "y"])
    shown = F.array_join(F.transform(F.array_sort(F.map_keys("counts")), lambda k: F.concat(k, F.lit("={"), F.array_join(F.transform(F.array_sort(F.map_keys(F.col("counts")[k])), lambda y: F.concat(y, F.lit(":"), F.col("counts")[k][y])), ","), F.lit("}"))), ";")
    return nested.select(F.col("o_orderstatus").alias("status"), shown.alias("nested"), "n")


@query("""
SELECT o_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def subjects_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted values that belong to each row, also for rows with none."""
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"), F.count("*").alias("lines"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(found, "o_orderkey", "left").select("o_orderkey", F.array_join("f", ",").alias("flags"), F.coalesce("lines", F.lit(0)).alias("lines"))


@query("""
SELECT word, count(*) AS docs, count(*) FILTER (WHERE lang = 'en') AS english FROM (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS word FROM documents) GROUP BY word ORDER BY docs DESC, word LIMIT 30
""")
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty words that most documents have; each document is reduced to its own distinct words before they meet."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{8,})"), 1)))
    rows = table(spark, sf_dir, "documents").select("lang", words.alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("docs"), F.count_if(F.col("lang") == "en").alias("english")).orderBy(F.desc("docs"), "word").limit(30)


@query("""
WITH d AS (SELECT doc_id, sha256(text) AS h, nullif(source, 'src0') AS family, lang FROM documents), c AS (SELECT h, min(doc_id) AS cluster FROM d GROUP BY h HAVING count(*) > 1), k AS (SELECT lang, family, CASE WHEN c.cluster IS NOT NULL THEN 'c' || c.cluster WHEN family IS NOT NULL THEN 'f' || family END AS voice FROM d LEFT JOIN c USING (h))
SELECT lang, count(*) AS docs, count(*) FILTER (WHERE voice IS NULL) AS unknown, count(DISTINCT voice) AS independent, count(DISTINCT voice) >= 2 AS enough FROM k GROUP BY lang
""")
def independent_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that speak for themselves: copies are one voice, else a family is, and unknown families never count."""
    docs = table(spark, sf_dir, "documents").select("lang", F.nullif("source", F.lit("src0")).alias("family"), "doc_id", F.sha2("text", 256).alias("h"))
    clusters = docs.groupBy("h").agg(F.min("doc_id").alias("cluster"), F.count("*").alias("many")).where("many > 1").drop("many")
    rows = docs.join(broadcast_below(clusters, 500_000), "h", "left")
    voice = F.coalesce(F.concat(F.lit("c"), "cluster"), F.concat(F.lit("f"), "family"))
    report = rows.withColumn("voice", voice).groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(F.col("voice").isNull()).alias("unknown"), F.countDistinct("voice").alias("independent"))
    return report.withColumn("enough", F.col("independent") >= 2)


@query("""
SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS done, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM lineitem) AS lines, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS parts,
(SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT lang) FROM documents) AS languages, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM labels WHERE toxic = 1) AS toxic, (SELECT count(*) FROM conversations WHERE role = 'user') AS asked
""")
def counts_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten counts as one row; each is one row before they are put side by side."""
    t = lambda name: table(spark, sf_dir, name)
    parts = [
        t("orders").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("done")),
        t("customer").agg(F.count("*").alias("customers")),
        t("lineitem").agg(F.count("*").alias("lines"), F.countDistinct("l_partkey").alias("parts")),
        t("documents").agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("languages")),
        t("pages").agg(F.count("*").alias("pages")),
        t("labels").agg(F.count_if(F.col("toxic") == 1).alias("toxic")),
        t("conversations").agg(F.count_if(F.col("role") == "user").alias("asked")),
    ]
    return reports.side_by_side(parts)


@query("""
SELECT coalesce(CASE WHEN quality = 0 THEN 'poor' WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN NULL END, 'unknown') AS reason, lang, count(*) AS n, sum(n_chars) AS chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL
""")
def gaps_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    reason = F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic")
    return rows.groupBy(F.coalesce(reason, F.lit("unknown")).alias("reason"), "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""
WITH g AS (SELECT doc_id, lang AS stored, CASE WHEN regexp_matches(text, '[ñáíó]') THEN 'es' WHEN regexp_matches(text, '[äöüß]') THEN 'de' WHEN regexp_matches(text, '[éèêçà]') THEN 'fr' WHEN regexp_matches(text, '[a-z]') THEN 'en' ELSE 'und' END AS detected FROM documents)
SELECT stored, detected, count(*) AS n, array_to_string((list_sort(list(doc_id)))[1:3], ',') AS examples FROM g WHERE stored <> detected GROUP BY ALL
""")
def language_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the stored language and the one the letters tell differ: counts and the first three examples of each pair."""
    from skein.functions import languages

    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("stored"), languages.by_marks(F.col("text")).alias("detected")).where("stored <> detected")
    return reports.with_examples(rows, ["stored", "detected"], "doc_id", 3).select("stored", "detected", "n", F.array_join("examples", ",").alias("examples"))


@query("""
WITH e AS (SELECT user_id, event_type, ts FROM events), s AS (SELECT user_id, max(ts) AS ok FROM e WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, max(ts) AS last, max(s.ok) AS last_ok, count(*) FILTER (WHERE event_type = 'error' AND (s.ok IS NULL OR ts > s.ok)) AS failures_since FROM e LEFT JOIN s USING (user_id) GROUP BY user_id
""")
def freshness_per_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each step: its last pass, its last success and the failures since. The last successes, a row a step, are joined to the rows, which one aggregate then counts."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    ok = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last_ok"))
    rows = e.join(ok, "user_id", "left")
    since = (F.col("event_type") == "error") & (F.col("last_ok").isNull() | (F.col("ts") > F.col("last_ok")))
    return rows.groupBy("user_id").agg(F.max("ts").alias("last"), F.max("last_ok").alias("last_ok"), F.count_if(since).alias("failures_since"))


@query("""
WITH c AS (SELECT sha256(text) AS digest, doc_id, n_chars, source FROM documents), g AS (SELECT digest, count(*) AS members, max(n_chars) AS chars, array_to_string((list_sort(list(doc_id)))[1:5], ',') AS first_members, count(DISTINCT source) AS sources FROM c GROUP BY digest HAVING count(*) > 1)
SELECT * FROM g ORDER BY members DESC, digest LIMIT 25
""")
def duplicate_cluster_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of duplicate clusters with their first five members; a cluster's members are counted before anything is joined to them."""
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id", "n_chars", "source")
    groups = reports.with_examples(rows, ["digest"], "doc_id", 5, F.max("n_chars").alias("chars"), F.countDistinct("source").alias("sources")).where("n > 1")
    page = groups.orderBy(F.desc("n"), "digest").limit(25)
    return page.select("digest", F.col("n").alias("members"), "chars", F.array_join("examples", ",").alias("first_members"), "sources")


@query("""
WITH v AS (SELECT lang, list_sort(list(n_chars)) AS v FROM documents GROUP BY lang) SELECT lang, v[1 + len(v) // 2] AS p50, v[1 + least(len(v) - 1, (len(v) * 9) // 10)] AS p90, v[1 + least(len(v) - 1, (len(v) * 99) // 100)] AS p99, v[len(v)] AS most FROM v
""")
def growth_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by place (place n*p of the sorted values, from 0), from counts of distinct values instead of lists of all of them."""
    return reports.percentiles_by_place(table(spark, sf_dir, "documents"), ["lang"], "n_chars", {"p50": (1, 2), "p90": (9, 10), "p99": (99, 100)}).withColumnRenamed("last", "most")


@query("""
WITH a AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey % 10)) AS x FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey % 10)) AS y FROM lineitem GROUP BY 1), j AS (SELECT x, y, len(list_intersect(x, y)) AS common, x[1] = y[1] AS same FROM a JOIN b USING (l_orderkey))
SELECT count(*) AS n, round(avg(common), 6) AS overlap, count(*) FILTER (WHERE same) AS same_first, round(avg(common * 1.0 / (len(x) + len(y) - common)), 6) AS agreement FROM j
""")
def method_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two methods give the same for each row: shared values, equal first choice, agreement."""
    both = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey") % 10)).alias("x"), F.array_sort(F.collect_set(F.col("l_suppkey") % 10)).alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    rows = both.select(shared.alias("both"), (F.element_at("x", 1) == F.element_at("y", 1)).alias("same"), (F.size("x") + F.size("y") - shared).alias("any"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("both"), 6).alias("overlap"), F.count_if("same").alias("same_first"), F.round(F.avg(F.col("both") / F.col("any")), 6).alias("agreement"))


@query("""
SELECT 'order without lines' AS fault, count(*) AS n FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'gap in lines', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) <> max(l_linenumber)) UNION ALL SELECT 'length differs', count(*) FROM documents WHERE length(text) <> n_chars UNION ALL SELECT 'repeated id', count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)
""")
def integrity_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named checks, each a count of what is wrong."""
    t = lambda name: table(spark, sf_dir, name)
    orders, lines = t("orders").select(F.col("o_orderkey").alias("k")), t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.max("l_linenumber").alias("last"))
    both = orders.withColumn("o", F.lit(1)).join(lines, "k", "full")  # one join for both directions and the gaps
    of_lines = both.agg(F.count_if(F.col("n").isNull()).alias("order without lines"), F.coalesce(F.sum(F.when(F.col("o").isNull(), F.col("n"))), F.lit(0)).alias("line without order"), F.count_if(F.col("n") != F.col("last")).alias("gap in lines"))
    of_texts = t("documents").agg(F.count_if(F.length("text") != F.col("n_chars")).alias("length differs"))
    of_labels = t("labels").groupBy("doc_id").count().agg(F.count_if(F.col("count") > 1).alias("repeated id"))
    row = reports.side_by_side([of_lines, of_texts, of_labels])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("fault"), F.col(f"`{c}`").alias("n")) for c in row.columns])).alias("x")).select("x.*")


@query("""
SELECT event_type, count(*) AS n, true AS close, quantile_disc(value, 0.5) AS middle FROM events GROUP BY event_type
""")
def approximate_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users by a sketch, whether that is within 3 % of their number, and the median by a quantile summary that is exact while it holds all values.

    The sketch is of the distinct users, which makes it the same sketch; one aggregate of both would keep a sketch and a
    summary for every user of a type before it counts them.
    """
    events = table(spark, sf_dir, "events")
    users = events.select(F.col("event_type").alias("kind"), "user_id").distinct().groupBy("kind").agg(F.approx_count_distinct("user_id", 0.01).alias("about"), F.count("user_id").alias("users"))
    values = events.groupBy("event_type").agg(F.count("*").alias("n"), F.percentile_approx("value", 0.5, 1_000_000).alias("middle"))
    close = F.abs(F.col("about") - F.col("users")) <= 0.03 * F.col("users")
    return values.join(users, F.col("event_type").eqNullSafe(F.col("kind"))).select("event_type", "n", close.alias("close"), "middle")


@query("""
WITH l AS (SELECT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_partkey % 7 = 0 UNION SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey % 3 = 0), s AS (SELECT a, count(DISTINCT b) AS confirmed FROM l GROUP BY a)
SELECT a AS o_orderkey, confirmed, confirmed >= 2 AS promoted FROM s
""")
def promotion_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct confirmations over both ends of links, with a floor of two."""
    lines = table(spark, sf_dir, "lineitem")
    ends = F.array_compact(F.array(F.when(F.col("l_partkey") % 7 == 0, F.col("l_partkey")), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey"))))
    seen = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.explode(ends).alias("b")).groupBy("o_orderkey").agg(F.countDistinct("b").alias("confirmed"))
    return seen.withColumn("promoted", F.col("confirmed") >= 2)


@query("""
WITH m AS (SELECT user_id AS statement, event_type AS vote FROM events WHERE event_type IN ('click', 'view', 'error')), t AS (SELECT statement, vote, count(*) AS n FROM m GROUP BY ALL)
SELECT statement, arg_max(vote, n * 10 - CASE vote WHEN 'click' THEN 0 WHEN 'error' THEN 1 ELSE 2 END) AS winner, max(n) AS votes, sum(n) AS cast_votes, count(*) FILTER (WHERE vote = 'error') = 1 AS quarantined FROM t GROUP BY statement
""")
def vote_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote with the most voices (equals by a fixed order) and whether any voice puts it in quarantine."""
    tally = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "error")).groupBy(F.col("user_id").alias("statement"), F.col("event_type").alias("vote")).agg(F.count("*").alias("n"))
    order = F.col("n") * 10 - F.when(F.col("vote") == "click", 0).when(F.col("vote") == "error", 1).otherwise(2)
    return tally.groupBy("statement").agg(F.max_by("vote", order).alias("winner"), F.max("n").alias("votes"), F.sum("n").alias("cast_votes"), (F.count_if(F.col("vote") == "error") == 1).alias("quarantined"))


@query("""
WITH d AS (SELECT ts::DATE AS day, event_type, user_id FROM events), b AS (SELECT min(day) AS a, max(day) AS z FROM d), s AS (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS day FROM b)
SELECT s.day, count(d.day) AS events, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) AS users FROM s LEFT JOIN d ON d.day = s.day GROUP BY s.day
""")
def daily_series_of_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several counters a day, with a row for days without any event; the days are joined to the daily counts, not to the events."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "user_id")
    counts = days.groupBy("day").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users"))
    spine = counts.agg(F.min("day").alias("a"), F.max("day").alias("z")).where("a is not null").select(F.explode(F.sequence("a", "z")).alias("day"))
    return spine.join(counts, "day", "left").fillna(0)


@query("""
WITH w AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY ALL) SELECT nation, segment, n, dense_rank() OVER (PARTITION BY nation ORDER BY n DESC) AS place, round(n * 1.0 / sum(n) OVER (PARTITION BY nation), 6) AS share FROM w
""")
def shares_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's share and place in its whole; the window runs over grouped rows, so it is bounded by the number of parts."""
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("nation")
    return counts.select("nation", "segment", "n", F.dense_rank().over(whole.orderBy(F.desc("n"))).alias("place"), F.round(F.col("n") / F.sum("n").over(whole), 6).alias("share"))
