"""Queries of filters, predicates, rules and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import rules, texts, urls
from skein.operators import covering, periods
from skein.plans.registry import query
from skein.session import table

#: Terms of each subject, with the weight of one that is present.
SUBJECTS = {"alpha": (7, ["the ", "and "]), "beta": (5, ["der ", "die "]), "gamma": (4, ["les ", "des "]), "delta": (2, ["los ", "las "]), "epsilon": (1, ["tion"])}


def _sql_terms(text: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({text}, '{t}')::INT" for t in terms) + ")"


@query("""
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND (lower(o_orderstatus) LIKE '%high%' OR lower(o_orderpriority) LIKE '%high%')
""")
def filter_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters that are given apply; unknown values of an enumeration and missing ones are no filters; a search term may be in any column."""
    asked = {"status": "F", "priority": "NO SUCH", "least": 100000.0, "customer": None, "search": "high"}
    return periods.optional_filters(
        table(spark, sf_dir, "orders"),
        equal={"o_orderstatus": (asked["status"], ("F", "O", "P")), "o_orderpriority": (asked["priority"], ("1-URGENT", "2-HIGH")), "o_custkey": (asked["customer"], None)},
        least={"o_totalprice": asked["least"]},
        search=(asked["search"], ["o_orderstatus", "o_orderpriority"]),
    ).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""
WITH d AS (SELECT max(ts)::DATE AS today FROM events), p AS (SELECT * FROM (VALUES ('day', 0, 0), ('yesterday', 1, 1), ('7d', 6, 0), ('30d', 29, 0)) v(period, first, last))
SELECT period, count(*) AS n, round(sum(value), 4) AS total FROM events, d, p WHERE ts::DATE BETWEEN today - first AND today - last GROUP BY period
""")
def period_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the day, the day before, and the last 7 and 30 days, in one scan: a row is given to each period it is in."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "value")
    today = events.agg(F.max("day").alias("today"))
    age = F.date_diff("today", "day")
    spans = {"day": (0, 0), "yesterday": (1, 1), "7d": (0, 6), "30d": (0, 29)}
    within = F.array_compact(F.array(*[F.when(age.between(a, b), F.lit(p)) for p, (a, b) in spans.items()]))
    return events.join(F.broadcast(today)).select(F.explode(within).alias("period"), "value").groupBy("period").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
SELECT doc_id, lower(concat_ws(' ', source, lang, left(text, 80), array_to_string((list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}'))))[1:3], ' '))) AS card, coalesce(list_contains(regexp_extract_all(lower(text), '[a-z]{9,}'), 'ablewhion'), false) AS asked FROM documents
""")
def card_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searched text of a card: its labels, its shown text and its first three subjects; whether it has a subject that is asked for."""
    subjects = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{9,})"), 1)))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.left("text", F.lit(80)).alias("shown"), subjects.alias("subjects"))
    card = F.lower(F.concat_ws(" ", "source", "lang", "shown", F.array_join(F.slice("subjects", 1, 3), " ")))
    return docs.select("doc_id", card.alias("card"), F.coalesce(F.array_contains("subjects", "ablewhion"), F.lit(False)).alias("asked"))


@query("""
SELECT doc_id, CASE WHEN quality = 1 AND nullif(trim(source), '') IS NOT NULL THEN source ELSE coalesce(nullif(trim(lang), ''), left(text, 20), '') END AS shown FROM documents LEFT JOIN labels USING (doc_id)
""")
def shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that is shown: the better one where its check succeeded, else the first that isn't empty."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    shown = F.when((F.col("quality") == 1) & blank("source").isNotNull(), F.col("source")).otherwise(F.coalesce(blank("lang"), F.left("text", F.lit(20)), F.lit("")))
    return docs.select("doc_id", shown.alias("shown"))


@query("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate::DATE END AS published, (o_orderdate + INTERVAL (o_orderkey % 40) DAY)::DATE AS seen, o_orderstatus AS kind FROM orders), m AS (SELECT max(seen) AS until FROM r)
SELECT o_orderkey, published IS NULL OR published >= until - 365 AS in_lookback, CASE kind WHEN 'F' THEN coalesce(published BETWEEN until - 29 AND until, false) WHEN 'O' THEN seen BETWEEN until - 29 AND until ELSE coalesce(published, seen) BETWEEN until - 29 AND until END AS in_period,
seen BETWEEN until - 29 AND until AND (published IS NULL OR published >= seen - 30) AS candidate, CASE WHEN (published IS NULL) <> (o_orderkey % 9 = 0) THEN 'inconsistent' WHEN published IS NULL THEN 'unresolved' WHEN published > seen THEN 'future' WHEN published < seen - 30 THEN 'old' ELSE 'eligible' END AS eligibility FROM r, m
""")
def publication_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four window rules: lookback that keeps unknown dates, membership by kind of source, candidates by first sight, eligibility with its reason."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate")).alias("published"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 40).cast("int")).alias("seen"), F.col("o_orderstatus").alias("kind"))
    rows = rows.join(F.broadcast(rows.agg(F.max("seen").alias("until"))))
    recent = lambda c: c.between(F.date_sub("until", 29), F.col("until"))
    published, seen = F.col("published"), F.col("seen")
    return rows.select(
        "o_orderkey",
        (published.isNull() | (published >= F.date_sub("until", 365))).alias("in_lookback"),
        F.when(F.col("kind") == "F", F.coalesce(recent(published), F.lit(False))).when(F.col("kind") == "O", recent(seen)).otherwise(recent(F.coalesce(published, seen))).alias("in_period"),
        (recent(seen) & (published.isNull() | (published >= F.date_sub(seen, 30)))).alias("candidate"),
        rules.first_of([("inconsistent", published.isNull() != (F.col("o_orderkey") % 9 == 0)), ("unresolved", published.isNull()), ("future", published > seen), ("old", published < F.date_sub(seen, 30))], "eligible").alias("eligibility"),
    )


_LOW = "lower(text)"
_SCORE = " + ".join(f"{w} * {_sql_terms(_LOW, t)}" for w, t in SUBJECTS.values())


@query(f"""
WITH s AS (SELECT doc_id, n_chars, lang, text, {_SCORE} AS score, {_sql_terms(_LOW, SUBJECTS["alpha"][1])} AS near FROM documents)
SELECT doc_id, score, CASE WHEN trim(text) = '' THEN 'empty' WHEN n_chars < 40 THEN 'short' WHEN near = 0 AND lang = 'en' THEN 'off subject' WHEN score >= 14 THEN 'core' WHEN score >= 5 THEN 'context' ELSE 'noise' END AS verdict,
CASE WHEN near >= 2 THEN 'near' WHEN {_sql_terms(_LOW, SUBJECTS["beta"][1])} > 0 THEN 'middle' WHEN score > 0 THEN 'far' ELSE 'watch' END AS perimeter,
least(CASE WHEN near >= 2 THEN greatest(score / 20.0, 0.4) ELSE score / 20.0 END, CASE WHEN n_chars < 200 THEN 0.5 ELSE 1.0 END) AS strength FROM s
""")
def relevance_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted counts of terms, the first exclusion or band that applies, a perimeter by priority, and a strength with floors and caps."""
    text = F.lower("text")
    counts = {name: rules.terms_present(text, t) for name, (_, t) in SUBJECTS.items()}
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", (F.trim("text") == "").alias("empty"), *[c.alias(n) for n, c in counts.items()])
    rows = rows.withColumn("score", sum((w * F.col(n) for n, (w, _) in SUBJECTS.items()), F.lit(0)))
    score, near = F.col("score"), F.col("alpha")
    verdict = rules.first_of([("empty", F.col("empty")), ("short", F.col("n_chars") < 40), ("off subject", (near == 0) & (F.col("lang") == "en")), ("core", score >= 14), ("context", score >= 5)], "noise")
    perimeter = rules.first_of([("near", near >= 2), ("middle", F.col("beta") > 0), ("far", score > 0)], "watch")
    strength = rules.clamped(score / 20.0, [(near >= 2, 0.4)], [(F.col("n_chars") < 200, 0.5), (F.lit(True), 1.0)])
    return rows.select("doc_id", "score", verdict.alias("verdict"), perimeter.alias("perimeter"), strength.alias("strength"))


@query(f"""
WITH s AS (SELECT doc_id, {", ".join(f"{w} * {_sql_terms(_LOW, t)} AS {n}" for n, (w, t) in SUBJECTS.items())} FROM documents),
u AS (UNPIVOT s ON {", ".join(SUBJECTS)} INTO NAME name VALUE score), r AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, list_position({list(SUBJECTS)}, name)) AS nth FROM u WHERE score > 0)
SELECT doc_id, coalesce(string_agg(name, ',' ORDER BY nth) FILTER (WHERE nth <= 3), 'general') AS subjects, CASE WHEN count(name) = 0 THEN 0.3 WHEN count(name) = 1 THEN 0.58 ELSE 0.66 END AS confidence FROM documents LEFT JOIN r USING (doc_id) GROUP BY doc_id
""")
def subject_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best subjects of a text by weighted terms, equals in catalogue order, with a default and a confidence."""
    text = F.lower("text")
    ranked = rules.weighted_ranking({n: w * rules.terms_present(text, t) for n, (w, t) in SUBJECTS.items()}, 3)
    rows = table(spark, sf_dir, "documents").select("doc_id", ranked.alias("ranked"))
    many = F.size("ranked")
    return rows.select("doc_id", F.when(many > 0, F.array_join("ranked", ",")).otherwise("general").alias("subjects"), F.when(many == 0, F.lit(0.3)).when(many == 1, F.lit(0.58)).otherwise(F.lit(0.66)).alias("confidence"))


@query(r"""
WITH t AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN upper(left(text, 40)) WHEN 1 THEN 'https://example.org/' || doc_id WHEN 2 THEN '  ' WHEN 3 THEN '<b>' || left(text, 30) WHEN 4 THEN left(text, 8) WHEN 5 THEN '12 - 34 - 56 - 78' ELSE left(text, 60) END AS title FROM documents),
l AS (SELECT *, trim(title) AS b, regexp_replace(trim(title), '[^\p{L}]', '', 'g') AS z FROM t)
SELECT doc_id, CASE WHEN title IS NULL OR b = '' THEN 'missing' WHEN regexp_matches(b, '^(https?://|www\.)\S+$') THEN 'address' WHEN regexp_matches(b, '<[A-Za-z/][^>]*>|&[a-z]+;') THEN 'markup' WHEN z = '' THEN 'letterless' WHEN length(b) < 12 THEN 'short' WHEN length(z) > 8 AND z = upper(z) AND z <> lower(z) THEN 'shouted' END AS problem FROM l
""")
def title_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("doc_id") % 7, F.col("text")
    title = F.when(k == 0, rules.capitals(F.left(text, F.lit(40)))).when(k == 1, F.concat(F.lit("https://example.org/"), "doc_id")).when(k == 2, "  ").when(k == 3, F.concat(F.lit("<b>"), F.left(text, F.lit(30)))).when(k == 4, F.left(text, F.lit(8))).when(k == 5, "12 - 34 - 56 - 78").otherwise(F.left(text, F.lit(60)))
    return table(spark, sf_dir, "documents").select("doc_id", title.alias("title")).select("doc_id", rules.title_problem(F.col("title")).alias("problem"))


@query(r"""
WITH h AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '(^|[\s"''(])(/home/|/root/|/Users/|[A-Z]:\\)') THEN 'path,' ELSE '' END || CASE WHEN regexp_matches(text, '(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*\S{6,}') THEN 'secret,' ELSE '' END || CASE WHEN regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}') THEN 'address,' ELSE '' END AS kinds FROM documents)
SELECT doc_id, trim(kinds, ',') AS kinds, sha256(regexp_replace(regexp_replace(regexp_replace(text, '(/home|/root|/Users)/[^\s"'')]*', '[path]', 'g'), '(?i)((?:api[_-]?key|secret|token|password)\s*[:=]\s*)\S{6,}', '\1[secret]', 'g'), '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}', '[address]', 'g')) AS digest FROM h WHERE kinds <> ''
""")
def hidden_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with values that must not be published, of which kinds, and the digest of the text without them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", rules.hidden_values(F.col("text")).alias("kinds")).where(F.size("kinds") > 0)
    return docs.select("doc_id", F.array_join("kinds", ",").alias("kinds"), F.sha2(rules.scrubbed(F.col("text")), 256).alias("digest"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, url, len(regexp_extract_all(lower(html), '<a ')) AS links, length(html) AS size FROM pages)
SELECT page_id, regexp_matches(path, '(?i)/(pricing|demo|landing|promo|en)(/|$)') AND links < 8 AS promotional, links * 60 > size / 10 AS aggregator FROM p
""")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing pages by their path and few links, and pages that mostly list others."""
    links = F.regexp_count(F.lower("html"), F.lit("<a "))
    rows = table(spark, sf_dir, "pages").select("page_id", urls.path(F.col("url")).alias("path"), links.alias("links"), F.length("html").alias("size"))
    return rows.select("page_id", (F.col("path").rlike("(?i)/(pricing|demo|landing|promo|en)(/|$)") & (F.col("links") < 8)).alias("promotional"), (F.col("links") * 60 > F.col("size") / 10).alias("aggregator"))


@query("""
WITH d AS (SELECT o_orderkey, o_custkey % 5 AS host, trunc((epoch(shipped) - epoch(o_orderdate)) / 86400)::INT AS delta FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN delta IS NULL THEN 'high' WHEN delta < 0 THEN 'critical' WHEN delta > 90 THEN 'high' WHEN delta > 30 THEN 'medium' ELSE 'low' END AS severity, delta IS NULL OR delta < 0 OR delta > 30 AS review,
CASE WHEN delta IS NULL THEN 'no date' WHEN delta < 0 THEN 'before its source' WHEN delta > 30 AND host = 0 THEN 'source is often late' WHEN delta > 30 THEN 'late' ELSE 'plausible' END AS reason FROM d
""")
def date_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two dates of a row may be trusted: severity, whether to review, and the reason."""
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("shipped"))
    rows = table(spark, sf_dir, "orders").join(shipped, "o_orderkey", "left").select("o_orderkey", (F.col("o_custkey") % 5).alias("host"), ((F.unix_seconds(F.col("shipped").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))) / 86_400).cast("int").alias("delta"))
    delta, host = F.col("delta"), F.col("host")
    return rows.select(
        "o_orderkey",
        rules.first_of([("high", delta.isNull()), ("critical", delta < 0), ("high", delta > 90), ("medium", delta > 30)], "low").alias("severity"),
        (delta.isNull() | (delta < 0) | (delta > 30)).alias("review"),
        rules.first_of([("no date", delta.isNull()), ("before its source", delta < 0), ("source is often late", (delta > 30) & (host == 0)), ("late", delta > 30)], "plausible").alias("reason"),
    )


@query("""
WITH v AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE + 200 END AS valid_until FROM orders), n AS (SELECT max(o_orderdate)::DATE AS as_of FROM orders)
SELECT o_orderkey, valid_until IS NULL OR valid_until >= as_of AS fresh, valid_until < as_of AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS expired FROM v, n
""")
def fresh_and_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness with an open end, and expired rows that nothing protects."""
    orders = table(spark, sf_dir, "orders")
    as_of = orders.agg(F.to_date(F.max("o_orderdate")).alias("as_of"))
    rows = orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.date_add(F.to_date("o_orderdate"), 200)).alias("valid_until")).join(F.broadcast(as_of))
    kept = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("kept", F.lit(True))
    rows = rows.join(kept, "o_orderkey", "left")
    return rows.select("o_orderkey", (F.col("valid_until").isNull() | (F.col("valid_until") >= F.col("as_of"))).alias("fresh"), ((F.col("valid_until") < F.col("as_of")) & F.col("kept").isNull()).alias("expired"))


@query(r"""
SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS judged, NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS not_toxic, regexp_matches(source, '^src[0-3]$') AS by_name FROM documents d
WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) OR regexp_matches(source, '^src[0-3]$')
""")
def corpus_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership by what exists, by what doesn't, or by a pattern; the labels are reduced to one row a document first."""
    facts = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.coalesce(F.bool_or(F.expr("quality = 1")), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.expr("toxic = 1")), F.lit(False)).alias("bad"))
    by_name = F.col("source").rlike("^src[0-3]$")
    rows = table(spark, sf_dir, "documents").select("doc_id", by_name.alias("by_name")).join(facts, "doc_id", "left")
    return rows.where(F.coalesce("good", F.lit(False)) | F.col("by_name")).select("doc_id", F.col("good").isNotNull().alias("judged"), (~F.coalesce("bad", F.lit(False))).alias("not_toxic"), "by_name")


@query(r"""
SELECT page_id, CASE WHEN starts_with(url, 'https://www.') THEN 'www' WHEN starts_with(url, 'https://m.') OR starts_with(url, 'http://m.') THEN 'mobile' WHEN starts_with(url, 'http://') THEN 'plain' ELSE 'other' END AS born FROM pages
""")
def prefix_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", rules.first_of([("www", url.startswith("https://www.")), ("mobile", url.startswith("https://m.") | url.startswith("http://m.")), ("plain", url.startswith("http://"))], "other").alias("born"))


@query("""
WITH t AS (SELECT conv_id, count(*) AS turns, list(DISTINCT role) AS roles, sum(length(text)) AS chars, count(*) FILTER (WHERE text = '') AS blank FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_filter([CASE WHEN turns < 2 THEN 'too few turns' END, CASE WHEN NOT list_contains(roles, 'assistant') THEN 'no answer' END, CASE WHEN chars < 400 THEN 'too short' END, CASE WHEN blank > 0 THEN 'blank turn' END, CASE WHEN turns > 6 THEN 'too many turns' END], lambda x: x IS NOT NULL), ',') AS defects FROM t
""")
def every_defect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules that a row breaks, not only the first."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.collect_set("role").alias("roles"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("text") == "").alias("blank"))
    checks: dict[str, Column] = {"too few turns": F.col("turns") < 2, "no answer": ~F.array_contains("roles", "assistant"), "too short": F.col("chars") < 400, "blank turn": F.col("blank") > 0, "too many turns": F.col("turns") > 6}
    return rows.select("conv_id", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])), ",").alias("defects"))


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '[\p{Cyrillic}]+')) + len(regexp_extract_all(text, '[\p{Greek}]+')) + len(regexp_extract_all(text, '[\p{Han}]+')) AS foreign_runs,
array_to_string((list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{4,}'), lambda w: w NOT IN ('tion', 'with', 'that')))))[1:5], ' ') AS latin_words FROM documents WHERE lang <> 'en'
""")
def foreign_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of other scripts in a text, and its first Latin words that are not allowed."""
    runs = sum((F.regexp_count("text", F.lit(rf"[\p{{Is{s}}}]+")) for s in ("Cyrillic", "Greek", "Han")), F.lit(0))
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1), lambda w: ~w.isin("tion", "with", "that"))
    return table(spark, sf_dir, "documents").where("lang <> 'en'").select("doc_id", runs.alias("foreign_runs"), F.array_join(F.slice(F.array_sort(F.array_distinct(words)), 1, 5), " ").alias("latin_words"))


@query(r"""
SELECT doc_id, NOT contains(trim(text), chr(10) || chr(10)) AND length(trim(text)) BETWEEN 1 AND 1500 AS one_paragraph, regexp_extract(text, '(?s)^(.*?[.!?])(\s|$)', 1) AS lead FROM documents
""")
def paragraph_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is one paragraph of bounded length, and its first sentence."""
    return table(spark, sf_dir, "documents").select("doc_id", texts.one_paragraph(F.col("text"), 1500).alias("one_paragraph"), texts.first_sentence(F.col("text")).alias("lead"))


_WANTED = {
    "english": (8, "lang = 'en'"), "german": (5, "lang = 'de'"), "short": (2, "n_chars <= 200"), "long": (2, "n_chars >= 5000"), "numbers": (3, "text RLIKE '[0-9]{3}'"),
    "first source": (3, "source = 'src1'"), "second source": (3, "source = 'src2'"), "accents": (4, "text RLIKE '[éèê]'"), "tables": (2, "contains(text, ' | ')"), "quality": (6, "quality = 1"), "toxic": (2, "toxic = 1"),
}
_MASKS = " + ".join(f"CASE WHEN {c.replace(' RLIKE ', ' SIMILAR TO ')} THEN {1 << k} ELSE 0 END" for k, (_, c) in enumerate(_WANTED.values())).replace("SIMILAR TO '[0-9]{3}'", "SIMILAR TO '(.|\\n)*[0-9]{3}(.|\\n)*'").replace("SIMILAR TO '[éèê]'", "SIMILAR TO '(.|\\n)*[éèê](.|\\n)*'")
_LEFT = "[" + ", ".join(str(n) for n, _ in _WANTED.values()) + "]"
_GAIN = f"len(list_filter(range(0, {len(_WANTED)}), lambda k: w[k + 1] > 0 AND (mask >> k) & 1 = 1))"


@query(f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_MASKS} AS mask FROM documents LEFT JOIN labels USING (doc_id)), r(turn, doc_id, gain, w, used) AS (
SELECT 0, NULL::BIGINT, 0, {_LEFT}, []::BIGINT[] UNION ALL
SELECT turn + 1, pick.doc_id, pick.gain, list_transform(range(0, {len(_WANTED)}), lambda k: w[k + 1] - ((pick.mask >> k) & 1)::INT), list_append(used, pick.doc_id) FROM (SELECT r.turn, r.w, r.used, (SELECT arg_max(struct_pack(doc_id := doc_id, mask := mask, gain := {_GAIN}), ({_GAIN}, -doc_id)) FROM d WHERE NOT list_contains(used, d.doc_id)) AS pick FROM r) WHERE pick.gain > 0)
SELECT doc_id, turn::INT AS turn, gain::INT AS gain FROM r WHERE turn > 0
""")
def sampled_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of documents that meets eleven named requirements, each as often as it asks, chosen greedily."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return covering.sample(docs, "doc_id", {name: (least, F.expr(c)) for name, (least, c) in _WANTED.items()})
