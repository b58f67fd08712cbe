"""Functions and operators that SQL can't express, against plain versions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skein import tables
from skein.functions import pages, quotes, rules
from skein.operators import joining, merging, rates
from skein.streaming import events


def test_spans_grow_to_sentences(spark):
    text = "One here. Dr. Who came, e.g. on foot! And left?\n\nA second paragraph. It has two sentences"
    assert [text[a:b] for a, b, _ in [quotes.widened_span(text, k, k + 2, 200) for k in (1, 12, 40, 52, 80)]] == [
        "One here.", "Dr. Who came, e.g. on foot!", "And left?", "A second paragraph.", "It has two sentences",
    ]
    assert quotes.widened_span(text, 12, 14, 10) == (12, 14, "too long")
    for start in range(len(text)):
        a, b, reason = quotes.widened_span(text, start, start + 1, 200)
        assert a <= start < b or text[start].isspace()
        assert text[a:b].strip() and "\n\n" not in text[a:b].strip() or text[start].isspace()
    rows = spark.createDataFrame([(text, 1, 3), (None, 1, 2), ("x", 0, 9), ("", 0, 0)], "t string, a int, b int")
    assert [r.s.reason for r in rows.select(quotes.widened(F.col("t"), F.col("a"), F.col("b")).alias("s")).collect()] == ["widened", "no span", "no span", "whole"]


def test_quotes_in_other_dress(spark):
    text = "He said: “Nothing — at   all — is\nlost.” Then 🎉 noth\u00ading at all (a+b) [1]. Straße und mehr davon"
    cases = {'"Nothing - at all - is lost."': "exact", "Straße und  mehr": "exact", "lost": "too short", "nothing whatever is lost": "not found", None: "too short", "nothing at all (a+b) [": "exact", "NOTHING AT ALL": "not found"}
    rows = spark.createDataFrame([(text, q) for q in cases], "t string, q string")
    got = rows.select("q", quotes.aligned(F.col("t"), F.col("q")).alias("a")).collect()
    assert {r.q: r.a.reason for r in got} == cases
    spans = {r.q: text[r.a.start : r.a.end] for r in got if r.a.start is not None}
    assert list(spans.values()) == ["“Nothing — at   all — is\nlost.”", "Straße und mehr", "noth\u00ading at all (a+b) ["]
    twice = spark.createDataFrame([("abcabcabcabcabc", "abcabcabcabc"), (None, "abcabcabcabc"), ("x" * 200_000 + " the very last words", "the very last words")], "t string, q string")
    column = quotes.aligned(F.col("t"), F.col("q"))
    assert [(r.a.start, r.a.reason) for r in twice.select(column.alias("a")).collect()] == [(None, "ambiguous"), (None, "not found"), (200_001, "exact")]
    outside = quotes.aligned(F.col("t"), F.col("q"), (F.lit(0), F.lit(100)))
    assert [r.a.reason for r in twice.select(outside.alias("a")).collect()] == ["ambiguous", "not found", "outside the window"]


def test_numbers_in_either_style(spark):
    want = {"1,234.50": 1234.5, "1.234,50": 1234.5, "1 234": 1234.0, "12,5": 12.5, "12.5": 12.5, "1,234": 1234.0, "0,234": 0.234, "1.234.567": 1234567.0, "-3": -3.0, "x": None, "": None}
    rows = spark.createDataFrame([(k,) for k in want], "raw string")
    assert dict(rows.select("raw", pages.number(F.col("raw"))).collect()) == want


def test_dates_of_pages_by_their_surest_place(spark):
    cases = {
        '<meta property="article:published_time" content="2024-02-03T10:00:00Z"><time datetime="2023-01-01">': ("2024-02-03", "article:published_time", 0.95),
        "<meta name='pubdate' content='Tue, 05 Mar 2024 23:30:00 -0200'>": ("2024-03-06", "pubdate", 0.82),
        '<meta itemprop="datePublished" content="soon"><script>{"datePublished": "2024-05-06"}</script>': ("2024-05-06", "linked data", 0.93),
        '<time class=a datetime="2024-07-08T01:00">': ("2024-07-08", "time", 0.75),
        "<div><h1>Title</h1><p>March 9, 2024</p></div>": ("2024-03-09", "header", 0.78),
        "<p>Words of 10 Apr 2024 and more</p>": ("2024-04-10", "lead", 0.72),
        "<p>" + "words " * 600 + "2024-11-12</p>": ("2024-11-12", "text", 0.62),
        "<p>2024-13-45 and 12345-01-01</p>": (None, "none", 0.0),
        "<script>var d = '2024-01-01'</script>": (None, "none", 0.0),
        "": (None, "none", 0.0),
    }
    rows = spark.createDataFrame([(h,) for h in cases] + [(None,)], "h string")
    got = {r.h: (r.d.date and str(r.d.date), r.d.source, r.d.confidence) for r in rows.select("h", pages.publication_date(F.col("h")).alias("d")).collect()}
    assert got == cases | {None: (None, "none", 0.0)}


def test_times_as_feeds_write_them(spark):
    cases = {"2024-02-30": None, "2024-??-??": "2024-01-01 00:00:00", "2024-05-??": "2024-05-01 00:00:00", "2024-05-06T07:08:09+02:00": "2024-05-06 05:08:09", "2 weeks ago": "2025-12-18 00:00:00", "1 year ago": "2025-01-01 00:00:00", "Mon, 06 May 2024 07:08 GMT": "2024-05-06 07:08:00", "Sept. 5, 2024": "2024-09-05 00:00:00", "Friday, September 6, 2024": "2024-09-06 00:00:00", "6 sep, 2024": "2024-09-06 00:00:00", "yesterday": None, "": None, None: None, "x ago": None}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r.raw: r.t and str(r.t) for r in rows.select("raw", pages.flexible_time(F.col("raw"), F.lit("2026-01-01")).cast("string").alias("t")).collect()}
    assert got == cases


def test_titles_of_pages(spark):
    one = spark.createDataFrame([("<title>A</title><h1> B <b>c</b></h1>",), ('<meta property="og:title" content="O"><h1>B</h1>',), ("<p>",)], "h string")
    assert [r.t and tuple(r.t) for r in one.select(pages.title(F.col("h")).alias("t")).collect()] == [("B c", "h1"), ("O", "og"), None]


def test_material_ids(spark):
    rows = spark.createDataFrame([("https://a/b", "x", None), ("https://a/b", "y", "2024"), ("", "A <b>Title</b>!", "2024"), (None, "a  title", "2024"), (None, "a title", None)], "u string, t string, p string")
    a, b, c, d, e = (r.i for r in rows.select(pages.material_id(F.col("u"), F.col("t"), F.col("p")).alias("i")).collect())
    assert a == b and c == d and len({a, c, e}) == 3 and len(a) == 16


def test_relative_days(spark):
    day = dt.date(2024, 3, 31)
    want = {"today": day, " Yesterday ": dt.date(2024, 3, 30), "3 days ago": dt.date(2024, 3, 28), "1 week ago": dt.date(2024, 3, 24), "1 month ago": dt.date(2024, 2, 29), "tomorrow": None, None: None}
    rows = spark.createDataFrame([(k,) for k in want], "s string")
    assert dict(rows.select("s", pages.relative_date(F.col("s"), F.lit(day))).collect()) == want


def test_values_that_must_not_be_published(spark):
    rows = spark.createDataFrame([("see /home/me/x.txt",), ("api_key = abcdef123",), ("write to a.b@example.org",), ("nothing",)], "t string")
    got = rows.select(rules.hidden_values(F.col("t")).alias("k"), rules.scrubbed(F.col("t")).alias("s")).collect()
    assert [r.k for r in got] == [["path"], ["secret"], ["address"], []]
    assert [r.s for r in got] == ["see [path]", "api_key = [secret]", "write to [address]", "nothing"]


def test_hot_keys_are_joined_whole(spark):
    rows = tables.written(spark.range(5000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), "id"), "test")
    side = tables.written(rows.groupBy("k").agg(F.count("*").alias("n"), (F.col("k") * 2).alias("v")), "test")
    got = tables.looked_up(rows, side, "k", "n", 5000).collect()
    assert len(got) == 5000 and all(r.v == 2 * r.k for r in got) and len({r.id for r in got}) == 5000
    tables.removed(side)
    with pytest.raises(Exception):
        side.collect()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Conf:
        @staticmethod
        def get(name, default):
            return default

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError):
        tables.shared_folder(Session)


def test_upserts_with_null_keys_and_repeated_rows(spark):
    state = spark.createDataFrame([(1, "a", 5, 5), (None, "n", 1, 1)], "k int, v string, low int, high int")
    feed = spark.createDataFrame([(1, "b", 7, 7, 1), (1, "c", 3, 9, 2), (None, "m", 4, 4, 1), (2, "d", None, None, 1)], "k int, v string, low int, high int, at int")
    got = merging.upserted(state, feed, ["k"], ["at"], lowest=["low"], highest=["high"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "c", 3, 9), (None, "m", 1, 4), (2, "d", None, None)], key=repr)
    assert merging.upserted(state, feed.limit(0), ["k"], ["at"]).count() == 2


def test_rates_and_as_of_against_plain_loops(spark):
    import random

    random.seed(1)
    data = [(k, random.randrange(3), random.randrange(400)) for k in range(300)]
    rows = spark.createDataFrame(data, "id int, key int, t int")
    got = {r.id: r.n for r in rates.recent(rows, "key", "t", 60).collect()}
    assert got == {i: sum(k == k2 and t - 60 < t2 <= t for _, k2, t2 in data) for i, k, t in data}
    left, right = rows.where("id % 2 = 0"), rows.where("id % 2 = 1").groupBy("key", "t").agg(F.max("id").alias("other"))
    found = {r.id: r.other for r in joining.as_of(left, right, ["key"], "t", ["other"]).collect()}
    known = {(r.key, r.t): r.other for r in right.collect()}
    for i, k, t in data[::2]:
        before = [t2 for k2, t2 in known if k2 == k and t2 <= t]
        assert found[i] == (known[k, max(before)] if before else None)


def test_sessions_end_after_a_gap(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, start + dt.timedelta(minutes=m)) for m in (0, 10, 39, 80)] + [(2, start)]
    found = events.sessions(spark.createDataFrame(rows, "user_id long, ts timestamp")).orderBy("user_id", "started").collect()
    assert [(r.user_id, r.n) for r in found] == [(1, 3), (1, 1), (2, 1)]


def test_labels_blocks_and_cursors(spark):
    from skein.functions import dates, texts
    from skein.operators import pages, retrieval

    one = spark.range(1)
    forms = spark.range(130).select("id", texts.plural(F.col("id"), "one", "few", "many").alias("f"))
    found = {r.id: r.f for r in forms.collect()}
    assert [k for k, f in found.items() if f == "one"] == [1, 21, 31, 41, 51, 61, 71, 81, 91, 101, 121]
    assert [found[k] for k in (0, 2, 4, 5, 11, 12, 14, 22, 112, 122)] == ["many", "few", "few", "many", "many", "many", "many", "few", "many", "few"]
    text = F.lit("Why:\n\n  first\nsecond\n\n End : x\nWhy: again\nSeen 1 234 567 8\nnone: -")
    row = one.select(
        texts.block(text, ["Reason", "Why"], ["End"]).alias("a"), texts.block(text, ["End"], ["Why"]).alias("b"), texts.block(text, ["Other"], ["End"]).alias("c"), texts.block(F.lit("Why: \nEnd: x"), ["Why"], ["End"]).alias("d"),
        texts.counter(text, "seen").alias("e"), texts.counter(text, "none").alias("f"), texts.block(F.lit(None).cast("string"), ["Why"], ["End"]).alias("g"),
    ).first()
    assert tuple(row) == ("first\nsecond", "x", None, None, 1234567, None, None)
    months = [f"m{k}" for k in range(1, 13)]
    day = lambda x: F.lit(x).cast("date")
    assert one.select(dates.label(day("2024-02-09"), months), dates.label(day(None), months)).first()[:] == ("9 m2 2024", None)
    assert str(one.select(dates.after(day("2024-02-29"), F.lit(365 + 30 + 2))).first()[0]) == "2025-03-31"
    mark = one.select(pages.cursor("q", key=F.lit(7), day=F.lit('a"b')).alias("m"))
    opened = mark.select(pages.opened(F.col("m"), "q", ["key", "day"]), pages.opened(F.col("m"), "other", ["key", "day"]), pages.opened(F.lit("?not a mark"), "q", ["key"]), pages.opened(F.lit(None).cast("string"), "q", ["key"])).first()
    assert tuple(opened[0]) == ("7", 'a"b') and opened[1:] == (None, None, None)
    assert one.select(retrieval.prefixes_matched(F.lit("Über alles, x_que"), "über ALL que the"), retrieval.prefixes_matched(F.lit(None).cast("string"), "a")).first()[:] == (2, 0)
