"""Text, date and URL functions against plain versions on hard cases."""

import datetime as dt
import unicodedata

from pyspark.sql import functions as F

from skein.functions import dates, texts, urls
from skein.operators import graph, history


def scanned(value):
    """The rule read off character by character: blanks between words of a line are one, and of a run of line ends three at most stay."""
    composed = unicodedata.normalize("NFC", value).replace("\0", "\N{REPLACEMENT CHARACTER}")
    out, ends, gap, skip = "", 0, False, False
    for char in composed:
        if char in "\r\n":
            if not (char == "\n" and skip):
                ends += 1
            skip, gap = char == "\r", False
            continue
        skip = False
        if char.isspace():
            gap = True
            continue
        if out:
            out += "\n" * min(ends, 3) if ends else " " * gap
        out, ends, gap = out + char, 0, False
    return out


def test_canonical_text(spark):
    letters = ["a", "bc", " ", "  ", "\t", "\r\n", "\n", "\r", "\n\n", "e\u0301", "\u3000", "\x00", "\u00a0\n"]
    cases = ["".join(letters[(k * 7 + n * n + n * k) % len(letters)] for n in range(k % 23)) for k in range(200)] + [None, "  ", "\n", "x"]
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = dict(rows.select("k", texts.canonical(F.col("t"))).collect())
    assert got == {k: None if t is None else scanned(t) for k, t in enumerate(cases)}


def test_chunks_are_the_text(spark):
    cases = ["", "x" * 9000, "word " * 3000, "a" * 2000 + " " + "b" * 5000, "é\n\n" * 2500, None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k int, t string")
    for r in rows.select("t", texts.chunks(F.col("t")).alias("c")).collect():
        assert "".join(c.text for c in r.c) == (r.t or "")
        assert all(0 < c.char_end - c.char_start == len(c.text) <= texts.CHUNK for c in r.c)
        for c in r.c[:-1]:
            half = c.text[texts.CHUNK // 2 :]
            assert c.text[-1] in " \n" or len(c.text) == texts.CHUNK and not set(half) & set(" \n")


def test_published_dates(spark):
    import calendar

    want = {None: (None, "none"), "": (None, "none"), "soon": (None, "none"), "1999-13": (None, "none"), "12-11-1999": (None, "none"), "Smarch 1, 2003": (None, "none"), "2001-04-31": (None, "none"), "2003-02-11x": (None, "none")}
    for k in range(1, 13):  # every month in all its forms
        year, day = 1990 + 3 * k, 2 * k + 3
        whole, month, start = dt.date(year, k, day), dt.date(year, k, 1), dt.date(year, 1, 1)
        for form in (f"{whole}", f"{whole}T23:59", f"  {whole} 04:05:06", f"{calendar.month_name[k]} {day}, {year}", f"{calendar.month_abbr[k].upper()}  {day},{year}"):
            want[form] = (whole, "day")
        for form in (f"{year}-{k:02}", f"{year}-{k:02}-??", f"{year}-{k:02}-xx", f"{year}-{k:02}-{year + 1}"):
            want[form] = (month, "month")
        want |= {f"{year}": (start, "year"), f"{year}-??": (start, "year"), f"{year}-??-??": (start, "year")}
    rows = spark.createDataFrame([(raw,) for raw in want], "raw string")
    assert {r.raw: (r.p.date, r.p.precision) for r in rows.select("raw", dates.published(F.col("raw")).alias("p")).collect()} == want


def test_domains_under_every_compound_suffix(spark):
    names = {f"a.b.{suffix}": f"b.{suffix}" for suffix in urls.COMPOUND} | {f"b.{suffix}": f"b.{suffix}" for suffix in urls.COMPOUND} | {"x.y.example.de": "example.de", "example.de": "example.de", "local": "local"}
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert len(urls.COMPOUND) == len(set(urls.COMPOUND)) == 22
    assert dict(rows.select("n", urls.registrable_domain(F.col("n"))).collect()) == names


def test_url_keys(spark):
    cases = {
        "http://www.Example.org/de/a/b/?utm_source=x&b=2&a=1": "https://example.org/a/b?a=1&b=2", "https://example.org/pt-BR/a/amp": "https://example.org/a", "https://example.org/a.amp?output=amp": "https://example.org/a",
        "https://example.org": "https://example.org/", "https://example.org:8080/en#top": "https://example.org:8080/", "not a url": "", "https://example.org/x?output=json&lang=de": "https://example.org/x?output=json", "https://example.org/x?b=a%20c&a": "https://example.org/x?a=&b=a+c", "https://example.org/x?b=a+c&a=%zz": "https://example.org/x?a=%25zz&b=a+c",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string")
    assert dict(rows.select("u", urls.url_key(F.col("u"))).collect()) == cases


def test_graph_keeps_the_first_node_and_names_lost_ends(spark):
    a = spark.createDataFrame([("1", "a", "x"), (None, "a", "y")], "id string, kind string, label string")
    b = spark.createDataFrame([("1", "b", "z"), ("2", "b", "z")], "id string, kind string, label string")
    known = graph.nodes([a, b])
    assert sorted(map(tuple, known.collect())) == [("1", "a", "x"), ("2", "b", "z")]
    edges = graph.relations([spark.createDataFrame([("1", "2", "r"), ("1", "2", "r"), ("2", "2", "r"), ("1", "9", "r"), ("8", "9", "r")], "src string, dst string, relation string")])
    assert [tuple(r) for r in graph.attached(edges, known).collect()] == [("1", "2", "r")]
    assert sorted((r.src, r.dst, r.lost) for r in graph.dangling(edges, known).collect()) == [("1", "9", "dst"), ("8", "9", "both")]


def test_all_failures_are_named(spark):
    got = spark.range(1).select(history.failures({"a": F.lit(True), "b": F.lit(False), "c": F.lit(None).cast("boolean")}).alias("f")).first()
    assert got.f == ["b", "c"]
