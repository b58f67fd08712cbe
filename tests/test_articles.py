"""Article bodies in scripts, broken ones too; strings of JSON; bytes of unknown character sets."""

import json

from pyspark.sql import functions as F

from skein.functions import articles

LONG = "A sentence of the article that is long enough to count. " * 12


def _ld(x):
    return f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>'


def _stream(flat):
    return f"<script>window.streamController.enqueue({json.dumps(json.dumps(flat))});</script>"


def _next(body, **more):
    data = {"props": {"pageProps": {"post": {"title": "Rich", "deep": [{"x": body}]}, **more}}}
    return f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script>'


def _rich(*texts, depth=0):
    node = {"nodeType": "text", "value": texts[0]}
    for _ in range(depth):
        node = {"nodeType": "hyperlink", "content": [node]}
    return {"nodeType": "document", "content": [{"nodeType": "paragraph", "content": [node]}, *({"nodeType": "paragraph", "content": [{"nodeType": "text", "value": t}]} for t in texts[1:])]}


FLAT = [{"_1": 2, "self": 0}, "loaderData", {"_3": 4}, "routes/$slug", {"_5": 6, "_900": 1}, "post", {"content": 7, "title": 8, "back": 4}, f"<p>{LONG}</p><p>Second \"quoted\" \\ part</p>", "A title"]
TYPED = {"@type": ["Thing", "NewsArticle"], "articleBody": f"<b>One</b> &amp; two {LONG}", "headline": "Head"}

PAGES = {
    "streamed": (_stream([1]) + _stream(FLAT), "reference graph", "A title"),
    "streamed, title not a string": (_stream([*FLAT[:8], 5]), "reference graph", ""),
    "streamed in circles": (_stream([{"_1": 0}, "loaderData"]), "none", ""),
    "places out of range": (_stream([{"_1": 99, "_7777777777777": 3}, "loaderData"]) + _stream([{"_1": -5}, "loaderData"]), "none", ""),
    "linked": (_ld(TYPED), "linked data", "Head"),
    "last of a list": (_ld([{"@type": "Article", "articleBody": "first " + LONG, "headline": "First"}, TYPED]), "linked data", "Head"),
    "in a graph": (_ld({"@graph": [{"@type": "Person"}, {"@graph": [TYPED]}]}), "linked data", "Head"),
    "broken, then whole": (_ld('{"@type": "Article", "articleBody": "cut') + _ld(TYPED), "linked data", "Head"),
    "another kind": (_ld({"@type": "WebPage", "articleBody": LONG}) + "<p>Shown</p>", "visible", ""),
    "shorter than what is shown": (_ld({"@type": "Article", "articleBody": "short"}) + f"<p>{LONG}</p>", "visible", ""),
    "description": (_ld({"@type": "Report", "description": LONG, "articleBody": 5}) + "<p>Shown</p>", "description", ""),
    "rich": (_next(_rich(LONG, "Second")), "rich text", "Rich"),
    "rich, too deep": (_next(_rich(LONG, depth=60)) + "<p>Shown</p>", "visible", ""),
    "nested beyond any depth": ('<script id="__NEXT_DATA__">{"props": {"pageProps": ' + "[" * 100_000 + "</script><p>Shown</p>", "visible", ""),
    "refused": ("<p>Just a moment...</p>", "blocked", ""),
    "menus only": ("<nav>Menu</nav><form>Form</form>", "none", ""),
    "marked sections": ("<![ <p>Shown</p><![foo[bar]]>", "visible", ""),
    "nothing": (None, "none", ""),
    "empty": ("", "none", ""),
}


def test_every_page_has_a_row_from_the_surest_source(spark):
    rows = spark.createDataFrame([(k, page if page is None else f"<html><body>{page}</body></html>") for k, (page, _, _) in PAGES.items()], "name string, html string")
    got = {r.name: r.a for r in rows.select("name", articles.body(F.col("html")).alias("a")).collect()}
    assert {k: (a.source, a.title) for k, a in got.items()} == {k: (source, title) for k, (_, source, title) in PAGES.items()}
    assert got["streamed"].text == f'{LONG.strip()}\nSecond "quoted" \\ part'
    assert got["linked"].text == f"One\n& two {LONG.strip()}"
    assert got["rich"].text == f"{LONG.strip()}\nSecond"
    assert got["description"].text == LONG.strip() and got["another kind"].text == "Shown"


def test_strings_of_json_in_their_order(spark):
    cases = {'{"id": "no", "a": ["x", {"b": " y ", "name": "no"}], "c": 5, "d": "z"}': "x\ny\nz", '"alone"': "alone", "[": None, "": None, "[]": "", "[" * 50_000: None}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert {r.raw: r.t for r in rows.select("raw", articles.json_text(F.col("raw")).alias("t")).collect()} == cases


def test_bytes_are_read_by_the_named_set_or_the_next_that_fits(spark):
    cases = [("Größe".encode(), None, "Größe"), ("Größe".encode("latin-1"), "text/html; charset=latin-1", "Größe"), ("Привет".encode("windows-1251"), "text/html", "Привет"), ("Привет".encode("windows-1251"), "text/html; charset=utf-8", "Привет"), (b"\x98\xff", "x; charset=none", "\x98ÿ"), (None, "text/html", None), (b"", "", "")]
    rows = spark.createDataFrame([(bytearray(p) if p is not None else None, t) for p, t, _ in cases], "p binary, t string")
    assert [r.x for r in rows.select(articles.decoded(F.col("p"), F.col("t")).alias("x")).collect()] == [x for *_, x in cases]
