"""Article bodies that pages hold in their scripts: JSON-LD, data of reference graphs, rich text; visible text as the fallback."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Types of nodes that are articles, inline nodes of rich text, marks of pages that refuse.
TYPES = ("Article", "BlogPosting", "NewsArticle", "Report", "ScholarlyArticle", "TechArticle")
INLINE = frozenset({"text", "hyperlink", "entry-hyperlink", "asset-hyperlink"})
BLOCKED = ("access denied", "attention required", "enable javascript and cookies to continue", "just a moment", "request blocked", "you have been blocked")
NO_NAMES = frozenset({"id", "name", "kind", "url", "permalink"})
LEAST, BLOCKED_BELOW, TITLE, DEEPEST = 500, 2000, 1000, 32
#: Where an article's data stands in a graph of references.
ROUTE = ("loaderData", "routes/$slug", "post")
CHROME = frozenset("script style noscript svg nav header footer form".split())
BREAKS = frozenset("address article blockquote br dd div dl dt figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section table td th tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with the value computed once, however often `of` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def clean(text: Column) -> Column:
    """Text without markup: each tag a line end, no blank lines, no white space around lines, the common character references decoded."""
    plain = F.when(text.contains("<") & text.contains(">"), F.regexp_replace(text, "<[^>]*>", "\n")).otherwise(text)
    for sign, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), (" ", "&nbsp;"), ("&", "&amp;")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(plain, r"[ \t\r]*\n[ \t\r\n]*", "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def _string(value: Column, path: str) -> Column:
    """What stands at a path of a variant, if it is a string."""
    return let(F.try_variant_get(value, path, "variant"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))


def _script(html: Column, attribute: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<script[^>]*\b{attribute}[^>]*>(.*?)</script>"), 1)


def linked_data(html: Column) -> Column:
    """struct(body, description, headline) of the first article among a page's JSON-LD nodes, in lists and graphs too; null if none. Broken scripts are left out."""
    parsed = F.filter(F.transform(_script(html, r"type\s*=\s*[\"']application/ld\+json"), F.try_parse_json), lambda v: v.isNotNull())
    listed = lambda v, path: F.reverse(F.try_variant_get(v, path, "array<variant>"))
    nodes = parsed
    for _ in range(3):  # lists within lists
        nodes = F.flatten(F.transform(nodes, lambda v: F.coalesce(listed(v, "$"), F.array(v))))
    for _ in range(3):  # graphs within graphs
        nodes = F.flatten(F.transform(nodes, lambda v: F.concat(F.array(v), F.coalesce(listed(v, "$['@graph']"), F.array().cast("array<variant>")))))
    kinds = lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(_string(v, "$['@type']")))
    article = F.get(F.filter(nodes, lambda v: F.arrays_overlap(kinds(v), F.array(*map(F.lit, TYPES)))), F.lit(0))

    def parts(v: Column) -> Column:
        part = lambda name: let(F.coalesce(_string(v, f"$.{name}"), F.lit("")), clean)
        return F.when(v.isNotNull(), F.struct(part("articleBody").alias("body"), part("description").alias("description"), F.left(part("headline"), F.lit(TITLE)).alias("headline")))

    return let(article, parts)


def _followed(flat: Column, value: Column, name: str) -> Column:
    """The entry of a name in an object of a flat list whose names and values may be places in that list."""
    at = lambda place: F.when(place >= 0, F.get(flat, place))
    named = lambda k: F.when(k.rlike("^_[0-9]{1,9}$"), F.coalesce(_string(at(F.substring(k, 2, 9).try_cast("int")), "$"), k)).otherwise(k)
    fields = F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, v: named(k) == name)
    whole = lambda x: F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "int"))
    return let(F.try_element_at(F.map_values(fields), F.lit(-1)), lambda entry: let(whole(entry), lambda place: F.when(place.isNotNull(), at(place)).otherwise(entry)))


def reference_graph(html: Column) -> Column:
    """struct(body, title) of the post in a page's streamed data: a flat list in which objects' names and values are places in the list. Null if there is none.

    The known route is followed a name at a time, so entries that refer to each other in circles are never walked.
    """
    pieces = let(F.split(html, r"streamController\.enqueue\("), lambda x: F.slice(x, F.lit(2), F.size(x)))
    literals = F.transform(pieces, lambda p: F.regexp_extract(p, r'(?s)^(".*?(?<!\\)(?:\\\\){0,50}")\)', 1))
    lists = F.transform(literals, lambda x: F.try_variant_get(F.try_parse_json(F.try_variant_get(F.try_parse_json(x), "$", "string")), "$", "array<variant>"))

    def post(flat: Column) -> Column:
        def fields(found: Column) -> Column:
            body, title = (let(F.coalesce(_string(_followed(flat, found, name), "$"), F.lit("")), clean) for name in ("content", "title"))
            return F.struct(body.alias("body"), F.left(title, F.lit(TITLE)).alias("title"))

        found = F.get(flat, F.lit(0))
        for name in ROUTE:
            found = _followed(flat, found, name)
        return let(found, fields)

    return F.get(F.filter(F.transform(F.filter(lists, lambda x: x.isNotNull()), post), lambda p: p["body"] != ""), F.lit(0))


def _rich(root: dict) -> str:
    """The text of a rich-text document, blocks ended by an empty line; iterative, so that no depth is too deep."""
    out: list[str] = []
    todo: list[tuple[object, int]] = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif depth > DEEPEST:
            continue
        elif isinstance(node, list):
            todo += [(x, depth + 1) for x in reversed(node) if not isinstance(x, str)]
        elif isinstance(node, dict):
            if isinstance(node.get("value"), str):
                out.append(node["value"])
            elif isinstance(node.get("content"), list):
                if node.get("nodeType") not in INLINE:
                    todo.append(("\n\n", depth))
                todo += [(x, depth + 1) for x in reversed(node["content"]) if not isinstance(x, str)]
    return "".join(out)


def _document(data: object) -> dict | None:
    """The first rich-text document in a page's data, at most eight levels down."""
    todo: list[tuple[object, int]] = [(data, 0)]
    while todo:
        value, depth = todo.pop()
        if depth > 8:
            continue
        if isinstance(value, dict):
            if value.get("nodeType") == "document" and isinstance(value.get("content"), list):
                return value
            todo += [(x, depth + 1) for x in reversed(value.values())]
        elif isinstance(value, list):
            todo += [(x, depth + 1) for x in reversed(value[:64])]
    return None


def _page_data(script: str | None) -> tuple[str, str]:
    try:
        props = json.loads(script or "")["props"]["pageProps"]
    except (ValueError, TypeError, KeyError, RecursionError):
        return "", ""
    root = _document(props) if isinstance(props, dict) else None
    if root is None:
        return "", ""
    titled = [props[k]["title"] for k in ("post", "article", "entry") if isinstance(props.get(k), dict) and isinstance(props[k].get("title"), str)]
    return _rich(root), titled[0] if titled else ""


def rich_text(html: Column) -> Column:
    """struct(body, title) of the rich text in the data that a page's framework starts from; empty strings if there is none."""
    kind = pa.struct([("body", pa.string()), ("title", pa.string())])

    def run(scripts: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("body", "title"), _page_data(x), strict=True)) for x in scripts.to_pylist()], kind)

    script = F.get(_script(html, r"id\s*=\s*[\"']__NEXT_DATA__[\"']"), F.lit(0))
    found = F.arrow_udf(run, "struct<body: string, title: string>")(script)
    return F.struct(clean(found["body"]).alias("body"), F.left(clean(found["title"]), F.lit(TITLE)).alias("title"))


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: dict[str, list[str]] = {"article": [], "main": [], "body": []}
        self.open = dict.fromkeys(self.text, 0)
        self.dropped: list[str] = []

    def parse_html_declaration(self, i: int) -> int:
        """Marked sections are no HTML: skipped up to the next ">"."""
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else i + 3

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CHROME:
            self.dropped.append(tag)
        if tag in self.open:
            self.open[tag] += 1
        if tag in BREAKS:
            self.handle_data("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.dropped:
            while self.dropped.pop() != tag:
                pass
        if tag in BREAKS:
            self.handle_data("\n")
        if tag in self.open:
            self.open[tag] = max(0, self.open[tag] - 1)

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            for tag, parts in self.text.items():
                if self.open[tag] or tag == "body":
                    parts.append(data)


def visible_text(html: Column) -> Column:
    """What a page shows outside its menus, headers, footers and forms: in its article, else its main part, else all of it."""

    def shown(page: str | None) -> str:
        parser = _Visible()
        parser.feed(page or "")
        parser.close()
        texts = ("".join(x) for x in parser.text.values())
        return next((t for t in texts if t.strip()), "")

    found = F.arrow_udf(lambda pages: pa.array([shown(p) for p in pages.to_pylist()], pa.string()), "string")(html)
    return F.regexp_replace(F.regexp_replace(found, r"[ \t\r]*\n[ \t\r\n]*", "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def body(html: Column, least: int = LEAST) -> Column:
    """struct(text, title, source, confidence): the article of a page, from where it is surest.

    Streamed data come first; the article of JSON-LD, then rich text, where they are longer than the visible text; a
    description only where there is hardly any text else. A short text with a mark of refusal is a blocked page. A null
    or broken page has a row too, with an empty text.
    """

    def chosen(x: Column) -> Column:
        graph, linked, rich, shown = x["graph"], x["linked"], x["rich"], F.coalesce(x["shown"], F.lit(""))
        long = lambda c: F.coalesce(F.length(c), F.lit(0))
        made = lambda text, title, source, sure: F.struct(text.alias("text"), F.coalesce(title, F.lit("")).alias("title"), F.lit(source).alias("source"), F.lit(sure).alias("confidence"))
        none = F.lit("")
        low = F.lower(shown)
        refused = (long(shown) < BLOCKED_BELOW) & F.greatest(*[low.contains(m).cast("int") for m in BLOCKED]).cast("boolean")
        return (
            F.when(graph.isNotNull(), made(graph["body"], graph["title"], "reference graph", 0.95))
            .when(long(linked["body"]) > long(shown), made(linked["body"], linked["headline"], "linked data", 0.95))
            .when(long(rich["body"]) > long(shown), made(rich["body"], rich["title"], "rich text", 0.9))
            .when((long(shown) < least) & (long(linked["description"]) >= least), made(linked["description"], linked["headline"], "description", 0.5))
            .when(refused, made(shown, none, "blocked", 0.0))
            .when(shown != "", made(shown, none, "visible", 0.6))
            .otherwise(made(none, none, "none", 0.0))
        )

    parts = F.struct(reference_graph(html).alias("graph"), linked_data(html).alias("linked"), rich_text(html).alias("rich"), visible_text(html).alias("shown"))
    return let(parts, chosen)


def _strings(raw: str | None) -> str | None:
    try:
        todo = [json.loads(raw or "")]
    except (ValueError, RecursionError):
        return None
    out = []
    while todo:
        value = todo.pop()
        if isinstance(value, str):
            if value.strip():
                out.append(value.strip())
        elif isinstance(value, list):
            todo += reversed(value)
        elif isinstance(value, dict):
            todo += [x for k, x in reversed(value.items()) if k.lower() not in NO_NAMES]
    return "\n".join(out)


def json_text(raw: Column) -> Column:
    """All strings of a JSON value of any depth, in their order, a line each, but for those under names such as id or url; null if it is no JSON."""
    return F.arrow_udf(lambda values: pa.array([_strings(v) for v in values.to_pylist()], pa.string()), "string")(raw)


#: Names of the two character sets that Spark reads as Python does.
UTF_8, LATIN_1 = ("utf-8", "utf8", "utf_8"), ("latin-1", "latin1", "iso-8859-1", "iso8859-1", "iso_8859-1")


def _decoded(payload: bytes | None, named: str | None) -> str | None:
    if payload is None:
        return None
    for encoding in (named, "utf-8", "windows-1251", "latin-1"):
        try:
            if encoding:
                return payload.decode(encoding)
        except (LookupError, UnicodeDecodeError, ValueError):
            continue
    return None


def decoded(payload: Column, content_type: Column) -> Column:
    """Bytes as text: by the character set that the content type names, else UTF-8, else Windows-1251, else Latin-1."""
    named = F.nullif(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*[\"']?([^;\s\"']+)", 1), F.lit(""))
    # what Spark can read itself doesn't go to Python, and Python holds one value of a batch at a time
    text, low = payload.cast("string"), F.lower(named)
    plain = F.is_valid_utf8(text) & F.coalesce(low.isin(*UTF_8), F.lit(True))
    narrow = F.coalesce(low.isin(*LATIN_1), F.lit(False))
    run = lambda payloads, names: pa.array((_decoded(p.as_py(), n.as_py()) for p, n in zip(payloads, names, strict=True)), pa.string(), size=len(payloads))
    rest = F.arrow_udf(run, "string")(F.when(~(plain | narrow), payload), named)
    return F.when(narrow, F.decode(payload, "ISO-8859-1")).when(plain, text).otherwise(rest)
