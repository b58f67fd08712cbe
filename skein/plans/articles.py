"""Queries of article bodies inside pages' scripts, strings of JSON, bytes of unknown character sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import articles
from skein.plans.registry import query
from skein.session import table

KINDS = 9


def _pages(docs: DataFrame) -> DataFrame:
    """Every document as a page of one of nine kinds: its text in JSON-LD (alone, in a list, in a graph, broken), in streamed data, in rich text, as a description, and visible."""
    text, head = F.coalesce("text", F.lit("")), F.concat(F.lit("Title "), F.col("doc_id").cast("string"))
    as_json = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    node = F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), text.alias("articleBody"), head.alias("headline")))
    ld = lambda body: F.concat(F.lit('<script type="application/ld+json">'), F.replace(body, F.lit("</"), F.lit("<\\/")), F.lit("</script>"))
    quoted = F.substr(as_json(x=text), F.lit(6), F.length(as_json(x=text)) - 6)
    flat = F.concat(F.lit('[{"_1":2},"loaderData",{"_3":4,"back":0},"routes/$slug",{"_5":6},"post",{"_7":8,"title":9},"content",'), quoted, F.lit(","), F.concat(F.lit('"'), head, F.lit('"')), F.lit("]"))
    literal = F.substr(as_json(x=flat), F.lit(6), F.length(as_json(x=flat)) - 6)
    leaf = F.array(F.struct(F.lit("text").alias("nodeType"), text.alias("value")))
    paragraph = F.array(F.struct(F.lit("paragraph").alias("nodeType"), leaf.alias("content")))
    props = F.struct(F.struct(head.alias("title"), F.struct(F.lit("document").alias("nodeType"), paragraph.alias("content")).alias("body")).alias("post"))
    shapes: list[Column] = [
        ld(node), ld(F.concat(F.lit('[{"@type":"WebSite"},['), node, F.lit("]]"))), ld(F.concat(F.lit('{"@graph":[{"@type":"Person"},{"@graph":['), node, F.lit("]}]}"))),
        ld(F.left(node, F.greatest(F.lit(1), F.length(node) - 5))), ld(as_json(**{"@type": F.array(F.lit("Thing"), F.lit("Report")), "description": text, "articleBody": F.lit(7)})),
        F.concat(F.lit("<script>x.streamController.enqueue("), F.replace(literal, F.lit("</"), F.lit("<\\/")), F.lit(");</script>")),
        F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), F.replace(as_json(props=F.struct(props.alias("pageProps"))), F.lit("</"), F.lit("<\\/")), F.lit("</script>")),
        F.concat(F.lit("<p>"), F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>")), F.lit("<p>Just a moment...</p>"),
    ]
    cases = [F.when(F.col("doc_id") % KINDS == k, shape) for k, shape in enumerate(shapes)]
    return docs.select("doc_id", F.concat(F.lit("<html><body><nav>Menu</nav>"), F.coalesce(*cases), F.lit("</body></html>")).alias("html"))


_TRIM = r"regexp_replace(regexp_replace({0}, '[ \t\r]*\n[ \t\r\n]*', '\n', 'g'), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
_CLEAN = _TRIM.format("replace(replace(replace(replace(replace(replace(CASE WHEN contains(text, '<') AND contains(text, '>') THEN regexp_replace(text, '<[^>]*>', '\n', 'g') ELSE text END, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')").replace("\n", "\\n")


@query(
    rf"""
WITH d AS (SELECT doc_id, doc_id % 9 AS k, coalesce(text, '') AS text FROM documents), c AS (SELECT doc_id, k, {_CLEAN} AS clean, {_TRIM.format("text")} AS shown FROM d),
r AS (SELECT doc_id, CASE WHEN k = 5 AND clean <> '' THEN 'reference graph' WHEN k < 3 AND clean <> '' THEN 'linked data' WHEN k = 6 AND clean <> '' THEN 'rich text' WHEN k = 4 AND length(clean) >= 500 THEN 'description' WHEN k = 8 THEN 'blocked' WHEN k = 7 AND shown <> '' THEN 'visible' ELSE 'none' END AS source, k, clean, shown FROM c)
SELECT doc_id, source, CASE source WHEN 'none' THEN '' WHEN 'visible' THEN shown WHEN 'blocked' THEN 'Just a moment...' ELSE clean END AS text, CASE WHEN source IN ('reference graph', 'linked data', 'rich text') THEN 'Title ' || doc_id ELSE '' END AS title,
CASE source WHEN 'reference graph' THEN 0.95 WHEN 'linked data' THEN 0.95 WHEN 'rich text' THEN 0.9 WHEN 'description' THEN 0.5 WHEN 'visible' THEN 0.6 ELSE 0 END::DOUBLE AS confidence FROM r
""".replace("\\n", "\n").replace("\\t", "\t").replace("\\r", "\r")
)
def article_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article in each of nine kinds of page made from all documents, with where it was found and how sure that is."""
    pages = _pages(table(spark, sf_dir, "documents"))
    return pages.select("doc_id", articles.body(F.col("html")).alias("a")).select("doc_id", "a.source", "a.text", "a.title", "a.confidence")


@query("""
SELECT conv_id, string_agg(trim(text), chr(10) ORDER BY turn, role, text) FILTER (WHERE trim(text) <> '') AS text FROM conversations GROUP BY conv_id
""")
def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested JSON, and all the strings in it but names and ids."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("name"), F.col("text").alias("text")))).alias("t"))
    nested = F.to_json(F.struct(F.concat(F.lit("conv "), "conv_id").alias("id"), F.struct(F.transform("t", lambda x: F.struct(x["name"].alias("name"), F.array(F.struct(x["text"].alias("body"))).alias("parts"))).alias("turns")).alias("data")))
    return turns.select("conv_id", F.nullif(articles.json_text(nested), F.lit("")).alias("text"))


@query("""
SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE lang <> 'xx'
""")
def charset_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes in UTF-8, or in Latin-1 as their type says where that can hold them, read again."""
    docs = table(spark, sf_dir, "documents").where("lang <> 'xx'").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    narrow = (F.col("doc_id") % 2 == 0) & ~F.col("text").rlike(r"[^\x{00}-\x{FF}]")
    payload = F.when(narrow, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    kind = F.when(narrow, "text/html; Charset='latin-1'").when(F.col("doc_id") % 3 == 0, "text/plain; charset=no-such-set").otherwise("text/html")
    return docs.select("doc_id", articles.decoded(payload, kind).alias("text"))
