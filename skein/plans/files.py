"""Queries of a store of files: imports, Word files, SQLite files and what an older store becomes."""

from __future__ import annotations

import io
import sqlite3
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators import ranges
from skein.plans.registry import query
from skein.session import table
from skein.sources import blobs
from skein.tables import shared_folder, written


def _as_word(text: Column) -> Column:
    """Texts as Word files, a paragraph a line."""

    def made(value: str | None) -> bytes:
        out = io.BytesIO()
        lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in (value or "").split("\n"))
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr(zipfile.ZipInfo(blobs.BODY), f'<w:document xmlns:w="{blobs.WORD[1:-1]}"><w:body>{lines}</w:body></w:document>')
        return out.getvalue()

    return F.arrow_udf(lambda values: pa.array([made(v.as_py()) for v in values], pa.binary()), "binary")(text)


_LINES = "list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g'), chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(160))), lambda x: x <> '')"


@query(f"""
SELECT doc_id, CASE WHEN doc_id % 20 = 7 THEN 'no archive' ELSE 'read' END AS state, CASE WHEN doc_id % 20 <> 7 THEN array_to_string({_LINES}, chr(10) || chr(10)) END AS text FROM documents WHERE text IS NOT NULL
""")
def word_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Word files, some of them damaged, imported into a store that keeps equal files once, and read from it."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    clean = F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    content = F.when(F.col("doc_id") % 20 == 7, F.encode(F.lit("damaged"), "UTF-8")).otherwise(_as_word(clean))
    store = blobs.Store(spark, f"{shared_folder(spark)}/skein-store-{uuid.uuid4().hex}")
    store.imported(docs.select(F.col("doc_id").cast("string").alias("name"), content.alias("content")))
    found = store.read().select(F.col("name").cast("long").alias("doc_id"), blobs.word_text(F.col("content")).alias("w"))
    return found.select("doc_id", "w.state", "w.text")


@query("""
WITH d AS (SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL), f AS (SELECT count(DISTINCT doc_id) AS names, count(DISTINCT text) AS contents FROM d)
SELECT * FROM (SELECT 1 AS step, 'imported' AS result, names AS new, 0 AS known, 0 AS conflicts, contents AS blobs FROM f UNION ALL SELECT 2, 'imported', 0, names, 0, contents FROM f UNION ALL SELECT 3, 'refused', 10, names - 1, 1, contents FROM f UNION ALL SELECT 4, 'imported', 10, names, 0, contents + 1 FROM f)
""")
def store_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store over all documents: an import, its replay, an import with a changed name that is refused whole, and a good one."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("content"))
    store = blobs.Store(spark, f"{shared_folder(spark)}/skein-store-{uuid.uuid4().hex}")
    more = spark.range(10).select(F.concat(F.lit("more "), "id").alias("name"), F.encode(F.lit("the same content of them all"), "UTF-8").alias("content"))
    first = docs.agg(F.min("name")).first()[0]
    changed = docs.select("name", F.when(F.col("name") == first, F.encode(F.lit("another content"), "UTF-8")).otherwise(F.col("content")).alias("content"))
    out = []
    for step, rows in enumerate((docs, docs, changed.unionByName(more), docs.unionByName(more)), 1):
        done, states = store.imported(rows)
        counts = states.agg(*[F.count_if(F.col("state") == s).alias(n) for s, n in (("new", "new"), ("known", "known"), ("conflict", "conflicts"))])
        stored = written(store.blobs().agg(F.count("*").alias("blobs")), "blob-count")
        out.append(counts.select(F.lit(step).alias("step"), F.lit("imported" if done else "refused").alias("result"), "new", "known", "conflicts").join(F.broadcast(stored)))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


_COLUMNS = T.StructType([T.StructField("orderkey", T.LongType()), T.StructField("status", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("day", T.DateType())])


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate::DATE AS day, o_orderkey % 40 AS file FROM orders), r AS (SELECT 'base ' || file AS name, o_orderkey AS orderkey, o_orderstatus AS status, o_totalprice AS price, day, NULL AS fault FROM o WHERE file % 10 <> 3 UNION ALL SELECT 'base ' || file, NULL, NULL, NULL, NULL, 'DatabaseError' FROM (SELECT DISTINCT file FROM o WHERE file % 10 = 3))
SELECT name, orderkey, status, price, day, fault, CASE WHEN fault IS NULL THEN row_number() OVER (PARTITION BY day, fault ORDER BY orderkey) END AS sort_order, CASE WHEN fault IS NULL THEN 'order_' || left(sha256('legacy|' || orderkey), 24) END AS new_id FROM r
""")
def sqlite_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in SQLite files, some damaged, read in ranges of rows and imported: new ids from old ones, and a running order within each day."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey is not null").select(F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.to_date("o_orderdate").cast("string").alias("day"), (F.col("o_orderkey") % 40).alias("file"))

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, base = None, None

        def content() -> pd.DataFrame:
            base.commit()
            whole = base.serialize()
            base.close()
            return pd.DataFrame({"name": [f"base {now}"], "content": [whole[: len(whole) // 3] + b"\0" * 500 if now % 10 == 3 else whole]})

        for batch in batches:  # sorted by file
            for file, rows in batch.groupby("file"):
                if file != now:
                    if base:
                        yield content()
                    now, base = int(file), sqlite3.connect(":memory:")
                    base.execute("CREATE TABLE issues (orderkey INTEGER, status TEXT, price REAL, day TEXT)")
                base.executemany("INSERT INTO issues VALUES (?, ?, ?, ?)", rows[["orderkey", "status", "price", "day"]].astype(object).values.tolist())
        if base:
            yield content()

    bases = written(orders.repartition("file").sortWithinPartitions("file").mapInPandas(made, "name string, content binary"), "bases")
    rows = written(blobs.sqlite_rows(bases, "issues", _COLUMNS, rows=200).select("name", "fault", *_COLUMNS.names).where("fault is null or orderkey is null"), "base-rows")
    parted = ranges.ranged(rows.where("fault is null").withColumn("one", F.lit(1)), ["day"], ["orderkey"])
    good = ranges.running(parted, ["day"], ["orderkey"], "one", "sort_order").select("name", *_COLUMNS.names, "fault", "sort_order", F.concat(F.lit("order_"), F.left(F.sha2(F.concat(F.lit("legacy|"), "orderkey"), 256), F.lit(24))).alias("new_id"))
    bad = rows.where("fault is not null").distinct().select("name", *_COLUMNS.names, "fault", F.lit(None).cast("long").alias("sort_order"), F.lit(None).cast("string").alias("new_id"))
    return good.unionByName(bad)
