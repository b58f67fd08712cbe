"""A store of files by content, imports that are refused whole on a conflict, and what is in Word and SQLite files."""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Iterator
from contextlib import closing
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.tables import written

# Where a Word file keeps its text, and how large that may be when unpacked.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BODY, PROPERTIES, LARGEST = "word/document.xml", "docProps/core.xml", 64 << 20
# A SQLite file is sent to one more task for each so many bytes, to so many at most.
SPAN_BYTES, MOST_SPANS = 16 << 20, 8


class Store:
    """Blobs named by the digest of their content, each kept once, and names that point to them and never change. One writer at a time.

    Blobs are written before the names that point to them, so a lost run leaves at most blobs without a name, and running
    it again ends in the same store. Contents are compressed by Parquet, so no Python holds them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], schema)
            raise

    def names(self) -> DataFrame:
        return self._table("names", "name string, sha256 string")

    def blobs(self) -> DataFrame:
        return self._table("blobs", "sha256 string, size long, packed binary")

    def read(self) -> DataFrame:
        """(name, sha256, content) of everything; content whose digest is no longer its name's is null."""
        found = self.names().join(self.blobs(), "sha256", "left")
        return found.select("name", "sha256", F.when(F.sha2("packed", 256) == F.col("sha256"), F.col("packed")).alias("content"))

    def imported(self, rows: DataFrame) -> tuple[bool, DataFrame]:
        """Adds rows(name, content), all or nothing; whether it did, and (name, state) of each name: new, known, or conflict.

        A name that has, or is given, two contents is a conflict, and then nothing is written. Rows without a name or content are left out.
        """
        given = written(rows.select("name", F.sha2("content", 256).alias("sha256"), "content"), "import")
        # not before: Spark would make a content that comes from Python once for this filter and once more for the table
        given = given.where(F.col("name").isNotNull() & F.col("content").isNotNull())
        named = given.groupBy("name").agg(F.min("sha256").alias("sha256"), F.max("sha256").alias("other"))
        old = self.names().withColumnRenamed("sha256", "old")
        state = F.when((F.col("sha256") != F.col("other")) | (F.col("old") != F.col("sha256")), "conflict").when(F.col("old").isNotNull(), "known").otherwise("new")
        states = written(named.join(old, "name", "left").select("name", "sha256", state.alias("state")), "import-states")
        if states.where("state = 'conflict'").limit(1).count():
            return False, states.select("name", "state")
        # one content a digest; only contents that the store lacks are written
        fresh = given.select("sha256", "content").join(self.blobs().select("sha256"), "sha256", "left_anti").groupBy("sha256").agg(F.first("content").alias("content"))
        fresh.select("sha256", F.length("content").cast("long").alias("size"), F.col("content").alias("packed")).write.mode("append").option("compression", "gzip").parquet(f"{self.folder}/blobs")
        states.where("state = 'new'").select("name", "sha256").write.mode("append").parquet(f"{self.folder}/names")
        return True, states.select("name", "state")


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if archive.getinfo(name).file_size > LARGEST:
        raise ValueError("too large")
    body = archive.read(name)
    if b"<!DOCTYPE" in body or b"<!ENTITY" in body:
        raise ValueError("declares entities")
    return ElementTree.fromstring(body)


def _word(content: bytes | None) -> dict:
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
            paragraphs = []
            for p in _xml(archive, BODY).iter(f"{WORD}p"):
                parts = [x.text or "" if x.tag == f"{WORD}t" else " " for x in p.iter() if x.tag in (f"{WORD}t", f"{WORD}tab", f"{WORD}br")]
                paragraphs.append("".join(parts).strip())
            title = ""
            if PROPERTIES in archive.namelist():
                title = next((x.text.strip() for x in _xml(archive, PROPERTIES).iter() if x.tag.endswith("}title") and x.text), "")
            return {"title": title, "text": "\n\n".join(p for p in paragraphs if p), "state": "read"}
    except zipfile.BadZipFile:
        return {"title": None, "text": None, "state": "no archive"}
    except KeyError:
        return {"title": None, "text": None, "state": "no document inside"}
    except (ElementTree.ParseError, ValueError, OSError, NotImplementedError, RuntimeError) as error:
        return {"title": None, "text": None, "state": f"unreadable: {type(error).__name__}"}


def word_text(content: Column) -> Column:
    """struct(title, text, state) of a Word file: its paragraphs, empty lines between them; a damaged file has a state and no text."""
    kind = pa.struct([("title", pa.string()), ("text", pa.string()), ("state", pa.string())])
    return F.arrow_udf(lambda values: pa.array([_word(v.as_py()) for v in values], kind), "struct<title: string, text: string, state: string>")(content)


def _opened(content: bytes | None) -> sqlite3.Connection:
    if not content:
        raise sqlite3.DatabaseError("empty")
    base = sqlite3.connect(":memory:")
    base.deserialize(content)
    base.execute("PRAGMA query_only = 1")
    return base


def _spans(low: int, high: int, rows: int, size: int) -> list[tuple[int, int]]:
    """Row ids low to high in spans of whole ranges of `rows`: one for each SPAN_BYTES of the file, at most MOST_SPANS."""
    ranges = -(-(high - low + 1) // rows)
    step = -(-ranges // min(ranges, MOST_SPANS, max(1, -(-size // SPAN_BYTES)))) * rows
    return [(k, min(k + step - 1, high)) for k in range(low, high + 1, step)]


def sqlite_rows(files: DataFrame, table: str, columns: StructType, rows: int = 100_000) -> DataFrame:
    """(name, row, fault, columns) of a table in SQLite files given as (name, content), read-only.

    A file's rows are read in ranges of `rows` row ids. Consecutive ranges make up spans, each read by a task of its own,
    so that one large file is no single task; a span costs one copy of the file's bytes, so there are few of them (see
    _spans), however many ranges there are. A file that is no database or lacks the table has one row with the fault.
    Values are cast to the columns' types by Spark.
    """
    text = ", ".join(f"{f.name} string" for f in columns)
    quoted = '"' + table.replace('"', '""') + '"'

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                try:
                    with closing(_opened(content)) as base:
                        low, high = base.execute(f"SELECT min(rowid), max(rowid) FROM {quoted}").fetchone()
                    out = [] if low is None else [(name, *span, None) for span in _spans(low, high, rows, len(content))]
                except sqlite3.Error as error:
                    out = [(name, None, None, type(error).__name__)]
                yield pd.DataFrame(out, columns=["name", "low", "high", "fault"]).astype({"low": "Int64", "high": "Int64"})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chosen = ", ".join(f'CAST("{f.name}" AS TEXT)' for f in columns)
        for batch in batches:
            for name, content, low, high in zip(batch["name"], batch["content"], batch["low"], batch["high"], strict=True):
                at, high = int(low), int(high)
                with closing(_opened(content)) as base:
                    while at <= high:
                        try:
                            found = base.execute(f"SELECT rowid, {chosen} FROM {quoted} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (at, min(at + rows - 1, high))).fetchall()
                            yield pd.DataFrame([(name, r[0], None, *r[1:]) for r in found], columns=["name", "row", "fault", *columns.names])
                            if not found:  # row ids may lie far apart
                                following = base.execute(f"SELECT min(rowid) FROM {quoted} WHERE rowid BETWEEN ? AND ?", (at, high)).fetchone()[0]
                                if following is None:
                                    break
                                at += (following - at) // rows * rows
                                continue
                        except sqlite3.Error as error:
                            yield pd.DataFrame([(name, None, type(error).__name__, *[None] * len(columns))], columns=["name", "row", "fault", *columns.names])
                        at += rows

    parts = written(files.mapInPandas(bounds, "name string, low long, high long, fault string"), "sqlite-spans")
    dealt = parts.where("fault is null").join(files, "name").repartition("name", "low").select("name", "content", "low", "high")
    got = dealt.mapInPandas(read, f"name string, row long, fault string, {text}")
    bad = parts.where("fault is not null").select("name", F.lit(None).cast("long").alias("row"), "fault", *[F.lit(None).cast("string").alias(c) for c in columns.names])
    return got.unionByName(bad).select("name", "row", "fault", *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in columns])
