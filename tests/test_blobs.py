"""A store of files by content, and Word and SQLite files, whole and damaged."""

import io
import sqlite3
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.sources import blobs


@pytest.fixture
def store(spark, tmp_path):
    return blobs.Store(spark, f"file://{tmp_path}/store")


def _rows(spark, rows):
    return spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in rows], "name string, content binary")


def test_equal_contents_are_kept_once_and_a_replay_changes_nothing(spark, store):
    rows = _rows(spark, [("a", b"one"), ("b", b"one"), ("c", b"two"), ("c", b"two"), ("d", None), (None, b"x"), ("e", b"")])
    done, states = store.imported(rows)
    assert done and {tuple(r) for r in states.collect()} == {(n, "new") for n in "abce"}
    files = sorted(f for f in spark.read.parquet(f"{store.folder}/blobs").inputFiles())
    done, states = store.imported(rows)
    assert done and {r.state for r in states.collect()} == {"known"}
    assert store.blobs().count() == 3 and store.names().count() == 4
    assert {(r.name, bytes(r.content)) for r in store.read().collect()} == {("a", b"one"), ("b", b"one"), ("c", b"two"), ("e", b"")}
    assert set(files) <= set(spark.read.parquet(f"{store.folder}/blobs").inputFiles())


def test_a_conflict_writes_nothing(spark, store):
    store.imported(_rows(spark, [("a", b"one")]))
    for rows in ([("a", b"other"), ("new", b"new")], [("twice", b"x"), ("twice", b"y"), ("new", b"new")]):
        done, states = store.imported(_rows(spark, rows))
        assert not done and "conflict" in {r.state for r in states.collect()}
        assert store.names().count() == store.blobs().count() == 1


def test_changed_blobs_are_seen(spark, store):
    store.imported(_rows(spark, [("a", b"one"), ("b", b"two")]))
    bad = store.blobs().withColumn("packed", F.max("packed").over(Window.partitionBy()))
    bad.write.parquet(f"{store.folder}/changed")
    other = blobs.Store(spark, store.folder)
    other.blobs = lambda: spark.read.parquet(f"{store.folder}/changed")
    assert sorted(r.content is None for r in other.read().collect()) == [False, True]


def _docx(xml, name=blobs.BODY, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr(name, xml)
        for k, v in more.items():
            archive.writestr(k.replace("__", "/").replace("_xml", ".xml"), v)
    return out.getvalue()


def test_word_files_and_what_is_wrong_with_them(spark):
    w = f'xmlns:w="{blobs.WORD[1:-1]}"'
    good = f"<w:document {w}><w:body><w:p><w:r><w:t>One </w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Größe &amp; more</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    title = '<c:core xmlns:c="x" xmlns:dc="y"><dc:title> The title </dc:title></c:core>'
    cases = {
        "good": (_docx(good, docProps__core_xml=title), ("The title", "One  two\n\nGröße & more", "read")),
        "no archive": (b"not a zip", (None, None, "no archive")),
        "cut": (_docx(good)[:60], (None, None, "no archive")),
        "other": (_docx("x", name="y"), (None, None, "no document inside")),
        "broken": (_docx("<w:document"), (None, None, "unreadable: ParseError")),
        "entities": (_docx('<!DOCTYPE x [<!ENTITY a "b">]><x/>'), (None, None, "unreadable: ValueError")),
        "null": (None, (None, None, "no archive")),
    }
    rows = _rows(spark, [(k, c) for k, (c, _) in cases.items()])
    got = {r.name: (r.w.title, r.w.text, r.w.state) for r in rows.select("name", blobs.word_text(F.col("content")).alias("w")).collect()}
    assert got == {k: want for k, (_, want) in cases.items()}


def _base(rows):
    base = sqlite3.connect(":memory:")
    base.execute('CREATE TABLE "my table" (id INTEGER, text, price)')
    base.executemany('INSERT INTO "my table" VALUES (?, ?, ?)', rows)
    base.commit()
    return base.serialize()


def test_sqlite_files_are_read_in_ranges_and_damaged_ones_give_a_reason(spark):
    many = [(k, f"t{k}", k / 4) for k in range(250)]
    files = _rows(spark, [("many", _base(many)), ("few", _base([(1, None, "no number"), (None, "ü", 2)])), ("none", _base([])), ("damaged", b"SQLite format 3\0" + b"x" * 3000), ("cut", _base(many)[:2500]), ("null", None)])
    columns = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("price", T.DoubleType())])
    found = blobs.sqlite_rows(files, "my table", columns, rows=60)
    got = found.collect()
    assert sorted((r.id, r.text, r.price) for r in got if r.name == "many") == many
    assert {r.row for r in got if r.name == "many"} == set(range(1, 251))
    assert {(r.id, r.text, r.price) for r in got if r.name == "few"} == {(1, None, None), (None, "ü", 2.0)}
    assert {r.name for r in got if r.fault} == {"damaged", "cut", "null"} and "none" not in {r.name for r in got}
    assert all(r.id is None for r in got if r.fault)
    assert {r.fault for r in blobs.sqlite_rows(files.where("name = 'few'"), "absent", columns).collect()} == {"OperationalError"}


def test_a_sqlite_file_is_sent_to_few_tasks_however_many_ranges_it_has(spark):
    assert blobs._spans(1, 225_000, 200, 10 << 20) == [(1, 225_000)]
    assert blobs._spans(1, 1000, 200, 40 << 20) == [(1, 400), (401, 800), (801, 1000)]
    assert len(blobs._spans(1, 10**9, 200, 10 << 30)) == blobs.MOST_SPANS
    base = sqlite3.connect(":memory:")
    base.execute("CREATE TABLE far (id INTEGER PRIMARY KEY)")
    far = [-5, 1, 60, 61, 10**12, 2**62]  # as many ranges as no list can hold
    base.executemany("INSERT INTO far VALUES (?)", [(k,) for k in far])
    base.commit()
    found = blobs.sqlite_rows(_rows(spark, [("far", base.serialize())]), "far", T.StructType([T.StructField("id", T.LongType())]), rows=60)
    assert sorted(r.id for r in found.collect()) == far
