"""What would grow faster than its input: pairs that are shuffled, batches of whole texts, repeated work."""

import math
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.functions import articles, stems
from skein.operators import joining, journal, merging, passages, retrieval, stories
from skein.sources import blobs
from test_stories import SCHEMA, _events


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_for_review_are_no_join_and_titles_are_bounded_as_the_matcher_has_them(spark):
    pairs = stories.for_review(spark.createDataFrame(_events(random.Random(3), 40), SCHEMA))[1]
    assert "Join" not in _plan(pairs) and "Aggregate" not in _plan(pairs)
    rng = random.Random(5)
    titles = [" ".join(rng.choice(["north", "river", "stone", "a", "of"]) for _ in range(rng.choice([4, 9, 12, 60]))) for _ in range(40)]
    titles += [t[:k] + rng.choice(["", " ", "x", t[k : k + 1] * 2]) + t[k + 1 :] for t in titles for k in (1, len(t) // 2)]
    block = stories._Titles(pa.chunked_array([titles]))
    found = 0
    for r, mine in enumerate(titles):
        some = np.array([k for k in range(len(titles)) if k != r])
        want = {k for k in some if len(titles[min(k, r)].split(" ")) >= stories.TITLE_WORDS and SequenceMatcher(None, titles[min(k, r)], titles[max(k, r)]).ratio() >= stories.TITLES}
        assert set(block.like(block, r, some, some < r).tolist()) == want, mine
        found += len(want)
    assert found > 50


def test_rows_that_share_items_are_counted_where_they_meet(spark):
    rng = random.Random(7)
    rows = [(rng.randint(0, 60), [rng.choice(["a", "b", "c", *map(str, range(30))]) for _ in range(rng.randint(0, 9))] + ([None] if k % 9 == 0 else [])) for k in range(90)] + [(None, ["a", "b", "29"])]
    rows = [(k, w, 0.5 * len(set(w) - {None})) for k, w in rows]
    df = spark.createDataFrame(rows, "id long, w array<string>, need double").repartition(5)
    flat = [(k, x) for k, w, _ in rows for x in set(w) - {None}]
    many = Counter(x for _, x in flat)
    want = Counter((a, b) for a, x in flat for b, y in flat if x == y and 2 <= many[x] <= 25 and a is not None and b is not None and a < b)
    need = {k: min(n for j, w, n in rows if j == k and set(w) - {None}) for k, _ in flat if k is not None}
    for least, column in ((1, None), (2, None), (1, "need")):
        pairs = joining.sharing(df, "id", "w", least, 25, column)
        assert "Aggregate" not in _plan(pairs) and "Join" not in _plan(pairs)
        assert {(r.a, r.b): r.shared for r in pairs.collect()} == {p: n for p, n in want.items() if n >= least and (column is None or n >= min(need[p[0]], need[p[1]]))}


def test_a_text_is_parted_into_words_once_for_all_questions_and_passages_are_of_the_best(spark):
    docs = spark.createDataFrame([(k, f"the river {'stones ' * (k % 3)}run north of winters", "en") for k in range(30)], "id long, text string, lang string")
    asked = spark.createDataFrame([(q, "en", w) for q, w in enumerate((["river"], ["stone", "winter"], ["running", "north"]))], "query int, language string, words array<string>")
    found = passages.stemmed_search(docs, "id", "text", "lang", asked, 2, every=False)
    assert "LeftSemi" in _plan(found) and "Window" not in _plan(found)  # the best are known, and only their texts are read for passages
    got = found.collect()
    assert {(r.query, r.nth): r.id for r in got} == {(0, 1): 0, (0, 2): 1, (1, 1): 0, (1, 2): 3, (2, 1): 0, (2, 2): 1}
    assert all(r.passage.startswith("the river") and r.matched == (2 if r.query == 2 else 1) for r in got)


def test_only_distinct_words_are_stemmed_whatever_is_asked_of_the_stems(spark):
    rows = spark.createDataFrame([(w, "en") for w in ("stones", "stone", "stones")], "word string, language string")
    found = stems.stemmed(rows, "word", "language").where("stem is not null")
    assert "Aggregate" not in _plan(found)  # the filter would be moved below it
    assert sorted(tuple(r) for r in found.collect()) == [("en", "stone", "stone"), ("en", "stones", "stone")]


def test_an_import_makes_each_content_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def content(values: pa.Array) -> pa.Array:
        made.add(len(values))
        return pa.array([None if v.as_py() == 3 else b"content" for v in values], pa.binary())

    rows = spark.range(6).select(F.col("id").cast("string").alias("name"), F.arrow_udf(content, "binary")("id").alias("content"))
    done, states = blobs.Store(spark, str(tmp_path / "store")).imported(rows)
    assert done and states.count() == 5 and made.value == 6


def test_postings_are_counted_within_their_documents_and_shuffled_once_for_the_index(spark, tmp_path):
    texts = ["The stone, the river; the STONE_1 the", "", None, "... !", "é É e a", "word " * 300 + "other", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    rows = retrieval.postings(docs, "id", "text")
    assert "Aggregate" not in _plan(rows) and _plan(rows).count("regexp_extract_all") == 1
    words = {k: re.findall(r"\w+", (t or "").lower()) for k, t in enumerate(texts)}
    want = {(w, k, n, len(found)) for k, found in words.items() for w, n in Counter(found).items()}
    assert sorted(tuple(r) for r in rows.collect()) == sorted(want)
    retrieval.indexed(docs, "id", "text", str(tmp_path / "index"))
    kept = spark.read.parquet(str(tmp_path / "index" / "postings"))
    assert {(r.term, r.id, r.tf, r.length) for r in kept.collect()} == want and kept.count() == len(want)
    n, mean = len(texts), sum(map(len, words.values())) / sum(t is not None for t in texts)
    score = lambda tf, df, length: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    got = {r.id: r.score for r in retrieval.from_index(spark, str(tmp_path / "index"), "id", ["the", "a"]).collect()}
    assert got == {0: pytest.approx(score(4, 1, 7)), 4: pytest.approx(score(1, 2, 4)), 6: pytest.approx(score(1, 2, 1))}


def test_entries_of_a_journal_stay_with_their_blocks_until_they_have_links(spark):
    entries = [(j, n, f"p{n % 7}", {"more": n}) for j in ("a", None) for n in range(40)] + [("a", None, "no number", None)]
    rows = spark.createDataFrame(entries, "j string, n int, payload string, rest map<string,int>").repartition(3)
    made = journal.linked(rows, "j", "n", "payload", block=4)
    assert made.columns == ["j", "n", "payload", "rest", "link"] and made.schema["n"] == rows.schema["n"]
    assert _plan(made).count("Join ") == 1 and "Aggregate" not in _plan(made)  # what comes before a block, and no second meeting of rows and links
    got = made.collect()
    assert sorted((str(r.j), r.n, r.payload, r.rest["more"]) for r in got) == sorted((str(j), n, p, x["more"]) for j, n, p, x in entries if n is not None)
    assert len({r.link for r in got}) == 40
    stored = spark.createDataFrame([(r.j, r.n, ("p4" if r.n == 3 else "p3" if r.n == 4 else r.payload) if r.j else r.payload, r.link) for r in got if r.j or r.n != 20], "j string, n int, payload string, link string")
    heads = spark.createDataFrame([("a", 40), (None, 40)], "j string, many long")
    found = journal.first_breaks(stored, heads, "j", "n", "payload", block=4)
    assert {(r.j, r.n, r.fault) for r in found.collect()} == {("a", 3, "swapped"), (None, 20, "lost")}


def test_what_is_known_is_grouped_with_the_feed_and_not_sorted_for_a_join(spark):
    state = spark.createDataFrame([(1, "x", "old", 1.0), (1, "x", "copy", 2.0), (None, "y", "null key", 3.0)], "a long, b string, who string, w double")
    feed = spark.createDataFrame([(1, "x", "new", 0.0), (None, "y", "new", 0.0), (None, None, "later", 5.0), (None, None, "first", 6.0), (2, "x", None, 7.0), (2, "x", "last", 1.0)], "a int, b string, who string, w double")
    got = merging.inserted(state, feed, ["a", "b"], ["who"])
    assert "Join" not in _plan(got) and "RepartitionByExpression" in _plan(got) and got.schema["a"].dataType == state.schema["a"].dataType
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [*map(tuple, state.collect()), (None, None, "first", 6.0), (2, "x", None, 7.0)]))
    keys = merging.inserted(state.select("a", "b"), feed.select("a", "b"), ["a", "b"], [])
    assert "Join" not in _plan(keys)
    assert sorted(map(str, map(tuple, keys.collect()))) == sorted(map(str, [(1, "x"), (1, "x"), (None, "y"), (None, None), (2, "x")]))


def test_contents_of_a_store_are_packed_and_read_without_python(spark, tmp_path):
    store = blobs.Store(spark, str(tmp_path / "store"))
    store.imported(spark.createDataFrame([("a", bytearray(b"text " * 20_000)), ("b", bytearray())], "name string, content binary"))
    assert "Python" not in store.read()._jdf.queryExecution().executedPlan().toString()
    assert {r.name: bytes(r.content) for r in store.read().collect()} == {"a": b"text " * 20_000, "b": b""}
    assert sum(f.stat().st_size for f in (tmp_path / "store" / "blobs").glob("*.parquet")) < 10_000


def test_only_bytes_that_spark_cannot_read_go_to_python(spark):
    cases = [(b, kind) for b in (None, b"", "Größe €".encode(), "Größe".encode("latin-1"), "Слово".encode("windows-1251"), b"\x98", b"\xed\xa0\x80", b"\xc0\x80", b"\xef\xbb\xbfx\0y", "😀".encode()) for kind in (None, "text/html", "x; charset=UTF-8", "x; Charset='latin-1'", "x; charset=ISO-8859-1", "x; charset=none-such", "x; charset=utf-16")]
    rows = spark.createDataFrame([(k, None if b is None else bytearray(b), kind) for k, (b, kind) in enumerate(cases)], "k int, b binary, kind string").repartition(2)
    names = [None, None, "utf-8", "latin-1", "latin-1", "none-such", "utf-16"]
    got = {r.k: r.text for r in rows.select("k", articles.decoded(F.col("b"), F.col("kind")).alias("text")).collect()}
    assert got == {k: articles._decoded(b, names[k % 7]) for k, (b, _) in enumerate(cases)}
    plan = _plan(rows.select(articles.decoded(F.col("b"), F.col("kind")).alias("text")))
    assert "isvalid" in plan.lower()
