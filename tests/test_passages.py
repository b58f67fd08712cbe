"""Covers, passages and their offsets; clauses against their evidence."""

import itertools
import random

from pyspark.sql import functions as F

from skein.operators import evidence, passages, retrieval


def test_covers_are_all_smallest_stretches():
    rng = random.Random(1)
    for _ in range(300):
        places = sorted({(rng.randint(0, 40), rng.choice("abc")) for _ in range(rng.randint(1, 9))})
        places = [next(g) for _, g in itertools.groupby(places, key=lambda x: x[0])]
        wanted = {t for _, t in places}
        full = [(a, b) for a in range(len(places)) for b in range(a, len(places)) if {t for _, t in places[a : b + 1]} == wanted]
        smallest = [(a, b) for a, b in full if not any((c, d) != (a, b) and a <= c and d <= b for c, d in full)]
        assert passages.covers(places) == smallest


def test_passages_reproduce_their_text(spark):
    rng = random.Random(2)
    filler = ["lorem", "ipsum", "Größe", "🎉", "dolor,", "sit\n", "amet."]
    rows = []
    for k in range(60):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 150))]
        for t in ("alpha", "Beta", "gamma"):
            for _ in range(rng.randint(0, 2)):
                words.insert(rng.randint(0, len(words)), t)
        rows.append((k, "  ".join(words)))
    rows += [(100, None), (101, ""), (102, "alpha"), (103, "alpha " + "x " * 500 + "beta"), (104, "z" * 100_000)]
    docs = spark.createDataFrame(rows, "id long, text string")
    asked = spark.createDataFrame([(1, ["alpha", "beta", "gamma"]), (2, None)], "query long, terms array<string>")
    hits = docs.select(F.explode(F.array(F.lit(1), F.lit(2)).cast("array<long>")).alias("query"), "id")
    found = passages.with_passages(hits, asked, docs, "id", "text")
    checked = passages.verified(found, docs, "id", "text").collect()
    assert len(checked) == 2 * len(rows)
    text = dict(rows)
    for r in checked:
        whole = text[r.id] or ""
        assert whole[r.start : r.end] == r.passage and (r.holds or text[r.id] is None)
        words = passages._WORD.findall(r.passage)
        if r.centred:
            assert len(words) <= passages.MOST and len(words) >= min(passages.LEAST, len(passages._WORD.findall(whole)))
            if r.last - r.first < passages.MOST:
                assert {w.lower() for w in words} & {"alpha", "beta", "gamma"} and len({w.lower() for w in words} & {"alpha", "beta", "gamma"}) == r.matched
        else:
            assert r.query == 2 or r.matched == 0
    moved = docs.select("id", F.concat(F.lit("x"), "text").alias("text"))
    assert not any(r.holds for r in passages.verified(found.where("length(passage) between 2 and 500"), moved.where("id < 60"), "id", "text").where("id < 60").collect() if "alpha" in r.passage)


def test_each_failed_clause_names_what_is_unsupported(spark):
    clauses = spark.createDataFrame([(1, 'It grew 1,234.5 % by €7 and "a rather long quotation said so" at Acme-X'), (2, "no facts here"), (3, "It has 5 and 5"), (4, None)], "clause long, text string")
    cited = spark.createDataFrame([(1, 10), (1, 11), (1, 10), (3, 10)], "clause long, source long")
    sources = spark.createDataFrame([(10, "Grew 1 234.5 and 5 in a rather long quotation said so."), (11, "It paid 7 € at Acme"), (12, "Acme-X %")], "source long, text string")
    got = {(r.clause, r.kind, r.token) for r in evidence.unsupported(clauses, cited, sources, "clause", "source", "text").collect()}
    assert got == {(1, "symbol", "%"), (1, "name", "Acme-X"), (3, "name", "It")}
    assert evidence.unfound_quotations(clauses, cited, sources, "clause", "source", "text").count() == 0
    assert [tuple(r) for r in evidence.unfound_quotations(clauses, cited.where("source = 11"), sources, "clause", "source", "text").collect()] == [(1, "a rather long quotation said so")]
    # translations: the same tokens, as often
    both = spark.createDataFrame([(1, 1), (2, 2)], "clause long, source long")
    after = spark.createDataFrame([(1, "5 and 5 cost 3 $"), (2, "12,5 %")], "clause long, text string")
    before = spark.createDataFrame([(1, "5 kosten 3 $"), (2, "12.5 %")], "source long, text string")
    rows = evidence.unsupported(after, both, before, "clause", "source", "text", same_count=True).collect()
    assert [(r.clause, r.kind, r.token, r.wanted, r.had) for r in rows] == [(1, "number", "5", 2, 1)]


def test_many_questions_find_the_same_with_few_and_with_many_terms(spark, monkeypatch):
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, " ".join(rng.choices("abcdefghij", k=rng.randint(0, 30)))) for k in range(80)], "id long, text string")
    asked = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "zz"]), (3, []), (4, None)], "query long, terms array<string>")
    run = lambda: sorted(map(tuple, retrieval.batch_search(docs, "id", "text", asked, 5).collect()))
    few = run()
    monkeypatch.setattr(retrieval, "LISTED", 0)
    assert run() == few and len(few) == 10
    assert retrieval.batch_search(docs, "id", "text", asked.where("query > 2"), 5).count() == 0
