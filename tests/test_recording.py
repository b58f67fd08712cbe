"""Batches recorded beside earlier ones, against plain versions: odd rows, empty tables, batches that come again."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators import merging, recording

RUNS = {"runs": "run long, status string, attempts long", "evidence": "run long, item int", "candidates": "run long, item int, reason string, status string"}
READ = {"readings": "statement long, kind string, admission string, valid_until date", "placements": "statement long, subject string", "gaps": "statement long, missing string"}
NAMED = {"entities": "kind string, name string", "mentions": "statement long, kind string, name string, role string, form string", "aliases": "kind string, name string, alias string", "reads": "statement long"}
PAIRS = {"links": "a long, b long, link string, judge string", "alone": "a long, b long, judge string"}
IDEAS = {"ideas": "idea string, statements long, sources long, unknown long, admitted boolean", "evidence": "idea string, statement long"}
QUOTES = {"published": "claim long, sources int", "quarantine": "claim long, condition string, state string"}


def empty(spark, schemas):
    return {k: spark.createDataFrame([], s) for k, s in schemas.items()}


def rows(tables):
    return {k: sorted((tuple(r) for r in df.collect()), key=repr) for k, df in tables.items()}


def test_runs_are_tried_again_only_if_they_failed(spark):
    rng = random.Random(3)
    recorded, state = empty(spark, RUNS), {}
    evidence, candidates = [], []
    for _ in range(3):
        attempts = [(rng.choice([None, *range(8)]), rng.choice([None, None, "cut off", "no answer"])) for _ in range(9)]
        items = [(rng.choice([None, *range(9)]), rng.randint(0, 3), rng.choice([None, "absent", "twice"])) for _ in range(40)]
        recorded = recording.extraction(recorded, spark.createDataFrame(attempts, "run long, failure string"), spark.createDataFrame(items, "run long, item int, reason string"))
        for run in {r for r, _ in attempts if r is not None}:
            status, so_far = state.get(run, (None, 0))
            if status == "succeeded":
                continue
            candidates = [(r, i, why, "discarded" if r == run and s == "open" else s) for r, i, why, s in candidates]
            failures = [f for r, f in attempts if r == run]
            if None in failures:
                state[run] = ("succeeded", so_far + 1)
                for item in {i for r, i, _ in items if r == run}:
                    reasons = [why for r, i, why in items if (r, i) == (run, item)]
                    evidence += [(run, item)] if None in reasons else []
                    candidates += [] if None in reasons else [(run, item, min(reasons), "open")]
            else:
                state[run] = ("failed", so_far + 1)
                candidates.append((run, None, min(failures), "open"))
    want = {"runs": [(r, *s) for r, s in state.items()], "evidence": evidence, "candidates": candidates}
    assert rows(recorded) == {k: sorted(v, key=repr) for k, v in want.items()}


def test_readings_place_known_subjects_and_leave_gaps(spark):
    day = date(2026, 3, 1)
    batch = [(1, "news", "admitted", day, ["b", "a", None, "a"]), (2, "law", None, day, ["x", "w"]), (3, "news", "rejected", day, ["x"]), (4, None, "admitted", None, []), (5, "other", "admitted", day, None), (1, "news", "admitted", day, ["b", "a", None, "a"]), (None, "news", "admitted", day, ["a"])]
    df = spark.createDataFrame(batch, "statement long, kind string, admission string, dated date, named array<string>")
    subjects = spark.createDataFrame([("a", True), ("b", True), ("b", True), ("x", False), (None, True)], "subject string, accepted boolean")
    once = recording.readings(empty(spark, READ), df, subjects, {"news": 7, "law": 700})
    want = {
        "readings": [(1, "news", "admitted", day + timedelta(7)), (2, "law", None, day + timedelta(700)), (3, "news", "rejected", day + timedelta(7)), (4, None, "admitted", None), (5, "other", "admitted", None)],
        "placements": [(1, "a"), (1, "b")],
        "gaps": [(2, "not known: w, x"), (4, "no subject named"), (5, "no subject named")],
    }
    assert rows(once) == {k: sorted(v, key=repr) for k, v in want.items()}
    assert rows(recording.readings(once, df, subjects, {"news": 1})) == rows(once)


def test_mentions_make_entities_aliases_and_reads(spark):
    batch = [(1, "person", "Ada Low", "said", "Low"), (1, "person", "Ada Low", "said", "Ada"), (2, "person", "Ada Low", None, "ADA LOW"), (2, "person", None, "said", "x"), (None, "person", "Bo", "said", "Bo"), (3, "firm", "Ada Low", "named", None)]
    df = spark.createDataFrame(batch, NAMED["mentions"])
    read = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 4, None)], "statement long")
    once = recording.mentions(empty(spark, NAMED), df, read)
    want = {"entities": [("person", "Ada Low"), ("firm", "Ada Low")], "mentions": [(1, "person", "Ada Low", "said", "Ada"), (2, "person", "Ada Low", None, "ADA LOW"), (3, "firm", "Ada Low", "named", None)], "aliases": [("person", "Ada Low", "Ada")], "reads": [(1,), (2,), (3,), (4,)]}
    assert rows(once) == {k: sorted(v, key=repr) for k, v in want.items()}
    assert rows(recording.mentions(once, df, read)) == rows(once)


def test_links_and_pairs_left_alone_keep_their_first_judge(spark):
    one = spark.createDataFrame([(1, 2, "agrees", "x"), (1, 2, "agrees", "w"), (2, 3, None, "x"), (None, 3, "agrees", "x")], "a long, b long, link string, judge string")
    two = spark.createDataFrame([(1, 2, "agrees", "a"), (1, 2, "denies", "a"), (2, 3, "agrees", "a"), (2, 3, None, "a")], one.schema)
    after = recording.links(recording.links(empty(spark, PAIRS), one), two)
    assert rows(after) == {"links": [(1, 2, "agrees", "w"), (1, 2, "denies", "a"), (2, 3, "agrees", "a")], "alone": [(2, 3, "x")]}


@pytest.mark.parametrize("seed", [1, 2])
def test_ideas_are_recorded_once_with_their_verdict(spark, seed):
    rng = random.Random(seed)
    members = [(rng.randint(0, 12), rng.randint(0, 5), rng.choice([None, "a", "b", "c"])) for _ in range(40)] + [(None, 1, "a"), (3, None, "a"), (90, 1, "a"), (91, 1, "a"), (90, 1, "a")]
    df = spark.createDataFrame(members, "part long, statement long, source string").repartition(3)
    once = recording.ideas(empty(spark, IDEAS), df)
    groups = {}
    for part in sorted({p for p, s, _ in members if p is not None and s is not None}):
        own = {s: min([x for p, t, x in members if (p, t) == (part, s) and x is not None], default=None) for s in {s for p, s, _ in members if p == part and s is not None}}
        groups.setdefault(frozenset(own), (len(own), len({x for x in own.values() if x}), sum(x is None for x in own.values())))
    found = once["ideas"].collect()
    evidence = {}
    for idea, statement in once["evidence"].collect():
        evidence.setdefault(idea, set()).add(statement)
    assert {frozenset(evidence[r.idea]): (r.statements, r.sources, r.unknown) for r in found} == groups
    assert len(found) == len(groups) and all(r.admitted == (r.sources >= 2) for r in found)
    assert rows(recording.ideas(once, df.where(F.col("part") > 3).withColumn("part", F.col("part") + 500))) == rows(once)


def test_quotations_are_published_wait_or_stay_in_quarantine(spark):
    schema = "claim long, language string, translated boolean, exact boolean, block string, one_paragraph boolean, figures boolean, sources int"
    ok = ("en", None, True, None, True, None, 1)
    batch = [(1, *ok), (2, "de", False, False, "stolen", False, None, 1), (3, "de", True, True, None, True, False, 2), (4, "en", None, None, "provenance missing", None, None, 1), (5, *ok), (5, "en", None, True, "stolen", True, None, 1), (6, None, None, True, None, True, None, 1), (None, *ok), (7, *ok)]
    recorded = empty(spark, QUOTES) | {"published": spark.createDataFrame([(7, 9)], QUOTES["published"]), "quarantine": spark.createDataFrame([(1, "blocked", "open"), (1, "figures changed", "closed"), (3, "figures changed", "open"), (7, "blocked", "open"), (8, "blocked", "open"), (4, "not an exact span", "closed")], QUOTES["quarantine"])}
    after = recording.quotations(recorded, spark.createDataFrame(batch, schema), "en")
    kept = [(1, "blocked", "closed"), (1, "figures changed", "closed"), (3, "figures changed", "open"), (7, "blocked", "closed"), (8, "blocked", "open"), (4, "not an exact span", "closed")]
    new = [(4, "not an exact span", "open"), (4, "provenance missing", "open"), (4, "longer than a paragraph", "open"), (5, "blocked", "open")]
    assert rows(after) == {"published": [(1, 1), (7, 9)], "quarantine": sorted(kept + new, key=repr), "waiting": [(2,), (6,)]}
    again = recording.quotations({k: after[k] for k in QUOTES}, spark.createDataFrame(batch, schema), "en")
    assert rows(again) == rows(after)


def test_a_null_key_is_inserted_once(spark):
    state = spark.createDataFrame([(None, 1), (2, 2)], "k long, v long")
    feed = spark.createDataFrame([(None, 5), (3, 4), (3, 3)], "k long, v long")
    assert rows({"x": merging.inserted(state, feed, ["k"], ["v"])})["x"] == sorted([(None, 1), (2, 2), (3, 3)], key=repr)
