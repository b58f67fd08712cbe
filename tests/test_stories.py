"""Events told more than once, against plain versions over all pairs."""

import datetime
import itertools
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from skein.operators import overlaps, stories

SCHEMA = "id long, title string, summary string, evidence string, subject string, action string, object string, event_type string, event_date date, products array<string>, organizations array<string>, facts array<string>, full boolean, source_type string"


def _events(rng, many):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
    rows = []
    for k in range(many):
        title = " ".join(rng.choice(words) for _ in range(rng.randint(3, 9)))
        if rows and rng.random() < 0.3:
            title = rng.choice(rows)[1]
            if rng.random() < 0.5 and len(title) > 50:
                title = title[:20] + "x" + title[21:]
        day = None if rng.random() < 0.1 else datetime.date(2026, 1, 1) + datetime.timedelta(rng.randint(0, 40) if rng.random() < 0.5 else 3)
        subject = "Hot Corp" if rng.random() < 0.5 else f"Corp {rng.randint(0, 20)}"
        rows.append((k, title, " ".join(rng.choices(words, k=rng.randint(0, 6))), "", subject, rng.choice(["launch", "policy"]), rng.choice(["A-1", "b 2"]), "launch", day, rng.sample(["P", "q", "R", "p", "s"], rng.randint(0, 3)), ["Org"] if rng.random() < 0.02 else None, ["f"] * rng.randint(0, 2), rng.random() < 0.7, rng.choice(["primary", "news", "review", None])))
    return rows


def _plain(text):
    return " ".join(re.findall(r"\w+", (text or "").lower()))


def _rank(r):
    return (int(r[12]), int(r[13] == "primary"), int(r[8] is not None), len(r[11]), int(r[13] == "news"), r[0])


def _may_merge(x, y):
    if any(_plain(x[k]) != _plain(y[k]) for k in (4, 5, 6, 7)) or not x[8] or x[8] != y[8]:
        return False
    p, q = ({_plain(z) for z in r[9]} for r in (x, y))
    return bool(p & q) or not p and not q


def _greedy(rows):
    groups = []
    for r in sorted(rows, key=_rank, reverse=True):
        for g in groups:
            if all(_may_merge(r, m) for m in g):
                g.append(r)
                break
        else:
            groups.append([r])
    return groups


def _candidate(x, y):
    if x[8] and y[8] and abs((x[8] - y[8]).days) > 7:
        return False
    names = [{n for n in [_plain(r[4]), *map(_plain, r[9]), *map(_plain, r[10] or [])] if n} for r in (x, y)]
    a, b = (set(_plain(" ".join(r[1:4])).split()) for r in (x, y))
    title = [_plain(r[1]) for r in (x, y)]
    near = len(title[0].split()) >= 5 and SequenceMatcher(None, *title).ratio() >= 0.96
    return bool(names[0] & names[1]) or len(a & b) / max(1, min(len(a), len(b))) >= 0.55 or near


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_and_reviews_equal_a_plain_greedy_over_all_pairs(spark, seed):
    rows = _events(random.Random(seed), 150)
    events = spark.createDataFrame(rows, SCHEMA).repartition(4)
    groups = _greedy(rows)
    want = {m[0]: g[0][0] for g in groups for m in g}
    members, pairs = stories.for_review(events)
    assert {r.id: r.chosen for r in members.collect()} == want
    assert any(len(g) > 2 for g in groups)
    got = {(r.a, r.b): r.verdict for r in pairs.collect()}
    by_id, chosen = {r[0]: r for r in rows}, sorted({g[0][0] for g in groups})
    expected = {}
    for a, b in itertools.combinations(chosen, 2):
        x, y = by_id[a], by_id[b]
        if _candidate(x, y):
            apart = _plain(x[4]) == _plain(y[4]) and x[5] != y[5] and x[8] and y[8] and x[8] != y[8]
            expected[a, b] = "separate" if apart else "review"
    of = {m[0]: g[0][0] for g in groups for m in g}
    for x, y in itertools.combinations(rows, 2):
        if _may_merge(x, y) and of[x[0]] != of[y[0]]:
            pair = tuple(sorted((of[x[0]], of[y[0]])))
            assert pair in expected
            expected[pair] = "conflict"
    assert got == expected
    assert "conflict" in expected.values() and "separate" in expected.values()


def test_no_events_and_empty_fields(spark):
    none = spark.createDataFrame([], SCHEMA)
    members, pairs = stories.for_review(none)
    assert members.count() == pairs.count() == 0
    blank = spark.createDataFrame([(k, None, None, None, None, None, None, None, None, None, None, None, None, None) for k in (1, 2)], SCHEMA)
    members, pairs = stories.for_review(blank)
    assert {(r.id, r.chosen) for r in members.collect()} == {(1, 1), (2, 2)} and pairs.count() == 0


def test_rare_items_find_every_pair_that_overlaps_enough(spark):
    rng = random.Random(4)
    sets = {k: sorted({min(int(rng.expovariate(0.08)), 60) for _ in range(rng.randint(1, 25))}) for k in range(120)}
    for share, both in ((0.55, False), (0.8, True)):
        need = {k: max(1, -(-int(len(s) * share * 100) // 100)) for k, s in sets.items()}
        rows = spark.createDataFrame([(k, s, need[k]) for k, s in sets.items()], "id long, items array<long>, need int")
        got = {(r.a, r.b) for r in overlaps.candidates(rows, "id", "items", "need", both).collect()}
        for a, b in itertools.combinations(sets, 2):
            shared = len(set(sets[a]) & set(sets[b]))
            least = max(need[a], need[b]) if both else need[min((a, b), key=lambda k: (len(sets[k]), k))]
            assert shared < least or (a, b) in got
        assert len(got) < 120 * 119 // 2


def test_copies_by_the_first_key_that_joins_them(spark):
    rows = spark.createDataFrame([(3, "u", "t"), (1, "u", None), (2, None, "t"), (4, "v", None), (5, None, None), (5, None, None)], "id long, url string, title string")
    got = sorted(tuple(r) for r in stories.exact_copies(rows, [("address", F.col("url")), ("title", F.col("title"))]).collect())
    assert got == [(1, 1, "address"), (2, 2, "title"), (3, 1, "address")]
