"""Chained journals, classes without caps, weighted cosines, nearest vectors and ancestors against plain versions."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from skein.operators import clustering, joining, journal, retrieval
from skein.operators.components import components


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _links(payloads, block):
    """By the definition, level by level."""

    def befores(values):
        blocks = [values[k : k + block] for k in range(0, len(values), block)]
        chains = [list(itertools.accumulate(b, _h, initial=journal.SEED)) for b in blocks]
        if len(blocks) == 1:
            tops = [journal.SEED]
        else:
            upper = befores([c[-1] for c in chains])
            tops = [journal.SEED, *[_h(before, above) for before, above, _ in upper[1:]]]
        return [(top, c[k], c[k + 1]) for top, c in zip(tops, chains, strict=True) for k in range(len(c) - 1)]

    return [_h(before, chain) for before, _, chain in befores([_h(p or "") for p in payloads])]


@pytest.fixture(scope="module")
def made(spark):
    rows = [("hot", k, f"p{k % 50}") for k in range(150)] + [("one", 0, None)] + [("small", k, str(k)) for k in range(5)]
    return rows, journal.linked(spark.createDataFrame(rows, "j string, n long, payload string").repartition(3), "j", "n", "payload", block=4).collect()


def test_links_bind_all_entries_before_in_blocks_of_blocks(made):
    rows, got = made
    by = {(r.j, r.n): r.link for r in got}
    for name in ("hot", "one", "small"):
        assert [by[name, n] for j, n, _ in rows if j == name] == _links([p for j, _, p in rows if j == name], 4)


CASES = {"whole": None, "changed": (77, "changed"), "lost": (64, "lost"), "swapped": (30, "swapped"), "swapped over a block's end": (31, "swapped"), "twice": (9, "lost"), "end cut off": (140, "lost"), "link changed": (0, "changed")}


@pytest.mark.parametrize("case", CASES)
def test_the_first_break_is_located(spark, made, case):
    rows = {n: [r.j, r.n, r.payload, r.link] for r in made[1] if r.j == "hot" for n in [r.n]}
    more = []
    if case == "changed":
        rows[77][2] = "other"
    elif case == "lost":
        del rows[64]
    elif case.startswith("swapped"):
        at = CASES[case][0]
        rows[at][2], rows[at + 1][2] = rows[at + 1][2], rows[at][2]
    elif case == "twice":
        more = [list(rows[9])]
    elif case == "end cut off":
        rows = {n: r for n, r in rows.items() if n < 140}
    elif case == "link changed":
        rows[0][3] = "0" * 64
    stored = spark.createDataFrame([*rows.values(), *more], "j string, n long, payload string, link string")
    heads = spark.createDataFrame([("hot", 150), ("gone", 3)], "j string, many long")
    got = {r.j: (r.n, r.fault) for r in journal.first_breaks(stored, heads, "j", "n", "payload", block=4).collect()}
    assert got.pop("gone") == (0, "lost")
    assert got == ({"hot": CASES[case]} if CASES[case] else {})


def test_500_near_copies_are_one_class(spark):
    rng = random.Random(2)
    sets = {k: [f"w{j}" for j in range(16) if j != k % 16] + [f"own{k}"] for k in range(500)}
    sets |= {1000 + k: rng.sample([f"v{j}" for j in range(30)], 4) for k in range(60)}
    rows = spark.createDataFrame(list(sets.items()), "id long, s array<string>")
    edges = joining.sharing_two(rows, "id", "s")
    assert edges.count() < 500 * 120
    got = {r.node: r.root for r in components(edges).collect()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        if len(set(sets[a]) & set(sets[b])) > 1:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {k: got.get(k, k) for k in sets} == {k: find(k) for k in sets}


@pytest.mark.parametrize("least", [0.12, 0.5, 0.9])
def test_cosines_without_a_cap(spark, least):
    rng = random.Random(3)
    sets = {k: sorted({f"i{min(int(rng.expovariate(0.1)), 50)}" for _ in range(rng.randint(1, 15))}) for k in range(80)}
    rows = spark.createDataFrame(list(sets.items()), "id long, w array<string>")
    df = {i: sum(i in s for s in sets.values()) for i in {x for s in sets.values() for x in s}}
    weight = {i: math.log(1 + len(sets) / n) ** 2 for i, n in df.items()}
    norm = {k: math.sqrt(sum(weight[i] for i in s)) for k, s in sets.items()}
    want = {(a, b): sum(weight[i] for i in set(sets[a]) & set(sets[b])) / norm[a] / norm[b] for a, b in itertools.combinations(sets, 2)}
    got = {(r.a, r.b): r.cosine for r in clustering.weighted_pairs(rows, "id", "w", least).collect()}
    assert set(got) == {k for k, c in want.items() if round(c, 6) >= least}
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in got)


def test_nearest_with_large_ids_nulls_and_ties(spark):
    rng = np.random.default_rng(1)
    big = (1 << 60) + 3
    rows = [(k, rng.normal(size=4).tolist(), ["x", "y", None][k % 3]) for k in range(60)] + [(big, [1.0, 0.0, 0.0, 0.0], "x"), (big + 2, [2.0, 0.0, 0.0, 0.0], "x"), (big + 4, [3.0, 0.0, 0.0, 0.0], "x")]
    odd = [(100, None, "x"), (101, [1.0, None, 0.0, 0.0], "x"), (102, [float("nan")] * 4, "x"), (None, [1.0] * 4, "x"), (103, [], "y")]
    df = spark.createDataFrame(rows + odd, "id long, v array<float>, g string")
    good = {i: (np.float32(v).astype(float), g) for i, v, g in rows} | {103: (np.zeros(4), "y")}
    unit = lambda v: v / max(1e-300, float(np.sqrt((v * v).sum())))
    for group in (None, "g"):
        got = retrieval.nearest_to_queries(df, df.where("id % 3 = 0 or id > 1000"), "id", "v", 3, group=group).collect()
        by = {}
        for r in got:
            by.setdefault(r["query"], []).append((r.nth, r.hit))
        for q, (v, g) in good.items():
            if not (q % 3 == 0 or q > 1000) or group and g is None:
                assert q not in by
                continue
            every = sorted((-round(float(unit(v) @ unit(w)), 12), i) for i, (w, h) in good.items() if i != q and (not group or g == h))
            assert [i for _, i in sorted(by[q])] == [i for _, i in every[:3]]
    assert retrieval.nearest_to_queries(df.limit(0), df, "id", "v", 3).count() == 0


def test_ancestors_end_on_cycles(spark):
    up = {1: 2, 2: 1, 3: 1, 10: 11, 11: 12, 12: 99, 20: 20, 30: None, 31: 30} | {100 + k: 100 + k - 1 for k in range(1, 40)}
    rows = spark.createDataFrame([(k, v) for k, v in up.items()], "k long, up long")
    got = {}
    for r in joining.ancestors(rows, "k", "up").collect():
        got.setdefault(r.node, {})[r.depth] = r.ancestor
    for k in up:
        chain, seen = [k], {k}
        while (nxt := up.get(chain[-1])) is not None and nxt not in seen:
            chain.append(nxt)
            seen.add(nxt)
        endless = nxt is not None
        assert got[k] == ({None: None} if endless else dict(enumerate(chain)))
    assert joining.ancestors(rows.limit(0), "k", "up").count() == 0


def test_the_closest_rows_before(spark):
    pairs = spark.createDataFrame([(1, 9, 0.5), (2, 9, 0.5), (3, 9, 0.7), (1, 2, 0.9)], "a long, b long, cosine double")
    assert sorted((r.b, r.nth, r.a) for r in clustering.closest_before(pairs, 2).collect()) == [(2, 1, 1), (9, 1, 3), (9, 2, 1)]
