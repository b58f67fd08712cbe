"""Spelling variants, hard negatives and top-k search against brute force, with odd rows in every input."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import negatives, topk, variants
from skein.llm.variants import PositionIndex

VECTORS = "vec_id long, embedding array<float>, label int, score string, rank int, v string"


def test_strassen_is_the_product_for_any_sides():
    rng = np.random.default_rng(3)
    for m, k, n in [(1, 1, 1), (17, 17, 17), (40, 64, 33), (64, 63, 65), (130, 20, 50)]:
        a, b = rng.integers(-(1 << 25), 1 << 25, (m, k)), rng.integers(-(1 << 25), 1 << 25, (k, n))
        assert (negatives.strassen(a, b) == a @ b).all()
    # sums inside wrap around, the result does not
    big = np.full((32, 32), 3 << 27)
    assert (negatives.strassen(big, big) == (9 << 54) * 32).all()


def test_windows_are_those_of_the_inequalities():
    for p in [*range(-50, 500), 10**15 + 7]:
        low, high = negatives.window(p)
        near = {p // 2 - 1, p // 2, p // 2 + 1, -(-p // 2), 19 * p // 20 - 1, 19 * p // 20, 19 * p // 20 + 1}
        for s in near:
            assert (low <= s <= high) == (50 * p <= 100 * s <= 95 * p)


@pytest.mark.parametrize("kind", ["spread", "equal", "few values", "one wide"])
def test_rows_left_out_by_the_index_are_never_among_the_best(kind):
    rng = np.random.default_rng(5)
    n, width, k = 3000, 24, 5
    v = rng.normal(0, 40, (n, width)).astype(np.int64)
    if kind == "equal":
        v[200:2500] = v[0]
    elif kind == "few values":
        v = rng.integers(-1, 2, (n, width))
    elif kind == "one wide":
        v[:, 0] = rng.integers(-100_000, 100_000, n)
    index, ids, fewer = topk.ImpactIndex(v), np.arange(n) * 3, 0
    for q in [*range(0, n, 150), -1]:
        query = v[q] if q >= 0 else np.zeros(width, np.int64)
        some = index.possible(query, k, q)
        fewer += len(some) < n // 2
        rows, scores = index.best(query, k, q, ids)
        every = [(-int(s), i) for i, s in enumerate(v @ query) if i != q]
        assert list(zip((-scores).tolist(), rows.tolist(), strict=True)) == sorted(every)[:k]
    assert fewer or kind in ("equal", "few values")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(0, 0.3, 6).tolist(), int(rng.integers(0, 3)), "x", 1, "y") for k in range(0, 400)]
    for k in range(100, 180):
        rows[k] = (k, rows[50][1], 1, "x", 1, "y")  # ties
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, 1, "x", 1, "y"), (1050, [nan] * 6, 1, "x", 1, "y"), (1100, [0.1, None, 0.2, 0.3, 0.4, 0.5], 1, "x", 1, "y"), (1150, [inf, 0.0, 0.0, 0.0, 0.0, 0.0], 1, "x", 1, "y"), (1200, [0.5] * 6, None, "x", 1, "y")]
    rows += [(None, [0.9] * 6, 1, "x", 1, "y"), (1250, [], 2, "x", 1, "y"), (1300, [0.7, 0.2], 0, "x", 1, "y"), (1350, [0.5] * 9, 7, "x", 1, "y"), (-50, [0.2] * 6, 1, "x", 1, "y"), (1 << 60, [0.3] * 6, 1, "x", 1, "y"), ((1 << 60) + 1, [0.3] * 6, 2, "x", 1, "y")]
    rows += [rows[3], rows[3], rows[50]]  # repeated rows count once
    return spark.createDataFrame(rows, VECTORS).repartition(5)


def _whole(vectors, labelled):
    out = {}
    for r in vectors.collect():
        if r.vec_id is None or r.embedding is None or labelled and r.label is None or any(x is None or not np.isfinite(x) for x in r.embedding):
            continue
        out[r.vec_id] = ([int(np.floor(256 * float(x))) for x in r.embedding], r.label)
    return out


def _score(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def test_top_k_equals_brute_force(vectors):
    rows = _whole(vectors, False)
    want = []
    for q in (i for i in rows if i % 50 == 0):
        every = sorted((-_score(rows[q][0], v), i) for i, (v, _) in rows.items() if i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(every, 1)]
    assert sorted(map(tuple, topk.nearest(vectors).collect())) == sorted(want)


def test_hard_negatives_equal_brute_force(vectors):
    rows = _whole(vectors, True)
    want = []
    for a in (i for i in rows if i % 50 == 0):
        scores = sorted((-_score(rows[a][0], v), i) for i, (v, _) in rows.items() if i != a)
        for sp, p in [(s, i) for s, i in scores if rows[i][1] == rows[a][1]][:5]:
            fit = [(s, i) for s, i in scores if rows[i][1] != rows[a][1] and 50 * -sp <= 100 * -s <= 95 * -sp][:3]
            want += [(a, p, n, i, -sp, -s) for n, (s, i) in enumerate(fit, 1)]
    got = sorted(map(tuple, negatives.hard_negatives(vectors).collect()))
    assert got == sorted(want)
    assert len({a for a, *_ in got}) > 5


def test_small_tables_and_large_numbers(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert topk.nearest(empty).count() == negatives.hard_negatives(empty).count() == 0
    one = spark.createDataFrame([(50, [1.0], 1, "", 1, "")], VECTORS)
    assert topk.nearest(one).count() == negatives.hard_negatives(one).count() == 0
    large = spark.createDataFrame([(0, [1e7, 1.0], 1, "", 1, ""), (1, [1e5, 1.0], 1, "", 1, ""), (2, [3e38, 0.0], 2, "", 1, ""), (3, [-1e9, 0.0], 2, "", 1, "")], VECTORS)
    got = [tuple(r) for r in topk.nearest(large).orderBy("rank").collect()]
    assert got[0] == (0, 1, 2, (1 << 63) - 1) and got[1] == (0, 2, 1, 256 * 10**7 * 256 * 10**5 + 256 * 256) and got[2][2] == 3


def _edits(word, alphabet):
    cut = [word[:k] + word[k + 1 :] for k in range(len(word))]
    put = [word[:k] + c + word[k:] for k in range(len(word) + 1) for c in alphabet]
    other = [word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in alphabet]
    return {*cut, *put, *other} - {word}


def test_bitsets_find_exactly_one_edit():
    rng = np.random.default_rng(11)
    alphabet = "abcé"
    words = sorted({"".join(rng.choice(list(alphabet), rng.integers(1, 7))) for _ in range(1500)})
    index = PositionIndex(words)
    assert index.chunks > 3
    for size, some in itertools.groupby(sorted(words, key=len), key=len):
        asked = list(some)[:80] + ["z" * size]
        for word, bits in zip(asked, index.one_edit_from(asked), strict=True):
            found = {words[k] for k in np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))}
            assert found == _edits(word, alphabet + "z") & set(words)
    long = ["a" * 3000, "a" * 2999 + "b", "a" * 3001, "a" * 1500 + "b" + "a" * 1499]
    assert np.unpackbits(PositionIndex(long).one_edit_from([long[0]])[0].view(np.uint8), bitorder="little")[:4].tolist() == [0, 1, 1, 1]


def _brute_groups(rows):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            low = c.lower() if "A" <= c <= "Z" else c
            if "a" <= low <= "z" or "À" <= low <= "ÿ":
                run += low
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
            run = ""
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    alphabet = sorted({c for w in words for c in w})
    near = {w: [x for x in _edits(w, alphabet) if x in words] for w in words}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def test_spelling_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 40)  # several blocks a length
    rng = np.random.default_rng(13)
    common = ["Straße" + x for x in "abcd"] + ["wording", "ÀÖÿ×÷abc", "lengthy" * 3]
    chain = [("abcdefgh", 700), ("abcdefgx", 120), ("abcdefyx", 20), ("abcdezyx", 4), ("abcdezyx", 1)]
    rows = []
    for k in range(300):
        some = [w[:j] + chr(97 + int(rng.integers(0, 5))) + w[j + 1 :] if rng.random() < 0.4 else w for w in rng.choice(common, 40).tolist() for j in [int(rng.integers(0, len(w)))]]
        rows.append((k, " ".join(some)))
    rows += [(1000 + k, f"{w} " * n) for k, (w, n) in enumerate(chain)]
    rows += [(1, None), (2, ""), (3, "12 !! 34"), (None, "nobody nobody nobody nobody nobody nobody"), (7, "again again-again againxx " * 9), (7, "again again-again againxx " * 9), (8, "x" * 5000 + " ")]
    docs = spark.createDataFrame([(i, t, 1, "form") for i, t in rows], "doc_id long, text string, n int, word string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_groups(docs).collect()}
    assert got == _brute_groups(rows)
    assert any(r[0] != r[1] for r in got.values() if r[0])
    assert variants.spelling_groups(docs.limit(0)).count() == 0
    assert variants.spelling_groups(docs.where("text is null")).select("word").where(F.col("word").isNotNull()).count() == 0
