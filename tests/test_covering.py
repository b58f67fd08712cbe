"""Samples that meet requirements against a plain greedy; windows of texts by a table function."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions import tables
from skein.operators import covering


def _wanted():
    return {"a": (3, F.col("a") > 5), "b": (2, F.col("b") == 1), "rare": (4, F.col("a") == 0), "both": (1, (F.col("a") > 7) & (F.col("b") == 1)), "never": (2, F.col("a") > 99), "nothing": (0, F.lit(True))}


PLAIN = {"a": (3, lambda a, b: a > 5), "b": (2, lambda a, b: b == 1), "rare": (4, lambda a, b: a == 0), "both": (1, lambda a, b: a > 7 and b == 1), "never": (2, lambda a, b: False), "nothing": (0, lambda a, b: True)}


@pytest.mark.parametrize("many", [0, 4, 300])
def test_the_sample_is_that_of_a_plain_greedy(spark, many):
    rng = random.Random(many)
    rows = [(k, rng.randint(0, 9), rng.randint(0, 3)) for k in range(many)]
    left, used, want = {k: n for k, (n, _) in PLAIN.items()}, set(), []
    while True:
        gains = [(-sum(left[k] > 0 and f(a, b) for k, (_, f) in PLAIN.items()), i) for i, a, b in rows if i not in used]
        if not gains or min(gains)[0] == 0:
            break
        gain, i = min(gains)
        used.add(i)
        want.append((i, len(want) + 1, -gain))
        _, a, b = rows[i]
        left = {k: n - PLAIN[k][1](a, b) for k, n in left.items()}
    df = spark.createDataFrame(rows, "id long, a int, b int").repartition(3)
    chosen = covering.sample(df, "id", _wanted())
    assert sorted(map(tuple, chosen.collect()), key=lambda r: r[1]) == want
    for r in covering.met(df, chosen, "id", _wanted()).collect():
        assert r.found >= min(r.least, r.possible) and r.possible == sum(PLAIN[r.requirement][1](a, b) for _, a, b in rows)


def test_windows_cover_the_text_and_the_schema_follows_the_arguments(spark):
    tables.registered(spark)
    rows = [(1, "abcdefghij"), (2, ""), (3, None), (4, "ab"), (5, "🎉é" * 7)]
    docs = spark.createDataFrame(rows, "id long, text string")
    found = spark.sql("SELECT d.id, w.* FROM {docs} d, LATERAL text_windows(d.text, 4, 3, true) w", docs=docs).collect()
    for i, text in rows:
        own = sorted((r for r in found if r.id == i), key=lambda r: r.ordinal)
        assert [r.text for r in own] == [text[r.char_start : r.char_end] for r in own]
        assert (own[-1].char_end if own else 0) == len(text or "") and [r.char_start for r in own] == [3 * r.ordinal for r in own]
    assert spark.sql("SELECT w.* FROM {docs} d, LATERAL text_windows(d.text, 4, 3) w", docs=docs).columns == ["ordinal", "char_start", "char_end"]
    with pytest.raises(Exception, match="width must be"):
        spark.sql("SELECT w.* FROM {docs} d, LATERAL text_windows(d.text, 0, 3) w", docs=docs)
