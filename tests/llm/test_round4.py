"""What the fourth round's review found in the training-data operators."""

import random

import pytest
from pyspark.sql import functions as F

from skein.llm import simhash


def _shingles(text, width=5):
    words = text.split()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


@pytest.mark.parametrize(("groups", "bits"), [(3, 0), (3, 4), (30, 0), (30, 4)])
def test_near_copies_unlike_the_smallest_of_their_cell_are_linked(spark, monkeypatch, groups, bits):
    """F8: in a cell, texts near the smallest one were compared with it alone, so near copies of each other stayed apart; in small cells, in crowded ones, and for one fingerprint."""
    word = random.Random(groups)
    texts = []
    for _ in range(groups):
        base = [f"w{word.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join([*base[:k], *(f"n{word.randrange(10**6)}" for _ in range(3 * (k < 60))), *base[k:]]) for k in (60, 59, 60 - word.randrange(2, 4))]
    word.shuffle(texts)
    texts = list(dict.fromkeys(texts))
    sets = [_shingles(t) for t in texts]
    like = [[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
    first = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if like[a][b]:
                first = [min(first[a], first[b]) if f in (first[a], first[b]) else f for f in first]
    assert len(set(first)) == groups and len(texts) > 2 * groups - 1

    def signed(text, shingle):
        fp = F.xxhash64(text).bitwiseAND(F.lit((1 << 3 * bits) - 1))
        return F.struct(fp.alias("fp"), F.xxhash64(text, F.lit(1)).alias("texts"), F.lit(60).alias("size"), F.array(F.lit(1), F.lit(2)).alias("cells"))

    monkeypatch.setattr(simhash, "_signatures", signed)
    monkeypatch.setattr(simhash, "BLOCK", 20, raising=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(first))
