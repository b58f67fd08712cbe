"""What the fourth round's review found, on tables so small that the right result can be read off."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import clustering, duplicates, stories


@pytest.mark.parametrize("block", [4, 1 << 12])
def test_claims_meet_by_common_words_too_and_in_groups_of_any_size(spark, monkeypatch, block):
    """words of more than 400 turns and groups of more than twelve were left out; components against all pairs, in blocks of several sizes."""
    monkeypatch.setattr(clustering, "SEED_ROWS", block, raising=False)
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 4 * block)
    monkeypatch.setattr(clustering, "CELLS", 8 * block)
    rng = random.Random(4)
    rows = [(10 * k, k // 3, ["common", *(f"{k % 5}-{rng.randrange(60)}" for _ in range(rng.randrange(1, 12)))]) for k in range(120)]
    rows += [(5000 + k, 900 + k, ["everywhere", "twice", f"x{k}"]) for k in range(450)] + [(9000, None, ["everywhere", "twice"]), (None, 7, ["everywhere", "twice"]), (9001, 1, []), (9002, 77, ["alone"])]
    sets = [(k, s, set(w)) for k, s, w in rows if k is not None and s is not None]
    first = {k: k for k, _, _ in sets}
    linked = set()
    for n, (a, sa, wa) in enumerate(sets):
        for b, sb, wb in sets[:n]:
            if sa != sb and len(wa & wb) >= max(1, 0.4 * min(len(wa), len(wb))):
                linked |= {a, b}
                low, high = sorted((first[a], first[b]))
                if low != high:
                    first = {k: low if f == high else f for k, f in first.items()}
    df = spark.createDataFrame(rows, "id long, source long, w array<string>").repartition(5)
    got = {r.id: r.group for r in clustering.claim_groups(df, "id", "source", "w", 0.4).collect()}
    assert got == {k: first[k] for k in linked} and len(set(got.values())) > 1
    assert sum(g == 5000 for g in got.values()) == 450


def test_a_review_bounds_titles_before_they_are_compared_and_events_are_read_once(spark, monkeypatch):
    """every row of a block was looked at for its title, and texts were parted into words for each reading of the events."""
    import pyarrow as pa

    rng = random.Random(6)
    titles = [" ".join(rng.choice(["north", "river", "stone", "wood", "of"]) for _ in range(rng.choice([5, 9, 30]))) for _ in range(60)]
    titles += [t[:k] + "x" + t[k:] for t in titles for k in (1, len(t) // 2)] + ["", "a"]
    block = stories._Titles(pa.chunked_array([titles]))
    looked = 0
    for r, mine in enumerate(titles):
        near = set(block.near(block, r).tolist())
        assert {k for k, t in enumerate(titles) if stories._alike(t, mine)} <= near
        looked += len(near)
    assert looked < len(titles) ** 2 / 2
    read = spark.sparkContext.accumulator(0)

    def word(ids: pa.Array) -> pa.Array:
        read.add(len(ids))
        return pa.array([f"told word {i % 3}" for i in ids.to_pylist()])

    fields = [F.arrow_udf(word, "string")("id").alias("title"), *[F.lit("x").alias(c) for c in ("summary", "evidence", "subject", "action", "object", "event_type", "source_type")]]
    lists = [F.array(F.lit(c)).alias(c) for c in ("products", "organizations", "facts")]
    events = spark.range(30).select("id", *fields, F.lit("2026-01-01").cast("date").alias("event_date"), *lists, F.lit(True).alias("full"))
    stories.for_review(events)[1].collect()
    assert read.value == 30


@pytest.mark.parametrize("marked", [1 << 22, 0])
def test_pairs_of_small_texts_are_found_by_shingles_beyond_the_usual_hash(spark, monkeypatch, marked):
    """all shingles were shuffled up to the last hash that any text chose."""
    monkeypatch.setattr(duplicates, "MOST_PLACES", marked)
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(44, 60))]
        texts += [" ".join(words), " ".join([*words[: len(words) - rng.randrange(1, 16)], "other"]), " ".join(["more"] * (1 + len(texts) % 40) + words)]
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if min(len(sets[a]), len(sets[b])) >= 40 and len(sets[a] & sets[b]) >= 0.75 * min(len(sets[a]), len(sets[b]))}
    df = spark.createDataFrame(list(enumerate(texts)), "k long, body string")
    assert {(r.a, r.b) for r in duplicates.shingle_pairs(df, "k", "body").collect()} == want and len(want) > 60
    moved = duplicates._chosen(duplicates._different(df, "k", "body", 5, 40), "k", 0.75)[1].count()
    assert not marked or moved < 0.6 * sum(len(s) for s in sets if len(s) >= 40)
