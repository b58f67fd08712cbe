"""The operators against brute force, exact round trips and held-out labels, with odd rows in every input."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import decontaminate, html, language, merkle, pieces, quality, queries, sharding, simhash, tokens, toxicity
from skein.llm.common import fold

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (4, "a"), (None, "no id at all"), (5, "word " * 30_000), (6, "Größe 日本語 🎉 ﬁ x"), (7, "1234 !!! ???")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, shard int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_segments_are_those_of_the_definition():
    """All maximal segments: the best one (the shortest, then the first of equals), and those of what lies left and right of it."""
    rng = np.random.default_rng(1)

    def by_definition(x, lo, hi):
        found = [(sum(x[i:j]), -(j - i), -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)]
        top = max(found, default=(0,))
        if top[0] <= 0:
            return []
        i = -top[2]
        j = i - top[1]
        return [*by_definition(x, lo, i), (i, j, top[0]), *by_definition(x, j, hi)]

    for _ in range(300):
        x = (rng.integers(-4, 5, rng.integers(0, 25)) + rng.random() / 7).tolist()  # sums of different segments differ
        x = [v + rng.random() / 1000 for v in x]
        got = toxicity.maximal_segments(x)
        want = by_definition(x, 0, len(x))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxic_passages_are_found_at_each_place():
    bad = [f"bad{k}" for k in range(8)]
    model = toxicity.SegmentModel([np.zeros(many, np.float32) for _, many in toxicity.TABLES])
    model.tables[0][toxicity.buckets(pa.array([" ".join(bad)]))[0][0][0]] = 3.0
    passage, clean = " ".join(bad), " ".join(f"w{k}" for k in range(300))
    scattered = " ".join(f"{w} {clean}" for w in bad)
    texts = [f"{clean} {passage} {clean}", f"{passage} {clean} {passage} {clean}", f"{scattered} {passage}", "bad1 " * 500, " ".join(f"bad{k % 2} {clean}" for k in range(50))]
    counts, segments, _ = model.segments(pa.array(texts))
    strong = [[(a, b) for a, b, s in segments[k] if s > 10] for k in range(len(texts))]
    places = lambda text: [(k, k + len(passage)) for k in range(len(text)) if text.startswith(passage, k)]
    assert strong == [places(t) for t in texts[:3]] + [[], []]
    assert all(model.evidence(n, segments[k])[0] > 0 for k, n in enumerate(counts.tolist()) if k < 3)


def test_simhash_against_brute_force(spark, docs, odd):
    both = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    got = simhash.near_duplicates(both).collect()
    assert len(got) == both.count()
    texts = {}
    for i, t in both.collect():
        texts.setdefault(i, t)

    def plain(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        if not words:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for r in got:
        if r.doc_id is not None:
            assert r.fp % (1 << 64) == plain(texts[r.doc_id])
    prints = sorted({r.fp for r in got})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in range(len(prints)):
        for b in range(a):
            if bin((prints[a] ^ prints[b]) % (1 << 64)).count("1") <= 2:
                root[find(prints[a])] = find(prints[b])
    least = {}
    for r in got:
        if r.doc_id is not None:
            least[find(r.fp)] = min(least.get(find(r.fp), r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(find(r.fp)) for r in got)


def test_links_at_two_bits_are_found_and_at_three_not(spark):
    base = 0x0123456789ABCDEF
    prints = [base, base ^ 3, base ^ (1 << 63) ^ 1, base ^ 7 ^ (1 << 40), 0, 1 << 20]
    rows = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    found = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in simhash.links(rows).collect()}
    from itertools import combinations

    near = {frozenset(p) for p in combinations(prints, 2) if bin(p[0] ^ p[1]).count("1") <= 2}
    assert found <= near
    import functools

    def groups(edges):
        parts = [{p} for p in prints]
        for e in edges:
            hit = [g for g in parts if g & e]
            parts = [g for g in parts if not g & e] + [functools.reduce(set.union, hit)]
        return sorted(map(sorted, parts))

    assert groups(found) == groups(near)


def test_links_in_crowded_cells_are_those_of_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    prints = {0x0123456789ABCDEF}
    for p in [0x0123456789ABCDEF, *rng.integers(0, 2**62, 20).tolist()]:
        for _ in range(30):
            flips = rng.choice(64, rng.integers(1, 4), replace=False)
            prints.add(p ^ sum(1 << int(k) for k in flips))
    prints = sorted(int(np.uint64(p).astype(np.int64)) for p in prints)
    rows = spark.createDataFrame([(p,) for p in prints], "fp long")
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if bin((p ^ q) % (1 << 64)).count("1") <= 2:
                root[find(p)] = find(q)
    for crowd in (2, 32):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        near = simhash.components(simhash.links(rows)).collect()
        own = {p: p for p in prints} | {r.node: r.root for r in near}
        assert len({(own[p], find(p)) for p in prints}) == len(set(own.values())) == len({find(p) for p in prints})


def jaccard(a, b):
    words = [bytes(t, "utf-8").translate(simhash.LOWER).split() for t in (a, b)]
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words)
    return len(x & y) / len(x | y)


def test_near_copies_are_found_and_others_left(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts, planted = [], []
    for _ in range(150):
        words = [vocabulary[k] for k in rng.integers(0, 3000, rng.integers(60, 400))]
        copy = list(words)
        for at in rng.choice(len(words), max(1, int(len(words) * rng.uniform(0.005, 0.025))), replace=False):
            copy[at] = "edited"
        texts += [" ".join(words), " ".join(copy)]
        planted.append((len(texts) - 2, len(texts) - 1))
    sure = [(a, b) for a, b in planted if jaccard(texts[a], texts[b]) >= 0.8]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component for r in simhash.similar(rows).collect()}
    assert len(sure) > 100
    assert sum(found[a] == found[b] for a, b in sure) >= 0.9 * len(sure)
    for a, b in planted:  # planted pairs are the only ones that can be alike
        assert found[a] != found[b] or (a, b) in sure
    assert len(set(found.values())) == len(texts) - sum(found[a] == found[b] for a, b in sure)
    kept = sorted(r.doc_id for r in simhash.keep_one(rows).collect())
    assert kept == sorted(set(range(len(texts))) - {b for a, b in sure if found[a] == found[b]})


def test_a_large_group_of_near_copies_gives_few_pairs(spark):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join("new" + str(k) if i == at else w for i, w in enumerate(words)) for k, at in enumerate(rng.integers(0, 300, 600))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = simhash.written(rows.select(simhash._signatures(F.col("text"), 5).alias("s")).select("s.*"), "test")
    assert simhash.candidates(signed.select("texts", "fp", "cells")).count() < 40 * len(texts)
    assert simhash.keep_one(rows).count() == 1


def test_keep_one_with_repeated_and_shared_ids(spark):
    t, u = "one two three four five six seven eight", "quite another text than that of the others here"
    rows = [(1, t, "a"), (5, t, "b"), (5, u, "c"), (7, u + " and more words", "d"), (7, u + " and more words", "d"), (None, t, "e"), (None, "alone and without an id", "f"), (8, None, "g"), (9, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    kept = sorted(map(tuple, simhash.keep_one(docs).collect()), key=repr)
    assert kept == sorted([rows[0], rows[2], rows[3], rows[6], rows[7]], key=repr)
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_decontamination_finds_copies_and_edits(spark, docs, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    edited = item.replace("five", "FIVE,").replace("nine", "changed")
    rows = [(1, f"before it. {item} and after"), (2, f"x {edited} y"), (3, "quite another text with one two three only"), (4, None), (5, ""), (6, item.upper()), (8, "a Short one; short two"), (8, "a Short one; short two"), (9, "the shortest pair: one short"), (10, f"{item} " * 400)]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short"), (10, "short one"), (11, "a short one"), (12, "  !"), (None, item), (7, item)], "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.matches(d, bench).collect()}
    assert set(got) == {(1, 7), (2, 7), (6, 7), (10, 7), (8, 9), (8, 10), (8, 11), (9, 9)} and got[1, 7] == got[8, 11] == 1.0 and 0.5 <= got[2, 7] < 1
    assert sorted(r.doc_id for r in decontaminate.decontaminated(d, bench).collect()) == [3, 4, 5]
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 40)  # several blocks
    again = decontaminate.matches(d, bench).collect()
    assert {(r.doc_id, r.item_id): r.score for r in again} == got and len(again) == len(got) + 3
    assert sorted(r.doc_id for r in decontaminate.decontaminated(d, bench).collect()) == [3, 4, 5]
    assert decontaminate.matches(d, bench.limit(0)).count() == 0
    assert decontaminate.matches(d.limit(0), bench).count() == 0


def test_decontamination_misses_no_alignment_of_dense_edits(spark):
    rng = np.random.default_rng(3)
    items = {k: [f"w{x}" for x in rng.integers(0, 400, n)] for k, n in enumerate((4, 5, 8, 15, 16, 25, 40, 59))}
    around = lambda: [f"w{x}" for x in rng.integers(0, 400, rng.integers(0, 30))]
    texts = []
    for item in items.values():
        for step in range(2, 8):
            for offset in range(step):
                at = range(offset, len(item), step)
                changed = [f"new{k}" if k in at else w for k, w in enumerate(item)]
                dropped = [w for k, w in enumerate(item) if k not in at]
                added = [v for k, w in enumerate(item) for v in ([f"new{k}", w] if k in at else [w])]
                texts += [around() + body + around() for body in (changed, dropped, added)]
        texts.append(added + around() + item + changed)
    want = {}
    hashed = lambda text: decontaminate.word_hashes(pa.array([" ".join(text)]))[0]
    for k, text in enumerate(texts):
        for i, item in items.items():
            score = decontaminate.align(hashed(item), hashed(text))[0] / len(item)
            if score >= decontaminate.LEAST:
                want[k, i] = score
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    found = decontaminate.matches(d, bench).collect()
    got = {(r.doc_id, r.item_id): r.score for r in found}
    assert len(found) == len(got) and got == want
    lone = d.where(F.col("doc_id") == 0)  # an edited copy alone: what its edits broke is in no document
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(lone, bench).collect()} == {x for x in want if x[0] == 0}


def test_alignment_against_a_plain_table():
    rng = np.random.default_rng(2)
    for _ in range(100):
        a, b = (rng.integers(0, 4, n).astype(np.uint64) for n in rng.integers(1, 12, 2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_pieces_are_the_librarys_and_go_back(spark, docs, odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    both = docs.select("text").unionByName(odd.select("text"))
    got = both.select("text", pieces.encoded(F.col("text"), path).alias("ids")).select("*", pieces.decoded(F.col("ids"), path).alias("back")).collect()
    for r in got:
        assert r.ids == sp.encode(r.text or "")
        assert r.back == sp.decode(r.ids)


def test_unigram_viterbi_is_the_best_path():
    class Same:
        @staticmethod
        def normalize(texts):
            return texts

    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.5, "▁a": -2.2, "ba": -9.0, "aba": -4.4}
    v = pieces.Vocabulary({p: k for k, p in enumerate(scores)}, scores, None, 99, False, Same())
    encoder = pieces.TrieEncoder(v)

    def best(word):
        if not word:
            return 0.0, ()
        return max((best(word[:k])[0] + scores[word[k:]], best(word[:k])[1] + (word[k:],)) for k in range(len(word)) if word[k:] in scores)

    words = ["▁ab", "▁aba", "▁abab", "▁b", "▁bab", "▁aabab"]
    for word, ids in zip(words, encoder.encode(words), strict=True):
        assert sum(list(scores.values())[i] for i in ids) == pytest.approx(best(word)[0])


def test_token_counts_are_the_librarys_and_cached(spark, docs, odd, tmp_path):
    from tokenizers import Tokenizer

    fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = spark.createDataFrame([(900_001, "a <|endoftext|> b"), (900_002, "it's  two   spaces\n\n x")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(more)
    own = tokens.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    cache = f"file://{tmp_path}/cache"
    got = tokens.token_counts(both, own, 1024, cache).collect()
    assert len(got) == both.count()
    want = {}
    for i, t in both.collect():
        want.setdefault(i, set()).add((len((t or "").encode()), len(fast.encode(t or "", add_special_tokens=False).ids)))
    assert all((r.n_bytes, r.n_tokens) in want[r.doc_id] and r.over_limit == (r.n_tokens > 1024) for r in got)
    before = spark.read.parquet(cache).count()
    assert before == spark.read.parquet(cache).select("content").distinct().count()
    tokens.token_counts(both, own, 1024, cache).count()
    assert spark.read.parquet(cache).count() == before


def test_merkle_against_plain_edits(spark, docs, odd):
    rows = docs.select("doc_id", "text").unionByName(odd.where("doc_id <> 4 or doc_id is null").select((F.col("doc_id") + 5_000).alias("doc_id"), "text"))
    got = {r.doc_id: r for r in merkle.fingerprints(rows).collect()}
    texts = {i: t or "" for i, t in rows.where("doc_id is not null").collect()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        text, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == merkle.Tree(text).written and r.edited_fingerprint == merkle.Tree(edited).written
        assert r.near_edited == pytest.approx(merkle.likeness(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(merkle.likeness(r.fingerprint, got[ids[(k + 1) % len(ids)]].fingerprint))
        mine, theirs = Counter(text.split("\n")), edited.split("\n")
        lacking = []
        for at, line in enumerate(theirs):
            if mine[line] > 0:
                mine[line] -= 1
            else:
                lacking.append(at)
        assert len(r.edited_paragraphs) == len(lacking) and {theirs[at] for at in r.edited_paragraphs} == {theirs[at] for at in lacking}
    many = [f"paragraph {n} has some words of its own" for n in range(200)]
    changed = ["edited" if n in (3, 77, 150) else line for n, line in enumerate(many)]
    trees = [merkle.Tree("\n".join(x)).written for x in (many, changed, many)]
    assert merkle.edits(trees[0], trees[1]) == [3, 77, 150] and merkle.edits(trees[0], trees[2]) == [] and 0.9 < merkle.likeness(*trees[:2]) < 1
    assert merkle.fingerprints(rows.limit(0)).count() == 0


def test_shards_are_exact_and_gapless(spark, docs, odd, monkeypatch):
    rows = docs.select("doc_id", "n_chars").unionByName(odd.select("doc_id", F.lit(1).cast("long").alias("n_chars")))
    equal = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("x").alias("shard"), F.lit(0).alias("slot"))  # clashing names, rows wholly equal
    for fan, table, many in ((256, rows, 16), (3, rows, 16), (3, equal, 7)):
        monkeypatch.setattr(sharding, "FAN", fan)
        out = sharding.shards(table, many, partitions=40).toPandas()
        assert len(out) == table.count()
        sizes = out.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
        assert sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["min"] == 0).all() and (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()
    assert sharding.shards(rows.limit(0), 4).count() == 0


def test_communication_has_exact_margins_and_the_right_mean():
    counts = [50, 0, 7, 143]
    draws = np.array([sharding.communication(counts, [25] * 8, np.random.default_rng(s)) for s in range(400)])
    assert (draws.sum(axis=2) == counts).all() and (draws.sum(axis=1) == 25).all()
    assert np.abs(draws.mean(axis=0) - np.outer(counts, np.full(8, 1 / 8))).max() < 0.6


def test_the_law_is_exact_beyond_numpys_range_too():
    from math import comb

    rng = np.random.default_rng(4)
    for good, bad, sample in ((40, 60, 90), (5, 70, 30), (30, 3, 20)):
        draws = np.array([sharding.hypergeometric(rng, good, bad, sample, most=1) for _ in range(20_000)])
        want = np.array([comb(good, k) * comb(bad, sample - k) / comb(good + bad, sample) if 0 <= sample - k <= bad else 0 for k in range(min(good, sample) + 1)])
        seen = np.bincount(draws, minlength=len(want)) / len(draws)
        assert np.abs(seen - want).max() < 0.015
    big = [sharding.hypergeometric(rng, 3 * 10**9, 5 * 10**9, 10**7) for _ in range(200)]
    mean, spread = 10**7 * 3 / 8, (10**7 * 15 / 64) ** 0.5
    assert abs(np.mean(big) - mean) < 5 * spread / 200**0.5 and 0.7 < np.std(big) / spread < 1.3


PAGE = """<html><head><title>T</title><script>var x="<p>no</p>"</script></head><body><header><h1>Site</h1><nav><a>Home</a></nav></header>
<div class="cookie-notice">We use cookies</div><div id="content"><h1>A title of the article</h1><p>First &amp; long paragraph of the
article text, with   more words than a menu has, and <a href=x>a link</a> in it.<p>Second one<br>goes on for long enough too, as paragraphs do.
<div class="ad">Buy it</div><form>Name <input></form><p>Short.</p></div><aside>More</aside><section class="comments"><p>I liked this article very much, thanks a lot for it.</p></section><footer>&copy;</footer></body></html>"""


def test_html_main_text(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "no markup at all"), (5, "<article><p>unclosed <b>bold"), (6, "<nav>only a menu</nav>")]
    got = {r.page_id: r.text for r in spark.createDataFrame(rows, "page_id long, html string").select("page_id", html.main_text(F.col("html")).alias("text")).collect()}
    assert got[1] == "\n".join(["A title of the article", "First & long paragraph of the article text, with more words than a menu has, and a link in it.", "Second one goes on for long enough too, as paragraphs do.", "Short."])
    assert got[2] == got[3] == got[6] == "" and got[4] == "no markup at all" and got[5] == "unclosed bold"


def test_html_keeps_article_text_beside_one_element_and_under_marked_names():
    p = [f"<p>Paragraph {k} of the article, which is as long as the paragraphs of articles are wont to be, with a second part.</p>" for k in range(8)]
    text = [x[3:-4] for x in p]
    menu = "<nav><a href=/>Home</a><a href=/b>More</a></nav>"
    foot = "<footer>All rights reserved</footer>"
    page = lambda body: f"<html><body>{menu}{body}{foot}</body></html>"
    assert html.main_blocks(page(f"<div>{''.join(p[:6])}</div><div>{''.join(p[6:])}</div>")) == text
    assert html.main_blocks(page(f"<div><h1>A title</h1>{p[0]}</div><div>{''.join(p[1:])}</div>")) == ["A title", *text]
    assert html.main_blocks(page(f"<article>{''.join(p[:7])}</article><article>{p[7]}</article>")) == text
    for box in ('div class="content has-sidebar"', 'article class="post comments-open"'):
        assert html.main_blocks(page(f"<{box}>{''.join(p)}</{box.split()[0]}>")) == text
    named = f'{"".join(p[:3])}<h2 id="discussion">Discussion</h2><p class="warning">{text[3]}</p>{"".join(p[4:])}'
    assert html.main_blocks(page(f"<article>{named}</article>")) == [*text[:3], "Discussion", *text[3:]]
    comments = f'<section class="comment-list">{"".join(p[2:])}</section>'
    assert html.main_blocks(page(f"<article>{p[0]}{p[1]}</article>{comments}")) == text[:2]


def test_html_link_lists_outside_the_regions_go_within_articles_too():
    p = "".join(f"<p>Paragraph {k} of the article, which is as long as the paragraphs of articles are wont to be.</p>" for k in range(4))
    links = "".join(f"<li><a href=/{k}>Another page {k}</a></li>" for k in range(9))
    got = html.main_blocks(f"<article><h1><a href=/>A title</a></h1>{p}<ul>{links}</ul></article>")
    assert got[0] == "A title" and len([x for x in got if x.startswith("Paragraph")]) == 4
    assert len(got) <= 7  # smoothing reaches two lines beyond a region at most


P = [f"Paragraph {k} of the article, which is as long as the paragraphs of articles are wont to be, with a second part that goes on." for k in range(6)]
TAGGED = [f"<p>{x}</p>" for x in P]
BODY, MENU = "".join(TAGGED), "".join(f"<div><a href=/{k}>Item {k}</a></div>" for k in range(6))
JUNK = "".join(f"<div><span>Tag</span> <span>{k}</span></div>" for k in range(6))
SHAPES = {
    "article": (f"<nav>x</nav><article><h1>T</h1>{BODY}</article><footer>f</footer>", ["T", *P]),
    "paragraphs in the body": (f"{MENU}{JUNK}{BODY}{JUNK}{MENU}", P),
    "divs without names": (f"<div>{MENU}</div><div>{JUNK}</div><div><div>{BODY}</div></div><div>{JUNK}</div>", P),
    "an article in two divs": (f"<div>{MENU}</div><div>{''.join(TAGGED[:4])}</div><div>{''.join(TAGGED[4:])}</div><div>{JUNK}</div>", P),
    "table layout": (f"<table><tr><td>{MENU}</td><td>{BODY}</td><td>{JUNK}</td></tr></table>", P),
    "main": (f"<div>{MENU}</div><main>{BODY}<p>End.</p></main><div>{JUNK}</div>", [*P, "End."]),
    "short paragraph": (f"<div>{MENU}</div><section>{TAGGED[0]}<p>Of.</p>{''.join(TAGGED[1:])}</section><div>{JUNK}</div>", [P[0], "Of.", *P[1:]]),
    "names": (f"<div class=menu>{JUNK}</div><div class='content has-sidebar'>{BODY}</div><div class=comments>{TAGGED[0]}</div>", P),
    "line breaks": (f"<div>{JUNK}</div><div>{'<br>'.join(P)}</div><div>{JUNK}</div>", [" ".join(P)]),
    "list": (f"<div>{MENU}</div><ul>{''.join('<li>' + x for x in P)}</ul><div>{JUNK}</div>", P),
}


def test_html_page_shapes_and_what_the_clusters_decide(monkeypatch):
    run = lambda: {name: html.main_blocks(f"<html><body>{page}</body></html>") for name, (page, _) in SHAPES.items()}
    assert run() == {name: want for name, (_, want) in SHAPES.items()}
    monkeypatch.setattr(html, "_threshold", lambda values: -1.0)  # one cluster
    assert sum(got != SHAPES[name][1] for name, got in run().items()) >= 3


def test_html_of_the_given_pages_does_not_hang_on_class_names(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r.html]
    named = [html.main_blocks(x) for x in pages]
    monkeypatch.setattr(html, "MARKS", frozenset())
    assert sum(html.main_blocks(x) == y for x, y in zip(pages, named, strict=True)) >= 0.95 * len(pages)


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "<div>" * 100_000 + "</p>" * 100_000, "<b class=ad>x" * 100_000, "<p>x</span>" * 100_000, f"<p>{'long ' * 400_000}"])
def test_html_takes_linear_time(page):
    import time

    began = time.perf_counter()
    html.main_blocks(page)
    assert time.perf_counter() - began < 20


def test_html_odd_tables(spark):
    rows = [(1, PAGE, "a"), (1, PAGE, "a"), (2, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = pages.withColumn("text", html.main_text(F.col("html"))).collect()
    assert got[0] == got[1] and got[2].text == ""
    assert pages.limit(0).select(html.main_text(F.col("html"))).count() == 0


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_language_held_out(spark, larger, odd):
    docs, _ = larger
    net = language.trained(docs, fold("doc_id", 4) == 2)
    got = language.language(docs, net).where(fold("doc_id", 4) == 2)
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    strange = {r.doc_id: r for r in language.language(odd, net).collect()}
    assert strange[1].lang_pred == strange[2].lang_pred == strange[3].lang_pred == strange[7].lang_pred == "und" and strange[1].score == 0
    assert language.trained(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(False)) is None
    assert language.language(odd, None).where("lang_pred = 'und'").count() == odd.count()


def test_language_table_of_pairs_gives_the_same_as_single_bytes():
    net = language.ByteConvNet.fresh(["a", "b"], 4, np.random.default_rng(0))
    x = np.random.default_rng(1).integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    pooled = np.concatenate([r.max(axis=0) for _, r in net._responses(x)], axis=1)
    assert np.allclose(net.paired()(x), net._softmax(pooled), atol=1e-5)


def test_quality_and_toxicity_held_out(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    for module, label, folds, left in ((quality, "quality", 4, 2), (toxicity, "toxic", 5, 0)):
        model = module.trained(docs, labels, fold("doc_id", folds) == left)
        run = quality.quality if module is quality else toxicity.toxicity
        got = run(docs, model).where(fold("doc_id", folds) == left).join(labels, "doc_id").where(F.col(label).isNotNull())
        by_lang = got.groupBy("lang").agg(*[F.count_if(F.expr(f"{label} = {y}")).alias(f"n{y}") for y in (0, 1)], *[F.count_if(F.expr(f"{label} = {y} and predicted = 1")).alias(f"p{y}") for y in (0, 1)]).collect()
        found, real, wrong, none = (sum(r[c] for r in by_lang) for c in ("p1", "n1", "p0", "n0"))
        assert found >= 0.85 * real and wrong <= 0.05 * none
        for r in by_lang:  # no language is left out
            assert r.n1 < 8 or r.p1 >= 0.7 * r.n1
            assert r.n0 < 20 or r.p0 <= 0.12 * r.n0
        strange = run(odd, model)
        assert strange.count() == odd.count() and strange.where("score between 0 and 1").count() == odd.count()
        assert run(odd.limit(0), model).count() == 0
        assert module.trained(docs, labels.limit(0), F.lit(False)) is None
        assert run(odd, None).where("score = 0").count() == odd.count()


def test_attention_scores_are_those_of_a_plain_forward_pass():
    rng = np.random.default_rng(6)
    shape = {"w": (quality.FEATURES, 5), "v": (5, 3), "u": (5, 3), "a": (3,), "c": (5,), "b": (5,), "d": (1,)}
    p = {k: rng.normal(0, 0.5, n) for k, n in shape.items()}
    model = quality.AttentionModel(rng.normal(0, 1, quality.FEATURES), rng.uniform(0.5, 2, quality.FEATURES), p)
    texts = ["One line.\nTwo lines | here!!\n\nthree", "", "z" * 2000, "word " * 300]
    score, top, weight = model.scores(pa.array(texts))
    for k, text in enumerate(texts):
        x, _ = quality.passages(pa.array([text]))
        hidden = [[max(0.0, sum((r[i] - model.mean[i]) / model.spread[i] * p["w"][i][j] for i in range(len(r))) + p["b"][j]) for j in range(5)] for r in x.astype(float)]
        gate = [sum(p["a"][g] * np.tanh(sum(h[j] * p["v"][j][g] for j in range(5))) / (1 + np.exp(-sum(h[j] * p["u"][j][g] for j in range(5)))) for g in range(3)) for h in hidden]
        share = np.exp(gate) / np.exp(gate).sum() if gate else []
        logit = p["d"][0] + sum(share[n] * sum(h[j] * p["c"][j] for j in range(5)) for n, h in enumerate(hidden))
        assert score[k] == pytest.approx(1 / (1 + np.exp(-logit)))
        assert (top[k], weight[k]) == (-1, 0) if not gate else weight[k] == pytest.approx(max(share))


def test_language_scores_are_those_of_a_plain_forward_pass():
    net = language.ByteConvNet.fresh(["a", "b", "c"], 2, np.random.default_rng(2))
    x = np.random.default_rng(3).integers(0, 256, (2, language.WINDOW)).astype(np.uint8)
    for row, got in zip(x, net.paired()(x), strict=True):
        padded, pooled = [*row.tolist(), *[0] * (max(language.WIDTHS) - 1)], []
        for width, taps in zip(language.WIDTHS, net.taps, strict=True):
            for f in range(2):
                pooled.append(max(sum(float(taps[k][padded[at + k]][f]) for k in range(width)) for at in range(language.WINDOW)))
        hidden = [max(0.0, v + float(b)) for v, b in zip(pooled, net.bias, strict=True)]
        z = np.exp([sum(h * float(net.dense[i][k]) for i, h in enumerate(hidden)) + float(net.offset[k]) for k in range(3)])
        assert np.allclose(got, z / z.sum(), atol=1e-4)


def test_passage_features_do_not_depend_on_the_batch():
    texts = ["One line.\nTwo lines | here!!", "", None, "z" * 2000]
    x, rows = quality.passages(pa.array(texts, pa.string()))
    alone = [quality.passages(pa.array([t], pa.string()))[0] for t in texts]
    for k, own in enumerate(alone):
        assert np.allclose(x[rows == k], own)


def test_queries_have_the_columns_of_their_contracts(spark):
    want = {"op1_html": "page_id url text n_chars", "op3_merkle": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op4_simhash": "doc_id fingerprint component_id", "op10_sharding": "doc_id size text_crc32 law shard slot grown_shard"}
    for name, columns in want.items():
        assert queries.queries()[name](spark, SF).columns[: len(columns.split())] == columns.split()


def test_coded_cases(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    blanks = " " * 20_000
    rows = [(5, f"{blanks}x{blanks}y{blanks}", 1), (6, "\n" * 5000 + "\t" * 3000 + " .", 1), (1, "Plain words, twice: words.", 9), (1, "Plain words, twice: words.", 9), (2, None, None), (3, "", 1), (None, "привет 世界 \U0001f600", 2), (4, "x" * 3000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = pieces.coded(docs, path)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert list(r["ids"]) == sp.encode(r["text"] or "")
        assert r["decoded"] == (r["text"] or "")
    assert pieces.coded(docs.limit(0), path).count() == 0
