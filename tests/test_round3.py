"""What the third round's review found, on tables so small that the right result can be read off."""

import datetime as dt
import hashlib
import itertools
import math
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.functions import rules
from skein.llm import simhash
from skein.operators import clustering, duplicates, joining, journal, recording
from skein.plans import prose, registry
from skein.streaming import tasks


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_two_levels_bind_all_blocks_in_one_chain(spark):
    """with more blocks than a block holds, the SQL of journal_links still chains all blocks of a journal after each other."""
    rows = [("hot", k, f"p{k}") for k in range(50)] + [("one", 0, None), (None, 0, "x")]
    got = {(r.j, r.n): r.link for r in journal.linked(spark.createDataFrame(rows, "j string, n long, payload string").repartition(3), "j", "n", "payload", block=4, levels=2).collect()}
    values = [_h(f"p{k}") for k in range(50)]
    chains = [list(itertools.accumulate(values[k : k + 4], _h, initial="0")) for k in range(0, 50, 4)]
    before = ["0", *[_h("0", x) for x in itertools.accumulate([c[-1] for c in chains], _h, initial="0")][1:]]
    want = {("hot", 4 * b + k): _h(before[b], x) for b, c in enumerate(chains) for k, x in enumerate(c[1:])}
    assert got == want | {("one", 0): _h("0", _h("0", _h(""))), (None, 0): _h("0", _h("0", _h("x")))}


def test_capitals_keep_a_text_length(spark):
    """F8: ß became SS, so a title of eight letters was shouted and one of eleven signs not short."""
    df = spark.createDataFrame([(0, "Straßen ab"), (1, "Straßen"), (2, "ŉ ᾀ x"), (3, None), (4, "")], "k long, t string")
    assert [r.c for r in df.select("k", rules.capitals(F.col("t")).alias("c")).orderBy("k").collect()] == ["STRAẞEN AB", "STRAẞEN", "ŉ ᾈ X", None, ""]
    titles = {"STRAẞEN, AB, C": "shouted", "STRAẞEN, A  ": "short", "STRAẞEN, A . .": None, "  ": "missing", "https://a.example/x\n": None, "ßabcdefgh, ijk": None}
    rows = spark.createDataFrame(list(enumerate(titles)), "k long, t string").select("k", rules.title_problem(F.col("t")).alias("p"))
    assert [r.p for r in rows.orderBy("k").collect()] == list(titles.values())


def test_titles_in_capitals_are_those_of_the_sql(spark, tmp_path):
    """F8: the query against its SQL on texts with ß."""
    spark.createDataFrame([(7, "Großbuß a."), (14, "Weißer abc."), (21, "Fußweg.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(registry.oracle_sql()["title_problems"]).fetchall())
    assert sorted(map(tuple, registry.queries()["title_problems"](spark, str(tmp_path)).collect())) == want


def _attempts(spark, folder, orders, lines):
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_linestatus string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    want = sorted(con.sql(registry.oracle_sql()["earliest_success"]).fetchall())
    assert sorted(map(tuple, registry.queries()["earliest_success"](spark, str(folder)).collect())) == want
    return want


def test_attempts_of_odd_rows_are_those_of_the_sql(spark, tmp_path):
    """unknown states, a key with a row on record among others, unknown days, an unknown key on record."""
    day = dt.datetime(2024, 1, 1)
    orders = [(1, "O"), (2, None), (3, "O"), (3, "P"), (4, "F"), (5, "F"), (None, "O")]
    lines = [(k, n, 20.0 + n, "F", d) for k in (1, 2, 3, 4) for n, d in ((1, None), (2, day), (3, day))] + [(5, None, 30.0, "F", day), (5, 4, 31.0, "F", day)]
    assert _attempts(spark, tmp_path / "a", orders, lines) == [(1, 2, 22.0), (2, 2, 22.0), (4, 2, 22.0), (5, 4, 31.0)]
    assert _attempts(spark, tmp_path / "b", [*orders, (None, "P")], lines) == []


def test_weighted_pairs_are_not_shuffled(spark):
    """candidates met the sets of both rows in joins; now blocks of rows meet, and all that moves is rows."""
    sets = {k: ["all", f"g{k % 7}", f"h{k % 5}", f"own{k}"] for k in range(120)}
    found = clustering.weighted_pairs(spark.createDataFrame(list(sets.items()), "id long, w array<string>"), "id", "w", 0.3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FlatMapCoGroups") >= 1
    df = {i: sum(i in s for s in sets.values()) for s in sets.values() for i in s}
    w = {i: math.log(1 + 120 / n) ** 2 for i, n in df.items()}
    norm = {k: math.sqrt(sum(w[i] for i in s)) for k, s in sets.items()}
    want = {(a, b): sum(w[i] for i in set(sets[a]) & set(sets[b])) / norm[a] / norm[b] for a, b in itertools.combinations(sets, 2)}
    got = {(r.a, r.b): r.cosine for r in found.collect()}
    assert set(got) == {k for k, c in want.items() if round(c, 6) >= 0.3}
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in got)


def test_every_alike_pair_and_every_link_is_found(spark):
    """pairs by chosen shingles against all pairs, frequent ones and repeated rows too, and each text's number of links."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    stock = rng.choices(words, k=60)
    texts = []
    for _ in range(150):
        base = stock + rng.choices(words, k=rng.randint(0, 120))
        texts += [" ".join(base[: rng.randint(44, len(base))] if rng.random() < 0.3 else base) for _ in range(rng.randint(1, 3))]
    texts += [None, "", "too short", texts[0], texts[5]]
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "k long, body string").repartition(3)
    first, sets = {}, {}
    for k, t in enumerate(texts):
        own = {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} if t else set()
        if first.setdefault(t, k) == k and len(own) >= 40:
            sets[k] = own
    alike = lambda x, y: len(x & y) / len(x | y) >= 0.8 or len(x & y) / min(len(x), len(y)) >= 0.75
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sets, 2) if alike(sets[a], sets[b])}
    found = duplicates.shingle_pairs(df, "k", "body").collect()
    assert {(r.a, r.b): r.shared for r in found} == want and len(found) == len(want) > 300
    links = spark.createDataFrame(list(want), "a long, b long")
    got = {r.k: r.links for r in clustering.linked_classes(df, "k", "body", links).collect()}
    assert got == {k: sum(first[t] in pair for pair in want) for k, t in enumerate(texts)}


def test_runs_are_not_sent_through_the_driver(spark):
    """runs, which grow with the batch, were broadcast as long as their files were small."""
    runs = spark.createDataFrame([(1, "failed", 1), (2, "succeeded", 1)], "run long, status string, attempts long")
    kept = {"runs": runs, "evidence": spark.createDataFrame([], "run long, item int"), "candidates": spark.createDataFrame([(1, 0, "r", "open")], "run long, item int, reason string, status string")}
    attempts = spark.createDataFrame([(1, None), (2, None), (3, "cut")], "run long, failure string")
    after = recording.extraction(kept, attempts, spark.createDataFrame([(1, 1, None), (2, 1, None), (3, 1, None)], "run long, item int, reason string"))
    for name in ("runs", "candidates"):
        assert "Broadcast" not in after[name]._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, after["runs"].collect())) == [(1, "succeeded", 2), (2, "succeeded", 1), (3, "failed", 1)]
    assert sorted(map(tuple, after["candidates"].collect()), key=str) == [(1, 0, "r", "discarded"), (3, None, "cut", "open")]
    assert list(map(tuple, after["evidence"].collect())) == [(1, 1)]


def test_ancestors_are_not_sent_through_the_driver(spark, monkeypatch):
    """steps and ancestors, which grow with the nodes, were broadcast as long as their files were small."""
    plans, write = [], joining.written
    monkeypatch.setattr(joining, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    rows = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (10, 11), (11, 12), (12, 99), (30, None)], "k long, up long")
    got = {(r.node, r.depth): r.ancestor for r in joining.ancestors(rows, "k", "up").collect()}
    assert got == {(1, None): None, (2, None): None, (3, None): None, (10, 0): 10, (10, 1): 11, (10, 2): 12, (10, 3): 99, (11, 0): 11, (11, 1): 12, (11, 2): 99, (12, 0): 12, (12, 1): 99, (30, 0): 30}
    assert not any("Broadcast" in p for p in plans)


def test_no_sketch_is_kept_for_a_user(spark, tmp_path):
    """the sketch and the summary were aggregated by type and user first. Types and users may be null."""
    rows = [(None, 1, 1.0), (None, 1, 2.0), (None, 2, 9.0), ("a", None, 4.0), ("a", 7, None), ("b", None, None)]
    spark.createDataFrame(rows, "event_type string, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    found = registry.queries()["approximate_measures"](spark, str(tmp_path))
    assert {tuple(r) for r in found.select("event_type", "n", "close", "middle").collect()} == {(None, 3, True, 2.0), ("a", 2, True, 4.0), ("b", 1, True, None)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    keyed = [line for line in plan.splitlines() if re.search(r"keys=\[[^\]]*user_id", line)]
    assert keyed and not [line for line in keyed if "percentile" in line or "approx" in line]


def test_a_task_sets_one_timer_at_a_time():
    """each row of a task set a timer of its own, and each of them called for the task's state."""

    class Kept:
        def __init__(self):
            self.held, self.timers = {}, []

        def exists(self):
            return "x" in self.held

        def get(self):
            return self.held["x"]

        def update(self, x):
            self.held["x"] = x

        put = update

        def appendValue(self, x):
            self.held["x"] = [*self.held.get("x", []), x]

        def appendList(self, x):
            self.held["x"] = [*self.held.get("x", []), *x]

        def clear(self):
            self.held.clear()

        def registerTimer(self, at):
            self.timers.append(at)

        def getCurrentWatermarkInMs(self):
            return 500

    machine = tasks.Machine()
    machine.handle, machine.waiting, machine.now = (Kept() for _ in range(3))
    batch = pd.DataFrame({"at_ms": [900, *range(0, 500, 10), 700], "kind": ["done", *["failed"] * 50, "claimed"]})
    list(machine.handleInputRows((1,), iter([batch]), None))
    assert machine.handle.timers == [0]
    out = pd.concat(machine.handleExpiredTimer((1,), machine.handle, None))
    assert list(out["at_ms"]) == list(range(50, 500, 60)) and machine.handle.timers == [0, 700]
    assert sorted(machine.waiting.get()) == [(700, "claimed"), (900, "done")]


def test_near_copies_of_the_pipeline_pass_the_grid(spark, monkeypatch):
    """keep_one found its pairs by sampled bits alone; the segment-popcount grid must find those within 2 bits by itself."""
    word = random.Random(10)
    texts = [[f"w{word.randrange(10**6)}" for _ in range(3000)] for _ in range(4)]
    near = [[*t[:-1], "other"] for t in texts]
    prints = [[simhash.fingerprint_of(" ".join(t).encode(), 5) & (1 << 64) - 1 for t in side] for side in (texts, near)]
    within = [k for k in range(4) if (prints[0][k] ^ prints[1][k]).bit_count() <= 2]
    assert within
    docs = spark.createDataFrame([(k + 10 * n, " ".join(t)) for n, side in enumerate((texts, near)) for k, t in enumerate(side)], "doc_id long, text string")
    monkeypatch.setattr(simhash, "candidates", lambda signed: spark.createDataFrame([], "a long, b long"))
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {0, 1, 2, 3} | {k + 10 for k in range(4) if k not in within}


def test_a_manifest_of_many_rows_has_several_files(spark, monkeypatch):
    """F16: one task wrote all rows of a manifest, and one task sorted them all for the other order."""
    monkeypatch.setattr(prose, "FILE_ROWS", 400, raising=False)
    read = []
    whole = prose.jsonl.manifest
    monkeypatch.setattr(prose.jsonl, "manifest", lambda *a: read.append(whole(*a)) or read[-1])
    found = registry.queries()["manifest_rows"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == 1500 and {r.digests for r in found} == {1}
    assert len(read[0].inputFiles()) == 8
