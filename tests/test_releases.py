"""State machines, identities, snapshots and URL forms against plain versions."""

import random
import uuid

from pyspark.sql import functions as F

from skein.functions import urls
from skein.operators import folding, releases
from skein.sources import files
from skein.tables import shared_folder

STEPS = {("a", "x"): "b", ("b", "y"): "c", ("c", "x"): "a", ("b", "x"): "b"}


def test_final_states_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(folding, "BLOCK", 4)
    r = random.Random(1)
    rows = [(0 if r.random() < 0.4 else r.randrange(1, 12), n, r.choice(["x", "y", "z", None])) for n in range(900)] + [(None, 901, "x"), (99, 902, "y")]
    want = {}
    for key, _, event in rows:
        if key is not None:
            state, events, refused = want.get(key, ("a", 0, 0))
            then = STEPS.get((state, event))
            want[key] = (then or state, events + 1, refused + (then is None))
    mixed = r.sample(rows, len(rows))
    frame = spark.createDataFrame(mixed, "k int, n int, e string").withColumns({"_key": F.lit("clash"), "state": F.lit("own")})
    got = {x["k"]: (x["state"], x["events"], x["refused"]) for x in folding.final_states(frame, "k", ["n"], "e", STEPS, "a").collect()}
    assert got == want
    assert folding.final_states(frame.limit(0), "k", ["n"], "e", STEPS, "a").count() == 0


def test_identity_knows_rows_but_not_their_order(spark):
    rows = [(n, f"text {n}", None if n % 3 else "s") for n in range(200)]
    schema = "id int, text string, source string"
    of = lambda r, n: releases.identity(releases.elements(spark.createDataFrame(r, schema).repartition(n), "t", F.col("id"), [F.col("text"), F.col("source")]))
    whole = of(rows, 1)
    assert whole == of(rows[::-1], 7)
    assert whole != of(rows[1:], 1)
    assert whole != of(rows + rows[:1], 1)
    assert whole != of([(0, "text 1", "s")] + rows[1:], 1)


def test_snapshot_names_changed_files(spark):
    path = f"{shared_folder(spark)}/skein-test-{uuid.uuid4().hex}"
    files.exported(spark.range(10).withColumn("part", F.col("id") % 2).repartition("part"), path, ["part"])
    manifest = spark.createDataFrame(files.digests(spark, path).collect())
    assert {x["state"] for x in files.verified(spark, path, manifest).collect()} == {"intact"}
    first = manifest.orderBy("file").first()["file"]
    wrong = manifest.withColumn("sha256", F.when(F.col("file") == first, "0").otherwise(F.col("sha256")))
    assert {x["file"]: x["state"] for x in files.verified(spark, path, wrong).collect()}[first] == "changed"


def test_url_forms(spark):
    reported = {
        "HTTP://WWW.Example.org//a///b/?utm_source=q&x=1&y=#top": "http://example.org/a/b?x=1",
        "https://example.org": "https://example.org/",
        "https://example.org/a).,": "https://example.org/a",
        "/rel/": "https://example.invalid/rel",
        "https://example.org:8080/?q=a%20b+c&GCLID=4": "https://example.org:8080/?q=a+b+c",
        "": "",
        None: "",
    }
    frame = spark.createDataFrame([(u,) for u in reported], "u string")
    assert {x["u"]: x["r"] for x in frame.select("u", urls.reported_url(F.col("u")).alias("r")).collect()} == reported
    fetched = {
        "https://WWW.Example.org:443//a/?x=&utm_id=1&fbclid=2&z=3#t": ("https://www.example.org//a/?x=&z=3", None),
        "http://example.org.:8080": ("http://example.org:8080/", None),
        "http://example.org:80/": ("http://example.org/", None),
        "ftp://example.org/": (None, "scheme"),
        "http://a:b@example.org/": (None, "user information"),
        "http:///a": (None, "no host"),
        "http://bücher.example/": (None, "host not encoded"),
        "http://example.org:0/": (None, "port"),
        "http://example.org:70000/": (None, "port"),
        "http://example.org:x/": (None, "port"),
        None: (None, "scheme"),
    }
    frame = spark.createDataFrame([(u,) for u in fetched], "u string").select("u", urls.fetchable_url(F.col("u")).alias("f"))
    assert {x["u"]: (x["f"]["url"], x["f"]["error"]) for x in frame.collect()} == fetched
