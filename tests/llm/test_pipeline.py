"""The pipeline against a brute-force version of its stages, on the documents and odd rows."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from skein.llm import decontaminate, language, toxicity
from skein.llm.common import fold
from skein.tables import written
from tests.llm.test_operators import jaccard

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables with odd rows among the documents, and columns that the operators use too."""
    out = tmp_path_factory.mktemp("tables")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    first = docs.where("length(text) > 300 and lang = 'en'").orderBy("doc_id").first()
    rows = [(900_001, None), (900_002, ""), (900_003, " \n "), (900_004, first.text), (900_004, first.text), (None, first.text), (900_005, "123 !!"), (900_006, first.text + " and then some")]
    odd = spark.createDataFrame([(i, t, "en", "odd", len(t or "")) for i, t in rows], docs.schema)
    both = docs.unionByName(odd).withColumns({"score": F.lit("own"), "lang_pred": F.lit("own"), "predicted": F.lit("own"), "passages": F.lit("own"), "component": F.lit("own")})
    both.write.parquet(f"{out}/documents.parquet")
    return str(out)


def brute(spark, folder):
    """What each stage keeps, row by row; the models are the operators' own, trained on each stage's input."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    net = language.trained(docs, fold("doc_id", 4) == 2)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = []
    probabilities = net.paired()
    for i, t in rows:
        if t and any(c.isalpha() for c in t):
            x, _, sizes = language.windows_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
            total = (probabilities(x) * sizes[:, None]).sum(axis=0)
            if total.max() / total.sum() >= 0.3:
                kept.append((i, t))
    yield kept
    table = spark.createDataFrame(kept, "doc_id long, text string")
    model = toxicity.trained(table, spark.read.parquet(f"{folder}/labels.parquet"), fold("doc_id", 5) == 0)
    stays = []
    for i, t in kept:
        counts, segments, _ = model.segments(pa.array([t.lower()]))
        total, best, _ = model.evidence(int(counts[0]), segments.get(0, []))
        if model.score(total, best) < 0.5:
            stays.append((i, t))
    yield stays
    order = sorted(set(stays), key=lambda r: (r[0] is None, r[0] or 0))
    groups = []  # (members); a text joins every group that it is like
    for r in order:
        like = [g for g in groups if any(jaccard(r[1], m[1]) >= 0.8 for m in g)]
        groups = [g for g in groups if not any(g is x for x in like)] + [[m for g in like for m in g] + [r]]
    one = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups]
    yield one
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hashed = [decontaminate.word_hashes(pa.array([t.lower()]))[0] for t in items]
    clean = []
    for i, t in one:
        words = decontaminate.word_hashes(pa.array([t.lower()]))[0]
        if all(decontaminate.align(item, words)[0] < decontaminate.LEAST * len(item) for item in hashed):
            clean.append((i, t))
    yield clean


def test_stages_are_those_of_brute_force(spark, folder):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema = docs.schema
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for (name, stage), want in zip(pipeline.STAGES[:-1], brute(spark, folder), strict=True):
        docs = written(stage(spark, docs, folder), "test")
        assert docs.schema.names == schema.names and [f.dataType for f in docs.schema] == [f.dataType for f in schema], name
        assert docs.where("score = 'own' and lang_pred = 'own' and predicted = 'own' and passages = 'own' and component = 'own'").count() == docs.count()
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=key) == sorted(want, key=key), name
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert list(r.ids) == sp.encode(texts[r.doc_id]) and r.n_pieces == len(r.ids) and r.round_trip == (sp.decode(r.ids) == texts[r.doc_id])


def test_an_empty_table_gives_an_empty_one(spark, folder):
    import corpus_pipeline as pipeline

    for name, stage in pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet").limit(0), folder).count() == 0, name
