"""A training-data pipeline over documents: each stage reads what the stage before kept.

STAGES is a list of (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, language, pieces, simhash, toxicity
from skein.llm.common import fold
from skein.tables import written

#: A document whose best language has a lower probability than this has none.
LEAST_LANGUAGE = 0.3


def _whole(docs: DataFrame) -> DataFrame:
    """doc_id and text for an operator, and the whole row in one column, so that no name of its columns meets the operator's."""
    return docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), "doc_id", "text")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language: null and empty texts, texts without a letter, or with no language of some probability.

    Rows are judged one by one: repeated ones stay or go together, extra columns come back as they are, whatever their
    names; from an empty table, or one without languages, nothing is learnt and nothing stays.
    """
    net = language.trained(docs, fold("doc_id", 4) == 2)
    found = language.language(_whole(docs), net)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select("_row.*")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity model marks.

    Null and empty texts have no toxic passage and stay; repeated rows stay or go together; extra columns come back as
    they are, whatever their names; without labels of both kinds nothing is marked.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.trained(docs, labels, fold("doc_id", 5) == 0)
    return toxicity.toxicity(_whole(docs), model).where("predicted = 0").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (see simhash.keep_one): SimHash fingerprints of five-word shingles, linked by the segment-popcount grid, and wider candidates, both confirmed by a Jaccard of 0.8 or more.

    Null and wordless texts are one group; of repeated rows one stays; a row without an id stays only where its group
    has no id; other texts with the same id are not touched.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none, and repeated rows stay or go together."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document that is left, and whether they give its text back.

    A null or empty text has no ids and gives back an empty text; repeated rows come out as often as they come in;
    columns besides doc_id, lang, source and text are left out.
    """
    found = pieces.coded(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return found.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_pieces"), same.alias("round_trip"))


STAGES = [
    ("language ID", identify_language),
    ("toxicity", reject_toxic),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can't express the stages (trained models, hashes of shingles, alignment); tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
