"""Token counts through a cache of digests.

A text's normalised content and the tokenizer's version have digests; the cache maps the pair to a count. Texts whose
digests the cache lacks are encoded once each, however many copies there are, and appended to the cache; then all
documents take their count from it.

Byte-level BPE files are encoded with tiktoken from the file's own vocabulary, which gives the same counts in less
time; other .json files with tokenizers, .model files with sentencepiece.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import slices
from skein.tables import broadcast_below, looked_up, shared_folder, written

CACHE = T.StructType([T.StructField("content", T.StringType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])
#: Rows (an id and a digest, about 120 bytes) that a broadcast may hold; more are joined by a shuffle.
ROWS_BROADCAST = 200_000
# Fixed value: the pattern by which this kind of byte-level BPE parts texts.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The characters that byte-level vocabularies use for bytes: themselves where printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _byte_level(spec: dict) -> bool:
    """Whether the file is plain byte-level BPE: nothing but the usual parting of texts and merges in order of ids."""
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    vocab = model.get("vocab", {})
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    first = 256
    ordered = all(vocab.get(a + b) == first + k for k, (a, b) in enumerate(merges))
    plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = plain and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("ignore_merges")
    special = all(t.get("special") and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in spec.get("added_tokens", []))
    return bool(merges) and plain and special and ordered


@dataclass
class Tokenizer:
    """A vocabulary file at a path that every executor has; its version is the file's digest with the normal form."""

    path: str
    form: str | None = None  # a Unicode normal form for the content, or none

    @property
    def version(self) -> str:
        with open(self.path, "rb") as file:
            return hashlib.sha256(file.read() + (self.form or "").encode()).hexdigest()

    def counter(self) -> Callable[[list[str]], list[int]]:
        if self.path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=self.path)
            return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
        with open(self.path, encoding="utf-8") as file:
            spec = json.load(file)
        if _byte_level(spec):
            import tiktoken

            byte, special = _byte_of(), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
            ranks = {bytes(map(byte.__getitem__, k)): v for k, v in spec["model"]["vocab"].items() if k not in special}
            encoding = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)

            def count(text: str) -> int:
                if any(s in text for s in special):
                    return len(encoding.encode(text, allowed_special="all"))
                return len(encoding.encode_ordinary(text))

            return lambda texts: [count(x) for x in texts]
        from tokenizers import Tokenizer as Fast

        fast = Fast.from_file(self.path)
        fast.no_truncation()
        fast.no_padding()
        return lambda texts: [len(x.ids) for x in fast.encode_batch(texts, add_special_tokens=False)]


_ready: dict[tuple[str, str | None], Callable[[list[str]], list[int]]] = {}


def _counts(tokenizer: Tokenizer) -> Callable:
    path, form = tokenizer.path, tokenizer.form

    def run(texts: pa.Array) -> pa.Array:
        if (path, form) not in _ready:
            _ready[path, form] = Tokenizer(path, form).counter()
        out: list[int] = []
        for part in slices(texts):
            whole = [x or "" for x in part.to_pylist()]
            out += _ready[path, form]([unicodedata.normalize(form, x) for x in whole] if form else whole)
        return pa.array(out, pa.int64())

    return F.arrow_udf(run, "long")


def _content(form: str | None):
    text = F.coalesce("text", F.lit(""))
    if form:
        normal = F.arrow_udf(lambda x: pa.array([unicodedata.normalize(form, t or "") for t in x.to_pylist()], pa.string()), "string")
        text = normal(text)
    return F.sha2(text.cast("binary"), 256)


def digests(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, n_bytes, content) of every row as a written table: texts are hashed once, what follows reads narrow rows."""
    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), _content(tokenizer.form).alias("content"))
    return written(rows, "token-digests")


def add_missing(docs: DataFrame, known_digests: DataFrame, tokenizer: Tokenizer, cache: str) -> DataFrame:
    """Encodes one document of each content that the cache (a folder of Parquet files) lacks, and appends the counts.

    The digests are grouped before they meet the cache, so copies count once; the grouped table (content, first, rows) is
    returned. All other rows are then left out by id and content: by a broadcast if they were counted to be few, else by
    a shuffle on that pair, never on the digest alone. Rows without an id, and rows that are wholly equal, may be
    encoded more than once but are appended once. Should a run break off, the next one appends what is still missing.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", _content(tokenizer.form).alias("content"))
    firsts = written(known_digests.groupBy("content").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "token-firsts")
    if _exists(docs, cache):
        had = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer.version).select("content").distinct()
        fresh = written(firsts.join(had, "content", "left_anti").select(F.col("first").alias("doc_id"), "content"), "token-misses")
        few = broadcast_below(fresh, ROWS_BROADCAST)
        texts = rows.join(few, (rows["content"] == few["content"]) & rows["doc_id"].eqNullSafe(few["doc_id"]), "left_semi")
    else:
        again = firsts.where("rows > 1")
        copies = looked_up(known_digests, again, "content", "rows", known_digests.count()).where("doc_id <> first")
        copies = written(copies.select("doc_id", "content").distinct(), "token-copies")
        texts = rows.join(broadcast_below(copies, ROWS_BROADCAST), ["doc_id", "content"], "left_anti")
    counted = texts.select("content", F.lit(tokenizer.version).alias("tokenizer"), _counts(tokenizer)(F.coalesce("text", F.lit(""))).alias("n_tokens"))
    counted.dropDuplicates(["content"]).write.mode("append").parquet(cache)
    return firsts


def _exists(docs: DataFrame, folder: str) -> bool:
    """Whether a folder of the shared file system is there, asked through Spark's own file listing."""
    try:
        docs.sparkSession.read.schema(CACHE).parquet(folder)
        return True
    except Exception as error:  # AnalysisException: the path does not exist yet
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def token_counts(docs: DataFrame, tokenizer: Tokenizer, limit: int, cache: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, counts taken from the cache after adding what it lacks.

    A null text is empty (0 bytes, 0 tokens). Without a folder given the cache is a new one in the shared folder.
    Repeated rows come out as often as they come in; extra columns are not read.
    """
    spark = docs.sparkSession
    if cache is None:
        import uuid

        cache = f"{shared_folder(spark)}/skein-token-cache-{uuid.uuid4().hex}"
    docs = docs.select("doc_id", "text")
    rows = digests(docs, tokenizer)
    firsts = add_missing(docs, rows, tokenizer, cache)
    known = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer.version)
    known = known.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))  # one row a content, should two writers have met
    counts = written(firsts.select("content", "rows").join(known, "content"), "token-counts")
    found = looked_up(rows, counts, "content", "rows", rows.count())
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
