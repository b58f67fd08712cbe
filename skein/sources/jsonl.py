"""JSON-lines files as sources and sinks: registries, queues with bad lines, manifests with digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.tables import broadcast_below


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, line) of text files: the place grows along each file, so the last line of a key can be told."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") * F.lit(1 << 20) + F.monotonically_increasing_id() % F.lit(1 << 33)).alias("place"), F.col("value").alias("line"))
    return raw.where(F.trim("line") != "")


def _parsed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The lines with their JSON as a struct `r`, null where a line isn't an object of the schema."""
    return lines(spark, path).withColumn("r", F.from_json("line", schema, {"mode": "PERMISSIVE"}))


def rows(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """All well-formed rows; a line that isn't JSON, or has no key, is skipped."""
    return _parsed(spark, path, schema).where(F.col(f"r.{key}").isNotNull()).select("r.*")


def registry(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """One row a key: of repeated ones the last, by file and place in it."""
    found = _parsed(spark, path, schema).where(F.col(f"r.{key}").isNotNull())
    last = found.groupBy(F.col(f"r.{key}").alias("_key")).agg(F.max_by("r", F.struct("file", "place")).alias("r"))
    return last.select("r.*")


def malformed(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """(file, bad): how many lines of each file were skipped."""
    return _parsed(spark, path, schema).groupBy("file").agg(F.count_if(F.col(f"r.{key}").isNull()).alias("bad"))


def manifest(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """The rows with the digest of each one's line and of all lines of its file in order of their digests, so that a changed file is known by it."""
    found = lines(spark, path).select("file", F.sha2("line", 256).alias("line_sha256"), F.from_json("line", schema).alias("r")).where(F.col(f"r.{key}").isNotNull())
    files = found.groupBy("file").agg(F.sha2(F.concat_ws("", F.count("*").cast("string"), F.bit_xor(F.xxhash64("line_sha256")).cast("string")), 256).alias("file_digest"))
    return found.join(broadcast_below(files, 100_000), "file").select("r.*", "line_sha256", "file_digest")


def write(rows: DataFrame, path: str, order: list) -> None:
    """Rows as JSON lines in an order that holds from file to file (a range a file)."""
    rows.orderBy(*order).write.option("ignoreNullFields", "false").json(path)
