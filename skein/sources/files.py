"""Files as snapshots: exports, and whether what was written is still what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one file, so that a file's bytes fit in a task when its digest is taken.
FILE_ROWS = 1_000_000


def exported(rows: DataFrame, path: str, by: list[str]) -> None:
    """Rows as JSON lines, a folder for each value of `by`."""
    rows.write.partitionBy(*by).option("maxRecordsPerFile", FILE_ROWS).option("ignoreNullFields", "false").json(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes) of every data file under a folder; the name is relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    name = F.regexp_extract("path", r"/([^/]+=[^/]+/[^/]+)$", 1)
    return found.select(name.alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def verified(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(file, state): intact, changed, missing or unexpected, of the files in a manifest and in the folder."""
    now = digests(spark, path).select("file", F.col("sha256").alias("now"))
    both = manifest.select("file", F.col("sha256").alias("then")).join(now, "file", "full")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "unexpected").when(F.col("now") != F.col("then"), "changed").otherwise("intact")
    return both.select("file", state.alias("state"))
