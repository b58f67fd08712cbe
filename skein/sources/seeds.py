"""Seeds: all tables of a base in one folder with a manifest, from which a new base starts only if everything is as the manifest says."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from skein.operators.releases import digest_of_rows

MANIFEST = "name string, columns string, rows long, digest string"


def _line(df: DataFrame) -> Column:
    """A row as one text that no other row has: its columns by name, each value with its length, so that null, an empty text and shifted values differ."""
    parts = []
    for field in sorted(df.schema, key=lambda f: f.name):
        column = F.col(f"`{field.name}`")
        value = F.to_json(F.struct(column)) if isinstance(field.dataType, (ArrayType, MapType, StructType)) else column.cast("string")
        known = F.when(column.isNull(), "n").otherwise(F.concat(F.length(value).cast("string"), F.lit(":"), value))
        parts.append(F.concat(F.lit(f"{field.name}="), known))
    return F.concat_ws("\n", *parts)


def _columns(df: DataFrame) -> str:
    return ", ".join(sorted(f"{f.name} {f.dataType.simpleString()}" for f in df.schema))


def evidence(name: str, df: DataFrame) -> DataFrame:
    """(name, columns, rows, digest) of a table; the digest doesn't depend on the order of its rows, nor on how they lie in files."""
    return df.agg(F.count("*").alias("rows"), digest_of_rows(_line(df)).alias("digest")).select(F.lit(name).alias("name"), F.lit(_columns(df)).alias("columns"), "rows", "digest")


def exported(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes the tables and then, of what was written, the manifest. A folder takes one seed: where there is something already, it raises an error."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{folder}/tables/{name}")
    rows = [evidence(name, spark.read.schema(df.schema).parquet(f"{folder}/tables/{name}")) for name, df in tables.items()]
    reduce(DataFrame.unionByName, rows).coalesce(1).write.parquet(f"{folder}/manifest")


def _found(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    try:
        return evidence(name, spark.read.parquet(f"{folder}/tables/{name}"))
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def checked(spark: SparkSession, folder: str) -> DataFrame:
    """(name, rows, digest, state): of each table in the manifest whether it is intact, missing, has other columns, or is changed. Files that can't be read end the job."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    names = [r["name"] for r in manifest.select("name").collect()]  # as many as there are tables
    found = [x for x in (_found(spark, folder, name) for name in names) if x is not None]
    now = reduce(DataFrame.unionByName, found, spark.createDataFrame([], MANIFEST)).select("name", F.col("columns").alias("columns_now"), F.col("rows").alias("rows_now"), F.col("digest").alias("digest_now"))
    state = F.when(F.col("digest_now").isNull(), "missing").when(F.col("columns") != F.col("columns_now"), "other columns").when((F.col("rows") != F.col("rows_now")) | (F.col("digest") != F.col("digest_now")), "changed").otherwise("intact")
    return manifest.join(now, "name", "left").select("name", "rows", "digest", state.alias("state"))


def imported(spark: SparkSession, folder: str, target: str) -> tuple[DataFrame, bool]:
    """The check of a seed, and whether it was copied to target: all of it or, if one table isn't intact, nothing.

    The copy is checked as well; its manifest is written last and only then, so a target without one is what a lost job
    or a failed copy left, and is no base. A target takes one import.
    """
    report = checked(spark, folder).collect()
    told = spark.createDataFrame(report, "name string, rows long, digest string, state string")
    if not report or any(r["state"] != "intact" for r in report):
        return told, False
    for r in report:
        spark.read.parquet(f"{folder}/tables/{r['name']}").write.parquet(f"{target}/tables/{r['name']}")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    now = reduce(DataFrame.unionByName, [evidence(r["name"], spark.read.parquet(f"{target}/tables/{r['name']}")) for r in report])
    if manifest.exceptAll(now).limit(1).count():
        raise OSError(f"the copy in {target} differs from the seed in {folder}")
    manifest.coalesce(1).write.parquet(f"{target}/manifest")
    return told, True
