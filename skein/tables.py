"""Intermediate tables in the folder that driver and executors share, and joins on keys that may be hot."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in so many of all rows; no more than so many keys can be.
HOT_KEYS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one on a local master, and an error on a cluster, whose machines share no temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='skein-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, read by column, safe when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skein-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a table made by `written` that no result needs any more."""
    spark = df.sparkSession
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for folder in folders:
        if "/skein-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_below(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it was counted to have at most so many rows; else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def looked_up(rows: DataFrame, side: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows joined to side (one row a key) on key, without column `weight`, which says how many of the `total` rows a key has.

    Keys with more than one in HOT_KEYS of all rows are at most HOT_KEYS, so they are joined by a broadcast and never meet
    in one task; the others are joined by a shuffle. Both tables are read twice and should be written ones.
    """
    hot = F.col(weight) > total / HOT_KEYS
    few = side.where(hot).drop(weight)
    direct = rows.join(F.broadcast(few), key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(side.where(~hot).drop(weight), key)
    return direct.unionByName(rest)
