"""States that outlive a run: each merge writes a new version beside the old ones, and a small pointer names the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class State:
    """A table in a shared folder with versions. Readers of a version are not disturbed by a merge; `rolled_back` points to an older one again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointers(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("sequence long, version string").parquet(f"{self.folder}/pointer")
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def current(self) -> str | None:
        """The name of the version that counts."""
        found = self._pointers()
        last = found.orderBy(F.desc("sequence")).first() if found is not None else None
        return last["version"] if last else None

    def read(self) -> DataFrame | None:
        version = self.current()
        return None if version is None else self.spark.read.parquet(f"{self.folder}/{version}")

    def replace(self, rows: DataFrame) -> str:
        """Writes rows as a new version, whole, and only then points to it."""
        version = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{version}")
        self._point(version)
        return version

    def replace_if_new(self, rows: DataFrame, identity: str) -> bool:
        """Writes rows as the version that their identity names, unless it is there already, and points to it unless it is current; whether it was written.

        A folder without its _SUCCESS mark is what a lost run left, and is written again.
        """
        version = f"v-{identity}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{version}/_SUCCESS")
        new = not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        if new:
            rows.write.mode("overwrite").parquet(f"{self.folder}/{version}")
        if self.current() != version:
            self._point(version)
        return new

    def history(self) -> DataFrame:
        """(sequence, version) of all moves of the pointer."""
        found = self._pointers()
        return self.spark.createDataFrame([], "sequence long, version string") if found is None else found

    def _point(self, version: str) -> None:
        found = self._pointers()
        sequence = 0 if found is None else 1 + (found.agg(F.max("sequence")).first()[0] or 0)
        self.spark.createDataFrame([(sequence, version)], "sequence long, version string").coalesce(1).write.mode("append").parquet(f"{self.folder}/pointer")

    def rolled_back(self, version: str) -> None:
        self._point(version)
