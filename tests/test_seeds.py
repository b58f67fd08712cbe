"""Seeds: what is imported is what was exported, and a seed with any fault imports nothing."""

import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from skein.sources import seeds


@pytest.fixture
def base(spark):
    a = spark.createDataFrame([(1, "x", [1, None]), (2, None, None), (2, "", []), (2, None, None)], "k long, t string, v array<int>")
    return {"a": a.repartition(3), "none": a.limit(0), "b": spark.createDataFrame([("1:2", None), (None, "1:2")], "`p q` string, r string")}


def test_a_seed_comes_back_as_it_was(spark, tmp_path, base):
    seeds.exported(base, f"{tmp_path}/seed")
    told, done = seeds.imported(spark, f"{tmp_path}/seed", f"{tmp_path}/base")
    assert done and sorted((r.name, r.rows, r.state) for r in told.collect()) == [("a", 4, "intact"), ("b", 2, "intact"), ("none", 0, "intact")]
    for name, df in base.items():
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/base/tables/{name}").collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert {r.state for r in seeds.checked(spark, f"{tmp_path}/base").collect()} == {"intact"}
    with pytest.raises(AnalysisException):
        seeds.exported(base, f"{tmp_path}/seed")
    with pytest.raises(AnalysisException):
        seeds.imported(spark, f"{tmp_path}/seed", f"{tmp_path}/base")


FAULTS = {
    "changed": lambda df: df.withColumn("t", F.coalesce("t", F.lit(""))),
    "other columns": lambda df: df.withColumn("k", F.col("k").cast("int")),
    "missing": None,
}


@pytest.mark.parametrize("state", sorted(FAULTS))
def test_a_faulty_seed_imports_nothing(spark, tmp_path, base, state):
    seeds.exported(base, f"{tmp_path}/seed")
    if state == "missing":
        os.rename(f"{tmp_path}/seed/tables/a", f"{tmp_path}/elsewhere")
    else:
        FAULTS[state](base["a"]).write.mode("overwrite").parquet(f"{tmp_path}/seed/tables/a")
    told, done = seeds.imported(spark, f"{tmp_path}/seed", f"{tmp_path}/base")
    assert not done and not os.path.exists(f"{tmp_path}/base")
    assert {r.name: r.state for r in told.collect()} == {"a": state, "b": "intact", "none": "intact"}


def test_a_lost_copy_of_a_repeated_row_is_a_change(spark, base):
    digest = lambda df: seeds.evidence("a", df).first().digest
    assert digest(base["a"]) == digest(base["a"].repartition(1).select("v", "t", "k")) != digest(base["a"].distinct())
