from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException

from nitrapanel.session import materialize, scratch_path, shared_dir, ship_package


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert spark.sparkContext.getCheckpointDir() is not None or shared_dir(spark)
    if named:
        assert shared_dir(spark) == named
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_materialize_cuts_lineage_and_keeps_types(spark):
    df = spark.range(10).selectExpr("id", "id % 2 = 0 as flag", "array(id) as xs")
    stored = materialize(df, "numbers")
    assert stored.schema.simpleString() == df.schema.simpleString()
    assert stored.orderBy("id").collect() == df.orderBy("id").collect()
    assert "Range" not in stored._jdf.queryExecution().optimizedPlan().toString()


def test_scratch_folder_is_removed_with_its_application(spark):
    from nitrapanel.session import drop_scratch

    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    drop_scratch(spark)
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)


def test_package_is_shipped_once(spark):
    ship_package(spark)
    before = list(spark.sparkContext.listFiles)
    ship_package(spark)
    assert list(spark.sparkContext.listFiles) == before
    assert any("nitrapanel" in f for f in before)
