import os

import pytest
from pyspark.sql import functions as F

from millrace import session


def test_materialised_tables_are_kept_and_cleared(spark):
    kept = session.materialised(spark.range(5).withColumn("x", F.col("id") * 2), "t")
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert kept.count() == 5 and os.path.isdir(path)
    assert session.clear_materialised(spark) >= 1
    assert not os.path.isdir(path)


def test_empty_table_keeps_its_schema(spark):
    kept = session.materialised(spark.range(0).withColumn("x", F.array(F.lit("a"))), "t")
    assert kept.count() == 0 and kept.columns == ["id", "x"]


def test_small_tables_are_broadcast_large_ones_not(spark, monkeypatch):
    small = session.broadcast_if_small(spark.range(10).withColumnRenamed("id", "k"), "s")
    plan = lambda df: spark.range(100).withColumnRenamed("id", "k").join(df, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(small)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 100)
    assert "strategy=broadcast" not in plan(session.broadcast_if_small(spark.range(10).withColumnRenamed("id", "k"), "s"))


def test_checkpoint_is_reliable(spark):
    df = session.checkpointed(spark.range(3))
    assert "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
    assert df._jdf.queryExecution().toRdd().toJavaRDD().isCheckpointed() or df.count() == 3


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        pytest.skip("not set here")
    assert session.shared_dir(spark) == configured


def test_spread_leaves_wide_tables_alone(spark):
    narrow, wide = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, 4)
    assert session.spread(narrow).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(wide) is wide
