"""A third of all lines on one part, one order and one supplier; no side is broadcast."""

import os
import shutil

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
NAMES = ["job_links", "establishments", "job_flow", "census_competitors", "scraped_competitors", "enrolments",
         "panel", "panel_dedupe", "latest_per_pair", "future_matrix", "stratified_split", "recommendation_table"]


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    for name in os.listdir(SF):
        if name != "lineitem.parquet":
            shutil.copyfile(f"{SF}/{name}", f"{folder}/{name}")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    part = spark.read.parquet(f"{SF}/part.parquet").filter("p_size <= 3").agg(F.min("p_partkey")).first()[0]
    hot = F.col("l_linenumber") <= 2
    lines.withColumns({
        "l_partkey": F.when(hot, F.lit(part)).otherwise(F.col("l_partkey")),
        "l_orderkey": F.when(hot, F.lit(7)).otherwise(F.col("l_orderkey")),
        "l_suppkey": F.when(hot, F.lit(3)).otherwise(F.col("l_suppkey")),
    }).coalesce(1).write.parquet(f"{folder}/lines")
    written = [f for f in os.listdir(f"{folder}/lines") if f.endswith(".parquet")][0]
    shutil.copyfile(f"{folder}/lines/{written}", f"{folder}/lineitem.parquet")
    keep = {k: "-1" for k in ("spark.sql.autoBroadcastJoinThreshold",
                              "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k, v in keep.items():
        spark.conf.set(k, v)
    # Small thresholds, so that the hot partitions are split even at this size.
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20KB")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "10KB")
    yield folder
    for k in (*keep, "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
              "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        spark.conf.unset(k)


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys_without_broadcast(spark, skewed, name):
    df = contract.queries()[name](spark, skewed)
    assert compare(df, connect(skewed), contract.oracle_sql()[name]) == ""
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("BroadcastHashJoin", "NestedLoop", "CartesianProduct"):
        assert bad not in plan, bad


def test_hot_partitions_are_split(spark, skewed):
    """At least the join of the lines with their hot part is read in several pieces."""
    lines = spark.read.parquet(f"{skewed}/lineitem.parquet").select("l_partkey", "l_linenumber", "l_extendedprice")
    parts = spark.read.parquet(f"{skewed}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    joined = lines.repartition(4, "l_linenumber").join(parts, "l_partkey")
    rows = joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == lines.count() and ("skew=true" in plan or "skewed" in plan)
