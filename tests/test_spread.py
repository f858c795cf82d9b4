"""Joins on a key that holds most of the rows."""

import pytest
from pyspark.sql import functions as F

from leasegrain.operators.spread import shares, spread_join


@pytest.fixture(scope="module")
def tables(spark):
    large = spark.range(10000).selectExpr("if(id < 9000, 'hot', concat('k', id % 500)) AS k", "id")
    small = spark.sql("SELECT 'hot' AS k, 1 AS v UNION ALL SELECT concat('k', id), 2 FROM range(400)")
    return large, small


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_rows_are_those_of_a_plain_join(tables, how):
    large, small = tables
    assert sorted(map(str, spread_join(large, small, ["k"], ["id"], how).collect())) == sorted(
        map(str, large.join(small, ["k"], how).collect())
    )


def test_no_task_holds_more_than_twice_its_portion(spark, tables):
    large, _ = tables
    counts = large.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = (
        large.withColumn("part", F.pmod(F.xxhash64("id"), shares(counts, ["k"]))).groupBy("k", "part").count().collect()
    )
    assert max(r["count"] for r in sizes) < 2 * 10000 / tasks
    assert {r.part for r in sizes if r.k != "hot"} == {0}


def test_empty_sides(spark, tables):
    large, small = tables
    assert spread_join(large.limit(0), small, ["k"], ["id"]).count() == 0
    assert spread_join(large, small.limit(0), ["k"], ["id"], "left").count() == 10000
