import pytest
from pyspark.sql import functions as F

from railweave.scale import is_small, lookup_join, numbered


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has one key, some have none."""
    return spark.range(6_000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 97).alias("k"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookups_beyond_the_bound_give_what_a_broadcast_gives(spark, skewed, how):
    small = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    wide = lookup_join(skewed, small, ["k"], how, max_rows=5)
    assert sorted(map(str, lookup_join(skewed, small, ["k"], how).select(sorted(wide.columns)).collect())) == sorted(map(str, wide.select(sorted(wide.columns)).collect()))


def test_a_hot_key_is_many_tasks(spark, skewed):
    small = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plan = lookup_join(skewed, small, ["k"], "inner", max_rows=5)
    assert "_salt" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.where("k = 0").count() == skewed.where("k = 0").count() > 2_000


def test_size_is_measured_in_bytes_too(spark):
    wide = spark.range(10).select("id", F.array_repeat(F.lit("x" * 100), 100).alias("a"))
    assert is_small(wide) and not is_small(wide, max_bytes=50_000) and not is_small(wide, max_rows=9) and is_small(wide.limit(0))


def test_numbers_in_order(spark):
    df = spark.range(1_000).select(((F.col("id") * 7919) % 1_000).alias("v"))
    assert [tuple(r) for r in numbered(df, ["v"], "n").orderBy("n").collect()] == [(i, i) for i in range(1_000)]
