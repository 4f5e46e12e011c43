"""Numbering and gathering hold after steps that deal rows anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.order import settled, with_position
from sluice.plans import recipe


def test_index_after_sort(spark):
    df = spark.range(2_000_000, numPartitions=9).withColumn("k", F.xxhash64("id"))
    found = recipe.Frame(df).sort(by="k").create.index(output="n").df
    n = found.agg(F.count("*").alias("n"), F.countDistinct("n").alias("d"), F.min("n").alias("a"), F.max("n").alias("b")).first()
    assert tuple(n) == (2_000_000, 2_000_000, 1, 2_000_000)
    # rising numbers have rising keys: each thousand ends before the next begins
    steps = found.groupBy(F.floor(F.col("n") / 1000).alias("t")).agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("t").collect()
    assert all(x["b"] < y["a"] for x, y in zip(steps, steps[1:], strict=False))


def test_accordion_after_sort(spark):
    df = spark.range(300_000).select("id", F.xxhash64("id").alias("k"), F.array(F.concat(F.lit("a"), F.col("id")), F.concat(F.lit("b"), F.col("id"))).alias("xs"))
    found = recipe.Frame(df).sort(by="k").accordion(input="xs", wrangles=[{"convert.case": {"input": "xs", "case": "upper"}}]).df
    right = F.col("xs") == F.array(F.concat(F.lit("A"), F.col("id")), F.concat(F.lit("B"), F.col("id")))
    assert found.where(~right).count() == 0 and found.count() == 300_000


def test_concatenate_after_sort(spark):
    df = spark.range(50_000).select("id", F.xxhash64("id").alias("k")).orderBy("k")
    left, right = with_position(df, "p"), with_position(df.select(F.col("k").alias("j"), "id"), "p")
    assert left.join(right, "p").where("k <> j").count() == 0


def test_settled_leaves_scans_alone(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where("id > 2").select((F.col("id") * 2).alias("x"))
    assert settled(df) is df
    assert settled(df.orderBy("x")) is not df
    assert settled(df.withColumn("r", F.rand())) is not df
    assert sorted(r["p"] for r in with_position(spark.range(0), "p").collect()) == []
