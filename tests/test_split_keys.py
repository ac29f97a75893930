"""Rows that share a key."""

from pyspark.sql import functions as F

from spanstrata.operators import sampling


def test_rows_of_one_key_are_neither_multiplied_nor_parted(spark):
    df = spark.range(120).select((F.col("id") % 60).alias("k"), F.lit("g").alias("g"), (F.col("id") % 60 % 3 == 0).cast("int").alias("y"))
    got = sampling.fit_calibration_split(df, 0.4, 30, 10, "g", "y", "k", 9)
    rows = got.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("parts")).collect()
    assert len(rows) == 60 and all((r.n, r.parts) == (2, 1) for r in rows)
