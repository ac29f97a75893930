"""Running sums over ranges of rows against one window per group."""

import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanstrata.operators import metrics, ordering, pooling


def single_window(df, keys, order, value, inclusive):
    spec = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return df.withColumn("s", F.coalesce(F.sum(value).over(spec), F.lit(0)))


def test_equals_single_window(spark):
    """Keys over many ranges and batches, null and NaN keys, null order values both ways, null values."""
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1.5, None, math.nan]), v if v % 11 else None, v, rng.choice([None, 1, 2, 5])) for v in rng.sample(range(4000), 3000)]
    df = spark.createDataFrame(rows, "k string, d double, o long, tie long, x int").repartition(7)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for order in ([F.col("o"), F.col("tie")], [F.col("o").desc(), F.col("tie")]):
            for value, inclusive in ((F.col("x"), True), (F.col("x") / 4, False)):
                want = {r.tie: r.s for r in single_window(df, ["k", "d"], order, value, inclusive).collect()}
                got = ordering.prefix_sums(df, ["k", "d"], order, {"s": (value, inclusive), "n": (F.lit(1), True)}, {"all": "n"}).collect()
                assert {r.tie: r.s for r in got} == want and len(got) == len(rows)
                assert all(r["all"] == sum((x.k, str(x.d)) == (r.k, str(r.d)) for x in got) for r in got[:20])
        placed = ordering.positions(df, [], [F.col("o").desc(), F.col("tie")], name="p").collect()
        nulls = [r.p for r in placed if r.o is None]
        assert min(nulls) == len(rows) - len(nulls) + 1
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ordering.prefix_sums(df.limit(0), ["k"], [F.col("o")], {"s": (F.col("x"), True)}, {"t": "s"}).count() == 0


def test_one_group_of_a_million_rows_spreads(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1_000_000).select(F.lit(0).alias("g"), (F.col("id") * 7919 % 1_000_003).alias("v"))
        placed = ordering.positions(df, ["g"], [F.col("v")])
        sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 1.5 * min(sizes)
        wrong = placed.select("v", "pos").join(df.select("v", F.row_number().over(Window.orderBy("v")).alias("n")), "v").where("pos <> n")
        assert wrong.count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sums_hold_inside_a_union(spark):
    """A union numbers its tasks anew; what earlier ranges carry over must still meet its range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 4001).alias("v"))
        placed = ordering.positions(df, ["g"], [F.col("v")], name="n")
        both = spark.range(5, numPartitions=3).select(F.lit(9).cast("long").alias("g"), F.lit(-1).cast("long").alias("v"), F.lit(0).cast("long").alias("n")).unionByName(placed)
        want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("v")).cast("long"))
        assert both.where("g < 9").exceptAll(want).count() == 0
        assert placed.coalesce(1).exceptAll(want).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sums_of_other_types_are_refused(spark):
    df = spark.createDataFrame([("a", "1")], "k string, v string")
    try:
        ordering.prefix_sums(df, ["k"], [F.col("v")], {"s": (F.col("v"), True)})
    except TypeError:
        return
    raise AssertionError


def test_null_scores_are_left_out(spark):
    rows = [(s / 10, int(s >= 5)) for s in range(10)] + [(None, 0)] * 3
    df = spark.createDataFrame(rows, "s double, y int")
    got = metrics.ranking_quality(df, F.col("s"), F.col("y")).first()
    assert (got.positives, got.negatives, got.auroc, got.auprc) == (5, 5, 1.0, 1.0)


def test_null_logits_are_chosen_last(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 0.5, None, 2.0, 1.0])], "bag int, item int, z double")
    assert sorted(r.item for r in pooling.top_k_pool(df, "bag", "item", "z", k=3).collect()) == [1, 3, 4]


def test_descending_buckets_put_nulls_last(spark):
    df = spark.createDataFrame([(1, v) for v in (5.0, None, 3.0, 4.0, None, 1.0)], "g int, v double")
    placed = ordering.positions(df, ["g"], [F.col("v").desc()], ordering.range_bucket(df, F.col("v"), 4, descending=True)).collect()
    assert [r.v for r in sorted(placed, key=lambda r: r.pos)] == [5.0, 4.0, 3.0, 1.0, None, None]
