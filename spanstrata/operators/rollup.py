"""Scores rolled up window -> object -> container."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_int, r6


def window_score(entropy: Column, printable: Column, entropy_weight: float = 1.0, nonprintable_weight: float = 0.0) -> Column:
    return r6(entropy * entropy_weight + (F.lit(1.0) - printable) * nonprintable_weight)


def predict_windows(
    labelled: DataFrame, threshold: float = 7.0, entropy_weight: float = 1.0, nonprintable_weight: float = 0.0
) -> DataFrame:
    """Add score, threshold and the hard decision ``score >= threshold``."""
    if min(threshold, entropy_weight, nonprintable_weight) < 0:
        raise ValueError("threshold and weights must be non-negative")
    score = window_score(F.col("entropy"), F.col("printable_ratio"), entropy_weight, nonprintable_weight)
    return labelled.withColumns({"score": score, "threshold": F.lit(float(threshold))}).withColumn(
        "predicted_label_id", as_int(F.col("score") >= F.col("threshold"))
    )


def rollup_objects(windows: DataFrame, threshold: float, from_score: bool = True) -> DataFrame:
    """Object score = max window score; span = bounding box of predicted windows.

    ``from_score``: decide by the score; otherwise by any predicted window.
    """
    hit = F.col("predicted_label_id") == 1
    rolled = windows.groupBy("container", "object_id", "object_path").agg(
        r6(F.max("score")).alias("score"),
        F.max("predicted_label_id").alias("_any"),
        F.max("label_id").alias("true_label_id"),
        F.count(F.lit(1)).alias("window_count"),
        F.sum("predicted_label_id").alias("predicted_window_count"),
        F.sum("label_id").alias("positive_window_count"),
        F.min(F.when(hit, F.col("offset_start"))).alias("predicted_offset_start"),
        F.max(F.when(hit, F.col("offset_end"))).alias("predicted_offset_end"),
    )
    decided = as_int(F.col("score") >= threshold) if from_score else F.col("_any")
    return rolled.withColumn("predicted_label_id", decided).drop("_any")


def rollup_containers(objects: DataFrame, threshold: float, from_score: bool = True) -> DataFrame:
    rolled = objects.groupBy("container").agg(
        r6(F.max("score")).alias("score"),
        F.max("predicted_label_id").alias("_any"),
        F.max("true_label_id").alias("true_label_id"),
        F.count(F.lit(1)).alias("object_count"),
        F.sum("predicted_label_id").alias("predicted_object_count"),
        F.sum("true_label_id").alias("positive_object_count"),
        F.sum("window_count").alias("window_count"),
        F.sum("predicted_window_count").alias("predicted_window_count"),
        F.sum("positive_window_count").alias("positive_window_count"),
    )
    decided = as_int(F.col("score") >= threshold) if from_score else F.col("_any")
    return rolled.withColumn("predicted_label_id", decided).drop("_any")


def localization_spans(windows: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(truth, prediction) interval sets of the positive objects: positive windows vs one bounding span."""
    keys = ["container", "object_id"]
    truth = windows.where(F.col("label_id") == 1).select(
        *keys, F.col("offset_start").alias("start"), F.col("offset_end").alias("end")
    )
    pred = objects.where((F.col("true_label_id") == 1) & F.col("predicted_offset_start").isNotNull()).select(
        *keys, F.col("predicted_offset_start").alias("start"), F.col("predicted_offset_end").alias("end")
    )
    return truth, pred
