"""Window, object and container labels from payload intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_int, r6
from .intervals import interval_join, overlap_length, span_iou, valid, with_covered

# Label vocabulary.
POSITIVE = "hidden_executable_payload"
NEGATIVE = "benign"


def label_name(label_id: Column) -> Column:
    return F.when(label_id == 1, POSITIVE).otherwise(NEGATIVE)


def sorted_set(value: Column) -> Column:
    """Sorted distinct values, NULL and empty strings removed."""
    return F.sort_array(F.collect_set(F.when(value != "", value)))


def payload_intervals(payloads: DataFrame) -> DataFrame:
    """Keep rows of the positive label with a real interval."""
    kept = valid(payloads, "offset_start", "offset_end")
    return kept.where(F.col("label") == POSITIVE) if "label" in payloads.columns else kept


def label_windows(
    windows: DataFrame,
    payloads: DataFrame,
    min_overlap_bytes: int = 1,
    min_overlap_ratio: float = 0.0,
    bucket_width: int = 65536,
) -> DataFrame:
    """Attach overlap evidence and labels to every window.

    Union overlap and best IoU use all overlaps; the match count, families and
    hashes only those above both thresholds.  Only overlapping windows are
    aggregated; the (usually small) result is joined back to all windows.
    """
    if min_overlap_bytes < 1 or not 0.0 <= min_overlap_ratio <= 1.0:
        raise ValueError("min_overlap_bytes >= 1 and 0 <= min_overlap_ratio <= 1 required")
    keys = ["container", "object_path"]
    spans = payload_intervals(payloads).select(
        *keys,
        F.col("offset_start").alias("p_start"),
        F.col("offset_end").alias("p_end"),
        "transform_family",
        "payload_sha256",
    )
    spans = with_covered(spans, keys, "p_start", "p_end").withColumn("p_fresh", F.greatest("p_start", "covered"))
    slim = windows.select(*keys, "window_id", "offset_start", "offset_end")
    pairs = interval_join(slim, spans, keys, ("offset_start", "offset_end"), ("p_start", "p_end"), bucket_width)
    s, e = F.col("offset_start"), F.col("offset_end")
    shared = overlap_length(s, e, F.col("p_start"), F.col("p_end"))
    match = (shared >= min_overlap_bytes) & (shared / (e - s) >= min_overlap_ratio)
    evidence = pairs.groupBy("container", "window_id").agg(
        F.sum(overlap_length(s, e, F.col("p_fresh"), F.col("p_end"))).alias("overlap_bytes"),
        F.max(span_iou(s, e, F.col("p_start"), F.col("p_end"))).alias("max_iou"),
        F.sum(as_int(match)).alias("matched_label_count"),
        sorted_set(F.when(match, F.col("transform_family"))).alias("transform_families"),
        sorted_set(F.when(match, F.col("payload_sha256"))).alias("payload_sha256s"),
    )
    joined = windows.join(evidence, ["container", "window_id"], "left")
    none = F.array().cast("array<string>")
    label_id = as_int(F.col("matched_label_count") > 0)
    size = F.col("offset_end") - F.col("offset_start")
    return joined.select(
        *windows.columns,
        label_name(label_id).alias("label"),
        label_id.alias("label_id"),
        F.coalesce("overlap_bytes", F.lit(0)).alias("overlap_bytes"),
        r6(F.coalesce(F.col("overlap_bytes") / size, F.lit(0.0))).alias("overlap_ratio"),
        r6(F.coalesce("max_iou", F.lit(0.0))).alias("max_iou"),
        F.coalesce("matched_label_count", F.lit(0)).cast("int").alias("matched_label_count"),
        F.coalesce("transform_families", none).alias("transform_families"),
        F.coalesce("payload_sha256s", none).alias("payload_sha256s"),
    )


def label_objects(labelled: DataFrame, payloads: DataFrame) -> DataFrame:
    """Positive when any payload interval exists for the object's path, matched by a window or not."""
    keys = ["container", "object_path"]
    truth = payload_intervals(payloads).groupBy(*keys).agg(
        sorted_set(F.col("transform_family")).alias("transform_families"),
        sorted_set(F.col("payload_sha256")).alias("payload_sha256s"),
    )
    rolled = labelled.groupBy("container", "object_id", "object_path").agg(
        F.count(F.lit(1)).alias("window_count"),
        F.sum("label_id").alias("positive_window_count"),
        r6(F.max("max_iou")).alias("max_window_iou"),
    )
    none = F.array().cast("array<string>")
    label_id = as_int(F.col("transform_families").isNotNull())
    return rolled.join(truth, keys, "left").select(
        "container",
        "object_id",
        "object_path",
        label_name(label_id).alias("label"),
        label_id.alias("label_id"),
        "window_count",
        "positive_window_count",
        "max_window_iou",
        F.coalesce("transform_families", none).alias("transform_families"),
        F.coalesce("payload_sha256s", none).alias("payload_sha256s"),
    )


def label_containers(objects: DataFrame, payloads: DataFrame) -> DataFrame:
    """Container labels; containers with payloads but no windows still appear.

    Hashes of a container are counted here; ``container_payloads`` lists them as
    rows, because their number is not bounded.
    """
    truth = payload_intervals(payloads).groupBy("container").agg(
        sorted_set(F.col("transform_family")).alias("transform_families"),
        F.countDistinct("payload_sha256").alias("payload_count"),
    )
    rolled = objects.groupBy("container").agg(
        F.count(F.lit(1)).alias("object_count"),
        F.sum("label_id").alias("positive_object_count"),
        F.sum("window_count").alias("window_count"),
        F.sum("positive_window_count").alias("positive_window_count"),
    )
    none = F.array().cast("array<string>")
    label_id = as_int(F.col("payload_count").isNotNull())
    return rolled.join(truth, "container", "full_outer").select(
        "container",
        label_name(label_id).alias("label"),
        label_id.alias("label_id"),
        *[
            F.coalesce(c, F.lit(0)).alias(c)
            for c in ("object_count", "positive_object_count", "window_count", "positive_window_count", "payload_count")
        ],
        F.coalesce("transform_families", none).alias("transform_families"),
    )


def container_payloads(payloads: DataFrame) -> DataFrame:
    """Distinct (container, payload hash) rows."""
    return payload_intervals(payloads).select("container", "payload_sha256").distinct()
