"""Algebra of half-open intervals.  Touching intervals merge; end <= start is no interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length of two intervals; 0 when either side is missing."""
    shared = F.least(e1, e2) - F.greatest(s1, s2)
    known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    return F.when(known, F.greatest(shared, F.lit(0))).otherwise(F.lit(0))


def span_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the bounding span of one pair of intervals."""
    shared = overlap_length(s1, e1, s2, e2)
    span = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when((shared > 0) & (span > 0), shared.cast("double") / span.cast("double")).otherwise(F.lit(0.0))


def valid(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    return df.where(F.col(end) > F.col(start))


def start_bucket(start: str, width: int) -> Column:
    return F.floor(F.col(start) / width).cast("long")


def with_covered(
    df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", bucket_width: int | None = None
) -> DataFrame:
    """Add ``covered``: the furthest end of earlier intervals of the key (NULL for the first)."""
    bucket = start_bucket(start, bucket_width) if bucket_width else None
    return running(df, keys, [F.col(start), F.col(end)], {"covered": ("max", F.col(end), False)}, bucket)


def disjoint_parts(
    df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", bucket_width: int | None = None
) -> DataFrame:
    """Rewrite intervals so they keep their union but no two overlap.

    Every row becomes the part not covered by earlier rows, so union lengths and
    intersections are plain sums and need no merge step.
    """
    parts = with_covered(valid(df, start, end), keys, start, end, bucket_width)
    fresh = F.greatest(F.col(start), F.col("covered"))
    return parts.withColumn(start, fresh).drop("covered").where(F.col(end) > F.col(start))


def merge_intervals(
    df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", bucket_width: int | None = None
) -> DataFrame:
    """Union of intervals per key as maximal disjoint intervals."""
    slim = valid(df, start, end).select(*keys, start, end).distinct()
    opened = with_covered(slim, keys, start, end, bucket_width).withColumn(
        "_new", F.when(F.col("covered").isNull() | (F.col(start) > F.col("covered")), 1).otherwise(0)
    )
    bucket = start_bucket(start, bucket_width) if bucket_width else None
    islands = running(opened, keys, [F.col(start), F.col(end)], {"_island": ("sum", F.col("_new"), True)}, bucket)
    return (
        islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
    )


def union_length(
    df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", bucket_width: int | None = None,
    name: str = "union_length",
) -> DataFrame:
    parts = disjoint_parts(df, keys, start, end, bucket_width)
    return parts.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias(name))


def interval_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str],
    bucket_width: int = 65536,
) -> DataFrame:
    """All overlapping pairs of equal keys, each exactly once.

    Both sides are spread over fixed-width buckets of the axis, so the join is
    an equi-join on (keys, bucket): one key with very many intervals is split
    over tasks and distant pairs never meet.  A pair is emitted only in the
    bucket where its overlap begins, so no deduplication is needed.
    The remaining columns of both sides must have distinct names.
    """
    (ls, le), (rs, re) = left_span, right_span

    def spread(df, s, e):
        slots = F.sequence(F.floor(F.col(s) / bucket_width), F.floor((F.col(e) - 1) / bucket_width))
        return df.where(F.col(e) > F.col(s)).withColumn("_slot", F.explode(slots))

    on = [*keys, "_slot"]
    pairs = spread(left, ls, le).join(spread(right, rs, re), on)
    return pairs.where(
        (F.col(ls) < F.col(re))
        & (F.col(rs) < F.col(le))
        & (F.col("_slot") == F.floor(F.greatest(F.col(ls), F.col(rs)) / bucket_width))
    ).drop("_slot")


def set_overlap(
    truth: DataFrame, prediction: DataFrame, keys: Sequence[str], bucket_width: int = 65536,
    sweep_width: int | None = None,
) -> DataFrame:
    """Per key: union lengths and bounds of both interval sets and their intersection.

    Columns: keys, truth_len, truth_start, truth_end, pred_len, pred_start, pred_end, inter_len.
    """

    def side(df, tag):
        parts = disjoint_parts(df.select(*keys, "start", "end"), keys, bucket_width=sweep_width)
        return parts.select(*keys, F.col("start").alias(f"{tag}_s"), F.col("end").alias(f"{tag}_e"))

    def summary(parts, tag):
        return parts.groupBy(*keys).agg(
            F.sum(F.col(f"{tag}_e") - F.col(f"{tag}_s")).alias(f"{tag}_len"),
            F.min(f"{tag}_s").alias(f"{tag}_start"),
            F.max(f"{tag}_e").alias(f"{tag}_end"),
        )

    t, p = side(truth, "truth"), side(prediction, "pred")
    shared = (
        interval_join(t, p, keys, ("truth_s", "truth_e"), ("pred_s", "pred_e"), bucket_width)
        .groupBy(*keys)
        .agg(F.sum(F.least("truth_e", "pred_e") - F.greatest("truth_s", "pred_s")).alias("inter_len"))
    )
    both = summary(t, "truth").join(summary(p, "pred"), list(keys), "full_outer").join(shared, list(keys), "left")
    return both.fillna(0, ["truth_len", "pred_len", "inter_len"])


def set_iou(inter: Column, left: Column, right: Column, empty: float = 0.0) -> Column:
    union = left + right - inter
    return F.when(union <= 0, F.lit(empty)).otherwise(inter.cast("double") / union.cast("double"))


def boundary_error(ts: Column, te: Column, ps: Column, pe: Column) -> Column:
    """Distance of the outer bounds; twice the truth span when nothing was predicted."""
    missing = (te - ts) * 2
    return F.when(ts.isNull(), F.lit(0.0)).otherwise(
        F.when(ps.isNull(), missing).otherwise(F.abs(ps - ts) + F.abs(pe - te)).cast("double")
    )
