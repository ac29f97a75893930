"""Cutting objects into byte windows.  Narrow: one Generate, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions.numeric import r6, ratio


def window_starts(size: Column, width: int, stride: int, include_tail: bool = True) -> Column:
    """Start offsets of full windows plus, if wanted, one tail window ending at ``size``."""
    full = F.sequence(F.lit(0), size - width, F.lit(stride))
    starts = F.array_union(full, F.array(size - width)) if include_tail else full
    return F.when(size <= 0, F.array().cast("array<int>")).when(size <= width, F.array(F.lit(0))).otherwise(starts)


def byte_windows(
    objects: DataFrame,
    width: int = 4096,
    stride: int = 2048,
    min_size: int = 1,
    include_tail: bool = True,
    keep: tuple[str, ...] = ("container", "object_id", "object_path"),
) -> DataFrame:
    """One row per window with its bytes in ``data``; the index counts before ``min_size``."""
    if width <= 0 or stride <= 0 or min_size <= 0:
        raise ValueError("width, stride and min_size must be positive")
    size = F.length("content")
    cut = objects.select(
        *keep, "content", F.posexplode(window_starts(size, width, stride, include_tail)).alias("window_index", "_s")
    )
    return cut.select(
        *keep,
        "window_index",
        F.format_string("%s:r%06d", "object_id", "window_index").alias("window_id"),
        F.col("_s").cast("long").alias("offset_start"),
        F.least(F.col("_s") + width, F.length("content")).cast("long").alias("offset_end"),
        F.substring(F.col("content"), F.col("_s") + 1, F.lit(width)).alias("data"),
    ).where(F.length("data") >= min_size)


def cut_first(windows: DataFrame) -> DataFrame:
    """The same windows, whose bytes are cut before anything that follows.

    Spark moves an expression that is used once into the Python kernel's argument; then each window
    waits for its kernel together with its whole object, in memory or on disk.  It moves nothing past a
    condition on a column that depends on the partition; this one always holds.
    """
    return windows.withColumn("_cut", F.spark_partition_id()).where("_cut >= 0").drop("_cut")


def with_stats(windows: DataFrame, data: str = "data") -> DataFrame:
    """Attach ``n`` (bytes) and ``stats`` (``byte_stats``)."""
    return windows.withColumns({"n": F.length(data), "stats": B.byte_stats(F.col(data))})


def with_histogram(windows: DataFrame, data: str = "data") -> DataFrame:
    """Attach ``n`` (bytes) and ``hist`` (256 counts)."""
    return windows.withColumns({"n": F.length(data), "hist": B.byte_histogram(F.col(data))})


def scored_windows(
    objects: DataFrame, width: int = 4096, stride: int = 2048, min_size: int = 1, include_tail: bool = True,
    keep: tuple[str, ...] = ("container", "object_id", "object_path"),
) -> DataFrame:
    """Windows with digest, entropy and printable ratio; the bytes themselves are dropped."""
    w = with_stats(byte_windows(objects, width, stride, min_size, include_tail, keep))
    return w.select(
        *keep,
        "window_index",
        "window_id",
        "offset_start",
        "offset_end",
        F.col("n").alias("size"),
        F.sha2("data", 256).alias("sha256"),
        r6(F.col("stats.entropy")).alias("entropy"),
        r6(ratio(F.col("stats.printable"), F.col("n"))).alias("printable_ratio"),
    )


WHOLE, SLIDING = "whole_entry", "window"


def typed_windows(
    objects: DataFrame, width: int = 4096, stride: int = 2048, min_size: int = 256,
    keep: tuple[str, ...] = ("container", "object_id"),
) -> DataFrame:
    """Start at every stride, drop remnants below ``min_size``; a tiny object is one window."""
    n = F.length("content")
    starts = F.when(n < min_size, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)), lambda s: n - s >= min_size)
    )
    listed = objects.select(*keep, n.alias("_n"), starts.alias("_starts"))
    return listed.select(
        *keep, "_n", F.size("_starts").alias("n_windows"), F.posexplode("_starts").alias("window_index", "_s")
    ).select(
        *keep,
        "window_index",
        F.when(F.col("_n") < min_size, WHOLE).otherwise(SLIDING).alias("section_type"),
        F.col("_s").cast("long").alias("offset_start"),
        F.least(F.col("_s") + width, F.col("_n")).cast("long").alias("offset_end"),
        "n_windows",
    )


def section_windows(
    objects: DataFrame, sections: DataFrame, width: int = 4096, stride: int = 2048, min_size: int = 256,
    whole_section: int = 8192,
) -> DataFrame:
    """Section-aware cut: small sections stay whole, large ones slide; no sections -> ``typed_windows``.

    ``sections``: container, object_id, section_index, section_type, offset, size.
    """
    keys = ["container", "object_id"]
    starts = F.when(F.col("size") <= whole_section, F.array(F.col("offset"))).otherwise(
        F.filter(
            F.sequence(F.col("offset"), F.col("offset") + F.col("size") - 1, F.lit(stride).cast("long")),
            lambda s: F.col("offset") + F.col("size") - s >= min_size,
        )
    )
    stop = F.col("offset") + F.col("size")
    cut = sections.select(*keys, "section_index", "section_type", "offset", "size", F.explode(starts).alias("offset_start"))
    cut = cut.withColumn(
        "offset_end",
        F.when(F.col("size") <= whole_section, stop).otherwise(F.least(F.col("offset_start") + width, stop)),
    )
    by_object = Window.partitionBy(*keys)
    inside = cut.select(
        *keys,
        (F.row_number().over(by_object.orderBy("section_index", "offset_start")) - 1).alias("window_index"),
        "section_type",
        "offset_start",
        "offset_end",
        F.count(F.lit(1)).over(by_object).cast("int").alias("n_windows"),
    )
    bare = objects.join(sections.select(*keys).distinct(), keys, "left_anti")
    return inside.unionByName(typed_windows(bare, width, stride, min_size))


def leading_windows(windows: DataFrame, per_object: int | None = None) -> DataFrame:
    """All windows, or the first ``per_object`` of each object by the index made while cutting."""
    return windows if per_object is None else windows.where(F.col("window_index") < per_object)
