"""How a window deviates from its neighbours, object and container, and where it lies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import classify as C
from ..functions.numeric import flag, log2_floor
from .ordering import materialize, positions, stored


def neighbor_delta(df: DataFrame, value: str = "entropy", half: int = 2, name: str = "delta_neighbor") -> DataFrame:
    """Value minus the mean of up to ``half`` windows on each side; 0 when alone.

    The window is one object's, whose size a file bounds.
    """
    spec = Window.partitionBy("container", "object_id").orderBy("offset_start").rowsBetween(-half, half)
    total, count = F.sum(value).over(spec), F.count(value).over(spec)
    delta = F.col(value) - (total - F.col(value)) / (count - 1)
    return df.withColumn(name, F.when(count > 1, delta).otherwise(F.lit(0.0)))


def group_delta(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Value minus the mean of its group.  Means are pre-aggregated, written and joined back,
    so few of them go to all tasks, and a container holding a third of all windows is never gathered in one task."""
    means = stored(df.groupBy(*keys).agg(F.avg(value).alias("_mean")), "means")
    return df.join(means, list(keys)).withColumn(name, F.col(value) - F.col("_mean")).drop("_mean")


def entropy_deltas(df: DataFrame, value: str = "entropy", half: int = 2) -> DataFrame:
    """Neighbour, object (by path) and container deltas."""
    out = neighbor_delta(df, value, half)
    out = group_delta(out, ["container", "object_path"], value, "delta_object")
    return group_delta(out, ["container"], value, "delta_container")


def window_positions(df: DataFrame) -> DataFrame:
    """Offset and index of a window inside its object, each scaled to [0, 1]; ties share the first index."""
    spec = Window.partitionBy("container", "object_id")
    last = F.max("offset_start").over(spec)
    count = F.count(F.lit(1)).over(spec)
    rank = F.rank().over(spec.orderBy("offset_start")) - 1
    return df.withColumns(
        {
            "offset_norm": F.col("offset_start") / F.greatest(last, F.lit(1)),
            "index_norm": rank / F.greatest(count - 1, F.lit(1)),
        }
    )


def object_positions(df: DataFrame, ordinal: str) -> DataFrame:
    """Index of an object among its container's objects by first appearance, scaled to [0, 1]."""
    keys = ["container", "object_id"]
    first = df.groupBy(*keys).agg(F.min(ordinal).alias("_first"))
    order = [F.col("_first"), F.col("object_id")]
    placed = positions(first, ["container"], order, name="_pos")
    sizes = first.groupBy("container").agg(F.count(F.lit(1)).alias("_objects"))
    scaled = placed.join(sizes, "container").select(
        *keys, ((F.col("_pos") - 1) / F.greatest(F.col("_objects") - 1, F.lit(1))).alias("object_index_norm")
    )
    return df.join(scaled, keys)


def object_context(df: DataFrame, object_type: Column) -> DataFrame:
    """Object size (largest window end) as log2 floor, and two type flags."""
    size = F.max("offset_end").over(Window.partitionBy("container", "object_id"))
    return df.withColumns(
        {
            "object_size_log2": log2_floor(F.greatest(size, F.lit(1))),
            "object_type_is_embedded_archive": flag(object_type == "embedded_archive"),
            "object_type_is_asset_blob": flag(object_type == "asset_blob"),
        }
    )


GROUPS = {
    "entropy": ["entropy", "printable_ratio"],
    "deltas": ["delta_neighbor", "delta_object", "delta_container"],
    "bytes": [
        "byte_printable_ratio", "byte_zero_ratio", "byte_high_bit_ratio", "byte_ascii_ratio", "byte_chi2_uniform",
        "byte_unique_count_log2", "byte_range_span", "byte_max_run_len_log2",
    ],
    "position": ["offset_norm", "index_norm", "object_index_norm"],
    "magic": ["has_dex_magic", "has_elf_magic", "has_png_magic", "has_zip_local_header"],
    "context": ["object_size_log2", "object_type_is_embedded_archive", "object_type_is_asset_blob"],
}
DEFAULT_GROUPS = ("entropy", "deltas", "bytes", "position")


def byte_distribution(stats: Column, n: Column, runs: Column) -> dict[str, Column]:
    """Eight scale-free byte statistics."""
    size = F.greatest(n, F.lit(1))
    return {
        "byte_printable_ratio": stats["printable"] / size,
        "byte_zero_ratio": stats["zero"] / size,
        "byte_high_bit_ratio": stats["high"] / size,
        "byte_ascii_ratio": stats["visible"] / size,
        "byte_chi2_uniform": B.chi_square_of(stats, n) / size,
        "byte_unique_count_log2": log2_floor(stats["unique"]),
        "byte_range_span": F.when(n > 0, (stats["top"] - stats["low"]) / 255.0).otherwise(0.0),
        "byte_max_run_len_log2": log2_floor(runs["run_len"]),
    }


def handcrafted_table(windows: DataFrame, ordinal: str, object_type: Column, groups: Sequence[str] = DEFAULT_GROUPS) -> DataFrame:
    """The full per-window feature table in a stable column order.

    windows: data, stats, n, runs, entropy, printable_ratio, offsets, keys, ``ordinal``.  What the bytes
    give is written once (``materialize``): the means of objects and containers and the places of objects
    are branches that would each read and count all bytes again.
    """
    df = windows
    if "bytes" in groups:
        df = df.withColumns(byte_distribution(F.col("stats"), F.col("n"), F.col("runs")))
    if "magic" in groups:
        df = df.withColumns(C.magic_scan(F.col("data")))
    df = materialize(df.drop("data", "stats", "runs"))
    if "deltas" in groups:
        df = entropy_deltas(df)
    if "position" in groups:
        df = object_positions(window_positions(df), ordinal)
    if "context" in groups:
        df = object_context(df, object_type)
    names = [c for g in GROUPS if g in groups for c in GROUPS[g]]
    return df.select("container", "object_id", "window_id", *names)


def section_coverage(windows: DataFrame, sections: DataFrame, types: Sequence[str], other: str) -> DataFrame:
    """Share of each window per section type, dominant type index and log2(boundaries + 1).

    sections: container, object_id, s_start, s_end, section_type; disjoint per object.
    Bytes outside every section count as ``other``.  Windows of objects without
    sections get shares of ``other`` only.
    """
    from .intervals import interval_join

    keys = ["container", "object_id"]
    slim = windows.select(*keys, "window_id", "offset_start", "offset_end")
    pairs = interval_join(slim, sections, keys, ("offset_start", "offset_end"), ("s_start", "s_end"))
    inner = pairs.select(
        *keys, "window_id", "offset_start", "offset_end",
        F.greatest("offset_start", "s_start").alias("a"), F.least("offset_end", "s_end").alias("b"), "section_type",
    )
    by_window = Window.partitionBy(*keys, "window_id").orderBy("a")
    prev_end = F.coalesce(F.lag("b").over(by_window), F.col("offset_start"))
    prev_type = F.lag("section_type").over(by_window)
    next_start = F.lead("a").over(by_window)
    steps = inner.withColumns({"pe": prev_end, "pt": prev_type, "last": next_start.isNull()})
    gap = F.greatest(F.col("a") - F.col("pe"), F.lit(0))
    tail = F.when(F.col("last"), F.greatest(F.col("offset_end") - F.col("b"), F.lit(0))).otherwise(0)
    # Changes of type at this piece's start, at the gap before it and at the tail after it.
    seen = F.when(gap > 0, F.lit(other)).otherwise(F.col("pt"))
    into_gap = (gap > 0) & F.col("pt").isNotNull() & (F.col("pt") != other)
    into_piece = seen.isNotNull() & (seen != F.col("section_type"))
    into_tail = (tail > 0) & (F.col("section_type") != other)
    marks = F.filter(
        F.array(F.when(into_gap | into_piece, F.col("a")), F.when(into_tail, F.col("b"))), lambda x: x.isNotNull()
    )
    pieces = steps.select(
        *keys, "window_id", "offset_start", "offset_end", "section_type", (F.col("b") - F.col("a")).alias("len"),
        (gap + tail).alias("gap"), F.size(F.array_distinct(marks)).alias("edges"),
    )
    sums = pieces.groupBy(*keys, "window_id").agg(
        *[F.sum(F.when(F.col("section_type") == x, F.col("len")).otherwise(0)).alias(f"_{x}") for x in types],
        F.sum("gap").alias("_gap"),
        F.sum("edges").alias("_edges"),
    )
    joined = windows.select(*keys, "window_id", "offset_start", "offset_end").join(sums, [*keys, "window_id"], "left")
    size = F.col("offset_end") - F.col("offset_start")
    filled = joined.withColumns(
        {
            f"_{x}": F.coalesce(F.col(f"_{x}"), F.lit(0))
            + (F.when(F.col("_edges").isNull(), size).otherwise(F.col("_gap")) if x == other else 0)
            for x in types
        }
    )
    parts = F.array(*[F.col(f"_{x}") for x in types])
    dominant = F.array_position(parts, F.array_max(parts)) - 1
    return filled.select(
        *keys, "window_id",
        *[(F.col(f"_{x}") / size).alias(f"share_{x}") for x in types],
        (dominant / max(len(types) - 1, 1)).alias("dominant"),
        F.log2(F.coalesce("_edges", F.lit(0)) + F.lit(1.0)).alias("boundaries_log2"),
    )


def byte_section_runs(windows: DataFrame, sections: DataFrame, default: str) -> DataFrame:
    """Section label of every byte of a window as maximal runs; later sections win overlaps.

    sections: container, object_id, s_start, s_end, section_type, section_index.
    Only the boundaries inside a window are handled, never single bytes.
    """
    from .intervals import interval_join

    keys = ["container", "object_id", "window_id"]
    slim = windows.select(*keys, "offset_start", "offset_end")
    pairs = interval_join(
        slim, sections, ["container", "object_id"], ("offset_start", "offset_end"), ("s_start", "s_end")
    ).select(
        *keys, "offset_start", "offset_end", F.greatest("offset_start", "s_start").alias("a"),
        F.least("offset_end", "s_end").alias("b"), "section_type", "section_index",
    )
    cuts = (
        pairs.select(*keys, F.explode(F.array("a", "b")).alias("at"))
        .unionByName(slim.select(*keys, F.explode(F.array("offset_start", "offset_end")).alias("at")))
        .distinct()
    )
    spec = Window.partitionBy(*keys).orderBy("at")
    atoms = cuts.withColumn("to", F.lead("at").over(spec)).where(F.col("to").isNotNull())
    owned = pairs.select(*keys, "a", "b", "section_type", "section_index")
    hit = atoms.join(owned, keys, "left").where("a IS NULL OR (at >= a AND to <= b) OR (to <= a OR at >= b)")
    inside = (F.col("at") >= F.col("a")) & (F.col("to") <= F.col("b"))
    label = hit.groupBy(*keys, "at", "to").agg(
        F.max(F.when(inside, F.struct("section_index", "section_type"))).alias("w")
    )
    named = label.select(*keys, "at", "to", F.coalesce(F.col("w.section_type"), F.lit(default)).alias("section_type"))
    change = F.coalesce(F.lag("section_type").over(spec) != F.col("section_type"), F.lit(True))
    islands = named.withColumn("_c", F.when(change, 1).otherwise(0)).withColumn("_i", F.sum("_c").over(spec))
    return islands.groupBy(*keys, "_i", "section_type").agg(F.min("at").alias("run_start"), F.max("to").alias("run_end")).drop("_i")
