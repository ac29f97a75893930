"""Feature tables of windows and objects built from the byte kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import classify as C
from ..functions.numeric import flag, log2_at_least, r6, ratio
from .ordering import stored


def long_form(df: DataFrame, keys: list[str], names: list[str], digits: bool = True) -> DataFrame:
    """(keys, feature, value) rows."""
    cell = lambda c: r6(F.col(c).cast("double")) if digits else F.col(c).cast("double")
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), cell(c).alias("value")) for c in names])
    return df.select(*keys, F.inline(rows))


def chunk_stats(entropies: Column, whole: Column) -> dict[str, Column]:
    """Mean, std, max, min, range and slope of sub-window entropies; the whole's entropy when there is none."""
    none = F.size(entropies) == 0
    zero = F.lit(0.0)
    top, low = F.array_max(entropies), F.array_min(entropies)
    return {
        "mean": F.when(none, whole).otherwise(B.mean_of(entropies)),
        "std": F.when(none, zero).otherwise(B.spread_of(entropies)),
        "max": F.when(none, whole).otherwise(top),
        "min": F.when(none, whole).otherwise(low),
        "range": F.when(none, zero).otherwise(top - low),
        "slope": F.when(none, zero).otherwise(B.slope_of(entropies)),
    }


SUMMARY = [
    "s_entropy", "s_chunk_entropy_mean", "s_chunk_entropy_std", "s_printable_ratio", "s_zero_ratio",
    "s_longest_zero_run_ratio", "s_high_byte_ratio", "s_duplicate_block_ratio", "s_length_log1p",
]


def byte_summary(df: DataFrame, keys: list[str], chunk: int = 256, block: int = 16) -> DataFrame:
    """Nine scalars per value of ``data``, rounded to six decimals."""
    base = df.select(
        *keys, F.length("data").alias("n"), B.byte_stats(F.col("data")).alias("stats"), B.byte_runs("data").alias("runs"),
        B.chunk_entropies(F.col("data"), chunk).alias("parts"), B.duplicate_block_ratio(F.col("data"), block).alias("dup"),
    )
    n = F.col("n")
    named = base.withColumn("s_entropy", r6(F.col("stats.entropy")))
    stats = chunk_stats(F.col("parts"), F.col("s_entropy"))
    return named.select(
        *keys,
        "s_entropy",
        r6(stats["mean"]).alias("s_chunk_entropy_mean"),
        r6(stats["std"]).alias("s_chunk_entropy_std"),
        r6(ratio(F.col("stats.printable"), n)).alias("s_printable_ratio"),
        r6(ratio(F.col("stats.zero"), n)).alias("s_zero_ratio"),
        r6(ratio(F.col("runs.zero_run"), n)).alias("s_longest_zero_run_ratio"),
        r6(ratio(F.col("stats.high"), n)).alias("s_high_byte_ratio"),
        r6(F.col("dup")).alias("s_duplicate_block_ratio"),
        r6(F.when(n > 0, B.length_log(n)).otherwise(0.0)).alias("s_length_log1p"),
    )


def unigram_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sparse byte frequencies: (keys, byte, n, frequency)."""
    base = df.select(*keys, F.length("data").alias("_n"), B.byte_histogram("data").alias("hist"))
    return base.select(*keys, "_n", F.posexplode("hist").alias("byte", "n")).where("n > 0").select(
        *keys, "byte", "n", r6(F.col("n") / F.col("_n")).alias("frequency")
    )


def unigram_map(hist: Column, size: Column) -> Column:
    """map<byte, frequency> of the bytes that occur."""
    cells = F.transform(hist, lambda c, i: F.struct(i.cast("int").alias("k"), ratio(c, size).alias("v")))
    return F.map_from_entries(F.filter(cells, lambda s: s["v"] > 0))


def bigram_rows(df: DataFrame, keys: list[str], buckets: int = 1024) -> DataFrame:
    base = df.select(*keys, F.inline(B.bigram_counts(F.col("data"), buckets)))
    return base.select(*keys, "bucket", "n")


def top_bigrams(data: Column, k: int = 4) -> Column:
    """Frequencies of the k most frequent byte pairs, padded with 0."""
    pairs = F.greatest(F.length(data) - 1, F.lit(1))
    return F.transform(B.top_pair_counts(data, k), lambda c: c / pairs)


def head_chi_square(data: Column, limit: int = 4096) -> Column:
    """Histogram of the leading bytes; the feature is defined on the head."""
    return B.byte_histogram(F.substring(data, 1, limit))


WEIGHTED = [
    "entropy", "weighted_entropy", "window_entropy_mean", "window_entropy_std", "window_entropy_range", "size_log2",
    "is_large", "head_chi2", "head_printable", "is_dex", "is_elf", "is_zip", "path_has_classes", "path_is_so", "path_has_assets",
]


def weighted_entropy_features(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Fifteen entropy, size, head and path features per object."""
    d, p = F.col("content"), F.col("object_path")
    base = objects.select(
        *keys, "object_path", "content", F.length(d).alias("n"), B.byte_histogram(d).alias("hist"),
        B.chunk_entropies(d, 256).alias("parts"), B.byte_histogram(F.substring(d, 1, 4096)).alias("h4"),
        B.byte_histogram(F.substring(d, 1, 1024)).alias("h1"),
    ).withColumn("entropy", B.entropy(F.col("hist"), F.col("n")))
    n, e = F.col("n"), F.col("entropy")
    head = F.least(n, F.lit(4096))
    expected = head / 256.0
    gaps = F.aggregate(F.col("h4"), F.lit(0.0), lambda a, c: a + (c - expected) * (c - expected))
    chi = gaps / F.greatest(expected, F.lit(1.0))
    s = chunk_stats(F.col("parts"), e)
    return base.select(
        *keys,
        "entropy",
        (e * log2_at_least(n, 2)).alias("weighted_entropy"),
        s["mean"].alias("window_entropy_mean"),
        s["std"].alias("window_entropy_std"),
        s["range"].alias("window_entropy_range"),
        log2_at_least(n, 1).alias("size_log2"),
        flag(n > 100000).alias("is_large"),
        (chi / 256.0).alias("head_chi2"),
        ratio(B.visible_count(F.col("h1")), F.least(n, F.lit(1024))).alias("head_printable"),
        flag(B.starts_with_bytes(d, C.DEX)).alias("is_dex"),
        flag(B.starts_with_bytes(d, C.ELF)).alias("is_elf"),
        flag(B.starts_with_bytes(d, C.ZIP)).alias("is_zip"),
        flag(F.lower(p).contains("classes")).alias("path_has_classes"),
        flag(p.endswith(".so")).alias("path_is_so"),
        flag(p.contains("assets/")).alias("path_has_assets"),
    )


def container_context(objects: DataFrame) -> DataFrame:
    """Counts by kind, high-entropy count, log2 size and flags per container."""
    p, d = C.clean_path(F.col("object_path")), F.col("content")
    kind = C.first_match(
        [
            (B.starts_with_bytes(d, C.DEX), "dex"),
            (B.starts_with_bytes(d, C.ELF) | p.endswith(".so"), "so"),
            (p.startswith("assets/") | p.startswith("res/"), "asset"),
        ],
        "unknown",
    )
    rows = objects.select(
        "container", kind.alias("kind"), F.length(d).alias("n"), B.byte_stats(d)["entropy"].alias("e")
    )
    agg = rows.groupBy("container").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("dex", "so", "asset", "unknown")],
        F.count_if((F.col("n") >= 256) & (F.col("e") > 7.5)).alias("high_entropy_count"),
        F.log2(F.greatest(F.sum("n"), F.lit(1)).cast("double")).alias("total_size_log2"),
        F.count(F.lit(1)).alias("total_entries"),
    )
    return agg.withColumns({"is_multidex": flag(F.col("dex_count") > 1), "has_native": flag(F.col("so_count") > 0)})


# ---- wide window vector (274 byte, 14 structural, 30 type-specific values) ---------------------

BYTE_NAMES = [f"hist_{i:03d}" for i in range(256)] + ["entropy"] + [f"roll_{x}" for x in ("mean", "std", "max", "min", "slope")] + [
    "visible_ratio", "zero_ratio", "high_ratio", "unique_share", "max_run_share", "chi2_scaled", "size_log2",
] + [f"bigram_top{i}" for i in range(1, 5)] + ["compression_ratio"]
STRUCT_NAMES = ["offset_share", "index_share", "size_share", "entry_order", "entry_size_log2"] + [
    "ctx_dex", "ctx_so", "ctx_asset", "ctx_unknown", "ctx_high_entropy", "ctx_size_log2", "ctx_entries", "ctx_multidex", "ctx_native",
]
TYPE_NAMES = [f"type_{i:02d}" for i in range(30)]
VECTOR_NAMES = BYTE_NAMES + STRUCT_NAMES + TYPE_NAMES


def _dex_values(d: Column, n: Column, h: Column, section: Column) -> dict[int, Column]:
    head = (section == "dex_header") & (n >= 112)
    log = lambda o: F.when(head, log2_at_least(B.uint32_le(d, o), 1)).otherwise(0.0)
    size = F.greatest(n, F.lit(1))
    code, text = section == "dex_code_item", section == "dex_string_data"
    words = list(C.keyword_flags(d, C.LOADER_KEYWORDS).values())
    out = {0: flag(head)}
    out |= {i: log(o) for i, o in zip(range(1, 8), (56, 64, 72, 80, 88, 96, 32))}
    out[8] = flag(head & (B.uint32_le(d, 88) < 10) & (B.uint32_le(d, 96) < 5))
    out[9] = flag(code)
    out[10] = F.when(code, B.count_byte(h, 0x0E) / size * 10.0).otherwise(0.0)
    out[11] = F.when(code, B.count_between(h, 0x12, 0x19) / size * 10.0).otherwise(0.0)
    out[12] = flag(text)
    out[13] = F.when(text, B.visible_count(h) / size).otherwise(0.0)
    return out | {20 + i: w for i, w in enumerate(words)}


def _elf_values(d: Column, e: Column, section: Column) -> dict[int, Column]:
    out = {0: F.lit(1.0)}
    out |= {1 + i: w for i, w in enumerate(C.keyword_flags(d, C.NATIVE_KEYWORDS).values())}
    out |= {7: e, 8: flag(B.contains_bytes(d, C.DEX)), 9: flag(B.contains_bytes(d, C.ZIP))}
    out |= {10 + i: w for i, w in enumerate(C.keyword_flags(d, C.SECTION_KEYWORDS).values())}
    out[14] = flag(section.isin("elf_rodata", "elf_data") & (e > 7.5))
    return out | {15 + i: flag(section == s) for i, s in enumerate(C.SECTION_TYPES[10:18])}


def _asset_values(d: Column, n: Column, h: Column, e: Column, thirds: list[Column], path: Column) -> dict[int, Column]:
    head = F.substring(d, 1, 4096)
    return {
        0: flag(B.contains_bytes(head, C.DEX)), 1: flag(B.contains_bytes(head, C.ELF)), 2: flag(B.contains_bytes(head, C.ZIP)),
        3: flag(B.starts_with_bytes(d, C.GZIP)), 4: B.visible_count(h) / F.greatest(n, F.lit(1)),
        5: flag(B.starts_with_bytes(d, C.PNG)), 6: flag(B.starts_with_bytes(d, C.JPG)),
        7: flag(F.substring(d, 1, 4).isin(*[bytearray(x) for x in (b"RIFF", b"OggS", b"fLaC")])),
        8: flag(e > 7.5), 9: e / 8.0, 10: thirds[0], 11: thirds[1], 12: thirds[2],
        13: F.length(C.clean_path(path)) - F.length(F.translate(C.clean_path(path), "/", "")), 14: C.path_keyword_flag(path),
    }


def third_parts(d: Column, n: Column) -> list[Column]:
    third = F.greatest(F.floor(n / 3).cast("int"), F.lit(1))
    return [
        F.substring(d, F.lit(1), third),
        F.substring(d, third + 1, third),
        F.substring(d, third * 2 + 1, F.greatest(n - third * 2, F.lit(0))),
    ]


def window_vectors(windows: DataFrame, contexts: DataFrame, keys: list[str]) -> DataFrame:
    """array<double> of 318 values per window in ``VECTOR_NAMES`` order.

    windows: keys, container, object_path, entry_type, section_type, data, offset_start, offset_end,
    window_index, n_windows, entry_index, entry_size, compression_ratio.
    """
    d = F.col("data")
    thirds = third_parts(d, F.length(d))
    base = windows.withColumns(
        {
            "n": F.length(d), "stats": B.byte_stats(d, counts=True), "runs": B.byte_runs(d), "parts": B.chunk_entropies(d, 1024, 512),
            "bigrams": top_bigrams(d), **{f"e{i}": B.byte_stats(x)["entropy"] for i, x in enumerate(thirds)},
        }
    )
    base = base.join(stored(contexts), "container")
    n, h, e, c, f = F.col("n"), F.col("stats.hist"), F.col("stats.entropy"), F.col, F.col("stats")
    size, entry = F.greatest(n, F.lit(1)), F.greatest(c("entry_size"), F.lit(1))
    few = F.size("parts") < 2
    one = F.coalesce(F.try_element_at(c("parts"), F.lit(1)), e)
    s = chunk_stats(c("parts"), e)
    roll = [F.when(few, one).otherwise(s["mean"]), F.when(few, 0.0).otherwise(s["std"]), F.when(few, one).otherwise(s["max"]),
            F.when(few, one).otherwise(s["min"]), F.when(few, 0.0).otherwise(s["slope"])]
    stats = [
        f["visible"] / size, f["zero"] / size, f["high"] / size, f["unique"] / 256.0,
        c("runs.run_len") / size, F.least(B.chi_square_of(f, n) / 256.0 / 1000.0, F.lit(1.0)), log2_at_least(n, 1),
    ]
    struct = [
        c("offset_start") / entry, c("window_index") / F.greatest(c("n_windows"), F.lit(1)),
        (c("offset_end") - c("offset_start")) / entry, c("entry_index") / F.greatest(c("total_entries"), F.lit(1)),
        log2_at_least(c("entry_size"), 1), c("dex_count"), c("so_count"), c("asset_count"), c("unknown_count"),
        c("high_entropy_count"), c("total_size_log2"), c("total_entries"), c("is_multidex"), c("has_native"),
    ]
    section, kind = c("section_type"), c("entry_type")
    third_e = [c(f"e{i}") for i in range(3)]
    groups = {
        "dex": _dex_values(d, n, h, section), "elf": _elf_values(d, e, section),
        "asset": _asset_values(d, n, h, e, third_e, c("object_path")),
    }
    zero = F.lit(0.0)
    dense = {
        k: F.array(*[v.get(i, zero).cast("double") for i in range(30)]) for k, v in groups.items()
    }
    typed = F.when(kind == "dex", dense["dex"]).when(kind == "elf", dense["elf"]).otherwise(dense["asset"])
    vector = F.concat(
        F.transform(h, lambda x: x / size),
        F.array(e, *[x.cast("double") for x in roll], *[x.cast("double") for x in stats]),
        c("bigrams"),
        F.array(c("compression_ratio").cast("double"), *[x.cast("double") for x in struct]),
        typed,
    )
    return base.select(*keys, vector.alias("features"))


def vector_rows(df: DataFrame, keys: list[str], names: list[str], features: str = "features") -> DataFrame:
    """Non-zero values of a named vector as (keys, feature, value)."""
    table = F.array(*[F.lit(x) for x in names])
    rows = df.select(*keys, F.posexplode(features).alias("_i", "_v")).where("_v <> 0")
    return rows.select(*keys, F.element_at(table, F.col("_i") + 1).alias("feature"), r6(F.col("_v")).alias("value"))


OBJECT_NAMES = (
    [f"hist_{i:03d}" for i in range(256)] + ["entropy"] + [f"roll_{x}" for x in ("mean", "std", "max", "min")]
    + ["visible_ratio", "zero_ratio", "compression_ratio", "size_log2"] + [f"magic_{m}" for m in C.MAGIC_TYPES]
    + [f"path_{m}" for m in C.PATH_TYPES] + ["is_dex", "is_elf"] + [f"dex_{i}" for i in range(7)] + [f"elf_{i}" for i in range(7)]
    + [f"asset_{i}" for i in range(4)] + ["pad_0", "pad_1"] + ["ctx_dex", "ctx_so", "ctx_asset", "ctx_entries"]
)


def object_vectors(objects: DataFrame, contexts: DataFrame, keys: list[str]) -> DataFrame:
    """array<double> of 313 values per object in ``OBJECT_NAMES`` order.

    objects: keys, container, object_path, content, compression_ratio.
    """
    d, p, c = F.col("content"), F.col("object_path"), F.col
    text = F.substring(d, 65, 4096)
    base = objects.withColumns(
        {
            "n": F.length(d), "stats": B.byte_stats(d, counts=True), "parts": B.chunk_entropies(d, 1024, 512),
            "magic": C.magic_type(d), "te": B.byte_stats(text)["entropy"],
        }
    )
    base = base.join(stored(contexts), "container")
    n, h, e, m = c("n"), c("stats.hist"), c("stats.entropy"), c("magic")
    size = F.greatest(n, F.lit(1))
    s = chunk_stats(c("parts"), e)
    dex, elf = (m == "dex") & (n > 112), (m == "elf") & (n > 64)
    asset = ~(dex | elf)
    zero = F.lit(0.0)
    when = lambda cond, v: F.when(cond, v.cast("double")).otherwise(0.0)
    marks = F.size(F.regexp_extract_all(B.latin1(d), F.lit(r"(\.packed|\.jiagu)"), F.lit(1)))
    head = F.substring(d, 1, 4096)
    visible = c("stats.visible") / size
    values = (
        [e] + [s[x] for x in ("mean", "std", "max", "min")]
        + [visible, c("stats.zero") / size, c("compression_ratio"), log2_at_least(n, 1)]
    )
    tail = (
        [flag(m == "dex"), flag(m == "elf")]
        + [when(dex, log2_at_least(B.uint32_le(d, o), 1)) for o in (56, 64, 88, 96)] + [flag(dex), zero, zero]
        + [flag(elf)] + [when(elf, flag(B.contains_bytes(d, w))) for w in (b"JNI_OnLoad", b"dlopen", b"mmap", b"mprotect")]
        + [when(elf, c("te")), when(elf, F.least(marks, F.lit(5)))]
        + [when(asset, flag(B.contains_bytes(head, w))) for w in (C.DEX, C.ELF, C.ZIP)] + [when(asset, visible)]
        + [zero, zero, c("dex_count"), c("so_count"), c("asset_count"), c("total_entries")]
    )
    vector = F.concat(
        F.transform(h, lambda x: x / size),
        F.array(*[v.cast("double") for v in values]),
        C.one_hot(m, C.MAGIC_TYPES),
        C.one_hot(C.path_type(p), C.PATH_TYPES),
        F.array(*[v.cast("double") for v in tail]),
    )
    return base.select(*keys, vector.alias("features"))
