"""Keys, safe casts and buckets derived from identifiers and catalogue fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier prefixes, transform names, build suffixes, multiplier.
PAIR_PREFIXES = ["benign_", "test_benign_", "az_benign_", "track_b_v2_benign_", "track_b_v2_dpt_"]
TRANSFORMS = [
    "split_xor", "path_randomized", "signature_strip", "embedded_asset", "so_embedded", "dex_method_inlined",
    "multi_dex_shim", "embedded_archive", "dex_string_encrypted", "base64", "xor",
]
BUILD_SUFFIXES = "_release|_debug_unaligned|_debug|_aligned|_unaligned"
SEED_MULTIPLIER = 2654435761


def strip_build_suffixes(name: Column) -> Column:
    """Drop all trailing build suffixes; a name made only of them stays as it is."""
    cut = F.regexp_replace(name, f"(?i)({BUILD_SUFFIXES})+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), name)


def pair_key(item_id: Column) -> Column:
    """Origin key: known prefix removed, else the part after ``_flat_``, else after the first ``_``."""
    out = None
    for p in PAIR_PREFIXES:
        rest = F.substring(item_id, len(p) + 1, 1 << 30)
        out = F.when(item_id.startswith(p), rest) if out is None else out.when(item_id.startswith(p), rest)
    return (
        out.when(item_id.contains("_flat_"), F.regexp_replace(item_id, r"^.*?_flat_", ""))
        .when(item_id.contains("_"), F.regexp_replace(item_id, r"^[^_]*_", ""))
        .otherwise(item_id)
    )


def package_key(item_id: Column) -> Column:
    """Leading ``_`` parts before the first all-digit or long hex part, joined with dots."""
    parts = F.split(item_id, "_")
    stop = F.array_position(F.transform(parts, lambda p: p.rlike("^([0-9]+|[0-9a-f]{6,})$")), True)
    head = F.when(stop == 0, parts).otherwise(F.slice(parts, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")))
    return F.coalesce(F.nullif(F.array_join(head, "."), F.lit("")), item_id)


def transform_family(item_id: Column, names: Sequence[str] = tuple(TRANSFORMS)) -> Column:
    """Longest known suffix, else the last ``_`` part."""
    out = None
    for n in sorted(names, key=len, reverse=True):
        cond = item_id.endswith("_" + n)
        out = F.when(cond, n) if out is None else out.when(cond, n)
    return out.otherwise(F.substring_index(item_id, "_", -1))


def seed_key(item_id: Column) -> Column:
    """Third ``__`` part, or the whole id."""
    parts = F.split(item_id, "__")
    return F.when(F.size(parts) >= 3, parts[2]).otherwise(item_id)


def safe_int(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def safe_date(text: Column) -> Column:
    """Timestamp of 'yyyy-MM-dd HH:mm:ss[.fraction]'; years up to 1990 mean unknown."""
    ts = F.try_to_timestamp(F.substring_index(text, ".", 1), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(F.year(ts) > 1990, ts)


def count_bucket(value: Column) -> Column:
    return (
        F.when(value == 0, "0").when(value <= 2, "1-2").when(value <= 5, "3-5").when(value <= 10, "6-10").otherwise("11+")
    )


def candidate_filter(hits: Column, date: Column, size: Column, markets: Column, min_date: str, min_size: int, max_size: int, market: str = "") -> Column:
    """No detections, recent, size within bounds, listed in ``market`` if one is required."""
    cond = (hits == 0) & (date >= min_date) & size.between(min_size, max_size)
    return cond & F.lower(markets).contains(market.lower()) if market else cond


def task_seed(base: int, package: Column, version: Column, family: Column) -> Column:
    """(base * multiplier + first 32 bits of sha256('package|version|family')) modulo 2^32."""
    tag = F.sha2(F.concat_ws("|", package, version, family), 256)
    word = F.conv(F.substring(tag, 1, 8), 16, 10).cast("bigint")
    return F.pmod(word + F.lit((base * SEED_MULTIPLIER) % 2**32).cast("bigint"), F.lit(2**32).cast("bigint"))


def row_key(*parts: Column) -> Column:
    """Parts joined with '|', NULL as empty."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def canonical_hash(**fields: Column) -> Column:
    """sha256 of the JSON object with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def sample_digest(seed: int, *parts: Column) -> Column:
    """md5('seed|part|part'): the documented, engine-independent sampling order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))
