"""Rule tables over members, and scorers built on rules or detector hits.

Rules are configuration (tens of rows given by the caller), so they become
literal CASE branches: each pattern is compiled once and no join is needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import base_name, clean_path
from ..functions.numeric import as_int, r6
from .labels import POSITIVE

FILE_SIZE = "__file_size__"

# Extension, prefix and rule lists of the additive scorer.
BENIGN_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".svg", ".mp3", ".mp4", ".m4a", ".ogg", ".wav", ".ttf", ".otf", ".xml",
    ".json", ".txt", ".html", ".css", ".js", ".properties", ".yml", ".yaml", ".pem", ".cer", ".crt", ".so",
]
SUSPICIOUS_PREFIXES = ["assets/", "res/raw/", "raw/", "res/xml/", "lib-unpacked/"]
CODE_PREFIXES = ["classes", "lib/"]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pattern: str
    label: str = POSITIVE
    payload_kind: str = "encrypted_dex"
    transform_family: str = "packer_x"
    offset_start: int | str = 0
    offset_end: int | str = FILE_SIZE


def match_all_rules(members: DataFrame, rules: Sequence[Rule], path: str = "object_path", size: str = "size") -> DataFrame:
    """One row per (member, matching rule).  A negative end counts from the end of the file."""
    n = F.col(size).cast("bigint")
    items = []
    for i, r in enumerate(rules):
        start = F.lit(0 if r.offset_start == FILE_SIZE else r.offset_start).cast("bigint")
        end = n if r.offset_end == FILE_SIZE else (F.lit(r.offset_end).cast("bigint") if r.offset_end >= 0 else n + F.lit(r.offset_end))
        row = F.struct(
            F.lit(i).alias("rule_order"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.label).alias("label"),
            F.lit(r.payload_kind).alias("payload_kind"), F.lit(r.transform_family).alias("transform_family"),
            start.alias("offset_start"), end.alias("offset_end"),
        )
        items.append(F.when(F.col(path).rlike(r.pattern), row))
    hits = F.filter(F.array(*items), lambda x: x.isNotNull())
    return members.select("*", F.inline(hits))


def first_rule(path: Column, rules: Sequence[tuple[str, str]], default: str = "unknown") -> Column:
    """Class of the first matching pattern."""
    out = None
    for pattern, value in rules:
        out = F.when(path.rlike(pattern), value) if out is None else out.when(path.rlike(pattern), value)
    return F.lit(default) if out is None else out.otherwise(default)


def rule_policy(rules: Sequence[tuple[str, str]], path: str = "new_name"):
    """New-member policy for ``diff_labels`` from ordered (pattern, class) rules."""
    return lambda members: first_rule(F.col(path), rules)


def family_of_hit(hit: Column, families: Mapping[str, str]) -> Column:
    """Case-insensitive exact name first, else the first listed name contained in the hit."""
    table = {k.strip().lower(): v for k, v in families.items()}
    key = F.lower(F.trim(hit))
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    part = F.lit(None).cast("string")
    for k, v in reversed(list(table.items())):
        if k:
            part = F.when(key.contains(k), v).otherwise(part)
    return F.when(key != "", F.coalesce(exact, part))


def _starts_with_any(path: Column, prefixes: Sequence[str]) -> Column:
    out = path.startswith(prefixes[0])
    for p in prefixes[1:]:
        out = out | path.startswith(p)
    return out


def additive_rule_scores(
    windows: DataFrame, threshold: float = 1.0, weights: Mapping[str, float] | None = None, min_large: int = 4096,
    low_printable: float = 0.1,
) -> DataFrame:
    """Four weighted object rules; fired rules listed in order.

    windows: container, object_id, object_path, offsets, printable_ratio, label_id.
    """
    w = {"suspicious_path": 0.6, "unknown_extension": 0.6, "large_object": 0.4, "low_printable_region": 0.4, **(weights or {})}
    objects = windows.groupBy("container", "object_id", "object_path").agg(
        (F.max("offset_end") - F.min("offset_start")).alias("object_size"),
        F.min("printable_ratio").alias("_low"),
        F.min("offset_start").alias("_s"),
        F.max("offset_end").alias("_e"),
        F.count(F.lit(1)).alias("window_count"),
        F.sum("label_id").alias("positive_window_count"),
    )
    p = clean_path(F.col("object_path"))
    code = _starts_with_any(p, CODE_PREFIXES)
    # A leading dot alone is no extension.
    ext = F.regexp_extract(base_name(p), r"[^.].*(\.[^.]*)$", 1)
    fired = {
        "suspicious_path": ~code & _starts_with_any(p, SUSPICIOUS_PREFIXES),
        "unknown_extension": ~code & ~ext.isin(*BENIGN_EXTENSIONS),
        "large_object": ~code & (F.col("object_size") >= min_large),
        "low_printable_region": ~code & (F.col("_low") <= low_printable),
    }
    score = sum((F.when(c, F.lit(w[n])).otherwise(0.0) for n, c in fired.items()), F.lit(0.0))
    listed = F.filter(F.array(*[F.when(c, n) for n, c in fired.items()]), lambda x: x.isNotNull())
    out = objects.withColumns({"score": r6(score), "triggered_rules": listed})
    hit = F.col("score") >= threshold
    return out.select(
        "container", "object_id", "object_path", "object_size", "score", as_int(hit).alias("predicted_label_id"),
        as_int(F.col("positive_window_count") > 0).alias("true_label_id"), "window_count", "positive_window_count",
        F.when(hit, F.col("window_count")).otherwise(0).alias("predicted_window_count"),
        F.when(hit, F.col("_s")).alias("predicted_offset_start"), F.when(hit, F.col("_e")).alias("predicted_offset_end"),
        "triggered_rules",
    )


def broadcast_object_decision(windows: DataFrame, objects: DataFrame) -> DataFrame:
    """Give every window the score and decision of its object."""
    keys = ["container", "object_id"]
    return windows.join(objects.select(*keys, "score", "predicted_label_id", "triggered_rules"), keys)


def rule_trigger_counts(objects: DataFrame) -> DataFrame:
    return objects.select(F.explode("triggered_rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("objects"))


DETECTOR_SCHEMA = "files array<struct<filename:string,matches:map<string,array<string>>>>"


def parse_detector_json(df: DataFrame, column: str) -> DataFrame:
    """Detector output: ``files`` plus ``scan_ok`` (false for missing or malformed JSON)."""
    parsed = df.withColumn("_j", F.from_json(F.col(column), DETECTOR_SCHEMA))
    return parsed.withColumns({"scan_ok": F.col("_j").isNotNull() & F.col("_j.files").isNotNull(), "files": F.col("_j.files")}).drop("_j")


def detector_hits(scans: DataFrame, keys: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """(keys, filename, category, hit) of the listed categories."""
    files = scans.select(*keys, F.explode("files").alias("f")).select(*keys, "f.filename", F.explode("f.matches").alias("category", "hits"))
    return files.where(F.col("category").isin(*categories)).select(*keys, "filename", "category", F.explode("hits").alias("hit"))


def detector_scores(scans: DataFrame, key: str, categories: Sequence[str] = ("packer", "protector"), min_hits: int = 1) -> DataFrame:
    """Number of distinct hits, decision and families per container; failed scans score 0."""
    if min_hits < 1:
        raise ValueError("min_hits must be >= 1")
    hits = detector_hits(scans.where("scan_ok"), [key], categories).distinct()
    per = hits.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_set("hit")).alias("_f"))
    none = F.array().cast("array<string>")
    joined = scans.select(key, "scan_ok", "true_label_id").join(per, key, "left")
    score = F.coalesce("_n", F.lit(0))
    return joined.select(
        key, score.alias("score"), as_int(F.col("scan_ok") & (score >= min_hits)).alias("predicted_label_id"), "true_label_id",
        F.coalesce("_f", none).alias("detected_families"), "scan_ok",
    )


def family_histogram(scores: DataFrame) -> DataFrame:
    return scores.select(F.explode("detected_families").alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("containers"))
