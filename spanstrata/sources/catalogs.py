"""Catalogue scans, listings and corpus sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import strip_build_suffixes

# Packer directory names by file-name code.
PACKER_CODES = {"al": "Ali", "bd": "Baidu", "bb": "Bangcle", "ij": "Ijiami", "qh": "Qihoo", "tx": "Tencent"}
LISTING_ROW = r"features/(\d+)/([^/]+)/(.+)_(al|bd|bb|ij|qh|tx)_signed\.json\s*$"


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_catalog(spark: SparkSession, path: str, required: Sequence[str], targets: DataFrame | None = None, key: str = "pkg_name") -> DataFrame:
    """CSV (also compressed) catalogue with required columns, optionally only rows of target keys."""
    rows = require_columns(spark.read.option("header", True).csv(path), required)
    return rows.join(targets.select(key), key, "left_semi") if targets is not None else rows


def id_path_index(rows: DataFrame, ids: Sequence[str], paths: Sequence[str], ordinal: str) -> DataFrame:
    """Last path per id; alternative column names are coalesced."""
    slim = rows.select(F.coalesce(*ids).alias("id"), F.coalesce(*paths).alias("path"), ordinal)
    return slim.where("id IS NOT NULL AND path IS NOT NULL").groupBy("id").agg(F.max_by("path", ordinal).alias("path"))


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, source, family and length of files below ``root/<source>/<family>/``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -3).alias("source"), F.element_at(parts, -2).alias("family"), "length")


def parse_listing(lines: DataFrame, line: Column) -> DataFrame:
    """api, packer, app of listing rows; rows with unknown packers drop, disagreeing codes are flagged."""
    table = F.create_map(*[F.lit(x) for kv in PACKER_CODES.items() for x in kv])
    part = lambda i: F.regexp_extract(F.trim(line), LISTING_ROW, i)
    rows = lines.select("*", part(1).alias("api"), part(2).alias("packer"), part(3).alias("app_raw"), F.try_element_at(table, part(4)).alias("packer_code"))
    known = rows.where((F.col("api") != "") & F.col("packer").isin(*PACKER_CODES.values()))
    return known.withColumns({"app": strip_build_suffixes(F.col("app_raw")), "inconsistent": F.col("packer") != F.col("packer_code")})


def write_corpus(df: DataFrame, path: str, stream: str = "stream", chunk: int = 10_000) -> DataFrame:
    """Write parquet files of at most ``chunk`` rows and return rows per stream."""
    df.write.option("maxRecordsPerFile", chunk).mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(stream).agg(F.count(F.lit(1)).alias("rows"))
