"""JSON Lines readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, strict: bool = True) -> DataFrame:
    """One object per line.  Strict reading fails on a malformed line; lenient reading
    keeps it in ``_corrupt_record`` with its file name."""
    paths = [path] if isinstance(path, str) else list(path)
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(paths)
    return rows.withColumn("_file", F.input_file_name())


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Bad lines are skipped; a missing path is an empty table."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Columns in sorted order; returns the number of rows written, counted in the files."""
    spark = df.sparkSession
    before = spark.read.text(path).count() if mode == "append" and _exists(spark, path) else 0
    df.select(*sorted(df.columns)).write.mode(mode).json(path)
    return spark.read.text(path).count() - before


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_version(df: DataFrame, root: str, version: str) -> str:
    """Write an enriched table as a new version; the source it was read from is never overwritten.

    A version that is being written again (a repeated batch) replaces its own earlier attempt.
    """
    target = f"{root.rstrip('/')}/version={version}"
    df.write.mode("overwrite").json(target)
    return target
