"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folder of the public vocabularies; every machine of a cluster needs it at this path.
TOKENIZERS = os.environ.get("SPANSTRATA_TOKENIZERS", "/opt/tokenizers")


def work_folder(spark: SparkSession) -> str:
    """The folder of reliable checkpoints, which all executors share.

    The session names it in ``spark.checkpoint.dir``.  Only a local session that names none
    (as in tests) gets a temporary one; on a cluster the setting is required, for a folder of
    one machine would be lost to the others.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spanstrata-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Evaluates once and cuts the lineage with a reliable checkpoint."""
    work_folder(df.sparkSession)
    return df.checkpoint()


def releasing(run):
    """A task function that gives its memory back when it ends: Arrow's pool and what the allocator holds free.

    Python workers live on after a task, so what they keep is lost to the tasks of later stages.
    """

    def wrapped(batches):
        import ctypes
        import gc

        import pyarrow

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return wrapped


def give_back(spark: SparkSession) -> None:
    """Has the executors' JVMs collect, after which they return free heap to the machine.

    For jobs of many stages on executors whose Python workers need memory beside the heap: a heap
    that one stage filled with garbage otherwise stays as large.  A task for each core, without data.
    """
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


ROWS = 20_000  # rows of a small table that are worth a task


def merged(df: DataFrame, rows: int) -> DataFrame:
    """Fewer partitions for a table known to have ``rows`` rows, at least ROWS in each; never more than it has."""
    return df.coalesce(max(1, -(-rows // ROWS)))


def settle_small(df: DataFrame) -> DataFrame:
    """Like ``settle``, for tables that may be much smaller than their number of partitions."""
    df = settle(df)
    return merged(df, df.count())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone; ``lower`` would change other letters too."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
