"""Incremental ingestion, stateless scoring and enrichment upserts as streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.matching import carry_forward
from ..operators.rollup import window_score
from ..operators.windows import scored_windows


def new_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    """Stream of files that appear below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def append_summary(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append each new input exactly once; a restart continues from the checkpoint."""
    return (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def score_stream(objects: DataFrame, width: int = 4096, stride: int = 2048, min_size: int = 1, entropy_weight: float = 1.0, nonprintable_weight: float = 0.0) -> DataFrame:
    """Windows and scores of a stream of complete objects; no state crosses batches."""
    w = scored_windows(objects, width, stride, min_size)
    return w.withColumn("score", window_score(F.col("entropy"), F.col("printable_ratio"), entropy_weight, nonprintable_weight))


VERSION = "upsert-version-"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions below ``root``, oldest first, as storage has them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName()[len(VERSION) :]) for p in names if p.getName().startswith(VERSION) and fs.exists(hadoop.Path(p, "_SUCCESS")))


def current_table(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame | None:
    """The newest finished version; None before the first one."""
    found = versions(spark, root)
    return spark.read.schema(schema).parquet(f"{root}/{VERSION}{found[-1]:012d}") if found else None


def upsert_labels(stream: DataFrame, root: str, keys: Sequence[str], labels: Sequence[str], order: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Merges each batch into the table below ``root``: fresh rows win, known labels fill nulls.

    Of several rows of a key in one batch the last by ``order`` counts (then by all other
    columns), so keys stay unique.  A batch starts from the newest version before its own and
    overwrites its own one, so a repeated batch gives the same table; which version is current
    is read from storage, so a new process goes on where the last one ended.
    """
    schema = stream.schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        last = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_last")
        fresh = batch.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*batch.columns)
        before = [v for v in versions(spark, root) if v < batch_id]
        if before:
            prior = spark.read.schema(schema).parquet(f"{root}/{VERSION}{before[-1]:012d}")
            merged = carry_forward(fresh, prior, keys, labels)
            fresh = merged.unionByName(prior.join(fresh.select(*keys), list(keys), "left_anti").select(*merged.columns))
        fresh.write.mode("overwrite").parquet(f"{root}/{VERSION}{batch_id:012d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
