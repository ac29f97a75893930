"""Archive members as rows.

Spark lists and distributes the archives; the only per-row Python is the unzip
helper, everything after it is DataFrame work.
"""

from __future__ import annotations

import io
import sys
import zipfile
import zlib

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classify import object_type

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMBER = T.StructType(
    [
        T.StructField("member_index", T.IntegerType()),
        T.StructField("object_path", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("parent", T.StringType()),
        T.StructField("compression", T.StringType()),
        T.StructField("compressed_size", T.LongType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)
ARCHIVES = (".apk", ".jar", ".zip")


def unzip(data: bytes, name: str, max_depth: int, max_member_bytes: int | None):
    """Yield member tuples; one counter runs across nesting, a bad nested archive is skipped.

    A member that cannot be read yields a row with its path and the error."""
    index = 0
    stack = [(data, "", 0, name, None)]
    while stack:
        blob, prefix, depth, parent, todo = stack.pop()
        if todo is None:
            try:
                archive = zipfile.ZipFile(io.BytesIO(blob))
            except zipfile.BadZipFile as bad:
                if depth == 0:
                    yield (-1, "", 0, parent, None, 0, None, str(bad))
                continue
            todo = (archive, iter([i for i in archive.infolist() if not i.is_dir()]))
        archive, infos = todo
        for info in infos:
            if max_member_bytes is not None and info.file_size > max_member_bytes:
                continue
            path = info.filename.replace("\\", "/")
            full = f"{prefix}!{path}" if prefix else path
            try:
                body = archive.read(info)
            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as bad:  # corrupt, encrypted, unknown method
                yield (-1, full, depth, parent, None, info.compress_size, None, f"{type(bad).__name__}: {bad}")
                continue
            kind = "stored" if info.compress_type == zipfile.ZIP_STORED else "deflated" if info.compress_type == zipfile.ZIP_DEFLATED else "other"
            yield (index, full, depth, parent, kind, info.compress_size, body, None)
            index += 1
            nested = body[:4] in (b"PK\x03\x04", b"PK\x05\x06") or full.lower().endswith(ARCHIVES)
            if nested and depth < max_depth:
                stack.append((None, prefix, depth, parent, (archive, infos)))
                stack.append((body, full, depth + 1, full, None))
                break


def read_archives(spark: SparkSession, path: str, pattern: str = "*.{apk,zip,jar}") -> DataFrame:
    """container_path, archive bytes and the sha256 that identifies the container."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("container_path"), F.sha2("content", 256).alias("container"), F.col("content").alias("archive"))


def explode_members(archives: DataFrame, max_depth: int = 1, max_member_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, errors) of ``container, container_path, archive`` rows."""
    schema = T.StructType([T.StructField("container", T.StringType()), T.StructField("container_path", T.StringType()), *MEMBER.fields])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for container, path, archive in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = []
                for m in unzip(archive, path.rsplit("/", 1)[-1], max_depth, max_member_bytes):
                    rows.append((container, path, *m))
                    if len(rows) >= 64:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    names, arrow = schema.names, to_arrow_schema(schema)
    rows = archives.select("container", "container_path", "archive").mapInArrow(run, schema)
    members = rows.where("error IS NULL").select(
        "container", "container_path",
        F.format_string("%s:%06d", F.substring("container", 1, 12), "member_index").alias("object_id"),
        "object_path", object_type(F.col("object_path"), F.col("content")).alias("object_type"), F.length("content").alias("size"),
        F.sha2("content", 256).alias("sha256"), "depth", "parent", "compression", "compressed_size", "content",
    )
    return members, rows.where("error IS NOT NULL").select("container", "container_path", "object_path", "error")


def probe_members(archives: DataFrame) -> DataFrame:
    """has_native / has_nested_code per container from member names alone; NULL when unreadable."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):  # one archive at a time in memory
                row = batch.slice(at, 1)
                try:
                    names = [n.replace("\\", "/").lower() for n in zipfile.ZipFile(io.BytesIO(row.column("archive")[0].as_py())).namelist()]
                    native = any(n.startswith("lib/") and n.endswith(".so") for n in names)
                    nested = any(n.startswith("assets/") and n.endswith(".dex") for n in names)
                except (zipfile.BadZipFile, TypeError):
                    native = nested = None
                yield pa.RecordBatch.from_arrays([row.column("container"), pa.array([native], pa.bool_()), pa.array([nested], pa.bool_())], names=["container", "has_native", "has_nested_code"])

    return archives.select("container", "archive").mapInArrow(run, "container string, has_native boolean, has_nested_code boolean")


def register_unzip(spark: SparkSession, name: str = "unzip_members") -> None:
    """SQL table function: ``SELECT * FROM t, LATERAL unzip_members(t.archive, 1)``."""

    class Unzip:
        def eval(self, data: bytes, max_depth: int):
            yield from unzip(bytes(data), "", max_depth, None)

    spark.udtf.register(name, F.udtf(Unzip, returnType=MEMBER))
