"""Byte-level BPE over chunks of long texts that are stitched where their pre-tokens agree."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 32_768  # characters of a chunk
OVERLAP = 1_024  # characters that a chunk shares with the next one
ROWS = 512  # texts in a batch of results


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


def _id_bytes(encoding, text: str) -> bytes:
    return np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), dtype="<u4").tobytes()


def _encode(df: DataFrame, keys: str, path: str, pattern: str) -> DataFrame:
    """Replaces ``text`` by ``ids``; ``keys`` is the schema of the columns that stay."""
    names = [k.split()[0] for k in keys.split(",")]

    def run(batches):
        encoding = _encoding(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [_id_bytes(encoding, t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(ids, pa.binary())], names=[*names, "ids"])

    return df.select(*names, "text").mapInArrow(run, f"{keys}, ids binary")


def _cut(df: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``doc_id, row, c, part``: chunk ``c`` of a text with the first characters of the next one."""

    def run(batches):
        for batch in batches:
            for doc, row, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "row", "text")), strict=True):
                starts = range(0, len(text), chunk)
                for at in range(0, len(starts), 64):
                    some = starts[at : at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * len(some), pa.int64()), pa.array([row] * len(some), pa.int64()), pa.array([s // chunk for s in some], pa.int64()),
                         pa.array([text[s : s + chunk + overlap] for s in some], pa.string())], names=["doc_id", "row", "c", "part"],
                    )

    return df.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, c long, part string")


def _pretokenise(df: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Adds the ends of pre-tokens in the part shared with the chunk before (``head``) and after (``tail``).

    An end counts only where the pre-token does not end in white space, for that one's end
    depends on what follows; of the tail, the last two pre-tokens don't count, for the chunk's
    end may have cut them short.
    """

    def run(batches):
        import regex

        find = regex.compile(pattern).finditer
        for batch in batches:
            head, tail = [], []
            for part in batch.column("part").to_pylist():
                ends = [m.end() for m in find(part)]
                good = [e for e in ends if not part[e - 1].isspace()]
                last = ends[-3] if len(ends) > 2 else -1
                head.append([e for e in good if e < overlap])
                tail.append([e - chunk for e in good if chunk <= e <= last])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], names=[*batch.schema.names, "head", "tail"]
            )

    return df.mapInArrow(run, "doc_id long, row long, c long, part string, head array<long>, tail array<long>")


def _stitched(parts: DataFrame, chunk: int) -> DataFrame:
    """``doc_id, row, run, text``: the pieces between agreed cuts, in order of ``run``.

    Chunk 0 starts at a true boundary.  A boundary that it and the next chunk share is a true
    one, and from there on the next chunk's boundaries are true as well, and so on.  Where two
    chunks share none, the rest of the text is one piece.
    """
    order = Window.partitionBy("row").orderBy("c")
    cut = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    last = F.lead("c").over(order).isNull()
    cuts = parts.withColumns({"cut": cut, "last": last}).withColumn(
        "broken", F.coalesce(F.max(F.when(F.col("cut").isNull() & ~F.col("last"), 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    )
    cuts = cuts.withColumn("cut", F.when(F.col("broken") == 0, F.col("cut"))).withColumn("before", F.lag("cut").over(order))
    start = F.coalesce("before", F.lit(0))
    end = F.when(F.col("last"), F.length("part")).otherwise(F.lit(chunk) + F.coalesce("cut", F.lit(0)))
    own = F.substring("part", start + 1, end - start)
    run = F.when(F.col("before").isNotNull() | (F.col("c") == 0), F.col("c"))
    runs = cuts.select("doc_id", "row", "c", own.alias("own"), F.max(run).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    pieces = runs.groupBy("row", "run").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("c", "own"))).alias("owns"))
    return pieces.select("doc_id", "row", "run", F.array_join("owns.own", "").alias("text"))


def _joined(pieces: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                ids = pa.array([b"".join(one.column("ids")[0].as_py())], pa.binary())
                yield pa.RecordBatch.from_arrays([one.column("doc_id"), ids], names=["doc_id", "ids"])

    return pieces.mapInArrow(run, "doc_id long, ids binary")


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, ids``: the ids of each whole text as little-endian unsigned 32-bit integers.

    Texts of one chunk are encoded where they are read.  Longer ones are cut into overlapping
    chunks, which are dealt over the tasks, pre-tokenised, stitched and encoded piece by piece.
    A null text counts as empty and has no ids; a null doc_id stays null; rows that repeat are
    documents of their own; other columns are ignored; no documents give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = _encode(docs.where(F.length("text") <= chunk), "doc_id long", ranks_path, pattern)
    long = docs.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    parts = _pretokenise(_cut(long, chunk, overlap).repartition("row", "c"), pattern, chunk, overlap)
    pieces = _encode(_stitched(parts, chunk), "doc_id long, row long, run long", ranks_path, pattern)
    whole = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("run", "ids"))).alias("runs"))
    return short.unionByName(_joined(whole.select("doc_id", F.col("runs.ids").alias("ids"))))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of a row's ids, one after the other."""

    def run(batches):
        ranks = _ranks(ranks_path)
        table = np.empty(max(ranks.values()) + 1, dtype=object)
        table[list(ranks.values())] = list(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [b"".join(table[np.frombuffer(x.as_buffer(), "<u4")].tolist()) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, "doc_id long, ids binary, decoded binary")
