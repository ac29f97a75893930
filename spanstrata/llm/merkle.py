"""Merkle manifest of a dataset: a tree of SHA-256 midstates over rows, by source."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .midstates import FANOUT, Path, Subtree, from_bytes, to_bytes

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 7  # levels of one block of the tree
BLOCK = FANOUT**LEVELS
ROWS = 64  # blocks that are worth a task


def leaf_hash(values: list[Column]) -> Column:
    """SHA-256 (binary) of values one after the other, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    texts = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, each row's place within its key, gapless from 0.

    Rows are sorted by ranges of (key, order), so a key of any size spreads over the tasks.  What
    reaches the driver is one row for each partition: its first and last key, the rows of the
    last one and of all.
    """
    ranged = settle(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order))

    offset, before, carried = {}, None, 0
    runs = ranged.groupBy(F.spark_partition_id().alias("part"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("run"))
    ends = runs.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max_by("run", "key").alias("run"), F.sum("run").alias("total"))
    for p in sorted(ends.collect(), key=lambda p: p.part):
        offset[p.part] = carried if p.first == before else 0
        carried = p.run + (offset[p.part] if p.run == p.total else 0)
        before = p.last

    def number(batches):
        last, done = None, offset.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            keys = batch.column(key).to_pylist()
            place = np.empty(len(keys), np.int64)
            starts = _starts(keys)
            for i, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                if last is not None and keys[i] != last:
                    done = 0
                place[i:end] = np.arange(done, done + end - i)
                done += end - i
                last = keys[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "pos"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema.fields)
    return settle(ranged.mapInArrow(number, f"{schema}, pos long"))


def _starts(keys: list) -> list[int]:
    """Where runs of equal keys begin."""
    a = np.array(keys, dtype=object)
    return [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist()] if len(keys) else []


def _blocks(nodes: DataFrame) -> tuple[DataFrame, int]:
    """One row for each block of BLOCK neighbours: its root, all its nodes and the states that its parents keep; and the last block's number.

    A key's only block ends at one node; where a key has several, each has LEVELS levels.
    """

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        block = table.column("block")[0].as_py()
        tree = Subtree(from_bytes(b"".join(table.column("digest").to_pylist())), LEVELS if block else None)
        kept = tree.pack()
        return pa.table({"key": table.column("key")[:1], "block": [block], "width": [table.num_rows], "levels": [len(tree.states)], "root": [to_bytes(tree.root)], "nodes": [kept[0]], "states": [kept[1]]})

    grouped = nodes.select("key", "pos", "digest", F.expr(f"pos div {BLOCK}").alias("block")).groupBy("key", "block")
    blocks = settle(grouped.applyInArrow(build, "key string, block long, width long, levels long, root binary, nodes binary, states binary"))
    count, last = blocks.agg(F.count(F.lit(1)), F.max("block")).first()
    return blocks.coalesce(max(1, -(-count // ROWS))), last or 0


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks, each over the roots of the one before, until every key has one block."""
    blocks, last = _blocks(nodes)
    rounds = [blocks]
    while last:
        blocks, last = _blocks(blocks.select("key", F.col("block").alias("pos"), F.col("root").alias("digest")))
        rounds.append(blocks)
    return rounds


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks with the paths ``key, pos, path`` of their roots."""
    return blocks.join(paths.withColumnRenamed("pos", "block"), ["key", "block"])


def _descend(blocks: DataFrame) -> DataFrame:
    """``key, pos, path`` of the children of blocks whose own ``path`` is known."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tree = Subtree.unpack(row["width"], row["levels"], row["nodes"], row["states"])
                first = row["block"] * BLOCK
                found = tree.paths(row["path"])
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * len(found)), pa.array(range(first, first + len(found)), pa.int64()), pa.array(found, pa.binary())], names=["key", "pos", "path"])

    rows = blocks.select("key", "block", "width", "levels", "nodes", "states", "path")
    return rows.mapInArrow(run, "key string, pos long, path binary")


@dataclass
class Manifest:
    """``leaves`` (with ``key, pos, digest``), the tables of blocks over them and over the sources, and the sources' roots.

    All tables but ``leaves`` are written in the shared folder, so that folds need no row of the dataset.
    """

    leaves: DataFrame
    rounds: list[DataFrame]
    sources: DataFrame
    over: list[DataFrame]

    def root(self) -> DataFrame:
        """``root``: one row, none for an empty dataset."""
        return self.over[-1].select("root")

    def paths(self) -> DataFrame:
        """``key, block, path, subroot, root``: the way from each lowest block to the root."""
        down = _descend(self.over[-1].withColumn("path", F.lit(b"")))  # one block, nothing above it
        for blocks in reversed(self.over[:-1]):
            down = _descend(_with_paths(blocks, down))
        down = self.sources.join(down.drop("key"), "pos").select("key", F.lit(0).cast("long").alias("pos"), "path")
        for blocks in reversed(self.rounds[1:]):
            down = _descend(_with_paths(blocks, down))
        roots = self.sources.select("key", F.col("digest").alias("subroot"))
        whole = self.root().agg(F.max("root").alias("root")).select("root").scalar()
        return down.join(roots, "key").select("key", F.col("pos").alias("block"), "path", "subroot").withColumn("root", whole)


def manifest(docs: DataFrame, replaced: Column | None = None, fields: tuple[str, ...] = FIELDS) -> Manifest:
    """The Merkle tree over the rows of ``docs``.

    A row is a leaf: the SHA-256 of its ``fields`` (the first is its id, the second its source),
    see ``leaf_hash``.  Leaves of a source ascend by id (null first; equal ids by digest);
    every FANOUT neighbours become the SHA-256 of their hex digests until one remains, the
    source's root; the sources' roots, by source (null first, UTF-8 bytewise), likewise give the
    root.  ``replaced`` is a text that replaces the last field in a second digest of each leaf.

    Nodes lie in blocks of LEVELS levels.  Each parent keeps the SHA-256 state before each of its
    child slots, with which ``fold`` resumes.  Repeated rows are leaves each; empty and null
    texts differ; other columns are ignored; no rows give no leaves and no root.
    """
    ident, source, *_ = fields
    values = [F.col(f) for f in fields]
    leaf = leaf_hash(values)
    other = leaf if replaced is None else leaf_hash([*values[:-1], replaced])
    key = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("."), F.col(source)))  # null sorts first
    rows = settle(docs.select(F.col(ident).alias("id"), key.alias("key"), leaf.alias("digest"), other.alias("changed"), F.monotonically_increasing_id().alias("tie")))
    leaves = numbered(rows, "key", ["id", "digest", "tie"]).drop("tie")
    rounds = _rounds(leaves)
    roots = rounds[-1].select("key", F.col("root").alias("digest"), F.lit("").alias("all"))
    sources = numbered(roots, "all", ["key"])
    return Manifest(leaves, rounds, sources, _rounds(sources.select(F.col("all").alias("key"), "pos", "digest")))


def fold(tree: Manifest) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` (digests as lowercase hex), one row for each leaf.

    ``folded_root`` is the root that results if the leaf's digest alone becomes ``changed``;
    ``proof_sha256`` the SHA-256 of the hex digests of its siblings, from the lowest level to the
    highest, left to right in each (empty input for a leaf without siblings).
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = right.to_pylist()[0]
        left = left.sort_by("pos")
        tree, path = Subtree.unpack(row["width"], row["levels"], row["nodes"], row["states"]), Path(row["path"])
        folded = to_bytes(path.fold(tree.fold(from_bytes(b"".join(left.column("changed").to_pylist())))))
        proof = [hashlib.sha256(p).digest() for p in tree.proofs(path.proof)]
        n = left.num_rows
        return pa.table({
            "id": left.column("id"), "leaf": left.column("digest"), "subroot": pa.array([row["subroot"]] * n, pa.binary()), "root": pa.array([row["root"]] * n, pa.binary()),
            "proof": pa.array(proof, pa.binary()), "folded": pa.array([folded[32 * i : 32 * (i + 1)] for i in range(n)], pa.binary()),
        })

    leaves = tree.leaves.withColumn("block", F.expr(f"pos div {BLOCK}"))
    blocks = tree.rounds[0].drop("root").join(tree.paths(), ["key", "block"]).select("key", "block", "width", "levels", "nodes", "states", "path", "subroot", "root")
    kind = tree.leaves.schema["id"].dataType.simpleString()
    done = leaves.groupBy("key", "block").cogroup(blocks.groupBy("key", "block")).applyInArrow(run, f"id {kind}, leaf binary, subroot binary, root binary, proof binary, folded binary")

    def text(name):
        return F.lower(F.hex(name))

    return done.select(
        "id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), text("proof").alias("proof_sha256"), text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
