"""Near-duplicate documents: MinHash bands, signature check, exact check, components."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, settle, settle_small
from .components import connected_components
from .hashing import _ODD, mix, shingle_set, texts_to_words

ROWS = 5  # minima in a band
SEED = 20
SIGNATURE = 512  # minima of a signature, a byte of each
MARGIN = 4.5  # standard errors below the limit at which a signature still passes
CHUNK = 512  # nodes of a cluster that meet as many others in one task


def band_count(percent: int, rows: int = ROWS, miss: float = 1e-5) -> int:
    """Bands at which a pair of exactly the least similarity is missed with probability ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - min(percent / 100, 0.999999) ** rows))


def _slices(batches, rows: int = 1024):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _shingles(batch: pa.RecordBatch, k: int):
    texts = (t.lower() for t in batch.column("text").cast(pa.binary()).to_pylist())  # bytes.lower changes A-Z alone
    for words in texts_to_words(texts):
        yield shingle_set(words, k)


def _node(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


class MinHash:
    """Minima of a set's hashes under many universal hash functions, and the keys of their bands."""

    def __init__(self, bands: int, rows: int = ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), ~np.uint64(0))
        for at in range(0, len(shingles), 2048):
            part = self.a * shingles[at : at + 2048]
            part += self.b
            np.minimum(least, part.min(axis=1), out=least)
        return least

    def keys(self, minima: np.ndarray) -> np.ndarray:
        band = np.arange(self.bands, dtype=np.uint64) * _ODD[6]
        return mix((minima.reshape(self.bands, self.rows) * _ODD[: self.rows]).sum(axis=1, dtype=np.uint64) + band).view(np.int64)

    @staticmethod
    def signature(minima: np.ndarray) -> bytes:
        return (minima >> np.uint64(32)).astype(np.uint8).tobytes()


def least_agreement(percent: int) -> float:
    """Share of equal signature bytes that a pair of exactly the least similarity misses with probability below 1e-5."""
    p = percent / 100 + (1 - percent / 100) / 256  # bytes of different minima agree by chance
    return p - MARGIN * math.sqrt(p * (1 - p) / SIGNATURE)


def sketches(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """``doc_id, n_shingles, node, keys``: a digest of each document's set and its band keys."""

    def run(batches):
        family = MinHash(bands)
        for batch in _slices(batches):
            size, node, keys = [], [], []
            for s in _shingles(batch, k):
                size.append(len(s))
                node.append(_node(s))
                keys.append(family.keys(family.minima(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "node", "keys"]
            )

    return docs.mapInArrow(releasing(run), "doc_id long, n_shingles long, node binary, keys array<long>")


def _star_pairs(members: DataFrame) -> DataFrame:
    """In each bucket, every member with the one that meets most others in all buckets."""
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = members.join(degree, "node")
    hubs = ranked.groupBy("key").agg(F.max_by("node", F.struct("degree", "node")).alias("hub"))
    return members.join(hubs, "key").where("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _unresolved(members: DataFrame, parts: DataFrame) -> DataFrame:
    """``node, part, cluster, rest, n, r`` of buckets that still hold several components.

    Buckets that share members form a cluster of ``n`` nodes.  Its largest component is done
    with itself; the ``r`` nodes outside of it (``rest``) have to meet all others.
    """
    known = members.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    open_keys = known.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("node").alias("hub")).where("lo != hi").select("key", "hub")
    rows = settle_small(known.join(open_keys, "key").select("node", "part", "hub").distinct())
    clusters = connected_components(rows, "node", "hub").toDF("node", "cluster")
    rows = settle_small(rows.select("node", "part").distinct().join(clusters, "node"))
    sizes = rows.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("k"))
    sizes = sizes.groupBy("cluster").agg(F.max_by("part", F.struct("k", "part")).alias("main"), F.sum("k").alias("n"), F.max("k").alias("most"))
    rows = rows.join(sizes, "cluster")
    return rows.select("node", "part", "cluster", (F.col("part") != F.col("main")).alias("rest"), "n", (F.col("n") - F.col("most")).alias("r"))


def _blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the comparison in each cluster, dealt into blocks ``cluster, i, j``.

    The nodes outside of a cluster's largest component, in chunks, meet the chunks of all its
    nodes; one pair of chunks is one block, so a cluster of any size spreads over the tasks.
    """
    chunk = F.expr(f"pmod(xxhash64(node), ceil(n / {CHUNK}))")
    lone = F.expr(f"pmod(xxhash64(node, 1), ceil(r / {CHUNK}))")
    columns = ["cluster", "node", "part", "minima"]
    left = rows.where("rest").select(*columns, F.lit(True).alias("asks"), lone.alias("i"), F.explode(F.expr(f"sequence(0L, ceil(n / {CHUNK}) - 1)")).alias("j"))
    right = rows.select(*columns, F.lit(False).alias("asks"), F.explode(F.expr(f"sequence(0L, ceil(r / {CHUNK}) - 1)")).alias("i"), chunk.alias("j"))
    return left, right


def _sides(table: pa.Table):
    """Nodes of a block, the number of each one's component, and the places of its two sides."""
    node = table.column("node").to_pylist()
    root = np.unique(np.array(table.column("part").to_pylist(), dtype=object), return_inverse=True)[1].reshape(-1)
    same = {}
    for i, x in enumerate(node):  # a node may stand on both sides
        root[i] = root[same.setdefault(x, i)]
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    return node, root, np.flatnonzero(asks), np.flatnonzero(~asks)


def _likely_nodes(rows: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """``cluster, i, j, node, part, asks``: the nodes of each block whose signature agrees with one of another component."""
    left, right = _blocks(rows.join(signatures, "node"))

    def block(table: pa.Table) -> pa.Table:
        _, root, left, right = _sides(table)
        sig = np.frombuffer(b"".join(table.column("minima").to_pylist()), np.uint8).reshape(len(root), -1)
        keep = np.zeros(len(root), bool)
        for x in left:
            y = right[root[right] != root[x]]
            y = y[(sig[y] == sig[x]).mean(axis=1) >= least]
            keep[y] = True
            keep[x] = len(y) > 0
        return table.filter(pa.array(keep)).drop_columns(["minima"]).select(["cluster", "i", "j", "node", "part", "asks"])

    return left.union(right).groupBy("cluster", "i", "j").applyInArrow(block, "cluster binary, i long, j long, node binary, part binary, asks boolean")


def _cross_links(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components of each cluster, as few as connect what all of them connect.

    A block compares full sets, skips what is connected already, and returns at most one link
    for each node that it joins.
    """

    def block(table: pa.Table) -> pa.Table:
        node, root, left, right = _sides(table)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        size = np.array([len(x) for x in sets])
        ends = np.cumsum(size)
        numbers = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
        mark = np.zeros(numbers.max() + 1, np.int64)
        out_a, out_b = [], []
        for x in left:
            y = right[root[right] != root[x]]
            if not len(y):
                continue
            own = numbers[ends[x] - size[x] : ends[x]]
            mark[own] = 1
            both = np.array([mark[numbers[ends[z] - size[z] : ends[z]]].sum() for z in y])
            mark[own] = 0
            for z in y[100 * both >= percent * (size[x] + size[y] - both)]:
                if root[z] != root[x]:
                    out_a.append(min(node[x], node[z]))
                    out_b.append(max(node[x], node[z]))
                    root[root == root[z]] = root[x]
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return likely.join(sets, "node").groupBy("cluster", "i", "j").applyInArrow(block, "a binary, b binary").distinct()


#: Bound of the table that is sent to all tasks before an exact join: so many buckets of ids.
ID_BUCKETS = 1 << 20


def _near(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents of the buckets (at most ID_BUCKETS, so the broadcast has a fixed bound) that hold a wanted doc_id."""
    bucket = F.expr(f"pmod(xxhash64(doc_id), {ID_BUCKETS}L)")
    near = F.broadcast(wanted.select(bucket.alias("bucket")).distinct())
    return docs.withColumn("bucket", bucket).join(near, "bucket", "left_semi").drop("bucket")


def _signatures(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """``node, minima`` of the wanted nodes (``doc_id, node``), computed anew; no text is shuffled."""

    def run(batches):
        family = MinHash(SIGNATURE, 1, SEED + 1)
        for batch in _slices(batches):
            sets = list(_shingles(batch, k))
            minima = [family.signature(family.minima(s)) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.binary()), pa.array(minima, pa.binary())], names=["node", "minima"])

    found = _near(docs, wanted).mapInArrow(releasing(run), "node binary, minima binary").where("node is not null")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _sets(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """``node, shingles``: full sets of the wanted nodes (and of other texts of their doc_ids), from one document each."""

    def run(batches):
        for batch in _slices(batches):
            sets = list(_shingles(batch, k))
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    texts = _near(docs, wanted).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return texts.mapInArrow(releasing(run), "node binary, shingles binary").dropDuplicates(["node"])


def _agreeing(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures agree often enough."""
    rows = pairs.join(signatures.toDF("a", "ma"), "a").join(signatures.toDF("b", "mb"), "b").select("a", "b", "ma", "mb")

    def run(batches):
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("ma", "mb"))
            yield batch.filter(pa.array((p == q).mean(axis=1) >= least)).select(["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    rows = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each row of ``docs``.

    Documents are linked if ``100 * |A and B| >= percent * |A or B|`` for their sets of
    distinct ``k``-word shingles (A-Z lower-cased, words end at ASCII white space; fewer
    than ``k`` words: the whole sequence is the one shingle).  ``component_id`` is the
    smallest doc_id that links reach, ``kept`` says that it is the document's own.

    Documents of one set (exact copies, repeated rows) form one node.  Nodes that share a
    band of MinHash minima are compared: each bucket's members with its most met member
    first; then, where buckets still hold several components, these with each other.  Pairs
    pass the share of equal minima (``least_agreement``) and then
    the full sets, which are fetched only for nodes that passed.  Sets are compared as 64-bit hashes.

    A null or empty text, or one of white space, has an empty set and no links.  A null
    doc_id has component null and is kept.  Rows that share a doc_id are one document for
    ``component_id`` only; other columns of ``docs`` are ignored.  No rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bands = band_count(percent)
    least = least_agreement(percent)
    drawn = settle(sketches(docs, k, bands))
    full = drawn.where("node is not null and doc_id is not null")
    classes = settle_small(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.any_value("keys").alias("keys")))
    spread = classes.select("node", F.explode("keys").alias("key"))
    classes = classes.drop("keys")
    crowded = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = settle_small(spread.join(crowded, "key"))
    pairs = settle_small(_star_pairs(members))

    def wanted(nodes):
        return classes.join(nodes.distinct(), "node", "left_semi").select("doc_id", "node")

    signatures = settle(_signatures(docs, k, wanted(members.select("node"))))
    pairs = settle_small(_agreeing(pairs, signatures, least))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    links = settle_small(_confirm(pairs, _sets(docs, k, wanted(ends)), percent))
    parts = connected_components(links, "a", "b").toDF("node", "part")
    rest = settle_small(_unresolved(members, parts))
    if not rest.isEmpty():
        likely = settle_small(_likely_nodes(rest, signatures, least))
        more = settle_small(_cross_links(likely, _sets(docs, k, wanted(likely.select("node"))), percent))
        parts = connected_components(links.union(more), "a", "b").toDF("node", "part")

    known = classes.join(parts, "node", "left").where("part is not null or copies > 1").withColumn("part", F.coalesce("part", "node"))
    known = settle_small(known)
    roots = known.groupBy("part").agg(F.min("doc_id").alias("root"))
    roots = known.join(roots, "part").select("node", "root")
    shown = drawn.select("doc_id", "n_shingles", "node")
    joined = shown.where("node is not null").join(roots, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
    alone = shown.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
