"""Near-duplicate vectors by an inverted multi-index over the products of two codebooks."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .components import connected_components
from .topk import usable

CELL = 4_096  # vectors of a cell of the grid, on average over all labels
SAMPLE = 4_096  # vectors that codebooks and cut-off are fitted on
TARGET = 0.998  # recall of one-sided visits for partners at exactly the least similarity
CHUNK = 1_024  # vectors of a cell that meet as many visitors in one task


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ book.T + (book**2).sum(axis=1)


def train_codebook(x: np.ndarray, size: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's algorithm from evenly drawn rows; an empty cluster keeps its centre."""
    book = x[np.linspace(0, len(x) - 1, size).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(x, book).argmin(axis=1)
        n = np.bincount(near, minlength=size)
        for k in range(x.shape[1]):
            book[:, k] = np.where(n > 0, np.bincount(near, x[:, k], size) / np.maximum(n, 1), book[:, k])
    return book


def visits(first: np.ndarray, second: np.ndarray, excess: float):
    """Multi-sequence traversal: cells ``(i, j)`` by ascending distance sum, while it exceeds the nearest one's by at most ``excess``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    best = first[a[0]] + second[b[0]]
    queue, met = [(best, 0, 0)], {(0, 0)}
    while queue:
        far, i, j = heapq.heappop(queue)
        if far - best > excess:
            return
        yield int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in met:
                met.add((x, y))
                heapq.heappush(queue, (first[a[x]] + second[b[y]], x, y))


class MultiIndex:
    """Two codebooks for the halves of unit vectors, and the cut-off of the traversal."""

    def __init__(self, sample: np.ndarray, size: int, least: float, target: float = TARGET):
        self.half = sample.shape[1] // 2
        self.books = [train_codebook(sample[:, : self.half], size), train_codebook(sample[:, self.half :], size)]
        self.size = size
        # partners of the sample at exactly the least similarity, in random directions: the excess
        # at which the traversal from one meets the cell of the other
        rng = np.random.default_rng(3)
        noise = rng.standard_normal(sample.shape)
        noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        partner = least * sample + math.sqrt(1 - least**2) * noise
        excess = np.zeros(len(sample))
        for x, y in zip(self.distances(sample), self.distances(partner), strict=True):
            excess += x[np.arange(len(x)), y.argmin(axis=1)] - x.min(axis=1)
        self.excess = float(np.quantile(excess, target))

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [_distances(x[:, : self.half], self.books[0]), _distances(x[:, self.half :], self.books[1])]

    def cells(self, x: np.ndarray) -> list[list[int]]:
        """Cells that each vector visits; the first one is its own."""
        return [[i * self.size + j for i, j in visits(a, b, self.excess)] for a, b in zip(*self.distances(x), strict=True)]


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy()
    wide = np.zeros((len(sizes), max(2, int(sizes.max(initial=0)))))
    wide[np.arange(wide.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _forest(mask: np.ndarray):
    """Pairs (row, column) that connect what the pairs of ``mask`` connect, at most rows + columns of them."""
    rows_left, cols_left, out = mask.any(axis=1), np.ones(mask.shape[1], bool), []
    while rows_left.any():
        new = np.flatnonzero(rows_left)[:1]
        rows_left[new] = False
        while len(new):
            cols = np.flatnonzero(mask[new].any(axis=0) & cols_left)
            if not len(cols):
                break
            cols_left[cols] = False
            out += zip(new[mask[np.ix_(new, cols)].argmax(axis=0)].tolist(), cols.tolist(), strict=True)
            rows = np.flatnonzero(mask[:, cols].any(axis=1) & rows_left)
            rows_left[rows] = False
            out += zip(rows.tolist(), cols[mask[np.ix_(rows, cols)].argmax(axis=1)].tolist(), strict=True)
            new = rows
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.93, cell: int = CELL, target: float = TARGET) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding, label``.

    Vectors of equal labels are linked if their cosine, in doubles, is at least ``least``.
    Equal vectors of a label are one entry that knows its number of copies.  Every entry lies
    in one cell of the product grid and visits the nearest cells, as far as a partner at the
    least similarity may lie with probability ``target`` (from either side, so a pair is
    missed with a far smaller one).  In each cell and label, visitors and residents are
    compared in blocks of CHUNK x CHUNK; a block returns link counts and a spanning forest,
    so its output grows with its rows, not with its pairs.  A pair that both sides would find
    is counted on the side of the smaller vec_id.

    A vector that is null, zero or holds null or non-finite components, or has no label or no
    vec_id, links with nothing; without vec_id its component is null and it is kept.  Shorter
    vectors count as filled up with zeros.  Rows that repeat are linked; a vec_id with several
    vectors is one vertex.  Other columns are ignored; no rows give no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    fit = usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    entries = settle(rows.where("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    count = entries.count()
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    drawn = entries.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).toArrow()
    sample = _matrix(drawn.column("embedding"))
    size = min(len(sample), max(2, math.ceil(math.sqrt(count / cell))))
    index = MultiIndex(sample, size, least, target)
    width = sample.shape[1]

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("embedding"))
                x = np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))[:, :]
                cells = index.cells(x[:, :width])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "label", "copies", "embedding")), pa.array(cells, pa.list_(pa.int64()))], names=["id", "label", "copies", "embedding", "cells"])

    kind = {f.name: f.dataType.simpleString() for f in entries.schema.fields}
    placed = settle(entries.select("id", "label", "copies", "embedding").mapInArrow(place, f"id long, label {kind['label']}, copies long, embedding {kind['embedding']}, cells array<long>"))
    home = F.element_at("cells", 1)
    residents = placed.select("id", "label", "copies", "embedding", home.alias("cell"), home.alias("home"), "cells", F.lit(True).alias("resident"))
    none = F.array().cast("array<long>")
    visitors = placed.select("id", "label", "copies", "embedding", F.explode("cells").alias("cell"), home.alias("home"), none.alias("cells"), F.lit(False).alias("resident"))
    both = residents.union(visitors)
    sizes = placed.select("label", home.alias("cell")).groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"))
    crowds = placed.select("label", F.explode("cells").alias("cell")).groupBy("label", "cell").agg(F.count(F.lit(1)).alias("m"))
    grid = sizes.join(crowds, ["label", "cell"]).select("label", "cell", F.ceil(F.col("n") / CHUNK).alias("across"), F.ceil(F.col("m") / CHUNK).alias("down"))
    dealt = both.join(grid, ["label", "cell"])
    mark = F.xxhash64("id")
    resident = F.col("resident")
    line = F.when(resident, F.sequence(F.lit(0).cast("long"), F.col("down") - 1)).otherwise(F.array(F.pmod(mark, F.col("down"))))
    dealt = dealt.withColumn("i", F.when(resident, F.pmod(mark, F.col("across")))).withColumn("j", F.explode(line))
    dealt = dealt.withColumn("i", F.explode(F.when(resident, F.array("i")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)))).drop("across", "down")

    def meet(table: pa.Table) -> pa.Table:
        here = table.column("resident").to_numpy(zero_copy_only=False)
        ids, copies, homes = (table.column(c).to_numpy() for c in ("id", "copies", "home"))
        unit = _matrix(table.column("embedding"))
        own, guests = np.flatnonzero(here), np.flatnonzero(~here)
        mask = unit[guests] @ unit[own].T >= least
        mask &= ids[guests][:, None] != ids[own]
        g, r = np.nonzero(mask)
        if len(g):  # leave out what the resident finds as a visitor of the guest's cell
            lists = table.column("cells").take(own).combine_chunks()
            span = max(int(homes.max()), int(max(lists.flatten().to_numpy(), default=0))) + 1
            known = np.repeat(np.arange(len(own)), lists.value_lengths().to_numpy()) * span + lists.flatten().to_numpy()
            twice = np.isin(r * span + homes[guests][g], known) & (ids[guests][g] > ids[own][r])
            mask[g[twice], r[twice]] = False
        links = np.concatenate([mask @ copies[own], mask.T @ copies[guests]])
        who = np.concatenate([ids[guests], ids[own]])[links > 0]
        edges = _forest(mask)
        a = [int(ids[guests[x]]) for x, _ in edges]
        b = [int(ids[own[y]]) for _, y in edges]
        n = len(who)
        return pa.table({
            "a": pa.array([*who.tolist(), *a], pa.int64()), "b": pa.array([None] * n + b, pa.int64()), "links": pa.array([*links[links > 0].tolist(), *[0] * len(a)], pa.int64()),
        })

    met = settle(dealt.groupBy("label", "cell", "i", "j").applyInArrow(meet, "a long, b long, links long"))
    counts = met.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "id")
    parts = connected_components(met.where("b is not null"), "a", "b").toDF("id", "part")
    known = entries.join(counts, "id", "left").join(parts, "id", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("part", "id").alias("component_id")
    )
    linked = rows.where("fit").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
