"""Exact top-k by inner product with an impact-ordered index, a score at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 16_384  # candidates of one index
LARGEST = float(2**62)  # scaled components reach less than this
WIDE = 2**62  # sums below it are added up in 64 bits
NARROW = 52  # bits of a sum that can share a number with its count
LEVELS = 32  # quantised impacts of a dimension
CHECK = 64  # segments between two attempts at a proof
FEW = 16  # a proof is complete when one in FEW candidates is possible


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def scaled(vector: Column) -> Column:
    """floor(1024 * x) of each component x as a double; a component that does not fit fails the job."""

    def one(x):
        y = F.lit(1024.0) * x.cast("double")
        return F.when(F.abs(y) < F.lit(LARGEST), F.floor(y)).otherwise(F.raise_error(F.lit("a component is too large for a long score")).cast("long"))

    return F.transform(vector, one)


class ImpactIndex:
    """Posting segments ``(dimension, level)`` of a block of integer vectors.

    A component v of dimension d has the impact v - low(d) for a query of positive weight and
    high(d) - v for one of negative weight, so impacts are never negative and scores differ
    from sums of impacts by a constant of the query.  Levels cut a dimension's range evenly.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.most = int(np.abs(vectors).max(initial=0))
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        self.width = (self.high - self.low) // LEVELS + 1
        level = (vectors - self.low) // self.width
        self.segments = []
        for d in range(vectors.shape[1]):
            order = np.argsort(level[:, d], kind="stable")
            self.segments.append(np.split(order, np.searchsorted(level[order, d], np.arange(1, LEVELS))))

    def _ordered(self, query: np.ndarray):
        """All segments with upper bounds of their impacts, in descending order; the slack; a bound of all sums of impacts.

        Impacts count in units of ``2**shift``, rounded up, so that a sum over all dimensions stays below WIDE.
        """
        d = np.repeat(np.arange(len(query)), LEVELS)
        level = np.tile(np.arange(LEVELS), len(query))
        span = (self.high - self.low)[d]
        up = np.minimum((level + 1) * self.width[d] - 1, span)  # largest v - low in the level
        down = np.maximum(span - level * self.width[d], 0)  # largest high - v in the level
        far = np.where(query[d] > 0, up, down)
        weight = np.abs(query)
        top = int(weight.max(initial=0)) * max(1, int(span.max(initial=0))) * len(query)
        shift = max(0, top.bit_length() - WIDE.bit_length() + 2)
        if top < WIDE:
            impact, slack = weight[d] * far, int((weight * (self.width - 1)).sum())
        else:  # products beyond 64 bits, in Python's integers
            impact = np.array([(w * x >> shift) + 1 for w, x in zip(weight[d].tolist(), far.tolist(), strict=True)], np.int64)
            slack = sum((w * x >> shift) + 2 for w, x in zip(weight.tolist(), (self.width - 1).tolist(), strict=True))
        keep = weight[d] > 0
        order = np.argsort(-impact[keep], kind="stable")
        return d[keep][order].tolist(), level[keep][order].tolist(), impact[keep][order], slack, min(top, WIDE)

    def top(self, query: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int):
        """Rows of the ``k`` highest scores among ``allowed`` ones, ties to smaller ids, and the scores.

        Segments are added in descending order of impact.  A row's upper bound is its sum so
        far plus the next segment's impact for each dimension not seen yet; the lower bound is
        the sum less the levels' widths.  Rows whose upper bound is below the k-th lower bound
        cannot be members; those that remain are scored exactly.  A score that does not fit 64 bits is an error.
        """
        n, dims = len(self.vectors), int((query != 0).sum())
        rows = np.flatnonzero(allowed)
        if len(rows) > k and dims:
            total, count = np.zeros(n, np.int64), np.zeros(n, np.int32)
            d, level, impact, slack, most = self._ordered(query)
            both = most < 1 << NARROW  # one addition for sum and count, where no sum can reach the count's bits
            step = impact + (np.int64(1) << np.int64(NARROW)) if both else impact
            for at in range(len(d)):
                posting = self.segments[d[at]][level[at]]
                if len(posting):
                    total[posting] += step[at]
                    if not both:
                        count[posting] += 1
                if at % CHECK == CHECK - 1 and at + 1 < len(d) and at * 2 > len(d):
                    rows = self._possible(*self._parted(total, count, both), allowed, k, dims, impact[at + 1], slack)
                    if len(rows) * FEW <= n:
                        break
            else:
                rows = self._possible(*self._parted(total, count, both), allowed, k, dims, 0, slack)
        score = self._scores(rows, query)
        best = np.lexsort((ids[rows], -score))[:k]
        return rows[best], score[best]

    def _scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.most * int(np.abs(query).max(initial=0)) * len(query) < WIDE:
            return self.vectors[rows] @ query
        exact = self.vectors[rows].astype(object) @ query.astype(object)
        if any(abs(x) >= 1 << 63 for x in exact):
            raise OverflowError("a score does not fit a long")
        return exact.astype(np.int64)

    @staticmethod
    def _parted(total, count, both):
        return (total & ((1 << NARROW) - 1), total >> NARROW) if both else (total, count)

    @staticmethod
    def _possible(total, count, allowed, k, dims, rest, slack):
        lower = (total - slack)[allowed]
        limit = np.partition(lower, len(lower) - k)[len(lower) - k]
        return np.flatnonzero(allowed & (total + (dims - count) * rest >= limit))


def _wide(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of ``width`` numbers, filled up with zeros."""
    sizes = lists.value_lengths().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 10, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``queries`` selects, the ``k`` best other rows.

    ``vectors`` has ``vec_id`` and ``embedding``; scores are integer inner products of
    floor(1024 * x) without any clamp; a component or a score that does not fit a long fails the
    job.  Candidates are dealt at random into blocks of about ``block`` rows; a task builds a
    block's index once, and all queries stream past it in batches.  Each query's best of all
    blocks are ranked.

    Vectors that are null or hold null or non-finite components take no part, nor do rows
    without vec_id.  Shorter vectors count as filled up with zeros.  A query skips all rows of
    its own vec_id; rows that repeat a vec_id are candidates each.  Ties go to the smaller
    vec_id; other columns are ignored; no rows, or no queries, give no rows.
    """
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("v"), queries.alias("asks"))
    blocks = max(1, -(-rows.count() // block))
    mark = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    candidates = rows.select("vec_id", "v", F.lit(False).alias("asks"), mark.alias("b"))
    asking = rows.where("asks").select("vec_id", "v", "asks", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    dealt = candidates.union(asking).repartitionById(blocks, F.col("b")).sortWithinPartitions("asks")  # candidates first

    def run(batches):
        ids, lists, index = [], [], None
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            own = int((~asks).sum())
            if own:  # candidates come first, so there is no index yet
                ids.append(batch.column("vec_id").slice(0, own).to_numpy())
                lists.append(batch.column("v").slice(0, own))
            if own == batch.num_rows:
                continue
            if index is None:
                if not ids:
                    return
                ids, width = np.concatenate(ids), max(1, max(int(x.value_lengths().to_numpy().max(initial=0)) for x in lists))
                index, lists = ImpactIndex(np.concatenate([_wide(x, width) for x in lists])), None
            out, asked = [], batch.column("v").slice(own)
            longest = max(width, int(asked.value_lengths().to_numpy().max(initial=0)))
            for q, query in zip(batch.column("vec_id").slice(own).to_pylist(), _wide(asked, longest), strict=True):
                best, score = index.top(query[:width], ids != q, ids, k)  # beyond the width candidates hold zeros
                out += zip([q] * len(best), ids[best].tolist(), score.tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    found = dealt.select("vec_id", "v", "asks").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
