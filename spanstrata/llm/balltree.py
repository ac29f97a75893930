"""Ranked lexical search: exact inner products of sparse vectors with ball trees."""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Bytes of a term (digits, letters, all bytes of other characters), A-Z lower-cased; the rest parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SLICE = 1 << 20  # bytes of a text that are cut into terms at once
ROWS = 512  # texts that a worker holds at once
BLOCK = 4096  # documents of a tree
ENTRIES = 1 << 21  # entries of a tree's vectors
LEAF = 128  # documents of a leaf
GROUP_BYTES = 8 << 20  # text of the items that are searched together
MERGE = 64  # lists that a group's best are merged in before the last ranking


def term_lists(text: bytes):
    """The terms of a text in order, as lists; the text may have any length."""
    text, at = text.translate(TERM_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, term, tf`` of the documents with a term: the number of terms, and counts of those in the vocabulary (from 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value.get
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                n, counts = 0, Counter()
                for words in term_lists(text or b""):
                    n += len(words)
                    counts.update(filter(None, map(known, words)))
                if n:
                    rows.append((doc, n, list(counts), list(counts.values())))
            if rows:
                doc, n, term, tf = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], names=["doc_id", "n", "term", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the runs ``start .. start + size``."""
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(start - ends + size, size)


class BallTree:
    """Documents as integer vectors without empty ones, halved into balls of a centroid and a radius.

    Centroids are rounded to integers and squared distances are exact integers, so a ball holds
    its documents without any rounding; only square roots are rounded, and upwards.
    """

    def __init__(self, size: np.ndarray, term: np.ndarray, value: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(size))
        self.balls = []  # first, last, centroid's terms and values, radius, children
        start = np.cumsum(size) - size
        squares = np.add.reduceat(value * value, start)
        width = int(term.max()) + 1

        def products(rows, dense):
            at = _ranges(start[rows], size[rows])
            return np.add.reduceat(dense[term[at]] * value[at], np.cumsum(size[rows]) - size[rows])

        def dense(at, weight):
            out = np.zeros(width, np.int64)
            out[term[at]] = weight
            return out

        def grow(lo, hi):
            rows = self.order[lo:hi]
            at = _ranges(start[rows], size[rows])
            total = np.bincount(term[at], weights=value[at], minlength=width).astype(np.int64)  # far below 2**53, so exact
            support = np.flatnonzero(total)
            centre = np.zeros(width, np.int64)
            centre[support] = (total[support] + len(rows) // 2) // len(rows)
            away = squares[rows] - 2 * products(rows, centre) + int((centre[support] ** 2).sum())
            me = len(self.balls)
            self.balls.append([lo, hi, support, centre[support], math.isqrt(int(away.max())) + 1, None])
            if hi - lo > leaf:
                far = rows[away.argmax()]
                one = slice(start[far], start[far] + size[far])
                near = products(rows, dense(one, value[one]))
                apart = squares[rows] - 2 * near
                other = rows[apart.argmax()]
                two = slice(start[other], start[other] + size[other])
                side = near - products(rows, dense(two, value[two]))
                mid = (hi - lo) // 2
                self.order[lo:hi] = rows[np.argpartition(side, mid)]
                self.balls[me][5] = (grow(lo, lo + mid), grow(lo + mid, hi))
            return me

        grow(0, len(size))
        at = _ranges(start[self.order], size[self.order])
        self.term, self.value, size = term[at], value[at], size[self.order]
        self.start = np.concatenate([[0], np.cumsum(size)])

    def bound(self, ball: int, query: np.ndarray) -> int:
        """No document of the ball has a higher product with the query (non-negative weights).

        By Cauchy and Schwarz on the terms that occur in the ball; the square root and the
        product with the radius are taken in doubles, with a relative margin far above their errors.
        """
        _, _, support, centre, radius, _ = self.balls[ball]
        own = query[support]
        far = math.sqrt(float((own.astype(np.float64) ** 2).sum())) * radius
        return int((own * centre).sum()) + math.ceil(far * (1 + 1e-9)) + 1

    def search(self, query: np.ndarray, best: "Best", ids: np.ndarray):
        """Visits balls from the highest bound down until no bound reaches the k-th score; leaves are scored exactly."""
        waiting = [(-self.bound(0, query), 0)]
        while waiting and -waiting[0][0] >= best.least:
            ball = heapq.heappop(waiting)[1]
            lo, hi, _, _, _, children = self.balls[ball]
            if children:
                for child in children:
                    bound = self.bound(child, query)
                    if bound >= best.least:
                        heapq.heappush(waiting, (-bound, child))
                continue
            a, b = self.start[lo], self.start[hi]
            scores = np.add.reduceat(query[self.term[a:b]] * self.value[a:b], self.start[lo:hi] - a)
            good = np.flatnonzero(scores >= best.least)
            if len(good):
                best.add(scores[good], ids[self.order[lo:hi][good]])


class Best:
    """The k highest scores above 0 so far, ties to smaller ids."""

    def __init__(self, k: int):
        self.k, self.least, self.scores, self.ids = k, 1, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores, ids):
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        keep = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[keep], ids[keep]
        if len(keep) == self.k:
            self.least = max(1, int(self.scores[-1]))


def values(tf: np.ndarray, n: np.ndarray, size: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A term's share in a document's scores; the length norm in Python's integers, which do not overflow."""
    m = np.array([100 - 25 + 25 * int(x) * documents // terms for x in n], dtype=np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, size))


def _search_group(docs: DataFrame, items: list, k: int, id_type) -> DataFrame:
    """Best documents of some items: one pass for the vectors, statistics, and one for the search."""
    terms = [Counter(w for words in term_lists((t or "").encode()) for w in words) for _, t in items]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for c in terms for t in c), 1)}
    found = settle(vectors(docs, vocabulary))
    stats = found.agg(F.count(F.lit(1)), F.sum("n")).first()
    documents, total = stats[0], stats[1] or 0
    df = found.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = np.zeros(len(vocabulary) + 1, np.int64)
    for term, n in df.collect():  # at most one row for each term of the items
        weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))
    asked = []
    for counts in terms:
        at = np.array([vocabulary[t] for t in counts], dtype=np.int64)
        asked.append((at, weight[at] * np.array(list(counts.values()), dtype=np.int64)))
    shared = docs.sparkSession.sparkContext.broadcast(asked)
    width, ids = len(vocabulary) + 1, pa.array([i for i, _ in items])

    def run(batches):
        best = [Best(k) for _ in shared.value]
        for batch in batches:
            doc, n = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
            size = batch.column("term").value_lengths().to_numpy().astype(np.int64)
            term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("term", "tf"))
            value = values(tf, n, size, documents, total)
            rows = np.flatnonzero((size > 0) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
            start = np.cumsum(size) - size
            while len(rows):
                cut = max(1, int(np.searchsorted(np.cumsum(size[rows[:BLOCK]]), ENTRIES, "right")))
                own, rows = rows[:cut], rows[cut:]
                at = _ranges(start[own], size[own])
                tree, own_ids = BallTree(size[own], term[at], value[at]), doc[own].astype(np.int64)
                dense = np.zeros(width, np.int64)
                for b, (terms, weights) in zip(best, shared.value, strict=True):
                    dense[terms] = weights
                    tree.search(dense, b, own_ids)
                    dense[terms] = 0
        item = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        if len(item):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(item)), pa.array(np.concatenate([b.ids for b in best])), pa.array(np.concatenate([b.scores for b in best]))], names=["item_id", "doc_id", "score"])

    return found.mapInArrow(run, f"item_id {id_type}, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item the ``k`` documents of the highest scores above 0.

    A document's vector holds a share of each of its terms (``values``), an item's vector the
    terms' weights times their repeats; the score is their inner product in 64-bit integers.
    Vectors are kept on the items' terms alone, for no other term can add to a score.  Each task
    builds ball trees over its documents, block by block, and searches them for all items with
    the best of its earlier blocks, so documents are never shuffled.

    Items travel to the tasks in groups of about GROUP_BYTES of text; each group is a pass over
    the documents.  Rows that share an item_id are one item of all their terms; rows without
    item_id are left out.  Null and empty texts have no terms.  Documents without doc_id count in
    the statistics and are not returned; rows that repeat a doc_id are documents each.  Ties go to the
    smaller doc_id; other columns are ignored; no items or no documents give no rows.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.where("item_id is not null").groupBy("item_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    held = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    groups = max(1, -(-held // GROUP_BYTES))
    found = None
    for g in range(groups):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()
        if own:
            part = _search_group(docs, [(r.item_id, r.text) for r in own], k, kind)
            found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = [F.desc("score"), "doc_id"]
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE))
    for keys in (["item_id", slot], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")
