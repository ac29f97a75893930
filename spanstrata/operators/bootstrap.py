"""Bootstrap AUROC by exact draws: counted cells keep their numbers, how often each is drawn travels.

Rows equal in scores and truth are one cell; the sorted cells are numbered, and each stands for the
row numbers after those of the cells before it.  A task makes all draws of a replicate by a vectorised
MD5, counts them at four bits a row and adds them up by cell; what travels is one number for each
replicate and cell, in as few bits as their distribution needs.  Ranges of ROWS cells are the unit of
work then; a range returns its edge scores, which may go on in its neighbours, and one sum over the
scores in between.
"""

from __future__ import annotations

import math
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import _changes, prefix_sums, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 1 << 16  # cells of a range; an offset in it takes two bytes
DRAWS = 1 << 20  # draws made at once
PIECE = 1 << 20  # rows added up at once; a multiple of eight
COUNTED = 1 << 28  # rows whose draws are counted at once, in half a byte each; more rows take the draws of a replicate again; a multiple of PIECE
LANES = 50_000  # digests computed at once, which fit a core's cache
TURNOVER = 100_000  # numbers that differ in their last digits alone
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _texts() -> np.ndarray:
    """The last digits of the numbers below TURNOVER, a row of ASCII codes for each of them."""
    number = np.arange(TURNOVER)
    return np.stack([number // 10**k % 10 + 48 for k in reversed(range(len(str(TURNOVER)) - 1))]).astype(np.uint32)


def _digest_heads(prefix: bytes, lo: int, hi: int, texts: np.ndarray) -> np.ndarray:
    """First 13 hex digits of md5(prefix + decimal i) for i in [lo, hi), all of one number of digits, of one quotient by TURNOVER.

    Such keys differ in their last characters alone, so most words of a block are one number for
    all; what a round needs stays in six buffers.
    """
    digits = len(str(lo))
    last, size = min(len(texts), digits), len(prefix) + digits
    if size > 55:
        raise ValueError("a draw's key must fit one block")
    block = bytearray(64)
    block[: size - last] = prefix + str(lo).encode()[: digits - last]
    block[size], block[56], block[57] = 0x80, 8 * size & 255, 8 * size >> 8
    words = [int.from_bytes(block[4 * j : 4 * j + 4], "little") for j in range(16)]
    at = lo % TURNOVER
    for k in range(last):
        place = size - last + k
        words[place >> 2] = words[place >> 2] + (texts[k - last, at : at + hi - lo] << np.uint32(8 * (place & 3)))
    a, b, c, d = (np.full(hi - lo, s, np.uint32) for s in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn = i >> 4
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            at = i
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            at = (5 * i + 1) & 15
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            at = (3 * i + 5) & 15
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            at = 7 * i & 15
        f += a
        if isinstance(words[at], int):
            f += np.uint32(_SINES[i] + words[at] & 0xFFFFFFFF)
        else:
            f += words[at]
            f += np.uint32(_SINES[i])
        s = _TURNS[turn][i & 3]
        np.left_shift(f, np.uint32(s), out=g)
        f >>= np.uint32(32 - s)
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return a.byteswap().astype(np.int64) << 20 | (b.byteswap() >> np.uint32(12)).astype(np.int64)


def draws(seed: int, replicate: int, lo: int, hi: int, n: int) -> np.ndarray:
    """Draws lo..hi-1 of a replicate in [0, n), equal to ``evaluation.draw_index``."""
    prefix, out, texts = f"{seed}|{replicate}|".encode(), [], _texts()
    while lo < hi:
        end = min(hi, lo + LANES, lo - lo % TURNOVER + TURNOVER, 10 ** len(str(lo)))
        out.append(_digest_heads(prefix, lo, end, texts) % n)
        lo = end
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _counts(seed: int, replicate: int, n: int, lo: int, hi: int, narrow: bool = True) -> np.ndarray:
    """How often a replicate draws each of the rows [lo, hi): two rows in a byte, or, if not ``narrow``, one in each eight."""
    out, drawn = np.zeros(-(-(hi - lo) // 2), np.uint8) if narrow else np.zeros(hi - lo, np.int64), 0
    for at in range(0, n, DRAWS):
        d = draws(seed, replicate, at, min(n, at + DRAWS), n)
        if hi - lo < n:
            d = d[(d >= lo) & (d < hi)] - lo
        drawn += len(d)
        if narrow:
            np.add.at(out, d >> 1, (1 + 15 * (d & 1)).astype(np.uint8))
        else:
            np.add.at(out, d, 1)
    if narrow and sum(int((part & 15).sum(dtype=np.int64) + (part >> 4).sum(dtype=np.int64)) for part in np.split(out, range(PIECE, len(out), PIECE))) != drawn:
        raise OverflowError  # a row drawn more than fifteen times
    return out


def _counted_rows(seed: int, replicate: int, n: int):
    """How often each row is drawn, in order, PIECE rows at once."""
    for lo in range(0, n, COUNTED):
        hi = min(n, lo + COUNTED)
        try:
            counts = _counts(seed, replicate, n, lo, hi)
            for at in range(0, hi - lo, PIECE):
                two = counts[at >> 1 : at + PIECE >> 1]
                yield np.stack([two & 15, two >> 4], axis=1).ravel()[: hi - lo - at].astype(np.int64)
        except OverflowError:  # hardly ever; then sixteen times fewer rows at once, in eight bytes each
            step = max(PIECE, COUNTED >> 4)
            for at in range(lo, hi, step):
                counts = _counts(seed, replicate, n, at, min(hi, at + step), False)
                yield from np.split(counts, range(PIECE, len(counts), PIECE))


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as many bits as the largest one needs, four at least, by a Huffman code."""
    flat = counts.ravel()
    most = int(flat.max(initial=0))
    if most < 16:
        half = flat.astype(np.uint8)
        half = np.append(half, np.uint8(0)) if len(half) & 1 else half
        kind, raw = b"4", half[::2] | half[1::2] << 4
    else:
        kind = next(k for k in (b"B", b"H", b"I", b"Q") if most < 1 << 8 * np.dtype(k.decode()).itemsize)
        raw = flat.astype(kind.decode())
    code = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
    return kind + code.compress(raw.tobytes()) + code.flush()


def _unpacked(blob: bytes, size: int) -> np.ndarray:
    kind, raw = blob[:1], zlib.decompress(blob[1:], -15)
    if kind != b"4":
        return np.frombuffer(raw, kind.decode())
    two = np.frombuffer(raw, np.uint8)
    return np.stack([two & 15, two >> 4], axis=1).ravel()[:size]


def first_rows(cells: DataFrame, lo: str, n: int) -> list[bytes]:
    """For each PIECE row numbers the bits of those that open a cell, deflated: at most a bit a row reaches the driver."""

    def run(batches):
        for batch in batches:
            at = np.sort(batch.column(0).to_numpy())
            block = at // PIECE
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(at) else np.empty(0, int)
            bits = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
                plane = np.zeros(PIECE, bool)
                plane[at[s:e] % PIECE] = True
                bits.append(zlib.compress(np.packbits(plane).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(block[starts], pa.int64()), pa.array(bits, pa.binary())], names=["block", "bits"])

    out = [np.zeros(PIECE >> 3, np.uint8) for _ in range(-(-n // PIECE))]
    for r in cells.select(F.col(lo).cast("long")).mapInArrow(run, "block long, bits binary").collect():
        out[r["block"]] |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return [zlib.compress(plane.tobytes(), 1) for plane in out]


def drawn_cells(cells: DataFrame, lo: str, seed: int, replicates: int, n: int) -> DataFrame:
    """``replicate, _range, _off, _many``: how often each cell of a range is drawn; n draws of each replicate."""
    opens = first_rows(cells, lo, n)

    def sums(replicate: int):
        """Draws of each cell in order, in arrays of any length; a cell may go on in later rows."""
        carry = None
        for counts, bits in zip(_counted_rows(seed, replicate, n), opens, strict=True):
            first = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))[: len(counts)])
            run = np.concatenate([[0], np.cumsum(counts)])
            edges = np.concatenate([first, [len(counts)]])
            if carry is not None:
                carry += run[edges[0]]
            if len(first):
                own = run[edges[1:]] - run[first]
                yield own[:-1] if carry is None else np.concatenate([[carry], own[:-1]])
                carry = own[-1]
        yield np.array([carry])

    def run(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                number, held = 0, np.empty(0, np.int64)
                for part in sums(i + 1):
                    held = np.concatenate([held, part])
                    while len(held) >= ROWS:
                        yield row(i + 1, number, held[:ROWS])
                        number, held = number + 1, held[ROWS:]
                if len(held):
                    yield row(i + 1, number, held)

    def row(replicate: int, number: int, counts: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array([replicate], pa.int64()), pa.array([number], pa.int64()), pa.array([None], pa.binary()), pa.array([_packed(counts)], pa.binary())], names=["replicate", "_range", "_off", "_many"])

    work = cells.sparkSession.range(0, replicates if n else 0, 1, max(1, min(replicates, 16 + replicates * -(-n // DRAWS) // 8)))
    return work.mapInArrow(run, "replicate long, _range long, _off binary, _many binary")


def counted_ranges(cells: DataFrame, dealt: DataFrame, score: str, truth: str, at: str, replicates: int, other: str | None = None) -> DataFrame:
    """``replicate, s, p, q, w, edge`` of each range and replicate: positives and others of a score, and what their pairs add up to.

    ``at`` numbers the cells in the order of ``score``; ``dealt`` has, for a range, the draws of all its
    cells by a replicate, or of the cells at ``_off`` by all replicates, one after the other.  Edge scores
    come singly, without ``w``; the scores in between as one row under their first score.  ``other`` names
    the cells' numbers in another order: then rows with ``_many`` hand the draws on in that order.
    """
    kind = cells.schema[score].dataType
    schema = T.StructType([T.StructField("replicate", T.LongType()), T.StructField("s", kind), *[T.StructField(c, t) for c, t in (("p", T.LongType()), ("q", T.LongType()), ("w", T.DoubleType()), ("edge", T.BooleanType()), ("_range", T.LongType()), ("_off", T.BinaryType()), ("_many", T.BinaryType()))]])

    def all_draws(hits: pa.Table, size: int) -> np.ndarray:
        """Draws by replicate and cell."""
        parts = []
        for r, off, many in zip(*(hits.column(c).to_pylist() for c in ("replicate", "_off", "_many")), strict=True):
            cols = slice(None) if off is None else np.frombuffer(off, np.uint16)
            parts.append((slice(r - 1, r) if off is None else slice(None), cols, _unpacked(many, size if off is None else replicates * len(cols))))
        out = np.zeros((replicates, size), max((x.dtype for _, _, x in parts), key=lambda t: t.itemsize))
        for rows, cols, x in parts:
            out[rows, cols] = x.reshape(out[rows].shape[0], -1)
        return out

    def run(own: pa.Table, hits: pa.Table) -> pa.Table:
        out = {f.name: [] for f in schema.fields}
        if own.num_rows and hits.num_rows:
            own = own.sort_by("_at").combine_chunks()
            starts = np.concatenate([[0], np.flatnonzero(_changes(own.to_batches()[0], [score])) + 1])
            scores = own.column(score).take(pa.array(starts)).to_pylist()
            true = np.array([-1 if y is None else int(y == 1) for y in own.column(truth).to_pylist()])
            drawn = all_draws(hits, own.num_rows)
            for r, m in enumerate(drawn, 1):
                m = m.astype(np.int64)
                p, q = np.add.reduceat(np.where(true == 1, m, 0), starts), np.add.reduceat(np.where(true == 0, m, 0), starts)
                rows = [(scores[0], int(p[0]), int(q[0]), None, True)]
                if len(p) > 2:
                    pi, qi = p[1:-1].astype(float), q[1:-1].astype(float)
                    rows.append((scores[1], int(pi.sum()), int(qi.sum()), float((pi * (np.cumsum(qi) - qi / 2)).sum()), False))
                if len(p) > 1:
                    rows.append((scores[-1], int(p[-1]), int(q[-1]), None, True))
                for name, values in zip(out, zip(*[(r, *x, None, None, None) for x in rows]), strict=True):
                    out[name].extend(values)
            if other:
                elsewhere = own.column("_other").to_numpy()
                order = np.argsort(elsewhere, kind="stable")
                number, offsets = elsewhere[order] // ROWS, (elsewhere[order] % ROWS).astype(np.uint16)
                cuts = np.concatenate([[0], np.flatnonzero(number[1:] != number[:-1]) + 1, [len(number)]]).tolist()
                for s, e in zip(cuts, cuts[1:]):
                    for name, value in zip(out, (None, None, None, None, None, None, int(number[s]), offsets[s:e].tobytes(), _packed(drawn[:, order[s:e]])), strict=True):
                        out[name].append(value)
        types = [pa.int64(), own.schema.field(score).type, pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), types, strict=True)})

    own = cells.select(F.floor(F.col(at) / ROWS).alias("_range"), F.col(at).alias("_at"), score, truth, *([F.col(other).alias("_other")] if other else []))
    return own.groupBy("_range").cogroup(dealt.groupBy("_range")).applyInArrow(run, schema)


def auroc(pieces: DataFrame) -> DataFrame:
    """``replicate, auroc`` from all ranges; replicates of one class are dropped."""
    own = pieces.groupBy("replicate", "s").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum("w").alias("w"), F.max("edge").alias("edge"))
    own = own.withColumn("w", F.when(F.col("edge"), F.col("p").cast("double") * F.col("q") / 2.0).otherwise(F.col("w")))
    cum = prefix_sums(own, ["replicate"], [F.col("s")], {"_below": (F.col("q"), False)})
    agg = cum.groupBy("replicate").agg(F.sum(F.col("w") + F.col("p").cast("double") * F.col("_below")).alias("w"), F.sum("p").cast("double").alias("p"), F.sum("q").cast("double").alias("q"))
    return agg.where("p > 0 AND q > 0").select("replicate", (F.col("w") / (F.col("p") * F.col("q"))).alias("auroc"))


def drawn_aurocs(df: DataFrame, scores: list[str], truth: str, replicates: int, seed: int) -> list[DataFrame]:
    """AUROC of each replicate by one score, or by each of two on common draws.

    Row numbers follow (score, other score, truth), as the draws' definition wants.
    """
    cells = df.groupBy(*scores, truth).agg(F.count(F.lit(1)).alias("_n")).withColumn("_g", F.lit(0))
    cells = prefix_sums(cells, ["_g"], [F.col(c) for c in (*scores, truth)], {"_lo": (F.col("_n"), False), "_a": (F.lit(1), False)})
    if len(scores) == 2:
        cells = prefix_sums(cells, ["_g"], [F.col(c) for c in (scores[1], scores[0], truth)], {"_b": (F.lit(1), False)})
    cells = stored(cells, "cells")
    n = cells.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    dealt = drawn_cells(cells, "_lo", seed, replicates, n)
    if len(scores) == 1:
        return [auroc(counted_ranges(cells, dealt, scores[0], truth, "_a", replicates))]
    found = stored(counted_ranges(cells, dealt, scores[0], truth, "_a", replicates, "_b"), "draws")
    handed = found.where("_many IS NOT NULL").select("replicate", "_range", "_off", "_many")
    return [auroc(found.where("_many IS NULL")), auroc(counted_ranges(cells, handed, scores[1], truth, "_b", replicates))]
