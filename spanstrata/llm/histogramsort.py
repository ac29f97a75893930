"""Sharding by histogram sort: splitters from exact counts below probes, then one exchange."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

PART_BYTES = 1 << 30  # bytes of text that are sorted in one task
PROBES = 16  # candidate boundaries in each open interval
TOLERANCE = 0.005  # of a shard: how far a boundary between different texts may lie from its ideal place
INNER = 0.05  # of a task's share: the same for boundaries inside a shard

_SIGN = 1 << 63
_ALL = 1 << 64


def _packed(keys: list[int]) -> np.ndarray:
    """128-bit keys as byte strings of the same order."""
    return np.frombuffer(b"".join(k.to_bytes(16, "big") for k in keys), "S16")


def _rows(high: pd.Series, low: pd.Series) -> np.ndarray:
    pair = np.empty((len(high), 2), ">u8")  # big-endian, so that bytes compare as numbers do
    for i, x in enumerate((high, low)):
        pair[:, i] = x.to_numpy(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    return np.frombuffer(pair.tobytes(), "S16")


def _key(pair) -> int:
    return (pair[0] + _SIGN) * _ALL + pair[1] + _SIGN


def _histogram(keys: DataFrame, probes: list[int]):
    """Bytes and rows below each probe, and the smallest and largest key of each gap that has rows."""
    packed = _packed(probes)

    @F.pandas_udf("int")
    def gap(high: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(packed, _rows(high, low), side="right").astype(np.int32))

    pair = F.struct("high", "low")
    counted = keys.groupBy(gap("high", "low").alias("gap")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min(pair).alias("least"), F.max(pair).alias("most"))
    size, rows, ends = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64), {}
    for r in counted.collect():  # at most one row for each gap between probes
        size[r.gap], rows[r.gap], ends[r.gap] = r.bytes, r.rows, (_key(r.least), _key(r.most))
    return np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist(), ends


class _Splitter:
    """An interval of keys around the boundary below which ``target`` bytes should lie."""

    def __init__(self, target: int, slack: float, low, high):
        self.target, self.slack, self.low, self.high = target, slack, low, high  # ends: (key, bytes below, rows below)

    @property
    def best(self):
        return min(self.low, self.high, key=lambda e: abs(e[1] - self.target))

    @property
    def done(self) -> bool:
        return abs(self.best[1] - self.target) <= self.slack or self.high[0] - self.low[0] <= 1

    def probes(self, count: int) -> list[int]:
        """Even places in the interval; between texts while several digests remain, between ids after that."""
        a, b = self.low[0], self.high[0]
        if -(-b // _ALL) - a // _ALL > 1:  # a boundary of texts lies inside
            a, b, unit = a // _ALL, -(-b // _ALL), _ALL
        else:
            unit = 1
        n = min(count, b - a - 1)
        return [(a + (b - a) * i // (n + 1)) * unit for i in range(1, n + 1)]


def splitters(keys: DataFrame, shards: int, part_bytes: int = PART_BYTES) -> list[tuple[int, int, int]]:
    """``(key, bytes below, rows below)`` of the boundaries between parts; every shard has equally many parts.

    Each round counts, over all partitions, the exact bytes and rows below candidate boundaries
    inside the intervals that are still open, and narrows them.  A boundary is settled when it
    meets its tolerance or when no row lies between its ends; then the nearer end is taken.  The
    driver holds PROBES keys for each open boundary, of which there are one for each part.
    """
    total, rows, least, most = keys.agg(F.sum("size"), F.count(F.lit(1)), F.min(F.struct("high", "low")), F.max(F.struct("high", "low"))).first()
    if not rows:
        return []
    parts = shards * max(1, -(-total // (shards * part_bytes)))
    inner = parts // shards
    low, high = (_key(least), 0, 0), (_key(most) + 1, total, rows)
    found = [_Splitter(total * j // parts, total / shards * TOLERANCE if j % inner == 0 else total / parts * INNER, low, high) for j in range(1, parts)]
    while open_ones := [s for s in found if not s.done]:
        probes = sorted({p for s in open_ones for p in s.probes(PROBES) if s.low[0] < p < s.high[0]})
        size, count, ends = _histogram(keys, probes)
        for s in open_ones:
            at = int(np.searchsorted(size, s.target, side="right"))  # the first probe with more bytes below it
            if at and (probes[at - 1], size[at - 1], count[at - 1]) > s.low:
                s.low = (probes[at - 1], size[at - 1], count[at - 1])
            if at < len(probes) and probes[at] < s.high[0]:
                s.high = (probes[at], size[at], count[at])
            if at in ends:  # rows of this gap alone lie between the ends
                s.low = (max(s.low[0], ends[at][0]), *s.low[1:])
                s.high = (min(s.high[0], ends[at][1] + 1), *s.high[1:])
    chosen = [low]
    for s in found:
        chosen.append(max(chosen[-1], s.best))
    return chosen


def shard(docs: DataFrame, shards: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with ``size, text_crc32, shard, slot``: shards of nearly equal bytes.

    ``size`` is the text's UTF-8 bytes plus 8, ``text_crc32`` their checksum; a null text counts as an empty one.
    Rows are ordered by the hash of their text, then by doc_id (null first), and cut
    where the bytes of all rows below come nearest to equal shares: at a boundary between texts
    within TOLERANCE of a shard if there is one, so equal texts stay together; else, as in a
    large group of copies, between two ids.  ``slot`` counts a shard's rows in that order, gapless from 0.

    Rows equal in text and doc_id stay together whatever their number.  A shard is sorted in as
    many tasks as its bytes need.  Other columns are kept unless a result bears their name; no
    rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.withColumns({
        "size": (F.octet_length(text) + F.lit(8)).cast("long"), "text_crc32": F.crc32(F.encode(text, "UTF-8")),
        "_high": F.xxhash64(text), "_low": F.coalesce(F.col("doc_id").cast("long"), F.lit(-_SIGN)),
    })
    chosen = splitters(settle(named.select(F.col("_high").alias("high"), F.col("_low").alias("low"), "size")), shards, part_bytes)
    parts = max(len(chosen), shards)
    inner = parts // shards
    packed = _packed([k for k, _, _ in chosen[1:]])
    below = np.array([r for _, _, r in chosen] or [0] * parts, np.int64)
    first = below - below[np.arange(parts) // inner * inner]

    @F.pandas_udf("part int, first long")
    def place(high: pd.Series, low: pd.Series) -> pd.DataFrame:
        part = np.searchsorted(packed, _rows(high, low), side="right")
        return pd.DataFrame({"part": part.astype(np.int32), "first": first[part]})

    dealt = named.withColumn("_place", place("_high", "_low")).repartitionById(parts, F.col("_place.part")).sortWithinPartitions("_high", "_low")
    slot = F.col("_place.first") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    kept = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
    return dealt.select(*kept, "size", "text_crc32", F.expr(f"int(_place.part div {inner})").alias("shard"), slot.alias("slot"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard; the files of a shard hold runs of its slots in order."""
    placed.write.partitionBy("shard").parquet(path)
