"""Where known passages occur verbatim inside objects, without a cross join."""

from __future__ import annotations

import hashlib
import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bytes as B
from .automaton import Matcher

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Passages of at most so many bytes in all are sent to every task; more are joined by their blocks or grams.
SENT_BYTES = 32 << 20
ANCHOR = 8
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _number(anchor: bytes) -> int:
    return int.from_bytes(anchor, "little")


class Needles:
    """Finds all places of many needles: a table of their first eight bytes, then the bytes themselves; an automaton for shorter ones."""

    def __init__(self, needles: list[tuple[int, bytes]]):
        short: dict[str, list[int]] = {}
        for k, n in needles:
            if 0 < len(n) < ANCHOR:
                short.setdefault(n.decode("latin-1"), []).append(k)
        self.short = Matcher(short)
        self.by_anchor: dict[int, list[tuple[int, bytes]]] = {}
        for k, n in needles:
            if len(n) >= ANCHOR:
                self.by_anchor.setdefault(_number(n[:ANCHOR]), []).append((k, n))
        self.table = np.zeros(1 << 16, dtype=bool)
        if self.by_anchor:
            self.table[(np.array(list(self.by_anchor), dtype=np.uint64) * _SPREAD) >> np.uint64(48)] = True

    def places(self, data: bytes):
        """``(needle, offset)`` of every occurrence, overlapping ones too."""
        if self.short.needles:
            for numbers, at in self.short.places(data.decode("latin-1")):  # a character for each byte
                yield from ((k, at) for k in numbers)
        if len(data) < ANCHOR or not self.by_anchor:
            return
        one = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
        two = one[:-1] | (one[1:] << np.uint64(8))
        four = two[:-2] | (two[2:] << np.uint64(16))
        eight = four[:-4] | (four[4:] << np.uint64(32))
        for at in np.flatnonzero(self.table[(eight * _SPREAD) >> np.uint64(48)]).tolist():
            for k, n in self.by_anchor.get(int(eight[at]), ()):
                if data.startswith(n, at):
                    yield k, at


def locate_passages(objects: DataFrame, passages: DataFrame, block: int = 16) -> DataFrame:
    """Every byte interval at which a passage stands in an object.

    objects: container, object_id, object_path, content BINARY.
    passages: item_id, needle BINARY; null and empty needles stand nowhere.

    Passages of at most SENT_BYTES bytes in all (that is checked) go to every task, which
    looks for all of them while it reads an object: no byte of an object is shuffled.  Beyond
    that size those of ``2 * block - 1`` bytes or more are joined by aligned blocks.  The shorter
    ones are sent if they alone keep to the bound, else they are joined too: by smaller blocks,
    those of a few bytes by all grams of their length.  Passages without item_id are left out.
    """
    known = passages.where("length(needle) > 0 and item_id is not null").select("item_id", "needle")
    size, n, widths = F.length("needle"), F.lit(0), [block >> i for i in range(block.bit_length()) if block >> i >= 4]
    for width in sorted(widths):
        n = F.when(size >= 2 * width - 1, width).otherwise(n)
    known = known.withColumns({"_width": n, "_gram": F.when(n == 0, size)})
    sizes = {(r["_width"], r["_gram"]): r["b"] for r in known.groupBy("_width", "_gram").agg(F.sum(size + 16).alias("b")).collect()}

    def sent(some):
        rows = [(r["item_id"], bytes(r["needle"])) for r in some.collect()]  # SENT_BYTES at most
        return _by_scan(objects, Needles([(i, needle) for i, (_, needle) in enumerate(rows)]), [(i, len(needle), hashlib.sha256(needle).hexdigest()) for i, needle in rows])

    if sum(sizes.values()) <= SENT_BYTES:
        return sent(known)
    short = sum(b for (width, _), b in sizes.items() if width < block)
    parts = [sent(known.where(F.col("_width") < block))] if 0 < short <= SENT_BYTES else []
    for width, gram in sorted(sizes, key=str):
        own = known.where((F.col("_width") == width) & F.col("_gram").eqNullSafe(F.lit(gram))).select("item_id", "needle")
        if width == block or short > SENT_BYTES:
            parts.append(_by_blocks(objects, own, width) if width else _by_grams(objects, own, gram))
    return reduce(DataFrame.unionByName, parts)


def _by_scan(objects: DataFrame, needles: Needles, items: list[tuple[int, int, str]]) -> DataFrame:
    keys = ["container", "object_id", "object_path"]

    def run(batches):
        for batch in batches:
            rows, item, start = [], [], []
            for i, content in enumerate(batch.column("content")):
                for k, at in needles.places(content.as_buffer().to_pybytes() if content.is_valid else b""):
                    rows.append(i), item.append(k), start.append(at)
            part = batch.select(keys).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([items[k][0] for k in item], pa.int64()), pa.array(start, pa.int64()), pa.array([s + items[k][1] for s, k in zip(start, item)], pa.int64()), pa.array([items[k][2] for k in item], pa.string())],
                names=[*keys, "item_id", "offset_start", "offset_end", "payload_sha256"],
            )

    return objects.select(*keys, "content").mapInArrow(run, "container string, object_id string, object_path string, item_id long, offset_start long, offset_end long, payload_sha256 string")


def _by_blocks(objects: DataFrame, passages: DataFrame, block: int) -> DataFrame:
    """Any occurrence of a passage of ``2 * block - 1`` bytes covers one whole aligned block of the
    object; the blocks are joined by value with those at the passage's first offsets and verified."""
    keys = ["container", "object_id", "object_path"]
    cells = objects.select(*keys, F.posexplode(B.blocks(F.col("content"), block)).alias("_b", "_block"))
    anchors = (
        passages.select("item_id", B.latin1(F.col("needle")).alias("_t"))
        .select("item_id", "_t", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("_o"))
        .select("item_id", "_o", F.substring(F.col("_t"), F.col("_o") + 1, F.lit(block)).alias("_block"))
    )
    candidates = cells.join(anchors, "_block").select(*keys, "item_id", (F.col("_b") * block - F.col("_o")).alias("_x")).where(F.col("_x") >= 0).distinct()
    checked = (
        candidates.join(objects.select("container", "object_id", "content"), ["container", "object_id"])
        .join(passages, "item_id")
        .where(F.substring(F.col("content"), F.col("_x") + 1, F.length("needle")) == F.col("needle"))
    )
    start = F.col("_x").cast("long")
    return checked.select(*keys, "item_id", start.alias("offset_start"), (start + F.length("needle")).alias("offset_end"), F.sha2("needle", 256).alias("payload_sha256"))


def _by_grams(objects: DataFrame, passages: DataFrame, size: int) -> DataFrame:
    """Passages of ``size`` bytes, a few, joined by value with the bytes at every offset."""
    keys = ["container", "object_id", "object_path"]
    at = objects.where(F.length("content") >= size).select(*keys, "content", F.explode(F.sequence(F.lit(0), F.length("content") - size)).alias("_x"))
    found = at.select(*keys, F.col("_x").cast("long").alias("offset_start"), F.substring("content", F.col("_x") + 1, F.lit(size)).alias("needle")).join(passages, "needle")
    return found.select(*keys, "item_id", "offset_start", (F.col("offset_start") + size).alias("offset_end"), F.sha2("needle", 256).alias("payload_sha256"))
