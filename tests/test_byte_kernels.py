"""Byte kernels over blocks of values against plain counting, and what the steps built on them send around."""

import subprocess
import sys
import tracemalloc
from collections import Counter
from math import log2
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanstrata.functions import bytes as B
from spanstrata.functions import classify as C
from spanstrata.operators import context, features, windows

VALUES = [None, b"", b"a", b"aab", b"\x00\x00a\x00", bytes(range(256)) * 3, b"ab" * 400, b"\xff" * 1000, b"", b"0123456789abcdef" * 5 + b"x"]


def entropy(v):
    return log2(len(v)) - sum(c * log2(c) for c in Counter(v).values()) / len(v) if v else 0.0


def runs(v):
    out, lo = [(0, 0, 0)], 0
    for i in range(1, len(v) + 1):
        if i == len(v) or v[i] != v[lo]:
            out.append((i - lo, -lo, v[lo]))
            lo = i
    best = max(out)
    return best[0], best[2], max(n for n, _, b in out if not b)


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_kernels_equal_plain_counting(spark, monkeypatch, block):
    """Values shorter and longer than a block."""
    monkeypatch.setattr(B, "BLOCK", block)
    d = F.col("d")
    rows = spark.createDataFrame(list(enumerate(VALUES)), "i int, d binary").coalesce(1).select(
        "i", B.byte_stats(d, counts=True).alias("s"), B.byte_histogram(d).alias("h"), B.byte_runs(d).alias("r"), B.chunk_entropies(d, 100, 50).alias("c"),
        B.top_pair_counts(d).alias("p"), B.duplicate_block_ratio(d).alias("dup"), B.pair_mean(d, B.np.arange(65536.0)).alias("m"),
    ).collect()
    assert len(rows) == len(VALUES)
    for r in rows:
        v = VALUES[r.i] or b""
        count = Counter(v)
        assert r.h == r.s.hist == [count[b] for b in range(256)]
        assert abs(r.s.entropy - entropy(v)) < 1e-12 and r.s.squares == sum(c * c for c in count.values())
        assert (r.s.visible, r.s.zero, r.s.high) == (sum(32 <= b <= 126 for b in v), count[0], sum(b >= 128 for b in v))
        assert (r.s.printable, r.s.unique, r.s.low, r.s.top) == (sum(32 <= b <= 126 or b in (9, 10, 13) for b in v), len(count), min(v, default=0), max(v, default=0))
        assert tuple(r.r) == runs(v)
        assert len(r.c) == len(range(0, len(v) - 99, 50)) and all(abs(x - entropy(v[s : s + 100])) < 1e-12 for x, s in zip(r.c, range(0, len(v), 50), strict=False))
        pairs = [a << 8 | b for a, b in zip(v, v[1:])]
        assert r.p == (sorted(Counter(pairs).values(), reverse=True) + [0] * 4)[:4]
        assert r.m == (pytest.approx(sum(pairs) / len(pairs)) if pairs else None)
        cells = [v[k : k + 16] for k in range(0, len(v) - 15, 16)]
        assert r.dup == (None if VALUES[r.i] is None else (len(cells) - len(set(cells))) / len(cells) if len(v) >= 32 else 0)
    got = {r.bucket: r.n for r in B.pair_totals(spark.createDataFrame([(v,) for v in VALUES], "data binary").coalesce(1)).collect()}
    assert got == Counter(a << 8 | b for v in VALUES if v for a, b in zip(v, v[1:]))


def column(ends, data, valid=None):
    """A binary column, made without pandas."""
    bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(ends), [bits, pa.py_buffer(np.array([0, *ends], np.int32)), pa.py_buffer(data)])


@pytest.mark.parametrize("size", [1 << 10, 1 << 12, 1 << 20])
def test_kernels_need_little_beside_their_batch(monkeypatch, size):
    """Short, usual and long values: what a Python worker of w6 and a14 allocates does not follow the batch."""
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda kernel: kernel)
    for total in (1 << 23, 1 << 24):
        batch = column(range(size, total + 1, size), bytes(range(256)) * (total >> 8))
        for kernel in (B.byte_stats, lambda c: B.chunk_entropies(c, 256, 256)):
            kernel(batch[:1])
            tracemalloc.start()
            out = kernel(batch)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert len(out) == len(batch)
            assert peak < (6 << 20) + 3 * out.nbytes


def test_kernels_do_not_load_pandas():
    """It is some 25 MB in every Python worker."""
    code = """
import sys
sys.path[:0] = sys.argv[1:]
from test_byte_kernels import B, F, column
F.arrow_udf = lambda kind: lambda kernel: kernel
assert "pandas" not in sys.modules
batch = column([3, 3, 1000], bytes(1000), [1, 0, 1])
B.byte_stats(batch, counts=True), B.chunk_entropies(batch, 256, 256), B.top_pair_counts(batch), B.duplicate_blocks(batch), B.byte_histogram.func(batch), B.byte_runs.func(batch)
assert "pandas" not in sys.modules
"""
    here = Path(__file__).resolve().parent
    subprocess.run([sys.executable, "-c", code, str(here), str(here.parent)], check=True)


def test_nulls_do_not_copy_a_batch(monkeypatch):
    batch = column([2, 2, 5], b"aabcd", [1, 0, 1])
    raw, at = B._flat(batch)
    assert raw.ctypes.data == batch.buffers()[2].address and at.tolist() == [0, 2, 2, 5]
    raw, at = B._flat(batch[1:])
    assert raw[at[0] : at[-1]].tobytes() == b"bcd" and np.diff(at).tolist() == [0, 3]
    hidden = column([2, 4, 5], b"aabcd", [1, 0, 1])  # bytes under the null
    raw, at = B._flat(hidden)
    assert raw[at[0] : at[-1]].tobytes() == b"aad" and np.diff(at).tolist() == [2, 0, 1]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_handcrafted_table_counts_bytes_once(spark):
    o = spark.createDataFrame([("c", f"o{i}", f"assets/{i}", i, bytes([i, 65, 66]) * 300) for i in range(5)], "container string, object_id string, object_path string, doc_id int, content binary")
    w = windows.with_stats(windows.byte_windows(o, 512, 256, 64, keep=("container", "object_id", "object_path", "doc_id")))
    w = w.withColumns({"runs": B.byte_runs("data"), "entropy": F.col("stats.entropy"), "printable_ratio": F.col("stats.printable") / F.col("n")})
    t = context.handcrafted_table(w, "doc_id", C.object_type(F.col("object_path"), F.lit(bytearray(b""))), tuple(context.GROUPS))
    assert "ArrowEvalPython" not in plan(t) and t.count() == w.count()


def test_counts_are_not_folded_by_lambdas(spark):
    o = spark.createDataFrame([("c", "o", "x.dex", b"abc" * 50, 1.0)], "container string, object_id string, object_path string, content binary, compression_ratio double")
    v = features.object_vectors(o, features.container_context(o), ["container", "object_id"])
    assert "aggregate(stats" not in plan(v) and "aggregate(hist" not in plan(v) and len(v.first().features) == len(features.OBJECT_NAMES)
    assert "lambdafunction" not in plan(features.container_context(o)) and "regexp_extract_all" not in plan(features.byte_summary(o.withColumnRenamed("content", "data"), ["object_id"]))
