import math

from pyspark.sql import functions as F

from spanstrata.functions import bytes as B
from spanstrata.operators import windows as W


def objects(spark, *contents):
    rows = [("c", f"o{i}", f"p{i}", bytearray(b)) for i, b in enumerate(contents)]
    return spark.createDataFrame(rows, "container string, object_id string, object_path string, content binary")


def test_window_geometry(spark):
    df = objects(spark, b"", b"a", b"b" * 8, b"c" * 9, b"d" * 12)
    got = W.byte_windows(df, 8, 4).select("object_id", "offset_start", "offset_end").collect()
    by = {}
    for r in got:
        by.setdefault(r[0], []).append((r[1], r[2]))
    assert by == {"o1": [(0, 1)], "o2": [(0, 8)], "o3": [(0, 8), (1, 9)], "o4": [(0, 8), (4, 12)]}


def test_index_counts_before_the_size_filter(spark):
    df = objects(spark, b"x" * 3)
    assert W.byte_windows(df, 8, 4, min_size=4).count() == 0
    assert W.byte_windows(objects(spark, b"y" * 9), 8, 4, min_size=4).select("window_id").collect()[1][0] == "o0:r000001"


def test_entropy_of_extremes(spark):
    df = objects(spark, bytes(range(256)), b"\0" * 64)
    got = {r.object_id: (r.entropy, r.printable_ratio) for r in W.scored_windows(df, 512, 256).collect()}
    assert got["o0"] == (8.0, round(98 / 256, 6)) and got["o1"] == (0.0, 0.0)


def test_runs_blocks_bigrams(spark):
    df = objects(spark, b"aab" + b"\0" * 20 + b"cc").select("content")
    r = df.select(B.byte_runs("content").alias("r"), B.bigram_counts(F.col("content")).alias("b")).first()
    assert (r.r.run_len, r.r.run_byte, r.r.zero_run) == (20, 0, 20)
    assert sum(x.n for x in r.b) == 24 and {x.bucket: x.n for x in r.b}[0] == 19
    d = objects(spark, b"0123456789abcdef" * 3, b"short").select(B.duplicate_block_ratio(F.col("content")).alias("d")).collect()
    assert math.isclose(d[0].d, 2 / 3) and d[1].d == 0.0


def test_typed_windows(spark):
    got = W.typed_windows(objects(spark, b"x" * 100, b"y" * 600), 512, 256).orderBy("object_id", "window_index").collect()
    assert [(r.section_type, r.offset_start, r.offset_end, r.n_windows) for r in got] == [
        ("whole_entry", 0, 100, 1), ("window", 0, 512, 2), ("window", 256, 600, 2)]


def test_block_diff(spark):
    rows = [(bytearray(b"aXaaYaaa"), bytearray(b"aaaaaaaa")), (bytearray(b"same"), bytearray(b"same")), (bytearray(b"abcdEF"), bytearray(b"abcd")), (bytearray(b""), bytearray(b"zz"))]
    df = spark.createDataFrame(rows, "a binary, b binary").coalesce(1)
    got = [[(x.start, x.end) for x in r[0]] for r in df.select(B.block_diff(F.col("a"), F.col("b"), 4)).collect()]
    assert got == [[(1, 2), (4, 5)], [], [(4, 6)], []]


def test_repeated_blocks_is_a_kernel(spark):
    """Sorting blocks as strings inside an expression took most of b8's and p7's time."""
    from collections import Counter

    rng = __import__("random").Random(3)
    values = [bytes(rng.choices(b"\x00\x01a", k=n)) for n in [0, 1, 7, 8, 9, 15, 16, 17, 63, 64, 511, 512]] + [b"ab" * 4, b"abcd" * 4, bytes(range(256)) * 2]
    for width in (2, 3, 4):
        df = objects(spark, *values).select("object_id", "content", B.repeated_blocks(F.col("content"), width).alias("r"))
        assert "sort" not in df._jdf.queryExecution().toString().lower()
        for row in df.collect():
            c, n = bytes(row.content), len(row.content) // width
            most = max(Counter(c[i * width : (i + 1) * width] for i in range(n)).values(), default=0)
            assert row.r == (most >= max(4, n // 8)), (width, c)
