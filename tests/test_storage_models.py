"""Writers, archives, upserts and models in one session; balanced buckets; lossless tokens."""

import io
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_archives_entry import make_zip

import __spark_entry__ as entry
from spanstrata.functions import tokens as K
from spanstrata.operators import ml as ML
from spanstrata.operators.ordering import positions, range_bucket, work_path
from spanstrata.sources import archives as A
from spanstrata.sources import jsonl as J
from spanstrata.streaming import incremental as I


def test_models_after_writers(spark):
    """A writer's counters in the session must not reach the tasks that score."""
    sf = "/root/testdata/sf0.001"
    queries = entry.queries()
    assert queries["s1_jsonl_round_trip"](spark, sf).count() > 0
    assert sum(r.written for r in queries["s2_write_count"](spark, sf).collect()) == queries["s2_write_count"](spark, sf).first().reported
    rows = [(i, bytearray((b"abc" if i % 2 else b"xyz") * 20), i % 2, i % 3) for i in range(60)]
    windows = spark.createDataFrame(rows, "id long, data binary, label int, fold int")
    scores = ML.out_of_fold_ngram_scores(windows, "label", "fold", range(3), buckets=1 << 10).collect()
    assert len(scores) == 60 and all((r.score > 0.5) == (r.label == 1) for r in scores)
    assert queries["m4_ablation_grid"](spark, sf).count() == 3


def test_append_count(spark):
    path = work_path(spark, "rows")
    assert J.write_jsonl(spark.range(5), path, "append") == 5
    assert J.write_jsonl(spark.range(7), path, "append") == 7


def test_tolerant_reader_hides_missing_paths_only(spark):
    schema = T.StructType.fromDDL("a BIGINT")
    assert J.read_tolerant(spark, work_path(spark, "absent"), schema).count() == 0
    with pytest.raises(Exception):
        J.read_tolerant(spark, "nosuchscheme://x/y", schema).count()


def test_upsert_repeats_and_restarts(spark):
    root, src, ck = work_path(spark, "table"), work_path(spark, "in"), work_path(spark, "ck")
    schema = T.StructType.fromDDL("k BIGINT, at BIGINT, label STRING")

    def feed(rows, checkpoint=ck):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        I.upsert_labels(I.new_files(spark, src, schema), root, ["k"], ["label"], ["at"], checkpoint).awaitTermination()

    def table():
        return sorted(tuple(r) for r in I.current_table(spark, root, schema).collect())

    assert I.current_table(spark, root, schema) is None
    feed([(1, 1, "a"), (1, 2, "b"), (2, 1, "x")])
    assert table() == [(1, 2, "b"), (2, 1, "x")]
    feed([(1, 3, None), (3, 1, None)])
    assert table() == [(1, 3, "b"), (2, 1, "x"), (3, 1, None)]
    assert I.versions(spark, root) == [0, 1]
    # a batch whose commit was lost runs again and gives the same table
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = jvm.Path(f"{ck}/commits/1")
    assert path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)
    I.upsert_labels(I.new_files(spark, src, schema), root, ["k"], ["label"], ["at"], ck).awaitTermination()
    assert table() == [(1, 3, "b"), (2, 1, "x"), (3, 1, None)] and I.versions(spark, root) == [0, 1]


def test_archive_errors_stay_with_their_member(spark):
    good = make_zip([("a.txt", b"hello" * 40), ("lib/x.so", b"native" * 9), ("assets/a.zip", b"no code")])
    broken = bytearray(good)
    at = broken.find(b"hello")
    broken[at] ^= 0xFF
    locked = bytearray(good)
    for mark, shift in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.find(mark) + shift] |= 1  # says that the first member is encrypted
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    rows = [("ok", bytearray(good)), ("crc", broken), ("locked", locked), ("empty", bytearray(empty.getvalue())), ("bad", bytearray(b"x"))]
    df = spark.createDataFrame([(k, k + ".zip", v) for k, v in rows], "container string, container_path string, archive binary")
    members, errors = A.explode_members(df)
    got = {(r.container, r.object_path) for r in members.collect()}
    assert {p for c, p in got if c == "ok"} == {"a.txt", "lib/x.so", "assets/a.zip"}
    for c in ("crc", "locked"):
        assert {p for k, p in got if k == c} == {"lib/x.so", "assets/a.zip"}
    assert {(r.container, r.object_path) for r in errors.collect()} == {("crc", "a.txt"), ("locked", "a.txt"), ("bad", "")}
    flags = {r.container: (r.has_native, r.has_nested_code) for r in A.probe_members(df).collect()}
    assert flags == {"ok": (True, False), "crc": (True, False), "locked": (True, False), "empty": (False, False), "bad": (None, None)}


def test_buckets_follow_the_distribution(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") == 7, 1e12).otherwise(F.col("id").cast("double")).alias("v"), F.lit(1).alias("g"))
    sizes = [r["count"] for r in rows.groupBy(range_bucket(rows, F.col("v"), 16).alias("b")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 20_000 / 16
    one = rows.withColumn("v", F.when(F.col("v") < 18_000, 5.0).otherwise(F.col("v")))
    sizes = sorted(r["count"] for r in one.groupBy(range_bucket(one, F.col("v"), 64).alias("b")).count().collect())
    assert sizes[-2] < 1_000  # all but the one value that is nine tenths of the rows
    placed = positions(rows, ["g"], [F.col("v")], range_bucket(rows, F.col("v"), 16))
    assert placed.where("pos = 20000").first().v == 1e12 and placed.agg(F.count_distinct("pos")).first()[0] == 20_000


def test_tokens_lose_no_byte(spark):
    for n in (0, 1, 126, 127, 252, 253, 1000):
        data = bytes(i % 256 for i in range(n))
        rows = spark.createDataFrame([(bytearray(data),)], "d binary").select(F.inline(K.token_sequences(F.col("d"), 128))).orderBy("seq_index").collect()
        back = bytes(t - K.BYTE_OFFSET for r in rows for t in r.input_ids if t >= K.BYTE_OFFSET)
        assert back == data and all(len(r.input_ids) == 128 and sum(r.attention_mask) == r.length for r in rows)
        assert [r.continued for r in rows] == [True] * (len(rows) - 1) + [False]


def test_ngram_features_are_those_of_hashing_tf(spark):
    from pyspark.ml.feature import HashingTF

    rows = [(0, bytearray(range(256))), (1, bytearray(b"abab  \x00\x00\xff")), (2, bytearray(b"x"))]
    df = spark.createDataFrame(rows, "i int, data binary")
    want = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=64).transform(ML.with_ngrams(df))
    got = ML.with_ngram_features(df, 64)
    assert {r.i: r._tf for r in got.collect()} == {r.i: r._tf for r in want.collect()}
