"""Containment joins by automata, and exact quantiles, against plain Python and Spark's own percentile."""

import itertools
import random

from pyspark.sql import functions as F

from spanstrata.operators import evaluation
from spanstrata.operators.automaton import Matcher, contains_join
from spanstrata.operators.passages import Needles


def test_matcher_finds_overlaps():
    m = Matcher({"a": 1, "aa": 2, "aba": 3, "é": 4})
    assert dict(m.found("xaabaé")) == {"a": 1, "aa": 2, "aba": 3, "é": 4} and dict(m.found("")) == {}
    assert sorted(m.places("aaba")) == [(1, 0), (1, 1), (1, 3), (2, 0), (3, 1)]
    data = b"\x00\xff\xffab\x00ab"
    needles = [b"\xff", b"\xff\xff", b"ab", b"ab", b"\x00", b"", b"absent!", b"12345678"]
    want = [(k, i) for k, n in enumerate(needles) for i in range(len(data)) if n and data.startswith(n, i)]
    assert sorted(Needles(list(enumerate(needles))).places(data)) == want


def test_many_short_needles(spark):
    """10,000 needles of one to three letters, the commonest in nearly every text; several automata give the same."""
    rng = random.Random(3)
    words = ["".join(w) for n in (1, 2, 3) for w in itertools.product("abcdefghijklmnopqrstuvw", repeat=n)][:10_000]
    texts = ["".join(rng.choices("abcdefghijkz", k=rng.randint(0, 30))) for _ in range(400)]
    n = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(-1, None), (-2, ""), (-3, "a")], "id int, w string").repartition(3)
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(900, None)], "t int, x string").repartition(8)
    want = sorted((i, j) for j, x in enumerate(texts) for i, w in [*enumerate(words), (-3, "a")] if w in x)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    for part_bytes in (1 << 22, 100_000):
        found = contains_join(n, t, "w", "x", part_bytes=part_bytes)
        assert sorted((r.id, r.t) for r in found.collect()) == want
    sizes = [r["count"] for r in contains_join(n, t, "w", "x").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * min(sizes)  # hits stay where the texts are
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert contains_join(n.limit(0), t, "w", "x").count() == contains_join(n, t.limit(0), "w", "x").count() == 0


def test_keys_must_be_equal(spark):
    n = spark.createDataFrame([("p", 1, "a"), ("q", 2, "a"), (None, 3, "a"), ("p", 4, "bc")], "k string, id int, w string")
    t = spark.createDataFrame([("p", 10, "xa"), ("q", 11, "bca"), (None, 12, "a"), ("p", 13, "abcabc")], "k string, t int, x string")
    assert sorted((r.k, r.id, r.t) for r in contains_join(n, t, "w", "x", ["k"]).collect()) == [("p", 1, 10), ("p", 1, 13), ("p", 4, 13), ("q", 2, 11)]


def test_quantiles_equal_percentile(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.random(), float(rng.randrange(5)), None])) for _ in range(3000)] + [("one", 2.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"lo": 0.0, "q": 0.3, "half": 0.5, "most": 0.975, "hi": 1.0}
    for keys in (["g"], []):
        want = {r[: len(keys)]: r[len(keys) :] for r in df.groupBy(*keys).agg(*[F.percentile("v", s) for s in shares.values()]).collect()}
        got = {r[: len(keys)]: r[len(keys) :] for r in evaluation.quantiles(df, "v", shares, keys).collect()}
        assert got.keys() == want.keys()
        for k, q in want.items():
            assert all(a == b or abs(a - b) < 1e-12 for a, b in zip(got[k], q, strict=True)), k


def test_quantiles_of_a_million_values(spark):
    df = spark.range(1_000_001).select((F.col("id") * 3).alias("v"))
    assert evaluation.quantiles(df, "v", {"half": 0.5, "q": 0.9}).first()[:] == (1_500_000.0, 2_700_000.0)
