"""Exact top-k where a block meets more queries than one Arrow batch holds."""

import random

from pyspark.sql import functions as F

from spanstrata.llm import topk


def test_queries_of_several_batches(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = topk.top_k(df, F.col("vec_id") % 2 == 0, k=3, block=50).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    whole = {i: [int(1024 * x // 1) for x in v] for i, v in rows}
    score = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b], strict=True))
    want = {q: sorted((-score(q, c), c) for c in whole if c != q)[:3] for q in whole if q % 2 == 0}
    assert {(r.query_id, r["rank"]): (-r.score, r.vec_id) for r in got} == {(q, k + 1): x for q, best in want.items() for k, x in enumerate(best)}
