"""Ablation at size: no table with a row for each row and model."""

import numpy as np
from pyspark.sql import functions as F

from spanstrata.operators import ablation as AB
from spanstrata.operators import sampling as K


def test_scores_of_all_models_share_a_row(spark, monkeypatch):
    rng, written, plain = np.random.default_rng(3), [], AB.materialize
    rows = [(i, i // 5, int(i % 4 == 0), f"f{i % 3}" if i % 4 == 0 else None, float(rng.normal(i % 4 == 0)), float(rng.normal())) for i in range(240)]
    assigned = K.leave_one_out(spark.createDataFrame(rows, "item long, bag long, y int, family string, a double, b double"), "family", "y", F.col("item") % 3 == 1)

    def spied(df):
        written.append(plain(df))
        return written[-1]

    monkeypatch.setattr(AB, "materialize", spied)
    report = AB.group_ablation(assigned, {"a": ["a"], "b": ["b"]}, "y", {"item": ["item"], "bag": ["bag"]}).collect()
    assert len(report) == 5 * 3 * 2
    assert max(df.count() for df in written if "item" in df.columns) <= len(rows)
