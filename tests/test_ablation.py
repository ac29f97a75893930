"""Feature-group ablation: weights against a plain Newton fit, roles of rows, levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanstrata.operators import ablation as AB
from spanstrata.operators import sampling as K

GROUPS = {"near": ["a", "b"], "far": ["c"]}


def rows_of(n=600, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        family = f"f{rng.integers(3)}" if y else None
        a, b, c = rng.normal(y * 1.5), rng.normal(5.0) * 1000, rng.normal(0.2 * y) / 50
        out.append((i, i // 10, y, family, float(a), None if i % 37 == 0 else float(b), float("nan") if i % 41 == 0 else float(c), i % 7 == 0, 3))
    return out


SCHEMA = "item long, bag long, y int, family string, a double, b double, c double, spare boolean, features int"


def plain(rows, held_out, columns):
    """Newton steps for one fold and one set of columns; returns a scoring function."""
    train = [r for r in rows if (r[2] == 1 and r[3] != held_out) or (r[2] == 0 and not r[7])]
    x = np.array([[np.nan if r[4 + c] is None else r[4 + c] for c in columns] for r in train])
    y = np.array([r[2] for r in train], dtype=float)
    mean, sd = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    z = np.column_stack([np.ones(len(x)), np.nan_to_num((x - mean) / sd)])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    w, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [1.0] * len(columns))
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge, z.T @ (weight * (p - y)) + ridge @ w)
    return lambda v: 1 / (1 + np.exp(-(w[0] + np.nan_to_num((v[columns] - mean) / sd) @ w[1:])))


def test_scores_equal_single_fits(spark):
    rows = rows_of()
    assigned = K.leave_one_out(spark.createDataFrame(rows, SCHEMA).repartition(5), "family", "y", F.col("spare")).drop("features")
    sets = AB.group_sets(GROUPS)
    assert list(sets) == ["all", "only_near", "only_far", "without_near", "without_far"] and sets["without_near"] == ["c"]
    got = AB.held_out_scores(assigned, AB.fit_sets(assigned, sets, "y"), sets, ["item", "y"]).collect()
    scores = {(r.features, r.held_out, r.item): r.score for r in got}
    assert len(scores) == len(got)
    want = {}
    for name, cols in sets.items():
        places = np.array(["abc".index(c) for c in sorted(cols)])
        for f in ("f0", "f1", "f2"):
            score = plain(rows, f, places)
            for r in rows:
                if (r[2] == 1 and r[3] == f) or (r[2] == 0 and r[7]):
                    want[name, f, r[0]] = score(np.array([np.nan if v is None else v for v in r[4:7]]))
    assert scores.keys() == want.keys()
    assert max(abs(scores[k] - want[k]) for k in want) < 1e-6


def test_report(spark):
    rows = rows_of()
    assigned = K.leave_one_out(spark.createDataFrame(rows, SCHEMA), "family", "y", F.col("spare")).drop("features")
    report = AB.group_ablation(assigned, GROUPS, "y", {"item": ["item"], "bag": ["bag"]}).collect()
    assert len(report) == 5 * 3 * 2
    by = {(r.features, r.held_out, r.level): r for r in report}
    for f in ("f0", "f1", "f2"):
        test = [r for r in rows if (r[2] == 1 and r[3] == f) or (r[2] == 0 and r[7])]
        assert by["all", f, "item"].support == len(test) and by["all", f, "item"].positives == sum(r[2] for r in test)
        assert by["all", f, "bag"].support == len({r[1] for r in test})
        assert by["only_near", f, "item"].auroc > 0.8 > by["only_far", f, "item"].auroc


def test_edges(spark):
    frame = spark.createDataFrame(rows_of(60), SCHEMA).drop("features")
    empty = K.leave_one_out(frame.limit(0), "family", "y", F.col("spare"))
    assert AB.group_ablation(empty, GROUPS, "y", {"item": ["item"]}).count() == 0
    alone = K.leave_one_out(frame.where("y = 1"), "family", "y")
    with pytest.raises(ValueError, match="both classes"):
        AB.fit_sets(alone, AB.group_sets(GROUPS), "y")
    flat = K.leave_one_out(frame.withColumn("c", F.lit(4.0)), "family", "y", F.col("spare"))  # a column without spread
    assert AB.held_out_scores(flat, AB.fit_sets(flat, {"flat": ["c"]}, "y"), {"flat": ["c"]}, ["item"]).where("abs(score - 0.5) > 1e-9").count() == 0
