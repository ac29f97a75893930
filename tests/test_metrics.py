import random

import pytest
from pyspark.sql import functions as F

from spanstrata.operators import evaluation as E
from spanstrata.operators import metrics as M



def S():
    return F.col("s")


def Y():
    return F.col("y")



def items(spark, rows):
    return spark.createDataFrame(rows, "g string, y int, s double")


def test_textbook_auroc(spark):
    df = items(spark, [("a", 0, 0.1), ("a", 0, 0.4), ("a", 1, 0.35), ("a", 1, 0.8)])
    r = M.ranking_quality(df, S(), Y()).first()
    assert r.auroc == 0.75 and r.auprc == round((1 + 2 / 3) / 2, 6)


@pytest.mark.parametrize("rows,auroc", [([("a", 1, 0.5)], None), ([("a", 1, 0.5), ("a", 0, 0.5)], 0.5), ([("a", 1, 0.1), ("a", 0, 0.9)], 0.0)])
def test_edge_cases(spark, rows, auroc):
    assert M.ranking_quality(items(spark, rows), S(), Y()).first().auroc == auroc


def test_pairwise_form_on_random_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randint(0, 1), round(rng.random(), 1)) for _ in range(200)]
    got = {r.g: r.auroc for r in M.ranking_quality(items(spark, rows), S(), Y(), ["g"]).collect()}
    for g in "ab":
        p = [s for k, y, s in rows if k == g and y]
        n = [s for k, y, s in rows if k == g and not y]
        assert got[g] == round(sum((a > b) + 0.5 * (a == b) for a in p for b in n) / len(p) / len(n), 6)


def test_ranking_favours_positive_on_ties(spark):
    df = items(spark, [("a", 0, 0.9), ("a", 1, 0.9), ("b", 0, 0.9), ("b", 1, 0.1), ("c", 0, 0.5)])
    r = M.ranking_report(df, ["g"], S(), Y()).first()
    assert (r.group_count, r.evaluated_group_count, r.mrr, r.top_1_hit, r.top_3_hit) == (3, 2, 0.75, 0.5, 1.0)


def test_calibration_edges(spark):
    df = items(spark, [("a", 1, 1.0), ("a", 0, 0.1), ("a", 1, 1.5)])
    bins = {r.bin: r["count"] for r in M.calibration_bins(df, S(), Y()).collect()}
    assert bins[9] == 1 and bins[1] == 1 and bins[0] == 0 and sum(bins.values()) == 2


def test_normalisation_without_reference_passes_through(spark):
    df = items(spark, [("a", 1, 0.3)])
    assert E.normalize_by_reference(df, "s", Y() == 0).first().normalized == 0.3


def test_bootstrap_methods_agree(spark):
    rng = random.Random(5)
    rows = [("a", y, round(rng.random() * 0.6 + 0.4 * y, 2)) for y in (rng.randint(0, 1) for _ in range(150))]
    df = items(spark, rows)
    a = E.bootstrap_ci(df, "s", "y", 20).first()
    b = E.bootstrap_ci(df, "s", "y", 20, method="poisson").first()
    assert a.n == b.n == 20 and abs(a["mean"] - b["mean"]) < 0.05
