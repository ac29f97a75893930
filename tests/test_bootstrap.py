"""The bootstrap by ranges of row numbers against its definition."""

import hashlib
import random

import pytest

from spanstrata.operators import bootstrap
from spanstrata.operators import evaluation as E


def test_draws_are_the_documented_ones():
    for lo, hi in ((0, 25), (95, 1012), (9_999_990, 10_000_010)):
        want = [int(hashlib.md5(f"7|12|{i}".encode()).hexdigest()[:13], 16) % 977 for i in range(lo, hi)]
        assert bootstrap.draws(7, 12, lo, hi, 977).tolist() == want


def test_ranges_and_ties_add_up(spark, monkeypatch):
    """Scores that span many ranges, single ones, null truths; two orders on common draws."""
    monkeypatch.setattr(bootstrap, "ROWS", 64)
    monkeypatch.setattr(bootstrap, "DRAWS", 300)
    rng = random.Random(2)
    rows = [(rng.choice([0.5, 0.5, 0.5, rng.random()]), rng.choice([0.25, round(rng.random(), 2), rng.random()]), rng.choice([0, 1, 1, None])) for _ in range(900)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    hits = E.resample_counts(df, ["a", "b", "y"], "a", 4, 7)
    got = bootstrap.drawn_aurocs(df, ["a", "b"], "y", 4, 7)
    for found, score in zip(got, "ab", strict=True):
        want = {r.replicate: r.auroc for r in E.weighted_auroc(hits, ["replicate"], score, "y", "drawn").collect()}
        assert {r.replicate: r.auroc for r in found.collect()} == pytest.approx(want, abs=1e-12) and len(want) == 4


def test_counts_in_pieces_and_wide_ones(spark, monkeypatch):
    """Cells over many pieces and passes, ranges of few cells, and rows drawn too often for half a byte."""
    want = [0] * 1000
    for d in bootstrap.draws(3, 1, 0, 1000, 1000).tolist():
        want[d] += 1
    monkeypatch.setattr(bootstrap, "PIECE", 64)
    monkeypatch.setattr(bootstrap, "COUNTED", 256)
    assert [int(x) for part in bootstrap._counted_rows(3, 1, 1000) for x in part] == want
    monkeypatch.setattr(bootstrap, "draws", lambda seed, replicate, lo, hi, n: bootstrap.np.arange(lo, hi) // 20 % n)
    assert [int(x) for part in bootstrap._counted_rows(3, 1, 1000) for x in part] == [20] * 50 + [0] * 950
    for counts in ([1, 0, 15], [16, 3], [70_000, 0, 1], []):
        assert bootstrap._unpacked(bootstrap._packed(bootstrap.np.array(counts, int)), len(counts)).tolist() == counts


def test_pieces_passes_and_ranges_agree_with_the_definition(spark, monkeypatch):
    for name, value in (("ROWS", 64), ("DRAWS", 300), ("PIECE", 64), ("COUNTED", 256)):
        monkeypatch.setattr(bootstrap, name, value)
    rng = random.Random(5)
    rows = [(rng.choice([0.5, None, rng.random()]), rng.choice([0.25, rng.random()]), rng.choice([0, 1])) for _ in range(700)] + [(0.75, 0.5, 1)] * 200
    df = spark.createDataFrame(rows, "a double, b double, y int")
    hits = E.resample_counts(df, ["a", "b", "y"], "a", 3, 7)
    for found, score in zip(bootstrap.drawn_aurocs(df, ["a", "b"], "y", 3, 7), "ab", strict=True):
        want = {r.replicate: r.auroc for r in E.weighted_auroc(hits, ["replicate"], score, "y", "drawn").collect()}
        assert {r.replicate: r.auroc for r in found.collect()} == pytest.approx(want, abs=1e-12) and len(want) == 3
    assert [f.collect() for f in bootstrap.drawn_aurocs(df.where("y > 1"), ["a", "b"], "y", 3, 7)] == [[], []]


def test_draws_travel_in_a_few_bits(spark):
    """Rows all different: less than half a byte a draw where two bytes were sent, and no more for rows that are equal."""
    rng = random.Random(6)
    rows = list(range(40_000))
    rng.shuffle(rows)
    cells = spark.createDataFrame([(i, j, i, float(i), i % 2) for i, j in enumerate(rows)], "_a long, _b long, _lo long, s double, y int")
    drawn = bootstrap.drawn_cells(cells, "_lo", 7, 5, 40_000)
    assert drawn.selectExpr("sum(length(_many))").first()[0] < 0.4 * 5 * 40_000
    handed = bootstrap.counted_ranges(cells, drawn, "s", "y", "_a", 5, "_b")
    assert handed.selectExpr("sum(length(_many))").first()[0] < 0.4 * 5 * 40_000
    few = cells.where("_lo % 10000 = 0")
    assert bootstrap.drawn_cells(few, "_lo", 7, 5, 40_000).selectExpr("sum(length(_many))").first()[0] < 100 * 5
