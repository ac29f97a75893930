import pytest
from pyspark.sql import functions as F

from spanstrata.operators import decide as V
from spanstrata.operators import diff as D
from spanstrata.operators import ordering as O
from spanstrata.operators import rules as R
from spanstrata.operators import sampling as K


def test_split_validation(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",)], "g string")
    got = {r.g: r.partition for r in K.group_split(df, "g", {"train": ["a"], "test": ["b"]}).collect()}
    assert got == {"a": "train", "b": "test", "z": "unassigned"}
    with pytest.raises(ValueError):
        K.group_split(df, "g", {"train": ["a"], "test": ["a"]})
    with pytest.raises(ValueError):
        K.group_split(df, "g", {"train": []})


def test_positions_equal_row_number(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1009).alias("v"))
    got = O.positions(df, ["k"], [F.col("v")], O.range_bucket(df, F.col("v"), 16)).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r.v, r.pos))
    for rows in by.values():
        assert [p for _, p in sorted(rows)] == list(range(1, 101))


def test_samples_smaller_than_target_keep_everything(spark):
    df = spark.createDataFrame([(i, "g", i % 2) for i in range(10)], "id int, g string, y int")
    assert K.stratified_sample(df, 50, 2, "g", "y", "id").count() == 10
    assert K.stratified_sample(df, 6, 2, "g", "y", "id").count() == 6


def test_snapshot_branches(spark):
    def side(items):
        rows = [(1, n, len(b), __import__("hashlib").sha256(b).hexdigest(), bytearray(b)) for n, b in items.items()]
        return spark.createDataFrame(rows, "pair_id int, name string, size int, sha256 string, content binary")

    old = side({"a": b"same", "b": b"12345678", "c": b"moved", "d": b"gone"})
    new = side({"a": b"same", "b": b"12X45678tail", "c2": b"moved", "e": b"fresh"})
    m = D.changed_ranges(D.snapshot_members(old, new), old, new, 4)
    got = {(r.branch, r.new_name, r.old_name): [(x.start, x.end) for x in r.diff_ranges] for r in m.collect()}
    assert got == {
        ("unchanged", "a", "a"): [], ("byte_modified", "b", "b"): [(2, 3), (8, 12)], ("renamed", "c2", "c"): [],
        ("new_in_packed", "e", None): [(0, 5)], ("removed", None, "d"): [],
    }
    s = D.diff_summary(m).first()
    assert s.changed_bytes == 10 and not s.alignment_failed and not s.degenerate


def test_rules_all_and_first(spark):
    df = spark.createDataFrame([("classes.dex", 100), ("x", 5)], "object_path string, size int")
    rules = [R.Rule("r1", "dex$"), R.Rule("r2", "^classes", offset_end=-10)]
    got = {(r.rule_id, r.offset_end) for r in R.match_all_rules(df, rules).collect()}
    assert got == {("r1", 100), ("r2", 90)}
    cls = [r[0] for r in df.select(R.first_rule(F.col("object_path"), [("^c", "one"), ("dex", "two")])).collect()]
    assert cls == ["one", "unknown"]


def test_reconciliation_matrix(spark):
    rows = [(1, True, False, 1, 1, 1.0), (2, False, True, 1, 1, 1.0), (3, False, False, 0, 0, None), (4, False, False, 0, 2, None),
            (5, False, False, 1, 1, 0.95), (6, False, False, 1, 1, 0.6), (7, False, False, 1, 1, 0.1)]
    df = spark.createDataFrame(rows, "pair int, alignment_failed boolean, degenerate boolean, n_rule int, n_diff int, iou double")
    got = [(r.decision, r.label_source, r.needs_manual_review) for r in V.reconcile(df).orderBy("pair").collect()]
    assert got == [
        ("rule_only_alignment_failed", "rules", True), ("rule_only_degenerate", "rules", True), ("no_signal", "none", True),
        ("path_b_only_no_rule_match", "diff", True), ("solid", "diff", False), ("partial_mismatch", "diff", True), ("low_confidence", "none", True),
    ]


def test_greedy_matches_and_mapping(spark):
    """Members whose best partner is taken get the next one, as in a plain greedy loop; J5 scores renamed members against their partners."""
    import math
    import random

    from spanstrata.operators import diff

    rng = random.Random(4)

    def members(tag):
        return [(p, f"{tag}{i}", bytes(rng.choices(b"abc\x00", weights=[1 + rng.randrange(3) for _ in range(4)], k=rng.randrange(100, 300)))) for p in ("p", "q") for i in range(12)]

    sides = {"n": members("n"), "o": members("o")}
    sides["n"].append(("p", "moved", sides["o"][0][2]))

    def frame(rows):
        df = spark.createDataFrame([(*r, len(r[2])) for r in rows], "pair_id string, name string, content binary, size long")
        return diff.with_profile(df.withColumn("sha256", F.sha2("content", 256))).cache()

    new, old = frame(sides["n"]), frame(sides["o"])

    def score(a, b):
        l1 = sum(abs(a.count(c) / len(a) - b.count(c) / len(b)) for c in range(256))
        return round(abs(math.log2(len(a)) - math.log2(len(b))) + 2 * l1, 6)

    def greedy(news):
        pairs = sorted((score(a, b), p, n, o) for p, n, a in news for q, o, b in sides["o"] if p == q and score(a, b) < 2.0)
        taken, out = set(), set()
        for _, p, n, o in pairs:
            if not {(p, n), (p, o)} & taken:
                taken |= {(p, n), (p, o)}
                out.add((p, n, o))
        return out

    got = {(r.pair_id, r.new_name, r.old_name) for r in diff.greedy_matches(new, old).collect()}
    assert got == greedy(sides["n"]) and len(got) > diff.fuzzy_matches(new, old).count()
    mapping = diff.member_mapping(new, old)
    assert ("p", "moved", "o0") in {(r.pair_id, r.new_name, r.old_name) for r in mapping.collect()}
    status = {(r.pair_id, r.name): (r.status, r.diff_score) for r in diff.diff_magnitude(new, old, mapping).collect()}
    assert status["p", "moved"] == ("unchanged", 0.0) and len(status) == len(sides["n"])
    assert sum(s == "modified" for s, _ in status.values()) == mapping.count() - 1
