import random

from spanstrata.operators import intervals as I
from spanstrata.operators import labels as L


def spans(spark, rows):
    return spark.createDataFrame(rows, "k string, start long, end long")


def test_touching_merge_and_empty_dropped(spark):
    df = spans(spark, [("a", 0, 5), ("a", 5, 7), ("a", 9, 9), ("a", 10, 12), ("b", 3, 4)])
    for width in (None, 4):
        got = sorted(map(tuple, I.merge_intervals(df, ["k"], bucket_width=width).collect()))
        assert got == [("a", 0, 7), ("a", 10, 12), ("b", 3, 4)]


def test_join_and_union_against_brute_force(spark):
    rng = random.Random(3)
    make = lambda: [(rng.choice("ab"), s, s + rng.randint(0, 40)) for s in (rng.randint(0, 200) for _ in range(60))]
    left, right = make(), make()
    a = spans(spark, left)
    b = spans(spark, right).toDF("k", "s2", "e2")
    got = sorted(map(tuple, I.interval_join(a, b, ["k"], ("start", "end"), ("s2", "e2"), 16).select("k", "start", "end", "s2", "e2").collect()))
    want = sorted((k, s, e, s2, e2) for k, s, e in left for k2, s2, e2 in right if k == k2 and s < e2 and s2 < e and e > s and e2 > s2)
    assert got == want
    lengths = {r.k: r.union_length for r in I.union_length(a, ["k"], bucket_width=32).collect()}
    for k in "ab":
        assert lengths[k] == len({p for kk, s, e in left if kk == k for p in range(s, e)})


def test_boundary_error_without_prediction(spark):
    t = spans(spark, [("a", 10, 30)])
    got = I.set_overlap(t, spans(spark, [("z", 0, 1)]).where("k = 'a'"), ["k"]).first()
    assert (got.truth_len, got.pred_len, got.inter_len) == (20, 0, 0)


def test_labels(spark):
    w = spark.createDataFrame(
        [("c", "o", "p", f"w{i}", i * 50, i * 50 + 100) for i in range(3)] + [("c", "o2", "q", "x0", 0, 100)],
        "container string, object_id string, object_path string, window_id string, offset_start long, offset_end long",
    )
    pay = spark.createDataFrame(
        [("c", "p", 90, 110, "f1", "h1"), ("c", "p", 95, 120, "f2", "h2"), ("c", "p", 60, 60, "f3", "h3"), ("d", "r", 0, 9, "f4", "h4")],
        "container string, object_path string, offset_start long, offset_end long, transform_family string, payload_sha256 string",
    )
    got = {r.window_id: r for r in L.label_windows(w, pay, 20, 0.0).collect()}
    assert got["w0"].overlap_bytes == 10 and got["w0"].label_id == 0 and got["w0"].max_iou == round(10 / 110, 6)
    assert got["w1"].overlap_bytes == 30 and got["w1"].transform_families == ["f1", "f2"]
    assert got["x0"].max_iou == 0.0 and got["x0"].label == "benign"
    objects = L.label_objects(L.label_windows(w, pay, 20), pay)
    containers = {r.container: r for r in L.label_containers(objects, pay).collect()}
    assert containers["d"].label_id == 1 and containers["d"].window_count == 0
    assert containers["c"].payload_count == 2


def test_passages_beyond_the_bound(spark, monkeypatch):
    """However the passages are dealt to sending, blocks and grams, all places are found, and no more than the bound is collected."""
    import hashlib
    import random

    from spanstrata.operators import passages as P

    rng = random.Random(3)
    bodies = [bytes(rng.choices(b"ab\x00\xff", k=n)) for n in (0, 2, 40, 700, 900)]
    needles = [(n, bytes(bodies[4][n * 3 : n * 3 + n])) for n in (1, 2, 3, 6, 7, 14, 15, 30, 31, 60)] + [(7, bodies[3][5:12]), (60, bodies[3][100:103]), (9, b""), (8, None)]
    objects = spark.createDataFrame([("c", str(i), f"p{i}", b) for i, b in enumerate(bodies)], "container string, object_id string, object_path string, content binary")
    frame = spark.createDataFrame(needles, "item_id long, needle binary")
    want = sorted(
        (str(o), i, x, x + len(n), hashlib.sha256(n).hexdigest()) for o, b in enumerate(bodies) for i, n in needles if n for x in range(len(b) - len(n) + 1) if b.startswith(n, x)
    )
    total, short = sum(len(n) + 16 for _, n in needles if n), sum(len(n) + 16 for _, n in needles if n and len(n) < 31)
    taken = []
    real = P.Needles
    monkeypatch.setattr(P, "Needles", lambda own: taken.append(sum(len(n) + 16 for _, n in own)) or real(own))
    for bound in (total, short, 0):
        monkeypatch.setattr(P, "SENT_BYTES", bound)
        got = sorted((r.object_id, r.item_id, r.offset_start, r.offset_end, r.payload_sha256) for r in P.locate_passages(objects, frame).collect())
        assert got == want and all(t <= bound for t in taken)
        taken.clear()
