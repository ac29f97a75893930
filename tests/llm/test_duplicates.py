"""Near-duplicate documents and vectors, and top-k search, against all pairs in plain Python."""

import math
import random

import numpy as np
import pytest
from brute import components, lower

from spanstrata.llm import minhash, topk, vectordup
from spanstrata.llm.components import connected_components
from spanstrata.llm.hashing import BLOCK, shingle_set, texts_to_words, word_hashes


def shingles(text, k):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", lower(text or "")) if x]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def documents():
    rng = random.Random(1)
    words = ["w%d" % i for i in range(400)]
    out = [(i, " ".join(rng.choices(words, k=rng.randint(1, 120)))) for i in range(120)]
    base = rng.choices(words, k=100)
    for i in range(200, 330):  # a group of near copies, with more and more changes
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(100)] = rng.choice(words)
        out.append((i, " ".join(w)))
    out += [(400 + i, " ".join(base).upper()) for i in range(30)]
    out += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "ONE "), (505, "one two"), (506, "x " * 5000), (507, "x " * 4000), (None, "one"), (508, "É a b c"), (509, "é a b c"), (3, out[3][1])]
    return out


@pytest.mark.parametrize("k,percent,chunk", [(3, 85, 512), (5, 80, 16)])
def test_documents(spark, monkeypatch, k, percent, chunk):
    """Blocks of few nodes give the same components as large ones."""
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rows = documents()
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(sets, links)
    frame = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, node string, kept boolean").repartition(5)
    got = minhash.near_duplicates(frame, k, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept and r.n_shingles == 1
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r


def test_no_documents(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_hashes_do_not_depend_on_blocks():
    rng = random.Random(2)
    text = ("".join(rng.choices("ab \n", k=BLOCK)) + "c" * (BLOCK + 5) + " d " + "e" * 10).encode()
    parts = text.split()
    one = {p: int(next(iter(texts_to_words([p])))[0]) for p in set(parts) if len(p) < BLOCK}
    got = [int(x) for x in word_hashes(text)]
    assert len(got) == len(parts) and all(x == one.get(p, x) for x, p in zip(got, parts))
    assert got[[len(p) > BLOCK for p in parts].index(True)] not in one.values()
    assert [len(x) for x in texts_to_words([b"", b"a b", text[:50], b" "])] == [0, 2, len(text[:50].split()), 0]
    assert len(shingle_set(word_hashes(b"a b c a b c"), 3)) == 3


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (7, None)]
    want = components({x for e in edges if None not in e and e[0] != e[1] for x in e}, [e for e in edges if None not in e])
    got = connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def vectors():
    rng = np.random.default_rng(4)
    out = []
    for i in range(300):
        out.append((i, rng.standard_normal(16).tolist(), i % 3))
    base = rng.standard_normal(16)
    for i in range(300, 420):
        out.append((i, (base + rng.standard_normal(16) * rng.choice([0.05, 0.25, 0.4])).tolist(), i % 2))
    out += [(500 + i, out[7][1], 1) for i in range(40)]
    out += [(600, None, 1), (601, [0.0] * 16, 1), (602, [1.0, None] + [0.0] * 14, 1), (603, [math.inf] + [0.0] * 15, 1), (604, [math.nan] * 16, 1), (605, out[7][1], None), (None, out[7][1], 1), (606, [], 1), (607, [1.0], 1), (608, [2.0], 1)]
    return out


def valid(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_vectors(spark, monkeypatch):
    rows = vectors()
    unit = {}
    for i, v, label in rows:
        if i is not None and valid(v) and any(v) and label is not None:
            x = np.zeros(16)
            x[: len(v)] = v
            unit[i] = (x / np.linalg.norm(x), label)
    links = [(a, b) for a in unit for b in unit if a < b and unit[a][1] == unit[b][1] and unit[a][0] @ unit[b][0] >= 0.93]
    want = components([i for i, _, _ in rows if i is not None], links)
    n = {i: sum(i in e for e in links) for i in want}
    frame = spark.createDataFrame([(i, v, x, 9) for i, v, x in rows], "vec_id long, embedding array<double>, label int, id int").repartition(4)
    for cell, chunk in ((4096, 1024), (20, 16)):
        monkeypatch.setattr(vectordup, "CHUNK", chunk)
        got = vectordup.near_duplicates(frame, 0.93, cell=cell).collect()
        assert len(got) == len(rows)
        found = sum(r.n_links for r in got) / sum(n.values())
        assert found > 0.99
        for r in got:
            assert r.vec_id is None or r.n_links <= n[r.vec_id]
            assert r.vec_id is not None or (r.component_id is None and r.kept)
        if found == 1:
            assert {r.vec_id: r.component_id for r in got if r.vec_id is not None} == want
    assert vectordup.near_duplicates(frame.limit(0)).count() == 0


def test_top_k(spark):
    rows = [(i, v) for i, v, _ in vectors()] + [(0, vectors()[3][1])]
    ints = [(i, np.array([math.floor(1024 * x) for x in v] + [0] * (16 - len(v)))) for i, v in rows if i is not None and valid(v)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    for block in (16384, 50):
        got = {}
        for r in topk.top_k(frame, frame.vec_id % 50 == 0, k=10, block=block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for i, q in ints:
            if i % 50 == 0 and i != 0:
                best = sorted(((-int(q @ v), j) for j, v in ints if j != i))[:10]
                assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert topk.top_k(frame.limit(0), frame.vec_id > 0).count() == 0
    assert topk.top_k(frame.where("vec_id in (0, 1)"), frame.vec_id == 1).count() == 2


@pytest.mark.parametrize("scale", [1.0, 1e4, 4e5, 3e14])
def test_top_k_of_large_components(spark, scale):
    """Sums of impacts far beyond 52 bits, of both signs; at the last scale products leave 64 bits while scores fit."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((500, 16))
    if scale > 1e12:  # large components meet zeros only
        base[:, 1:] *= 1e-13
        base[::50, 0] = 0
    rows = [(i, (v * scale).tolist()) for i, v in enumerate(base)] + [(900, (-base[7] * scale).tolist()), (901, (base[7] * scale).tolist())]
    if scale > 1e12:
        rows[-2:] = []
    ints = {i: [math.floor(1024.0 * x) for x in v] for i, v in rows}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in topk.top_k(frame, frame.vec_id % 50 == 0, k=10, block=200).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [i for i in sorted(ints) if i % 50 == 0]
    for q, found in got.items():
        best = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), j) for j, v in ints.items() if j != q)[:10]
        assert sorted(found) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]


def test_top_k_refuses_what_no_long_holds(spark):
    for v in ([1e17], [4e15]):  # a component, and a product of components
        frame = spark.createDataFrame([(0, v), (1, v)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="too large|does not fit"):
            topk.top_k(frame, frame.vec_id == 0).collect()


def test_top_k_bounds_hold_in_shifted_units():
    """With impacts in units of a power of two every true member stays possible."""
    rng = np.random.default_rng(10)
    vectors = rng.integers(-(1 << 40), 1 << 40, (2000, 8))
    index, ids, allowed = topk.ImpactIndex(vectors), np.arange(2000), np.ones(2000, bool)
    for _ in range(5):
        query = rng.integers(-(1 << 19), 1 << 19, 8)
        rows, score = index.top(query, allowed, ids, 10)
        exact = vectors @ query
        assert score.tolist() == np.sort(exact)[::-1][:10].tolist()
