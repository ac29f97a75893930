"""Merkle manifest, ranked search and sharding against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import sha

from spanstrata.llm import balltree, histogramsort, merkle
from spanstrata.llm.midstates import PADDING, START, Subtree, compress, from_bytes, hex_block, to_bytes


def test_states_resume_sha256():
    raw = [bytes([i]) * 32 for i in range(5)]
    state = compress(START, hex_block(from_bytes(raw[0])))
    both = compress(compress(state, hex_block(from_bytes(raw[1]))), PADDING[2])
    assert to_bytes(both).hex() == sha(raw[0].hex() + raw[1].hex())


def tree(nodes, levels=None):
    done = 0
    while len(nodes) > 1 if levels is None else done < levels:
        nodes, done = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], done + 1
    return nodes[0]


@pytest.mark.parametrize("n,levels", [(1, None), (2, None), (3, None), (10, None), (28, None), (1, 3), (7, 2), (10, 4)])
def test_subtree(n, levels):
    raw = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    other = [hashlib.sha256(b"x" + r).digest() for r in raw]
    kept = Subtree(from_bytes(b"".join(raw)), levels)
    kept = Subtree.unpack(n, len(kept.states), *kept.pack())
    assert to_bytes(kept.root).hex() == tree([r.hex() for r in raw], levels)
    folded = to_bytes(kept.fold(from_bytes(b"".join(other))))
    for i in range(n):
        changed = [(other if j == i else raw)[j].hex() for j in range(n)]
        assert folded[32 * i : 32 * i + 32].hex() == tree(changed, levels)


def brute_manifest(rows, changed):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted (doc_id, leaf, subroot, root, proof, folded)."""

    def leaf(values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = {}
    for r, c in zip(rows, changed, strict=True):
        groups.setdefault("" if r[1] is None else "." + r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), leaf((*r[:4], c)), r[0]))
    keys = sorted(groups, key=lambda k: k.encode())
    leaves = {k: sorted(groups[k]) for k in keys}
    subroots = [tree([x[2] for x in leaves[k]]) for k in keys]
    root = tree(subroots)

    def siblings(nodes, i):
        out = ""
        while len(nodes) > 1:
            run = range(i // 3 * 3, min(i // 3 * 3 + 3, len(nodes)))
            out += "".join(nodes[j] for j in run if j != i)
            nodes, i = [sha("".join(nodes[j : j + 3])) for j in range(0, len(nodes), 3)], i // 3
        return out

    out = []
    for s, k in enumerate(keys):
        own = [x[2] for x in leaves[k]]
        for i, x in enumerate(leaves[k]):
            sub = tree(own[:i] + [x[3]] + own[i + 1 :])
            out.append((x[4], x[2], subroots[s], root, sha(siblings(own, i) + siblings(subroots, s)), tree(subroots[:s] + [sub] + subroots[s + 1 :])))
    return sorted(out, key=str)


def test_manifest(spark, monkeypatch):
    """Small blocks make several rounds; a hot source, null fields, repeated rows and repeated ids."""
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else rng.choice(["a", "ä", "Z", ""]), "en", 3, "x\ny" * (i % 4)) for i in range(260)]
    rows += [(7, "hot", "en", 3, "other"), (7, "hot", "en", 3, "other"), (None, "hot", None, None, None), (300, None, "de", 1, ""), (301, "lone", None, 5, "z\n" * 90000)]
    changed = [t if t is None or i is None or zlib.crc32(str(i).encode()) % 2 else t.replace("\n", "") for i, *_, t in rows]
    frame = spark.createDataFrame([(*r, c, "k", 1) for r, c in zip(rows, changed, strict=True)], "doc_id long, source string, lang string, n_chars long, text string, other string, key string, block int").repartition(7)
    want = brute_manifest(rows, changed)
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    got = merkle.fold(merkle.manifest(frame, frame.other)).collect()
    assert sorted(((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got), key=str) == want
    assert all(r.verified == (r.folded_root == r.root) for r in got) and {r.verified for r in got} == {True, False}
    assert merkle.fold(merkle.manifest(frame.limit(0))).count() == 0


def test_manifest_of_one_row(spark):
    frame = spark.createDataFrame([(1, "s", "en", 1, "a")], "doc_id long, source string, lang string, n_chars long, text string")
    (row,) = merkle.fold(merkle.manifest(frame)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == sha("1:11:s2:en1:11:a") and row.proof_sha256 == sha("") and row.verified


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_search(docs, items, k):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n_docs, total = len(held), sum(h[2] for h in held)
    df = Counter(t for h in held for t in h[1])
    out = []
    for item in {i for i, _ in items if i is not None}:
        asked = Counter(t for i, x in items if i == item for t in terms(x))
        scores = []
        for i, tf, n in held:
            m = 75 + 25 * n * n_docs // total
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, r in asked.items() if t in tf)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, at + 1, i, -s) for at, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,leaf,cut", [(4096, 128, 1 << 20), (50, 4, 64)])
def test_search(spark, monkeypatch, block, leaf, cut):
    """Near copies, ties, a text beyond the slices, null and empty texts, repeated ids and items, several groups of items."""
    monkeypatch.setattr(balltree, "BLOCK", block)
    monkeypatch.setattr(balltree, "SLICE", cut)
    monkeypatch.setattr(balltree.BallTree.__init__, "__defaults__", (leaf,))
    monkeypatch.setattr(balltree, "GROUP_BYTES", 1 << 20 if block > 50 else 400)
    rng = random.Random(6)
    words = ["w%d" % i for i in range(60)] + ["Ä", "é9", "x_y", "NUL\x00a", "日本"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(300)]
    base = rng.choices(words, k=30)
    docs += [(400 + i, " ".join(base[: 30 - i % 3])) for i in range(60)]
    docs += [(500, None), (501, ""), (502, "..;"), (None, " ".join(base)), (3, docs[9][1]), (503, "w1 " * 20000), (504, "rare-Word here")]
    items = [(1, " ".join(base)), (2, "W1 w1 w2, w3"), (3, None), (4, ""), (5, "unknown words"), (6, "rare word"), (2, "w5"), (None, "w1"), (7, docs[9][1])]
    frame = spark.createDataFrame([(i, t, 1, "q") for i, t in docs], "doc_id long, text string, score int, term string").repartition(3)
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    got = balltree.search(frame, asked, 20)
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()) == brute_search(docs, items, 20)
    assert balltree.search(frame.limit(0), asked, 20).count() == balltree.search(frame, asked.limit(0), 20).count() == 0


def test_ball_bounds():
    """No document of a ball scores above its bound, and near copies let the search leave balls out."""
    rng = np.random.default_rng(7)
    base = np.array([rng.permutation(400)[:30] for _ in range(8)])
    size, term, value = np.full(2000, 30), [], []
    for i in range(2000):
        own = base[i % 8].copy()
        own[rng.integers(30)] = 400 + rng.integers(20)
        term.append(own)
        value.append(rng.integers(800_000, 810_000, 30))
    held = balltree.BallTree(size, np.concatenate(term), np.concatenate(value), 16)
    query = np.zeros(420, np.int64)
    query[base[3]] = rng.integers(1, 20_000, 30)
    scores = np.add.reduceat(query[held.term] * held.value, held.start[:-1])
    for b, (lo, hi, *_) in enumerate(held.balls):
        assert scores[lo:hi].max() <= held.bound(b, query)
    seen = []
    best, ids = balltree.Best(10), np.arange(2000)
    bound = held.bound
    held.bound = lambda ball, q: seen.append(ball) or bound(ball, q)
    held.search(query, best, ids)
    assert len(seen) < len(held.balls) / 2
    assert best.scores.tolist() == np.sort(scores)[::-1][:10].tolist()


@pytest.mark.parametrize("part_bytes", [1 << 30, 4096])
def test_shards(spark, part_bytes):
    """Bytes near equal, slots gapless, equal texts together except where a boundary cuts a large group."""
    rng = random.Random(8)
    rows = [(i, "t%d " % rng.randrange(500) * rng.randint(1, 60)) for i in range(1500)]
    rows += [(2000 + i, "copy " * 40) for i in range(700)]  # a third of all bytes
    rows += [(5000, None), (5001, ""), (None, "no id"), (5002, "é" * 3), (5003, "a"), (5003, "a"), (5003, "b")]
    frame = spark.createDataFrame([(i, t, "x", 9, 8) for i, t in rows], "doc_id long, text string, shard string, slot int, other int").repartition(5)
    out = histogramsort.shard(frame, 24, part_bytes).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in out))) == sorted(map(str, rows)) and all(r.other == 8 for r in out)
    held = {}
    for r in out:
        data = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        held.setdefault(r.shard, []).append(r)
    assert sorted(held) == list(range(24))
    mean = sum(r["size"] for r in out) / 24
    largest = max(r["size"] for r in out)
    for own in held.values():
        assert abs(sum(r["size"] for r in own) - mean) <= largest + 2 * histogramsort.TOLERANCE * mean
        assert sorted(r.slot for r in own) == list(range(len(own)))
    of_text = {}
    for r in out:
        of_text.setdefault(r.text or "", set()).add(r.shard)
    assert sum(len(s) > 1 for s in of_text.values()) <= 23 and all(max(s) - min(s) + 1 == len(s) for s in of_text.values())
    assert len(of_text["copy " * 40]) in (8, 9, 10)


def test_shards_of_few_rows(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert histogramsort.shard(frame.limit(0), 24).count() == 0
    assert sorted(r.slot for r in histogramsort.shard(frame, 3).collect()) in ([0, 0], [0, 1])


def test_histogram_keys_order():
    """Packed keys of negative and positive numbers compare as the pairs do."""
    import pandas as pd

    high, low = pd.Series([-5, 3, 3, -(1 << 63)]), pd.Series([2, -9, 4, (1 << 63) - 1])
    packed = histogramsort._rows(high, low)
    assert np.argsort(packed).tolist() == [3, 0, 1, 2]
    assert (packed == histogramsort._packed([histogramsort._key(p) for p in zip(high, low, strict=True)])).all()
