"""URL filter, packing, BPE, language identification and the pipeline."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import TABLES, components, crc_mod, pii, read, u32
from pyspark.sql import functions as F

import corpus_pipeline
from spanstrata.llm import bpe, langid, packing, urlfilter
from spanstrata.llm.boosting import calibrate, fit_trees
from spanstrata.llm.common import TOKENIZERS
from spanstrata.llm.queries import PATTERN, QUERIES, RULES

WORDS = f"{TOKENIZERS}/word_bpe_49k.json"
RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def odd_texts():
    rng = random.Random(6)
    odd = [None, "", " ", "\n\n \t", "it's we're. DON'T, café. Jǒ ǰ ﬁ ŉ ß ẞ İ", "<|endoftext|> x", "a" * 3000, " " * 2000 + "x", "中文 字😀", "x\x00y\x1cz\xa0w\u3000"]
    alphabet = "aZé \n.,'sß$0²ǰÅİıﬁσς中\u0301\u030c\u2003\x85"
    return odd + ["".join(rng.choices(alphabet, k=rng.randint(0, 200))) for _ in range(150)] + ["lorem ipsum 42, dolor's  sit\n\n amet " * 200]


def frame_of(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "x", 2), (3, texts[3], "x", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length int").repartition(3), rows


def test_bpe(spark):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    frame, rows = frame_of(spark, odd_texts())
    for chunk, overlap in ((32768, 1024), (64, 32), (7, 5)):
        got = sorted(((r.doc_id if r.doc_id is not None else -1, bytes(r.ids), bytes(r.decoded)) for r in bpe.decode(bpe.encode(frame, RANKS, PATTERN, chunk, overlap), RANKS).collect()))
        assert got == sorted((i if i is not None else -1, u32(whole.encode_ordinary(t or "")), (t or "").encode()) for i, t, _, _ in rows)
    assert bpe.encode(frame.limit(0), RANKS, PATTERN).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    frame, rows = frame_of(spark, [*odd_texts(), "many words " * 3000])
    got = [r.asDict() for r in packing.pack_documents(frame, WORDS, ids=True).collect()]
    want = sorted(u32([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for _, t, _, _ in rows)
    docs = {}
    for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["start"])):
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4
        docs.setdefault(r["doc_id"], []).append(r)
    once = sorted(b"".join(bytes(p["ids"]) for p in ps) for i, ps in docs.items() if i != 3)
    assert once == sorted(w for i, w in zip([r[0] for r in rows], [u32([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for _, t, _, _ in rows]) if i != 3)
    assert len(want) == len(rows) and len(docs[3]) == 2
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(frame.limit(0), WORDS).count() == 0


def test_added_tokens(spark, tmp_path):
    """op4 and the pipeline's last stage give the ids of the vocabulary's tokenizer as it stands."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    texts = ["<|endoftext|> x", "A<|startoftext|>B Ǐ<|endoftext|>", "<|ENDOFTEXT|> y", "<|endoftext |>", "plain Text."] + [t or "" for t in odd_texts()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (QUERIES["op4_first_fit_decreasing_packing"](spark, str(tmp_path)), corpus_pipeline.pack(spark, frame, "")):
        first = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in got.where("start = 0").collect()}
        for i, t in enumerate(texts):
            ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
            assert first[i] == (len(ids), zlib.crc32(u32(ids[:2048]))), t[:50]


def test_first_fit():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 200):
        sizes = rng.integers(1, 100, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 128)
        room = []
        for i in np.argsort(-sizes, kind="stable"):
            at = next((b for b, free in enumerate(room) if free >= sizes[i]), len(room))
            if at == len(room):
                room.append(128)
            assert (bins[i], offsets[i]) == (at, 128 - room[at])
            room[at] -= sizes[i]


def test_language_paths():
    """The forward sums equal those over all segmentations, one by one."""
    pieces = sorted({"▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"})
    lattice = langid.Lattice(pieces)
    prob = np.vstack([np.random.default_rng(8).random((len(pieces), 2)), [[langid.UNKNOWN] * 2, [0, 0]]])

    def paths(word, k):
        if not word:
            return 1.0
        total = langid.UNKNOWN * paths(word[1:], k) if word[0] not in pieces else 0.0
        return total + sum(prob[i, k] * paths(word[len(p) :], k) for i, p in enumerate(pieces) if word.startswith(p))

    words = ["abab", "aaaa", "abxa", "xxxx"]
    got = np.exp(lattice.forward(words, prob))
    assert np.allclose(got, [[paths("▁" + w, k) for k in range(2)] for w in words])
    uses = lattice.expected(words[:1], np.array([2.0]), prob[:, 0])
    assert abs(sum(uses[i] * len(p) for i, p in enumerate(pieces)) - 2 * 5) < 1e-9  # every segmentation covers the word
    # Long words: sums in logarithms give the same, also across the blocks of places.
    many = ["abxabba" * 3, "babaabx" * 3]
    short, uses = lattice.forward(many, prob), lattice.expected(many, np.array([2.0, 3.0]), prob[:, 0])
    assert np.allclose([lattice._long_forward(w, prob) for w in many], short)
    assert np.allclose(sum(lattice._long_expected(w, t, prob[:, 0]) for w, t in zip(many, (2.0, 3.0))), uses)
    long = "ab" * (langid.BLOCK + 3)
    power = {p: np.log(prob[i, 1]) for i, p in enumerate(pieces)}
    text, sums = "▁" + long, [0.0]
    for j in range(1, len(text) + 1):
        sums.append(np.logaddexp.reduce([sums[i] + power[text[i:j]] for i in range(max(0, j - 3), j) if text[i:j] in power]))
    assert np.isclose(lattice.forward([long], prob)[0, 1], sums[-1])
    assert langid.words_of("a" * 5000 + " B") == ["a" * 5000, "b"]


def test_languages(spark):
    docs = read("documents")
    got = QUERIES["op9_language_of_segmentations"](spark, TABLES).toPandas().merge(docs, on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: crc_mod(i) == 2)).all() and len(got) == len(docs)
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.97 and got.score.between(0, 1).all()
    model = langid.fit(spark.read.parquet(f"{TABLES}/documents.parquet").limit(40), PIECES)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 ² _ !", "en"), (None, "the of and", None), (5, "é" * 5000, "x")], "doc_id long, text string, score string")
    shown = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert shown[1] == shown[2] == shown[3] == ("und", 0.0) and shown[None][0] in model.languages and shown[5][0] in model.languages
    none = langid.fit(langid.sample_of(odd.select("doc_id", "text", odd.score.cast("string").alias("lang")).where("false")), PIECES)
    assert none.languages == [] and langid.predict(odd, none).where("lang_pred <> 'und'").count() == 0


def rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fit = [(len(r), r, v) for v, r in RULES for s, p in [r.split("/", 1)] if (host == s or host.endswith("." + s)) and path.startswith("/" + p)]
    return host, path, max(fit)[1:] if fit else (None, None)


def test_urls(spark):
    pages = read("pages")
    for r in QUERIES["op2_boosted_url_filter"](spark, TABLES).collect():
        host, path, (fit, verdict) = rule(pages.url[pages.page_id == r.page_id].iloc[0])
        assert (r.host, r.path, r.rule) == (host, path, fit) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)
    odd = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.NET/x", "x://y://net/", "http://org/fr/?a=1#b", "http://org/frx", "http://É.com/de/", "http://example.com/de/" + "x" * 100_000, "http://a\nb.net/\nc"]
    frame = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate([*odd, odd[5]])] + [(None, odd[6], "x", 0.0)], "page_id long, url string, host string, length double")
    got = urlfilter.judge(frame, RULES).collect()
    assert len(got) == len(odd) + 2
    for r in got:
        if r.page_id is not None:
            host, path, (fit, verdict) = rule([*odd, odd[5]][r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, fit) and verdict in (None, r.verdict), r
    assert urlfilter.judge(frame.limit(0), RULES).count() == 0


def test_url_entropy(spark):
    """The entropy is that of all characters of the url and of the host, wherever a random token stands."""
    token = "q7zK2xW9vB4nM1pL"
    urls = [None, "", "http://a.b.c.com/aaaaaaaa", f"http://a.b.c.com/{token}", f"http://a.b.c.com/?x={token}", f"http://a.b.c.{token}.com/", "http://é.b.c.中😀/" + "ab" * 50_000]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    frame = frame.select("url", urlfilter.host_of(F.col("url")).alias("host"), urlfilter.path_of(F.col("url")).alias("path"))

    def entropy(text):
        return sum(-n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())

    for r in urlfilter.lexical(frame).collect():
        assert abs(r.entropy - entropy(r.url or "")) < 1e-9 and abs(r.host_entropy - entropy(r.host)) < 1e-9, r.url


def test_urls_of_one_way_suffixes(spark):
    """Where each rule decides whole suffixes, pages of its suffix and of an unseen one are judged by lexical features."""
    rng = random.Random(11)
    # digits in the path speak for a block, with exceptions among the pages that rules decide; the suffix tells those pages' verdicts alone
    rules, urls = [], []

    def page(suffix, bad, start):
        tail = "".join(rng.choices("0123456789" if bad else "aeioulnrst", k=12))
        return f"http://{rng.choice(['www', 'm', 'blog'])}.{suffix}/{start}/{tail}"

    for i in range(40):
        suffix, bad = f"site{i:02}.com", i % 2 == 0
        rules.append(("block" if bad else "allow", f"{suffix}/r/"))
        urls += [(page(suffix, bad if n % 10 else not bad, "r"), bad) for n in range(20 + i)]
        urls += [(page(suffix, b, "x"), b) for b in (True, False) for _ in range(5)]
    urls += [(page("site98.org", b, "x"), b) for b in (True, False) for _ in range(50)]
    frame = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)] + [(i, urls[0][0]) for i in range(10_000, 12_000)], "page_id long, url string")
    got = [(r.page_id, r.rule, r.verdict == "block") for r in urlfilter.judge(frame, rules).where("page_id < 10000").collect()]
    assert len(got) == len(urls)
    for own in ([x for x in got if x[1] is None and ".org" not in urls[x[0]][0]], [x for x in got if ".org" in urls[x[0]][0]]):
        assert sum(v == urls[i][1] for i, _, v in own) / len(own) > 0.97


def test_trees():
    rng = np.random.default_rng(9)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = fit_trees(x[:1000], y[:1000])
    assert ((trees.predict(x[1000:]) > 0.5) == y[1000:]).mean() > 0.97
    assert fit_trees([], []).predict([[1.0]])[0] < 1e-6 and fit_trees([[1.0]], [1]).predict([[1.0]])[0] > 0.999
    assert calibrate([0.9] * 500 + [0.1] * 500, [1] * 500 + [0] * 500, 0.98) == 0.9 and calibrate([], [], 0.9) == 2.0
    # A large sure block does not pay for a doubtful one below it.
    assert calibrate([0.9] * 5000 + [0.1] * 40, [1] * 5000 + [0] * 40, 0.98) == 0.9


def test_thresholds_come_from_all_examples(spark):
    """A sample of a few candidates may fit the trees; the thresholds count every example of the other half."""
    from spanstrata.llm import pii

    docs = spark.createDataFrame([(i, f"mail user{i}@example{i % 7}.org now, call +1 (275) 555-{1000 + i}") for i in range(800)], "doc_id long, text string")
    found = pii.with_candidates(docs).localCheckpoint()
    assert pii.fit(found, sample=40).limits[0] < 1.5
    assert calibrate([0.9, 0.1], [500, 0], 0.98, [500, 500]) == calibrate([0.9] * 500 + [0.1] * 500, [1] * 500 + [0] * 500, 0.98)


def word_set(text, k=5):
    w = text.translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("column", ["n_chars"])
def test_pipeline(spark, column):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").limit(120).collect()
    extra = [(9001, "12 34", "en", "s", 5), (9002, None, None, None, None), (9003, docs[0].text, None, "s", 1), (9004, "mail me at bob@example.org or call +1 (275) 555-7228 " + docs[1].text[:200], "en", "s", 250)]
    frame = spark.createDataFrame([tuple(d) for d in docs] + extra, "doc_id long, text string, lang string, source string, n_chars long")
    out = frame
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, out, TABLES).toArrow())
        assert out.columns == frame.columns
        kept[name] = {r.doc_id: r for r in out.collect()}
    texts = {r.doc_id: r.text for r in frame.collect()}
    assert set(texts) - set(kept["language"]) == {9001, 9002}
    sets = {i: word_set(texts[i]) for i in kept["language"]}
    group = components(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert set(kept["near_duplicates"]) == {i for i in group if group[i] == i} and 9003 not in kept["near_duplicates"]
    assert set(kept["personal_data"]) == set(kept["near_duplicates"])
    for i, r in kept["personal_data"].items():
        found = pii(texts[i])
        assert not pii(r.text) or found == []
        assert found or (r.text, r.n_chars) == (texts[i], dict((d[0], d[4]) for d in [*map(tuple, docs), *extra])[i])
    assert "<EMAIL> or call <PHONE>" in kept["personal_data"][9004].text
    pieces = corpus_pipeline.STAGES[-1][1](spark, out, TABLES).collect()
    assert {p.doc_id for p in pieces} == set(kept["personal_data"])
    assert hashlib.sha256(b"").hexdigest() and corpus_pipeline.run(spark, TABLES).count() > 0
