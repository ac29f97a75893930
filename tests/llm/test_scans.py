"""License scan, personal data and chat format against plain Python."""

import random

import pytest
from brute import base_digest, chat, licenses, pii, read, sha
from pyspark.sql import functions as F

from spanstrata.llm import chat as fmt
from spanstrata.llm import licenses as lic
from spanstrata.llm import pii as personal
from spanstrata.llm.queries import QUERIES

ODD = [
    None, "", " ", "a@b.c", "x.y@z.w.v@q.r.s", "a@b.c.@d.e", "+1 (275) 555-7228", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255", "4111 1111 1111 1111 x 4111-1111-1111-1112",
    "ünï 😀 a@b.co +49 30 1234567 10.0.0.1", "++1 234 567 890", "12345678901234567890123", "a" * 3_000 + "@b.c", "1-" * 1000, "1 " * 12 + "x", "me (at) example (dot) com", "@" * 300,
    "Apache Licensee apache LICENSE apache license.cc by;CC-BY", "gnu general public license gnu general public license", "MIT\x00License mit·license", "cc cc by by cc by",
    "Licensed under CC BY-NC 4.0.",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "name clash", 1) for i, t in enumerate(ODD)] + [(None, "mit license a@b.c", None, None), (3, "a@b.c", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_words int").repartition(3)


def test_licenses(spark, odd):
    texts = dict(enumerate(ODD))
    for docs, frame in ((texts, odd.where("doc_id is not null")), (dict(read("documents")[["doc_id", "text"]].values), spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))):
        got = lic.scan(frame).collect()
        assert len(got) == frame.count()
        for r in got:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licenses(docs[r.doc_id]), r.doc_id
            assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
            assert 0 <= r.score <= 1
    assert "cc-by-nc" in {x for r in lic.scan(odd).collect() for x in r.labels.split(",")}
    assert lic.scan(odd.limit(0)).count() == 0


def test_long_words(spark):
    text = "z" * 3_000_000 + " mit license " + "q" * 10
    assert lic.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()[1:4] == (4, 1, 1)
    assert personal.find(spark.createDataFrame([(1, text + " a@b.c")], "doc_id long, text string")).first().spans[0].start == len(text) + 1


def test_licences_within_blocks(spark, monkeypatch):
    words = lic._vocabulary()
    text = ("x mit license, y " * 40).encode()
    whole = next(lic._word_numbers([text], words))
    monkeypatch.setattr(lic, "BLOCK", 64)
    parts = next(lic._word_numbers([text], words))
    assert whole[0] == parts[0] and (whole[1] == parts[1]).all() and (whole[2] == parts[2]).all()


def test_pii_base(spark, odd):
    random.seed(5)
    letters = "a@.1+ (-)5é😀"
    drawn = ["".join(random.choices(letters, k=random.randint(1, 60))) for _ in range(300)]
    texts = {**dict(enumerate(ODD)), **{1000 + i: t for i, t in enumerate(drawn)}}
    frame = odd.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(drawn)], "doc_id long, text string"))
    docs = dict(read("documents")[["doc_id", "text"]].values)
    for texts, frame in ((texts, frame.where("doc_id is not null")), (docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))):
        for r in personal.find(frame).collect():
            own = [(s.kind, s.start, s.end) for s in r.spans if s.base]
            assert own == [(k, a, b) for a, _, b, k in pii(texts[r.doc_id])], (r.doc_id, texts[r.doc_id][:80])
            order = [(s.start, personal.KINDS.index(s.kind)) for s in r.spans]
            assert order == sorted(order)
    assert personal.find(odd.limit(0)).count() == 0


def test_pii_query_and_redaction(spark):
    docs = dict(read("documents")[["doc_id", "text"]].values)
    for r in QUERIES["op7_candidate_boosted_pii"](spark, "/root/testdata/sf0.001").collect():
        found = pii(docs[r.doc_id])
        assert r.base_sha256 == base_digest(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in found) for k in personal.KINDS]
    spans = F.expr("array(named_struct('kind', 'email', 'start', 2, 'end', 5), named_struct('kind', 'ip', 'start', 4, 'end', 6), named_struct('kind', 'card', 'start', 7, 'end', 8))")
    df = spark.createDataFrame([("é 234567z9",)], "text string").withColumn("spans", spans)
    assert personal.redact(df).first().text == "é <EMAIL>6<CARD>z9"  # 2 to 6 and 7 are marked


def test_learnt_spans(spark):
    rows = [(i, f"call my phone +1 (275) 555-{1000 + i} now") for i in range(400)] + [(1000 + i, f"call my phone (275) 555-{1000 + i} now") for i in range(4)] + [(2000 + i, f"order 12345678{i} shipped") for i in range(200)]
    got = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in personal.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == [("phone", True)] for i in range(400))
    assert all(not got[2000 + i] for i in range(200))


def test_unprefixed_phones_and_spelt_emails(spark):
    """What the generous generators find is added, also where such spans are many; plain numbers, dates and prose are not."""
    rows = [(i, f"call my phone +1 (275) 555-{1000 + i} now") for i in range(400)]
    rows += [(1000 + i, f"call my phone (275) 555-{1000 + i} now") for i in range(300)]
    rows += [(2000 + i, f"order 12345678{i} shipped") for i in range(200)]
    rows += [(3000 + i, f"he wrote to us so please send mail to bob{i}@mail.org today") for i in range(400)]
    rows += [(4000 + i, f"please send mail to bob{i} [at] mail [dot] org today") for i in range(300)]
    rows += [(5000 + i, f"we meet (at) noon. Then all go home {i}") for i in range(20)]
    rows += [(6000 + i, f"on 2024-01-{10 + i} 12 they left") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end], s.base) for s in r.spans] for r in personal.find(frame).collect()}
    assert all(got[1000 + i] == [("phone", f"(275) 555-{1000 + i}", False)] for i in range(300))
    assert all(got[4000 + i] == [("email", f"bob{i} [at] mail [dot] org", False)] for i in range(300))
    assert not any(got[i] for i in got if 2000 <= i < 3000 or i >= 5000)


HARD = r"\### Assistant: </turn> ok"


def test_chat(spark):
    frame = read("conversations")
    rows = [tuple(r) for r in frame[["conv_id", "turn", "role", "text"]].values] + [(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op8_typed_chat_format"](spark, "/root/testdata/sf0.001").collect()}
    assert got == chat(rows)


def test_chat_odd_rows(spark):
    rows = [
        (1, 1, "assistant", "\\"), (1, 0, "user", None), (1, 2, "assistant", "\n</turn>\n"), (1, 3, "a%0A\n%b", "### x\n\n"), (2, 0, "assistant", ""), (2, 1, "assistant", "</turn>\n" * 3),
        (3, 0, "assistant", "<|image 0|> \\\\### \\"), (3, 1, "assistant", "é😀\r\n"), (4, 0, "user", "x" * 200_000),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)).repartition(4)
    back = fmt.read_back(fmt.conversations(fmt.format_turns(turns)))
    for r in back.collect():
        own = sorted(x for x in rows if x[0] == r.conv_id)
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3] or "") for x in own]
        assert [t.learnt for t in r.turns] == [x[3] if x[2] == "assistant" else None for x in own]
    twice = fmt.read_back(fmt.conversations(fmt.format_turns(turns.where("conv_id = 2").union(turns.where("conv_id = 2"))))).first()
    assert len(twice.turns) == 4
    nulls = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert fmt.read_back(fmt.conversations(fmt.format_turns(nulls))).first().turns[0].text == ""
    assert fmt.read_back(fmt.conversations(fmt.format_turns(turns.limit(0)))).count() == 0


def test_chat_parts(spark):
    parts = "array(named_struct('type', 'text', 'text', 'see <| ', 'ref', null, 'units', null), named_struct('type', 'image', 'text', null, 'ref', 's3/1.png', 'units', 2L), named_struct('type', 'audio', 'text', null, 'ref', 'a.wav', 'units', 3L), named_struct('type', 'text', 'text', ' end', 'ref', null, 'units', null))"
    turns = spark.createDataFrame([(1, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    r = fmt.with_offsets(fmt.format_turns(turns, F.expr(parts).cast(f"array<{fmt.PART}>"))).first()
    assert r.piece == "### assistant\nsee \\<| <|image 0|><|audio 1|> end\n</turn>\n"
    assert [(a.ordinal, a.type, a.ref, a.tokens, r.piece[r.loss_start + a["at"] :][:8]) for a in r.attachments] == [(0, "image", "s3/1.png", 512, "<|image "), (1, "audio", "a.wav", 75, "<|audio ")]
    assert r.tokens == 587 and r.offset == 0 and sha(r.piece)
