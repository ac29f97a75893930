"""The registered queries of this subpackage, ``(spark, sf_dir) -> DataFrame``, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from . import balltree, bpe, chat, histogramsort, langid, licenses, merkle, packing, pii, topk, urlfilter, vectordup
from .common import TOKENIZERS, table
from .minhash import near_duplicates

QUERIES, ORACLES = {}, {}

#: Fixed value: what splits a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


@query("op1_impact_ordered_top_k", TOP_SQL)
def op1(spark, sf_dir):
    """Ten best other vectors of every vector whose vec_id is divisible by 100."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), k=10)


#: Verdicts of hosts and paths.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op2_boosted_url_filter")
def op2(spark, sf_dir):
    """Verdict of every page's url: a rule's, else that of trees fitted on urls that rules decide."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES)


VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, min(r.y) AS component_id, e.vec_id = min(r.y) AS kept
FROM embeddings e JOIN reach r ON r.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id GROUP BY e.vec_id, n.n"""


@query("op3_multi_index_vector_duplicates", VECTOR_SQL)
def op3(spark, sf_dir):
    """Vectors of equal labels with cosine 0.93 or more."""
    return vectordup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r.y) AS component_id, d.doc_id = min(r.y) AS kept
FROM documents d JOIN reach r ON r.x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id, s.n"""


@query("op10_minhash_near_duplicates", NEAR_SQL)
def op10(spark, sf_dir):
    """Three-word shingles, similarity 0.85; see ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


@query("op4_first_fit_decreasing_packing")
def op4(spark, sf_dir):
    """Pieces of all documents, packed into sequences of 2048 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", added_tokens=True)


@query("op5_chunked_byte_bpe")
def op5(spark, sf_dir):
    """Ids of all documents and the bytes that they decode to, as digests."""
    ranks = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, PATTERN), ranks)
    return coded.select(
        "doc_id", F.expr("bigint(octet_length(ids) / 4)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


HELD_OUT = "coalesce(crc32(encode(string(doc_id), 'UTF-8')) % 4 = 2, false)"


@query("op9_language_of_segmentations")
def op9(spark, sf_dir):
    """Language of all documents; those with remainder 2 are not learnt from."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.sample_of(docs.where(~F.expr(HELD_OUT))), f"{TOKENIZERS}/piece_bpe_32k.model")
    return langid.predict(docs, model).withColumn("held_out", F.expr(HELD_OUT))


@query("op6_positional_license_scan")
def op6(spark, sf_dir):
    """License phrases and templates in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op7_candidate_boosted_pii")
def op7(spark, sf_dir):
    """Personal data in all documents: counts and digest of base spans, and all spans."""
    found = pii.find(table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in pii.KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op8_typed_chat_format")
def op8(spark, sf_dir):
    """All conversations and one of control strings, formatted and read back."""
    hard = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    shown = chat.conversations(chat.format_turns(rows.union(extra)))
    back = chat.read_back(shown)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("turns", lambda t: F.coalesce(t["learnt"], F.lit(""))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars",
    )


_BYTE = "CAST(strlen({0}) AS VARCHAR) || ':' || {0}"


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE {_BYTE.format(name)} END"


_LEAF = "sha256({0} || {1} || {2} || {3} || {4})"
_HEAD = [_field(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars")]
#: One step of the reflected CRC-32 for a byte of an ASCII text, and the whole checksum's remainder by 2.
_CRC_ODD = """list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda v, z: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))) % 2 = 0"""

MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS i, doc_id, coalesce('.' || source, '') AS key,
    {_LEAF.format(*_HEAD, _field("text"))} AS leaf, {_LEAF.format(*_HEAD, _field("replace(text, chr(10), '')"))} AS other, coalesce(NOT ({_CRC_ODD}), false) AS even
  FROM documents),
leaves AS (
  SELECT *, CASE WHEN even THEN other ELSE leaf END AS changed, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf, i) - 1 AS pos,
    count(*) OVER (PARTITION BY key) AS n FROM d),
low AS (
  SELECT key, 0 AS level, pos, leaf AS h, n FROM leaves
  UNION ALL SELECT key, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY key, level, pos // 3, n),
subroots AS (SELECT key, h AS subroot, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, pos, subroot AS h, n FROM subroots
  UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY level, pos // 3, n),
low_runs AS (SELECT key, level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM low WHERE n > 1 GROUP BY ALL),
high_runs AS (SELECT level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM high WHERE n > 1 GROUP BY ALL),
climb AS (
  SELECT i, key, 0 AS level, pos, n, changed AS h, '' AS proof FROM leaves
  UNION ALL SELECT c.i, c.key, c.level + 1, c.pos // 3, (c.n + 2) // 3,
    sha256(array_to_string(list_transform(r.hs, lambda x, k: CASE WHEN k = c.pos % 3 + 1 THEN c.h ELSE x END), '')),
    c.proof || array_to_string(list_filter(r.hs, lambda x, k: k <> c.pos % 3 + 1), '')
  FROM climb c JOIN low_runs r ON r.key = c.key AND r.level = c.level AND r.run = c.pos // 3 WHERE c.n > 1),
climb_on AS (
  SELECT c.i, 0 AS level, s.pos, s.n, c.h, c.proof FROM climb c JOIN subroots s ON s.key = c.key WHERE c.n = 1
  UNION ALL SELECT c.i, c.level + 1, c.pos // 3, (c.n + 2) // 3,
    sha256(array_to_string(list_transform(r.hs, lambda x, k: CASE WHEN k = c.pos % 3 + 1 THEN c.h ELSE x END), '')),
    c.proof || array_to_string(list_filter(r.hs, lambda x, k: k <> c.pos % 3 + 1), '')
  FROM climb_on c JOIN high_runs r ON r.level = c.level AND r.run = c.pos // 3 WHERE c.n > 1)
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = t.h AS verified
FROM leaves l JOIN subroots s ON s.key = l.key JOIN high t ON t.n = 1 JOIN climb_on c ON c.i = l.i AND c.n = 1"""


@query("op11_merkle_midstate_manifest", MERKLE_SQL)
def op11(spark, sf_dir):
    """Merkle tree of all documents by source; line breaks are deleted in documents of even id checksum."""
    even = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0, F.lit(False))
    tampered = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.fold(merkle.manifest(table(spark, sf_dir, "documents"), tampered)).withColumnRenamed("id", "doc_id")


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')"

RANKED_SQL = f"""
WITH q AS (SELECT item_id, t, count(*) AS r FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark WHERE item_id IS NOT NULL) GROUP BY item_id, t),
d AS (SELECT row_number() OVER () AS i, doc_id, {_TERMS} AS words FROM documents),
sized AS (SELECT i, doc_id, len(words)::BIGINT AS n FROM d WHERE len(words) > 0),
a AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sized),
tf AS (SELECT i, t, count(*) AS tf FROM (SELECT i, unnest(words) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY i, t),
w AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, a GROUP BY t, big_n),
v AS (SELECT s.doc_id, tf.i, t, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * s.n * a.big_n) // a.big_l))) AS v FROM tf JOIN sized s ON s.i = tf.i, a),
scored AS (SELECT q.item_id, v.doc_id, v.i, sum(q.r * w.w * v.v)::BIGINT AS score FROM q JOIN w ON w.t = q.t JOIN v ON v.t = q.t WHERE v.doc_id IS NOT NULL GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20"""


@query("op12_ball_tree_ranked_search", RANKED_SQL)
def op12(spark, sf_dir):
    """The 20 best documents of each benchmark item by integer scores of their terms."""
    return balltree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


@query("op13_histogram_sort_shards")
def op13(spark, sf_dir):
    """All documents in 24 shards of nearly equal bytes."""
    placed = histogramsort.shard(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
