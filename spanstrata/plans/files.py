"""Readers, writers, streams and models exercised on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import r6
from ..operators import ablation as AB
from ..operators import ml as ML
from ..operators import sampling as K
from ..operators import seldom as SE
from ..operators import summaries as S
from ..operators import windows as W
from ..operators.context import GROUPS
from ..operators.metrics import ranking_quality
from ..operators.ordering import materialize, stored, work_path
from ..sources import archives as A
from ..sources import catalogs as C
from ..sources import jsonl as J
from ..sources import manifests as M
from ..streaming import incremental as I
from .base import query
from .detection import MIN, STRIDE, WIDTH, labelled, windows
from .features import handcrafted


def scratch(t, name: str) -> str:
    """A fresh folder next to the checkpoints, which all executors can reach."""
    return work_path(t.spark, name)


ORDER_SCHEMA = "o_custkey BIGINT, o_orderkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE"
ORDER_COLS = ["o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"]


@query("s1_jsonl_round_trip", f"SELECT {', '.join(ORDER_COLS)} FROM orders")
def s1(t):
    path = scratch(t, "orders")
    J.write_jsonl(t.orders.select(*ORDER_COLS), path)
    return J.read_jsonl(t.spark, path, T.StructType.fromDDL(ORDER_SCHEMA))


@query("s2_write_count", "SELECT o_orderstatus, count(*) AS written, (SELECT count(*) FROM orders) AS reported FROM orders GROUP BY o_orderstatus")
def s2(t):
    path = scratch(t, "orders")
    n = J.write_jsonl(t.orders.select(*ORDER_COLS), path)
    rows = J.read_jsonl(t.spark, path, T.StructType.fromDDL(ORDER_SCHEMA))
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("written"), F.lit(n).cast("bigint").alias("reported"))


@query("s3_versioned_rewrite", "SELECT o_orderkey, o_custkey % 7 AS enriched FROM orders")
def s3(t):
    root = scratch(t, "versions")
    first = J.write_version(t.orders.select("o_orderkey", "o_custkey"), root, "1")
    rows = J.read_jsonl(t.spark, first, T.StructType.fromDDL("o_orderkey BIGINT, o_custkey BIGINT"))
    second = J.write_version(rows.select("o_orderkey", (F.col("o_custkey") % 7).alias("enriched")), root, "2")
    return J.read_jsonl(t.spark, second, T.StructType.fromDDL("o_orderkey BIGINT, enriched BIGINT"))


@query("s4_multi_file_union", "SELECT label, count(*) AS n FROM (SELECT CASE WHEN toxic = 1 THEN 'pos' ELSE 'neg' END AS label FROM labels) GROUP BY label")
def s4(t):
    a, b = scratch(t, "pos"), scratch(t, "neg")
    J.write_jsonl(t.labels.where("toxic = 1").select("doc_id", F.lit("pos").alias("label")), a)
    J.write_jsonl(t.labels.where("toxic = 0").select("doc_id", F.lit("neg").alias("label")), b)
    rows = J.read_jsonl(t.spark, [a, b], T.StructType.fromDDL("doc_id BIGINT, label STRING"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@F.udf(T.BinaryType())
def zip_of(doc_id: int, text: str, lang: str) -> bytes:
    """A small archive around one document: the text, a native stub and a nested archive."""
    import io
    import zipfile

    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("classes.dex", text[::-1])
    if doc_id % 50 == 7:
        return b"not an archive"
    with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"assets/{lang}.txt", text)
        if doc_id % 2 == 0:
            z.writestr("lib/x/a.so", "stub")
        if doc_id % 3 == 0:
            z.writestr("assets/inner.zip", inner.getvalue())
        if doc_id % 5 == 0:
            z.writestr("assets/x.dex", "more")
    return outer.getvalue()


def archives(t):
    return t.documents.select(F.col("doc_id").cast("string").alias("container"), F.concat(F.col("doc_id").cast("string"), F.lit(".apk")).alias("container_path"), zip_of("doc_id", "text", "lang").alias("archive"))


@query(
    "s5_explode_members",
    """SELECT doc_id::VARCHAR AS container, concat('assets/', lang, '.txt') AS object_path, 0 AS depth, octet_length(encode(text))::INTEGER AS size, sha256(text) AS sha256 FROM documents WHERE doc_id % 50 <> 7
UNION ALL SELECT doc_id::VARCHAR, 'lib/x/a.so', 0, 4, sha256('stub') FROM documents WHERE doc_id % 50 <> 7 AND doc_id % 2 = 0
UNION ALL SELECT doc_id::VARCHAR, 'assets/x.dex', 0, 4, sha256('more') FROM documents WHERE doc_id % 50 <> 7 AND doc_id % 5 = 0
UNION ALL SELECT doc_id::VARCHAR, 'assets/inner.zip!classes.dex', 1, octet_length(encode(text))::INTEGER, sha256(reverse(text)) FROM documents WHERE doc_id % 50 <> 7 AND doc_id % 3 = 0
UNION ALL SELECT doc_id::VARCHAR, 'assets/inner.zip', 0, NULL, NULL FROM documents WHERE doc_id % 50 <> 7 AND doc_id % 3 = 0""",
)
def s5(t):
    members, _ = A.explode_members(archives(t))
    # the bytes of the nested archive itself are the zip writer's own (times, order of fields)
    own = F.col("object_path") != "assets/inner.zip"
    return members.select("container", "object_path", "depth", F.when(own, F.col("size")).alias("size"), F.when(own, F.col("sha256")).alias("sha256"))


@query(
    "s5_nested_members",
    "SELECT object_path, depth, count(*) AS n FROM (SELECT 'assets/inner.zip!classes.dex' AS object_path, 1 AS depth FROM documents WHERE doc_id % 50 <> 7 AND doc_id % 3 = 0) GROUP BY ALL",
)
def s5_nested(t):
    members, _ = A.explode_members(archives(t))
    return members.where("depth = 1").groupBy("object_path", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("s5_bad_archives", "SELECT doc_id::VARCHAR AS container FROM documents WHERE doc_id % 50 = 7")
def s5_bad(t):
    return A.explode_members(archives(t))[1].select("container")


@query(
    "s6_member_probe",
    "SELECT doc_id::VARCHAR AS container, CASE WHEN doc_id % 50 <> 7 THEN doc_id % 2 = 0 END AS has_native, CASE WHEN doc_id % 50 <> 7 THEN doc_id % 5 = 0 END AS has_nested_code FROM documents",
)
def s6(t):
    return A.probe_members(archives(t))


@query("s7_catalog_scan", "SELECT p_partkey::VARCHAR AS p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 48)")
def s7(t):
    path = scratch(t, "catalog")
    t.part.select("p_partkey", "p_brand", "p_name").write.option("header", True).option("compression", "gzip").csv(path)
    targets = t.part.where("p_size > 48").select("p_brand").distinct()
    return C.read_catalog(t.spark, path, ["p_partkey", "p_brand"], targets, "p_brand").select("p_partkey", "p_brand")


@query(
    "s8_manifest_reader",
    "SELECT item_id, sha256(text) AS text_sha FROM benchmark",
)
def s8(t):
    path = scratch(t, "manifest")
    rows = t.benchmark.select(F.struct("item_id", "text").alias("r"), (F.col("item_id") % 16).alias("g"))
    wrapped = rows.groupBy("g").agg(F.to_json(F.struct(F.collect_list("r").alias("records"))).alias("value"))
    wrapped.select("value", "g").repartition(4, "g").write.partitionBy("g").text(path)
    read = M.read_manifest(t.spark, path, T.StructType.fromDDL("item_id BIGINT, text STRING"))
    return read.select("item_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha"))


@query(
    "s9_id_path_index",
    "SELECT id, path FROM (SELECT concat('c', o_custkey) AS id, concat('p', o_orderkey) AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1",
)
def s9(t):
    rows = t.orders.selectExpr("CASE WHEN o_orderkey % 2 = 0 THEN concat('c', o_custkey) END AS apk_id", "concat('c', o_custkey) AS id2", "CASE WHEN o_orderkey % 3 = 0 THEN concat('p', o_orderkey) END AS path", "concat('p', o_orderkey) AS local_path", "o_orderkey")
    return C.id_path_index(rows, ["apk_id", "id2"], ["path", "local_path"], "o_orderkey")


@query(
    "s10_inventory",
    """WITH d AS (SELECT source, lang, CASE WHEN n_chars > 200 THEN concat(lang, '/', doc_id) END AS path, CASE WHEN n_chars > 200 THEN n_chars END AS n FROM documents),
 e AS (SELECT source, lang, string_agg(path, ',' ORDER BY path) AS ex FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY path) AS r FROM d WHERE path IS NOT NULL) WHERE r <= 3 GROUP BY ALL),
 g AS (SELECT source, lang, grouping(source, lang) AS level, count(path) AS files, coalesce(sum(n), 0)::BIGINT AS bytes FROM d GROUP BY ROLLUP (source, lang))
SELECT g.*, ex AS examples FROM g LEFT JOIN e ON g.source = e.source AND g.lang = e.lang AND level = 0""",
)
def s10(t):
    d = t.documents.selectExpr("source", "lang", "CASE WHEN n_chars > 200 THEN concat(lang, '/', doc_id) END AS path", "CASE WHEN n_chars > 200 THEN n_chars END AS n")
    return S.inventory(d, "source", "lang", "path", "n").withColumn("examples", F.array_join("examples", ","))


@query("s11_corpus_sink", "SELECT lang AS stream, count(*) AS rows FROM documents GROUP BY lang")
def s11(t):
    return C.write_corpus(t.documents.select("doc_id", F.col("lang").alias("stream")), scratch(t, "corpus"), chunk=200)


LISTING = "concat('features/', 15 + p_size % 3, '/', CASE p_partkey % 4 WHEN 0 THEN 'Ali' WHEN 1 THEN 'Baidu' WHEN 2 THEN 'Odd' ELSE 'Tencent' END, '/', replace(p_name, ' ', ''), CASE p_partkey % 3 WHEN 0 THEN '_release' ELSE '' END, CASE p_partkey % 5 WHEN 0 THEN '_tx' WHEN 1 THEN '_al' WHEN 2 THEN '_bd' WHEN 3 THEN '_zz' ELSE '_al' END, '_signed.json')"


@query(
    "s12_listing_parser",
    f"""WITH x AS (SELECT p_partkey, {LISTING} AS l FROM part), y AS (SELECT p_partkey, regexp_extract(l, 'features/([0-9]+)/([^/]+)/(.+)_(al|bd|bb|ij|qh|tx)_signed[.]json', ['a', 'p', 'r', 'c']) AS m FROM x)
SELECT p_partkey, m.a AS api, m.p AS packer, regexp_replace(m.r, '(_release|_debug_unaligned|_debug|_aligned|_unaligned)+$', '') AS app, CASE m.c WHEN 'al' THEN 'Ali' WHEN 'bd' THEN 'Baidu' ELSE 'Tencent' END <> m.p AS inconsistent
FROM y WHERE m.a <> '' AND m.p IN ('Ali', 'Baidu', 'Bangcle', 'Ijiami', 'Qihoo', 'Tencent')""",
)
def s12(t):
    return C.parse_listing(t.part.select("p_partkey", F.expr(LISTING).alias("l")), F.col("l")).select("p_partkey", "api", "packer", "app", "inconsistent")


@query("s13_tolerant_reader", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3")
def s13(t):
    path = scratch(t, "messy")
    line = F.when(F.col("o_orderkey") % 10 == 3, "{oops").otherwise(F.to_json(F.struct("o_orderkey")))
    t.orders.select(line.alias("value")).write.text(path)
    schema = T.StructType.fromDDL("o_orderkey BIGINT")
    return J.read_tolerant(t.spark, path, schema).unionByName(J.read_tolerant(t.spark, path + "-absent", schema))


# ---- streams --------------------------------------------------------------------------------


@query("t1_incremental_ingest", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def t1(t):
    src, out, ck = scratch(t, "in"), scratch(t, "out"), scratch(t, "ck")
    slim = t.events.select("event_id", "event_type")
    for part in (0, 1):
        slim.where(F.col("event_id") % 2 == part).write.mode("append").parquet(src)
        I.append_summary(I.new_files(t.spark, src, slim.schema), out, ck).awaitTermination()
    return t.spark.read.schema(slim.schema).parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t2_stream_scores",
    "SELECT container, window_id, round_even(entropy + (1.0e0 - printable_ratio), 6) AS score FROM wstats",
    ("wstats",),
)
def t2(t):
    src, out, ck = scratch(t, "objects"), scratch(t, "scores"), scratch(t, "ck")
    o = t.objects.select("container", "object_id", "object_path", "content")
    o.write.parquet(src)
    scored = I.score_stream(I.new_files(t.spark, src, o.schema), WIDTH, STRIDE, MIN, 1.0, 1.0).select("container", "window_id", "score")
    I.append_summary(scored, out, ck).awaitTermination()
    return t.spark.read.schema(scored.schema).parquet(out)


@query("t3_label_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'b' ELSE 'a' END AS stage, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS label FROM orders")
def t3(t):
    src, root, ck = scratch(t, "labels"), scratch(t, "table"), scratch(t, "ck")
    schema = T.StructType.fromDDL("o_orderkey BIGINT, stage STRING, label STRING")
    first = t.orders.selectExpr("o_orderkey", "'a' AS stage", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS label")
    older = t.orders.where("o_orderkey % 4 = 0").selectExpr("o_orderkey", "'aa' AS stage", "'old' AS label")
    second = t.orders.where("o_orderkey % 2 = 0").selectExpr("o_orderkey", "'b' AS stage", "CAST(NULL AS STRING) AS label")
    for part in (first, second.unionByName(older)):
        part.write.mode("append").parquet(src)
        I.upsert_labels(I.new_files(t.spark, src, schema), root, ["o_orderkey"], ["label"], ["stage"], ck).awaitTermination()
    return I.current_table(t.spark, root, schema)


# ---- models ---------------------------------------------------------------------------------


MODEL_FOLD = "CAST(regexp_replace(container, '[^0-9]', '') AS INT) % 4"


def ngram_scores(t):
    w = W.cut_first(windows(t).select("container", "object_id", "window_id", "data", "offset_start", "offset_end"))
    w = SE.with_labels(w, labelled(t).select("container", "window_id", "label_id"), ["container", "window_id"], "label_id")
    w = stored(w.withColumn("fold", F.expr(MODEL_FOLD)), "windows")
    return ML.out_of_fold_ngram_scores(w, "label_id", "fold", range(4))


@query("m1_ngram_model")
def m1(t):
    return ngram_scores(t).select("container", "window_id", "fold", r6(F.col("score")).alias("score"))


@query(
    "m1_scored_windows",
    """SELECT container, window_id, (regexp_replace(container, '[^0-9]', '', 'g')::INT % 4)::INTEGER AS fold, label_id, true AS in_range, true AS better_than_chance FROM labelled""",
    ("labelled",),
)
def m1_scored(t):
    """All windows once, with scores in [0, 1] that rank hidden passages above chance."""
    s = materialize(ngram_scores(t).select("container", "window_id", "fold", "label_id", "score"))
    auroc = ranking_quality(s, F.col("score"), F.col("label_id"), []).select(F.col("auroc") > 0.5).scalar()
    return s.select("container", "window_id", "fold", "label_id", F.col("score").between(0, 1).alias("in_range"), auroc.alias("better_than_chance"))


@query("m2_boosted_folds")
def m2(t):
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("label") < 5).cast("int").alias("y"), (F.col("vec_id") % 2).alias("fold"))
    return ML.boosted_fold_scores(rows, "v", "y", "fold", [0, 1]).select("vec_id", "y", "fold", r6(F.col("score")).alias("score"))


@query(
    "m3_token_normality",
    """WITH p AS (SELECT container, window_id, unnest(list_transform(range(1, wn), lambda k: bs[k] * 256 + bs[k + 1])) AS g FROM (SELECT container, window_id, wn, list_transform(range(0, wn), lambda k: ('0x' || substr(whx, 2 * k + 1, 2))::INTEGER) AS bs FROM windows)),
 c AS (SELECT container, window_id, g, count(*) AS n FROM p GROUP BY ALL), m AS (SELECT g, sum(n) AS c FROM c JOIN (SELECT container, window_id FROM labelled WHERE label_id = 0) USING (container, window_id) GROUP BY g), t AS (SELECT g // 256 AS h, sum(c) AS t FROM m GROUP BY 1)
SELECT container, window_id, round_even(sum(-ln((coalesce(m.c, 0) + 1) / (coalesce(t, 0) + 256)) * n) / sum(n), 6) AS surprisal FROM c LEFT JOIN m USING (g) LEFT JOIN t ON h = g // 256 GROUP BY ALL""",
    ("labelled",),
)
def m3(t):
    w = W.cut_first(windows(t).select("container", "window_id", "data"))
    # Windows of one id share their label, and each is in ``labelled``: what is not positive there is benign.
    benign = SE.anti_join(w.where("container IS NOT NULL"), labelled(t).where("label_id <> 0"), ["container", "window_id"])
    return ML.token_normality(benign, w, ["container", "window_id"]).withColumn("surprisal", r6(F.col("surprisal")))


@query("m4_ablation_grid")
def m4(t):
    rows = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_suppkey") % 2).alias("fold"))
    groups = {"price": ["l_extendedprice", "l_quantity"], "rates": ["l_discount", "l_tax"], "all": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]}
    return ML.ablation_report(rows, groups, "y", "fold", [0, 1])


ABLATION_LEVELS = {"window": ["container", "window_id"], "object": ["container", "object_id"], "container": ["container"]}


def group_ablation(t):
    """Feature groups of the handcrafted window table, each passage family held out in turn; a fifth of the benign objects is for tests."""
    truth = labelled(t).select("container", "window_id", "label_id", F.get("transform_families", F.lit(0)).alias("family"))
    rows = handcrafted(t).join(truth, ["container", "window_id"])
    spare = F.substring_index("object_id", ":", -1).cast("long") % 5 == 0
    return AB.group_ablation(K.leave_one_out(rows, "family", "label_id", spare), GROUPS, "label_id", ABLATION_LEVELS)


@query("m4_group_ablation")
def m4_groups(t):
    r = group_ablation(t)
    return r.select("features", "held_out", "level", "support", "true_positives", "false_positives", "false_negatives", "true_negatives", "precision", "recall", "f1", "accuracy", "auroc", "auprc")


@query(
    "m4_group_ablation_counts",
    f"""WITH k AS (SELECT container, object_id, window_id, label_id AS y, CASE WHEN label_id = 1 THEN fams[1] END AS test_fold, split_part(object_id, ':', -1)::BIGINT % 5 = 0 AS bt FROM labelled),
 te AS (SELECT k.*, held_out FROM k JOIN (SELECT DISTINCT test_fold AS held_out FROM k WHERE y = 1) ON (y = 1 AND test_fold = held_out) OR (y = 0 AND bt)),
 it AS (SELECT held_out, 'window' AS level, window_id AS i, y FROM te UNION ALL SELECT held_out, 'object', object_id, max(y) FROM te GROUP BY ALL UNION ALL SELECT held_out, 'container', container, max(y) FROM te GROUP BY ALL)
SELECT features, held_out, level, count(*) AS support, sum(y)::BIGINT AS positives, true AS in_range FROM it, (SELECT unnest({list(AB.group_sets(GROUPS))}) AS features) GROUP BY ALL""",
    ("labelled",),
)
def m4_group_counts(t):
    """Items of every report row; all rates lie in [0, 1] and ranking figures stand where both classes do."""
    r = group_ablation(t)
    rates = [F.col(c).between(0, 1) for c in ("precision", "recall", "f1", "accuracy")]
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("support"))
    ranked = F.when(both, F.col("auroc").between(0, 1) & F.col("auprc").between(0, 1)).otherwise(F.col("auroc").isNull())
    return r.select("features", "held_out", "level", "support", "positives", F.coalesce(rates[0] & rates[1] & rates[2] & rates[3] & ranked, F.lit(False)).alias("in_range"))
