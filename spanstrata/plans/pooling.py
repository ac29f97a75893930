"""Pooling, baseline and context-dependent container queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import classify as C
from ..functions.numeric import r6
from ..functions.scoring import sigmoid
from ..operators import pooling as P
from ..operators import summaries as S
from ..operators import windows as W
from . import base, features  # noqa: F401  (features defines the object byte relation)
from .base import query
from .detection import labelled
from .expressions import BUCKETS_SQL, ENTRY_SQL

base.CTE["bagitems"] = """
  SELECT event_id, user_id, round_even(ln((value + 1.0e0) / 30.0e0), 6) AS logit, ((event_id * 37) % 101) / 100.0e0 AS att, ((event_id * 11) % 97) / 97.0e0 AS norm FROM events"""


base.CTE["wraw2"] = """
  SELECT container, window_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy,
    sum(CASE WHEN b BETWEEN 32 AND 126 OR b IN (9, 10, 13) THEN c ELSE 0 END) / sum(c) AS printable_ratio FROM wbytes GROUP BY ALL"""
base.DEPENDS["wraw2"] = ("wbytes",)


def bag_items(t):
    i = F.col("event_id")
    return t.events.select(
        "event_id", "user_id", r6(F.log((F.col("value") + 1.0) / 30.0)).alias("logit"), ((i * 37) % 101 / 100.0).alias("att"), ((i * 11) % 97 / 97.0).alias("norm")
    )


@query(
    "a6_vector_pool",
    """WITH d AS (SELECT label, vec_id, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS v, embedding[1]::DOUBLE AS o FROM embeddings),
 t AS (SELECT label, dim, avg(v) AS top_mean FROM (SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY o DESC, vec_id) AS r FROM d) WHERE r <= 3 GROUP BY ALL)
SELECT label, dim::INTEGER AS dim, round_even(max(v), 6) AS "max", round_even(avg(v), 6) AS mean, round_even(any_value(top_mean), 6) AS top_mean FROM d JOIN t USING (label, dim) GROUP BY ALL""",
)
def a6(t):
    e = t.embeddings.withColumn("o", F.col("embedding")[0])
    pooled = P.vector_pool(e, ["label"], "embedding")
    top = P.top_mean_pool(e, ["label"], "embedding", [F.col("o").desc(), F.col("vec_id")])
    return pooled.join(top, ["label", "dim"]).select("label", "dim", *[r6(F.col(c)).alias(c) for c in ("max", "mean", "top_mean")])


@query(
    "a7_mean_pool_objects",
    """WITH f AS (SELECT container, object_id, array_to_string(list_sort(list(DISTINCT f)), ',') AS fams FROM (SELECT container, object_id, unnest(fams) AS f FROM labelled) GROUP BY ALL),
 a AS (SELECT container, object_id, round_even(avg(e2.entropy), 6) AS entropy, round_even(avg(e2.printable_ratio), 6) AS printable_ratio, max(label_id) AS label_id, count(*) AS window_count
       FROM labelled l JOIN (SELECT container, window_id, entropy, printable_ratio FROM wraw2) e2 USING (container, window_id) GROUP BY ALL)
SELECT a.*, coalesce(fams, '') AS transform_families FROM a LEFT JOIN f USING (container, object_id)""",
    ("labelled", "wraw2"),
)
def a7(t):
    lab = labelled(t).select("container", "object_id", "window_id", "label_id", "transform_families")
    w = W.with_histogram(W.byte_windows(t.objects, 512, 256, 64))
    raw = w.select(
        "container", "window_id", B.entropy(F.col("hist"), F.col("n")).alias("entropy"), (B.printable_count(F.col("hist")) / F.col("n")).alias("printable_ratio")
    )
    j = lab.join(raw, ["container", "window_id"])
    p = P.pool_windows(j, ["container", "object_id"], ["entropy", "printable_ratio"], "transform_families", "label_id")
    return p.select(
        "container", "object_id", r6(F.col("entropy")).alias("entropy"), r6(F.col("printable_ratio")).alias("printable_ratio"), "label_id", "window_count",
        F.array_join("transform_families", ",").alias("transform_families"),
    )


@query(
    "a8_top_k_pool",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY logit DESC, event_id) AS r, greatest(1, round_even(count(*) OVER (PARTITION BY user_id) * 0.1, 0)) AS k FROM bagitems)
SELECT user_id, round_even(avg(logit), 6) AS bag_logit, count(*) AS k FROM r WHERE r <= k GROUP BY user_id""",
    ("bagitems",),
)
def a8(t):
    chosen = P.top_k_pool(bag_items(t), "user_id", "event_id", "logit", ratio=0.1)
    return P.top_k_bags(chosen, "user_id", "logit").withColumn("bag_logit", r6(F.col("bag_logit")))


SIG = "1 / (1 + exp(-logit))"
CLAMP = f"least(greatest({SIG}, 1e-6), 1 - 1e-6)"


@query(
    "a9_noisy_or",
    f"""WITH b AS (SELECT user_id, least(greatest(1 - exp(sum(ln(1 - {CLAMP}))), 1e-6), 1 - 1e-6) AS p, sum({SIG}) AS s FROM bagitems GROUP BY user_id)
SELECT event_id, user_id, round_even(p, 6) AS bag_probability, round_even(ln(p) - ln(1 - p), 4) AS bag_logit, round_even({SIG} / s, 6) AS share FROM bagitems JOIN b USING (user_id)""",
    ("bagitems",),
)
def a9(t):
    d = P.noisy_or_shares(bag_items(t), "user_id", "logit")
    return d.select("event_id", "user_id", r6(F.col("bag_probability")).alias("bag_probability"), F.bround("bag_logit", 4).alias("bag_logit"), r6(F.col("share")).alias("share"))


@query(
    "a10_attention_pool",
    """WITH s AS (SELECT *, att + 0.5e0 * (1.0e0 - norm) AS s FROM bagitems), m AS (SELECT user_id, max(s) AS m FROM s GROUP BY 1), e AS (SELECT s.*, exp(s - m) AS e FROM s JOIN m USING (user_id)),
 z AS (SELECT user_id, sum(e) AS z FROM e GROUP BY 1) SELECT user_id, round_even(sum(e / z * logit), 6) AS bag_logit FROM e JOIN z USING (user_id) GROUP BY user_id""",
    ("bagitems",),
)
def a10(t):
    w = P.attention_pool(bag_items(t), "user_id", "att", "logit", "norm", 0.5)
    return P.attention_bags(w, "user_id", "logit").withColumn("bag_logit", r6(F.col("bag_logit")))


A11 = " UNION ALL ".join(
    f"SELECT user_id, '{m}' AS mode, round_even(avg({e}), 6) AS mean_score, sum(CASE WHEN {e} >= {c} THEN 1 ELSE 0 END)::BIGINT AS predicted FROM x GROUP BY user_id"
    for m, e, c in [
        ("attention", "sh", "0.5"), ("attention_x_bag", "sh * bs", "0.5"), ("attention_anomaly", "CASE WHEN top > 0 THEN (1.0 - sh) * bs ELSE bs END", "0.5 * bs"), ("instance_logit", SIG, "0.5"),
    ]
)


@query(
    "a11_localization_modes",
    f"""WITH x AS (SELECT *, CASE WHEN top > 0 THEN att / top ELSE att END AS sh FROM (SELECT *, max(att) OVER (PARTITION BY user_id) AS top, (user_id % 9 + 1) / 10 AS bs FROM bagitems)) {A11}""",
    ("bagitems",),
)
def a11(t):
    items = bag_items(t).withColumn("bs", (F.col("user_id") % 9 + 1) / 10)
    out = None
    for mode in P.MODES:
        d = P.localization_scores(items, "user_id", "att", "bs", "logit", mode).groupBy("user_id").agg(
            r6(F.avg("item_score")).alias("mean_score"), F.sum("predicted_label_id").alias("predicted")
        ).withColumn("mode", F.lit(mode))
        out = d if out is None else out.unionByName(d)
    return out


def profiled(t):
    d = F.col("content")
    o = t.objects.select("container", "object_id", "object_path", F.length(d).alias("size"), C.object_type(F.col("object_path"), d).alias("object_type"), B.byte_stats(d)["entropy"].alias("entropy"))
    return o


base.CTE["oprof"] = """
  SELECT o.container, o.object_id, object_path, o.n AS size, e.e AS entropy FROM objects o JOIN (SELECT container, object_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM obytes GROUP BY ALL) e USING (container, object_id)"""
base.DEPENDS["oprof"] = ("objects", "obytes")


@query(
    "a13_container_baselines",
    """WITH u AS (SELECT *, row_number() OVER (PARTITION BY container ORDER BY entropy DESC) AS r FROM oprof WHERE size >= 64), s AS (SELECT container, log2(sum(size)) AS cs FROM oprof GROUP BY 1)
SELECT container, round_even(max(entropy) / 8, 6) AS max_entropy, round_even(max(entropy * log2(greatest(size, 2))), 6) AS max_weighted_entropy, round_even(log2(max(size)), 6) AS max_entry_size_log2,
  round_even(log2(count(*) + 1), 6) AS n_entries_log2, count(*) FILTER (suffix(lower(object_path), '.dex') OR starts_with(lower(object_path), 'classes'))::DOUBLE AS dex_entry_count,
  count(*) FILTER (suffix(lower(object_path), '.so'))::DOUBLE AS so_entry_count, count(*) FILTER (starts_with(lower(object_path), 'assets/'))::DOUBLE AS asset_entry_count,
  round_even(avg(CASE WHEN r <= 3 THEN entropy END) / 8, 6) AS mean_top3_entropy, round_even(any_value(cs), 6) AS container_size_log2 FROM u JOIN s USING (container) GROUP BY container""",
    ("oprof",),
)
def a13(t):
    d = P.container_baselines(profiled(t))
    return d.select("container", *[r6(F.col(c)).alias(c) for c in d.columns if c != "container"])


OT = """CASE WHEN suffix(lower(object_path), '.dex') THEN 'dex' WHEN suffix(lower(object_path), '.so') OR starts_with(lower(object_path), 'lib/') THEN 'native_lib' WHEN starts_with(lower(object_path), 'meta-inf/') THEN 'signature'
  WHEN suffix(lower(object_path), '.zip') THEN 'embedded_archive' WHEN starts_with(lower(object_path), 'assets/') THEN 'asset_blob' WHEN starts_with(lower(object_path), 'res/') THEN 'resource' ELSE 'unknown_blob' END"""


@query(
    "a14_hardness_profile",
    f"""WITH o AS (SELECT *, {OT} AS ot, CASE WHEN regexp_matches(lower(object_path), '^lib/.*[.]so$') AND len(string_split(object_path, '/')) >= 3 THEN string_split(lower(object_path), '/')[2] END AS abi FROM oprof),
 a AS (SELECT container, count(*) AS entry_count, count(*) FILTER (ot = 'dex') AS dex_count, count(*) FILTER (ot = 'native_lib') AS native_lib_count, count(*) FILTER (ot IN ('asset_blob', 'resource')) AS asset_resource_count,
   max(size)::INTEGER AS largest_entry_size, sum(size)::BIGINT AS container_size, round_even(max(entropy), 6) AS max_entropy, count(*) FILTER (entropy >= 7.2 AND size >= 65536) AS high_entropy_entry_count,
   coalesce(list_sort(list(DISTINCT abi) FILTER (abi IS NOT NULL)), []) AS abis FROM o GROUP BY container),
 f AS (SELECT *, container_size >= 20971520 AS large_apk, native_lib_count >= 4 OR len(abis) >= 2 AS native_heavy, asset_resource_count >= 40 AS asset_heavy, dex_count >= 2 AS multi_dex,
   high_entropy_entry_count >= 1 OR max_entropy >= 7.5 AS high_entropy, largest_entry_size >= 5242880 AS large_entry, entry_count >= 200 AS many_entries FROM a)
SELECT * EXCLUDE (abis), array_to_string(abis, ',') AS native_abis, large_apk::INT + native_heavy::INT + asset_heavy::INT + multi_dex::INT + high_entropy::INT + large_entry::INT + many_entries::INT AS hardness_score FROM f""",
    ("oprof",),
)
def a14(t):
    return P.hardness_profile(profiled(t)).withColumn("native_abis", F.array_join("native_abis", ","))


@query(
    "a19_bucket_summary",
    f"""WITH p AS (SELECT doc_id, bucket, (doc_id * 7919 % 1000) / 1000 AS score FROM {BUCKETS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, doc_id) AS r FROM p)
SELECT bucket, count(*) AS high_score_count, round_even(avg(score), 6) AS mean_score, max(score) AS max_score, string_agg(CASE WHEN r <= 3 THEN doc_id END, ',' ORDER BY r) AS examples FROM r GROUP BY bucket""",
    ("probes",),
)
def a19(t):
    e = C.entry_type(F.col("object_path"), F.col("content"))
    p = t.probes.select("doc_id", C.path_bucket(F.col("object_path"), e).alias("bucket"), (F.col("doc_id") * 7919 % 1000 / 1000).alias("score"))
    s = S.bucket_summary(p, "bucket", "score", "doc_id")
    return s.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query(
    "a23_majority_type",
    f"""WITH e AS (SELECT doc_id, container, {ENTRY_SQL} AS t FROM probes), c AS (SELECT container, t, count(*) AS n, min(doc_id) AS f FROM e GROUP BY ALL)
SELECT container, t AS entry_type, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY container ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""",
    ("probes",),
)
def a23(t):
    e = t.probes.select("doc_id", "container", C.entry_type(F.col("object_path"), F.col("content")).alias("entry_type"))
    return P.majority_type(e, ["container"], "entry_type", "doc_id")


@query(
    "f6_top_objects_by_metric",
    """WITH m AS (SELECT user_id, event_id, unnest(['att', 'anomaly', 'contribution']) AS metric, unnest([att, round_even(1 - norm, 6), round_even(att / (1 + exp(-logit)), 6)]) AS score FROM bagitems),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id, metric ORDER BY score DESC, event_id) AS rank FROM m) SELECT user_id, event_id, metric, score, rank::INTEGER AS rank FROM r WHERE rank <= 5""",
    ("bagitems",),
)
def f6(t):
    i = bag_items(t).select("user_id", "event_id", "att", r6(1 - F.col("norm")).alias("anomaly"), r6(F.col("att") * sigmoid(F.col("logit"))).alias("contribution"))
    return S.top_by_metric(i, ["user_id"], "event_id", ["att", "anomaly", "contribution"], 5)
