"""Corpus curation: summaries, rankings, splits, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as K
from ..operators import summaries as S
from . import base
from .base import query
from .detection import scored_windows

# ---- summaries ------------------------------------------------------------------------------

META = [
    "concat('s', c_nationkey % 5) AS source",
    "c_mktsegment AS family",
    "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal > 5000 END AS packed",
    "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS nested",
    "c_custkey % 3 = 0 AS native",
]
base.CTE["meta"] = f"SELECT c_custkey, {', '.join(META)} FROM customer"


def meta(t):
    return t.customer.selectExpr("c_custkey", *META)


@query(
    "a15_corpus_summary",
    """SELECT source, family, grouping(source, family) AS level, count(*) AS samples, count(*) FILTER (packed) AS n_packed, count(*) FILTER (native) AS n_native, count(*) FILTER (nested) AS n_nested,
  round_even(avg(CASE WHEN packed THEN 1 ELSE 0 END), 6) AS packed_rate FROM meta GROUP BY ROLLUP (source, family)""",
    ("meta",),
)
def a15(t):
    return S.corpus_summary(meta(t))


@query(
    "a15_flag_crosstab",
    "SELECT coalesce(packed::VARCHAR, 'unknown') AS packed, coalesce(nested::VARCHAR, 'unknown') AS nested, count(*) AS n FROM meta GROUP BY ALL",
    ("meta",),
)
def a15_cross(t):
    return S.flag_crosstab(meta(t), "packed", "nested")


SUSP = "CASE WHEN c_custkey % 4 = 0 THEN 'Ali,Baidu' WHEN c_custkey % 4 = 1 THEN 'Ali' ELSE '' END"


@query(
    "a15_suspected_histogram",
    f"""WITH x AS (SELECT concat('s', c_nationkey % 5) AS source, unnest(list_filter(string_split({SUSP}, ','), lambda v: v <> '')) AS packer FROM customer WHERE c_custkey % 11 > 0 AND c_acctbal > 5000)
SELECT source, packer, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT '*', packer, count(*) FROM x GROUP BY packer""",
)
def a15_hist(t):
    fams = F.filter(F.split(F.expr(SUSP), ","), lambda v: v != "")
    return S.suspected_histogram(meta(t).join(t.customer.select("c_custkey", fams.alias("fams")), "c_custkey"), "fams")


COV = "replace(p_name, ' ', '') AS app, p_brand AS packer, concat('', 15 + p_size % 3) AS api"


@query(
    "a16_coverage_index",
    f"""WITH x AS (SELECT {COV} FROM part), p AS (SELECT app, packer, array_to_string(list_sort(list(DISTINCT api)), '+') AS apis FROM x GROUP BY ALL)
SELECT app, count(*) AS n_packers, array_to_string(list_sort(list(concat(packer, ':', apis))), ',') AS packers FROM p GROUP BY app""",
)
def a16(t):
    return S.coverage_index(t.part.selectExpr("replace(p_name, ' ', '') AS app", "p_brand AS packer", "concat('', 15 + p_size % 3) AS api"), "app", "packer", "api")


@query("a16_packer_coverage", f"SELECT packer, count(DISTINCT app) AS n_apps, count(*) AS rows FROM (SELECT {COV} FROM part) GROUP BY packer")
def a16_packer(t):
    return S.packer_coverage(t.part.selectExpr("replace(p_name, ' ', '') AS app", "p_brand AS packer"), "app", "packer")


@query(
    "a17_yearly_profile",
    """WITH o AS (SELECT o_orderpriority AS k, coalesce(CASE WHEN o_orderkey % 9 > 0 THEN year(o_orderdate)::VARCHAR END, 'unknown') AS y, o_orderkey FROM orders),
 h AS (SELECT k, y, count(*) AS n FROM o GROUP BY ALL), e AS (SELECT k, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_orderkey) AS r FROM o) WHERE r <= 5 GROUP BY k)
SELECT k, sum(n)::BIGINT AS n, string_agg(concat(y, '=', n), ',' ORDER BY concat(y, '=', n)) AS by_year, any_value(examples) AS examples FROM h JOIN e USING (k) GROUP BY k""",
)
def a17(t):
    o = t.orders.select(F.col("o_orderpriority").alias("k"), F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderdate")).alias("d"), "o_orderkey")
    return S.yearly_profile(o, "k", "d", "o_orderkey").withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


A18_DIMS = ["decision", "source", "agreement"]
A18_SQL = "o_orderpriority AS decision, o_orderstatus AS source, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('a', o_custkey % 4) END AS agreement, o_totalprice > 250000 AS needs_manual_review"


@query(
    "a18_batch_summary",
    f"WITH x AS (SELECT {A18_SQL} FROM orders) SELECT 'total' AS dimension, '*' AS value, count(*) AS n, count(*) FILTER (needs_manual_review) AS n_review FROM x UNION ALL "
    + " UNION ALL ".join(f"SELECT '{d}', coalesce({d}, 'none'), count(*), count(*) FILTER (needs_manual_review) FROM x GROUP BY {d}" for d in A18_DIMS),
)
def a18(t):
    pairs = t.orders.selectExpr(
        "o_orderpriority AS decision", "o_orderstatus AS source", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('a', o_custkey % 4) END AS agreement", "o_totalprice > 250000 AS needs_manual_review"
    )
    return S.batch_summary(pairs, A18_DIMS)


@query(
    "a25_labelled_training_rows",
    """SELECT w.container, label_id, count(*) AS rows, sum(wn)::BIGINT AS bytes FROM windows w JOIN (SELECT DISTINCT source AS container, CASE regexp_replace(source, '[^0-9]', '', 'g')::INT % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS label_id FROM documents) USING (container)
WHERE label_id IS NOT NULL GROUP BY ALL""",
    ("windows",),
)
def a25(t):
    samples = t.documents.select(F.col("source").alias("container")).distinct().withColumn(
        "label", F.expr("CASE CAST(regexp_replace(container, '[^0-9]', '') AS INT) % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END")
    )
    rows = S.labelled_training_rows(scored_windows(t), samples, "container")
    return rows.groupBy("container", "label_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


# ---- rankings -------------------------------------------------------------------------------


@query(
    "f7_select_candidates",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey) AS r FROM orders),
 c AS (SELECT *, row_number() OVER (PARTITION BY lower(o_orderkey % 4000 || '') ORDER BY o_custkey, r) AS d FROM r WHERE r <= 2 AND o_totalprice > 20000)
SELECT o_orderkey, o_custkey, o_totalprice FROM c WHERE d = 1 ORDER BY o_orderdate DESC, o_orderkey LIMIT 500""",
)
def f7(t):
    o = t.orders.withColumn("digest", (F.col("o_orderkey") % 4000).cast("string"))
    c = S.select_candidates(
        o, "o_custkey", "digest", [F.desc("o_totalprice"), F.desc("o_orderdate"), F.col("o_orderkey")], 2, F.col("o_totalprice") > 20000, [F.desc("o_orderdate"), F.col("o_orderkey")], 500
    )
    return c.select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "f8_bounded_top_k",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem ORDER BY (l_returnflag = 'R') DESC, l_shipdate DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey, l_partkey LIMIT 300""",
)
def f8(t):
    rank = [F.expr("l_returnflag = 'R'").desc(), F.desc("l_shipdate"), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]
    return t.lineitem.orderBy(*rank).limit(300).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")




@query(
    "f9_pick_version",
    """WITH v AS (SELECT concat(p_brand, '/', p_type) AS app, 12 + p_size AS min_sdk, p_partkey AS version_code, round(p_retailprice * 100)::BIGINT AS added, max(p_partkey) OVER (PARTITION BY p_brand, p_type) AS hint FROM part),
 s AS (SELECT *, CASE WHEN min_sdk <= 16 THEN 0 WHEN version_code = hint AND hint % 2 = 0 THEN 1 ELSE 2 END AS tier FROM v),
 r AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY tier, CASE tier WHEN 0 THEN added WHEN 1 THEN 0 ELSE -added END, version_code) AS r FROM s)
SELECT app, version_code, added, tier FROM r WHERE r = 1""",
)
def f9(t):
    v = t.part.select(
        F.concat_ws("/", "p_brand", "p_type").alias("app"), (F.col("p_size") + 12).alias("min_sdk"), F.col("p_partkey").alias("version_code"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("added")
    )
    top = v.groupBy("app").agg(F.max("version_code").alias("hint")).withColumn("hint", F.when(F.col("hint") % 2 == 0, F.col("hint")))
    return S.pick_version(v.join(top, "app"), "app", "hint")


# ---- splits and samples ---------------------------------------------------------------------

SPLIT = {"train": ["en", "de"], "test": ["fr"]}


@query(
    "k1_group_split",
    "SELECT doc_id, lang, CASE WHEN lang IN ('en', 'de') THEN 'train' WHEN lang = 'fr' THEN 'test' ELSE 'unassigned' END AS partition FROM documents",
)
def k1(t):
    return K.group_split(t.documents.select("doc_id", "lang"), "lang", SPLIT)


FOLD_ROWS = """lo AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, (l_returnflag = 'R')::INTEGER AS y, CASE WHEN l_suppkey % 13 = 0 THEN '' ELSE concat('fam', l_suppkey % 7) END AS family, l_partkey % 10 = 0 AS bt FROM lineitem WHERE l_tax < 0.08),
 k AS (SELECT *, CASE WHEN y = 1 THEN 'positive' WHEN bt THEN 'benign_test' ELSE 'benign_train' END AS kind, CASE WHEN y = 1 THEN family END AS test_fold FROM lo WHERE y = 0 OR family <> '')"""


def fold_rows(t):
    fam = F.when(F.col("l_suppkey") % 13 == 0, "").otherwise(F.concat(F.lit("fam"), (F.col("l_suppkey") % 7).cast("string")))
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", (F.col("l_returnflag") == "R").cast("int").alias("y"), fam.alias("family"), (F.col("l_partkey") % 10 == 0).alias("bt"), (F.col("l_tax") >= 0.08).alias("bad")
    )
    return K.leave_one_out(rows, "family", "y", F.col("bt"), F.col("bad"))


@query("k2_leave_one_out", f"WITH {FOLD_ROWS} SELECT kind, test_fold, count(*) AS n, sum(CASE WHEN kind = 'benign_train' OR (kind = 'positive' AND test_fold <> 'fam3') THEN 1 ELSE 0 END)::BIGINT AS train_when_fam3_held_out FROM k GROUP BY ALL")
def k2(t):
    role = K.fold_role(F.lit("fam3"))
    return fold_rows(t).groupBy("kind", "test_fold").agg(F.count(F.lit(1)).alias("n"), F.sum((role == "train").cast("int")).alias("train_when_fam3_held_out"))


@query(
    "k2_fold_sizes",
    f"""WITH {FOLD_ROWS}, t AS (SELECT count(*) FILTER (kind = 'positive') AS p, count(*) FILTER (kind = 'benign_train') AS b, count(*) FILTER (kind = 'benign_test') AS x FROM k)
SELECT test_fold AS held_out, any_value(p) - count(*) AS n_train_positive, any_value(b) AS n_train_benign, count(*) AS n_test_positive, any_value(x) AS n_test_benign FROM k, t WHERE kind = 'positive' GROUP BY test_fold""",
)
def k2_sizes(t):
    return K.fold_sizes(fold_rows(t))


@query(
    "k3_seed_disjoint_folds",
    """WITH r AS (SELECT doc_id, doc_id % 97 AS seed, CASE WHEN doc_id % 3 = 0 THEN 'benign' ELSE lang END AS family FROM documents), s AS (SELECT DISTINCT seed FROM r),
 g AS (SELECT seed, rep, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws('|', 42, rep, seed))) AS rn FROM s, (SELECT unnest([1, 2, 3]) AS rep)),
 ro AS (SELECT seed, rep, CASE WHEN rn <= greatest(1, floor((SELECT count(*) FROM s) * 0.3)) THEN 'test' ELSE 'train' END AS role FROM g),
 u AS (SELECT rep, held_out, role, family FROM r JOIN ro USING (seed), (SELECT unnest(['en', 'de', 'fr', 'es']) AS held_out) WHERE family = 'benign' OR (family = held_out AND role = 'test') OR (family <> held_out AND role = 'train'))
SELECT rep AS repeat, held_out, role, count(*) FILTER (family <> 'benign') AS positives, count(*) FILTER (family = 'benign') AS benign FROM u GROUP BY ALL""",
)
def k3(t):
    rows = t.documents.select("doc_id", (F.col("doc_id") % 97).alias("seed"), F.when(F.col("doc_id") % 3 == 0, "benign").otherwise(F.col("lang")).alias("family"))
    roles = K.seed_roles(rows, "seed", 3)
    return K.seed_disjoint_counts(rows, roles, "seed", "family", ["en", "de", "fr", "es"])


SAMPLE_ROWS = "s AS (SELECT doc_id, lang, (toxic = 1)::INTEGER AS y FROM documents JOIN labels USING (doc_id))"


def sample_rows(t):
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", F.col("toxic").alias("y")), "doc_id")


@query(
    "k4_stratified_sample",
    f"""WITH {SAMPLE_ROWS}, n AS (SELECT count(*) AS n, sum(y) AS p FROM s), kp AS (SELECT least(p, greatest(60, 20), 120) AS kp FROM n),
 pos AS (SELECT *, row_number() OVER (ORDER BY md5(concat('5|', doc_id))) AS rn FROM s WHERE y = 1),
 rest AS (SELECT doc_id, lang, y FROM pos, kp WHERE rn > kp UNION ALL SELECT doc_id, lang, y FROM s WHERE y = 0),
 rr AS (SELECT *, row_number() OVER (PARTITION BY lang, y ORDER BY md5(concat('6|', doc_id))) AS k FROM rest), tn AS (SELECT *, row_number() OVER (ORDER BY k, lang, y) AS t FROM rr)
SELECT doc_id, lang, y FROM pos, kp WHERE rn <= kp UNION ALL SELECT doc_id, lang, y FROM tn, kp WHERE t <= 120 - kp""",
)
def k4(t):
    return K.stratified_sample(sample_rows(t), 120, 20, "lang", "y", "doc_id", 5).select("doc_id", "lang", "y")


@query(
    "k5_fit_calibration_split",
    f"""WITH {SAMPLE_ROWS}, n AS (SELECT count(*) AS n, sum(y) AS p, count(*) - sum(y) AS q FROM s), tg AS (SELECT *, least(greatest(1, 30, round_even(n * 0.4, 0)), n - 1) AS t FROM n),
 a AS (SELECT *, greatest(least(p - 1, t, greatest(1, 10)), 0) AS kp FROM tg), b AS (SELECT *, greatest(least(q - 1, t - kp, greatest(1, floor(t / 2))), 0) AS kn FROM a),
 rk AS (SELECT s.*, row_number() OVER (PARTITION BY y ORDER BY md5(concat('9|', doc_id))) <= CASE WHEN y = 1 THEN kp ELSE kn END AS fst FROM s, b),
 rr AS (SELECT *, row_number() OVER (PARTITION BY lang, y ORDER BY md5(concat('10|', doc_id))) AS k FROM rk WHERE NOT fst), tn AS (SELECT *, row_number() OVER (ORDER BY k, lang, y) AS turn FROM rr),
 il AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY turn) AS i FROM tn), al AS (SELECT il.*, row_number() OVER (ORDER BY turn) AS f FROM il, b WHERE i <= CASE WHEN y = 1 THEN p - 1 - kp ELSE q - 1 - kn END),
 ch AS (SELECT doc_id FROM rk WHERE fst UNION ALL SELECT doc_id FROM al, b WHERE f <= t - kp - kn)
SELECT doc_id, y, CASE WHEN doc_id IN (SELECT doc_id FROM ch) THEN 'calibration' ELSE 'fit' END AS part FROM s""",
)
def k5(t):
    return K.fit_calibration_split(sample_rows(t), 0.4, 30, 10, "lang", "y", "doc_id", 9).select("doc_id", "y", "part")


@query(
    "k6_subsample_bags",
    """WITH x AS (SELECT user_id, event_id, event_type = 'purchase' AS y FROM events), n AS (SELECT user_id, count(*) AS n, count(*) FILTER (y) AS p FROM x GROUP BY 1),
 q AS (SELECT *, CASE WHEN n <= 40 THEN n ELSE greatest(least(40, CASE WHEN p > 0 THEN floor(p / 0.25) ELSE 40 END), p) - p END AS q FROM n),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat('3|', user_id, '|', event_id))) AS rn FROM x WHERE NOT y)
SELECT user_id, event_id FROM x WHERE y UNION ALL SELECT user_id, event_id FROM r JOIN q USING (user_id) WHERE rn <= q""",
)
def k6(t):
    e = t.events.select("user_id", "event_id", "event_type")
    return K.subsample_bags(e, "user_id", F.col("event_type") == "purchase", "event_id", 40, 0.25, 3).select("user_id", "event_id")


K7_SQL = """WITH w AS (SELECT container, object_id, row_number() OVER (PARTITION BY container ORDER BY object_id, window_index) - 1 AS idx FROM windows),
 r AS (SELECT *, row_number() OVER (PARTITION BY container ORDER BY md5(concat('4|', container, '|', idx))) AS rn FROM w), p AS (SELECT *, row_number() OVER (PARTITION BY container ORDER BY idx) - 1 AS ni FROM r WHERE rn <= 100)
SELECT container, object_id, min(ni) AS "start", max(ni) + 1 AS "end" FROM p GROUP BY ALL"""


@query("k7_subsample_windows", K7_SQL, ("windows",))
def k7(t):
    from ..operators.ordering import positions
    from .detection import windows

    w = windows(t).select("container", "object_id", "window_index", F.substring_index("object_id", ":", -1).cast("int").alias("ord"))
    w = positions(w, ["container"], [F.col("ord"), F.col("window_index")]).withColumn("idx", F.col("pos") - 1)
    return K.object_bounds(K.subsample_windows(w, "container", "object_id", "idx", 100, 4), "container", "object_id")


K8_ROWS = "concat('p', o_custkey % 30) AS packer_id, o_orderkey AS apk_id, o_orderkey % 3 AS final_label_count, o_orderkey % 977 = 0 AS needs_manual_review, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice / 600000 END AS ratio"


@query(
    "k8_audit_sample",
    f"""WITH x AS (SELECT {K8_ROWS} FROM orders), ok AS (SELECT * FROM x WHERE final_label_count > 0 OR needs_manual_review), tg AS (SELECT greatest(4, least(60, ceil(count(*) * 0.1))) AS t FROM ok),
 rv AS (SELECT packer_id, apk_id, 0 AS p, 'needs_manual_review=true' AS why FROM ok WHERE needs_manual_review), rt AS (SELECT * FROM ok WHERE ratio IS NOT NULL AND ratio <> 0),
 lo AS (SELECT packer_id, apk_id FROM rt ORDER BY ratio, packer_id, apk_id LIMIT 1), hi AS (SELECT packer_id, apk_id FROM rt ORDER BY ratio DESC, packer_id DESC, apk_id DESC LIMIT 1),
 bs AS (SELECT * FROM rv UNION ALL SELECT *, 1, 'lowest non-zero payload_ratio (possible payload miss)' FROM lo UNION ALL SELECT *, 2, 'highest payload_ratio (degenerate boundary)' FROM hi WHERE (packer_id, apk_id) NOT IN (SELECT (packer_id, apk_id) FROM lo)),
 cv AS (SELECT packer_id, min(apk_id) AS apk_id, 3, concat('packer ''', packer_id, ''' coverage') FROM ok WHERE packer_id NOT IN (SELECT packer_id FROM bs) GROUP BY packer_id),
 pk AS (SELECT * FROM bs UNION ALL SELECT * FROM cv), tk AS (SELECT count(*) AS k FROM (SELECT DISTINCT packer_id, apk_id FROM pk)),
 po AS (SELECT packer_id, apk_id, row_number() OVER (ORDER BY md5(concat('0|', packer_id, '|', apk_id))) AS rn FROM ok WHERE NOT EXISTS (SELECT 1 FROM pk WHERE pk.packer_id = ok.packer_id AND pk.apk_id = ok.apk_id)),
 al AS (SELECT * FROM pk UNION ALL SELECT packer_id, apk_id, 4, 'random fill' FROM po, tg, tk WHERE rn <= t - k)
SELECT packer_id, apk_id, string_agg(why, '; ' ORDER BY p, why) AS rationale FROM al GROUP BY ALL""",
)
def k8(t):
    rows = t.orders.selectExpr(
        "concat('p', o_custkey % 30) AS packer_id", "o_orderkey AS apk_id", "o_orderkey % 3 AS final_label_count", "o_orderkey % 977 = 0 AS needs_manual_review", "CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice / 600000 END AS ratio"
    )
    return K.audit_sample(rows, 0.1, 4, 60)


@query(
    "k9_control_sets",
    """WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS y, o_orderpriority AS fam, o_custkey % 5 = 0 AS paired FROM orders), b AS (SELECT * FROM x WHERE y = 0 AND NOT paired), o AS (SELECT * FROM x WHERE y = 1 AND fam <> '5-LOW'),
 w AS (SELECT * FROM x WHERE y = 1 AND fam = '5-LOW'), r AS (SELECT *, row_number() OVER (ORDER BY fam, id) AS r FROM o),
 a AS (SELECT 'non_target' AS mode, id FROM b UNION ALL SELECT 'non_target', id FROM o UNION ALL SELECT 'add_target', id FROM b UNION ALL SELECT 'add_target', id FROM o UNION ALL SELECT 'add_target', id FROM w
   UNION ALL SELECT 'add_target_benign', id FROM b UNION ALL SELECT 'add_target_benign', id FROM o UNION ALL SELECT 'add_target_benign', id FROM w UNION ALL SELECT 'add_target_benign', id FROM x WHERE y = 0 AND paired
   UNION ALL SELECT 'other_positive_replay', id FROM b UNION ALL SELECT 'other_positive_replay', id FROM o UNION ALL SELECT 'other_positive_replay', id FROM r WHERE r <= (SELECT count(*) FROM w))
SELECT mode, count(*) AS n, count(DISTINCT id) AS distinct_n, sum(id)::BIGINT AS id_sum FROM a GROUP BY mode""",
)
def k9(t):
    x = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("y"), F.col("o_orderpriority").alias("fam"), (F.col("o_custkey") % 5 == 0).alias("paired"))
    out = None
    for mode in ("non_target", "add_target", "add_target_benign", "other_positive_replay"):
        d = K.control_training_set(x, mode, "fam", "y", "5-LOW", F.col("paired"), "id").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("distinct_n"), F.sum("id").alias("id_sum")
        ).withColumn("mode", F.lit(mode))
        out = d if out is None else out.unionByName(d)
    return out


