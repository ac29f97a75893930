"""Matching and fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import pair_key
from ..operators import matching as J
from .base import query
from .expressions import ID_SQL, PAIR_SQL


@query(
    "j6_fuse_scores",
    """WITH d AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, min(score) AS s, min(y) AS y FROM (SELECT *, round_even(l_discount * 10, 6) AS score, (l_returnflag = 'R')::INTEGER AS y FROM lineitem) GROUP BY ALL),
 a AS (SELECT * FROM d WHERE l_suppkey % 10 <> 1), b AS (SELECT * REPLACE (CASE WHEN l_suppkey % 10 = 3 THEN 1 - y ELSE y END AS y, s / 2 AS s) FROM d WHERE l_suppkey % 10 <> 2)
SELECT coalesce(CASE WHEN b.s IS NULL THEN 'only in first' WHEN a.s IS NULL THEN 'only in second' WHEN a.y <> b.y THEN 'labels differ' END, 'fused') AS problem, count(*) AS n, round_even(sum(a.s), 4) AS sum_a, round_even(sum(b.s), 4) AS sum_b
FROM a FULL JOIN b USING (l_orderkey, l_linenumber, l_suppkey, l_partkey) GROUP BY ALL""",
)
def j6(t):
    keys = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]
    d = t.lineitem.groupBy(*keys).agg(F.min(F.bround(F.col("l_discount") * 10, 6)).alias("score"), F.min((F.col("l_returnflag") == "R").cast("int")).alias("label_id"))
    flip = F.when(F.col("l_suppkey") % 10 == 3, 1 - F.col("label_id")).otherwise(F.col("label_id"))
    a = d.where("l_suppkey % 10 <> 1")
    b = d.where("l_suppkey % 10 <> 2").withColumns({"label_id": flip, "score": F.col("score") / 2})
    f = J.fuse_scores(a, b, keys)
    return f.groupBy(F.coalesce("problem", F.lit("fused")).alias("problem")).agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.sum("score_a"), 4).alias("sum_a"), F.bround(F.sum("score_b"), 4).alias("sum_b")
    )


IDX_SQL = "concat('org.', lower(p_type), '.', replace(p_name, ' ', ''), p_partkey)"
APP10 = "CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' ', p_partkey) WHEN 1 THEN upper(concat(p_name, p_partkey)) WHEN 2 THEN split_part(p_name, ' ', 2) ELSE concat('zz', p_partkey) END"


@query(
    "j10_resolve_names",
    f"""WITH idx AS (SELECT {IDX_SQL} AS package, p_partkey AS ordinal, regexp_replace(lower(concat(p_name, '-', p_partkey % 50)), '[^a-z0-9]', '', 'g') AS nn, regexp_replace(lower(string_split({IDX_SQL}, '.')[3]), '[^a-z0-9]', '', 'g') AS last FROM part),
 apps AS (SELECT DISTINCT {APP10} AS app FROM part), a AS (SELECT app, regexp_replace(lower(app), '[^a-z0-9]', '', 'g') AS needle FROM apps),
 pin AS (SELECT *, CASE app WHEN 'zz3' THEN 'org.x' WHEN 'zz7' THEN (SELECT package FROM idx WHERE ordinal = 5) END AS pin, CASE WHEN app = 'zz3' THEN 'override' WHEN app = 'zz7' THEN 'curated' WHEN app = 'ring' THEN 'blocked' END AS tier FROM a),
 c AS (SELECT app, package, ordinal, 1 AS p, 1.0e0 AS score FROM pin JOIN idx ON needle = nn WHERE tier IS NULL
   UNION ALL SELECT app, package, ordinal, 2, 0.8 FROM pin JOIN idx ON needle = last WHERE tier IS NULL
   UNION ALL SELECT app, package, ordinal, 3, length(needle) / length(nn) FROM pin JOIN idx ON contains(nn, needle) WHERE tier IS NULL AND needle <> ''),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app ORDER BY p, score DESC, ordinal) AS r FROM c) WHERE r = 1)
SELECT app, CASE WHEN tier IS NOT NULL THEN CASE WHEN pin IN (SELECT package FROM idx) THEN pin END ELSE b.package END AS package,
  CASE WHEN tier IS NOT NULL THEN CASE WHEN pin IN (SELECT package FROM idx) THEN tier ELSE 'unresolved' END ELSE coalesce(['exact', 'suffix', 'substring'][b.p], 'unresolved') END AS match_type,
  CASE WHEN tier IS NOT NULL THEN (coalesce(pin IN (SELECT package FROM idx), false))::INT::DOUBLE ELSE round_even(coalesce(b.score, 0), 6) END AS score
FROM pin LEFT JOIN b USING (app)""",
)
def j10(t):
    idx = t.part.select(F.expr(IDX_SQL).alias("package"), F.col("p_partkey").alias("ordinal"), F.expr("concat(p_name, '-', p_partkey % 50)").alias("name"))
    apps = t.part.select(F.expr(APP10).alias("app")).distinct()
    five = t.part.where("p_partkey = 5").select(F.expr(IDX_SQL).alias("p")).first()["p"]
    return J.resolve_names(apps, idx, {"zz3": "org.x"}, {"zz7": five}, ["ring"])


LOC_SQL = "CASE WHEN c_custkey % 3 = 0 THEN concat('customer#', lpad(concat('', c_custkey), 9, '0')) WHEN c_custkey % 3 = 1 THEN concat('p1/X', c_name, '_packed.apk') ELSE concat('none', c_custkey) END"


@query(
    "j11_find_counterparts",
    f"""WITH s AS (SELECT c_mktsegment AS packer, concat(c_name, '_v', c_custkey % 3) AS stem FROM customer), l AS (SELECT c_mktsegment AS packer, CASE WHEN c_custkey % 5 = 0 THEN concat(c_name, '_v', c_custkey % 3) ELSE {LOC_SQL} END AS location FROM customer),
 e AS (SELECT DISTINCT s.packer, s.stem FROM s JOIN l ON s.packer = l.packer AND s.stem = l.location),
 n AS (SELECT s.packer, s.stem, count(*) AS n, min(location) AS f FROM s JOIN l ON s.packer = l.packer AND contains(lower(location), lower(substr(stem, 1, 18))) GROUP BY ALL)
SELECT s.packer, s.stem, CASE WHEN e.stem IS NOT NULL THEN s.stem WHEN n.n = 1 THEN n.f END AS found FROM s LEFT JOIN e USING (packer, stem) LEFT JOIN n USING (packer, stem)""",
)
def j11(t):
    stem = F.expr("concat(c_name, '_v', c_custkey % 3)")
    s = t.customer.select(F.col("c_mktsegment").alias("packer"), stem.alias("stem"))
    loc = t.customer.select(F.col("c_mktsegment").alias("packer"), F.when(F.col("c_custkey") % 5 == 0, stem).otherwise(F.expr(LOC_SQL)).alias("location"))
    return J.find_counterparts(s, loc, 18)


@query(
    "j12_target_semi_join",
    "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)",
)
def j12(t):
    target = t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").join(target, "l_suppkey", "left_semi")


@query(
    "j13_carry_forward",
    """SELECT f.o_orderkey, f.o_orderstatus, coalesce(f.a, p.a) AS a, coalesce(f.b, p.b) AS b, p.note FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS b FROM orders) f
LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN -1 END::BIGINT AS a, 'old' AS b, concat('n', o_custkey) AS note FROM orders WHERE o_orderkey % 4 > 0) p USING (o_orderkey)""",
)
def j13(t):
    fresh = t.orders.select("o_orderkey", "o_orderstatus", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END").alias("a"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END").alias("b"))
    prior = t.orders.where("o_orderkey % 4 > 0").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 5 > 0 THEN -1L END").alias("a"), F.lit("old").alias("b"), F.expr("concat('n', o_custkey)").alias("note"))
    return J.carry_forward(fresh, prior, ["o_orderkey"], ["a", "b"], ["note"])


GRID_FAMS = ["AUTOMOBILE", "BUILDING", "ghost"]
GRID_SQL = """g AS (SELECT concat('n', c_nationkey, '_', c_custkey % 40) AS item, max(c_custkey) % 3 > 0 AS clean FROM customer GROUP BY 1),
 p AS (SELECT concat('n', c_nationkey, '_', c_custkey % 40) AS item, c_mktsegment AS family, max(c_acctbal) > 3000 AS confirmed FROM customer GROUP BY 1, 2),
 x AS (SELECT g.item, f.family, concat_ws('__', f.family, g.item) AS pair_id, CASE WHEN p.confirmed IS NULL THEN 'missing_packed' WHEN NOT clean THEN 'unpacked_not_clean' WHEN NOT p.confirmed THEN 'packed_not_confirmed' ELSE 'paired' END AS status
   FROM g CROSS JOIN (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'ghost']) AS family) f LEFT JOIN p ON p.item = g.item AND p.family = f.family)"""


def grid(t):
    item = F.expr("concat('n', c_nationkey, '_', c_custkey % 40)")
    items = t.customer.groupBy(item.alias("item")).agg((F.max("c_custkey") % 3 > 0).alias("clean"))
    packed = t.customer.groupBy(item.alias("item"), F.col("c_mktsegment").alias("family")).agg((F.max("c_acctbal") > 3000).alias("confirmed"))
    return J.pair_grid(items, GRID_FAMS, packed)


@query(
    "j14_pair_grid",
    f"WITH {GRID_SQL} SELECT *, CASE WHEN status <> 'missing_packed' THEN 'done' WHEN family = 'ghost' THEN 'manual_required' ELSE 'todo' END AS task FROM x",
)
def j14(t):
    return J.pair_tasks(grid(t), ["ghost"])


@query("j14_status_counts", f"WITH {GRID_SQL} SELECT status, family, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT status, '*', count(*) FROM x GROUP BY status")
def j14_counts(t):
    return J.status_counts(grid(t))


@query(
    "j15_opposite_partners",
    f"""WITH b AS (SELECT c_custkey AS bag_id, (c_custkey % 3 = 0)::INTEGER AS label, split_part({PAIR_SQL}, '_', 1) AS pair_key FROM (SELECT c_custkey, {ID_SQL} AS i FROM customer)),
 g AS (SELECT pair_key, 1 - label AS label, count(*) AS n, min(bag_id) AS f FROM b GROUP BY ALL)
SELECT bag_id, label, pair_key, coalesce(n, 0) AS partner_count, f AS first_partner FROM b LEFT JOIN g USING (pair_key, label)""",
)
def j15(t):
    b = t.customer.select(F.col("c_custkey").alias("bag_id"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END").alias("label"), F.expr(ID_SQL).alias("i"))
    return J.opposite_partners(b, F.substring_index(pair_key(F.col("i")), "_", 1))


@query(
    "j16_anchor_positive_pairs",
    """SELECT a.vec_id // 2 AS pair, a.label AS anchor_family, b.label AS positive_family, round_even(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), 5) AS dot
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0""",
)
def j16(t):
    v = t.embeddings.select(F.expr("vec_id div 2").alias("pair"), (F.col("vec_id") % 2).alias("side"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    p = J.anchor_positive_pairs(v, "pair", "side", "embedding", "label").where("problem IS NULL")
    dot = F.aggregate(F.zip_with("anchor", "positive", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return p.select("pair", "anchor_family", "positive_family", F.bround(dot, 5).alias("dot"))


@query(
    "j17_unique_owner",
    """WITH o AS (SELECT md5(text) AS k, min(source) AS owner FROM (SELECT DISTINCT text, source FROM documents) GROUP BY 1 HAVING count(*) = 1)
SELECT doc_id, owner FROM documents LEFT JOIN o ON md5(text) = k""",
)
def j17(t):
    rows = t.documents.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("k"), F.col("source").alias("owner"))
    return J.remap_unique_owner(rows.select("doc_id", "k"), rows, "k", "owner").select("doc_id", "owner")


STEM_SQL = (
    "concat(replace(p_name, ' ', ''), '_', p_partkey % 90, CASE p_partkey % 7 WHEN 0 THEN '_unsign_sign' WHEN 1 THEN '_208_jiagu_sign' WHEN 2 THEN '_kiwi_sign' "
    "WHEN 3 THEN '_legu_signed' WHEN 4 THEN '_extra' WHEN 5 THEN '' ELSE '_9_other' END)"
)
ORG_SQL = "concat(replace(p_name, ' ', ''), '_', p_partkey % 60)"


@query(
    "j18_match_origins",
    f"""WITH o AS (SELECT DISTINCT {ORG_SQL} AS origin FROM part), p AS (SELECT DISTINCT {STEM_SQL} AS stem FROM part),
 c AS (SELECT stem, 0 AS p, substr(stem, 1, length(stem) - 12) AS cand FROM p WHERE suffix(stem, '_unsign_sign') UNION ALL SELECT stem, 1, substr(stem, 1, length(stem) - 12) FROM p WHERE suffix(stem, '_legu_signed')
   UNION ALL SELECT stem, 10, regexp_replace(split_part(stem, '_jiagu_sign', 1), '_[0-9]+$', '') FROM p WHERE contains(stem, '_jiagu_sign')
   UNION ALL SELECT stem, 12, regexp_replace(split_part(stem, '_kiwi_sign', 1), '_[0-9]+$', '') FROM p WHERE contains(stem, '_kiwi_sign')),
 m AS (SELECT stem, p, origin FROM c JOIN o ON cand = origin UNION ALL SELECT stem, 100, origin FROM p JOIN o ON starts_with(stem, origin)
   UNION ALL SELECT stem, 200, origin FROM p JOIN o ON starts_with(stem, split_part(origin, '_', 1))),
 b AS (SELECT stem, origin FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY p, length(origin) DESC, origin) AS r FROM m) WHERE r = 1)
SELECT stem, origin FROM p LEFT JOIN b USING (stem)""",
)
def j18(t):
    return J.match_origins(t.part.select(F.expr(STEM_SQL).alias("stem")).distinct(), t.part.select(F.expr(ORG_SQL).alias("origin")).distinct())


@query(
    "j19_discover_pairs",
    """WITH r AS (SELECT n_name AS packer_id, CASE n_nationkey % 3 WHEN 0 THEN 'open_source' WHEN 1 THEN 'commercial' ELSE 'registered_not_patched' END AS grp FROM nation),
 p AS (SELECT DISTINCT concat('NATION_', p_partkey % 25) AS packer_id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS stem FROM part),
 b AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '-') ELSE p_name END AS base_name FROM part WHERE p_size < 20),
 s AS (SELECT regexp_replace(lower(base_name), '[^a-z0-9]+', '_', 'g') AS slug, min(base_name) AS near FROM b GROUP BY 1)
SELECT packer_id, grp, stem, coalesce(b.base_name, near) AS base_name FROM p JOIN r USING (packer_id) LEFT JOIN b ON b.base_name = stem LEFT JOIN s ON slug = regexp_replace(lower(stem), '[^a-z0-9]+', '_', 'g')
WHERE grp <> 'registered_not_patched' AND coalesce(b.base_name, near) IS NOT NULL""",
)
def j19(t):
    reg = t.nation.select(F.col("n_name").alias("packer_id"), F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'open_source' WHEN 1 THEN 'commercial' ELSE 'registered_not_patched' END").alias("grp"))
    packed = t.part.select(F.expr("concat('NATION_', p_partkey % 25)").alias("packer_id"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END").alias("stem")).distinct()
    base = t.part.where("p_size < 20").select(F.expr("CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '-') ELSE p_name END").alias("base_name")).distinct()
    return J.discover_pairs(reg, packed, base)
