"""Snapshot diff, rule labelling and reconciliation queries.

Neighbouring document sources (2k, 2k+1) act as old and new snapshot of pair k;
members are named by their rank within (source, lang).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide as V
from ..operators import diff as D
from ..operators import rules as R
from ..operators.ordering import materialize, positions
from . import base
from .base import dealt, query
from .detection import labelled

NUM = "CAST(regexp_replace(source, '[^0-9]', '') AS INT)"


def members(t):
    if "_members" not in t.__dict__:
        t.__dict__["_members"] = build_members(t)
    return t.__dict__["_members"]


def build_members(t):
    docs = dealt(t.documents).select("doc_id", "source", "lang", F.encode("text", "UTF-8").alias("content"))
    ids = docs.select("doc_id", "source", "lang")
    placed = positions(ids, ["source", "lang"], [F.col("doc_id")])
    num = F.expr(NUM)
    named = placed.select(
        "doc_id", F.floor(num / 2).cast("int").alias("pair_id"), (num % 2).alias("side"),
        F.concat("lang", F.lit("/m"), F.lpad(F.col("pos").cast("string"), 6, "0"), F.expr("CASE pos % 4 WHEN 0 THEN '.dex' WHEN 1 THEN '.so' WHEN 2 THEN '.dat' ELSE '' END")).alias("name"),
    )
    return named.join(docs.select("doc_id", "content"), "doc_id").select(
        "pair_id", "side", "name", F.length("content").alias("size"), F.sha2("content", 256).alias("sha256"), "content"
    )


def sides(t):
    m = members(t)
    return m.where("side = 0").drop("side"), m.where("side = 1").drop("side")


base.CTE |= {
    "members": """
  SELECT (n // 2)::INTEGER AS pair_id, n % 2 AS side, concat(lang, '/m', lpad(pos::VARCHAR, 6, '0'), CASE pos % 4 WHEN 0 THEN '.dex' WHEN 1 THEN '.so' WHEN 2 THEN '.dat' ELSE '' END) AS name,
    octet_length(encode(text))::INTEGER AS size, sha256(text) AS sha256, hex(encode(text)) AS hx
  FROM (SELECT *, regexp_replace(source, '[^0-9]', '', 'g')::INTEGER AS n, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS pos FROM documents)""",
    "olds": "SELECT * FROM members WHERE side = 0",
    "news": "SELECT * FROM members WHERE side = 1",
    "mapped": """
  SELECT pair_id, CASE WHEN o.sha256 = n.sha256 THEN 'unchanged' ELSE 'byte_modified' END AS branch, name AS new_name, name AS old_name, n.size AS new_size, o.size AS old_size,
    n.sha256 AS new_sha256, o.sha256 AS old_sha256 FROM news n JOIN olds o USING (pair_id, name)
  UNION ALL
  SELECT pair_id, CASE WHEN new_name IS NOT NULL AND old_name IS NOT NULL THEN 'renamed' WHEN new_name IS NOT NULL THEN 'new_in_packed' ELSE 'removed' END, new_name, old_name, new_size, old_size,
    CASE WHEN new_name IS NOT NULL THEN sha256 END, CASE WHEN old_name IS NOT NULL THEN sha256 END
  FROM (SELECT pair_id, sha256, name AS new_name, size AS new_size, row_number() OVER (PARTITION BY pair_id, sha256 ORDER BY name) AS k FROM news n
        WHERE NOT EXISTS (SELECT 1 FROM olds o WHERE o.pair_id = n.pair_id AND o.name = n.name)) a
  FULL JOIN (SELECT pair_id, sha256, name AS old_name, size AS old_size, row_number() OVER (PARTITION BY pair_id, sha256 ORDER BY name) AS k FROM olds o
        WHERE NOT EXISTS (SELECT 1 FROM news n WHERE o.pair_id = n.pair_id AND o.name = n.name)) b USING (pair_id, sha256, k)""",
    # changed ranges of modified members, 256-byte blocks
    "cranges": """
  SELECT pair_id, name, min(s) AS s, max(e) AS e FROM (
    SELECT pair_id, name, s, e, sum(f) OVER (PARTITION BY pair_id, name ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN s > lag(e) OVER (PARTITION BY pair_id, name ORDER BY s) THEN 1 ELSE 0 END AS f FROM (
        SELECT pair_id, name, min(k) AS s, max(k) + 1 AS e FROM (
          SELECT pair_id, name, blk, unnest(list_filter(range(256 * blk, least(256 * blk + 256, m)), lambda k: nx[2 * (k - 256 * blk) + 1:2 * (k - 256 * blk) + 2] <> ox[2 * (k - 256 * blk) + 1:2 * (k - 256 * blk) + 2])) AS k
          FROM (SELECT pair_id, name, m, blk, substr(nh, 512 * blk + 1, 512) AS nx, substr(oh, 512 * blk + 1, 512) AS ox
                FROM (SELECT n.pair_id, n.name, n.hx AS nh, o.hx AS oh, least(n.size, o.size) AS m, unnest(range(0, (least(n.size, o.size) + 255) // 256)) AS blk FROM news n JOIN olds o USING (pair_id, name) WHERE n.sha256 <> o.sha256))
          WHERE nx <> ox)
        GROUP BY pair_id, name, blk
        UNION ALL SELECT pair_id, n.name, o.size, n.size FROM news n JOIN olds o USING (pair_id, name) WHERE n.sha256 <> o.sha256 AND n.size > o.size)))
  GROUP BY pair_id, name, g""",
    "changed": """
  SELECT m.*, CASE WHEN branch = 'new_in_packed' THEN new_size WHEN branch = 'byte_modified' THEN coalesce(c, 0) ELSE 0 END::BIGINT AS changed_bytes
  FROM mapped m LEFT JOIN (SELECT pair_id, name AS new_name, sum(e - s) AS c FROM cranges GROUP BY ALL) USING (pair_id, new_name)""",
    "dsum": """
  SELECT pair_id, coalesce(sum(new_size), 0)::BIGINT AS total_bytes, sum(changed_bytes)::BIGINT AS changed_bytes, count(*) FILTER (branch = 'unchanged') AS n_unchanged,
    count(*) FILTER (branch = 'byte_modified') AS n_byte_modified, count(*) FILTER (branch = 'new_in_packed') AS n_new_in_packed, count(*) FILTER (branch = 'removed') AS n_removed,
    count(*) FILTER (branch = 'renamed') AS n_renamed FROM changed GROUP BY pair_id""",
}
base.DEPENDS |= {
    "olds": ("members",), "news": ("members",), "mapped": ("olds", "news"), "cranges": ("olds", "news"), "changed": ("mapped", "cranges"), "dsum": ("changed",),
}


def changed(t):
    """Member mapping with ranges (no contents), evaluated once per query."""
    if "_changed" not in t.__dict__:
        old, new = sides(t)
        t.__dict__["_changed"] = materialize(D.changed_ranges(D.snapshot_members(old, new), old, new, 256))
    return t.__dict__["_changed"]


@query("j2_snapshot_members", "SELECT * FROM mapped WHERE branch <> 'renamed'", ("mapped",))
def j2(t):
    return D.snapshot_members(*sides(t)).where("branch <> 'renamed'")


@query(
    "j3_renamed_members",
    "SELECT pair_id, branch, count(*) AS n, sum(CASE WHEN branch = 'renamed' THEN hash_check END)::BIGINT AS renamed_bytes FROM (SELECT *, new_size AS hash_check FROM mapped) GROUP BY ALL",
    ("mapped",),
)
def j3(t):
    m = D.snapshot_members(*sides(t))
    return m.groupBy("pair_id", "branch").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("branch") == D.RENAMED, F.col("new_size"))).alias("renamed_bytes")
    )


@query("i6_block_diff", 'SELECT pair_id, name, s AS "start", e AS "end" FROM cranges', ("cranges",))
def i6(t):
    return changed(t).where(F.col("branch") == D.MODIFIED).select("pair_id", F.col("new_name").alias("name"), F.inline("diff_ranges"))


@query(
    "i8_diff_summary",
    """SELECT *, round_even(coalesce(changed_bytes / nullif(total_bytes, 0), 0), 6) AS changed_ratio, coalesce(changed_bytes / nullif(total_bytes, 0), 0) > 0.95 AS degenerate,
  total_bytes > 0 AND n_unchanged + n_byte_modified + n_renamed = 0 AS alignment_failed FROM dsum""",
    ("dsum",),
)
def i8(t):
    return D.diff_summary(changed(t))


NEW_RULES = [(r"^en/.*\.dex$", "payload_container"), (r"\.so$", "payload_container"), (r"\.dat$", "benign_loader")]


def diff_label_rows(t, include=True):
    _, new = sides(t)
    c = changed(t)
    fam = F.concat(F.lit("packer_"), F.col("pair_id").cast("string"))
    return D.diff_labels(c, D.diff_summary(c), fam, new, R.rule_policy(NEW_RULES), include_degenerate=include)


base.CTE["dlabels"] = """
  SELECT pair_id, name AS object_path, s AS offset_start, e AS offset_end, sha256(unhex(substr(hx, 2 * s + 1, 2 * (e - s)))) AS payload_sha256
  FROM (SELECT r.pair_id, r.name, r.s, r.e, n.hx FROM cranges r JOIN news n USING (pair_id, name)
        UNION ALL SELECT pair_id, new_name, 0, new_size, hx FROM mapped m JOIN news n USING (pair_id) WHERE n.name = m.new_name AND branch = 'new_in_packed'
          AND (regexp_matches(new_name, '^en/.*[.]dex$') OR regexp_matches(new_name, '[.]so$')) AND new_size > 0)
  WHERE pair_id NOT IN (SELECT pair_id FROM dsum WHERE total_bytes > 0 AND n_unchanged + n_byte_modified + n_renamed = 0)"""
base.DEPENDS["dlabels"] = ("dsum",)


@query(
    "i9_diff_labels",
    "SELECT *, 'hidden_executable_payload' AS label, concat('packer_', pair_id) AS transform_family FROM dlabels",
    ("dlabels",),
)
def i9(t):
    return diff_label_rows(t)


# near pairs (nn, oo, score) of members that neither name nor content matches
NEAR = """WITH h AS (SELECT pair_id, side, name, size, b, count(*) AS c FROM (SELECT pair_id, side, name, size, unnest(list_transform(range(0, size), lambda k: ('0x' || substr(hx, 2 * k + 1, 2))::INTEGER)) AS b FROM members WHERE size > 0) GROUP BY ALL),
 un AS (SELECT pair_id, new_name AS name, 1 AS side FROM mapped WHERE branch = 'new_in_packed' UNION ALL SELECT pair_id, old_name, 0 FROM mapped WHERE branch = 'removed'),
 u AS (SELECT m.* FROM members m JOIN un USING (pair_id, name, side)),
 cand AS (SELECT n.pair_id, n.name AS nn, o.name AS oo, n.size AS ns, o.size AS os, abs(log2(greatest(n.size, 1)) - log2(greatest(o.size, 1))) AS g FROM u n JOIN u o ON n.pair_id = o.pair_id AND n.side = 1 AND o.side = 0
          WHERE abs(log2(greatest(n.size, 1)) - log2(greatest(o.size, 1))) < 2),
 l AS (SELECT pair_id, nn, oo, g, sum(abs(p)) AS d FROM (SELECT pair_id, nn, oo, g, b, sum(p) AS p FROM (
        SELECT c.pair_id, nn, oo, g, b, h.c / ns AS p FROM cand c JOIN h ON h.pair_id = c.pair_id AND h.side = 1 AND h.name = nn
        UNION ALL SELECT c.pair_id, nn, oo, g, b, -h.c / os FROM cand c JOIN h ON h.pair_id = c.pair_id AND h.side = 0 AND h.name = oo) GROUP BY ALL) GROUP BY ALL),
 s AS (SELECT pair_id, nn, oo, round_even(g + 2 * d, 6) AS score FROM l WHERE round_even(g + 2 * d, 6) < 2),"""


@query(
    "j4_fuzzy_matches",
    NEAR
    + """
 r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, nn ORDER BY score, oo) AS a, row_number() OVER (PARTITION BY pair_id, oo ORDER BY score, nn) AS b FROM s)
SELECT pair_id, nn AS new_name, oo AS old_name, score FROM r WHERE a = 1 AND b = 1""",
    ("mapped",),
)
def j4(t):
    old, new = sides(t)
    m = D.snapshot_members(old, new)
    n_keys = m.where(F.col("branch") == D.NEW).select("pair_id", F.col("new_name").alias("name"))
    o_keys = m.where(F.col("branch") == D.REMOVED).select("pair_id", F.col("old_name").alias("name"))
    free_new = D.with_profile(new.join(n_keys, ["pair_id", "name"], "left_semi"))
    free_old = D.with_profile(old.join(o_keys, ["pair_id", "name"], "left_semi"))
    return D.fuzzy_matches(free_new, free_old)


MAGNITUDE = """WITH h AS (SELECT pair_id, side, name, size, b, count(*) AS c FROM (SELECT pair_id, side, name, size, unnest(list_transform(range(0, size), lambda k: ('0x' || substr(hx, 2 * k + 1, 2))::INTEGER)) AS b FROM members WHERE size > 0) GROUP BY ALL),
 e AS (SELECT pair_id, side, name, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM h GROUP BY ALL),
 l AS (SELECT pair_id, name, sum(abs(p)) AS d FROM (SELECT n.pair_id, n.name, b, sum(CASE WHEN h.side = 1 THEN h.c / h.size ELSE -h.c / h.size END) AS p FROM news n JOIN olds o USING (pair_id, name) JOIN h ON h.pair_id = n.pair_id AND h.name = n.name GROUP BY ALL) GROUP BY ALL),
 j AS (SELECT n.pair_id, n.name, n.size AS ns, o.size AS os, n.sha256 AS a, o.sha256 AS b, abs(coalesce(x.e, 0) - coalesce(y.e, 0)) AS ed, n.size / greatest(o.size, 1) AS r, l.d, n.pair_id IN (SELECT pair_id FROM olds) AS known
   FROM news n LEFT JOIN olds o USING (pair_id, name) LEFT JOIN e x ON x.pair_id = n.pair_id AND x.name = n.name AND x.side = 1 LEFT JOIN e y ON y.pair_id = n.pair_id AND y.name = n.name AND y.side = 0 LEFT JOIN l ON l.pair_id = n.pair_id AND l.name = n.name),
 s AS (SELECT *, CASE WHEN NOT known THEN 'unknown' WHEN b IS NULL THEN 'new' WHEN a = b THEN 'unchanged' ELSE 'modified' END AS status FROM j)
SELECT pair_id, name, status, round_even(CASE status WHEN 'unknown' THEN 0.5 WHEN 'new' THEN 1 WHEN 'unchanged' THEN 0 ELSE greatest(least(0.3e0 * least(abs(log2(greatest(r, 0.01))) / 3, 1) + 0.3e0 * least(ed / 4, 1) + 0.4e0 * least(d / 1.5e0, 1), 0.9e0), 0.1e0) END, 6) AS diff_score,
  CASE WHEN os IS NULL THEN 1 WHEN ed > 2 OR r > 2 OR r < 0.3 THEN 0.8 WHEN ns <> os THEN 0.3 ELSE 0 END::DOUBLE AS coarse_score,
  round_even(CASE status WHEN 'modified' THEN d WHEN 'new' THEN 2 ELSE 0 END, 6) AS histogram_distance FROM s"""


@query("j5_diff_magnitude", MAGNITUDE, ("olds", "news"))
def j5(t):
    old, new = sides(t)
    return D.diff_magnitude(D.with_profile(new), D.with_profile(old))


# all candidates of a pair_id by (score, nn, oo), each taken unless one of its members is
GREEDY = NEAR + """
 q AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score, nn, oo) AS k FROM s),
 walk AS (
  SELECT pair_id, k, [nn] AS un, [oo] AS uo, true AS took FROM q WHERE k = 1
  UNION ALL
  SELECT q.pair_id, q.k, CASE WHEN list_contains(un, nn) OR list_contains(uo, oo) THEN un ELSE list_append(un, nn) END,
    CASE WHEN list_contains(un, nn) OR list_contains(uo, oo) THEN uo ELSE list_append(uo, oo) END, NOT (list_contains(un, nn) OR list_contains(uo, oo))
  FROM walk w JOIN q ON q.pair_id = w.pair_id AND q.k = w.k + 1),
 greedy AS (SELECT pair_id, nn AS new_name, oo AS old_name, score FROM q JOIN walk USING (pair_id, k) WHERE took)"""
ALIGNED = GREEDY + """,
 partners AS (SELECT pair_id, new_name, old_name FROM mapped WHERE new_name IS NOT NULL AND old_name IS NOT NULL UNION ALL SELECT pair_id, new_name, old_name FROM greedy),
 aolds AS (SELECT o.* REPLACE (p.new_name AS name) FROM olds o JOIN partners p ON p.pair_id = o.pair_id AND p.old_name = o.name),
 amembers AS (SELECT * FROM news UNION ALL SELECT * FROM aolds)"""


@query("j4_greedy_matches", GREEDY + " SELECT * FROM greedy", ("mapped",))
def j4_greedy(t):
    old, new = sides(t)
    m = materialize(D.snapshot_members(old, new))
    n_keys = m.where(F.col("branch") == D.NEW).select("pair_id", F.col("new_name").alias("name"))
    o_keys = m.where(F.col("branch") == D.REMOVED).select("pair_id", F.col("old_name").alias("name"))
    free_new = D.with_profile(new.join(n_keys, ["pair_id", "name"], "left_semi"))
    free_old = D.with_profile(old.join(o_keys, ["pair_id", "name"], "left_semi"))
    return D.greedy_matches(free_new, free_old)


@query(
    "j5_aligned_magnitude",
    f"{ALIGNED} SELECT * FROM ({MAGNITUDE.replace('FROM members', 'FROM amembers').replace('JOIN olds o', 'JOIN aolds o')})",
    ("olds", "news", "mapped"),
)
def j5_aligned(t):
    old, new = map(D.with_profile, sides(t))
    return D.diff_magnitude(new, old, D.member_mapping(new, old))


for _name in ("j4_greedy_matches", "j5_aligned_magnitude"):
    base.ORACLES[_name] = base.ORACLES[_name].replace("WITH ", "WITH RECURSIVE ", 1)


PART_RULES = [
    R.Rule("r_red", "^red ", offset_end=-1), R.Rule("r_ring", "ring$", label="benign_loader", payload_kind="shim", offset_start=2, offset_end=4),
    R.Rule("r_s", "^s", payload_kind="native_stub"), R.Rule("r_wid", "widg[e]t", transform_family="packer_w"),
]


def rules_sql(src: str, path: str, size: str, rules) -> str:
    out = []
    for i, r in enumerate(rules):
        end = size if r.offset_end == R.FILE_SIZE else (str(r.offset_end) if r.offset_end >= 0 else f"{size} + ({r.offset_end})")
        out.append(
            f"SELECT *, {i} AS rule_order, '{r.rule_id}' AS rule_id, '{r.label}' AS label, '{r.payload_kind}' AS payload_kind, '{r.transform_family}' AS transform_family, "
            f"{r.offset_start}::BIGINT AS offset_start, ({end})::BIGINT AS offset_end FROM {src} WHERE regexp_matches({path}, '{r.pattern}')"
        )
    return " UNION ALL ".join(out)


@query("j7_all_matching_rules", rules_sql("(SELECT p_partkey, p_name, length(p_name) AS size FROM part)", "p_name", "size", PART_RULES))
def j7(t):
    return R.match_all_rules(t.part.select("p_partkey", "p_name", F.length("p_name").cast("bigint").alias("size")), PART_RULES, "p_name")


URL_RULES = [("/en/", "english"), ("^https", "secure"), ("[.]html$", "page"), ("utm_", "tracked")]


@query(
    "j8_first_matching_rule",
    "SELECT page_id, CASE WHEN regexp_matches(url, '/en/') THEN 'english' WHEN regexp_matches(url, '^https') THEN 'secure' WHEN regexp_matches(url, '[.]html$') THEN 'page' WHEN regexp_matches(url, 'utm_') THEN 'tracked' ELSE 'unknown' END AS cls FROM pages",
)
def j8(t):
    return t.pages.select("page_id", R.first_rule(F.col("url"), URL_RULES).alias("cls"))


HIT_FAMILIES = {"Small Ring": "Ring", "widget": "Widget", "red": "Red", " blue ": "Blue"}


@query(
    "j9_family_of_hit",
    """SELECT p_partkey, CASE WHEN k = 'small ring' THEN 'Ring' WHEN k = 'widget' THEN 'Widget' WHEN k = 'red' THEN 'Red' WHEN k = 'blue' THEN 'Blue'
  WHEN contains(k, 'small ring') THEN 'Ring' WHEN contains(k, 'widget') THEN 'Widget' WHEN contains(k, 'red') THEN 'Red' WHEN contains(k, 'blue') THEN 'Blue' END AS family
FROM (SELECT p_partkey, lower(p_name) AS k FROM part)""",
)
def j9(t):
    return t.part.select("p_partkey", R.family_of_hit(F.initcap(F.concat(F.lit(" "), "p_name", F.lit(" "))), HIT_FAMILIES).alias("family"))


# ---- additive rule scorer ------------------------------------------------------------------

EXT_SQL = ", ".join(repr(e) for e in R.BENIGN_EXTENSIONS)
base.CTE["robj"] = f"""
  SELECT container, object_id, object_path, max(offset_end) - min(offset_start) AS object_size, min(offset_start) AS s, max(offset_end) AS e, count(*) AS window_count, sum(label_id)::BIGINT AS positive_window_count,
    min(printable_ratio) AS low, starts_with(lower(object_path), 'classes') OR starts_with(lower(object_path), 'lib/') AS code,
    starts_with(lower(object_path), 'assets/') OR starts_with(lower(object_path), 'res/raw/') AS susp,
    regexp_extract(lower(object_path), '([.][^./]*)$', 1) NOT IN ({EXT_SQL}) AS unk FROM labelled GROUP BY container, object_id, object_path"""
base.CTE["rscore"] = """
  SELECT *, round_even(CASE WHEN NOT code AND susp THEN 0.6e0 ELSE 0 END + CASE WHEN NOT code AND unk THEN 0.6e0 ELSE 0 END + CASE WHEN NOT code AND object_size >= 4096 THEN 0.4e0 ELSE 0 END + CASE WHEN NOT code AND low <= 0.1 THEN 0.4e0 ELSE 0 END, 6) AS score,
    list_filter([CASE WHEN NOT code AND susp THEN 'suspicious_path' END, CASE WHEN NOT code AND unk THEN 'unknown_extension' END, CASE WHEN NOT code AND object_size >= 4096 THEN 'large_object' END,
      CASE WHEN NOT code AND low <= 0.1 THEN 'low_printable_region' END], lambda x: x IS NOT NULL) AS rules FROM robj"""
base.DEPENDS |= {"robj": ("labelled",), "rscore": ("robj",)}


@query(
    "a4_additive_rule_scores",
    """SELECT container, object_id, object_path, object_size, score, (score >= 1)::INTEGER AS predicted_label_id, (positive_window_count > 0)::INTEGER AS true_label_id, window_count, positive_window_count,
  CASE WHEN score >= 1 THEN window_count ELSE 0 END AS predicted_window_count, CASE WHEN score >= 1 THEN s END AS predicted_offset_start, CASE WHEN score >= 1 THEN e END AS predicted_offset_end,
  array_to_string(rules, ',') AS triggered_rules FROM rscore""",
    ("rscore",),
)
def a4(t):
    return R.additive_rule_scores(labelled(t)).withColumn("triggered_rules", F.array_join("triggered_rules", ","))


@query(
    "a4_rule_trigger_counts",
    "SELECT rule, count(*) AS objects FROM (SELECT unnest(rules) AS rule FROM rscore) GROUP BY rule",
    ("rscore",),
)
def a4_counts(t):
    return R.rule_trigger_counts(R.additive_rule_scores(labelled(t)))


@query(
    "a4_window_decisions",
    "SELECT l.container, window_id, score, (score >= 1)::INTEGER AS predicted_label_id FROM labelled l JOIN rscore r USING (container, object_id)",
    ("rscore",),
)
def a4_windows(t):
    w = labelled(t)
    d = R.broadcast_object_decision(w, R.additive_rule_scores(w))
    return d.select("container", "window_id", "score", "predicted_label_id")


# ---- detector hits from events --------------------------------------------------------------


def scans(t):
    """One detector result per user: JSON text built from the user's events."""
    per = t.events.groupBy("user_id", "event_type").agg(F.sort_array(F.collect_set(F.concat(F.lit("h"), F.floor(F.col("value") / 20).cast("string")))).alias("hits"))
    files = per.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "hits")))).alias("matches"))
    js = F.to_json(F.struct(F.array(F.struct(F.lit("classes.dex").alias("filename"), "matches")).alias("files")))
    raw = files.select("user_id", F.when(F.col("user_id") % 10 == 3, "{broken").otherwise(js).alias("report"), (F.col("user_id") % 2).cast("int").alias("true_label_id"))
    return R.parse_detector_json(raw, "report")


base.CTE["hits"] = """
  SELECT DISTINCT user_id, event_type AS category, concat('h', floor(value / 20)::BIGINT) AS hit FROM events WHERE event_type IN ('error', 'signup') AND user_id % 10 <> 3"""
base.CTE["dscore"] = """
  SELECT user_id, coalesce(n, 0) AS score, (user_id % 10 <> 3 AND coalesce(n, 0) >= 9)::INTEGER AS predicted_label_id, (user_id % 2)::INTEGER AS true_label_id, coalesce(f, []) AS fams, user_id % 10 <> 3 AS scan_ok
  FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT user_id, count(*) AS n, list_sort(list(DISTINCT hit)) AS f FROM hits GROUP BY user_id) USING (user_id)"""
base.DEPENDS["dscore"] = ("hits",)


@query(
    "a5_detector_scores",
    "SELECT user_id, score, predicted_label_id, true_label_id, array_to_string(fams, ',') AS detected_families, scan_ok FROM dscore",
    ("dscore",),
)
def a5(t):
    return R.detector_scores(scans(t), "user_id", ("error", "signup"), 9).withColumn("detected_families", F.array_join("detected_families", ","))


@query("a5_family_histogram", "SELECT family, count(*) AS containers FROM (SELECT unnest(fams) AS family FROM dscore) GROUP BY family", ("dscore",))
def a5_hist(t):
    return R.family_histogram(R.detector_scores(scans(t), "user_id", ("error", "signup"), 9))


# ---- validation and decisions ---------------------------------------------------------------


@query(
    "v1_record_violations",
    """SELECT * FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice <= 2000 THEN 'price too low' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'bad status' END,
  CASE WHEN year(o_orderdate) < 1995 THEN 'too old' END], lambda x: x IS NOT NULL)) AS message FROM orders)""",
)
def v1(t):
    rules = {"price too low": F.col("o_totalprice") <= 2000, "bad status": ~F.col("o_orderstatus").isin("O", "F"), "too old": F.year("o_orderdate") < 1995}
    return V.violations(t.orders, ["o_orderkey"], rules)


REC_SPARK = {
    "payload_kind": "CASE l_linenumber WHEN 1 THEN 'encrypted_dex' WHEN 2 THEN 'shim' WHEN 3 THEN 'odd' ELSE 'native_stub' END",
    "offset_start": "CAST(l_quantity AS BIGINT)", "offset_end": "CAST(l_extendedprice / 1000 AS BIGINT)",
    "transform_family": "CASE WHEN l_returnflag = 'A' THEN 'other' ELSE 'packer_x' END",
    "label_source": "CASE WHEN l_tax > 0.07 THEN 'guess' ELSE 'rule_based' END",
    "object_path": "CASE WHEN l_suppkey % 50 = 0 THEN NULL ELSE l_linestatus END",
}


@query(
    "v2_label_record_violations",
    "SELECT message, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN object_path IS NULL THEN 'missing object_path' END, CASE WHEN payload_kind = 'odd' THEN 'unknown payload_kind' END, CASE WHEN e < s THEN 'offset_end before offset_start' END, "
    "CASE WHEN NOT starts_with(transform_family, 'packer_') THEN 'transform_family without packer_ prefix' END, CASE WHEN label_source = 'guess' THEN 'unknown label_source' END], lambda x: x IS NOT NULL)) AS message FROM (SELECT "
    + ", ".join(f"{v} AS {k}" for k, v in REC_SPARK.items() if not k.startswith("offset"))
    + ", trunc(l_quantity)::BIGINT AS s, trunc(l_extendedprice / 1000)::BIGINT AS e FROM lineitem)) GROUP BY message",
)
def v2(t):
    rec = t.lineitem.select("l_orderkey", *[F.expr(v).alias(k) for k, v in REC_SPARK.items()])
    bad = V.violations(rec, ["l_orderkey"], V.label_record_rules(["object_path"]))
    return bad.groupBy("message").agg(F.count(F.lit(1)).alias("n"))


MEMBER_RULES = [R.Rule("dex", r"[.]dex$", offset_start=16), R.Rule("so", r"[.]so$", label="benign_loader", offset_end=-8), R.Rule("en", r"^en/.*[.]dat$", offset_end=64)]


def rule_label_rows(t):
    _, new = sides(t)
    hits = R.match_all_rules(new.select("pair_id", F.col("name").alias("object_path"), "size"), MEMBER_RULES)
    kept = hits.where((F.col("label") == "hidden_executable_payload") & (F.col("offset_end") > F.col("offset_start")))
    return kept.select("pair_id", "object_path", F.col("offset_start").alias("start"), F.col("offset_end").alias("end"))


base.CTE["rlabels"] = f"""
  SELECT pair_id, object_path, offset_start AS s, offset_end AS e FROM ({rules_sql("(SELECT pair_id, name AS object_path, size FROM news)", "object_path", "size", MEMBER_RULES)})
  WHERE label = 'hidden_executable_payload' AND offset_end > offset_start"""
base.CTE["agree"] = """
  SELECT pair_id, round_even(CASE WHEN sum(u) > 0 THEN sum(i) / sum(u) ELSE 1 END, 6) AS iou, count(*) AS objects FROM (
    SELECT pair_id, object_path, count(*) AS u, count(*) FILTER (a > 0 AND b > 0) AS i FROM (
      SELECT pair_id, object_path, pos, max(a) AS a, max(b) AS b FROM (
        SELECT pair_id, object_path, unnest(range(s, e)) AS pos, 1 AS a, 0 AS b FROM rlabels UNION ALL SELECT pair_id, object_path, unnest(range(offset_start, offset_end)), 0, 1 FROM dlabels) GROUP BY ALL) GROUP BY ALL) GROUP BY pair_id"""
base.CTE["decided"] = """
  SELECT d.pair_id, d.total_bytes > 0 AND n_unchanged + n_byte_modified + n_renamed = 0 AS alignment_failed, d.changed_bytes / nullif(total_bytes, 0) > 0.95 AS degenerate,
    coalesce(r.n, 0) AS n_rule, coalesce(f.n, 0) AS n_diff, iou FROM dsum d LEFT JOIN (SELECT pair_id, count(*) AS n FROM rlabels GROUP BY ALL) r USING (pair_id)
  LEFT JOIN (SELECT pair_id, count(*) AS n FROM dlabels GROUP BY ALL) f USING (pair_id) LEFT JOIN agree USING (pair_id)"""
base.CTE["decisions"] = """
  SELECT *, CASE WHEN alignment_failed THEN 'rule_only_alignment_failed' WHEN degenerate AND pair_id % 2 = 0 THEN 'rule_only_degenerate' WHEN n_rule = 0 AND n_diff = 0 THEN 'no_signal' WHEN n_rule = 0 THEN 'path_b_only_no_rule_match'
    WHEN iou >= 0.4 THEN 'solid' WHEN iou >= 0.3 THEN 'partial_mismatch' ELSE 'low_confidence' END AS decision FROM decided"""
base.DEPENDS |= {"rlabels": ("news",), "agree": ("rlabels", "dlabels"), "decided": ("agree", "dsum"), "decisions": ("decided",)}


@query(
    "v3_agreement_verdict",
    "SELECT *, CASE WHEN iou >= 0.9 THEN 'solid' WHEN iou >= 0.3 THEN 'partial_mismatch' ELSE 'low_confidence' END AS verdict FROM agree",
    ("agree",),
)
def v3(t):
    d = diff_label_rows(t).select("pair_id", "object_path", F.col("offset_start").alias("start"), F.col("offset_end").alias("end"))
    a = V.label_agreement(rule_label_rows(t), d, "pair_id", "object_path")
    return a.withColumn("verdict", V.verdict(F.col("iou"), 0.9, 0.3))


def decided(t):
    d = diff_label_rows(t).select("pair_id", "object_path", F.col("offset_start").alias("start"), F.col("offset_end").alias("end"))
    r = rule_label_rows(t)
    s = D.diff_summary(changed(t)).select("pair_id", "alignment_failed", (F.col("degenerate") & (F.col("pair_id") % 2 == 0)).alias("degenerate"))
    count = lambda x, n: x.groupBy("pair_id").agg(F.count(F.lit(1)).alias(n))
    pairs = s.join(count(r, "n_rule"), "pair_id", "left").join(count(d, "n_diff"), "pair_id", "left")
    pairs = pairs.join(V.label_agreement(r, d, "pair_id", "object_path").select("pair_id", "iou"), "pair_id", "left")
    return V.reconcile(pairs.fillna(0, ["n_rule", "n_diff"]), 0.4, 0.3)


@query(
    "v4_reconcile_labels",
    """SELECT pair_id, n_rule, n_diff, iou, decision, CASE WHEN starts_with(decision, 'rule_only') THEN 'rules' WHEN decision IN ('path_b_only_no_rule_match', 'solid', 'partial_mismatch') THEN 'diff' ELSE 'none' END AS label_source,
  decision <> 'solid' AS needs_manual_review FROM decisions""",
    ("decisions",),
)
def v4(t):
    return decided(t).select("pair_id", "n_rule", "n_diff", "iou", "decision", "label_source", "needs_manual_review")


@query(
    "v4_final_labels",
    """SELECT pair_id, object_path, s::BIGINT AS start, e::BIGINT AS "end", 'rules' AS label_source FROM rlabels WHERE pair_id IN (SELECT pair_id FROM decisions WHERE starts_with(decision, 'rule_only'))
UNION ALL SELECT pair_id, object_path, offset_start, offset_end, 'diff' FROM dlabels WHERE pair_id IN (SELECT pair_id FROM decisions WHERE decision IN ('path_b_only_no_rule_match', 'solid', 'partial_mismatch'))""",
    ("decisions",),
)
def v4_labels(t):
    """The labels of each pair after reconciliation, from the source that its decision names."""
    d = diff_label_rows(t).select("pair_id", "object_path", F.col("offset_start").alias("start"), F.col("offset_end").alias("end"))
    r = rule_label_rows(t).select("pair_id", "object_path", "start", "end")
    return V.reconciled_labels(decided(t), d, r, "pair_id").select("pair_id", "object_path", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label_source")


@query(
    "a18_agreement_percent",
    """SELECT decision, count(*) AS n, round_even(count(*) * 100.0e0 / (SELECT count(*) FROM decisions), 6) AS percent FROM decisions GROUP BY decision""",
    ("decisions",),
)
def a18_percent(t):
    return V.agreement_counts(decided(t).select("decision"), "decision")


EXPECTED = "CASE user_id % 4 WHEN 0 THEN 'h3' WHEN 1 THEN ' ' WHEN 2 THEN 'zz' ELSE 'h1' END"


@query(
    "v5_detector_cross_check",
    f"""SELECT user_id, CASE WHEN NOT scan_ok AND n = 0 THEN 'scan_failed' WHEN x IS NULL AND n = 0 THEN 'no_expectation' WHEN x IS NULL THEN 'false_positive' WHEN n = 0 THEN 'no_detection'
  WHEN list_contains(fams, x) THEN 'solid' ELSE 'mismatch' END AS agreement FROM (SELECT user_id, scan_ok, score AS n, fams, nullif(trim({EXPECTED}), '') AS x FROM dscore)""",
    ("dscore",),
)
def v5(t):
    s = R.detector_scores(scans(t), "user_id", ("error", "signup"), 9).select(
        "user_id", F.expr(EXPECTED).alias("expected"), (~F.col("scan_ok")).alias("scan_failed"), (F.col("score") > 0).alias("has_hit"), F.col("detected_families").alias("families")
    )
    return V.cross_check(s).select("user_id", "agreement")


@query(
    "v6_leaked_keys",
    "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'N')",
)
def v6(t):
    return V.leaked_keys(t.lineitem.where("l_returnflag = 'N'"), t.lineitem.where("l_returnflag = 'R'"), "l_suppkey")


@query(
    "v6_dirty_prefix_exclusion",
    "SELECT p_partkey, p_name FROM part WHERE NOT (starts_with(upper(p_name), 'RED') OR starts_with('RED', upper(p_name)) OR starts_with(upper(p_name), 'SMALL RING') OR starts_with('SMALL RING', upper(p_name)))",
)
def v6_dirty(t):
    return V.without_dirty_prefix(t.part.select("p_partkey", "p_name"), "p_name", ["red", "small ring"])


PAIRS_V7 = "CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '3%' THEN 'commercial' ELSE 'open_source' END"


@query(
    "v7_label_source_choice",
    f"""WITH p AS (SELECT o_orderkey, {PAIRS_V7} AS grp, o_custkey % 3 AS n_injected, o_orderkey % 4 AS n_diff, o_orderstatus = 'O' AS has_rules, o_orderkey % 5 = 0 AS degenerate, o_orderkey % 7 = 0 AS alignment_failed,
   ['solid', 'partial_mismatch', 'low_confidence', 'rule_only_degenerate'][1 + o_custkey % 4] AS cs FROM orders),
 s AS (SELECT *, CASE WHEN grp = 'commercial' THEN CASE WHEN has_rules THEN CASE WHEN starts_with(cs, 'rule_only') THEN 'rules' WHEN cs IN ('solid', 'partial_mismatch') THEN 'diff' ELSE 'none' END WHEN n_diff > 0 THEN 'diff' ELSE 'none' END
   WHEN n_injected > 0 THEN 'injected' WHEN n_diff > 0 THEN 'diff' ELSE 'none' END AS src FROM p)
SELECT o_orderkey, src AS chosen_source, CASE WHEN grp = 'commercial' THEN CASE WHEN has_rules THEN cs <> 'solid' ELSE n_diff > 0 END ELSE src = 'none' AND (degenerate OR alignment_failed) END AS needs_manual_review,
  array_to_string(list_filter([CASE WHEN grp = 'commercial' AND NOT has_rules THEN 'commercial packer without rule file' END, CASE WHEN grp <> 'commercial' AND src = 'diff' THEN 'injected labels missing' END,
    CASE WHEN degenerate THEN 'degenerate diff' END, CASE WHEN alignment_failed THEN 'alignment failed' END], lambda x: x IS NOT NULL), ';') AS reasons FROM s""",
)
def v7(t):
    cs = F.element_at(F.array(*[F.lit(x) for x in ("solid", "partial_mismatch", "low_confidence", "rule_only_degenerate")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    p = t.orders.select(
        "o_orderkey", F.expr(PAIRS_V7).alias("grp"), (F.col("o_custkey") % 3).alias("n_injected"), (F.col("o_orderkey") % 4).alias("n_diff"), (F.col("o_orderstatus") == "O").alias("has_rules"),
        (F.col("o_orderkey") % 5 == 0).alias("degenerate"), (F.col("o_orderkey") % 7 == 0).alias("alignment_failed"), cs.alias("cs_decision"),
    )
    out = V.choose_label_source(p)
    return out.select("o_orderkey", "chosen_source", "needs_manual_review", F.array_join("reasons", ";").alias("reasons"))


@query(
    "v8_benign_class",
    "SELECT p_partkey, CASE WHEN p_size % 3 > 0 AND p_size % 8 >= 3 THEN 'benign-hard-clean' WHEN p_size % 3 > 0 THEN 'benign-clean' ELSE 'benign-borderline' END AS label_class, p_size % 3 > 0 AND p_brand <> 'Brand#2' AS train_allowed FROM part",
)
def v8(t):
    cols = V.benign_class(F.col("p_size") % 3 > 0, F.col("p_size") % 8, F.col("p_brand") == "Brand#2")
    return t.part.select("p_partkey", *[c.alias(n) for n, c in cols.items()])


@query(
    "v9_corpus_gate",
    """SELECT count(*) AS total, count(*) FILTER (r IS NULL) AS kept, count(*) FILTER (r = 'too_short') AS dropped_too_short, count(*) FILTER (r = 'bad_lang') AS dropped_bad_lang,
  round_even((count(*) - count(*) FILTER (r IS NULL)) / count(*), 6) AS excluded_share, CASE WHEN (count(*) - count(*) FILTER (r IS NULL)) / count(*) > 0.2 THEN 'over_cap' ELSE 'ok' END AS status
FROM (SELECT CASE WHEN n_chars < 100 THEN 'too_short' WHEN lang = 'fr' THEN 'bad_lang' END AS r FROM documents)""",
)
def v9(t):
    return V.gate_corpus(t.documents, {"too_short": F.col("n_chars") < 100, "bad_lang": F.col("lang") == "fr"}, 0.2)


@query(
    "v10_pending_inputs",
    """WITH f AS (SELECT doc_id, source, sha256(concat(sha256(text), '|', '4096/2048')) AS fp FROM documents)
SELECT doc_id, fp AS fingerprint FROM f WHERE fp NOT IN (SELECT fp FROM f WHERE source IN ('src0', 'src1', 'src2'))""",
)
def v10(t):
    fp = t.documents.select("doc_id", "source", V.fingerprint(F.encode("text", "UTF-8"), F.lit("4096/2048")).alias("fingerprint"))
    done = fp.where(F.col("source").isin("src0", "src1", "src2"))
    return V.pending_inputs(fp.select("doc_id", "fingerprint"), done)


@query(
    "k10_removed_members",
    "SELECT pair_id, name, size FROM olds o WHERE NOT EXISTS (SELECT 1 FROM news n WHERE n.pair_id = o.pair_id AND n.name = o.name)",
    ("olds", "news"),
)
def k10(t):
    old, new = sides(t)
    return D.removed_members(old, new).select("pair_id", "name", "size")


@query(
    "k10_candidate_union",
    """WITH u AS (SELECT p_name AS path, p_partkey AS k, 0 AS s FROM part WHERE p_size > 25 UNION ALL SELECT upper(p_name), p_partkey, 1 FROM part WHERE p_retailprice > 1000)
SELECT path, k FROM (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY s, k, path) AS r FROM u) WHERE r = 1""",
)
def k10_union(t):
    a = t.part.where("p_size > 25").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("path"))
    b = t.part.where("p_retailprice > 1000").select(F.col("p_partkey").alias("k"), F.upper("p_name").alias("path"))
    return D.distinct_candidates([a, b], "path").select("path", "k")


