"""Scalar classification, key and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import classify as C
from ..functions import keys as K
from ..functions import scoring as S
from ..functions import tokens as T
from ..functions.numeric import r6
from ..operators import windows as W
from .base import PROBE_PATH_SQL, query
from .detection import windows



def P():
    return F.col("object_path")


def D():
    return F.col("content")


LP = "lower(replace(object_path, chr(92), '/'))"
BASE = f"regexp_extract({LP}, '([^/]*)$', 1)"
SUF = f"regexp_extract({BASE}, '.([.][^./]+)$', 1)"
ZIPS = "(starts_with(hx, '504B0304') OR starts_with(hx, '504B0506'))"


@query(
    "p1_classify_object",
    f"""SELECT doc_id, CASE WHEN {SUF} = '.dex' THEN 'dex' WHEN {SUF} = '.so' OR starts_with({LP}, 'lib/') THEN 'native_lib'
  WHEN starts_with({LP}, 'meta-inf/') THEN 'signature' WHEN {ZIPS} OR {SUF} IN ('.apk', '.jar', '.zip') THEN 'embedded_archive'
  WHEN starts_with({LP}, 'assets/') THEN 'asset_blob' WHEN starts_with({LP}, 'res/') OR {LP} = 'resources.arsc' THEN 'resource'
  ELSE 'unknown_blob' END AS object_type FROM probes""",
    ("probes",),
)
def p1(t):
    return t.probes.select("doc_id", C.object_type(P(), D()).alias("object_type"))


AX = "starts_with(hx, '03000800')"
ENTRY_SQL = f"""CASE WHEN starts_with(hx, '6465780A') THEN 'dex' WHEN starts_with(hx, '7F454C46') THEN 'elf' WHEN {ZIPS} THEN 'archive'
  WHEN starts_with(hx, '02000C00') THEN 'arsc' WHEN starts_with(hx, '1F8B') AND length(hx) >= 8 THEN 'archive'
  WHEN {AX} AND length(hx) >= 16 AND {LP} = 'androidmanifest.xml' THEN 'manifest' WHEN {AX} AND length(hx) >= 16 THEN 'asset'
  WHEN {LP} = 'androidmanifest.xml' THEN 'manifest' WHEN {LP} = 'resources.arsc' THEN 'arsc'
  WHEN starts_with({BASE}, 'classes') AND suffix({BASE}, '.dex') THEN 'dex' WHEN starts_with({LP}, 'lib/') OR suffix({BASE}, '.so') THEN 'elf'
  WHEN regexp_matches({BASE}, '[.](apk|jar|zip|dex)$') THEN 'archive'
  WHEN starts_with({LP}, 'assets/') OR starts_with({LP}, 'res/') OR starts_with({LP}, 'meta-inf/') THEN 'asset' ELSE 'unknown' END"""


@query("p2_entry_type", f"SELECT doc_id, {ENTRY_SQL} AS entry_type FROM probes", ("probes",))
def p2(t):
    return t.probes.select("doc_id", C.entry_type(P(), D()).alias("entry_type"))


MAGIC_SQL = f"""CASE WHEN length(hx) < 8 THEN 'unknown' WHEN starts_with(hx, '6465780A') THEN 'dex' WHEN starts_with(hx, '7F454C46') THEN 'elf'
  WHEN {ZIPS} THEN 'zip' WHEN starts_with(hx, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(hx, 'FFD8FF') THEN 'jpg'
  WHEN starts_with(hx, '474946383761') OR starts_with(hx, '474946383961') THEN 'gif' WHEN starts_with(hx, '1F8B') THEN 'gzip'
  WHEN starts_with(hx, '030008') THEN 'axml' WHEN length(hx) > 8 AND starts_with(hx, '02000C00') THEN 'arsc' ELSE 'unknown' END"""


def hot_sql(expr: str, names) -> str:
    return f"list_transform([{', '.join(repr(n) for n in names)}], lambda v: CASE WHEN v = {expr} THEN '1' ELSE '0' END)"


@query(
    "p3_magic_type",
    f"SELECT doc_id, m AS magic, array_to_string({hot_sql('m', C.MAGIC_TYPES)}, '') AS one_hot FROM (SELECT doc_id, {MAGIC_SQL} AS m FROM probes)",
    ("probes",),
)
def p3(t):
    bits = F.transform(C.one_hot(C.magic_type(D()), C.MAGIC_TYPES), lambda x: x.cast("int").cast("string"))
    return t.probes.select("doc_id", C.magic_type(D()).alias("magic"), F.array_join(bits, "").alias("one_hot"))


PTYPE_SQL = f"""CASE WHEN {LP} = 'classes.dex' THEN 'classes_dex' WHEN starts_with({LP}, 'classes') AND suffix({LP}, '.dex') THEN 'secondary_dex'
  WHEN starts_with({LP}, 'lib/') OR suffix({LP}, '.so') THEN 'native_lib' WHEN starts_with({LP}, 'assets/') THEN 'assets'
  WHEN starts_with({LP}, 'res/raw/') THEN 'res_raw' WHEN starts_with({LP}, 'res/') THEN 'res_other' WHEN starts_with({LP}, 'meta-inf/') THEN 'meta_inf'
  WHEN {LP} = 'resources.arsc' THEN 'resources_arsc' WHEN {LP} = 'androidmanifest.xml' THEN 'manifest'
  WHEN regexp_matches({LP}, '[.](apk|jar|zip)$') THEN 'embedded_archive' WHEN NOT contains({LP}, '/') THEN 'root_file' ELSE 'unknown' END"""


@query(
    "p4_path_type",
    f"SELECT doc_id, m AS path_type, array_to_string({hot_sql('m', C.PATH_TYPES)}, '') AS one_hot FROM (SELECT doc_id, {PTYPE_SQL} AS m FROM probes)",
    ("probes",),
)
def p4(t):
    bits = F.transform(C.one_hot(C.path_type(P()), C.PATH_TYPES), lambda x: x.cast("int").cast("string"))
    return t.probes.select("doc_id", C.path_type(P()).alias("path_type"), F.array_join(bits, "").alias("one_hot"))


MODEL_SQL = ", ".join(repr(s) for s in C.MODEL_SUFFIXES)
BUCKET_SQL = f"""CASE WHEN b = 'classes.dex' THEN 'classes.dex' WHEN starts_with(b, 'classes') AND suffix(b, '.dex') THEN 'secondary_dex'
  WHEN starts_with(p, 'lib/') OR suffix(b, '.so') THEN 'lib_so' WHEN b = 'resources.arsc' THEN 'resources_arsc'
  WHEN p = 'androidmanifest.xml' THEN 'manifest' WHEN starts_with(p, 'meta-inf/') THEN 'meta_inf'
  WHEN coarse = 'archive' OR s IN ('.apk', '.jar', '.zip', '.gz') THEN 'nested_archive' WHEN starts_with(p, 'res/raw/') THEN 'res_raw'
  WHEN starts_with(p, 'res/') THEN 'res_other' WHEN starts_with(p, 'assets/') AND s IN ({MODEL_SQL}) THEN 'model_data_file'
  WHEN starts_with(p, 'assets/') THEN 'assets' WHEN coarse = 'asset' THEN 'asset_entry' WHEN coarse = 'unknown' THEN 'unknown_blob' ELSE coarse END"""
BUCKETS_SQL = f"""(SELECT doc_id, container, coarse, {BUCKET_SQL} AS bucket FROM (SELECT doc_id, container, {LP} AS p, {BASE} AS b,
  CASE WHEN contains({BASE}, '.') THEN '.' || regexp_extract({BASE}, '([^.]*)$', 1) ELSE '' END AS s, {ENTRY_SQL} AS coarse FROM probes))"""


@query("p5_path_bucket", f"SELECT doc_id, coarse, bucket FROM {BUCKETS_SQL}", ("probes",))
def p5(t):
    e = C.entry_type(P(), D())
    return t.probes.select("doc_id", e.alias("coarse"), C.path_bucket(P(), e).alias("bucket"))


FAM_LIST = list(C.FAMILY_KINDS) + ["other"]
OP = "lower(object_path)"
INFER_SQL = f"""CASE WHEN suffix({OP}, '.dex') OR contains({OP}, 'classes') THEN 'encrypted_dex' WHEN suffix({OP}, '.so') OR contains({OP}, '/lib/') THEN 'native_stub'
  WHEN contains({OP}, 'assets/') THEN 'compressed_payload' WHEN contains({OP}, 'meta-inf/') OR contains({OP}, 'manifest') OR suffix({OP}, '.arsc') THEN 'metadata_table' ELSE 'shim' END"""
KIND_SQL = "CASE fam " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in C.FAMILY_KINDS.items()) + " END"


@query(
    "p6_instance_kind",
    f"""SELECT doc_id, {INFER_SQL} AS at_inference, CASE WHEN y > 0 AND k IS NOT NULL THEN k WHEN y = 0 THEN 'benign_other' ELSE {INFER_SQL} END AS in_training
FROM (SELECT p.doc_id, object_path, l.toxic AS y, {KIND_SQL} AS k
      FROM (SELECT *, [{", ".join(repr(f) for f in FAM_LIST)}][1 + doc_id % 12] AS fam FROM probes) p LEFT JOIN labels l ON p.doc_id = l.doc_id)""",
    ("probes",),
)
def p6(t):
    fams = F.array(*[F.lit(f) for f in FAM_LIST])
    d = t.probes.join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    fam = F.array(F.element_at(fams, (F.col("doc_id") % 12 + 1).cast("int")))
    return d.select(
        "doc_id",
        C.instance_kind_at_inference(P()).alias("at_inference"),
        C.instance_kind_for_training(P(), F.col("toxic"), fam).alias("in_training"),
    )


@query(
    "p8_magic_scan",
    f"""SELECT doc_id, CASE WHEN {" OR ".join(f"contains(h, '{m.hex().upper()}')" for m in C.DEX_VERSIONS)} THEN 1.0 ELSE 0.0 END::DOUBLE AS has_dex_magic,
  contains(h, '7F454C46')::INT::DOUBLE AS has_elf_magic, contains(h, '89504E470D0A1A0A')::INT::DOUBLE AS has_png_magic,
  contains(h, '504B0304')::INT::DOUBLE AS has_zip_local_header FROM (SELECT doc_id, substr(hx, 1, 512) AS h FROM probes)""",
    ("probes",),
)
def p8(t):
    return t.probes.select("doc_id", *[c.alias(n) for n, c in C.magic_scan(D()).items()])


def u32(o: int, hx: str = "hx") -> str:
    b = [f"substr({hx}, {2 * (o + i) + 1}, 2)" for i in (3, 2, 1, 0)]
    return f"('0x' || {' || '.join(b)})::BIGINT"


@query(
    "p9_header_flags",
    f"""WITH x AS (SELECT doc_id, object_path, hx, length(hx) // 2 AS n FROM probes),
 y AS (SELECT *, CASE WHEN n >= 36 THEN {u32(32)} END AS fs, CASE WHEN n >= 56 THEN {u32(52)} END AS mo, CASE WHEN n >= 64 THEN {u32(60)} END AS si FROM x)
SELECT doc_id, (n >= 8 AND substr(hx, 1, 16) IN ({", ".join(repr(m.hex().upper()) for m in C.DEX_VERSIONS)}))::INT::DOUBLE AS dex_magic_present,
  coalesce(n >= 112 AND fs BETWEEN 1024 AND 104857600 AND fs <= n, false)::INT::DOUBLE AS file_size_plausible,
  coalesce(n >= 116 AND mo >= 112 AND mo < n AND mo % 4 = 0, false)::INT::DOUBLE AS map_list_offset_plausible,
  coalesce(n >= 108 AND si % 4 = 0, false)::INT::DOUBLE AS string_ids_offset_aligned,
  (contains(substr(hx, 1, 1024), '504B0304') OR (n > 512 AND contains(substr(hx, greatest(2 * (n - 512) + 1, 1), 1024), '504B0304')))::INT::DOUBLE AS nearby_zip_local_header,
  (regexp_matches(object_path, '(?i)[.]dex$') OR regexp_matches(object_path, '(?i)classes[0-9]*[.]dex'))::INT::DOUBLE AS object_path_is_dex_like,
  starts_with(lower(object_path), 'assets/')::INT::DOUBLE AS object_path_is_asset, regexp_matches(object_path, '^lib/[^/]+/.*[.]so$')::INT::DOUBLE AS object_path_is_lib_so FROM y""",
    ("probes",),
)
def p9(t):
    return t.probes.select("doc_id", *[c.alias(n) for n, c in C.header_flags(P(), D()).items()])


@query(
    "p10_uint32_le",
    f"""SELECT doc_id, CASE WHEN length(hx) >= 8 THEN {u32(0)} END AS at_0, CASE WHEN length(hx) >= 72 THEN {u32(32)} END AS at_32,
  CASE WHEN length(hx) >= 200 THEN {u32(96)} END AS at_96 FROM probes""",
    ("probes",),
)
def p10(t):
    return t.probes.select("doc_id", *[B.uint32_le(D(), o).alias(f"at_{o}") for o in (0, 32, 96)])


TEXT_WORDS = {"license": ["license", "License"], "password": ["password"], "the": ["the "], "at_sign": ["@"]}
WORDS = {**C.LOADER_KEYWORDS, **C.NATIVE_KEYWORDS, **C.SECTION_KEYWORDS, **TEXT_WORDS}


@query(
    "p11_keyword_flags",
    "SELECT doc_id, "
    + ", ".join(f"({' OR '.join(f'contains(text, {w!r})' for w in ws)})::INT::DOUBLE AS \"{n}\"" for n, ws in WORDS.items())
    + " FROM documents",
)
def p11(t):
    return t.objects.select("doc_id", *[c.alias(n) for n, c in C.keyword_flags(D(), WORDS).items()])


APP_SQL = "concat(replace(p_name, ' ', ''), CASE p_partkey % 6 WHEN 0 THEN '_release' WHEN 1 THEN '_debug_unaligned' WHEN 2 THEN '_Debug_aligned' WHEN 3 THEN '_release_signed' ELSE '' END)"


@query(
    "p12_strip_build_suffixes",
    f"""SELECT p_partkey, coalesce(nullif(regexp_replace(app, '(?i)(_release|_debug_unaligned|_debug|_aligned|_unaligned)+$', ''), ''), app) AS app
FROM (SELECT p_partkey, {APP_SQL} AS app FROM part)""",
)
def p12(t):
    return t.part.select("p_partkey", K.strip_build_suffixes(F.expr(APP_SQL)).alias("app"))


ID_SQL = (
    "concat(CASE c_custkey % 8 WHEN 0 THEN 'benign_' WHEN 1 THEN 'test_benign_' WHEN 2 THEN 'track_b_v2_dpt_' WHEN 3 THEN 'pk_flat_' "
    "WHEN 4 THEN 'az_' ELSE 'plain' END, lower(c_mktsegment), CASE c_custkey % 3 WHEN 0 THEN '_app' ELSE '-app' END, '_', "
    "CASE c_custkey % 4 WHEN 0 THEN '10023' WHEN 1 THEN '985f5181' WHEN 2 THEN 'abc' ELSE 'v' END, '_', c_custkey, "
    "CASE c_custkey % 5 WHEN 0 THEN '_split_xor' WHEN 1 THEN '_xor' WHEN 2 THEN '_so_embedded' WHEN 3 THEN '__d__stem' ELSE '_zz' END)"
)
PAIR_SQL = "CASE " + " ".join(f"WHEN starts_with(i, '{p}') THEN substr(i, {len(p) + 1})" for p in K.PAIR_PREFIXES) + (
    " WHEN contains(i, '_flat_') THEN substr(i, instr(i, '_flat_') + 6) WHEN contains(i, '_') THEN substr(i, instr(i, '_') + 1) ELSE i END"
)


@query("p13_pair_key", f"SELECT c_custkey, {PAIR_SQL} AS pair_key FROM (SELECT c_custkey, {ID_SQL} AS i FROM customer)")
def p13(t):
    return t.customer.select("c_custkey", K.pair_key(F.expr(ID_SQL)).alias("pair_key"))


@query(
    "p14_package_key",
    f"""WITH x AS (SELECT c_custkey, {ID_SQL} AS i, string_split({ID_SQL}, '_') AS p FROM customer),
 y AS (SELECT *, list_position(list_transform(p, lambda v: regexp_full_match(v, '[0-9]+|[0-9a-f]{{6,}}')), true) AS k FROM x)
SELECT c_custkey, coalesce(nullif(array_to_string(CASE WHEN coalesce(k, 0) = 0 THEN p ELSE p[1:k - 1] END, '.'), ''), i) AS package_key FROM y""",
)
def p14(t):
    return t.customer.select("c_custkey", K.package_key(F.expr(ID_SQL)).alias("package_key"))


FAMILY_SQL = "CASE " + " ".join(f"WHEN suffix(i, '_{n}') THEN '{n}'" for n in sorted(K.TRANSFORMS, key=len, reverse=True)) + (
    " ELSE string_split(i, '_')[-1] END"
)


@query("p15_transform_family", f"SELECT c_custkey, {FAMILY_SQL} AS transform_family FROM (SELECT c_custkey, {ID_SQL} AS i FROM customer)")
def p15(t):
    return t.customer.select("c_custkey", K.transform_family(F.expr(ID_SQL)).alias("transform_family"))


@query(
    "p16_seed_key",
    f"SELECT c_custkey, CASE WHEN len(string_split(i, '__')) >= 3 THEN string_split(i, '__')[3] ELSE i END AS seed FROM (SELECT c_custkey, {ID_SQL} AS i FROM customer)",
)
def p16(t):
    return t.customer.select("c_custkey", K.seed_key(F.expr(ID_SQL)).alias("seed"))


RAW_INT = "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'x1' ELSE concat('', o_custkey) END"
RAW_DATE_SPARK = "CASE o_orderkey % 5 WHEN 0 THEN 'bad' WHEN 1 THEN '1981-01-01 00:00:00' ELSE concat(date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss'), '.123') END"
RAW_DATE_DUCK = "CASE o_orderkey % 5 WHEN 0 THEN 'bad' WHEN 1 THEN '1981-01-01 00:00:00' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END"


@query(
    "p17_safe_casts",
    f"""SELECT o_orderkey, coalesce(TRY_CAST({RAW_INT} AS BIGINT), 0) AS n, CASE WHEN year(d) > 1990 THEN strftime(d, '%Y-%m-%d') END AS day
FROM (SELECT *, TRY_CAST({RAW_DATE_DUCK} AS TIMESTAMP) AS d FROM orders)""",
)
def p17(t):
    return t.orders.select(
        "o_orderkey", K.safe_int(F.expr(RAW_INT)).alias("n"), F.date_format(K.safe_date(F.expr(RAW_DATE_SPARK)), "yyyy-MM-dd").alias("day")
    )


@query(
    "p18_count_buckets",
    """SELECT CASE WHEN k = 0 THEN '0' WHEN k <= 2 THEN '1-2' WHEN k <= 5 THEN '3-5' WHEN k <= 10 THEN '6-10' ELSE '11+' END AS bucket, count(*) AS n
FROM (SELECT l_suppkey % 17 AS k FROM lineitem) GROUP BY ALL""",
)
def p18(t):
    return t.lineitem.groupBy(K.count_bucket(F.col("l_suppkey") % 17).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p19_candidate_filter",
    """SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_discount = 0 AND strftime(l_shipdate, '%Y-%m-%d') >= '1997-01-01'
  AND l_extendedprice BETWEEN 1000 AND 30000 AND contains(lower(l_returnflag || l_linestatus), 'r')""",
)
def p19(t):
    cond = K.candidate_filter(
        F.col("l_discount"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_extendedprice"),
        F.concat("l_returnflag", "l_linestatus"), "1997-01-01", 1000, 30000, "R",
    )
    return t.lineitem.where(cond).select("l_orderkey", "l_linenumber", "l_suppkey")


@query(
    "p22_score_blend",
    """SELECT family, round_even(avg(round_even(score * 0.75e0 + score_b * 0.25e0, 8)), 6) AS identity_mean,
  round_even(avg(1 / (1 + exp(-(ln(a / (1 - a)) * 0.75 + ln(b / (1 - b)) * 0.25)))), 6) AS logit_mean
FROM (SELECT *, least(greatest(score, 1e-6), 1 - 1e-6) AS a, least(greatest(score_b, 1e-6), 1 - 1e-6) AS b FROM scored) GROUP BY family""",
    ("scored",),
)
def p22(t):
    a, b = F.col("score"), F.col("score_b")
    lo = S.sigmoid(S.logit(a) * 0.75 + S.logit(b) * 0.25)
    return t.scored.groupBy("family").agg(
        r6(F.avg(F.bround(a * 0.75 + b * 0.25, 8))).alias("identity_mean"), r6(F.avg(lo)).alias("logit_mean")
    )


@query(
    "p23_task_seed",
    f"""SELECT p_partkey, (('0x' || substr(sha256(concat(p_name, '|', p_size, '|', p_type)), 1, 8))::BIGINT + {(1337 * K.SEED_MULTIPLIER) % 2**32}) % 4294967296 AS seed FROM part""",
)
def p23(t):
    return t.part.select("p_partkey", K.task_seed(1337, F.col("p_name"), F.col("p_size").cast("string"), F.col("p_type")).alias("seed"))


@query(
    "p24_row_key",
    """SELECT p_partkey, concat_ws('|', p_brand, p_type, p_size) AS row_key, sha256(concat('{"brand":"', p_brand, '","size":', p_size, '}')) AS canonical FROM part""",
)
def p24(t):
    return t.part.select(
        "p_partkey",
        K.row_key(F.col("p_brand"), F.col("p_type"), F.col("p_size")).alias("row_key"),
        K.canonical_hash(size=F.col("p_size"), brand=F.col("p_brand")).alias("canonical"),
    )


SEV = list(S.LABEL_SEVERITY) + ["mystery"]
SEV_SQL = "CASE l " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in S.LABEL_SEVERITY.items()) + " ELSE 0.5 END"


@query(
    "p25_label_severity",
    f"""SELECT p_partkey, s::DOUBLE AS score, CASE WHEN s >= 0.9 THEN 'new' WHEN s > 0 THEN 'modified' ELSE 'unchanged' END AS status
FROM (SELECT p_partkey, {SEV_SQL} AS s FROM (SELECT p_partkey, [{", ".join(repr(x) for x in SEV)}][1 + p_partkey % 12] AS l FROM part))""",
)
def p25(t):
    label = F.element_at(F.array(*[F.lit(x) for x in SEV]), (F.col("p_partkey") % 12 + 1).cast("int"))
    s = S.severity(label)
    return t.part.select("p_partkey", s.alias("score"), S.severity_status(s).alias("status"))


@query(
    "p26_registry_group",
    """SELECT p_partkey, CASE WHEN p_type = 'STANDARD' THEN 'registered_not_patched' WHEN starts_with(upper(p_brand), 'BRAND#1') OR starts_with(p_name, 's') THEN 'commercial' ELSE 'open_source' END AS grp
FROM (SELECT p_partkey, p_type, p_brand, p_name FROM part)""",
)
def p26(t):
    status = F.when(F.col("p_type") == "STANDARD", "registered_not_patched").otherwise("candidate")
    lic = F.when(F.upper("p_brand").startswith("BRAND#1"), " commercial_x").otherwise("NONE")
    pid = F.when(F.col("p_name").startswith("s"), F.concat(F.lit("cs"), "p_name")).otherwise("os")
    return t.part.select("p_partkey", S.registry_group(status, lic, pid).alias("grp"))


@query(
    "p27_byte_tokens",
    """SELECT conv_id, turn, seq_index::INTEGER AS seq_index, array_to_string(list_concat(list_concat(list_concat([1], list_transform(range(0, n), lambda k: ('0x' || substr(hx, 2 * k + 1, 2))::INTEGER + 5)), [2]),
    list_transform(range(0, 126 - n), lambda k: 0)), ',') AS input_ids, (n + 2)::INTEGER AS length, continued
FROM (SELECT conv_id, turn, seq_index, substr(hx, 252 * seq_index + 1, 252) AS hx, least(n - 126 * seq_index, 126) AS n, seq_index < greatest(n - 1, 0) // 126 AS continued
  FROM (SELECT conv_id, turn, hex(encode(text)) AS hx, octet_length(encode(text)) AS n, unnest(range(0, greatest(octet_length(encode(text)) - 1, 0) // 126 + 1)) AS seq_index FROM conversations))""",
)
def p27(t):
    rows = t.conversations.select("conv_id", "turn", F.inline(T.token_sequences(F.encode("text", "UTF-8"), 128)))
    return rows.withColumn("input_ids", F.array_join(F.col("input_ids").cast("array<string>"), ",")).drop("attention_mask")


@query(
    "p28_path_parts",
    f"""SELECT doc_id, p AS norm_path, regexp_extract(p, '([^/]*)$', 1) AS base_name, regexp_extract(p, '([.][^./]+)$', 1) AS extension,
  (length(p) - length(replace(p, '/', '')))::INTEGER AS depth FROM (SELECT doc_id, {LP} AS p FROM probes)""",
    ("probes",),
)
def p28(t):
    return t.probes.select("doc_id", *[c.alias(n) for n, c in C.path_parts(P()).items()])


@query(
    "p29_routed_score",
    f"""SELECT doc_id, round_even(CASE e WHEN 'dex' THEN a + 0.25e0 * c WHEN 'elf' THEN b + 0.25e0 * c WHEN 'unknown' THEN 0.25e0 * a + 0.25e0 * b + 0.25e0 * c ELSE c END, 6) AS score
FROM (SELECT doc_id, {ENTRY_SQL} AS e, (doc_id % 10) / 10 AS a, (doc_id % 7) / 7 AS b, (doc_id % 13) / 13 AS c FROM probes)""",
    ("probes",),
)
def p29(t):
    i = F.col("doc_id")
    s = S.routed_score(C.entry_type(P(), D()), (i % 10) / 10, (i % 7) / 7, (i % 13) / 13)
    return t.probes.select("doc_id", r6(s).alias("score"))


# Pattern tokens on windows, entry type from the path.
BYTES = "('0x' || substr(whx, 2 * k + 1, 2))::INTEGER"
B64_SQL = ", ".join(str(b) for b in sorted(T.BASE64_CHARS.encode()))
P7_SQL = f"""WITH st AS (SELECT container, window_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e,
   sum(CASE WHEN b BETWEEN 32 AND 126 OR b IN (9, 10, 13) THEN c ELSE 0 END) / sum(c) AS pr, sum(CASE WHEN b IN ({B64_SQL}) THEN c ELSE 0 END) / sum(c) AS b64
   FROM wbytes GROUP BY ALL),
 pos AS (SELECT container, window_id, k, {BYTES} AS b FROM (SELECT container, window_id, whx, unnest(range(0, wn)) AS k FROM windows)),
 isl AS (SELECT container, window_id, b, k, k - row_number() OVER (PARTITION BY container, window_id, b ORDER BY k) AS g FROM pos),
 runs AS (SELECT container, window_id, b, count(*) AS len, min(k) AS k0 FROM isl GROUP BY container, window_id, b, g),
 run AS (SELECT container, window_id, max(len) AS run_len, arg_max(b, len * 100000 - k0) AS run_byte FROM runs GROUP BY ALL),
 gr AS (SELECT container, window_id, w, substr(whx, 2 * w * j + 1, 2 * w) AS g, count(*) AS c FROM (SELECT container, window_id, whx, w, unnest(range(0, wn // w)) AS j
        FROM windows, (SELECT unnest([2, 4]) AS w)) GROUP BY ALL),
 rep AS (SELECT container, window_id, w, max(c) >= greatest(4, sum(c) // 8) AS r FROM gr GROUP BY ALL),
 rp AS (SELECT container, window_id, bool_or(w = 2 AND r) AS r2, bool_or(w = 4 AND r) AS r4 FROM rep GROUP BY ALL)
SELECT w.container, w.window_id, array_to_string(list_filter(['[BOS]', 'ENTRY_TEXTLIKE_SLOT', 'MAGIC_NONE',
   CASE WHEN e < 3.5 THEN 'ENTROPY_LOW' WHEN e < 6.5 THEN 'ENTROPY_MEDIUM' ELSE 'ENTROPY_HIGH' END,
   CASE WHEN pr > 0.85 THEN 'ASCII_TEXT' WHEN pr > 0.35 THEN 'ASCII_MIXED' ELSE 'BINARY_DENSE' END, CASE WHEN b64 > 0.92 AND wn >= 32 THEN 'BASE64_LIKE' END,
   CASE WHEN substr(whx, 1, 4) IN ('7801', '785E', '789C', '78DA') THEN 'COMPRESS_ZLIB_LIKE' END, CASE WHEN starts_with(whx, '504B') THEN 'COMPRESS_ZIP_LIKE' END,
   CASE WHEN e >= 7.2 AND pr < 0.35 THEN 'ENCRYPTION_LIKE_HIGH_ENTROPY' END,
   CASE WHEN run_len < 16 THEN 'RUN_SHORT' WHEN run_byte = 0 THEN 'RUN_ZERO_LONG' WHEN run_byte = 255 THEN 'RUN_FF_LONG' ELSE 'RUN_BYTE_LONG' END,
   CASE WHEN r2 THEN 'REPEAT_2GRAM' END, CASE WHEN r4 THEN 'REPEAT_4GRAM' END, 'PATTERN_END', '[EOS]'], lambda x: x IS NOT NULL), ' ') AS tokens
FROM windows w JOIN st USING (container, window_id) JOIN run USING (container, window_id) JOIN rp USING (container, window_id)"""


@query("p7_pattern_tokens", P7_SQL.replace("ENTRY_TEXTLIKE_SLOT", "ENTRY_UNKNOWN"), ("windows", "wbytes"))
def p7(t):
    w = W.with_histogram(windows(t)).withColumn("runs", B.byte_runs("data"))
    tok = T.pattern_tokens(F.col("data"), F.col("hist"), F.col("n"), F.col("runs"), F.lit("unknown"))
    return w.select("container", "window_id", F.array_join(tok, " ").alias("tokens"))
