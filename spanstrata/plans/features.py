"""Feature queries on windows and objects of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import classify as C
from ..functions.numeric import r6, ratio
from ..operators import context as X
from ..operators import features as E
from ..operators import windows as W
from . import base
from .base import query
from .detection import MIN, STRIDE, WIDTH, windows

K = ["container", "window_id"]
base.CTE["obytes"] = """
  SELECT container, object_id, b, count(*) AS c FROM (SELECT container, object_id,
    unnest(list_transform(range(0, n), lambda k: ('0x' || substr(hx, 2 * k + 1, 2))::INTEGER)) AS b FROM objects) GROUP BY ALL"""
base.CTE["wpos"] = """
  SELECT container, window_id, k, ('0x' || substr(whx, 2 * k + 1, 2))::INTEGER AS b
  FROM (SELECT container, window_id, whx, unnest(range(0, wn)) AS k FROM windows)"""
base.DEPENDS |= {"obytes": ("objects",), "wpos": ("windows",)}


def chunked(src: str, keys: str, hx: str, n: str, width: int, step: int) -> str:
    """chunk(keys, i, e): entropy of full sub-windows."""
    return f"""SELECT {keys}, i, log2({width}) - sum(c * log2(c)) / {width} AS e FROM (
    SELECT {keys}, i, b, count(*) AS c FROM (SELECT {keys}, i, unnest(list_transform(range(0, {width}), lambda k: ('0x' || substr(part, 2 * k + 1, 2))::INTEGER)) AS b
      FROM (SELECT {keys}, i, substr({hx}, 2 * {step} * i + 1, 2 * {width}) AS part FROM (SELECT {keys}, {hx}, unnest(range(0, ({n} - {width}) // {step} + 1)) AS i FROM {src} WHERE {n} >= {width})))
    GROUP BY ALL) GROUP BY {keys}, i"""


@query(
    "b3_unigram_frequencies",
    "SELECT container, window_id, b::INTEGER AS byte, c::INTEGER AS n, round_even(c / sum(c) OVER (PARTITION BY container, window_id), 6) AS frequency FROM wbytes",
    ("wbytes",),
)
def b3(t):
    return E.unigram_rows(windows(t), K)


@query(
    "b4_bigram_buckets",
    """SELECT container, window_id, bucket::INTEGER AS bucket, count(*)::INTEGER AS n FROM (
  SELECT container, window_id, unnest(list_transform(range(1, wn), lambda k: (bs[k] * 256 + bs[k + 1]) % 1024)) AS bucket FROM (
    SELECT container, window_id, wn, list_transform(range(0, wn), lambda k: ('0x' || substr(whx, 2 * k + 1, 2))::INTEGER) AS bs FROM windows)) GROUP BY ALL""",
    ("windows",),
)
def b4(t):
    return E.bigram_rows(windows(t), K, 1024)


@query(
    "b5_top_bigrams",
    """WITH g AS (SELECT container, window_id, substr(whx, 2 * k + 1, 4) AS g, count(*) AS c FROM (SELECT container, window_id, whx, unnest(range(0, wn - 1)) AS k FROM windows) GROUP BY ALL),
 r AS (SELECT *, sum(c) OVER (PARTITION BY container, window_id) AS s, row_number() OVER (PARTITION BY container, window_id ORDER BY c DESC) AS r FROM g)
SELECT container, window_id, """
    + ", ".join(f"round_even(coalesce(max(CASE WHEN r = {i} THEN c / s END), 0), 6) AS top{i}" for i in range(1, 5))
    + " FROM r GROUP BY container, window_id",
    ("windows",),
)
def b5(t):
    w = windows(t).select(*K, E.top_bigrams(F.col("data")).alias("f"))
    return w.select(*K, *[r6(F.col("f")[i - 1]).alias(f"top{i}") for i in range(1, 5)])


@query(
    "b6_longest_runs",
    """WITH isl AS (SELECT container, window_id, b, k, k - row_number() OVER (PARTITION BY container, window_id, b ORDER BY k) AS g FROM wpos),
 runs AS (SELECT container, window_id, b, count(*) AS len, min(k) AS k0 FROM isl GROUP BY container, window_id, b, g)
SELECT container, window_id, max(len)::INTEGER AS run_len, arg_max(b, len * 100000 - k0) AS run_byte, coalesce(max(CASE WHEN b = 0 THEN len END), 0)::INTEGER AS zero_run
FROM runs GROUP BY container, window_id""",
    ("wpos",),
)
def b6(t):
    return windows(t).select(*K, B.byte_runs("data").alias("r")).select(*K, "r.*")


@query(
    "b7_duplicate_blocks",
    """WITH g AS (SELECT container, window_id, substr(whx, 32 * j + 1, 32) AS g FROM (SELECT container, window_id, whx, unnest(range(0, wn // 16)) AS j FROM windows))
SELECT container, window_id, round_even((count(*) - count(DISTINCT g)) / count(*), 6) AS duplicate_ratio FROM g GROUP BY ALL""",
    ("windows",),
)
def b7(t):
    return windows(t).select(*K, r6(B.duplicate_block_ratio(F.col("data"))).alias("duplicate_ratio"))


@query(
    "b8_repeated_blocks",
    """WITH gr AS (SELECT container, window_id, w, substr(whx, 2 * w * j + 1, 2 * w) AS g, count(*) AS c FROM (SELECT container, window_id, whx, w, unnest(range(0, wn // w)) AS j
        FROM windows, (SELECT unnest([2, 4]) AS w)) GROUP BY ALL),
 rep AS (SELECT container, window_id, w, max(c) >= greatest(4, sum(c) // 8) AS r FROM gr GROUP BY ALL)
SELECT container, window_id, bool_or(w = 2 AND r) AS repeat_2, bool_or(w = 4 AND r) AS repeat_4 FROM rep GROUP BY ALL""",
    ("windows",),
)
def b8(t):
    d = F.col("data")
    return windows(t).select(*K, B.repeated_blocks(d, 2).alias("repeat_2"), B.repeated_blocks(d, 4).alias("repeat_4"))


@query(
    "b9_distribution_stats",
    """SELECT container, window_id, round_even(sum(c * c) * 256.0e0 / sum(c) - sum(c), 6) AS chi2, round_even((sum(c * c) * 256.0e0 / sum(c) - sum(c)) / sum(c), 6) AS chi2_per_byte,
  round_even(least((sum(c * c) * 256.0e0 / sum(c) - sum(c)) / 256 / 1000, 1), 6) AS chi2_scaled, count(*)::INTEGER AS unique_bytes,
  floor(log2(count(*)))::DOUBLE AS unique_log2, round_even((max(b) - min(b)) / 255, 6) AS range_span FROM wbytes GROUP BY container, window_id""",
    ("wbytes",),
)
def b9(t):
    h, n = F.col("hist"), F.col("n")
    chi = B.chi_square(h, n)
    return W.with_histogram(windows(t)).select(
        *K, r6(chi).alias("chi2"), r6(chi / n).alias("chi2_per_byte"), r6(F.least(chi / 256.0 / 1000.0, F.lit(1.0))).alias("chi2_scaled"),
        B.unique_bytes(h).alias("unique_bytes"), B.unique_log2(h).alias("unique_log2"),
        r6((B.highest_byte(h) - B.lowest_byte(h)) / 255.0).alias("range_span"),
    )


@query(
    "b10_length_log",
    "SELECT container, object_id, round_even(ln(1 + n::DOUBLE) / ln(1 + 1048576.0e0), 6) AS length_log FROM objects",
    ("objects",),
)
def b10(t):
    return t.objects.select("container", "object_id", r6(B.length_log(F.length("content"))).alias("length_log"))


B12_SQL = f"""WITH ch AS ({chunked("windows", "container, window_id", "whx", "wn", 256, 256)}),
 cs AS (SELECT container, window_id, avg(e) AS m, stddev_pop(e) AS s FROM ch GROUP BY ALL),
 isl AS (SELECT container, window_id, k - row_number() OVER (PARTITION BY container, window_id ORDER BY k) AS g FROM wpos WHERE b = 0),
 zr AS (SELECT container, window_id, max(c) AS z FROM (SELECT container, window_id, g, count(*) AS c FROM isl GROUP BY ALL) GROUP BY ALL),
 g AS (SELECT container, window_id, substr(whx, 32 * j + 1, 32) AS g FROM (SELECT container, window_id, whx, unnest(range(0, wn // 16)) AS j FROM windows)),
 du AS (SELECT container, window_id, (count(*) - count(DISTINCT g)) / count(*) AS d FROM g GROUP BY ALL),
 st AS (SELECT container, window_id, sum(c) AS n, round_even(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS e,
   sum(CASE WHEN b BETWEEN 32 AND 126 OR b IN (9, 10, 13) THEN c ELSE 0 END) / sum(c) AS p, sum(CASE WHEN b = 0 THEN c ELSE 0 END) / sum(c) AS z0,
   sum(CASE WHEN b >= 128 THEN c ELSE 0 END) / sum(c) AS h FROM wbytes GROUP BY ALL)
SELECT container, window_id, e AS s_entropy, round_even(coalesce(m, e), 6) AS s_chunk_entropy_mean, round_even(coalesce(s, 0), 6) AS s_chunk_entropy_std,
  round_even(p, 6) AS s_printable_ratio, round_even(z0, 6) AS s_zero_ratio, round_even(coalesce(z, 0) / n, 6) AS s_longest_zero_run_ratio,
  round_even(h, 6) AS s_high_byte_ratio, round_even(d, 6) AS s_duplicate_block_ratio, round_even(ln(1 + n::DOUBLE) / ln(1048577.0e0), 6) AS s_length_log1p
FROM st LEFT JOIN cs USING (container, window_id) LEFT JOIN zr USING (container, window_id) LEFT JOIN du USING (container, window_id)"""


@query("b12_byte_summary", B12_SQL, ("wbytes", "wpos"))
def b12(t):
    return E.byte_summary(windows(t), K)


@query(
    "w2_typed_windows",
    """WITH s AS (SELECT container, object_id, n, CASE WHEN n < 256 THEN [0] ELSE list_filter(range(0, n, 256), lambda x: n - x >= 256) END AS st FROM objects)
SELECT container, object_id, (i - 1)::INTEGER AS window_index, CASE WHEN n < 256 THEN 'whole_entry' ELSE 'window' END AS section_type, st[i] AS offset_start,
  least(st[i] + 512, n) AS offset_end, len(st)::INTEGER AS n_windows FROM (SELECT *, unnest(range(1, len(st) + 1)) AS i FROM s)""",
    ("objects",),
)
def w2(t):
    return W.typed_windows(t.objects, 512, 256)


SECTIONS = """SELECT container, object_id, k AS section_index, ['dex_header', 'dex_code_item', 'dex_string_data'][k + 1] AS section_type,
    [0, n // 8, n // 2][k + 1] AS s0, [n // 8, n // 2, n - n // 16][k + 1] AS s1 FROM (SELECT *, unnest([0, 1, 2]) AS k FROM objects WHERE n >= 256 AND doc_id % 3 <> 0)"""
base.CTE["sections"] = SECTIONS
base.DEPENDS["sections"] = ("objects",)


def sections(t):
    n = F.length("content").cast("long")
    cut = lambda k: F.floor(n / k)
    rows = F.array(
        F.struct(F.lit("dex_header").alias("section_type"), F.lit(0).cast("long").alias("s_start"), cut(8).alias("s_end")),
        F.struct(F.lit("dex_code_item").alias("section_type"), cut(8).alias("s_start"), cut(2).alias("s_end")),
        F.struct(F.lit("dex_string_data").alias("section_type"), cut(2).alias("s_start"), (n - cut(16)).alias("s_end")),
    )
    return t.objects.where((F.length("content") >= 256) & (F.col("doc_id") % 3 != 0)).select(
        "container", "object_id", F.posexplode(rows).alias("section_index", "s")
    ).select("container", "object_id", "section_index", "s.*")


@query(
    "w3_section_windows",
    """WITH c AS (SELECT container, object_id, section_index, section_type, s0, s1, unnest(CASE WHEN s1 - s0 <= 1024 THEN [s0] ELSE list_filter(range(s0, s1, 256), lambda x: s1 - x >= 256) END) AS x FROM sections),
 a AS (SELECT container, object_id, row_number() OVER (PARTITION BY container, object_id ORDER BY section_index, x) - 1 AS window_index, section_type, x AS offset_start,
   CASE WHEN s1 - s0 <= 1024 THEN s1 ELSE least(x + 512, s1) END AS offset_end, count(*) OVER (PARTITION BY container, object_id) AS n_windows FROM c),
 s AS (SELECT container, object_id, n, CASE WHEN n < 256 THEN [0] ELSE list_filter(range(0, n, 256), lambda x: n - x >= 256) END AS st FROM objects WHERE NOT (n >= 256 AND doc_id % 3 <> 0))
SELECT container, object_id, window_index::INTEGER AS window_index, section_type, offset_start, offset_end, n_windows::INTEGER AS n_windows FROM a
UNION ALL SELECT container, object_id, (i - 1)::INTEGER, CASE WHEN n < 256 THEN 'whole_entry' ELSE 'window' END, st[i], least(st[i] + 512, n), len(st)::INTEGER
FROM (SELECT *, unnest(range(1, len(st) + 1)) AS i FROM s)""",
    ("sections",),
)
def w3(t):
    sec = sections(t).select(
        "container", "object_id", "section_index", "section_type", F.col("s_start").alias("offset"), (F.col("s_end") - F.col("s_start")).alias("size")
    )
    return W.section_windows(t.objects, sec, 512, 256, 256, 1024)


W4_SQL = f"""WITH ch AS ({chunked("objects", "container, object_id", "hx", "n", 256, 256)}),
 cs AS (SELECT container, object_id, avg(e) AS m, stddev_pop(e) AS s, max(e) AS mx, min(e) AS mn FROM ch GROUP BY ALL),
 w AS (SELECT container, object_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM obytes GROUP BY ALL)"""


@query(
    "w4_chunk_entropy",
    W4_SQL + " SELECT container, object_id, round_even(coalesce(m, e), 6) AS mean, round_even(coalesce(s, 0), 6) AS std FROM w LEFT JOIN cs USING (container, object_id)",
    ("obytes",),
)
def w4(t):
    s = chunk_table(t, 256, 256)
    return s.select("container", "object_id", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


def chunk_table(t, width, step):
    d = F.col("content")
    base_df = t.objects.select(
        "container", "object_id", B.byte_stats(d)["entropy"].alias("e"), B.chunk_entropies(d, width, step).alias("parts")
    )
    return base_df.select("container", "object_id", *[c.alias(n) for n, c in E.chunk_stats(F.col("parts"), F.col("e")).items()])


@query(
    "w5_rolling_entropy",
    f"""WITH ch AS ({chunked("objects", "container, object_id", "hx", "n", 1024, 512)}),
 cs AS (SELECT container, object_id, avg(e) AS m, stddev_pop(e) AS s, max(e) AS mx, min(e) AS mn, coalesce(CASE WHEN count(*) > 1 THEN regr_slope(e, i) END, 0) AS sl FROM ch GROUP BY ALL),
 w AS (SELECT container, object_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM obytes GROUP BY ALL)
SELECT container, object_id, round_even(coalesce(m, e), 6) AS mean, round_even(coalesce(s, 0), 6) AS std, round_even(coalesce(mx, e), 6) AS "max",
  round_even(coalesce(mn, e), 6) AS "min", round_even(coalesce(sl, 0), 6) AS slope FROM w LEFT JOIN cs USING (container, object_id)""",
    ("obytes",),
)
def w5(t):
    s = chunk_table(t, 1024, 512)
    return s.select("container", "object_id", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "max", "min", "slope")])


@query(
    "w6_entropy_range",
    W4_SQL + """ SELECT container, object_id, round_even(coalesce(m, e), 6) AS mean, round_even(coalesce(s, 0), 6) AS std,
  round_even(coalesce(mx - mn, 0), 6) AS "range" FROM w LEFT JOIN cs USING (container, object_id)""",
    ("obytes",),
)
def w6(t):
    s = chunk_table(t, 256, 256)
    return s.select("container", "object_id", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "range")])


@query(
    "w7_entropy_of_thirds",
    """WITH p AS (SELECT container, object_id, part, substr(hx, 2 * a + 1, 2 * (z - a)) AS px, z - a AS pn FROM (SELECT *, greatest(n // 3, 1) AS th FROM objects),
   LATERAL (SELECT unnest([1, 2, 3]) AS part, unnest([0, th, 2 * th]) AS a, unnest([least(th, n), least(2 * th, n), n]) AS z)),
 h AS (SELECT container, object_id, part, b, count(*) AS c FROM (SELECT container, object_id, part, unnest(list_transform(range(0, pn), lambda k: ('0x' || substr(px, 2 * k + 1, 2))::INTEGER)) AS b FROM p) GROUP BY ALL),
 e AS (SELECT container, object_id, part, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM h GROUP BY ALL)
SELECT container, object_id, round_even(coalesce(max(CASE WHEN part = 1 THEN e END), 0), 6) AS first, round_even(coalesce(max(CASE WHEN part = 2 THEN e END), 0), 6) AS middle,
  round_even(coalesce(max(CASE WHEN part = 3 THEN e END), 0), 6) AS last FROM e GROUP BY ALL""",
    ("objects",),
)
def w7(t):
    d = F.col("content")
    parts = E.third_parts(d, F.length(d))
    hists = t.objects.select(
        "container", "object_id", *[B.byte_histogram(p).alias(f"h{i}") for i, p in enumerate(parts)], *[F.length(p).alias(f"n{i}") for i, p in enumerate(parts)]
    )
    return hists.select(
        "container", "object_id", *[r6(B.entropy(F.col(f"h{i}"), F.col(f"n{i}"))).alias(nm) for i, nm in enumerate(("first", "middle", "last"))]
    )


@query(
    "w8_leading_windows",
    """SELECT container, stream, count(*) AS sequences, sum(wn)::BIGINT AS bytes FROM windows, (SELECT unnest(['bytecode', 'native', 'raw']) AS stream)
WHERE object_size >= 256 GROUP BY ALL""",
    ("windows",),
)
def w8(t):
    w = W.leading_windows(W.byte_windows(t.objects.where(F.length("content") >= 256), WIDTH, STRIDE, MIN))
    streams = F.explode(F.array(*[F.lit(s) for s in ("bytecode", "native", "raw")])).alias("stream")
    return w.select("container", streams, F.length("data").alias("n")).groupBy("container", "stream").agg(
        F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("bytes")
    )


base.CTE["wraw"] = """
  SELECT container, window_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy,
    sum(CASE WHEN b BETWEEN 32 AND 126 OR b IN (9, 10, 13) THEN c ELSE 0 END) / sum(c) AS printable_ratio FROM wbytes GROUP BY ALL"""
base.DEPENDS["wraw"] = ("wbytes",)
F_BASE = "w AS (SELECT w.*, s.entropy, s.printable_ratio FROM windows w JOIN wraw s USING (container, window_id))"


def raw_windows(t):
    """Windows with unrounded entropy, so that rounded differences have no decimal ties."""
    w = W.with_histogram(windows(t))
    return w.withColumn("entropy", B.entropy(F.col("hist"), F.col("n"))).drop("data", "hist")

NEIGHBOR = """CASE WHEN count(*) OVER nb > 1 THEN entropy - (sum(entropy) OVER nb - entropy) / (count(*) OVER nb - 1) ELSE 0 END"""
NB = "WINDOW nb AS (PARTITION BY container, object_id ORDER BY offset_start ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query(
    "f1_neighbor_delta",
    f"WITH {F_BASE} SELECT container, window_id, round_even({NEIGHBOR}, 6) + 0.0e0 AS delta_neighbor FROM w {NB}",
    ("wraw",),
)
def f1(t):
    return X.neighbor_delta(raw_windows(t)).select(*K, r6(F.col("delta_neighbor")).alias("delta_neighbor"))


@query(
    "f2_group_deltas",
    f"""WITH {F_BASE} SELECT container, window_id, round_even(entropy - avg(entropy) OVER (PARTITION BY container, object_path), 6) + 0.0e0 AS delta_object,
  round_even(entropy - avg(entropy) OVER (PARTITION BY container), 6) + 0.0e0 AS delta_container FROM w""",
    ("wraw",),
)
def f2(t):
    d = X.entropy_deltas(raw_windows(t))
    return d.select(*K, r6(F.col("delta_object")).alias("delta_object"), r6(F.col("delta_container")).alias("delta_container"))


POS = """round_even(offset_start / greatest(max(offset_start) OVER ob, 1), 6) AS offset_norm,
  round_even((rank() OVER (PARTITION BY container, object_id ORDER BY offset_start) - 1) / greatest(count(*) OVER ob - 1, 1), 6) AS index_norm,
  round_even((dense_rank() OVER (PARTITION BY container ORDER BY object_id) - 1) / greatest(nobj - 1, 1), 6) AS object_index_norm"""
NOBJ = "JOIN (SELECT container, count(DISTINCT object_id) AS nobj FROM windows GROUP BY container) USING (container)"
OB = "WINDOW ob AS (PARTITION BY container, object_id)"


@query("f3_positions", f"SELECT container, window_id, {POS} FROM windows {NOBJ} {OB}", ("windows",))
def f3(t):
    w = windows(t).drop("data").withColumn("ordinal", F.substring_index("object_id", ":", -1).cast("long"))
    d = X.object_positions(X.window_positions(w), "ordinal")
    return d.select(*K, *[r6(F.col(c)).alias(c) for c in ("offset_norm", "index_norm", "object_index_norm")])


SUFO = "regexp_extract(lower(object_path), '([.][^./]+)$', 1)"
OTYPE = f"""CASE WHEN {SUFO} = '.dex' THEN 'dex' WHEN {SUFO} = '.so' OR starts_with(lower(object_path), 'lib/') THEN 'native_lib' WHEN starts_with(lower(object_path), 'meta-inf/') THEN 'signature'
  WHEN {SUFO} IN ('.apk', '.jar', '.zip') THEN 'embedded_archive' WHEN starts_with(lower(object_path), 'assets/') THEN 'asset_blob' ELSE 'x' END"""
CTX = f"""floor(log2(max(offset_end) OVER ob))::DOUBLE AS object_size_log2, ({OTYPE} = 'embedded_archive')::INT::DOUBLE AS object_type_is_embedded_archive,
  ({OTYPE} = 'asset_blob')::INT::DOUBLE AS object_type_is_asset_blob"""


@query("f4_object_context", f"SELECT container, window_id, {CTX} FROM windows {OB}", ("windows",))
def f4(t):
    w = windows(t)
    d = X.object_context(w, C.object_type(F.col("object_path"), F.col("data")))
    return d.select(*K, "object_size_log2", "object_type_is_embedded_archive", "object_type_is_asset_blob")


F10_SQL = f"""WITH {F_BASE},
 isl AS (SELECT container, window_id, b, k - row_number() OVER (PARTITION BY container, window_id, b ORDER BY k) AS g FROM wpos),
 run AS (SELECT container, window_id, max(c) AS rl FROM (SELECT container, window_id, count(*) AS c FROM isl GROUP BY container, window_id, b, g) GROUP BY ALL),
 bd AS (SELECT container, window_id, sum(CASE WHEN b BETWEEN 32 AND 126 OR b IN (9, 10, 13) THEN c ELSE 0 END) / sum(c) AS pr, sum(CASE WHEN b = 0 THEN c ELSE 0 END) / sum(c) AS z,
   sum(CASE WHEN b >= 128 THEN c ELSE 0 END) / sum(c) AS hi, sum(CASE WHEN b BETWEEN 32 AND 126 THEN c ELSE 0 END) / sum(c) AS a,
   (sum(c * c) * 256.0e0 / sum(c) - sum(c)) / sum(c) AS x2, floor(log2(count(*)))::DOUBLE AS u, (max(b) - min(b)) / 255 AS sp FROM wbytes GROUP BY ALL)
SELECT container, object_id, window_id, round_even(entropy, 6) AS entropy, round_even(printable_ratio, 6) AS printable_ratio, round_even({NEIGHBOR}, 6) + 0.0e0 AS delta_neighbor,
  round_even(entropy - avg(entropy) OVER (PARTITION BY container, object_path), 6) + 0.0e0 AS delta_object, round_even(entropy - avg(entropy) OVER (PARTITION BY container), 6) + 0.0e0 AS delta_container,
  round_even(pr, 6) AS byte_printable_ratio, round_even(z, 6) AS byte_zero_ratio, round_even(hi, 6) AS byte_high_bit_ratio, round_even(a, 6) AS byte_ascii_ratio,
  round_even(x2, 6) AS byte_chi2_uniform, u AS byte_unique_count_log2, round_even(sp, 6) AS byte_range_span, floor(log2(rl))::DOUBLE AS byte_max_run_len_log2, {POS},
  {", ".join(f"contains(substr(whx, 1, 512), '{m}')::INT::DOUBLE AS {n}" for n, m in {"has_dex_magic": "6465780A3033", "has_elf_magic": "7F454C46", "has_png_magic": "89504E470D0A1A0A", "has_zip_local_header": "504B0304"}.items())}, {CTX}
FROM w JOIN run USING (container, window_id) JOIN bd USING (container, window_id) {NOBJ} {NB}, ob AS (PARTITION BY container, object_id)"""


def handcrafted(t, groups=tuple(X.GROUPS)):
    keep = ("container", "object_id", "object_path", "doc_id")
    w = W.with_stats(W.byte_windows(t.objects, WIDTH, STRIDE, MIN, keep=keep)).withColumn("runs", B.byte_runs("data"))
    w = w.withColumns(
        {
            "entropy": F.col("stats.entropy"),
            "printable_ratio": ratio(F.col("stats.printable"), F.col("n")),
        }
    )
    return X.handcrafted_table(w, "doc_id", C.object_type(F.col("object_path"), F.lit(bytearray(b""))), groups)


@query("f10_handcrafted_table", F10_SQL, ("wraw", "wpos"))
def f10(t):
    df = handcrafted(t)
    return df.select("container", "object_id", "window_id", *[r6(F.col(c)).alias(c) for c in df.columns[3:]])


@query(
    "b11_histogram_distance",
    """WITH s AS (SELECT a.container, a.object_id AS x, lead(a.object_id) OVER (PARTITION BY a.container ORDER BY a.object_id) AS y FROM objects a),
 tot AS (SELECT container, object_id, sum(c) AS n FROM obytes GROUP BY ALL),
 f AS (SELECT container, object_id, b, c / n AS p FROM obytes JOIN tot USING (container, object_id)),
 l AS (SELECT s.container, s.x, s.y, f.b, f.p AS p, 0.0e0 AS q FROM s JOIN f ON s.container = f.container AND s.x = f.object_id WHERE y IS NOT NULL
       UNION ALL SELECT s.container, s.x, s.y, f.b, 0.0e0, f.p FROM s JOIN f ON s.container = f.container AND s.y = f.object_id)
SELECT container, x AS left_id, y AS right_id, round_even(sum(d), 6) AS l1 FROM (SELECT container, x, y, b, abs(sum(p) - sum(q)) AS d FROM l GROUP BY ALL) GROUP BY ALL""",
    ("obytes",),
)
def b11(t):
    from ..operators.ordering import positions

    o = t.objects.select("container", "object_id", "doc_id", F.length("content").alias("n"), B.byte_histogram("content").alias("hist"))
    placed = positions(o.select("container", "object_id", "doc_id"), ["container"], [F.col("doc_id")])
    o = o.join(placed.select("object_id", "pos"), "object_id")
    right = o.select("container", F.col("object_id").alias("right_id"), (F.col("pos") - 1).alias("pos"), F.col("hist").alias("rh"), F.col("n").alias("rn"))
    pairs = o.withColumnRenamed("object_id", "left_id").join(right, ["container", "pos"])
    return pairs.select(
        "container", "left_id", "right_id", r6(B.histogram_l1(F.col("hist"), F.col("rh"), F.col("n"), F.col("rn"))).alias("l1")
    )


base.CTE["actx"] = f"""
  SELECT container, count(*) FILTER (k = 'dex') AS dex_count, count(*) FILTER (k = 'so') AS so_count, count(*) FILTER (k = 'asset') AS asset_count,
    count(*) FILTER (k = 'unknown') AS unknown_count, count(*) FILTER (n >= 256 AND e > 7.5) AS high_entropy_count, log2(greatest(sum(n), 1)) AS total_size_log2,
    count(*) AS total_entries FROM (SELECT container, object_id, CASE WHEN suffix(lower(object_path), '.so') THEN 'so' WHEN starts_with(lower(object_path), 'assets/') OR starts_with(lower(object_path), 'res/') THEN 'asset' ELSE 'unknown' END AS k, n
    FROM objects) JOIN (SELECT container, object_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM obytes GROUP BY ALL) USING (container, object_id) GROUP BY container"""
base.DEPENDS["actx"] = ("obytes",)


@query(
    "a12_container_context",
    "SELECT container, dex_count, so_count, asset_count, unknown_count, high_entropy_count, round_even(total_size_log2, 6) AS total_size_log2, total_entries, (dex_count > 1)::INT::DOUBLE AS is_multidex, (so_count > 0)::INT::DOUBLE AS has_native FROM actx",
    ("actx",),
)
def a12(t):
    return E.container_context(t.objects).withColumn("total_size_log2", r6(F.col("total_size_log2")))


PRINT_H = "sum(CASE WHEN b BETWEEN 32 AND 126 THEN c ELSE 0 END)"


@query(
    "b15_weighted_entropy",
    W4_SQL
    + """, o AS (SELECT *, least(n, 4096) AS hn, least(n, 1024) AS pn FROM objects),
 hb AS (SELECT container, object_id, b, count(*) AS c FROM (SELECT container, object_id, unnest(list_transform(range(0, hn), lambda k: ('0x' || substr(hx, 2 * k + 1, 2))::INTEGER)) AS b FROM o) GROUP BY ALL),
 h4 AS (SELECT container, object_id, sum(c * c) AS s2, sum(c) AS hn, count(*) AS u FROM hb GROUP BY ALL),
 pb AS (SELECT container, object_id, sum((b BETWEEN 32 AND 126)::INT) / count(*) AS hp FROM (SELECT container, object_id, unnest(list_transform(range(0, pn), lambda k: ('0x' || substr(hx, 2 * k + 1, 2))::INTEGER)) AS b FROM o) GROUP BY ALL),
 r AS (SELECT container, object_id, e, e * log2(greatest(n, 2)) AS we, coalesce(m, e) AS wm, coalesce(s, 0) AS ws, coalesce(mx - mn, 0) AS wr, log2(n) AS sl, (n > 100000)::INT AS lg,
   (s2 - 2 * h4.hn * (h4.hn / 256) + 256 * (h4.hn / 256) * (h4.hn / 256)) / greatest(h4.hn / 256, 1) / 256 AS chi, hp, contains(lower(object_path), 'classes')::INT AS pc, suffix(object_path, '.so')::INT AS ps, contains(object_path, 'assets/')::INT AS pa
   FROM o JOIN w USING (container, object_id) LEFT JOIN cs USING (container, object_id) JOIN h4 USING (container, object_id) JOIN pb USING (container, object_id))
SELECT container, object_id, unnest(['entropy', 'weighted_entropy', 'window_entropy_mean', 'window_entropy_std', 'window_entropy_range', 'size_log2', 'is_large', 'head_chi2', 'head_printable', 'is_dex', 'is_elf', 'is_zip', 'path_has_classes', 'path_is_so', 'path_has_assets']) AS feature,
  round_even(unnest([e, we, wm, ws, wr, sl, lg, chi + 1e-9, hp, 0, 0, 0, pc, ps, pa]::DOUBLE[]), 6) AS value FROM r""",
    ("obytes",),
)
def b15(t):
    f = E.weighted_entropy_features(t.objects, ["container", "object_id"])
    # dyadic chi-squares end in ties of the sixth decimal, which the two engines break differently
    f = f.withColumn("head_chi2", F.col("head_chi2") + 1e-9)
    return E.long_form(f, ["container", "object_id"], E.WEIGHTED)


TYPES = ["dex_header", "dex_code_item", "dex_string_data", "other"]


@query(
    "b16_section_coverage",
    """WITH p AS (SELECT container, window_id, greatest(offset_start, s0) AS a, least(offset_end, s1) AS z, section_type, offset_start AS w0, offset_end AS w1 FROM windows JOIN sections USING (container, object_id) WHERE offset_start < s1 AND s0 < offset_end),
 t AS (SELECT container, window_id, w1 - w0 AS n, """
    + ", ".join(f"coalesce(sum(CASE WHEN section_type = '{x}' THEN z - a END), 0) AS {x}" for x in TYPES[:3])
    + """, count(*) + CASE WHEN max(z) < max(w1) THEN 1 ELSE 0 END - 1 AS edges FROM p GROUP BY ALL),
 f AS (SELECT container, object_id, window_id, offset_end - offset_start AS n, coalesce(dex_header, 0) AS h, coalesce(dex_code_item, 0) AS c, coalesce(dex_string_data, 0) AS s, coalesce(edges, 0) AS edges
   FROM windows LEFT JOIN t USING (container, window_id))
SELECT container, object_id, window_id, round_even(h / n, 6) AS share_dex_header, round_even(c / n, 6) AS share_dex_code_item, round_even(s / n, 6) AS share_dex_string_data,
  round_even((n - h - c - s) / n, 6) AS share_other, round_even((CASE greatest(h, c, s, n - h - c - s) WHEN h THEN 0 WHEN c THEN 1 WHEN s THEN 2 ELSE 3 END) / 3, 6) AS dominant,
  round_even(log2(edges + 1), 6) AS boundaries_log2 FROM f""",
    ("windows", "sections"),
)
def b16(t):
    d = X.section_coverage(windows(t).drop("data"), sections(t).drop("section_index"), TYPES, "other")
    return d.select("container", "object_id", "window_id", *[r6(F.col(c)).alias(c) for c in d.columns[3:]])


@query(
    "b17_byte_sections",
    """WITH o2 AS (SELECT container, object_id, section_index, section_type, s0, s1 + 40 AS s1 FROM sections),
 w AS (SELECT container, object_id, window_id, unnest(range(offset_start, offset_end)) AS pos FROM windows),
 l AS (SELECT container, object_id, window_id, pos, coalesce(arg_max(section_type, section_index) FILTER (pos >= s0 AND pos < s1), 'other') AS st FROM w LEFT JOIN o2 USING (container, object_id) GROUP BY ALL),
 g AS (SELECT *, pos - row_number() OVER (PARTITION BY window_id, st ORDER BY pos) AS g FROM l)
SELECT container, object_id, window_id, st AS section_type, min(pos) AS run_start, max(pos) + 1 AS run_end FROM g GROUP BY container, object_id, window_id, st, g""",
    ("windows", "sections"),
)
def b17(t):
    overlapped = sections(t).withColumn("s_end", F.col("s_end") + 40)
    return X.byte_section_runs(windows(t).drop("data"), overlapped, "other")
