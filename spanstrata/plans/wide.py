"""Wide feature vectors and manifest eligibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators import features as E
from ..operators import summaries as S
from ..operators import windows as W
from .base import query
from . import base, features  # noqa: F401  (features defines the byte relations)

# Histogram part and scalar statistics of the object vector, in long form.
B14_SQL = """WITH tot AS (SELECT container, object_id, sum(c) AS n, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e, sum(CASE WHEN b BETWEEN 32 AND 126 THEN c ELSE 0 END) / sum(c) AS v FROM obytes GROUP BY ALL)
SELECT container, object_id, printf('hist_%03d', b) AS feature, round_even(c / n, 6) AS value FROM obytes JOIN tot USING (container, object_id)
UNION ALL SELECT container, object_id, unnest(['entropy', 'visible_ratio', 'size_log2']), round_even(unnest([e, v, log2(n)]), 6) FROM tot"""


def object_vectors(t):
    o = t.objects.select("container", "object_id", "object_path", "content", F.lit(1.0).alias("compression_ratio"))
    return E.object_vectors(o, E.container_context(t.objects), ["container", "object_id"])


@query("b14_object_vectors")
def b14(t):
    return E.vector_rows(object_vectors(t), ["container", "object_id"], E.OBJECT_NAMES)


@query("b14_object_vector_base", f"SELECT * FROM ({B14_SQL}) WHERE value <> 0", ("obytes",))
def b14_base(t):
    rows = E.vector_rows(object_vectors(t), ["container", "object_id"], E.OBJECT_NAMES)
    return rows.where("(feature LIKE 'hist%' OR feature IN ('entropy', 'visible_ratio', 'size_log2')) AND value <> 0")


def window_vectors(t):
    keep = ("container", "object_id", "object_path", "doc_id", "content")
    w = W.typed_windows(t.objects, 512, 256, keep=keep)
    rows = w.select(
        "container", "object_id", "object_path", "window_index", "n_windows", "offset_start", "offset_end", "section_type",
        C.entry_type(F.col("object_path"), F.col("content")).alias("entry_type"), F.col("doc_id").alias("entry_index"),
        F.length("content").alias("entry_size"), F.lit(0.5).alias("compression_ratio"),
        F.substring(F.col("content"), (F.col("offset_start") + 1).cast("int"), F.lit(512)).alias("data"),
    )
    return E.window_vectors(rows, E.container_context(t.objects), ["container", "object_id", "window_index"])


@query("b13_window_vectors")
def b13(t):
    return E.vector_rows(window_vectors(t), ["container", "object_id", "window_index"], E.VECTOR_NAMES)


base.CTE["tw"] = """
  SELECT container, object_id, object_path, n, i - 1 AS window_index, st[i] AS s, least(st[i] + 512, n) AS e, substr(hx, 2 * st[i] + 1, 1024) AS whx, len(st) AS nw
  FROM (SELECT *, unnest(range(1, len(st) + 1)) AS i FROM (SELECT *, CASE WHEN n < 256 THEN [0] ELSE list_filter(range(0, n, 256), lambda x: n - x >= 256) END AS st FROM objects))"""
base.DEPENDS["tw"] = ("objects",)


@query(
    "b13_window_vector_base",
    """WITH wb AS (SELECT container, object_id, window_index, b, count(*) AS c FROM (SELECT container, object_id, window_index, unnest(list_transform(range(0, e - s), lambda k: ('0x' || substr(whx, 2 * k + 1, 2))::INTEGER)) AS b FROM tw) GROUP BY ALL),
 g AS (SELECT container, object_id, window_index, sum(c) AS m, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS ent, count(*) / 256 AS u, sum(CASE WHEN b >= 128 THEN c ELSE 0 END) / sum(c) AS hi FROM wb GROUP BY ALL),
 r AS (SELECT container, object_id, window_index::INTEGER AS window_index, unnest(['entropy', 'unique_share', 'high_ratio', 'size_log2', 'offset_share', 'index_share', 'size_share', 'entry_size_log2', 'compression_ratio']) AS feature,
   round_even(unnest([ent, u, hi, log2(m), s / n, window_index / nw, (e - s) / n, log2(n), 0.5]::DOUBLE[]), 6) AS value FROM g JOIN tw USING (container, object_id, window_index))
SELECT * FROM r WHERE value <> 0""",
    ("tw",),
)
def b13_base(t):
    rows = E.vector_rows(window_vectors(t), ["container", "object_id", "window_index"], E.VECTOR_NAMES)
    names = ["entropy", "unique_share", "high_ratio", "size_log2", "offset_share", "index_share", "size_share", "entry_size_log2", "compression_ratio"]
    return rows.where(F.col("feature").isin(*names) & (F.col("value") != 0))


@query(
    "p20_eligible_rows",
    """SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name), p_brand ORDER BY p_partkey) AS r FROM part WHERE p_size % 3 > 0 AND p_type <> 'ECONOMY' AND p_brand <> 'Brand#9')
WHERE r = 1 ORDER BY p_partkey LIMIT 100""",
)
def p20(t):
    m = t.part.select(
        "p_partkey", "p_name", F.concat("p_name", F.lit("/"), "p_brand").alias("path"), (F.col("p_size") % 3 > 0).alias("train_allowed"), (F.col("p_type") != "ECONOMY").alias("clean"),
        F.when(F.col("p_brand") == "Brand#9", "benign-borderline").when(F.col("p_size") > 20, "benign-hard-clean").otherwise("benign-clean").alias("label_class"),
    )
    return S.eligible_rows(m, "path", "p_partkey", 100).select("p_partkey", "p_name")


@query(
    "u5_unzip_table_function",
    """SELECT doc_id::VARCHAR AS container, object_path, depth, n FROM (
  SELECT doc_id, concat('assets/', lang, '.txt') AS object_path, 0 AS depth, octet_length(encode(text))::INTEGER AS n FROM documents WHERE doc_id % 50 <> 7
  UNION ALL SELECT doc_id, 'lib/x/a.so', 0, 4 FROM documents WHERE doc_id % 50 <> 7 AND doc_id % 2 = 0
  UNION ALL SELECT doc_id, 'assets/x.dex', 0, 4 FROM documents WHERE doc_id % 50 <> 7 AND doc_id % 5 = 0
  UNION ALL SELECT doc_id, 'assets/inner.zip!classes.dex', 1, octet_length(encode(text))::INTEGER FROM documents WHERE doc_id % 50 <> 7 AND doc_id % 3 = 0
  UNION ALL SELECT doc_id, 'assets/inner.zip', 0, NULL FROM documents WHERE doc_id % 50 <> 7 AND doc_id % 3 = 0)""",
)
def u5(t):
    from ..sources.archives import register_unzip
    from .files import archives

    register_unzip(t.spark)
    return t.spark.sql(
        "SELECT {a}.container, m.object_path, m.depth, CASE WHEN m.object_path <> 'assets/inner.zip' THEN length(m.content) END AS n "
        "FROM {a}, LATERAL unzip_members({a}.archive, 1) m WHERE m.error IS NULL",
        a=archives(t),
    )
