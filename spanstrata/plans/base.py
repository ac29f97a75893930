"""Query registry and the relations the queries start from.

``Tables`` maps the given tables to the library's concepts (containers, objects,
payload intervals, scored items ...); ``CTE`` states the same relations in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query; ``uses`` names the shared CTEs its oracle needs, in order."""

    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql, *uses)
        return fn

    return register


def with_ctes(body: str, *names: str) -> str:
    ordered: list[str] = []

    def add(n):
        for dep in DEPENDS.get(n, ()):
            add(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    if not ordered:
        return body
    heads = ",\n".join(f"{n} AS ({CTE[n]})" for n in ordered)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


def dealt(df: DataFrame) -> DataFrame:
    """Deals the rows out evenly if the session asks for it in ``spanstrata.spread``.

    Files of one row group cannot be split by a scan; whoever reads a few of them sets the
    number of partitions.  Without the setting nothing is shuffled, whatever the input's size.
    """
    n = df.sparkSession.conf.get("spanstrata.spread", None)
    return df.repartition(int(n)) if n else df


# One text for both engines.
PATH_SQL = (
    "concat(CASE doc_id % 7 WHEN 0 THEN 'lib/' WHEN 1 THEN 'assets/' WHEN 2 THEN 'res/raw/' WHEN 3 THEN 'META-INF/' "
    "WHEN 4 THEN '' WHEN 5 THEN 'classes' ELSE 'res/' END, source, '/', doc_id, "
    "CASE doc_id % 5 WHEN 0 THEN '.dex' WHEN 1 THEN '.so' WHEN 2 THEN '.zip' WHEN 3 THEN '.txt' ELSE '' END)"
)
# Leading magic bytes for the classification queries, as hex.
HEAD_SQL = (
    "CASE doc_id % 13 WHEN 0 THEN '6465780A30333500' WHEN 1 THEN '7F454C46' WHEN 2 THEN '504B0304' WHEN 3 THEN '504B0506' "
    "WHEN 4 THEN '1F8B08' WHEN 5 THEN '89504E470D0A1A0A' WHEN 6 THEN '02000C00' WHEN 7 THEN '0300080000000000' "
    "WHEN 8 THEN 'FFD8FF' WHEN 9 THEN '474946383961' ELSE '' END"
)
PROBE_PATH_SQL = (
    "CASE doc_id % 17 WHEN 0 THEN 'classes.dex' WHEN 1 THEN 'classes2.dex' WHEN 2 THEN 'AndroidManifest.xml' "
    "WHEN 3 THEN 'resources.arsc' WHEN 4 THEN concat('inner', chr(92), 'app.apk') ELSE " + PATH_SQL + " END"
)
SCORE_SQL = "4.0e0 * l_discount + 3.75e0 * l_tax + 0.006e0 * l_quantity"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def objects(self) -> DataFrame:
        """container, object_id, object_path, content and the source columns of a document."""
        return dealt(self.documents).select(
            F.col("source").alias("container"),
            F.format_string("%s:%06d", "source", "doc_id").alias("object_id"),
            F.expr(PATH_SQL).alias("object_path"),
            F.encode("text", "UTF-8").alias("content"),
            "doc_id",
            "lang",
        )

    @cached_property
    def probes(self) -> DataFrame:
        """Objects with varied paths and leading magic bytes, for classification."""
        return dealt(self.documents).select(
            "doc_id",
            F.col("source").alias("container"),
            F.expr(PROBE_PATH_SQL).alias("object_path"),
            F.concat(F.unhex(F.expr(HEAD_SQL)), F.encode("text", "UTF-8")).alias("content"),
        )

    @cached_property
    def passages(self) -> DataFrame:
        return self.benchmark.select("item_id", F.encode("text", "UTF-8").alias("needle"))

    @cached_property
    def payloads(self) -> DataFrame:
        from ..operators.passages import locate_passages

        hits = locate_passages(self.objects.select("container", "object_id", "object_path", "content"), self.passages)
        return hits.withColumn("transform_family", F.concat(F.lit("fam"), (F.col("item_id") % 5).cast("string")))

    @cached_property
    def scored(self) -> DataFrame:
        """Items with a truth, a score in [0, 1], a second score, a group, a family and a fold."""
        return self.lineitem.select(
            "l_orderkey",
            "l_linenumber",
            F.col("l_suppkey").alias("suppkey"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("truth"),
            F.bround(F.expr(SCORE_SQL), 6).alias("score"),
            F.bround(F.col("l_extendedprice") / 110000.0, 6).alias("score_b"),
            F.concat(F.lit("fam"), (F.col("l_suppkey") % 7).cast("string")).alias("family"),
            (F.col("l_partkey") % 5).cast("int").alias("fold"),
        )


CTE = {
    "objects": f"""
  SELECT source AS container, printf('%s:%06d', source, doc_id) AS object_id, {PATH_SQL} AS object_path,
         hex(encode(text)) AS hx, octet_length(encode(text)) AS n, doc_id, lang, text
  FROM documents""",
    "probes": f"""
  SELECT doc_id, source AS container, {PROBE_PATH_SQL} AS object_path,
         concat({HEAD_SQL}, hex(encode(text))) AS hx
  FROM documents""",
    "windows": """
  SELECT container, object_id, object_path, n AS object_size, i - 1 AS window_index,
         printf('%s:r%06d', object_id, i - 1) AS window_id, starts[i] AS offset_start,
         least(starts[i] + 512, n) AS offset_end, substr(hx, 2 * starts[i] + 1, 1024) AS whx,
         least(starts[i] + 512, n) - starts[i] AS wn
  FROM (SELECT *, unnest(range(1, len(starts) + 1)) AS i
        FROM (SELECT *, CASE WHEN n = 0 THEN [] WHEN n <= 512 THEN [0]
                ELSE list_sort(list_distinct(list_append(range(0, n - 512 + 1, 256), n - 512))) END AS starts
              FROM objects))
  WHERE least(starts[i] + 512, n) - starts[i] >= 64""",
    "wbytes": """
  SELECT container, window_id, b, count(*) AS c
  FROM (SELECT container, window_id, unnest(from_hex_bytes) AS b
        FROM (SELECT container, window_id,
                     list_transform(range(0, wn), lambda k: ('0x' || substr(whx, 2 * k + 1, 2))::INTEGER) AS from_hex_bytes
              FROM windows))
  GROUP BY ALL""",
    "wstats": """
  SELECT container, window_id,
         round_even(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy,
         round_even(sum(CASE WHEN b BETWEEN 32 AND 126 OR b IN (9, 10, 13) THEN c ELSE 0 END) / sum(c), 6) AS printable_ratio
  FROM wbytes GROUP BY ALL""",
    "payloads": """
  SELECT container, object_id, object_path, item_id, p AS offset_start, p + octet_length(encode(b.text)) AS offset_end,
         sha256(b.text) AS payload_sha256, concat('fam', item_id % 5) AS transform_family
  FROM (SELECT o.container, o.object_id, o.object_path, b.item_id, b.text,
               octet_length(encode(split_part(o.text, b.text, 1))) AS p
        FROM objects o JOIN benchmark b ON contains(o.text, b.text)) b""",
    "labelled": """
  SELECT w.container, w.object_id, w.object_path, w.window_id, w.window_index, w.offset_start, w.offset_end,
         w.wn AS size, s.entropy, s.printable_ratio,
         CASE WHEN coalesce(m.k, 0) > 0 THEN 1 ELSE 0 END AS label_id,
         coalesce(u.bytes, 0) AS overlap_bytes, coalesce(m.iou, 0) AS max_iou, coalesce(m.k, 0) AS k,
         coalesce(m.fams, []) AS fams, coalesce(m.shas, []) AS shas
  FROM windows w JOIN wstats s USING (container, window_id)
  LEFT JOIN (
    SELECT container, window_id, max(iou) AS iou, count(*) FILTER (ok) AS k,
           coalesce(list_sort(list(DISTINCT transform_family) FILTER (ok)), []) AS fams,
           coalesce(list_sort(list(DISTINCT payload_sha256) FILTER (ok)), []) AS shas
    FROM (SELECT w.container, w.window_id, p.*, ov / (greatest(w.offset_end, p.offset_end) - least(w.offset_start, p.offset_start)) AS iou,
                 ov >= 64 AND ov / (w.offset_end - w.offset_start) >= 0.1 AS ok
          FROM windows w JOIN payloads p ON w.container = p.container AND w.object_path = p.object_path
               AND w.offset_start < p.offset_end AND p.offset_start < w.offset_end,
               LATERAL (SELECT least(w.offset_end, p.offset_end) - greatest(w.offset_start, p.offset_start) AS ov))
    GROUP BY ALL) m USING (container, window_id)
  LEFT JOIN (
    SELECT container, window_id, count(DISTINCT pos) AS bytes
    FROM (SELECT w.container, w.window_id,
                 unnest(range(greatest(w.offset_start, p.offset_start), least(w.offset_end, p.offset_end))) AS pos
          FROM windows w JOIN payloads p ON w.container = p.container AND w.object_path = p.object_path
               AND w.offset_start < p.offset_end AND p.offset_start < w.offset_end)
    GROUP BY ALL) u USING (container, window_id)""",
    # threshold 4.3 suits text the way 7.0 suits archives
    "predicted": """
  SELECT *, round_even(entropy + (1.0e0 - printable_ratio), 6) AS score,
         CASE WHEN round_even(entropy + (1.0e0 - printable_ratio), 6) >= 4.3 THEN 1 ELSE 0 END AS predicted_label_id
  FROM labelled""",
    "pobjects": """
  SELECT container, object_id, object_path, max(score) AS score,
         CASE WHEN max(score) >= 4.3 THEN 1 ELSE 0 END AS predicted_label_id,
         max(label_id) AS true_label_id, count(*) AS window_count, sum(predicted_label_id)::BIGINT AS predicted_window_count,
         sum(label_id)::BIGINT AS positive_window_count,
         min(CASE WHEN predicted_label_id = 1 THEN offset_start END) AS predicted_offset_start,
         max(CASE WHEN predicted_label_id = 1 THEN offset_end END) AS predicted_offset_end
  FROM predicted GROUP BY container, object_id, object_path""",
    "pcontainers": """
  SELECT container, max(score) AS score, CASE WHEN max(score) >= 4.3 THEN 1 ELSE 0 END AS predicted_label_id,
         max(true_label_id) AS true_label_id, count(*) AS object_count,
         sum(predicted_label_id)::BIGINT AS predicted_object_count, sum(true_label_id)::BIGINT AS positive_object_count,
         sum(window_count)::BIGINT AS window_count, sum(predicted_window_count)::BIGINT AS predicted_window_count,
         sum(positive_window_count)::BIGINT AS positive_window_count
  FROM pobjects GROUP BY container""",
    "scored": f"""
  SELECT l_orderkey, l_linenumber, l_suppkey AS suppkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS truth,
         round_even({SCORE_SQL}, 6) AS score, round_even(l_extendedprice / 110000.0e0, 6) AS score_b,
         concat('fam', l_suppkey % 7) AS family, (l_partkey % 5)::INTEGER AS fold
  FROM lineitem""",
    "curve": """
  SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM (SELECT score, sum(truth) AS pos, sum(1 - truth) AS neg FROM scored GROUP BY score)
  WINDOW w AS (ORDER BY score DESC)""",
    "famcurve": """
  SELECT family, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER (PARTITION BY family) AS p, sum(neg) OVER (PARTITION BY family) AS n
  FROM (SELECT family, score, sum(truth) AS pos, sum(1 - truth) AS neg FROM scored GROUP BY family, score)
  WINDOW w AS (PARTITION BY family ORDER BY score DESC)""",
}
DEPENDS = {
    "windows": ("objects",),
    "wbytes": ("windows",),
    "wstats": ("wbytes",),
    "payloads": ("objects",),
    "labelled": ("wstats", "payloads"),
    "predicted": ("labelled",),
    "pobjects": ("predicted",),
    "pcontainers": ("pobjects",),
    "curve": ("scored",),
    "famcurve": ("scored",),
}
