"""Corpus and batch summaries, candidate ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_int, r6
from ..functions.scoring import sigmoid
from .ordering import top_per_group


def top_by_metric(items: DataFrame, group: Sequence[str], item: str, metrics: Sequence[str], k: int) -> DataFrame:
    """Best k items per group for each of several metrics, with rank."""
    long = items.select(*group, item, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in metrics])))
    return top_per_group(long, [*group, "metric"], [F.col("score").desc(), F.col(item)], k)


def select_candidates(rows: DataFrame, key: str, digest: str, order: Sequence[Column], per_key: int, accept: Column, final: Sequence[Column], limit: int) -> DataFrame:
    """Best ``per_key`` rows per key, accepted ones, one per digest, then a global top ``limit``."""
    best = top_per_group(rows, [key], order, per_key, "_r").where(accept)
    one = best.groupBy(F.lower(digest).alias("_d")).agg(F.min_by(F.struct(*rows.columns), F.struct(key, "_r")).alias("b"))
    return one.where("_d <> ''").select("b.*").orderBy(*final).limit(limit)


def pick_version(versions: DataFrame, app: str, suggested: str, max_sdk: int = 16) -> DataFrame:
    """Oldest version that still runs on ``max_sdk``, else the suggested one, else the newest."""
    sdk = F.coalesce(F.col("min_sdk"), F.lit(999))
    tier = F.when(sdk <= max_sdk, 0).when(F.col("version_code") == F.col(suggested), 1).otherwise(2)
    order = F.when(tier == 0, F.col("added")).when(tier == 1, F.lit(0)).otherwise(-F.col("added"))
    pick = F.min_by(F.struct("version_code", "added", tier.alias("tier")), F.struct(tier.alias("t"), order.alias("o"), "version_code"))
    return versions.groupBy(app).agg(pick.alias("b")).select(app, "b.*")


def examples(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column], k: int) -> DataFrame:
    """Up to k example values per key; rows are cut to k before they are gathered."""
    best = top_per_group(df.select(*keys, value, *[c.alias(f"_o{i}") for i, c in enumerate(order)]), keys, [F.col(f"_o{i}") for i in range(len(order))], k, "_r")
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v")))), lambda s: s["v"]).alias("examples"))


def bucket_summary(df: DataFrame, bucket: str, score: str, item: str, k: int = 3) -> DataFrame:
    """Count, mean, max and best examples per bucket."""
    agg = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("high_score_count"), r6(F.avg(score)).alias("mean_score"), F.max(score).alias("max_score"))
    ex = examples(df, [bucket], item, [-F.col(score), F.col(item)], k)
    return agg.join(ex, bucket, "left")


def corpus_summary(df: DataFrame) -> DataFrame:
    """Totals per source and family with all sub-totals in one pass.

    df: source, family, packed, native, nested (nullable booleans); NULL is its own bucket.
    """
    t = lambda c: F.count_if(F.col(c)).alias(f"n_{c}")
    return df.rollup("source", "family").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("samples"), t("packed"), t("native"), t("nested"),
        r6(F.avg(F.when(F.col("packed"), 1.0).otherwise(0.0))).alias("packed_rate"),
    )


def flag_crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of two nullable flags; NULL shown as 'unknown'."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)
    return df.select(name(row), name(column)).groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))


def suspected_histogram(df: DataFrame, families: str) -> DataFrame:
    """Packer histogram overall and per source (source '*' = all)."""
    one = df.where("packed").select("source", F.explode(families).alias("packer")).groupBy("source", "packer").agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(one.groupBy("packer").agg(F.sum("n").alias("n")).withColumn("source", F.lit("*")).select(*one.columns))


def coverage_index(df: DataFrame, app: str, packer: str, api: str) -> DataFrame:
    """Per app the packers with their API levels; vocabularies are small sets."""
    per = df.groupBy(app, packer).agg(F.sort_array(F.collect_set(api)).alias("apis"))
    return per.groupBy(app).agg(
        F.count(F.lit(1)).alias("n_packers"),
        F.array_join(F.array_sort(F.collect_list(F.concat(F.col(packer), F.lit(":"), F.array_join("apis", "+")))), ",").alias("packers"),
    )


def packer_coverage(df: DataFrame, app: str, packer: str) -> DataFrame:
    return df.groupBy(packer).agg(F.countDistinct(app).alias("n_apps"), F.count(F.lit(1)).alias("rows"))


def yearly_profile(df: DataFrame, key: str, date: str, item: str, k: int = 5) -> DataFrame:
    """Rows per key, histogram by year ('unknown' for NULL) and up to k examples."""
    year = F.coalesce(F.year(date).cast("string"), F.lit("unknown"))
    hist = df.groupBy(key, year.alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    agg = hist.groupBy(key).agg(
        F.sum("_n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat("_y", F.lit("="), F.col("_n").cast("string")))), ",").alias("by_year")
    )
    return agg.join(examples(df, [key], item, [F.col(item)], k), key)


def batch_summary(pairs: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Totals and one histogram per dimension: (dimension, value, n, n_review)."""
    cells = pairs.groupBy(*dims).agg(F.count(F.lit(1)).alias("_n"), F.sum(as_int(F.col("needs_manual_review"))).alias("_r"))
    table = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("*").alias("value")),
        *[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("none")).alias("value")) for d in dims],
    )
    return cells.select("_n", "_r", F.inline(table)).groupBy("dimension", "value").agg(F.sum("_n").alias("n"), F.sum("_r").alias("n_review"))


def labelled_training_rows(windows: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """All windows of probed samples with the container's label."""
    s = samples.where("label IS NOT NULL").select(key, F.col("label").alias("label_id"))
    return windows.join(s, key)


def inventory(files: DataFrame, source: str, family: str, path: str, size: str, k: int = 3) -> DataFrame:
    """Files, bytes and up to k sample paths per (source, family), with source and grand totals.

    A NULL path marks a family folder without files.
    """
    agg = files.rollup(source, family).agg(F.grouping_id().alias("level"), F.count(path).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    ex = examples(files.where(F.col(path).isNotNull()), [source, family], path, [F.col(path)], k).withColumn("level", F.lit(0).cast("bigint"))
    return agg.join(ex, [source, family, "level"], "left")


def contribution_scores(items: DataFrame, attention: str, logit: str) -> DataFrame:
    return items.withColumn("contribution", F.col(attention) * sigmoid(F.col(logit)))


def eligible_rows(manifest: DataFrame, path: str, ordinal: str, limit: int, require_hard: bool = False) -> DataFrame:
    """Train-allowed clean rows of a manifest, one per case-insensitive path, the first ``limit`` by ``ordinal``.

    manifest: train_allowed, clean, label_class, ``path``, ``ordinal``.
    """
    classes = ["benign-hard-clean"] if require_hard else ["benign-clean", "benign-hard-clean"]
    ok = manifest.where(F.col("train_allowed") & F.col("clean") & F.col("label_class").isin(*classes) & (F.col(path) != ""))
    first = ok.groupBy(F.lower(path).alias("_k")).agg(F.min_by(F.struct(*manifest.columns), ordinal).alias("b"))
    return first.select("b.*").orderBy(ordinal).limit(limit)
