"""Pooling of items into bags and of objects into containers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..functions.scoring import sigmoid
from .ordering import positions, top_per_group


def vector_pool(rows: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise max and mean of equally long vectors, in long form (keys, dim, max, mean)."""
    return rows.select(*keys, F.posexplode(vector).alias("dim", "_v")).groupBy(*keys, "dim").agg(
        F.max("_v").cast("double").alias("max"), F.avg("_v").alias("mean")
    )


def top_mean_pool(rows: DataFrame, keys: Sequence[str], vector: str, order: Sequence[Column], k: int = 3) -> DataFrame:
    """Element-wise mean of the k best rows per key."""
    best = top_per_group(rows, keys, order, k)
    return best.select(*keys, F.posexplode(vector).alias("dim", "_v")).groupBy(*keys, "dim").agg(F.avg("_v").alias("top_mean"))


def as_vector(long: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Long pools back to one array per key: all ``parts`` of dim 0.., concatenated part by part."""
    pieces = [
        F.transform(F.array_sort(F.collect_list(F.struct("dim", p))), lambda s, p=p: s[p]).alias(f"_{p}") for p in parts
    ]
    return long.groupBy(*keys).agg(*pieces).select(*keys, F.concat(*[F.col(f"_{p}") for p in parts]).alias("features"))


def pool_windows(windows: DataFrame, keys: Sequence[str], features: Sequence[str], families: str, truth: str) -> DataFrame:
    """Mean of window features per object, union of families, max truth."""
    fam = windows.select(*keys, F.explode(families).alias("_f")).groupBy(*keys).agg(F.sort_array(F.collect_set("_f")).alias(families))
    agg = windows.groupBy(*keys).agg(
        *[F.avg(f).alias(f) for f in features], F.max(truth).alias(truth), F.count(F.lit(1)).alias("window_count")
    )
    none = F.array().cast("array<string>")
    return agg.join(fam, list(keys), "left").withColumn(families, F.coalesce(families, none))


def top_k_pool(items: DataFrame, bag: str, item: str, logit: str, k: int = 1, ratio: float = 0.0) -> DataFrame:
    """Mean of the k (or share) largest logits per bag; chosen items weigh 1/k."""
    sizes = items.groupBy(bag).agg(F.count(F.lit(1)).alias("_n"))
    want = F.greatest(F.lit(1), F.bround(F.col("_n") * ratio, 0).cast("bigint")) if ratio > 0 else F.lit(k)
    order = [F.col(logit).desc(), F.col(item)]
    placed = positions(items, [bag], order, name="_pos")
    j = placed.join(sizes, bag).withColumn("_k", F.least(want, F.col("_n"))).where(F.col("_pos") <= F.col("_k"))
    return j.select(bag, item, logit, (F.lit(1.0) / F.col("_k")).alias("weight"))


def top_k_bags(chosen: DataFrame, bag: str, logit: str) -> DataFrame:
    return chosen.groupBy(bag).agg(F.avg(logit).alias("bag_logit"), F.count(F.lit(1)).alias("k"))


def noisy_or(items: DataFrame, bag: str, logit: str, eps: float = 1e-6) -> DataFrame:
    """Bag probability 1 - prod(1 - p) in log space, its logit, and the sum of probabilities."""
    if not 0.0 < eps < 0.5:
        raise ValueError("eps must be in (0, 0.5)")
    p = sigmoid(F.col(logit))
    clamp = lambda x: F.least(F.greatest(x, F.lit(eps)), F.lit(1.0 - eps))
    agg = items.groupBy(bag).agg(F.sum(F.log1p(-clamp(p))).alias("_l"), F.sum(p).alias("p_sum"))
    pb = clamp(F.lit(1.0) - F.exp("_l"))
    return agg.select(bag, pb.alias("bag_probability"), (F.ln(pb) - F.log1p(-pb)).alias("bag_logit"), "p_sum")


def noisy_or_shares(items: DataFrame, bag: str, logit: str, eps: float = 1e-6) -> DataFrame:
    """Share of each item in its bag's total probability."""
    return items.join(noisy_or(items, bag, logit, eps), bag).withColumn("share", sigmoid(F.col(logit)) / F.col("p_sum"))


def attention_pool(items: DataFrame, bag: str, score: str, logit: str, normality: str | None = None, beta: float = 0.0) -> DataFrame:
    """Softmax weights over each bag from supplied scores (+ beta * (1 - normality)).

    Maxima and normalisers are pre-aggregated per bag and joined back.
    """
    s = F.col(score) + (F.lit(beta) * (F.lit(1.0) - F.col(normality)) if normality else F.lit(0.0))
    work = items.withColumn("_s", s)
    work = work.join(work.groupBy(bag).agg(F.max("_s").alias("_m")), bag).withColumn("_e", F.exp(F.col("_s") - F.col("_m")))
    return work.join(work.groupBy(bag).agg(F.sum("_e").alias("_z")), bag).withColumn("attention", F.col("_e") / F.col("_z")).drop("_s", "_m", "_e", "_z")


def attention_bags(weighted: DataFrame, bag: str, logit: str) -> DataFrame:
    return weighted.groupBy(bag).agg(F.sum(F.col("attention") * F.col(logit)).alias("bag_logit"))


MODES = ("attention", "attention_x_bag", "attention_anomaly", "instance_logit")


def localization_scores(items: DataFrame, bag: str, attention: str, bag_score: str, logit: str, mode: str, threshold: float = 0.5) -> DataFrame:
    """Item scores from attention and bag score; the anomaly mode scales its threshold by the bag score."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    top = items.groupBy(bag).agg(F.max(attention).alias("_top"))
    j = items.join(top, bag)
    share = F.when(F.col("_top") > 0, F.col(attention) / F.col("_top")).otherwise(F.col(attention))
    score = {
        "attention": share,
        "attention_x_bag": share * F.col(bag_score),
        "attention_anomaly": F.when(F.col("_top") > 0, (F.lit(1.0) - share) * F.col(bag_score)).otherwise(F.col(bag_score)),
        "instance_logit": sigmoid(F.col(logit)),
    }[mode]
    cut = F.lit(threshold) * F.col(bag_score) if mode == "attention_anomaly" else F.lit(threshold)
    return j.withColumns({"item_score": score, "item_threshold": cut}).withColumn(
        "predicted_label_id", (F.col("item_score") >= F.col("item_threshold")).cast("int")
    ).drop("_top")


def container_baselines(objects: DataFrame, min_bytes: int = 64) -> DataFrame:
    """Nine training-free scores per container; containers without usable objects score 0.

    objects: container, object_path, size, entropy.
    """
    p = F.lower("object_path")
    used = objects.where(F.col("size") >= min_bytes)
    log = lambda c, floor: F.log2(F.greatest(c, F.lit(floor)).cast("double"))
    agg = used.groupBy("container").agg(
        (F.max("entropy") / 8.0).alias("max_entropy"),
        F.max(F.col("entropy") * log(F.col("size"), 2)).alias("max_weighted_entropy"),
        F.log2(F.max("size").cast("double")).alias("max_entry_size_log2"),
        F.log2(F.count(F.lit(1)) + F.lit(1.0)).alias("n_entries_log2"),
        F.count_if(p.endswith(".dex") | p.startswith("classes")).cast("double").alias("dex_entry_count"),
        F.count_if(p.endswith(".so")).cast("double").alias("so_entry_count"),
        F.count_if(p.startswith("assets/")).cast("double").alias("asset_entry_count"),
    )
    top = top_per_group(used.select("container", "entropy"), ["container"], [F.col("entropy").desc()], 3)
    top = top.groupBy("container").agg((F.avg("entropy") / 8.0).alias("mean_top3_entropy"))
    whole = objects.groupBy("container").agg(log(F.sum("size"), 1).alias("container_size_log2"))
    out = whole.join(agg, "container", "left").join(top, "container", "left")
    names = [c for c in out.columns if c != "container"]
    return out.select("container", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names])



def hardness_profile(objects: DataFrame) -> DataFrame:
    """Seven structure flags per container and how many are set.

    objects: container, object_path, object_type, size, entropy.
    """
    p = F.lower(F.translate("object_path", "\\", "/"))
    abi = F.when(p.rlike(r"^lib/.*\.so$") & (F.size(F.split(p, "/")) >= 3), F.split(p, "/")[1])
    n = lambda *t: F.count_if(F.col("object_type").isin(*t))
    abis = objects.select("container", abi.alias("abi")).where("abi IS NOT NULL").distinct().groupBy("container").agg(
        F.sort_array(F.collect_set("abi")).alias("native_abis")
    )
    agg = objects.groupBy("container").agg(
        F.count(F.lit(1)).alias("entry_count"), n("dex").alias("dex_count"), n("native_lib").alias("native_lib_count"),
        n("asset_blob", "resource").alias("asset_resource_count"), F.max("size").alias("largest_entry_size"),
        F.sum("size").alias("container_size"), r6(F.max("entropy")).alias("max_entropy"),
        F.count_if((F.col("entropy") >= 7.2) & (F.col("size") >= 64 * 1024)).alias("high_entropy_entry_count"),
    )
    j = agg.join(abis, "container", "left").withColumn("native_abis", F.coalesce("native_abis", F.array().cast("array<string>")))
    c = F.col
    flags = {
        "large_apk": c("container_size") >= 20 * 1024 * 1024,
        "native_heavy": (c("native_lib_count") >= 4) | (F.size("native_abis") >= 2),
        "asset_heavy": c("asset_resource_count") >= 40,
        "multi_dex": c("dex_count") >= 2,
        "high_entropy": (c("high_entropy_entry_count") >= 1) | (c("max_entropy") >= 7.5),
        "large_entry": c("largest_entry_size") >= 5 * 1024 * 1024,
        "many_entries": c("entry_count") >= 200,
    }
    score = sum((x.cast("int") for x in flags.values()), F.lit(0))
    return j.withColumns(flags).withColumn("hardness_score", score)


def majority_type(items: DataFrame, keys: Sequence[str], kind: str, ordinal: str) -> DataFrame:
    """Most frequent type per key; the one seen first wins ties."""
    counts = items.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"), (-F.min(ordinal)).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(kind, F.struct("n", "_first")).alias(kind), F.max("n").alias("votes"))
