"""Exact evaluation metrics as grouped aggregations.

Rows are first collapsed to counts per distinct score; cumulative counts over
the scores then come from ``prefix_sums``, so neither a large
fold nor a single global ordering ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_int, r6, ratio
from .intervals import boundary_error, set_iou, set_overlap
from .ordering import prefix_sums

ALL = "_all"


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn(ALL, F.lit(0)), [ALL])


def _unkeyed(df: DataFrame) -> DataFrame:
    return df.drop(ALL)


def confusion_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "precision": r6(ratio(tp, tp + fp)),
        "recall": r6(ratio(tp, tp + fn)),
        "f1": r6(ratio(tp * 2, tp * 2 + fp + fn)),
        "accuracy": r6(ratio(tp + tn, tp + fp + fn + tn)),
    }


def confusion_report(df: DataFrame, truth: Column, predicted: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, precision, recall, F1, accuracy; 0 for empty denominators."""
    t, p = truth == 1, predicted == 1
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("support"),
        F.count_if(t).alias("positives"),
        F.count_if(p).alias("predicted_positives"),
        F.count_if(t & p).alias("true_positives"),
        F.count_if(~t & p).alias("false_positives"),
        F.count_if(t & ~p).alias("false_negatives"),
        F.count_if(~t & ~p).alias("true_negatives"),
    )
    c = [F.col(x) for x in ("true_positives", "false_positives", "false_negatives", "true_negatives")]
    return agg.withColumns(confusion_columns(*c))


def hard_labels(df: DataFrame, score: Column, threshold: float, name: str = "predicted_label_id") -> DataFrame:
    return df.withColumn(name, as_int(score >= threshold))


def score_counts(df: DataFrame, score: Column, truth: Column, keys: Sequence[str]) -> DataFrame:
    """Rows of each distinct score by truth; rows without a score are left out."""
    slim = df.select(*keys, score.cast("double").alias("score"), truth.alias("_y")).where("score IS NOT NULL")
    return slim.groupBy(*keys, "score").agg(
        F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") != 1).alias("neg")
    )


def score_curve(df: DataFrame, score: Column, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: own counts, counts at or above it (tp, fp) and class totals."""
    work, k = _keyed(df, keys)
    return curve_of_counts(score_counts(work, score, truth, k), k)


def curve_of_counts(counts: DataFrame, k: Sequence[str]) -> DataFrame:
    sums = {"tp": (F.col("pos"), True), "fp": (F.col("neg"), True)}
    return prefix_sums(counts, k, [F.col("score").desc()], sums, {"positives": "tp", "negatives": "fp"})


def ranking_quality(df: DataFrame, score: Column, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    """AUROC (ties count half) and average precision (ties grouped); NULL with one class only."""
    work, k = _keyed(df, keys)
    return quality_of_counts(score_counts(work, score, truth, k), k)


def quality_of_counts(counts: DataFrame, k: Sequence[str]) -> DataFrame:
    """``ranking_quality`` from ``score_counts``.

    The class totals are the last running counts, so they need no join with every score: the
    pairs that positives win are all pairs less those that they lose.
    """
    curve = prefix_sums(counts, k, [F.col("score").desc()], {"tp": (F.col("pos"), True), "fp": (F.col("neg"), True)})
    d = {c: F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp")}
    agg = curve.groupBy(*k).agg(
        F.max("tp").alias("positives"),
        F.max("fp").alias("negatives"),
        F.sum(d["pos"] * (d["fp"] - d["neg"] / 2.0)).alias("_l"),
        F.sum(d["pos"] * d["tp"] / (d["tp"] + d["fp"])).alias("_s"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    return _unkeyed(
        agg.select(
            *k,
            "positives",
            "negatives",
            r6(F.when(both, (p * n - F.col("_l")) / (p * n))).alias("auroc"),
            r6(F.when(both, F.col("_s") / p)).alias("auprc"),
        )
    )


def first_hits(df: DataFrame, group: Sequence[str], score: Column, truth: Column) -> DataFrame:
    """Per group: does it hold a positive, and the rank of its best one (positives win ties).

    The rank is 1 + the number of items scored above the best positive, so two
    aggregations replace a sort of each group.
    """
    g = list(group)
    slim = df.select(*g, score.cast("double").alias("_s"), truth.alias("_y"))
    best = slim.groupBy(*g).agg(F.max(F.when(F.col("_y") == 1, F.col("_s"))).alias("_best"))
    per_score = slim.groupBy(*g, "_s").agg(F.count(F.lit(1)).alias("_n"))
    return (
        per_score.join(best, g)
        .groupBy(*g)
        .agg(
            F.max("_best").alias("best_positive_score"),
            F.sum(F.when(F.col("_s") > F.col("_best"), F.col("_n")).otherwise(0)).alias("_above"),
        )
        .select(
            *g,
            "best_positive_score",
            F.when(F.col("best_positive_score").isNotNull(), F.col("_above") + 1).alias("first_hit"),
        )
    )


def ranking_report(
    df: DataFrame, group: Sequence[str], score: Column, truth: Column, keys: Sequence[str] = (), ks: Sequence[int] = (1, 3, 5)
) -> DataFrame:
    """Mean reciprocal rank and hit@k over groups with a positive."""
    if any(k <= 0 for k in ks):
        raise ValueError("all k values must be positive")
    hits = first_hits(df, [*keys, *group], score, truth)
    known = F.col("first_hit").isNotNull()
    return hits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("group_count"),
        F.count_if(known).alias("evaluated_group_count"),
        r6(F.coalesce(F.avg(F.lit(1.0) / F.col("first_hit")), F.lit(0.0))).alias("mrr"),
        *[
            r6(F.coalesce(F.avg(F.when(known, as_int(F.col("first_hit") <= k).cast("double"))), F.lit(0.0))).alias(f"top_{k}_hit")
            for k in ks
        ],
    )


def localization_samples(samples: DataFrame, truth: DataFrame, prediction: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per sample: IoU, boundary error and overlap flag (NULL without truth)."""
    both = samples.join(set_overlap(truth, prediction, ids), list(ids), "left")
    known = F.coalesce(F.col("truth_len"), F.lit(0)) > 0
    c = F.col
    return both.select(
        *samples.columns,
        F.when(known, set_iou(c("inter_len"), c("truth_len"), c("pred_len"))).alias("iou"),
        F.when(known, boundary_error(c("truth_start"), c("truth_end"), c("pred_start"), c("pred_end"))).alias("boundary_error"),
        F.when(known, as_int(c("inter_len") > 0)).alias("hit"),
    )


def localization_report(
    samples: DataFrame, truth: DataFrame, prediction: DataFrame, ids: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Mean IoU, boundary error and hit rate over samples that have a truth."""
    zero = F.lit(0.0)
    return localization_samples(samples, truth, prediction, ids).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("support"),
        F.count("iou").alias("evaluated"),
        r6(F.coalesce(F.avg("iou"), zero)).alias("mean_iou"),
        r6(F.coalesce(F.avg("boundary_error"), zero)).alias("mean_boundary_error"),
        r6(F.coalesce(F.avg(F.col("hit").cast("double")), zero)).alias("offset_hit_rate"),
    )


def operating_points(df: DataFrame, score: Column, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    """FPR at 95 % TPR (NULL if unreachable), TPR at 1 % and 5 % FPR (0 if unreachable)."""
    k = list(keys) or [ALL]
    curve = score_curve(df, score, truth, keys)
    tpr, fpr = ratio(F.col("tp"), F.col("positives")), ratio(F.col("fp"), F.col("negatives"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    agg = curve.where(both).groupBy(*k).agg(
        F.min(F.when(tpr >= 0.95, fpr)).alias("_f95"),
        F.max(F.when(fpr <= 0.01, tpr)).alias("_t1"),
        F.max(F.when(fpr <= 0.05, tpr)).alias("_t5"),
    )
    zero = F.lit(0.0)
    return _unkeyed(
        agg.select(
            *k,
            r6(F.col("_f95")).alias("fpr_at_95_tpr"),
            r6(F.coalesce("_t1", zero)).alias("tpr_at_1_fpr"),
            r6(F.coalesce("_t5", zero)).alias("tpr_at_5_fpr"),
        )
    )


def threshold_points(curve: DataFrame) -> DataFrame:
    """Unrounded precision, recall, F1 and FPR when every score >= threshold is predicted positive."""
    tp, fp, pos = F.col("tp"), F.col("fp"), F.col("positives")
    points = curve.withColumns(
        {"p": ratio(tp, tp + fp), "r": ratio(tp, pos), "fpr": ratio(fp, F.col("negatives")), "threshold": F.col("score")}
    )
    return points.withColumn("f", F.when(F.col("p") + F.col("r") > 0, F.col("p") * 2.0 * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))


def best_f1_threshold(df: DataFrame, score: Column, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Threshold of the best unrounded F1; the highest threshold wins ties."""
    k = list(keys) or [ALL]
    points = threshold_points(score_curve(df, score, truth, keys))
    best = points.groupBy(*k).agg(F.max(F.struct("f", "threshold", "p", "r", "fpr")).alias("b"))
    return _unkeyed(
        best.select(
            *k,
            F.col("b.threshold").alias("threshold"),
            r6(F.col("b.f")).alias("f1"),
            r6(F.col("b.p")).alias("precision"),
            r6(F.col("b.r")).alias("recall"),
            r6(F.col("b.fpr")).alias("fpr"),
        )
    )


def best_rounded_threshold(df: DataFrame, score: Column, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Best by (F1, precision, threshold) after rounding the metrics to 6 decimals."""
    k = list(keys) or [ALL]
    tp, fp, pos, neg = (F.col(x) for x in ("tp", "fp", "positives", "negatives"))
    points = score_curve(df, score, truth, keys).withColumns(confusion_columns(tp, fp, pos - tp, neg - fp))
    best = points.groupBy(*k).agg(
        F.max(F.struct("f1", "precision", r6(F.col("score")).alias("threshold"), "recall", "accuracy")).alias("b")
    )
    return _unkeyed(best.select(*k, *[f"b.{c}" for c in ("threshold", "precision", "recall", "f1", "accuracy")]))


def threshold_report(df: DataFrame, score: Column, truth: Column, default: float, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics at the default threshold next to the best one (``mode`` = default / best)."""
    base = confusion_report(df, truth, as_int(score >= default), keys).select(
        *keys, F.lit("default").alias("mode"), F.lit(float(default)).alias("threshold"), "precision", "recall", "f1", "accuracy"
    )
    best = best_rounded_threshold(df, score, truth, keys).select(
        *keys, F.lit("best").alias("mode"), "threshold", "precision", "recall", "f1", "accuracy"
    )
    return base.unionByName(best)


def target_tpr_threshold(df: DataFrame, score: Column, truth: Column, target: float, keys: Sequence[str] = ()) -> DataFrame:
    """Among thresholds reaching the target TPR: lowest FPR, then highest threshold."""
    k = list(keys) or [ALL]
    points = threshold_points(score_curve(df, score, truth, keys)).where(F.col("r") >= target)
    best = points.groupBy(*k).agg(F.min(F.struct("fpr", (-F.col("threshold")).alias("_t"), "p", "r", "f")).alias("b"))
    return _unkeyed(
        best.select(
            *k,
            (-F.col("b._t")).alias("threshold"),
            r6(F.col("b.fpr")).alias("fpr"),
            r6(F.col("b.r")).alias("tpr"),
            r6(F.col("b.p")).alias("precision"),
            r6(F.col("b.f")).alias("f1"),
        )
    )


def brier_score(df: DataFrame, score: Column, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    gap = score - truth.cast("double")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("support"), r6(F.avg(gap * gap)).alias("brier"))


def calibration_bins(df: DataFrame, score: Column, truth: Column, bins: int = 10) -> DataFrame:
    """Equal-width bins over [0, 1], the last one closed; empty bins are listed, outside scores are in none."""
    edges = [F.lit(i / bins) for i in range(bins + 1)]
    slot = F.lit(None).cast("int")
    for i in reversed(range(bins)):
        top = score <= edges[i + 1] if i == bins - 1 else score < edges[i + 1]
        slot = F.when((score >= edges[i]) & top, i).otherwise(slot)
    filled = df.select(slot.alias("bin"), score.alias("_s"), truth.cast("double").alias("_y")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg("_s").alias("_conf"), F.avg("_y").alias("_acc")
    )
    spark = df.sparkSession
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(filled, "bin", "left").select(
        "bin",
        F.coalesce("count", F.lit(0)).alias("count"),
        r6(F.coalesce("_conf", F.lit(0.0))).alias("confidence"),
        r6(F.coalesce("_acc", F.lit(0.0))).alias("accuracy"),
        F.coalesce(F.abs(F.col("_acc") - F.col("_conf")), F.lit(0.0)).alias("gap"),
    )


def expected_calibration_error(df: DataFrame, score: Column, truth: Column, bins: int = 10) -> DataFrame:
    """Bin gaps weighted by the share of all rows."""
    table = calibration_bins(df, score, truth, bins)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return table.agg(
        r6(F.coalesce(F.sum(F.col("gap") * F.col("count") / total), F.lit(0.0))).alias("ece"),
        F.sum("count").alias("binned"),
    )


def top_k_report(df: DataFrame, group: Sequence[str], order: Sequence[Column], truth: Column, k: int) -> DataFrame:
    """The k best items of each group count as predicted positive."""
    from pyspark.sql import Window

    spec = Window.partitionBy(*group).orderBy(*order)
    slim = df.select(*group, truth.alias("_y"), F.row_number().over(spec).alias("_rank")).where(F.col("_rank") <= k)
    picked = slim.agg(
        F.count(F.lit(1)).alias("picked"), F.coalesce(F.sum(as_int(F.col("_y") == 1)), F.lit(0)).alias("tp")
    )
    whole = df.agg(F.count(F.lit(1)).alias("support"), F.sum(as_int(truth == 1)).alias("positives"))
    tp = picked.select("tp").scalar()
    n = picked.select("picked").scalar()
    sized = whole.select("support", "positives", n.alias("predicted_positives"), tp.alias("true_positives"))
    sized = sized.withColumns(
        {
            "false_positives": F.col("predicted_positives") - F.col("true_positives"),
            "false_negatives": F.col("positives") - F.col("true_positives"),
        }
    ).withColumn("true_negatives", F.col("support") - F.col("positives") - F.col("false_positives"))
    c = [F.col(x) for x in ("true_positives", "false_positives", "false_negatives", "true_negatives")]
    return sized.withColumns(confusion_columns(*c))
