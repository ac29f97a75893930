"""Evaluation queries on line items: truth, two scores, orders as groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import as_int, r6
from ..operators import evaluation as E
from ..operators import metrics as M
from ..operators.ordering import prefix_sums
from .base import query



def S():
    return F.col("score")


def Y():
    return F.col("truth")


CUT = 0.45

CONF = """sum(truth)::BIGINT AS positives, sum(p)::BIGINT AS predicted_positives, sum(truth * p)::BIGINT AS true_positives,
  sum((1 - truth) * p)::BIGINT AS false_positives, sum(truth * (1 - p))::BIGINT AS false_negatives,
  sum((1 - truth) * (1 - p))::BIGINT AS true_negatives"""
RATES = """round_even(coalesce(true_positives / nullif(true_positives + false_positives, 0), 0), 6) AS "precision",
  round_even(coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0), 6) AS recall,
  round_even(coalesce(2 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0), 0), 6) AS f1,
  round_even(coalesce((true_positives + true_negatives) / nullif(true_positives + true_negatives + false_positives + false_negatives, 0), 0), 6) AS accuracy"""
PRED = f"(SELECT *, CASE WHEN score >= {CUT} THEN 1 ELSE 0 END AS p FROM scored)"
AUROC = "round_even(CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos * (n - fp + neg / 2)) / (max(p) * max(n)) END, 6)"
AUPRC = "round_even(CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos * tp / (tp + fp)) / max(p) END, 6)"


@query(
    "e1_confusion_report",
    f"SELECT *, {RATES} FROM (SELECT family, count(*) AS support, {CONF} FROM {PRED} GROUP BY family)",
    ("scored",),
)
def e1(t):
    return M.confusion_report(t.scored, Y(), as_int(S() >= CUT), ["family"])


@query(
    "e2_threshold_labels",
    f"SELECT fold, p AS predicted_label_id, count(*) AS n, sum(truth)::BIGINT AS positives FROM {PRED} GROUP BY ALL",
    ("scored",),
)
def e2(t):
    return M.hard_labels(t.scored, S(), CUT).groupBy("fold", "predicted_label_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("truth").alias("positives")
    )


@query(
    "e3_auroc",
    f"SELECT max(p)::BIGINT AS positives, max(n)::BIGINT AS negatives, {AUROC} AS auroc FROM curve",
    ("curve",),
)
def e3(t):
    return M.ranking_quality(t.scored, S(), Y()).drop("auprc")


@query(
    "e4_average_precision",
    f"SELECT family, {AUROC} AS auroc, {AUPRC} AS auprc FROM famcurve GROUP BY family",
    ("famcurve",),
)
def e4(t):
    return M.ranking_quality(t.scored, S(), Y(), ["family"]).select("family", "auroc", "auprc")


@query(
    "e5_ranking_report",
    """WITH r AS (SELECT l_orderkey, truth, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, truth DESC) AS r FROM scored),
 f AS (SELECT l_orderkey, min(CASE WHEN truth = 1 THEN r END) AS f FROM r GROUP BY l_orderkey)
SELECT count(*) AS group_count, count(f) AS evaluated_group_count, round_even(avg(1 / f), 6) AS mrr,
  round_even(avg((f <= 1)::INT), 6) AS top_1_hit, round_even(avg((f <= 3)::INT), 6) AS top_3_hit,
  round_even(avg((f <= 5)::INT), 6) AS top_5_hit FROM f""",
    ("scored",),
)
def e5(t):
    return M.ranking_report(t.scored, ["l_orderkey"], S(), Y())


@query(
    "e9_entry_localization",
    """WITH q AS (SELECT *, max(score_b) OVER (PARTITION BY l_orderkey) AS m,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, suppkey) AS r FROM scored),
 k AS (SELECT *, CASE WHEN score_b > 0.5 THEN 1 ELSE 0 END AS y FROM q WHERE m > 0.3),
 h AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM k GROUP BY score),
 c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM h
       WINDOW w AS (ORDER BY score DESC)),
 b AS (SELECT l_orderkey, coalesce(max(CASE WHEN y = 1 THEN 1 / r END), 0) AS rr FROM k GROUP BY l_orderkey)
SELECT (SELECT count(*) FROM b) AS bags, (SELECT round_even(avg(rr), 6) FROM b) AS mrr,
  (SELECT round_even(sum(pos * (n - fp + neg / 2)) / (max(p) * max(n)), 6) FROM c) AS auroc, (SELECT count(*) FROM k) AS items""",
    ("scored",),
)
def e9(t):
    tie = F.col("l_linenumber") * 10000000 + F.col("suppkey")
    return E.entry_localization(t.scored, ["l_orderkey"], "score_b", S(), tie_break=tie)


@query(
    "e10_operating_points",
    """SELECT family, round_even(min(CASE WHEN tp / p >= 0.95 THEN fp / n END), 6) AS fpr_at_95_tpr,
  round_even(coalesce(max(CASE WHEN fp / n <= 0.01 THEN tp / p END), 0), 6) AS tpr_at_1_fpr,
  round_even(coalesce(max(CASE WHEN fp / n <= 0.05 THEN tp / p END), 0), 6) AS tpr_at_5_fpr FROM famcurve GROUP BY family""",
    ("famcurve",),
)
def e10(t):
    return M.operating_points(t.scored, S(), Y(), ["family"])


POINTS = """SELECT family, score AS threshold, tp / (tp + fp) AS p, tp / p AS r, fp / n AS fpr,
  CASE WHEN tp > 0 THEN (tp / (tp + fp)) * 2.0e0 * (tp / p) / ((tp / (tp + fp)) + (tp / p)) ELSE 0 END AS f FROM famcurve"""


@query(
    "e11_best_f1_threshold",
    f"""WITH pts AS ({POINTS}), rk AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY f DESC, threshold DESC) AS k FROM pts)
SELECT family, threshold, round_even(f, 6) AS f1, round_even(p, 6) AS "precision", round_even(r, 6) AS recall,
  round_even(fpr, 6) AS fpr FROM rk WHERE k = 1""",
    ("famcurve",),
)
def e11(t):
    return M.best_f1_threshold(t.scored, S(), Y(), ["family"])


E12_POINTS = """pts AS (SELECT fold, score, sum(pos) OVER w AS true_positives, sum(neg) OVER w AS false_positives,
    sum(pos) OVER (PARTITION BY fold) - sum(pos) OVER w AS false_negatives,
    sum(neg) OVER (PARTITION BY fold) - sum(neg) OVER w AS true_negatives
  FROM (SELECT fold, score, sum(truth) AS pos, sum(1 - truth) AS neg FROM scored GROUP BY ALL)
  WINDOW w AS (PARTITION BY fold ORDER BY score DESC))"""


@query(
    "e12_threshold_report",
    f"""WITH {E12_POINTS},
 m AS (SELECT fold, round_even(score, 6) AS threshold, {RATES} FROM pts),
 best AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, "precision" DESC, threshold DESC) AS k FROM m),
 d AS (SELECT fold, {CONF} FROM {PRED} GROUP BY fold)
SELECT fold, 'default' AS mode, {CUT}::DOUBLE AS threshold, {RATES} FROM d
UNION ALL SELECT fold, 'best', threshold, "precision", recall, f1, accuracy FROM best WHERE k = 1""",
    ("scored",),
)
def e12(t):
    return M.threshold_report(t.scored, S(), Y(), CUT, ["fold"])


@query(
    "e13_target_tpr_threshold",
    f"""WITH pts AS ({POINTS}), rk AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY fpr, threshold DESC) AS k FROM pts WHERE r >= 0.95)
SELECT family, threshold, round_even(fpr, 6) AS fpr, round_even(r, 6) AS tpr, round_even(p, 6) AS "precision",
  round_even(f, 6) AS f1 FROM rk WHERE k = 1""",
    ("famcurve",),
)
def e13(t):
    return M.target_tpr_threshold(t.scored, S(), Y(), 0.95, ["family"])


@query(
    "e14_top_k_report",
    f"""WITH r AS (SELECT truth, CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, suppkey, truth) <= 1
       THEN 1 ELSE 0 END AS p FROM scored),
 c AS (SELECT count(*) AS support, {CONF} FROM r)
SELECT support, positives, predicted_positives, true_positives, false_positives, false_negatives, true_negatives, {RATES} FROM c""",
    ("scored",),
)
def e14(t):
    return M.top_k_report(
        t.scored, ["l_orderkey"], [S().desc(), F.col("l_linenumber"), F.col("suppkey"), Y()], Y(), 1
    )


@query(
    "e15_brier_score",
    "SELECT family, count(*) AS support, round_even(avg((score - truth) * (score - truth)), 6) AS brier FROM scored GROUP BY family",
    ("scored",),
)
def e15(t):
    return M.brier_score(t.scored, S(), Y(), ["family"])


ECE = """bins AS (SELECT b, b / 10 AS lo, (b + 1) / 10 AS hi FROM (SELECT unnest(range(10)) AS b)),
 tab AS (SELECT b, count(s.score) AS n, coalesce(avg(s.score), 0) AS c, coalesce(avg(s.truth), 0) AS a
         FROM bins LEFT JOIN scored s ON s.score >= lo AND (s.score < hi OR (b = 9 AND s.score <= hi)) GROUP BY b)"""


@query(
    "e16_calibration_bins",
    f"""WITH {ECE} SELECT b::INTEGER AS bin, n AS "count", round_even(c, 6) AS confidence, round_even(a, 6) AS accuracy,
  round_even(abs(a - c), 6) AS gap FROM tab""",
    ("scored",),
)
def e16_bins(t):
    return M.calibration_bins(t.scored, S(), Y()).withColumn("gap", r6(F.col("gap")))


@query(
    "e16_expected_calibration_error",
    f"""WITH {ECE} SELECT round_even(sum(abs(a - c) * n / (SELECT count(*) FROM scored)), 6) AS ece, sum(n)::BIGINT AS binned FROM tab""",
    ("scored",),
)
def e16(t):
    return M.expected_calibration_error(t.scored, S(), Y())


@query(
    "e17_reference_normalization",
    """WITH r AS (SELECT avg(score) AS mu, stddev_pop(score) AS sd FROM scored WHERE truth = 0 AND fold <> 0),
 z AS (SELECT fold, (score - mu) / CASE WHEN sd > 1e-6 THEN sd ELSE 1 END AS z, score - mu AS c FROM scored, r)
SELECT fold, count(*) AS n, round_even(avg(z), 6) AS z_mean, round_even(max(z), 6) AS z_max, round_even(min(z), 6) AS z_min FROM z GROUP BY fold""",
    ("scored",),
)
def e17(t):
    z = E.normalize_by_reference(t.scored, "score", (Y() == 0) & (F.col("fold") != 0), "z")
    n = F.col("normalized")
    return z.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(n)).alias("z_mean"), r6(F.max(n)).alias("z_max"), r6(F.min(n)).alias("z_min")
    )


FOLDS = f"""c AS (SELECT fold, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY fold) AS p,
    sum(neg) OVER (PARTITION BY fold) AS n FROM (SELECT fold, score, sum(truth) AS pos, sum(1 - truth) AS neg FROM scored GROUP BY ALL)
  WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
 q AS (SELECT fold, {AUROC} AS auroc, {AUPRC} AS auprc FROM c GROUP BY fold),
 m AS (SELECT fold, sum(truth)::BIGINT AS n_positive, sum(1 - truth)::BIGINT AS n_negative,
   round_even(sum(CASE WHEN truth = 1 AND score > 0.5 THEN 1 ELSE 0 END) / greatest(sum(truth), 1), 6) AS detection_rate,
   round_even(avg(CASE WHEN truth = 1 THEN score END), 6) AS positive_mean,
   round_even(avg(CASE WHEN truth = 0 THEN score END), 6) AS negative_mean FROM scored GROUP BY fold),
 f AS (SELECT * FROM m JOIN q USING (fold))"""


@query("e18_fold_results", f"WITH {FOLDS} SELECT * FROM f", ("scored",))
def e18(t):
    return E.fold_results(t.scored, "fold", S(), Y())


@query(
    "e18_fold_summary",
    f"""WITH {FOLDS} SELECT count(*) AS n_folds, round_even(avg(auroc), 6) AS mean_auroc,
  round_even(avg(detection_rate), 6) AS mean_detection_rate FROM f""",
    ("scored",),
)
def e18_summary(t):
    return E.fold_summary(E.fold_results(t.scored, "fold", S(), Y()))


BOOT_B = 200


def boot_sql(extra: str) -> str:
    return f"""WITH rng AS (SELECT score, {extra}truth, row_number() OVER (ORDER BY score, {extra}truth) - 1 AS d FROM scored),
 tot AS (SELECT count(*) AS n FROM scored),
 draw AS (SELECT b, ('0x' || substr(md5(concat('7|', b, '|', i)), 1, 13))::BIGINT % (SELECT n FROM tot) AS d
   FROM (SELECT unnest(range(1, {BOOT_B} + 1)) AS b), (SELECT unnest(range((SELECT n FROM tot))) AS i)),
 hit AS (SELECT b, d, count(*) AS m FROM draw GROUP BY ALL),
 smp AS (SELECT b, score, {extra}truth, sum(m) AS w FROM hit JOIN rng USING (d) GROUP BY ALL)"""


def boot_auc(name: str, col: str) -> str:
    return f"""{name}h AS (SELECT b, {col} AS s, sum(CASE WHEN truth = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN truth = 1 THEN 0 ELSE w END) AS q FROM smp GROUP BY ALL),
 {name}c AS (SELECT *, sum(q) OVER (PARTITION BY b ORDER BY s) - q AS below FROM {name}h),
 {name} AS (SELECT b, sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS v FROM {name}c GROUP BY b HAVING sum(p) > 0 AND sum(q) > 0)"""


CI = """count(v) AS n, round_even(avg(v), 6) AS mean, round_even(stddev_pop(v), 6) AS std, round_even(quantile_cont(v, 0.025), 6) AS p2_5,
  round_even(quantile_cont(v, 0.5), 6) AS p50, round_even(quantile_cont(v, 0.975), 6) AS p97_5"""


@query("e19_bootstrap_ci", boot_sql("") + f", {boot_auc('a', 'score')} SELECT {CI} FROM a", ("scored",))
def e19(t):
    return E.bootstrap_ci(t.scored, "score", "truth", BOOT_B)


@query(
    "e20_paired_bootstrap",
    boot_sql("score_b, ")
    + f""", {boot_auc('a', 'score')}, {boot_auc('c', 'score_b')}, d AS (SELECT c.v - a.v AS v FROM a JOIN c USING (b))
SELECT {CI}, round_even(least(1, 2 * least(avg((v <= 0)::INT), avg((v >= 0)::INT))), 6) AS p_two_sided FROM d""",
    ("scored",),
)
def e20(t):
    return E.paired_bootstrap(t.scored, "score", "score_b", "truth", BOOT_B)


@query(
    "e21_metric_expectations",
    f"""WITH {FOLDS}, mm AS (SELECT unnest(['mean_auroc', 'mean_detection_rate']) AS metric,
   unnest([round_even(avg(auroc), 6), round_even(avg(detection_rate), 6)]) AS value FROM f),
 x AS (SELECT * FROM (VALUES ('mean_auroc', 0.5::DOUBLE, 0.05::DOUBLE), ('mean_detection_rate', 0.9::DOUBLE, 0.0005::DOUBLE), ('mean_brier', 0.25::DOUBLE, 0.001::DOUBLE)) v(metric, expected, tolerance))
SELECT metric, expected, tolerance, value, coalesce(abs(value - expected) <= tolerance, false) AS ok FROM x LEFT JOIN mm USING (metric)""",
    ("scored",),
)
def e21(t):
    summary = E.fold_summary(E.fold_results(t.scored, "fold", S(), Y()))
    names = ["mean_auroc", "mean_detection_rate"]
    tidy = summary.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))
    return E.check_expectations(
        tidy, {"mean_auroc": (0.5, 0.05), "mean_detection_rate": (0.9, 0.0005), "mean_brier": (0.25, 0.001)}
    )


SWEEP = [i / 20 + 0.0025 for i in range(4, 17)]


@query(
    "e22_threshold_sweep",
    f"""WITH c AS (SELECT family, t AS threshold, count(*) AS support, sum(CASE WHEN score >= t THEN truth ELSE 0 END)::BIGINT AS true_positives,
   sum(CASE WHEN score >= t THEN 1 - truth ELSE 0 END)::BIGINT AS false_positives, sum(CASE WHEN score >= t THEN 0 ELSE truth END)::BIGINT AS false_negatives,
   sum(CASE WHEN score >= t THEN 0 ELSE 1 - truth END)::BIGINT AS true_negatives
  FROM scored, (SELECT unnest([{", ".join(repr(x) + "::DOUBLE" for x in SWEEP)}]) AS t) GROUP BY ALL)
SELECT *, {RATES} FROM c""",
    ("scored",),
)
def e22(t):
    return E.sweep_thresholds(t.scored, SWEEP, S(), Y(), ["family"])


@query(
    "e23_threshold_transfer",
    f"""WITH cal AS (SELECT * FROM scored WHERE suppkey % 3 = 0 AND fold < 4), tst AS (SELECT * FROM scored WHERE suppkey % 3 <> 0),
 {E12_POINTS.replace("FROM scored", "FROM cal")},
 m AS (SELECT fold, round_even(score, 6) AS threshold, {RATES} FROM pts),
 best AS (SELECT fold, threshold FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, "precision" DESC, threshold DESC) AS k FROM m) WHERE k = 1),
 d AS (SELECT t.fold, coalesce(b.threshold, {CUT}) AS threshold, truth, CASE WHEN score >= coalesce(b.threshold, {CUT}) THEN 1 ELSE 0 END AS p
       FROM tst t LEFT JOIN best b USING (fold)),
 c AS (SELECT fold, threshold::DOUBLE AS threshold, count(*) AS support, {CONF} FROM d GROUP BY ALL)
SELECT *, {RATES} FROM c""",
    ("scored",),
)
def e23(t):
    cal = t.scored.where("suppkey % 3 = 0 AND fold < 4")
    test = t.scored.where("suppkey % 3 <> 0")
    decided = E.transfer_threshold(cal, test, "fold", S(), Y(), CUT)
    return M.confusion_report(decided, Y(), F.col("predicted_label_id"), ["fold", "threshold"])


@query(
    "e24_scoring_direction",
    """WITH b AS (SELECT family, l_orderkey, avg(CASE WHEN truth = 1 THEN score END) AS p, avg(CASE WHEN truth = 0 THEN score END) AS n
  FROM scored WHERE fold <> 0 GROUP BY ALL HAVING p IS NOT NULL AND n IS NOT NULL)
SELECT family, count(*) AS bags, round_even(avg(p), 6) AS positive_mean, round_even(avg(n), 6) AS negative_mean,
  CASE WHEN avg(p) < avg(n) THEN 'inverse' ELSE 'direct' END AS direction FROM b GROUP BY family""",
    ("scored",),
)
def e24(t):
    train = t.scored.where("fold <> 0")
    return E.scoring_direction(train, ["l_orderkey"], F.lit(1), Y(), S(), ["family"])


@query(
    "f5_average_ranks",
    """SELECT l_orderkey, l_linenumber, suppkey, score, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2)::DOUBLE AS avg_rank
FROM scored""",
    ("scored",),
)
def f5(t):
    items = t.scored.select("l_orderkey", "l_linenumber", "suppkey", "score")
    counts = items.groupBy("score").agg(F.count(F.lit(1)).alias("_n")).withColumn("_g", F.lit(0))
    below = prefix_sums(counts, ["_g"], [S()], {"_below": (F.col("_n"), False)})
    ranks = below.select("score", (F.col("_below") + (F.col("_n") + 1) / 2.0).alias("avg_rank"))
    return items.join(ranks, "score")


REPORTS = f"""tasks AS (SELECT method, family, fold, truth, s AS score FROM (SELECT 'a' AS method, family, fold, truth, score AS s FROM scored
   UNION ALL SELECT 'b', family, fold, truth, score_b FROM scored)),
 h AS (SELECT method, family, fold, score, sum(truth) AS pos, sum(1 - truth) AS neg FROM tasks GROUP BY ALL),
 c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY method, family, fold) AS p,
   sum(neg) OVER (PARTITION BY method, family, fold) AS n FROM h WINDOW w AS (PARTITION BY method, family, fold ORDER BY score DESC)),
 q AS (SELECT method, family, fold, {AUROC} AS auroc, {AUPRC} AS auprc FROM c GROUP BY ALL),
 k AS (SELECT method, family, fold, count(*) AS support, {CONF} FROM (SELECT *, CASE WHEN score >= {CUT} THEN 1 ELSE 0 END AS p FROM tasks) GROUP BY ALL),
 reports AS (SELECT * FROM k JOIN q USING (method, family, fold))"""
AGGR = """count(*) AS contributing_task_count, sum(support)::BIGINT AS support, sum(positives)::BIGINT AS positives,
   sum(predicted_positives)::BIGINT AS predicted_positives, sum(true_positives)::BIGINT AS true_positives,
   sum(false_positives)::BIGINT AS false_positives, sum(false_negatives)::BIGINT AS false_negatives, sum(true_negatives)::BIGINT AS true_negatives,
   round_even(avg(auroc), 6) AS auroc, round_even(avg(auprc), 6) AS auprc, count(auroc) AS auroc_task_count"""


def reports(t):
    both = t.scored.select(
        "family", "fold", "truth",
        F.inline(F.array(F.struct(F.lit("a").alias("method"), S().alias("score")), F.struct(F.lit("b").alias("method"), F.col("score_b").alias("score")))),
    )
    return E.task_reports(both, ["method", "family", "fold"], S(), Y(), CUT)


@query(
    "a20_report_aggregation",
    f"""WITH {REPORTS},
 g AS (SELECT method, family, 'family' AS scope, {AGGR} FROM reports GROUP BY ALL
       UNION ALL SELECT method, '*', 'overall', {AGGR} FROM reports GROUP BY ALL)
SELECT *, {RATES} FROM g""",
    ("scored",),
)
def a20(t):
    return E.with_overall(reports(t), "family", "method")


FAMS = [f"fam{i}" for i in range(7)] + ["fam9"]


@query(
    "a21_method_family_pivot",
    f"""WITH {REPORTS} SELECT method, {", ".join(f"coalesce(printf('%.4f', round_even(avg(CASE WHEN family = '{f}' THEN auroc END), 6)), '-') AS {f}" for f in FAMS)}
FROM reports GROUP BY method""",
    ("scored",),
)
def a21(t):
    return E.pivot_table(reports(t), "method", "family", FAMS, "auroc")


@query(
    "a22_score_summary",
    """SELECT fold, count(score) AS "count", round_even(avg(score), 6) AS mean, round_even(stddev_pop(score), 6) AS std, min(score) AS "min",
  round_even(quantile_cont(score, 0.25), 6) AS p25, round_even(quantile_cont(score, 0.5), 6) AS p50, round_even(quantile_cont(score, 0.75), 6) AS p75,
  round_even(quantile_cont(score, 0.9), 6) AS p90, max(score) AS "max" FROM scored GROUP BY fold""",
    ("scored",),
)
def a22(t):
    return E.score_summary(t.scored, "score", ["fold"])


A24_H = """SELECT family, m, v, sum(truth) AS pos, sum(1 - truth) AS neg FROM x GROUP BY ALL"""


@query(
    "a24_score_comparison",
    f"""WITH x0 AS (SELECT family, l_orderkey, truth, 'a' AS m, score AS v FROM scored UNION ALL SELECT family, l_orderkey, truth, 'b', score_b FROM scored),
 x AS (SELECT * FROM x0 UNION ALL SELECT '*', l_orderkey, truth, m, v FROM x0),
 h AS ({A24_H}),
 c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY family, m) AS p,
   sum(neg) OVER (PARTITION BY family, m) AS n FROM h WINDOW w AS (PARTITION BY family, m ORDER BY v DESC)),
 q AS (SELECT family, m, {AUROC} AS auroc FROM c GROUP BY ALL),
 r AS (SELECT family, m, l_orderkey, truth, row_number() OVER (PARTITION BY family, m, l_orderkey ORDER BY v DESC, truth DESC) AS r FROM x),
 f AS (SELECT family, m, l_orderkey, min(CASE WHEN truth = 1 THEN r END) AS f FROM r GROUP BY ALL),
 mm AS (SELECT family, m, round_even(coalesce(avg(1 / f), 0), 6) AS mrr FROM f GROUP BY ALL),
 w AS (SELECT family, max(CASE WHEN m = 'a' THEN auroc END) AS auroc_a, max(CASE WHEN m = 'a' THEN mrr END) AS mrr_a,
   max(CASE WHEN m = 'b' THEN auroc END) AS auroc_b, max(CASE WHEN m = 'b' THEN mrr END) AS mrr_b FROM q JOIN mm USING (family, m) GROUP BY family)
SELECT *, CASE WHEN auroc_a - auroc_b > 0.01 THEN 'a' WHEN auroc_a - auroc_b < -0.01 THEN 'b' ELSE 'tie' END AS auroc_winner,
  CASE WHEN mrr_a - mrr_b > 0.01 THEN 'a' WHEN mrr_a - mrr_b < -0.01 THEN 'b' ELSE 'tie' END AS mrr_winner FROM w""",
    ("scored",),
)
def a24(t):
    return E.compare_scores(t.scored, "family", ["l_orderkey"], Y(), {"a": S(), "b": F.col("score_b")})
