"""Record validation, reconciliation of label sources, leakage guards and fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import r6
from . import intervals as I

# Decision names, payload kinds and label sources.
PAYLOAD_KINDS = ["encrypted_dex", "extracted_method_body", "compressed_payload", "embedded_asset", "native_stub"]
LOADER_KINDS = ["shim", "loader_dex"]
LABEL_SOURCES = ["source_injected", "rule_based", "diff_based"]


def violations(df: DataFrame, ids: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(ids, message) for every failed rule; a rule is a condition that means *bad* (NULL counts as bad)."""
    found = F.filter(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), msg) for msg, bad in rules.items()]), lambda m: m.isNotNull()
    )
    return df.select(*ids, F.explode(found).alias("message"))


def label_record_rules(required: Sequence[str]) -> dict[str, Column]:
    """Rules for injected label entries."""
    c = F.col
    rules = {f"missing {f}": c(f).isNull() for f in required}
    return rules | {
        "unknown payload_kind": ~c("payload_kind").isin(*PAYLOAD_KINDS, *LOADER_KINDS),
        "offset_end before offset_start": c("offset_end") < c("offset_start"),
        "transform_family without packer_ prefix": ~c("transform_family").startswith("packer_"),
        "unknown label_source": ~c("label_source").isin(*LABEL_SOURCES),
    }


def verdict(iou: Column, solid: float = 0.9, review: float = 0.5) -> Column:
    if solid <= review:
        raise ValueError("solid must exceed review")
    return F.when(iou >= solid, "solid").when(iou >= review, "partial_mismatch").otherwise("low_confidence")


def label_agreement(a: DataFrame, b: DataFrame, pair: str, path: str, bucket_width: int = 65536) -> DataFrame:
    """Micro IoU per pair over all objects of two label sets (columns start, end)."""
    both = I.set_overlap(a, b, [pair, path], bucket_width)
    return both.groupBy(pair).agg(
        r6(I.set_iou(F.sum("inter_len"), F.sum("truth_len"), F.sum("pred_len"), empty=1.0)).alias("iou"),
        F.count(F.lit(1)).alias("objects"),
    )


def reconcile(pairs: DataFrame, solid: float = 0.9, review: float = 0.5) -> DataFrame:
    """Seven-way decision between diff and rule labels.

    pairs: alignment_failed, degenerate, n_rule, n_diff, iou.
    """
    c = F.col
    decision = (
        F.when(c("alignment_failed"), "rule_only_alignment_failed")
        .when(c("degenerate"), "rule_only_degenerate")
        .when((c("n_rule") == 0) & (c("n_diff") == 0), "no_signal")
        .when(c("n_rule") == 0, "path_b_only_no_rule_match")
        .when(c("iou") >= solid, "solid")
        .when(c("iou") >= review, "partial_mismatch")
        .otherwise("low_confidence")
    )
    source = (
        F.when(decision.startswith("rule_only"), "rules")
        .when(decision.isin("path_b_only_no_rule_match", "solid", "partial_mismatch"), "diff")
        .otherwise("none")
    )
    return pairs.withColumns(
        {"decision": decision, "label_source": source, "needs_manual_review": decision != "solid"}
    )


def reconciled_labels(decisions: DataFrame, diff: DataFrame, rules: DataFrame, pair: str) -> DataFrame:
    """Labels of the chosen source of each pair."""
    pick = decisions.select(pair, "label_source")
    both = diff.withColumn("label_source", F.lit("diff")).unionByName(rules.withColumn("label_source", F.lit("rules")))
    return both.join(pick, [pair, "label_source"], "left_semi")


def cross_check(df: DataFrame) -> DataFrame:
    """Expected family against detector output: six agreement values.

    df: expected, scan_failed, has_hit, families ARRAY.
    """
    exp = F.nullif(F.trim("expected"), F.lit(""))
    hit = F.col("has_hit")
    value = (
        F.when(F.col("scan_failed") & ~hit, "scan_failed")
        .when(exp.isNull() & ~hit, "no_expectation")
        .when(exp.isNull(), "false_positive")
        .when(~hit, "no_detection")
        .when(F.array_contains("families", exp), "solid")
        .otherwise("mismatch")
    )
    return df.withColumns({"agreement": value, "needs_manual_review": ~value.isin("solid", "no_expectation")})


def leaked_keys(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys present on both sides; must be empty."""
    return test.select(key).distinct().join(train.select(key), key, "left_semi")


def without_dirty_prefix(df: DataFrame, key: str, dirty: Sequence[str]) -> DataFrame:
    """Drop rows whose key is a prefix of, or starts with, a dirty name (case-insensitive)."""
    k = F.upper(key)
    bad = F.lit(False)
    for d in dirty:
        bad = bad | F.lit(d.upper()).startswith(k) | k.startswith(d.upper())
    return df.where(~bad)


def choose_label_source(pairs: DataFrame) -> DataFrame:
    """Label source per pair by packer group, with review flag and reasons.

    pairs: grp, n_injected, n_diff, has_rules, degenerate, alignment_failed, cs_decision.
    """
    c = F.col
    by_rules = (
        F.when(c("cs_decision").startswith("rule_only"), "rules")
        .when(c("cs_decision").isin("solid", "partial_mismatch", "path_b_only_no_rule_match"), "diff").otherwise("none")
    )
    commercial = F.when(c("has_rules"), by_rules).when(c("n_diff") > 0, "diff").otherwise("none")
    opened = F.when(c("n_injected") > 0, "injected").when(c("n_diff") > 0, "diff").otherwise("none")
    is_cs = c("grp") == "commercial"
    source = F.when(is_cs, commercial).otherwise(opened)
    broken = c("degenerate") | c("alignment_failed")
    review = F.when(is_cs, F.when(c("has_rules"), c("cs_decision") != "solid").otherwise(c("n_diff") > 0)).otherwise(
        (source == "none") & broken
    )
    reasons = F.filter(
        F.array(
            F.when(is_cs & ~c("has_rules"), "commercial packer without rule file"),
            F.when(~is_cs & (source == "diff"), "injected labels missing"),
            F.when(c("degenerate"), "degenerate diff"),
            F.when(c("alignment_failed"), "alignment failed"),
        ),
        lambda r: r.isNotNull(),
    )
    return pairs.withColumns({"chosen_source": source, "needs_manual_review": review, "reasons": reasons})


def benign_class(clean: Column, hardness: Column, strict_test: Column, hard_threshold: int = 3) -> dict[str, Column]:
    name = F.when(clean & (hardness >= hard_threshold), "benign-hard-clean").when(clean, "benign-clean").otherwise("benign-borderline")
    return {"label_class": name, "train_allowed": clean & ~strict_test}


def gate_corpus(df: DataFrame, checks: Mapping[str, Column], max_excluded: float = 0.2) -> DataFrame:
    """Per-check drop counts and the gate's outcome (ok, empty, all_failed, over_cap).

    A row is dropped by the first check it fails.
    """
    reason = F.lit(None).cast("string")
    for name, bad in reversed(list(checks.items())):
        reason = F.when(bad, name).otherwise(reason)
    agg = df.select(reason.alias("_r")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_r").isNull()).alias("kept"),
        *[F.count_if(F.col("_r") == n).alias(f"dropped_{n}") for n in checks],
    )
    share = (F.col("total") - F.col("kept")) / F.greatest("total", F.lit(1))
    status = (
        F.when(F.col("total") == 0, "empty").when(F.col("kept") == 0, "all_failed").when(share > max_excluded, "over_cap").otherwise("ok")
    )
    return agg.withColumns({"excluded_share": r6(share), "status": status})


def gated(df: DataFrame, checks: Mapping[str, Column], max_excluded: float = 0.2) -> DataFrame:
    """Rows passing all checks; the job fails when the gate does not say ok."""
    status = gate_corpus(df, checks, max_excluded).select("status").scalar()
    bad = F.lit(False)
    for c in checks.values():
        bad = bad | F.coalesce(c, F.lit(False))
    guard = F.when(status != "ok", F.raise_error(F.concat(F.lit("corpus gate: "), status)).cast("boolean")).otherwise(True)
    return df.where(~bad).where(guard)


def fingerprint(content: Column, config: Column) -> Column:
    """Hash of content hash and configuration."""
    return F.sha2(F.concat_ws("|", F.sha2(content, 256), config), 256)


def pending_inputs(inputs: DataFrame, done: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Inputs not processed yet under the same configuration."""
    return inputs.join(done.select(key), key, "left_anti")


def agreement_counts(df: DataFrame, value: str) -> DataFrame:
    """Histogram with percent of all rows."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    return counts.withColumn("percent", r6(F.col("n") * 100.0 / total))


