"""Splits, folds and deterministic samples.

Random choices follow the order of md5('seed|...|key'), which every engine
reproduces.  Ranks come from ``positions`` with digest buckets, so a stratum
holding most of the data is still ranked by many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import sample_digest
from .ordering import materialize, positions, prefix_sums

ALL = "_all"


def hash_ranked(df: DataFrame, keys: Sequence[str], seed: int, parts: Sequence[Column], name: str = "rn") -> DataFrame:
    """1-based rank in the digest order of each stratum."""
    d = df.withColumn("_md5", sample_digest(seed, *parts))
    work, k = (d, list(keys)) if keys else (d.withColumn(ALL, F.lit(0)), [ALL])
    return positions(work, k, [F.col("_md5")], name=name).drop("_md5", ALL)


def group_split(df: DataFrame, group: str, assignment: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add ``partition`` by group; groups named nowhere are unassigned."""
    listed = [g for groups in assignment.values() for g in groups]
    if not listed:
        raise ValueError("at least one group must be assigned")
    if len(set(listed)) != len(listed):
        raise ValueError("a group may appear in one partition only")
    table = F.create_map(*[F.lit(x) for p, groups in assignment.items() for g in groups for x in (g, p)])
    return df.withColumn("partition", F.coalesce(F.try_element_at(table, F.col(group)), F.lit("unassigned")))


def leave_one_out(df: DataFrame, group: str, label: str, benign_test: Column | None = None, failed: Column | None = None) -> DataFrame:
    """Assign rows for leave-one-group-out without copying them per fold.

    ``test_fold`` is the group of a positive row; benign rows are ``benign_train``
    (in every training set) or ``benign_test`` (in every test set).  Failed rows
    and positives without a group are dropped.
    """
    kept = df.where(~F.coalesce(failed, F.lit(False))) if failed is not None else df
    kept = kept.where((F.col(label) == 0) | (F.col(group).isNotNull() & (F.col(group) != "")))
    kind = F.when(F.col(label) != 0, "positive").when(benign_test if benign_test is not None else F.lit(False), "benign_test").otherwise("benign_train")
    return kept.withColumns({"kind": kind, "test_fold": F.when(F.col(label) != 0, F.col(group))})


def fold_role(held_out: Column) -> Column:
    """Role of an assigned row in the fold that holds out one group."""
    return (
        F.when(F.col("kind") == "benign_train", "train").when(F.col("kind") == "benign_test", "test")
        .when(F.col("test_fold") == held_out, "test").otherwise("train")
    )


def fold_sizes(assigned: DataFrame) -> DataFrame:
    """Train and test sizes of every fold from per-group counts: training = all minus the held-out group."""
    per = assigned.where("kind = 'positive'").groupBy(F.col("test_fold").alias("held_out")).agg(F.count(F.lit(1)).alias("n_test_positive"))
    total = assigned.agg(
        F.struct(
            F.count_if(F.col("kind") == "positive").alias("p"), F.count_if(F.col("kind") == "benign_train").alias("b"), F.count_if(F.col("kind") == "benign_test").alias("t")
        ).alias("s")
    ).scalar()
    return per.select(
        "held_out", (total["p"] - F.col("n_test_positive")).alias("n_train_positive"), total["b"].alias("n_train_benign"), "n_test_positive", total["t"].alias("n_test_benign")
    )


def seed_roles(seeds: DataFrame, seed_col: str, repeats: int, test_share: float = 0.3, seed: int = 42) -> DataFrame:
    """(repeat, seed, role): per repeat the first share of seeds in digest order is test."""
    distinct = seeds.select(seed_col).distinct()
    grid = distinct.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    ranked = hash_ranked(grid, ["repeat"], seed, [F.col("repeat"), F.col(seed_col)])
    n = distinct.agg(F.count(F.lit(1)).alias("n")).scalar()
    cut = F.greatest(F.lit(1), F.floor(n * test_share))
    return ranked.select("repeat", seed_col, F.when(F.col("rn") <= cut, "test").otherwise("train").alias("role"))


def seed_disjoint_counts(rows: DataFrame, roles: DataFrame, seed_col: str, family: str, families: Sequence[str], benign: str = "benign") -> DataFrame:
    """Rows per (repeat, held-out family, role): both classes only from the seeds of their side.

    Rows collapse to (seed, family) counts first, so repeats and folds multiply
    counts and not rows.
    """
    cells = rows.groupBy(seed_col, family).agg(F.count(F.lit(1)).alias("_n"))
    j = cells.join(roles, seed_col).withColumn("held_out", F.explode(F.array(*[F.lit(f) for f in families])))
    is_test = F.col("role") == "test"
    own, ben = F.col(family) == F.col("held_out"), F.col(family) == benign
    used = j.where(ben | (own & is_test) | (~own & ~is_test))
    return used.groupBy("repeat", "held_out", "role").agg(
        F.sum(F.when(ben, 0).otherwise(F.col("_n"))).alias("positives"), F.sum(F.when(ben, F.col("_n")).otherwise(0)).alias("benign")
    )


def _round_robin(df: DataFrame, strata: Sequence[str], seed: int, key: Column) -> DataFrame:
    """Global position when the strata are visited in turn, each in digest order."""
    ranked = materialize(hash_ranked(df, strata, seed, [key], "_rr").withColumn(ALL, F.lit(0)))
    return positions(ranked, [ALL], [F.col("_rr"), *[F.col(s) for s in strata]], name="_turn").drop(ALL)


def stratified_sample(df: DataFrame, target: int, min_positive: int, group: str, label: str, key: str, seed: int = 0) -> DataFrame:
    """At most ``target`` rows: positives first, then round robin over (group, label)."""
    df = materialize(df)
    n = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p")).alias("s")).scalar()
    keep = F.least(n["p"], F.greatest(F.lit(target // 2), F.lit(min_positive)), F.lit(target))
    pos = materialize(hash_ranked(df.where(F.col(label) == 1), [], seed, [F.col(key)]).withColumn("_in", F.col("rn") <= keep))
    rest = pos.where("NOT _in").drop("rn", "_in").unionByName(df.where(F.col(label) != 1))
    filled = _round_robin(rest, [group, label], seed + 1, F.col(key)).where(F.col("_turn") <= F.lit(target) - keep)
    sampled = pos.where("_in").select(*df.columns).unionByName(filled.select(*df.columns))
    return sampled


def fit_calibration_split(
    df: DataFrame, share: float, min_rows: int, min_positive: int, group: str, label: str, key: str, seed: int = 0
) -> DataFrame:
    """Add ``part`` = calibration / fit; both labels stay present in fit.  Rows that share a key share its part."""
    df = materialize(df)
    n = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p")).alias("s")).scalar()
    neg = n["n"] - n["p"]
    one = F.lit(1).cast("bigint")
    target = F.least(F.greatest(one, F.lit(min_rows), F.bround(n["n"] * share, 0).cast("bigint")), n["n"] - 1)
    kp = F.greatest(F.least(n["p"] - 1, target, F.greatest(one, F.lit(min_positive))), F.lit(0))
    kn = F.greatest(F.least(neg - 1, target - kp, F.greatest(one, F.floor(target / 2))), F.lit(0))
    ranked = hash_ranked(df, [label], seed, [F.col(key)])
    first = F.col("rn") <= F.when(F.col(label) == 1, kp).otherwise(kn)
    ranked = materialize(ranked.withColumn("_first", first))
    turned = _round_robin(ranked.where("NOT _first").drop("rn", "_first"), [group, label], seed + 1, F.col(key))
    turned = materialize(turned)
    inside = positions(turned, [label], [F.col("_turn")], name="_in_label")
    cap = F.when(F.col(label) == 1, n["p"] - 1 - kp).otherwise(neg - 1 - kn)
    allowed = materialize(inside.where(F.col("_in_label") <= cap).withColumn(ALL, F.lit(0)))
    order = positions(allowed, [ALL], [F.col("_turn")], name="_fill")
    extra = order.where(F.col("_fill") <= target - kp - kn).select(key)
    chosen = ranked.where("_first").select(key).unionByName(extra).distinct().withColumn("_c", F.lit(True))
    return df.join(chosen, key, "left").withColumn("part", F.when(F.col("_c"), "calibration").otherwise("fit")).drop("_c")


def subsample_bags(df: DataFrame, bag: str, positive: Column, key: str, max_size: int, min_share: float, seed: int = 0) -> DataFrame:
    """Keep all positives of a bag and so many negatives that size cap and positive share hold."""
    work = df.withColumn("_y", positive)
    sizes = work.groupBy(bag).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_y").alias("_p"))
    by_share = F.when((F.col("_p") > 0) & F.lit(min_share > 0), F.floor(F.col("_p") / (min_share or 1.0))).otherwise(F.lit(max_size))
    target = F.greatest(F.least(F.lit(max_size), by_share), F.col("_p"))
    quota = F.when(F.col("_n") <= max_size, F.col("_n")).otherwise(target - F.col("_p"))
    neg = hash_ranked(work.where("NOT _y"), [bag], seed, [F.col(bag), F.col(key)])
    kept = neg.join(sizes.select(bag, quota.alias("_q")), bag).where(F.col("rn") <= F.col("_q"))
    return work.where("_y").select(*df.columns).unionByName(kept.select(*df.columns))


def subsample_windows(df: DataFrame, bag: str, obj: str, index: str, max_windows: int, seed: int = 0) -> DataFrame:
    """At most ``max_windows`` windows per bag with a new consecutive ``new_index``."""
    picked = hash_ranked(df, [bag], seed, [F.col(bag), F.col(index)]).where(F.col("rn") <= max_windows).drop("rn")
    placed = positions(picked, [bag], [F.col(index)], name="_p")
    return placed.withColumn("new_index", F.col("_p") - 1).drop("_p")


def object_bounds(sampled: DataFrame, bag: str, obj: str) -> DataFrame:
    """[start, end) of the new index per object; objects without windows are gone."""
    return sampled.groupBy(bag, obj).agg(F.min("new_index").alias("start"), (F.max("new_index") + 1).alias("end"))


def audit_sample(rows: DataFrame, share: float = 0.1, low: int = 4, high: int = 6, seed: int = 0) -> DataFrame:
    """Pairs to audit: all review rows, extreme ratios, one per family, random fill; reasons joined.

    rows: packer_id, apk_id, final_label_count, needs_manual_review, ratio.
    """
    keys = ["packer_id", "apk_id"]
    ok = materialize(rows.where((F.col("final_label_count") > 0) | F.col("needs_manual_review")))
    n = ok.agg(F.count(F.lit(1)).alias("n")).scalar()
    target = F.greatest(F.lit(low), F.least(F.lit(high), F.ceil(n * share)))
    tag = lambda df, p, why: df.select(*keys, F.lit(p).alias("_p"), F.lit(why).alias("why"))
    review = tag(ok.where("needs_manual_review"), 0, "needs_manual_review=true")
    rated = ok.where("ratio IS NOT NULL AND ratio <> 0")
    edge = lambda fn: rated.agg(fn(F.struct("ratio", *keys)).alias("b")).where("b IS NOT NULL").select(*[f"b.{k}" for k in keys])
    lowest, highest = edge(F.min), edge(F.max)
    lows = tag(lowest, 1, "lowest non-zero payload_ratio (possible payload miss)")
    highs = tag(highest.join(lowest, keys, "left_anti"), 2, "highest payload_ratio (degenerate boundary)")
    base = review.unionByName(lows).unionByName(highs)
    missing = ok.join(base.select("packer_id"), "packer_id", "left_anti").groupBy("packer_id").agg(F.min("apk_id").alias("apk_id"))
    cover = missing.select(*keys, F.lit(3).alias("_p"), F.format_string("packer '%s' coverage", "packer_id").alias("why"))
    picked = materialize(base.unionByName(cover))
    taken = picked.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    pool = hash_ranked(ok.join(picked.select(*keys), keys, "left_anti").select(*keys), [], seed, [F.col(k) for k in keys])
    fill = tag(pool.where(F.col("rn") <= target - taken), 4, "random fill")
    both = picked.unionByName(fill)
    return both.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "why"))), lambda s: s["why"]), "; ").alias("rationale"))


def control_training_set(df: DataFrame, mode: str, family: str, label: str, target_family: str, paired: Column, key: str) -> DataFrame:
    """Training rows under one of four control modes.

    non_target, add_target, add_target_benign, other_positive_replay: the last
    repeats as many other positives (by family, key) as the target family has.
    """
    benign = df.where((F.col(label) == 0) & ~paired)
    others = df.where((F.col(label) == 1) & (F.col(family) != target_family))
    own = df.where((F.col(label) == 1) & (F.col(family) == target_family))
    out = benign.unionByName(others)
    if mode == "non_target":
        return out
    if mode in ("add_target", "add_target_benign"):
        out = out.unionByName(own)
        return out.unionByName(df.where((F.col(label) == 0) & paired)) if mode == "add_target_benign" else out
    if mode != "other_positive_replay":
        raise ValueError("unknown control mode")
    n = own.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = others.groupBy(family).agg(F.count(F.lit(1)).alias("_c")).withColumn(ALL, F.lit(0))
    before = positions_sum(counts, family)
    inside = positions(others, [family], [F.col(key)], name="_i")
    replay = inside.join(before, family).where(F.col("_i") + F.col("_before") <= n)
    return out.unionByName(replay.select(*df.columns))


def positions_sum(counts: DataFrame, family: str) -> DataFrame:
    """Rows of all families that sort before a family (one row per family)."""
    return prefix_sums(counts, [ALL], [F.col(family)], {"_before": (F.col("_c"), False)}).select(family, "_before")
