"""Two snapshots of the same container: member mapping, changed ranges, diff scores, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions.numeric import r6, ratio
from .ordering import materialize, positions

# Branch names and thresholds.
UNCHANGED, MODIFIED, NEW, REMOVED, RENAMED = "unchanged", "byte_modified", "new_in_packed", "removed", "renamed"
DEGENERATE = 0.95


def snapshot_members(old: DataFrame, new: DataFrame) -> DataFrame:
    """Members of both snapshots mapped by name, then by content.

    old / new: pair_id, name, size, sha256.  Equal names claim each other first;
    the k-th remaining new member of a hash is then a rename of the k-th
    remaining old one (by name).
    Returns pair_id, branch, new_name, old_name, sizes and hashes.
    """
    n = new.select("pair_id", "name", F.col("name").alias("new_name"), F.col("size").alias("new_size"), F.col("sha256").alias("new_sha256"))
    o = old.select("pair_id", "name", F.col("name").alias("old_name"), F.col("size").alias("old_size"), F.col("sha256").alias("old_sha256"))
    # Three branches read the mapped names; the slim join is evaluated once.
    joined = materialize(n.join(o, ["pair_id", "name"], "full_outer").drop("name"))
    both = F.col("new_name").isNotNull() & F.col("old_name").isNotNull()
    same = joined.where(both).withColumn(
        "branch", F.when(F.col("new_sha256") == F.col("old_sha256"), UNCHANGED).otherwise(MODIFIED)
    )
    keys = ["pair_id", "sha256"]
    added = joined.where("old_name IS NULL").select("pair_id", F.col("new_sha256").alias("sha256"), "new_name", "new_size")
    gone = joined.where("new_name IS NULL").select("pair_id", F.col("old_sha256").alias("sha256"), "old_name", "old_size")
    added = positions(added, keys, [F.col("new_name")], name="k")
    gone = positions(gone, keys, [F.col("old_name")], name="k")
    rest = added.join(gone, [*keys, "k"], "full_outer").select(
        "pair_id", "new_name", "new_size", F.when(F.col("new_name").isNotNull(), F.col("sha256")).alias("new_sha256"),
        "old_name", "old_size", F.when(F.col("old_name").isNotNull(), F.col("sha256")).alias("old_sha256"),
        F.when(both, RENAMED).when(F.col("new_name").isNotNull(), NEW).otherwise(REMOVED).alias("branch"),
    )
    cols = ["pair_id", "branch", "new_name", "old_name", "new_size", "old_size", "new_sha256", "old_sha256"]
    return same.select(*cols).unionByName(rest.select(*cols))


def changed_ranges(members: DataFrame, old: DataFrame, new: DataFrame, block: int = 4096) -> DataFrame:
    """Add ``diff_ranges`` and ``changed_bytes``.  Contents are fetched for modified members only."""
    mod = members.where(F.col("branch") == MODIFIED).select("pair_id", "new_name", "old_name")
    a = new.select("pair_id", F.col("name").alias("new_name"), F.col("content").alias("_a"))
    b = old.select("pair_id", F.col("name").alias("old_name"), F.col("content").alias("_b"))
    ranges = (
        mod.join(a, ["pair_id", "new_name"])
        .join(b, ["pair_id", "old_name"])
        .select("pair_id", "new_name", B.block_diff(F.col("_a"), F.col("_b"), block).alias("_r"))
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("new_size").cast("bigint").alias("end")))
    joined = members.join(ranges, ["pair_id", "new_name"], "left")
    listed = F.when((F.col("branch") == NEW) & (F.col("new_size") > 0), whole).otherwise(F.coalesce("_r", none))
    out = joined.withColumn("diff_ranges", listed).drop("_r")
    return out.withColumn(
        "changed_bytes", F.aggregate("diff_ranges", F.lit(0).cast("bigint"), lambda acc, r: acc + r["end"] - r["start"])
    )


def diff_summary(changed: DataFrame) -> DataFrame:
    """Totals per pair, changed-byte ratio, degenerate and alignment-failed flags."""
    agg = changed.groupBy("pair_id").agg(
        F.coalesce(F.sum("new_size"), F.lit(0)).alias("total_bytes"),
        F.sum("changed_bytes").alias("changed_bytes"),
        *[F.count_if(F.col("branch") == b).alias(f"n_{b}") for b in (UNCHANGED, MODIFIED, NEW, REMOVED, RENAMED)],
    )
    share = ratio(F.col("changed_bytes"), F.col("total_bytes"))
    linked = F.col(f"n_{UNCHANGED}") + F.col(f"n_{MODIFIED}") + F.col(f"n_{RENAMED}")
    return agg.withColumns(
        {
            "changed_ratio": r6(share),
            "degenerate": share > DEGENERATE,
            "alignment_failed": (F.col("total_bytes") > 0) & (linked == 0),
        }
    )


def all_new_are_payload(members: DataFrame) -> Column:
    return F.lit("payload_container")


def no_new_is_payload(members: DataFrame) -> Column:
    return F.lit("benign_loader")


def diff_labels(
    changed: DataFrame, summary: DataFrame, family: Column, new: DataFrame | None = None,
    policy: Callable[[DataFrame], Column] = all_new_are_payload, include_degenerate: bool = False,
) -> DataFrame:
    """Changed ranges of modified members and accepted new members as payload labels.

    ``policy`` maps the member table to a class per new member; only
    ``payload_container`` is labelled.  With ``new`` (contents) each range gets
    its own hash, otherwise the member's.
    """
    ok = ~F.col("alignment_failed") if include_degenerate else ~(F.col("alignment_failed") | F.col("degenerate"))
    rows = changed.join(summary.where(ok).select("pair_id"), "pair_id", "left_semi")
    keep = (F.col("branch") == MODIFIED) | ((F.col("branch") == NEW) & (policy(rows) == "payload_container"))
    spans = rows.where(keep).select("pair_id", F.col("new_name").alias("object_path"), "new_sha256", F.explode("diff_ranges").alias("r"))
    spans = spans.select("pair_id", "object_path", "new_sha256", F.col("r.start").alias("offset_start"), F.col("r.end").alias("offset_end"))
    sha = F.col("new_sha256")
    if new is not None:
        body = new.select("pair_id", F.col("name").alias("object_path"), "content")
        spans = spans.join(body, ["pair_id", "object_path"])
        sha = F.sha2(F.substring("content", (F.col("offset_start") + 1).cast("int"), (F.col("offset_end") - F.col("offset_start")).cast("int")), 256)
    return spans.select(
        "pair_id", "object_path", "offset_start", "offset_end", F.lit("hidden_executable_payload").alias("label"),
        family.alias("transform_family"), sha.alias("payload_sha256"),
    )


def with_profile(members: DataFrame) -> DataFrame:
    """Add histogram and entropy of ``content`` and drop the bytes."""
    h = members.withColumn("hist", B.byte_histogram("content")).drop("content")
    return h.withColumn("entropy", B.entropy(F.col("hist"), F.col("size")))


def _near_pairs(new: DataFrame, old: DataFrame, limit: float) -> DataFrame:
    """All pairs with |log2 size ratio| + 2 * histogram distance < limit: pair_id, new_name, old_name, score.

    Both terms bound the search exactly: sizes within ``limit`` doublings and
    shares of any byte class within ``limit / 4``.  Members meet only in cells of
    that grid, and the distance is computed for survivors of both bounds.
    """
    def shape(df, tag):
        return df.select(
            "pair_id", F.col("name").alias(f"{tag}_name"), F.col("hist").alias(f"{tag}_hist"), F.col("size").alias(f"{tag}_size"),
            F.log2(F.greatest("size", F.lit(1)).cast("double")).alias(f"{tag}_log"),
            ratio(B.visible_count(F.col("hist")), F.col("size")).alias(f"{tag}_vis"),
        )

    n, o = shape(new, "new"), shape(old, "old")
    near = limit / 4.0

    def reach(value, radius):
        return F.explode(F.sequence(F.floor((value - radius) / radius).cast("int"), F.floor((value + radius) / radius).cast("int")))

    o = o.withColumns({"c1": F.floor(F.col("old_log") / limit).cast("int"), "c2": F.floor(F.col("old_vis") / near).cast("int")})
    n = n.withColumn("c1", reach(F.col("new_log"), limit)).withColumn("c2", reach(F.col("new_vis"), near))
    gap = F.abs(F.col("new_log") - F.col("old_log"))
    close = n.join(o, ["pair_id", "c1", "c2"]).where(gap + 4.0 * F.abs(F.col("new_vis") - F.col("old_vis")) < limit)
    l1 = B.histogram_l1(F.col("new_hist"), F.col("old_hist"), F.col("new_size"), F.col("old_size"))
    return close.select("pair_id", "new_name", "old_name", r6(gap + 2.0 * l1).alias("score")).where(F.col("score") < limit)


def _mutual_best(scored: DataFrame) -> DataFrame:
    best_n = scored.groupBy("pair_id", "new_name").agg(F.min(F.struct("score", "old_name")).alias("m"))
    best_o = scored.groupBy("pair_id", "old_name").agg(F.min(F.struct("score", "new_name")).alias("m"))
    left = best_n.select("pair_id", "new_name", F.col("m.old_name").alias("old_name"), F.col("m.score").alias("score"))
    right = best_o.select("pair_id", F.col("m.new_name").alias("new_name"), "old_name")
    return left.join(right, ["pair_id", "new_name", "old_name"])


def fuzzy_matches(new: DataFrame, old: DataFrame, limit: float = 2.0) -> DataFrame:
    """Mutually best partners of unmatched members, in one round; see ``greedy_matches`` for all."""
    return _mutual_best(_near_pairs(new, old, limit))


def greedy_matches(new: DataFrame, old: DataFrame, limit: float = 2.0) -> DataFrame:
    """Exact greedy 1:1 partners of unmatched members: the least (score, new_name, old_name) first.

    A pair that is best for both its members is taken by the greedy order, whatever comes
    before it, so rounds of mutual-best joins on the members still free give the same pairs.
    Each round is checkpointed; there are as many as the longest chain of members that wait
    for one another.
    """
    scored = materialize(_near_pairs(new, old, limit))
    found = materialize(_mutual_best(scored))
    out = found
    while not found.isEmpty():
        scored = materialize(scored.join(found.select("pair_id", "new_name"), ["pair_id", "new_name"], "left_anti")
                             .join(found.select("pair_id", "old_name"), ["pair_id", "old_name"], "left_anti"))
        found = materialize(_mutual_best(scored))
        out = out.unionByName(found)
    return out


def member_mapping(new: DataFrame, old: DataFrame, limit: float = 2.0) -> DataFrame:
    """pair_id, new_name, old_name: partners by name, then by content, then by ``greedy_matches`` of the rest.

    new / old: pair_id, name, size, sha256, hist.
    """
    members = materialize(snapshot_members(old, new))

    def free(side, own, other):
        rest = members.where(F.col(other).isNull()).select("pair_id", F.col(own).alias("name"))
        return side.join(rest, ["pair_id", "name"], "left_semi")

    linked = members.where("new_name is not null and old_name is not null").select("pair_id", "new_name", "old_name")
    more = greedy_matches(free(new, "new_name", "old_name"), free(old, "old_name", "new_name"), limit)
    return linked.unionByName(more.select("pair_id", "new_name", "old_name"))


def diff_magnitude(new: DataFrame, old: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Diff score of each new member against its namesake, or its partner in ``mapping`` (see ``member_mapping``): new 1.0, unchanged 0.0, modified 0.1-0.9.

    new / old: pair_id, name, size, sha256, entropy, hist.  A pair without any old
    member is unknown (0.5).
    """
    o = old.select("pair_id", "name", *[F.col(c).alias(f"o_{c}") for c in ("size", "sha256", "entropy", "hist")])
    if mapping is not None:
        partners = mapping.select("pair_id", F.col("old_name").alias("name"), F.col("new_name").alias("_new"))
        o = o.join(partners, ["pair_id", "name"]).drop("name").withColumnRenamed("_new", "name")
    sides = old.select("pair_id").distinct().withColumn("_known", F.lit(True))
    j = new.join(o, ["pair_id", "name"], "left").join(sides, "pair_id", "left")
    rel = F.col("size") / F.greatest("o_size", F.lit(1))
    size_f = F.least(F.abs(F.log2(F.greatest(rel, F.lit(0.01)))) / 3.0, F.lit(1.0))
    ent = F.abs(F.col("entropy") - F.col("o_entropy"))
    l1 = B.histogram_l1(F.col("hist"), F.col("o_hist"), F.col("size"), F.col("o_size"))
    mix = 0.3 * size_f + 0.3 * F.least(ent / 4.0, F.lit(1.0)) + 0.4 * F.least(l1 / 1.5, F.lit(1.0))
    status = (
        F.when(F.col("_known").isNull(), "unknown").when(F.col("o_sha256").isNull(), "new")
        .when(F.col("sha256") == F.col("o_sha256"), "unchanged").otherwise("modified")
    )
    d = j.withColumn("status", status)
    is_mod = F.col("status") == "modified"
    coarse = (
        F.when(F.col("o_size").isNull(), 1.0).when((ent > 2.0) | (rel > 2.0) | (rel < 0.3), 0.8)
        .when(F.col("size") != F.col("o_size"), 0.3).otherwise(0.0)
    )
    return d.select(
        "pair_id", "name", "status",
        r6(F.when(F.col("status") == "unknown", 0.5).when(F.col("status") == "new", 1.0).when(~is_mod, 0.0)
           .otherwise(F.greatest(F.least(mix, F.lit(0.9)), F.lit(0.1)))).alias("diff_score"),
        coarse.alias("coarse_score"),
        r6(F.when(is_mod, l1).when(F.col("status") == "new", 2.0).otherwise(0.0)).alias("histogram_distance"),
    )


def removed_members(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("pair_id", "name"), ["pair_id", "name"], "left_anti")


def distinct_candidates(frames: list[DataFrame], path: str) -> DataFrame:
    """Union of candidate lists, one row per case-insensitive path; earlier lists win."""
    tagged = [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f)
    cols = frames[0].columns
    best = out.groupBy(F.lower(path).alias("_key")).agg(F.min(F.struct("_src", *cols)).alias("b"))
    return best.select(*[F.col(f"b.{c}").alias(c) for c in cols])


