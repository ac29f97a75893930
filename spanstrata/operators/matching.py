"""Joins between named things: fusing tables, resolving names, finding counterparts.

Containment is found by an automaton over all names, prefix conditions by equi-joins on
prefixes that are verified afterwards, so nothing is compared with everything.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import r6
from .automaton import contains_join

# Decorations of packed file names.
STRIP_SUFFIXES = ["_unsign_sign", "_legu_signed", "_legu_sign", "_protected_sign", "_unsigned_sign"]
CUT_KEYWORDS = ["_jiagu_sign", "_ijiami_sign", "_kiwi_sign", "_baidu_sign"]


def literal_map(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast("map<string,string>")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")


def normal_name(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def fuse_scores(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of two score tables with a ``problem`` per row (NULL = fused).

    a / b: keys, score, label_id.
    """
    left = a.select(*keys, F.col("score").alias("score_a"), F.col("label_id").alias("label_a"))
    right = b.select(*keys, F.col("score").alias("score_b"), F.col("label_id").alias("label_b"))
    problem = (
        F.when(F.col("score_b").isNull(), "only in first").when(F.col("score_a").isNull(), "only in second")
        .when(F.col("label_a") != F.col("label_b"), "labels differ")
    )
    return left.join(right, list(keys), "full_outer").withColumn("problem", problem)


def resolve_names(
    apps: DataFrame, index: DataFrame, overrides: Mapping[str, str], curated: Mapping[str, str], blocked: Sequence[str]
) -> DataFrame:
    """Package of each app name: override > curated > blocked > exact > last label > best substring.

    apps: app.  index: package, name, ordinal (order of the index).
    A pinned package that the index lacks stays unresolved.
    """
    named = apps.select("app", normal_name(F.col("app")).alias("needle"))
    pinned = named.select(
        "app", "needle",
        F.coalesce(F.try_element_at(literal_map(overrides), F.col("app")), F.try_element_at(literal_map(curated), F.col("app"))).alias("pin"),
        F.when(F.col("app").isin(*overrides) if overrides else F.lit(False), "override")
        .when(F.col("app").isin(*curated) if curated else F.lit(False), "curated")
        .when(F.col("app").isin(*blocked) if blocked else F.lit(False), "blocked").alias("tier"),
    )
    packages = index.select(F.col("package").alias("pin")).distinct().withColumn("_have", F.lit(True))
    fixed = pinned.where("tier IS NOT NULL").join(packages, "pin", "left").select(
        "app", F.when(F.col("_have"), F.col("pin")).alias("package"), F.when(F.col("_have"), F.col("tier")).otherwise("unresolved").alias("match_type"),
        F.when(F.col("_have"), 1.0).otherwise(0.0).alias("score"),
    )
    free = pinned.where("tier IS NULL AND needle <> ''").select("app", "needle")
    idx = index.select("package", "ordinal", normal_name(F.col("name")).alias("nn"), normal_name(F.substring_index("package", ".", -1)).alias("last"))
    exact = free.join(idx, F.col("needle") == F.col("nn")).select("app", "package", "ordinal", F.lit(1).alias("p"), F.lit(1.0).alias("score"))
    last = free.join(idx, F.col("needle") == F.col("last")).select("app", "package", "ordinal", F.lit(2).alias("p"), F.lit(0.8).alias("score"))
    sub = contains_join(free, idx.select("package", "ordinal", "nn"), "needle", "nn").select(
        "app", "package", "ordinal", F.lit(3).alias("p"), (F.length("needle") / F.length("nn")).alias("score")
    )
    best = exact.unionByName(last).unionByName(sub).groupBy("app").agg(
        F.min(F.struct("p", (-F.col("score")).alias("neg"), "ordinal", "package")).alias("b")
    )
    kinds = F.element_at(F.array(F.lit("exact"), F.lit("suffix"), F.lit("substring")), F.col("b.p"))
    found = best.select("app", F.col("b.package").alias("package"), kinds.alias("match_type"), r6(-F.col("b.neg")).alias("score"))
    rest = pinned.where("tier IS NULL").select("app").join(found, "app", "left").select(
        "app", "package", F.coalesce("match_type", F.lit("unresolved")).alias("match_type"), F.coalesce("score", F.lit(0.0)).alias("score")
    )
    return fixed.unionByName(rest)


def find_counterparts(stems: DataFrame, locations: DataFrame, min_prefix: int = 12) -> DataFrame:
    """Location of each (packer, stem): exact, else the only one containing the stem or its prefix, else NULL.

    stems: packer, stem.  locations: packer, location.

    A prefix has few characters, so all pieces of a location that are as long as a prefix are counted per packer and
    meet the prefixes by equality; pairs of rows are never listed, and nothing but the prefixes' lengths
    (at most ``min_prefix`` numbers) reaches the driver.  Rows that repeat count each.
    """
    s = stems.withColumn("_key", F.lower(F.substring("stem", 1, min_prefix)))
    exact = s.join(locations.select("packer", F.col("location").alias("stem")), ["packer", "stem"], "left_semi").select(
        "packer", "stem", F.col("stem").alias("found")
    ).distinct()
    rest = s.join(exact.select("packer", "stem"), ["packer", "stem"], "left_anti").where("_key <> ''")
    lengths = [r[0] for r in rest.select(F.length("_key")).distinct().collect()]
    text = F.lower("location")
    cut = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))
    pieces = F.array_distinct(F.flatten(F.array_compact(F.array(*map(cut, lengths), F.array().cast("array<string>")))))
    places = locations.select("packer", "location", F.explode(pieces).alias("_key")).groupBy("packer", "_key").agg(
        F.count(F.lit(1)).alias("_places"), F.min("location").alias("found")
    )
    wanted = rest.groupBy("packer", "stem", "_key").agg(F.count(F.lit(1)).alias("_rows")).where("_rows = 1")
    single = wanted.join(places.where("_places = 1"), ["packer", "_key"]).select("packer", "stem", "found")
    return stems.join(exact.unionByName(single), ["packer", "stem"], "left")


def carry_forward(fresh: DataFrame, prior: DataFrame, keys: Sequence[str], labels: Sequence[str], prior_only: Sequence[str] = ()) -> DataFrame:
    """Fresh rows win; NULL labels are filled from the prior row; ``prior_only`` columns come from it."""
    p = prior.select(*keys, *[F.col(c).alias(f"_{c}") for c in [*labels, *prior_only]])
    j = fresh.join(p, list(keys), "left")
    out = [F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in labels else F.col(c) for c in fresh.columns]
    return j.select(*out, *[F.col(f"_{c}").alias(c) for c in prior_only])


def pair_grid(items: DataFrame, families: Sequence[str], packed: DataFrame) -> DataFrame:
    """Every item with every configured family and the state of the pair.

    items: item, clean.  packed: item, family, confirmed.  The family list is a
    parameter, so the grid is an explode of a literal, not a cross join.
    """
    grid = items.withColumn("family", F.explode(F.array(*[F.lit(f) for f in families])))
    j = grid.join(packed.withColumn("_there", F.lit(True)), ["item", "family"], "left")
    status = (
        F.when(F.col("_there").isNull(), "missing_packed").when(~F.col("clean"), "unpacked_not_clean")
        .when(~F.col("confirmed"), "packed_not_confirmed").otherwise("paired")
    )
    return j.select("item", "family", F.concat_ws("__", "family", "item").alias("pair_id"), status.alias("status"))


def pair_tasks(grid: DataFrame, manual: Sequence[str]) -> DataFrame:
    """The grid as a task plan: packed pairs are done, some families need manual work."""
    state = F.when(F.col("status") != "missing_packed", "done").when(F.col("family").isin(*manual), "manual_required").otherwise("todo")
    return grid.withColumn("task", state)


def status_counts(grid: DataFrame) -> DataFrame:
    """Counts per status overall (family '*') and per family."""
    each = grid.groupBy("status", "family").agg(F.count(F.lit(1)).alias("n"))
    return each.unionByName(each.groupBy("status").agg(F.sum("n").alias("n")).withColumn("family", F.lit("*")))


def opposite_partners(bags: DataFrame, key: Column) -> DataFrame:
    """Per bag: how many bags of the same key have the opposite label, and the first of them.

    Group summaries are joined instead of pairs, so a large key stays linear.
    """
    b = bags.withColumn("pair_key", key)
    g = b.groupBy("pair_key", (F.lit(1) - F.col("label")).alias("label")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("bag_id").alias("first_partner")
    )
    return b.join(g, ["pair_key", "label"], "left").select(
        "bag_id", "label", "pair_key", F.coalesce("_n", F.lit(0)).alias("partner_count"), "first_partner"
    )


def anchor_positive_pairs(vectors: DataFrame, key: str, side: str, vector: str, family: str) -> DataFrame:
    """One row per key with both sides; ``problem`` marks unequal shapes or a missing side."""
    pick = lambda v, c: F.max_by(F.when(F.col(side) == v, F.col(c)), F.when(F.col(side) == v, 1))
    wide = vectors.groupBy(key).agg(
        pick(0, vector).alias("anchor"), pick(1, vector).alias("positive"), pick(0, family).alias("anchor_family"), pick(1, family).alias("positive_family")
    )
    problem = F.when(F.col("anchor").isNull() | F.col("positive").isNull(), "missing side").when(F.size("anchor") != F.size("positive"), "shape")
    return wide.withColumn("problem", problem)


def remap_unique_owner(rows: DataFrame, owners: DataFrame, key: str, owner: str) -> DataFrame:
    """Replace ``key`` by its owner where exactly one owner exists; other rows keep NULL."""
    one = owners.select(key, owner).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(owner).alias(owner)).where("_n = 1").drop("_n")
    return rows.join(one, key, "left")


def match_origins(packed: DataFrame, origins: DataFrame) -> DataFrame:
    """Origin of decorated names: stripped suffix, cut at a keyword, else longest prefix, else package prefix.

    packed: stem.  origins: origin (distinct).
    """
    s = F.col("stem")
    tries = []
    for i, x in enumerate(STRIP_SUFFIXES):
        tries.append(F.when(s.endswith(x), F.struct(F.lit(i).alias("p"), F.substring(s, F.lit(1), F.length(s) - len(x)).alias("cand"))))
    for i, x in enumerate(CUT_KEYWORDS):
        head = F.substring_index(s, x, 1)
        bare = F.regexp_replace(head, "_[0-9]+$", "")
        tries.append(F.when(s.contains(x), F.struct(F.lit(10 + i).alias("p"), bare.alias("cand"))))
    listed = packed.select("stem", F.inline(F.filter(F.array(*tries), lambda t: t.isNotNull())))
    prefixes = packed.select(
        "stem", F.lit(100).alias("p"), F.explode(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, F.lit(1), i))).alias("cand")
    )
    o = origins.select("origin", F.substring_index("origin", "_", 1).alias("_head"))
    exact = listed.unionByName(prefixes).join(o.select(F.col("origin").alias("cand"), "origin"), "cand").select("stem", "p", "origin")
    # of the origins of one head only the longest (then the first) can be the answer
    heads = o.groupBy("_head").agg(F.min(F.struct((-F.length("origin")).alias("l"), "origin"))["origin"].alias("origin"))
    loose = prefixes.select("stem", F.lit(200).alias("p"), F.col("cand").alias("_head")).join(heads, "_head").select("stem", "p", "origin")
    best = exact.unionByName(loose).groupBy("stem").agg(F.min(F.struct("p", (-F.length("origin")).alias("l"), "origin")).alias("b"))
    return packed.join(best.select("stem", F.col("b.origin").alias("origin")), "stem", "left")


def discover_pairs(registry: DataFrame, packed: DataFrame, base: DataFrame, allow: Sequence[str] = ()) -> DataFrame:
    """Registry x packed listing x base listing: exact base name first, then equal slugs.

    registry: packer_id, grp.  packed: packer_id, stem.  base: base_name.
    """
    reg = registry.where(F.col("grp") != "registered_not_patched")
    reg = reg.where(F.col("packer_id").isin(*allow)) if allow else reg
    listed = packed.join(reg, "packer_id").withColumn("_slug", slug(F.col("stem")))
    exact = base.select(F.col("base_name").alias("stem"), F.col("base_name").alias("_exact"))
    by_slug = base.groupBy(slug(F.col("base_name")).alias("_slug")).agg(F.min("base_name").alias("_near"))
    j = listed.join(exact, "stem", "left").join(by_slug, "_slug", "left")
    return j.select("packer_id", "grp", "stem", F.coalesce("_exact", "_near").alias("base_name")).where("base_name IS NOT NULL")
