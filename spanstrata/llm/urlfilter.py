"""URL filter: host and path rules, and boosted trees on lexical features for the rest."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Trees, fit_trees, score
from .common import lower_ascii, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 20_000  # labelled URLs that the trees are fitted on
FOLDS = 5  # of whole suffixes, on which it is decided whether page counts serve
LEXICAL = ["length", "host_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "host_entropy", "parameters", "fragment"]
COUNTS = ["suffix_pages", "site_pages"]
FEATURES = LEXICAL + COUNTS


def host_of(url: Column) -> Column:
    """A-Z lower-cased text after the first ``://`` up to ``/ ? #`` or the end; empty without ``://``."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of ``(verdict, host/path)`` that fits; among equally long ones the first in order of text."""
    fit = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True)[::-1]:
        site, _, start = rule.partition("/")
        own = ((host == site) | host.endswith("." + site)) & path.startswith("/" + start)
        fit = F.when(own, F.lit(rule)).otherwise(fit)
    return fit


def entropies(texts: list[str]) -> np.ndarray:
    """Shannon entropy of the characters of each text, in bits; 0 for an empty one."""
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        if text:
            counts = np.bincount(np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_inverse=True)[1])
            share = counts / len(text)
            out[i] = -(share * np.log2(share)).sum()
    return out


def with_entropy(urls: DataFrame) -> DataFrame:
    """Adds ``entropy`` of the whole url and ``host_entropy`` of the whole host, from counts of all their characters."""

    def run(batches):
        for batch in batches:
            parts = [pa.array(entropies([t or "" for t in batch.column(c).to_pylist()]), pa.float64()) for c in ("url", "host")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *parts], names=[*batch.schema.names, "entropy", "host_entropy"])

    schema = T.StructType([*urls.schema.fields, T.StructField("entropy", T.DoubleType()), T.StructField("host_entropy", T.DoubleType())])
    return urls.mapInArrow(run, schema)


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that need no other URL, and ``suffix`` (last two labels) and ``site`` (last three)."""
    url, digits = F.coalesce("url", F.lit("")), lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    rest = F.regexp_extract(url, "(?s)://(.*)", 1)
    return with_entropy(urls).withColumns({
        "length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "labels": F.size(F.filter(F.split("host", "[.]"), lambda x: x != "")).cast("double"),
        "digit_ratio": digits(url) / F.greatest(F.length(url), F.lit(1)),
        "hyphens": F.length(F.regexp_replace("host", "[^-]", "")).cast("double"),
        "parameters": F.when(F.instr(url, "?") > 0, F.size(F.split(F.substring_index(F.regexp_extract(rest, "(?s)[?](.*)", 1), "#", 1), "&"))).otherwise(0).cast("double"),
        "fragment": (F.instr(url, "#") > 0).cast("double"),
        "suffix": F.substring_index("host", ".", -2),
        "site": F.substring_index("host", ".", -3),
    })


def fit(drawn: list[tuple[str, float, list[float]]]) -> tuple[Trees, list[str]]:
    """Trees and their features, from ``(suffix, label, values of FEATURES)``.

    Rules decide most suffixes one way, so what tells suffixes apart also tells the labels that
    rules give.  Hence no verdict of its own suffix is a feature of a row, and page counts are
    features only if they lower the log loss on suffixes that the trees have not seen.
    """
    suffixes = {s: i % FOLDS for i, s in enumerate(dict.fromkeys(s for s, _, _ in drawn))}
    fold, y = np.array([suffixes[s] for s, _, _ in drawn]), np.array([v for _, v, _ in drawn])
    x = np.array([f for _, _, f in drawn], dtype=float).reshape(len(drawn), len(FEATURES))

    def loss(width):
        total = 0.0
        for k in range(min(FOLDS, len(suffixes))):
            p = np.clip(fit_trees(x[fold != k, :width], y[fold != k]).predict(x[fold == k, :width]), 1e-6, 1 - 1e-6)
            total -= (y[fold == k] * np.log(p) + (1 - y[fold == k]) * np.log(1 - p)).sum()
        return total

    width = len(FEATURES) if len(suffixes) > 1 and loss(len(FEATURES)) < loss(len(LEXICAL)) else len(LEXICAL)
    return fit_trees(x[:, :width], y), FEATURES[:width]


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_column: str = "page_id") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every url.

    A rule decides where one fits.  For the others boosted trees are fitted on URLs that rules
    decide (at most SAMPLE distinct ones, those of the smallest digests): length, depth, digit
    ratio, entropy of the whole url and host, parameters, and, where that serves on suffixes left
    out (see ``fit``), how often the suffix and the site occur over all pages.  ``score`` is the trees' probability of a block, at least 0.5
    is ``block``.  If rules decide no url, or all alike, the rest is allowed with score 0.

    A null url, or one without ``://``, has an empty host and path.  Repeated rows get the same
    verdict; a null page_id stays; other columns are ignored; no rows give no rows.
    """
    verdicts = F.create_map(*(F.lit(x) for v, r in rules for x in (r, v)))
    base = pages.select(id_column, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = lexical(base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("given", verdicts[F.col("rule")]))
    rows = rows.withColumn("label", (F.col("given") == "block").cast("double"))
    stats = settle(rows.groupBy("suffix", "site").agg(F.count(F.lit(1)).alias("n")))
    for key in ("suffix", "site"):
        rows = rows.join(stats.groupBy(key).agg(F.log2(F.sum("n") + 1.0).alias(f"{key}_pages")), key)
    rows = settle(rows.select(id_column, "host", "path", "rule", "given", "label", "url", "suffix", *FEATURES))
    drawn = rows.where("label is not null").select("url", "suffix", "label", *FEATURES).distinct().orderBy(F.xxhash64("url"), "url").limit(SAMPLE).drop("url").collect()
    trees, names = fit([(r["suffix"], r["label"], [float(r[c]) for c in FEATURES]) for r in drawn])
    probability = score(trees, {c: F.col(c) for c in names}, names)
    return rows.select(
        id_column, "host", "path", "rule",
        F.coalesce("given", F.when(probability >= 0.5, "block").otherwise("allow")).alias("verdict"),
        probability.alias("score"),
    )
