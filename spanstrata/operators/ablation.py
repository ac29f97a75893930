"""Ablation of feature groups: the models of every set of columns and every fold are fitted together."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import sigmoid
from . import metrics as M
from .ordering import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

RIDGE = 1.0  # penalty of the standardised weights
ROUNDS = 30  # Newton steps
TOLERANCE = 1e-9  # gain of the mean loss under which a model is done
BLOCK = 1024  # rows that a task handles at once


def group_sets(groups: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """All columns, each group alone, and all but one group."""
    sets = {"all": [c for cols in groups.values() for c in cols]}
    if len(groups) > 1:
        sets |= {f"only_{g}": list(cols) for g, cols in groups.items()}
        sets |= {f"without_{g}": [c for other, cols in groups.items() if other != g for c in cols] for g in groups}
    return sets


class _Fold:
    """What a fold's models need to know of its training rows: scales of the features and weights of the classes."""

    def __init__(self, cells: Sequence, held_out, width: int, balanced: bool = True):
        train = [c for c in cells if c["test_fold"] is None or c["test_fold"] != held_out]
        rows = [sum(c["n"] for c in train if c["y"] == y) for y in (0, 1)]
        self.one_class = not all(rows)
        if self.one_class and (balanced or not any(rows)):
            raise ValueError(f"training needs both classes where {held_out!r} is held out")
        self.positive = rows[1] > 0
        self.weight = np.array([sum(rows) / (2.0 * n) for n in rows]) if balanced else np.ones(2)
        n = np.array([[c[f"n{i}"] or 0 for i in range(width)] for c in train], dtype=float)
        mean = np.array([[c[f"m{i}"] or 0.0 for i in range(width)] for c in train])
        within = np.array([[c[f"v{i}"] or 0.0 for i in range(width)] for c in train])
        total = np.maximum(n.sum(axis=0), 1)
        self.mean = (n * mean).sum(axis=0) / total
        spread = (n * (within + (mean - self.mean) ** 2)).sum(axis=0) / total
        self.scale = np.where(spread > 1e-18, np.sqrt(spread), 1.0)
        self.rows = sum(rows)


def _sums(data: DataFrame, weights: list[np.ndarray], models: list[tuple[int, np.ndarray]], folds: list, scales: list[_Fold]) -> list[np.ndarray]:
    """Loss, gradient and curvature of every model at its weights, in one pass over the rows.

    A task sends one row for each model; only sums over all tasks come back, whose number
    depends on the models alone.  Features lie across a block's rows, so a model's columns are
    whole runs of memory; a held-out row weighs nothing.
    """

    def run(batches):
        out = [np.zeros(1 + len(w) + len(w) ** 2) for w in weights]
        for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
            x = np.ascontiguousarray(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).T)
            t, times = batch.column("y").to_numpy(), batch.column("times").to_numpy()
            own = batch.column("test_fold")
            own = pc.index_in(own, value_set=pa.array(folds, own.type)).fill_null(-1).to_numpy()
            whole = np.isfinite(x).all()
            z = np.ones((len(x) + 1, batch.num_rows))
            for k, s in enumerate(scales):
                mine = [at for at, (fold, _) in enumerate(models) if fold == k]
                if not mine:
                    continue
                np.subtract(x, s.mean[:, None], out=z[1:])
                z[1:] /= s.scale[:, None]
                if not whole:
                    np.nan_to_num(z, copy=False)  # an absent value stands at the mean
                c = s.weight[t] * times * (own != k)
                for at in mine:
                    part = z[models[at][1]]
                    u = np.clip(weights[at] @ part, -500, 500)
                    e = np.exp(-np.abs(u))
                    p = np.where(u >= 0, 1.0, e) / (1 + e)
                    d, sums = len(part), out[at]
                    sums[0] += c @ (np.maximum(u, 0) + np.log1p(e) - t * u)
                    sums[1 : 1 + d] += part @ (c * (p - t))
                    part *= np.sqrt(c * p * (1 - p))
                    sums[1 + d :] += (part @ part.T).ravel()
        yield pa.RecordBatch.from_pydict({"model": pa.array(range(len(out)), pa.int32()), "sums": pa.array([o.tobytes() for o in out], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer()) for v in table.column("sums"))
        return pa.table({"model": table.column("model")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    sums = {r["model"]: np.frombuffer(r["sums"]) for r in data.mapInArrow(run, "model int, sums binary").groupBy("model").applyInArrow(add, "model int, sums binary").collect()}
    return [sums[at] if at in sums else np.zeros(1 + len(w) + len(w) ** 2) for at, w in enumerate(weights)]


def fit_sets(assigned: DataFrame, sets: Mapping[str, Sequence[str]], label: str, ridge: float = RIDGE, rounds: int = ROUNDS, balanced: bool = True, times: str | None = None) -> DataFrame:
    """``features, held_out, bias, mean, coef``: logistic regressions of every set of columns and every fold.

    ``assigned`` comes from ``sampling.leave_one_out``: a fold trains on all rows that are not
    ``benign_test`` and not of the held-out group.  All models take their Newton steps together,
    one pass over the rows for a step; a step that raises a model's loss is halved.  Scales and
    class weights are those of a fold's own training rows, from one aggregation over
    (group, class).  ``mean`` and ``coef`` cover ``sets``' columns in sorted order, 0 outside a set.
    Null and NaN features count as the mean.  No rows give no models; a fold without both classes raises.
    ``balanced=False``: all rows weigh the same, and a model of one class is sure of it.
    ``times`` names a column that says how many equal rows a row stands for.
    """
    columns = sorted({c for cols in sets.values() for c in cols})
    x = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]
    many = F.lit(1.0) if times is None else F.col(times).cast("double")
    data = materialize(assigned.where("kind != 'benign_test'").select("test_fold", F.col(label).cast("int").alias("y"), many.alias("times"), F.array(*x).alias("x")))
    if times is None:
        parts = [f(F.col("x")[i]).alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]
    else:  # sums of shifted values, which do not cancel
        shift = data.select([F.coalesce(F.avg(F.col("x")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(len(columns))]).first()
        parts = []
        for i in range(len(columns)):
            away = F.col("x")[i] - shift[i]
            n, one, two = F.sum(F.when(away.isNotNull(), F.col("times"))), F.sum(away * F.col("times")), F.sum(away * away * F.col("times"))
            parts += [n.alias(f"n{i}"), (one / n + shift[i]).alias(f"m{i}"), F.greatest(two / n - (one / n) * (one / n), F.lit(0.0)).alias(f"v{i}")]
    cells = data.groupBy("test_fold", "y").agg(F.sum("times").alias("n"), *parts).collect()  # a row for each group
    folds = sorted({c["test_fold"] for c in cells if c["test_fold"] is not None})
    scales = [_Fold(cells, f, len(columns), balanced) for f in folds]
    names, models = [], []
    for name, cols in sets.items():
        for k in range(len(folds)):
            names.append((name, k))
            models.append((k, np.array([0, *(columns.index(c) + 1 for c in sorted(set(cols)))])))
    best = [np.zeros(len(cols)) for _, cols in models]
    trial, least, done = list(best), [np.inf] * len(models), [scales[k].one_class for k, _ in models]
    for at, (k, _) in enumerate(models):
        if done[at]:
            best[at][0] = np.inf if scales[k].positive else -np.inf
    for _ in range(rounds if models else 0):
        going = [at for at, d in enumerate(done) if not d]
        if not going:
            break
        for at, s in zip(going, _sums(data, [trial[at] for at in going], [models[at] for at in going], folds, scales), strict=True):
            w = trial[at]
            d, rest = len(w), np.r_[0.0, np.full(len(w) - 1, ridge)]  # the bias is free
            loss = s[0] + (rest * w * w).sum() / 2
            if loss > least[at]:
                trial[at] = (w + best[at]) / 2
                done[at] = np.abs(trial[at] - best[at]).max() < TOLERANCE
                continue
            done[at] = least[at] - loss < TOLERANCE * scales[models[at][0]].rows
            best[at], least[at] = w, loss
            step = np.linalg.lstsq(s[1 + d :].reshape(d, d) + np.diag(rest), s[1 : 1 + d] + rest * w, rcond=None)[0]
            trial[at] = w - step
    rows = []
    for (name, k), (_, cols), w in zip(names, models, best, strict=True):
        coef = np.zeros(len(columns))
        coef[cols[1:] - 1] = w[1:] / scales[k].scale[cols[1:] - 1]
        rows.append((name, folds[k], float(w[0]), scales[k].mean.tolist(), coef.tolist()))
    held = T.StructField("held_out", assigned.schema["test_fold"].dataType)
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField("features", T.StringType()), held, T.StructField("bias", T.DoubleType()), T.StructField("mean", numbers), T.StructField("coef", numbers)])
    return assigned.sparkSession.createDataFrame(rows, schema)


def _logits(assigned: DataFrame, models: DataFrame, sets: Mapping[str, Sequence[str]], keep: Sequence[str]) -> tuple[DataFrame, list]:
    """``kind, test_fold, *keep, _u`` of the test rows and the models' (features, held_out): ``_u`` holds a logit for each model.

    Columns are added one after the other, so equal rows have equal logits wherever they are.
    """
    columns = sorted({c for cols in sets.values() for c in cols})
    fitted = sorted(models.collect(), key=lambda m: (m["features"], m["held_out"]))  # a row for each set and fold
    bias = np.array([m["bias"] for m in fitted])
    mean, coef = (np.array([m[c] for m in fitted]).reshape(len(fitted), len(columns)) for c in ("mean", "coef"))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def kernel(values: pa.Array) -> pa.Array:
        flat = []
        for at in range(0, len(values), BLOCK):
            part = values.slice(at, BLOCK)
            x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            u = np.zeros((len(part), len(bias)))
            for i in range(x.shape[1]):
                away = x[:, i, None] - mean[:, i]
                u += np.where(np.isnan(away), 0.0, away) * coef[:, i]
            flat.append((bias + u).ravel())
        offsets = np.arange(len(values) + 1, dtype=np.int32) * len(bias)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0), *flat])))

    values = F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns])
    test = assigned.where("kind IN ('positive', 'benign_test')")
    rows = test.select(F.col("kind").alias("_kind"), F.col("test_fold").alias("_fold"), *keep, kernel(values).alias("_u"))
    return rows, [(m["features"], m["held_out"]) for m in fitted]


def _named(model: Column, names: list, kind: T.DataType) -> list[Column]:
    """``features`` and ``held_out`` of a model's number."""
    features = F.array(*[F.lit(f) for f, _ in names]).cast("array<string>")
    held = F.array(*[F.lit(h) for _, h in names]).cast(T.ArrayType(kind))
    return [F.get(features, model).alias("features"), F.get(held, model).alias("held_out")]


def held_out_scores(assigned: DataFrame, models: DataFrame, sets: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """``features, held_out, *keep, score``: each test row by the models that have not seen its group.

    A positive row meets the models of its own fold, a ``benign_test`` row those of all folds.
    """
    rows, names = _logits(assigned, models, sets, keep)
    each = rows.select("_kind", "_fold", *keep, F.posexplode("_u").alias("_model", "_logit"))
    each = each.select("_kind", "_fold", *_named(F.col("_model"), names, assigned.schema["test_fold"].dataType), *keep, sigmoid(F.col("_logit")).alias("score"))
    return each.where("_kind = 'benign_test' OR _fold = held_out").drop("_kind", "_fold")


def level_report(assigned: DataFrame, models: DataFrame, sets: Mapping[str, Sequence[str]], label: str, levels: Mapping[str, Sequence[str]], threshold: float = 0.5) -> DataFrame:
    """Confusion counts, rates, AUROC and average precision for each set of columns, fold and level.

    ``levels`` names the columns that make up an item of a level; an item has the highest score
    and the highest truth of its rows in a fold.  An item is one row with the scores of all models
    until scores are counted; everything else follows from the counts.
    """
    ids = list(dict.fromkeys(c for cols in levels.values() for c in cols))
    rows, names = _logits(assigned, models, sets, [*ids, label])
    rows = materialize(rows)
    folds = sorted({h for _, h in names})
    kind = assigned.schema["test_fold"].dataType
    fold_of = [folds.index(h) for _, h in names]
    if names:  # texts, for hundreds of expressions: built one by one they take longer than small jobs
        best = [f"max(CASE WHEN _in{k} THEN _u[{i}] END) AS _u{i}" for i, k in enumerate(fold_of)]
        truth = [f"CAST(max(CASE WHEN _in{k} THEN _y END) AS INT) AS _t{k}" for k in range(len(folds))]
        cells = ", ".join(f"struct({i} AS m, _u{i} AS u, _t{k} AS t)" for i, k in enumerate(fold_of))
    else:
        best, truth, cells = ["0 AS _u"], [], "struct(0 AS m, CAST(null AS DOUBLE) AS u, CAST(null AS INT) AS t)"
    inside = {f"_in{k}": (F.col("_kind") == "benign_test") | (F.col("_fold") == F.lit(f).cast(kind)) for k, f in enumerate(folds)}
    marked = rows.withColumns({"_y": F.col(label), **inside})
    counts = None
    for at, cols in enumerate(levels.values()):
        items = marked.groupBy(*cols).agg(*[F.expr(e) for e in best + truth])
        each = items.select(F.expr(f"inline(array({cells}))")).where("t IS NOT NULL")
        one = each.groupBy("m", sigmoid(F.col("u")).alias("score")).agg(F.count_if(F.col("t") == 1).alias("pos"), F.count_if(F.col("t") != 1).alias("neg"))
        one = one.select((F.col("m") * len(levels) + at).alias("_cell"), "score", "pos", "neg")
        counts = one if counts is None else counts.unionByName(one)
    counts = materialize(counts)
    hit = F.col("score") >= threshold
    total = lambda c, here=F.lit(True): F.coalesce(F.sum(F.when(here, c)), F.lit(0))
    pos, neg = F.col("pos"), F.col("neg")
    report = counts.groupBy("_cell").agg(
        total(pos + neg).alias("support"), total(pos).alias("positives"), total(pos + neg, hit).alias("predicted_positives"),
        total(pos, hit).alias("true_positives"), total(neg, hit).alias("false_positives"), total(pos, ~hit).alias("false_negatives"), total(neg, ~hit).alias("true_negatives"),
    )
    report = report.withColumns(M.confusion_columns(*[F.col(c) for c in ("true_positives", "false_positives", "false_negatives", "true_negatives")]))
    report = report.join(M.quality_of_counts(counts, ["_cell"]).drop("positives", "negatives"), "_cell", "left")
    level = F.get(F.array(*[F.lit(n) for n in levels]), (F.col("_cell") % len(levels)).cast("int")).alias("level")
    return report.select(*_named(F.floor(F.col("_cell") / len(levels)).cast("int"), names, kind), level, *[c for c in report.columns if c != "_cell"])


def group_ablation(assigned: DataFrame, groups: Mapping[str, Sequence[str]], label: str, levels: Mapping[str, Sequence[str]], threshold: float = 0.5) -> DataFrame:
    """The report of ``level_report`` for ``group_sets`` of columns under leave-one-group-out folds."""
    sets = group_sets(groups)
    assigned = materialize(assigned)
    return level_report(assigned, fit_sets(assigned, sets, label), sets, label, levels, threshold)
