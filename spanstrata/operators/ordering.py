"""Running aggregates and positions that do not put a whole group in one task.

A plain ``Window.partitionBy(key)`` sorts every row of a key in one task.  ``prefix_sums``
spreads rows over ranges of (key, order); what each range adds to the next one is a row for
each partition.  ``running`` spreads them over (key, bucket), where the bucket is a monotone
function of the order value; bucket totals supply the part contributed by earlier buckets.
Results, and the places of nulls, equal the single-window form.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_BUCKETS = 256  # bounds the size of the generated condition


def work_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spanstrata-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A path below the work folder that nothing else uses."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Evaluate once and cut the lineage, in the reliable folder ``spark.checkpoint.dir``.

    Used where a derived relation feeds several branches: without it every
    branch, and every level of a chain of such steps, would repeat the scan.
    """
    work_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Written once as a table below the work folder; unlike after ``materialize``, Spark's size check knows its size and may send a small one to all tasks."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_bucket(df: DataFrame, value: Column, buckets: int | None = None, descending: bool = False) -> Column:
    """Monotone bucket number of a numeric value between split points at its approximate quantiles.

    The split points follow the values' distribution, so an outlier or a skewed range leaves
    the buckets even; equal values share a bucket.  There are as many buckets as shuffle
    partitions (at most MOST_BUCKETS).  Nulls have a null bucket, which comes first; when
    descending they have the last one.
    """
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2, min(buckets, MOST_BUCKETS))
    number = value.cast("double")
    shares = [i / buckets for i in range(1, buckets)]
    found = df.select(number.alias("v")).stat.approxQuantile("v", shares, 0.25 / buckets)
    splits = sorted(set(found))

    def place(lo: int, hi: int) -> Column:
        """Binary search among ``splits[lo:hi]`` as nested conditions."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(number < splits[mid], place(lo, mid)).otherwise(place(mid + 1, hi))

    at = F.when(number.isNotNull(), place(0, len(splits)))
    return F.coalesce(F.lit(len(splits)) - at, F.lit(len(splits) + 1)) if descending else at


def hash_bucket(hex_digest: Column) -> Column:
    """Bucket of a hex digest by its first three digits (order preserving)."""
    return F.conv(F.substring(hex_digest, 1, 3), 16, 10).cast("int")


def prefix_bucket(text: Column) -> Column:
    """Order-preserving bucket of a string from its first two bytes."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 2)), 4, "0"), 16, 10).cast("int")


_FUNCS = {"sum": F.sum, "max": F.max}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    aggs: Mapping[str, tuple[str, Column, bool]],
    bucket: Column | None = None,
) -> DataFrame:
    """Add running aggregates: ``name -> (sum|max, value, include_current_row)``.

    ``bucket`` must be monotone in ``order``; rows equal in ``order`` must share
    a bucket.  Without it one window per key is used, which is right only for
    keys of bounded size (for instance the windows of one object).
    """
    last = {True: Window.currentRow, False: -1}
    if bucket is None:
        spec = Window.partitionBy(*keys).orderBy(*order)
        cols = {
            n: _FUNCS[f](v).over(spec.rowsBetween(Window.unboundedPreceding, last[inc]))
            for n, (f, v, inc) in aggs.items()
        }
        return df.withColumns(
            {n: F.coalesce(c, F.lit(0)) if aggs[n][0] == "sum" else c for n, c in cols.items()}
        )
    work = materialize(df.withColumn("_bucket", bucket))
    spec = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = work.withColumns(
        {
            f"_l_{n}": _FUNCS[f](v).over(spec.rowsBetween(Window.unboundedPreceding, last[inc]))
            for n, (f, v, inc) in aggs.items()
        }
    )
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = work.groupBy(*keys, "_bucket").agg(*[_FUNCS[f](v).alias(f"_t_{n}") for n, (f, v, _) in aggs.items()])
    before = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_b"),
        *[_FUNCS[f](f"_t_{n}").over(across).alias(f"_p_{n}") for n, (f, _, _) in aggs.items()],
    )
    cond = F.col("_bucket") == F.col("_b")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(before, cond, "left")
    out = {}
    for n, (f, _, _) in aggs.items():
        a, b = F.col(f"_l_{n}"), F.col(f"_p_{n}")
        zero = F.lit(0)
        out[n] = F.coalesce(a, zero) + F.coalesce(b, zero) if f == "sum" else F.greatest(a, b)
    return joined.withColumns(out).select(*df.columns, *aggs.keys())


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Rows whose key differs from that of the row before; nulls are equal, as are NaNs."""
    n = batch.num_rows
    out = np.zeros(max(0, n - 1), bool)
    for c in map(batch.column, keys):
        nan = pc.fill_null(pc.is_nan(c), False).to_numpy(zero_copy_only=False) if pa.types.is_floating(c.type) else np.zeros(n, bool)
        null = c.is_null().to_numpy(zero_copy_only=False)
        differ = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        out |= (differ & ~(nan[1:] & nan[:-1])) | (null[1:] != null[:-1])
    return out


def _same(a: list, b: list) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


def _segments(batch: pa.RecordBatch, keys: list[str]) -> list[tuple[int, int]]:
    """Runs of equal keys in a batch."""
    starts = [0, *(np.flatnonzero(_changes(batch, keys)) + 1).tolist()]
    return list(zip(starts, [*starts[1:], batch.num_rows], strict=True))


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, tuple[Column, bool]],
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add running sums ``name -> (value, include_current_row)`` along ``order`` within ``keys``.

    Rows are dealt by ranges of (keys, order) into as many tasks as Spark finds fit, so one group
    spreads over all of them.  The ranges come from a sample, so both passes over them must see
    the same ones: they are written once (``materialize``).  The first pass returns a row for each
    partition, its first and last key and what its last key sums up to; these rows alone reach the
    driver.  The second one adds up within partitions and starts with what earlier ones carry over.
    Partitions are known by their number in the written table (``spark_partition_id``); a task's own
    number differs from it where the result is part of a union.

    Values are integers or doubles, nulls add nothing; nulls in ``order`` stand where Spark's sort
    puts them.  Keys may be null; rows that tie are summed in any order.  ``totals`` adds columns
    ``name -> sum's name`` with a group's whole sum.  No rows give no rows.
    """
    keys, names = list(keys), list(sums)
    columns = df.columns
    held = [f"_value_{i}" for i in range(len(names))]
    kinds = dict(df.select(*[v.alias(h) for h, (v, _) in zip(held, sums.values(), strict=True)]).dtypes)
    real = [kinds[h] in ("double", "float") for h in held]
    if odd := [kinds[h] for h in held if kinds[h] not in ("double", "float", "tinyint", "smallint", "int", "bigint")]:
        raise TypeError(f"running sums need integers or doubles, not {odd[0]}")
    work = df.withColumns({h: F.coalesce(v.cast("double" if r else "bigint"), F.lit(0)) for h, r, (v, _) in zip(held, real, sums.values(), strict=True)})
    ranged = materialize(work.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order))

    number = F.spark_partition_id().alias("_range_part")

    def ends(batches):
        first = last = None
        carried, single = [0] * len(held), True
        for batch in batches:
            if not batch.num_rows:
                continue
            segments = _segments(batch, keys)
            values = [batch.column(h).to_numpy() for h in held]
            start = [batch.column(k)[0].as_py() for k in keys]
            if first is None:
                first = last = start
                opening, part = batch.select(keys).slice(0, 1), batch.column("_range_part")[0].as_py()
            if len(segments) > 1 or not _same(start, last):
                carried, single = [0] * len(held), False
            lo, hi = segments[-1]
            carried = [c + v[lo:hi].sum() for c, v in zip(carried, values, strict=True)]
            last = [batch.column(k)[lo].as_py() for k in keys]
            closing = batch.select(keys).slice(lo, 1)
        if first is not None:
            arrays = [pa.array([part], pa.int64()), *opening.columns, *closing.columns, *[pa.array([c], pa.float64() if r else pa.int64()) for c, r in zip(carried, real, strict=True)], pa.array([single])]
            yield pa.RecordBatch.from_arrays(arrays, names=end_schema.names)

    kept = {f.name: f for f in ranged.schema.fields}
    end_schema = T.StructType([
        T.StructField("part", T.LongType()), *[T.StructField(f"_{e}_{i}", kept[k].dataType) for e in ("first", "last") for i, k in enumerate(keys)],
        *[kept[h] for h in held], T.StructField("single", T.BooleanType()),
    ])
    offsets, before, carried = {}, None, None
    for r in sorted(ranged.select(*keys, *held, number).mapInArrow(ends, end_schema).collect(), key=lambda r: r.part):
        first, last, own = list(r[1 : 1 + len(keys)]), list(r[1 + len(keys) : 1 + 2 * len(keys)]), list(r[1 + 2 * len(keys) : -1])
        offsets[r.part] = carried if before is not None and _same(first, before) else [0] * len(held)
        before, carried = last, [a + b for a, b in zip(own, offsets[r.part], strict=True)] if r.single else own

    inclusive = [inc for _, inc in sums.values()]

    def add_up(batches):
        carry = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            changed = _changes(batch, keys)
            start = [batch.column(k)[0].as_py() for k in keys]
            if last is None:
                carry = offsets.get(batch.column("_range_part")[0].as_py(), [0] * len(held))
            elif not _same(start, last):
                carry = [0] * len(held)
            opens = np.concatenate([[0], np.flatnonzero(changed) + 1])
            segment = np.concatenate([[0], np.cumsum(changed)])
            out, next_carry = [], []
            for h, c, inc in zip(held, carry, inclusive, strict=True):
                value = batch.column(h).to_numpy()
                run = np.cumsum(value)
                base = run[opens - 1]
                base[0] = -c  # the first run goes on from the batch before
                total = run - base[segment]
                next_carry.append(total[-1])
                out.append(pa.array(total if inc else total - value))
            carry, last = next_carry, [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *out], names=[*columns, *names])

    added = [T.StructField(n, T.DoubleType() if r else T.LongType()) for n, r in zip(names, real, strict=True)]
    done = ranged.select("*", number).mapInArrow(add_up, T.StructType([*[kept[c] for c in columns], *added]))
    if totals:
        at = {n: h for n, h in zip(names, held, strict=True)}
        whole = ranged.groupBy(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]).agg(*[F.sum(at[n]).alias(t) for t, n in totals.items()])
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
        done = done.join(whole, same).select(*columns, *names, *totals)
    return done


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column | None = None,
    name: str = "pos",
) -> DataFrame:
    """1-based position of each row in its group, whatever the group's size; rows spread by ranges, or by ``bucket``."""
    if bucket is None:
        return prefix_sums(df, keys, order, {name: (F.lit(1), True)})
    return running(df, keys, order, {name: ("sum", F.lit(1), True)}, bucket)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per group.  Spark cuts each task to ``n`` rows before the shuffle."""
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(spec)).where(F.col(name) <= n)
