"""Which of many needles a text contains, by one automaton over all needles."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of needles of so many bytes (as JSON) make one automaton; more make several, each a pass over the texts.
PART_BYTES = 4 << 20


class Matcher:
    """Needles with a value each; the automaton (some 40 bytes for each byte of the needles) is built once in a worker."""

    def __init__(self, needles: dict[str, object]):
        self.needles, self._automaton = needles, None

    def __getstate__(self):
        return {"needles": self.needles, "_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for needle, value in self.needles.items():
                self._automaton.add_word(needle, (needle, value))
            self._automaton.make_automaton()
        return self._automaton

    def found(self, text: str):
        """``(needle, value)`` of each needle that the text contains, once."""
        return dict(v for _, v in self.automaton.iter(text)).items() if self.needles else ()

    def places(self, text: str):
        """``(value, start)`` of every occurrence, overlapping ones too."""
        if self.needles:
            for end, (needle, value) in self.automaton.iter(text):
                yield value, end - len(needle) + 1


def _part(needles: DataFrame, texts: DataFrame, needle: str, text: str, keys: list[str]) -> DataFrame:
    """Matches of needles that are few enough for one automaton and for a broadcast."""
    owners: dict[str, set] = {}
    for r in needles.select(F.col(needle).alias("n"), F.xxhash64(F.lit(0), *keys).alias("k")).distinct().collect():  # at most about PART_BYTES
        owners.setdefault(r.n, set()).add(r.k)
    shared = texts.sparkSession.sparkContext.broadcast(Matcher(owners))
    columns = texts.columns

    def run(batches):
        matcher = shared.value
        for batch in batches:
            rows, hits = [], []
            for i, (x, key) in enumerate(zip(batch.column(text).to_pylist(), batch.column("_owner").to_pylist(), strict=True)):
                own = [n for n, k in matcher.found(x) if key in k] if x else []
                rows += [i] * len(own)
                hits += own
            found = batch.select(columns).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(hits, pa.string())], names=[*columns, "_needle"])

    schema = T.StructType([*texts.schema.fields, T.StructField("_needle", T.StringType())])
    hits = texts.withColumn("_owner", F.xxhash64(F.lit(0), *keys)).mapInArrow(run, schema)
    return hits.join(F.broadcast(needles.withColumn("_needle", F.col(needle))), [*keys, "_needle"]).drop("_needle")


def contains_join(needles: DataFrame, texts: DataFrame, needle: str, text: str, keys: Sequence[str] = (), part_bytes: int = PART_BYTES) -> DataFrame:
    """Pairs of equal ``keys`` where ``text`` contains ``needle``; the keys once, then both sides' other columns.

    Every text is read once for all needles of an automaton, whatever their number and length; a
    needle that occurs often makes no hot key, for its hits stay where the texts are and meet the
    needles' rows in a broadcast of checked size.  Needles of more than ``part_bytes`` are dealt
    into parts, and each part is a pass of its own.

    Null and empty needles match nothing, nor do null texts or null keys; rows that repeat match
    each; no rows give no rows.  The two sides must not share other column names.
    """
    keys = list(keys)
    own = needles.where(F.length(needle) > 0)
    held = own.agg(F.sum(F.length(F.to_json(F.struct(*own.columns))).cast("long"))).first()[0] or 0
    parts = max(1, -(-held // part_bytes))
    found = None
    for p in range(parts):
        some = own if parts == 1 else own.where(F.pmod(F.xxhash64(needle), F.lit(parts)) == p)
        one = _part(some, texts, needle, text, keys)
        found = one if found is None else found.union(one)
    return found
