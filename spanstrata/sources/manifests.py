"""Large JSON manifests: their records one by one, without the document in one piece."""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Members of an object that hold its records.
LISTS = ("records", "apks")
ROWS, CHARS = 1024, 4 << 20  # records, and their characters, that a worker returns at once

_INSIDE = re.compile(r'(?:[^"\\]|\\.)*', re.S)  # the rest of a string
_MARK = re.compile(r'["{}\[\]]')
_COLON = re.compile(r"\s*:\s*")


class Splitter:
    """Reads a document piece by piece and returns the texts of its records as they end.

    Only the record at hand is kept.  Records are the objects of a top-level list, those of a
    list that is a member of LISTS of a top-level object, or else top-level objects themselves.
    A piece must end outside of an escape sequence.
    """

    def __init__(self):
        self.depth, self.base, self.string = 0, None, False
        self.held: list[str] | None = None  # the record so far
        self.name, self.after = "", None  # the last string of a top-level object, and what followed it

    @property
    def level(self) -> int:
        """Depth at which records begin."""
        return 0 if self.base is None else self.base

    def feed(self, piece: str) -> list[str]:
        out, at, start = [], 0, 0
        while at < len(piece):
            if self.string:
                end = _INSIDE.match(piece, at).end()
                if self.depth == 1 and len(self.name) < 64:
                    self.name += piece[at:end]
                at = end + 1
                if end < len(piece):
                    self.string, self.after = False, ""
                continue
            mark = _MARK.search(piece, at)
            end = mark.start() if mark else len(piece)
            if self.depth == 1 and self.after is not None and len(self.after) < 64:
                self.after += piece[at:end]
            at = end + 1
            if not mark:
                break
            c = mark.group()
            if c == '"':
                self.string = True
                if self.depth == 1:
                    self.name, self.after = "", None
            elif c in "{[":
                opens = self.depth == self.level
                if c == "[" and self.depth == 0 and self.base is None:
                    self.base = 1
                elif c == "[" and self.depth == 1 and self.base is None and self.name in LISTS and _COLON.fullmatch(self.after or ""):
                    self.base, self.held = 2, None  # the object is no record, it holds them
                elif c == "{" and opens and self.held is None:
                    self.held, start = [], end
                self.depth += 1
            elif self.depth:
                self.depth -= 1
                if c == "}" and self.held is not None and self.depth == self.level:
                    out.append("".join(self.held) + piece[start:at])
                    self.held = None
                elif self.base == 2 and self.depth == 1:
                    self.base = -1  # the first such list counts; the object's other members hold no records
                if self.depth == 0:
                    self.base = None
        if self.held is not None:
            self.held.append(piece[start:])
        return out


def split_manifests(spark: SparkSession, path: str) -> DataFrame:
    """``file, value``: the text of each record of the JSON documents at ``path``.

    Spark's text source cuts the files at closing braces, in blocks of any size, whatever the
    line ends; the pieces of a file come together in order in one task, which keeps one record at
    a time.  A document is a list, an object with a list under one of LISTS, or objects one
    after the other (JSON Lines).  Other values than objects are no records; a document that
    ends within a record loses that record; empty files have none.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value"
    )
    ordered = pieces.repartition("file").sortWithinPartitions("file", "block", "n").select("file", "value")

    def run(batches):
        now, splitter, files, values, size = None, None, [], [], 0
        for batch in batches:
            for file, piece in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if file != now:
                    now, splitter = file, Splitter()
                for record in splitter.feed(piece + "}"):
                    files.append(file)
                    values.append(record)
                    size += len(record)
                if len(values) >= ROWS or size > CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(values)], names=["file", "value"])
                    files, values, size = [], [], 0
        if values:
            yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(values)], names=["file", "value"])

    return ordered.mapInArrow(run, "file string, value string")


def read_manifest(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """The records of manifests of any size, see ``split_manifests``; fields that do not fit are null."""
    return split_manifests(spark, path).select(F.from_json("value", record).alias("r")).select("r.*")
