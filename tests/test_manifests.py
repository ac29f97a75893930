"""Records of JSON manifests of all shapes, read in pieces."""

import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import types as T

from spanstrata.sources.manifests import Splitter, read_manifest, split_manifests

RECORD = "id BIGINT, text STRING, deep STRUCT<a: ARRAY<STRUCT<b: STRING>>>"


def records(n=60):
    rng = random.Random(1)
    odd = ['}', '{', '"', "\\", '\\"', "],[", "\n", "é", "records", '":[{']
    return [{"id": i, "text": "".join(rng.choices(odd, k=rng.randint(0, 9))), "deep": {"a": [{"b": "}" * (i % 3)}, {}]}} for i in range(n)]


def shapes(rows):
    return {
        "list": json.dumps(rows), "spaced": "\n " + json.dumps(rows, indent=2) + "\n", "records": json.dumps({"meta": {"x": [{"y": {"z": {}}}]}, "records": rows, "after": {"a": {"b": {"c": 1}}}, "apks": [{"id": -1}]}),
        "apks": json.dumps({"n": 1, "apks": rows}), "lines": "\n".join(map(json.dumps, rows)) + "\n", "one": json.dumps(rows[0]), "none": "[]", "empty": "", "numbers": "[1, null, [2]]", "cut": json.dumps(rows)[:-40],
    }


@pytest.mark.parametrize("step", [1, 7, 10**6])
def test_splitter(step):
    rows = records()
    want = {"one": rows[:1], "none": [], "empty": [], "numbers": [], "cut": rows[:-1]}
    for name, text in shapes(rows).items():
        pieces, splitter = [], Splitter()
        for part in [p + "}" for p in text.split("}")]:  # as the reader cuts them
            pieces += [part] if step > 1 else [part[:-1], "}"] if part[:-1] and not part[:-1].endswith("\\") else [part]
        got = [json.loads(r) for p in pieces for r in splitter.feed(p)]
        assert got == want.get(name, rows), name


def test_read_manifest(spark, tmp_path):
    """Many files and many blocks of a file, which Spark's splits cut at any place."""
    rows = records(300)
    for name, text in shapes(rows).items():
        (tmp_path / f"{name}.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for name in ("list", "spaced", "records", "apks", "lines"):
            got = read_manifest(spark, str(tmp_path / f"{name}.json"), T.StructType.fromDDL(RECORD))
            assert sorted((r.id, r.text) for r in got.collect()) == [(r["id"], r["text"]) for r in rows], name
        counts = {os.path.basename(r.file): r["count"] for r in split_manifests(spark, str(tmp_path)).groupBy("file").count().collect()}
        assert counts == {"list.json": 300, "spaced.json": 300, "records.json": 300, "apks.json": 300, "lines.json": 300, "one.json": 1, "cut.json": 299}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_memory_of_a_long_line():
    """60 MB in one line take the memory of a record, not of the document."""
    code = """
import json, resource
from spanstrata.sources.manifests import Splitter
s, n, one = Splitter(), 0, json.dumps({"id": 1, "text": "x{}" * 2000})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
pieces = [p + "}" for p in (one + ",").split("}")][:-1]
s.feed('{"records": [')
for _ in range(10_000):
    for p in pieces:
        n += len(s.feed(p))
    s.feed(",")
assert n == 10_000
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 30_000
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=300)
