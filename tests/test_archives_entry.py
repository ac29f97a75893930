import io
import zipfile

import __spark_entry__ as entry
from spanstrata.sources import archives as A


def make_zip(items):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in items:
            z.writestr(n, b)
    return out.getvalue()


def test_members_nested_and_bad(spark):
    inner = make_zip([("classes.dex", b"dex\n")])
    good = make_zip([("a.txt", b"hello"), ("assets/in.zip", inner), ("z/", b""), ("last", b"x" * 50)])
    df = spark.createDataFrame([("g", "g.apk", bytearray(good)), ("b", "b.apk", bytearray(b"nope"))], "container string, container_path string, archive binary")
    members, errors = A.explode_members(df)
    got = [(r.object_id, r.object_path, r.depth) for r in members.orderBy("object_id").collect()]
    assert got == [("g:000000", "a.txt", 0), ("g:000001", "assets/in.zip", 0), ("g:000002", "assets/in.zip!classes.dex", 1), ("g:000003", "last", 0)]
    assert [r.container for r in errors.collect()] == ["b"]
    small, _ = A.explode_members(df, max_member_bytes=10)
    assert {r.object_path for r in small.collect()} == {"a.txt"}


def test_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "score" in df.columns
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 150
