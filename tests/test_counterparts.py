"""Counterparts of stems among locations."""

from spanstrata.operators import matching


def test_counterparts_of_repeated_rows(spark):
    stems = spark.createDataFrame([("p", "abc_v1"), ("p", "abc_v1"), ("p", "xyz_v2"), ("p", "two_v0"), ("p", "dup_v0"), ("p", "dup_v0"), ("q", "Xy"), ("p", ""), ("p", None), (None, "xyz")], "packer string, stem string")
    places = spark.createDataFrame([("p", "abc_v1"), ("p", "in/XYZ/xyz.apk"), ("p", "two"), ("p", "a/two"), ("p", "dup"), ("q", "xyz"), ("q", None), ("q", "")], "packer string, location string")
    got = sorted(map(str, (tuple(r) for r in matching.find_counterparts(stems, places, 3).collect())))
    want = [("p", "abc_v1", "abc_v1")] * 2 + [("p", "xyz_v2", "in/XYZ/xyz.apk"), ("p", "two_v0", None), ("p", "dup_v0", None), ("p", "dup_v0", None), ("q", "Xy", "xyz"), ("p", "", None), ("p", None, None), (None, "xyz", None)]
    assert got == sorted(map(str, want))
