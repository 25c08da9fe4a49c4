"""The walks over nested types, against plain code."""

from pyspark.sql import functions as F

from panelyard.operators import nested

KIND = "struct<a: string, n: int, rule_id: string, list: array<struct<id: string, v: int, tags: array<string>>>, m: map<string, struct<x: string, rule_id: string>>, plain: array<int>>"


def test_rewrite_at_any_depth(spark):
    v = {"a": "one", "n": 1, "rule_id": "r", "list": [{"id": "k", "v": 2, "tags": ["t", None]}, None], "m": {"key": {"x": "y", "rule_id": "r"}}, "plain": [1]}
    df = spark.createDataFrame([(v,), (None,)], f"v {KIND}")
    out = df.select(nested.rewritten(F.col("v"), df.schema["v"].dataType, lambda c: F.upper(c), {"rule_id"}).alias("v"))
    assert "rule_id" not in out.schema.simpleString()
    got = [r.v.asDict(True) if r.v else None for r in out.collect()]
    assert got == [{"a": "ONE", "n": 1, "list": [{"id": "K", "v": 2, "tags": ["T", None]}, None], "m": {"key": {"x": "Y"}}, "plain": [1]}, None]


def test_differences_by_path(spark):
    seed = {"a": "one", "n": None, "rule_id": "r", "list": [{"id": "k", "v": 2, "tags": ["t"]}, {"id": "gone", "v": 1, "tags": []}], "m": {"x": {"x": "1", "rule_id": None}, "y": None}, "plain": [1, 2]}
    draft = {"a": "two", "n": 5, "rule_id": None, "list": [{"id": "new", "v": 0, "tags": []}, {"id": "k", "v": 3, "tags": ["t", "u"]}], "m": {"x": {"x": "2", "rule_id": None}, "z": None}, "plain": [2, 1]}
    df = spark.createDataFrame([(1, seed, draft), (2, seed, seed), (3, None, None), (4, seed, None), (5, None, draft)], f"i int, s {KIND}, d {KIND}")
    out = df.select("i", nested.differences(F.col("s"), F.col("d"), df.schema["s"].dataType, "", {"id"}).alias("x"))
    got = {r.i: {(z.path, z.code) for z in r.x} for r in out.collect()}
    assert got[1] == {
        ("a", "changed"), ("n", "unexpected"), ("rule_id", "missing"), ("list[k].v", "changed"), ("list[k].tags", "changed"), ("list[gone]", "removed"), ("list[new]", "added"),
        ("m[x].x", "changed"), ("m[y]", "removed"), ("m[z]", "added"), ("plain", "changed"),
    }
    assert got[2] == got[3] == set() and got[4] == {("", "missing")} and got[5] == {("", "unexpected")}
