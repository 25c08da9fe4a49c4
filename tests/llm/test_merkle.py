import hashlib

import pytest
from pyspark.sql import functions as F

from panelyard.llm import merkle

SCHEMA = "replica int, record_id long, sha string, start long, stop long, node string"


def rows_of(replica, records):
    """records: (number, bytes) laid out one after the other"""
    out, at = [], 0
    for i, raw in records:
        out.append((replica, i, hashlib.sha256(raw).hexdigest(), at, at + len(raw), "x"))
        at += len(raw)
    return out


def brute(a, b):
    want = {}
    for i in {r[1] for r in a + b} - {None}:
        x, y = (sorted((r[3], r[4], r[2]) for r in rs if r[1] == i) for rs in (a, b))
        if x != y:
            same = sorted(r[2] for r in x) == sorted(r[2] for r in y)
            want[i] = "missing" if not y else "extra" if not x else "moved" if same else "changed"
    return want


@pytest.mark.parametrize("fanout", [2, 16])
def test_audit_against_brute_force(spark, fanout):
    good = [(i, b"record %d " % i * (i % 7 + 1)) for i in range(700) if i % 13]
    bad = [(i, raw[:-1] + b"!") if i in (5, 400) else (i, raw) for i, raw in good if i != 77]
    for a, b in ((good, good), (good, [(i, raw if i not in (3, 650) else b"X" + raw[1:]) for i, raw in good]), (good, bad), (good, [*good, (2000, b"new")]), ([(1, b"a"), (1, b"b")], [(1, b"b"), (1, b"a")]), (good[:1], good[:1]), ([(-3, b"n"), (4, b"p")], [(-3, b"n"), (4, b"q")])):
        a, b = rows_of(0, a), rows_of(1, b)
        got = {r.record_id: r.status for r in merkle.audit(spark.createDataFrame([*a, *b], SCHEMA), fanout).collect()}
        assert got == brute(a, b)


def test_only_differing_branches_and_roots(spark):
    a, b = (rows_of(k, [(i, b"r%d" % i) for i in range(300)]) for k in (0, 1))
    b[123] = (1, 123, "0" * 64, *b[123][3:])
    levels = merkle.build(spark.createDataFrame([*a, *b], SCHEMA), 4)
    assert [x.count() for x in levels] == [600, 150, 38, 10, 4, 2]
    for k, x in enumerate(levels):
        differ = x.groupBy("node").agg(F.countDistinct("digest").alias("n")).where("n > 1").collect()
        assert [r.node for r in differ] == [123 // 4**k]


def test_nulls_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.audit(empty).count() == 0
    one = spark.createDataFrame([(0, None, "a", 0, 1, ""), (0, 7, "b", 1, 2, "")], SCHEMA)
    assert [(r.record_id, r.status) for r in merkle.audit(one).collect()] == [(7, "missing")]


def test_offsets_and_text(spark):
    df = spark.createDataFrame([(0, None, "é"), (1, "http://x", None), (4096, "u", "z")], "record_id long, uri string, html string")
    t = df.select("record_id", merkle.warc_text(F.col("record_id"), F.col("uri"), F.col("html")).alias("t")).withColumn("sha", merkle.digest(F.col("t"))).withColumn("size", F.octet_length("t").cast("long"))
    rows = merkle.with_offsets(t).orderBy("record_id").collect()
    assert "Content-Length: 2\r\n\r\né\r\n\r\n" in rows[0].t and "Content-Length: 0\r\n\r\n\r\n\r\n" in rows[1].t
    assert rows[0].start == 0 and rows[1].start == len(rows[0].t.encode()) and rows[2].start == 0 and rows[2].archive == 1
