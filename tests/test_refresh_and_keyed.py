"""Incremental refresh by parts, and the keyed table that streams bring up to date."""

import os
import re

import pytest
from pyspark.sql import functions as F

from panelyard.operators import incremental, refresh
from panelyard.streaming import keyed

SUMS = lambda rows: rows.groupBy("k").agg(F.sum("v").alias("total"))


def rows_of(spark, values):
    return spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v long")


def candidates(rows, names):
    named = rows.sparkSession.createDataFrame(list(names.items()), "k string, name string")
    hashed = refresh.content_hash(rows, "k", ["v"]).join(named, "k")
    return incremental.with_fingerprints(hashed, ["name", "content"], ["name"], "v1").select("k", "name", "full_hash", "analysis_hash")


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


@pytest.fixture()
def begun(spark, tmp_path):
    day1 = {f"p{i}": [i, 2 * i] for i in range(40)}
    at = refresh.Refresh(*(str(tmp_path / x) for x in ("in", "out", "state")), key="k", parts=16)
    refresh.write_parts(rows_of(spark, day1), at.inputs, "k", at.parts)
    at.first(candidates(rows_of(spark, day1), {k: k for k in day1}), SUMS)
    return at, day1


def test_merged_result_is_a_full_run(spark, begun):
    at, day1 = begun
    day2 = dict(day1) | {"p3": [100], "new": [7, 8], "p5": [10, 5]}  # p5: the same rows in another order
    del day2["p9"]
    names = {k: k for k in day2} | {"p4": "four", "p3": "three"}
    refresh.write_parts(rows_of(spark, day2), at.inputs, "k", at.parts)
    new = candidates(rows_of(spark, day2), names)
    todo = at.plan(new).cache()
    assert {r.k: r.action for r in todo.collect()} == {"p3": "run_changed", "new": "run_new", "p9": "remove", "p4": "rename"}
    before = files(at.results)
    computed = []
    touched = at.run(todo, lambda rows: computed.append({r.k for r in rows.select("k").collect()}) or SUMS(rows))
    assert computed == [{"p3", "new"}]
    assert {(r.k, r.name, r.total) for r in at.load(spark, at.results).collect()} == {(k, names[k], sum(v)) for k, v in day2.items()}
    # Files of other parts are the very same ones.
    part = lambda f: int(re.search(r"part=(\d+)", f)[1])
    after = files(at.results)
    assert {f: t for f, t in before.items() if part(f) not in touched} == {f: t for f, t in after.items() if part(f) not in touched}
    assert not set(before) & {f for f in after if part(f) in touched} and 0 < len(touched) <= 4
    # Nothing is left to do; running an old plan again changes nothing.
    assert at.plan(new).count() == 0 and at.run(at.plan(new), SUMS) == []
    at.run(todo, SUMS)
    assert at.load(spark, at.results).count() == len(day2)


def test_only_touched_parts_are_read(spark, begun):
    at, day1 = begun
    new = candidates(rows_of(spark, dict(day1) | {"p3": [1]}), {k: k for k in day1})
    todo = at.plan(new)
    touched = sorted({r.part for r in todo.collect()})
    assert len(touched) == 1
    for df in (at.stale(todo, touched), at.merged(todo, touched, SUMS(at.stale(todo, touched)))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.splitlines() if "FileScan" in x and ("/in" in x or "/out" in x)]
        assert scans and all("PartitionFilters: [isnotnull(part" in x and f"= {touched[0]})" in x or f"part#" in x and f"IN ({touched[0]})" in x for x in scans)
    todo = todo.cache()
    todo.count()
    for path in (at.inputs, at.results):  # what lies in other parts can't be read any more
        for f in files(path):
            if f"part={touched[0]}/" not in f:
                open(f, "w").close()
    assert at.run(todo, SUMS) == touched
    assert {r.k: r.total for r in at.load(spark, at.results, touched).collect()}["p3"] == 3 + 6


def test_last_key_of_a_part_goes_and_failures_are_retried(spark, tmp_path):
    at = refresh.Refresh(*(str(tmp_path / x) for x in ("in", "out", "state")), key="k", parts=64)
    one = rows_of(spark, {"a": [1], "b": [2]})
    refresh.write_parts(one, at.inputs, "k", at.parts)
    at.first(candidates(one, {"a": "a", "b": "b"}), lambda rows: SUMS(rows.where("k <> 'b'")))
    assert {r.k: r.status for r in at.load(spark, at.state).collect()} == {"a": "succeeded", "b": "failed"}
    left = rows_of(spark, {"b": [2]})
    new = candidates(left, {"b": "b"})
    at.run(at.plan(new).cache(), SUMS)
    assert at.load(spark, at.results).collect() == [] and [r.k for r in at.load(spark, at.state).collect()] == ["b"]
    assert [(r.k, r.action) for r in at.plan(new, retry_failed=True).collect()] == [("b", "run_retry")]
    at.run(at.plan(new, retry_failed=True).cache(), SUMS)
    assert [(r.k, r.total) for r in at.load(spark, at.results).collect()] == [("b", 2)]


@pytest.fixture()
def tables(spark, tmp_path):
    kind = spark.createDataFrame([], "k string, y int, v long, seq int").schema
    rows = keyed.KeyedTable(spark, str(tmp_path / "rows"), kind, ["k", "y"], "seq", ["k"], buckets=16)
    made = spark.createDataFrame([], "k string, total long, batch long").schema
    return rows, keyed.KeyedTable(spark, str(tmp_path / "sums"), made, ["k"], "batch", ["k"], buckets=16)


def test_batches_touch_their_buckets_and_replays_do_nothing(spark, tables):
    rows, sums = tables
    run = keyed.feed(rows, sums, SUMS)
    kind = "k string, y int, v long, seq int"
    run(spark.createDataFrame([(f"p{i}", y, i, 0) for i in range(30) for y in (1, 2)], kind), 0)
    before = files(rows.path) | files(sums.path)
    late = spark.createDataFrame([("p3", 2, 100, 1), ("p3", 2, 50, 1), ("p4", 1, -1, -5), ("q", 1, 9, 0)], kind)
    run(late, 1)
    want = {f"p{i}": 2 * i for i in range(30)} | {"p3": 103, "q": 9}  # an older row of p4 loses
    assert {r.k: r.total for r in sums.read().collect()} == want
    assert {r.k for r in sums.read().where("batch = 1").collect()} == {"p3", "p4", "q"}
    new = {f: t for f, t in (files(rows.path) | files(sums.path)).items() if f not in before}
    assert all("batch=1" in f for f in new) and len({f.split("bucket=")[1].split("/")[0] for f in new}) <= 3
    run(late, 1)  # a replay
    assert {f for f in files(rows.path) | files(sums.path)} == set(before) | set(new)
    assert {r.k: r.total for r in sums.read().collect()} == want


def test_a_batch_lost_before_its_entry_is_written_again(spark, tables, monkeypatch):
    rows, sums = tables
    run, kind = keyed.feed(rows, sums, SUMS), "k string, y int, v long, seq int"
    run(spark.createDataFrame([("a", 1, 1, 0), ("b", 1, 2, 0)], kind), 0)
    more = spark.createDataFrame([("a", 2, 10, 0)], kind)
    with monkeypatch.context() as m, pytest.raises(RuntimeError):  # rows are in, sums aren't
        m.setattr(sums.__class__, "committed", lambda self: (_ for _ in ()).throw(RuntimeError("lost")) if self is sums else [0])
        run(more, 1)
    assert {r.k: r.total for r in sums.read().collect()} == {"a": 1, "b": 2}
    run(more, 1)
    assert {r.k: r.total for r in sums.read().collect()} == {"a": 11, "b": 2}
    # Files without an entry don't count, and old ones go.
    rows.bucketed(more).write.partitionBy("bucket").parquet(f"{rows.path}/data/batch=7")
    assert rows.read().count() == 3 and rows.vacuum() >= 1 and rows.read().count() == 3 and rows.committed() == [1]


def test_late_rows_are_told(spark):
    from panelyard.plans.all_queries import QUERIES

    if os.path.isdir("/root/testdata/sf0.001"):
        out = QUERIES["late_events"](spark, "/root/testdata/sf0.001").agg(F.sum("n").alias("n"), F.sum("late").alias("late")).first()
        assert out.n > 0 and out.late > 0
