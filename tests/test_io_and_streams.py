import datetime as dt
import json

import pytest

from panelyard.sources import sinks, tables
from panelyard.streaming import feeds


def test_scan_tidies_headers_and_keeps_lineage(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" YEAR ,FID,\n2020,3,x\n2021,4,y\n")
    df = tables.scan(spark, str(tmp_path / "a.csv"), "csv", required=("YEAR", "FID"))
    assert {"YEAR", "FID", "source_file"} <= set(df.columns)
    assert df.count() == 2 and df.first().source_file.endswith("a.csv")
    with pytest.raises(ValueError):
        tables.scan(spark, str(tmp_path / "a.csv"), "csv", required=("NDVI",))


def test_labels_unions_and_optional(spark):
    df = spark.createDataFrame([("光伏项目 FID 227",), ("风电项目 FID 142",), ("项目 FID 6",), ("光伏风电",)], "l string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(tables.type_of_label(F.col("l"), {"光伏": "solar", "风电": "wind", "煤": "coal"})).collect()] == ["solar", "wind", None, None]
    u = tables.union_types({"coal": spark.range(2), "wind": spark.range(1).withColumnRenamed("id", "x")})
    assert sorted((r.project_type, r.id, r.x) for r in u.collect() if r.project_type == "wind") == [("wind", None, 0)]
    assert tables.optional(spark, None, "a int").count() == 0
    assert spark.range(1).select(tables.project_key(F.lit("wind"), F.lit(42))).first()[0] == "wind-0042"


def test_documents_bundles_and_manifest(spark, tmp_path):
    p = spark.createDataFrame([("a", "coal"), ("b", "wind")], "project_key string, project_type string")
    c = spark.createDataFrame([("a", 2021, 1.0), ("a", 2020, 2.0)], "project_key string, year int, v double")
    nested = sinks.nest(p, {"main": c})
    sinks.write_documents(nested, str(tmp_path / "docs"))
    back = {r.project_key: r.main for r in spark.read.json(str(tmp_path / "docs")).collect()}
    assert [m.year for m in back["a"]] == [2020, 2021] and back["b"] is None
    sinks.write_bundle({"entry": p, "chart": c}, str(tmp_path / "out"))
    assert tables.bundle(spark, str(tmp_path / "out/entry")).count() == 2
    m = {r.name: (r.rows, r.digest) for r in sinks.manifest({"x": c, "y": c.orderBy("year"), "z": c.limit(1)}).collect()}
    assert m["x"] == m["y"] != m["z"]
    sinks.write_summary(c, str(tmp_path / "csv"), ["year"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["year"]
    (tmp_path / "tree/k1").mkdir(parents=True)
    (tmp_path / "tree/k1/report.json").write_text(json.dumps({"a": 1}))
    t = tables.result_tree(spark, str(tmp_path / "tree/*/*.json")).first()
    assert (t.key, t.name, json.loads(t.text)) == ("k1", "report.json", {"a": 1})


def _feed(spark, path, rows, n):
    spark.createDataFrame(rows, "id long, ts timestamp, event_type string, v int").coalesce(1).write.mode("append").parquet(path)


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 12, 0, 5)
    rows = [(i, t0 + dt.timedelta(seconds=7 * i), "a" if i % 2 else "b", i) for i in range(20)]
    _feed(spark, str(tmp_path / "in"), [*rows, rows[3]], 1)
    source = lambda: spark.readStream.schema("id long, ts timestamp, event_type string, v int").parquet(str(tmp_path / "in"))

    def result(df, name, mode="complete"):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    counts = result(feeds.sliding_counts(source()), "sliding")
    assert counts.agg({"n": "sum"}).first()[0] == 21 * 6
    assert result(feeds.distinct_events(source(), ["id"]), "once", "append").count() == 20
