"""Exports with manifests, lineage of facts, and drafts of any shape."""

import json
import os

from pyspark.sql import functions as F

from panelyard.operators import drafts, trend
from panelyard.sources import sinks


def test_manifest_names_every_file_and_finds_damage(spark, tmp_path):
    path = str(tmp_path / "out")
    a = spark.range(25).select(F.col("id"), F.when(F.col("id") % 2 == 0, "x").alias("t"))
    sinks.export_lines({"a": a, "b": spark.createDataFrame([("é\nü",)], "t string")}, path, rows_per_file=4)
    said = spark.createDataFrame(sinks.file_manifest(spark, path).collect(), "table string, file string, bytes long, rows long, sha256 string")
    got = {r.table: (r.files, r.rows) for r in said.groupBy("table").agg(F.count("*").alias("files"), F.sum("rows").alias("rows")).collect()}
    assert got["a"][1] == 25 and got["a"][0] >= 7 and got["b"] == (1, 1) and said.agg(F.max("rows")).first()[0] <= 4
    assert sinks.manifest_issues(said, sinks.file_manifest(spark, path)).collect() == []
    lines = sorted((json.loads(r.value)["id"] for r in spark.read.text(f"{path}/table=a").collect()))
    assert lines == list(range(25)) and "t" in json.loads(spark.read.text(f"{path}/table=a").where("value like '%:1,%'").first().value)
    files = [r.file for r in said.where("table = 'a'").orderBy("file").collect()]
    os.remove(f"{path}/table=a/{files[0]}")
    for name in (files[1], "part-new.txt"):
        with open(f"{path}/table=a/{name}", "a") as f:
            f.write('{"id": 99}\n')
        if os.path.exists(crc := f"{path}/table=a/.{name}.crc"):
            os.remove(crc)
    assert {(r.file, r.issue) for r in sinks.manifest_issues(said, sinks.file_manifest(spark, path)).collect()} == {(files[0], "missing"), (files[1], "changed"), ("part-new.txt", "extra")}


def test_facts_carry_their_rows(spark):
    rows = spark.createDataFrame([("p", 2017 + i, "X", v, 10 - i, "f") for i, v in enumerate((1.0, None, 3.0))], "k string, year int, indicator string, value double, source_row long, source_file string")
    f = trend.with_lineage(trend.indicator_facts(rows, ["k", "indicator"]), rows, ["k", "indicator"]).first()
    assert [tuple(x) for x in f.time_series] == [(2017, 1.0, 10, "f"), (2018, None, 9, "f"), (2019, 3.0, 8, "f")] and f.missing_years == [2018]


def test_drafts_of_any_shape(spark):
    contexts = spark.createDataFrame(
        [("p", "P001", "名甲", "突出问题", [("NP",)]), ("p", "P002", "名乙", "存在风险", []), ("p", "P003", "名丙", "不适用", [])], "project_key string, problem_id string, problem_name string, status string, conflicting_signals array<struct<indicator: string>>"
    )
    section = lambda i, **more: {"section_id": i, "title": "t", **({"paragraphs": ["甲"]} if i != "problem_analysis" else {}), **more}
    blocks = [{"problem_id": "P001", "title": "x名甲", "paragraphs": ["但NP" + "字" * 400]}, {"problem_id": "P002", "title": "名乙", "paragraphs": ["字" * 90]}]
    right = {"summary": {"paragraphs": ["a"], "keywords": ["1", "2", "3"]}, "sections": [section(s, **({"problem_blocks": blocks} if s == "problem_analysis" else {})) for s in drafts.SECTIONS]}
    change = lambda f: (d := json.loads(json.dumps(right)), f(d))[0]
    cases = {
        "right": (right, []), "null": (None, ["invalid_narrative_type"]), "number": (5, ["invalid_narrative_type"]), "keywords are numbers": (change(lambda d: d["summary"].update(keywords=[1, 2, 3])), []),
        "paragraph is a number": (change(lambda d: d["summary"].update(paragraphs=[1])), ["invalid_summary_paragraphs"]), "paragraphs is a text": (change(lambda d: d["summary"].update(paragraphs="a")), ["invalid_summary_paragraphs"]),
        "no keywords": (change(lambda d: d["summary"].pop("keywords")), ["invalid_summary"]), "a section is a list": (change(lambda d: d["sections"].append([])), ["section_mismatch"]), "a section twice": (change(lambda d: d["sections"].append(d["sections"][0])), ["section_mismatch"]),
        "more in a section": (change(lambda d: d["sections"][0].update(x=1)), ["invalid_section"]), "title is null": (change(lambda d: d["sections"][4].update(title=None)), ["invalid_section"]), "block is a text": (change(lambda d: d["sections"][1].update(problem_blocks=["x"])), ["problem_block_mismatch"]),
        "block paragraphs is an object": (change(lambda d: d["sections"][1]["problem_blocks"][1].update(paragraphs={})), ["invalid_problem_paragraphs"]), "bad measure": (change(lambda d: d["summary"].update(paragraphs=["坏措施 P001级"])), ["unapproved_measure"]),
        "priority": (change(lambda d: d["summary"].update(paragraphs=["归入 P1"])), ["priority_language"]),
    }
    rows = [("p", name, None if d is None else json.dumps(d, ensure_ascii=False)) for name, (d, _) in cases.items()]
    out = drafts.draft_contract_issues(spark.createDataFrame(rows, "project_key string, v string, draft string"), contexts, spark.createDataFrame([("p", "坏措施")], "project_key string, phrase string"), ["project_key", "v"])
    got = {}
    for r in out.collect():
        got.setdefault(r.v, []).append(r.code)
    assert {k: sorted(got.get(k, [])) for k in cases} == {k: codes for k, (_, codes) in cases.items()}
