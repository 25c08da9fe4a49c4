"""Pattern search by an index of pieces, against plain search."""

import random

import ahocorasick

from panelyard.operators import measures, substrings


def test_hits_equal_plain_search(spark):
    rng = random.Random(2)
    texts = [(k, "".join(rng.choices("abcé\n 漢", k=rng.choice((0, 1, 2, 3, 30, 200))))) for k in range(60)] + [(60, None), (61, "abc"), (61, "xyz"), (62, "a" * 20_000)]
    patterns = [(k, "".join(rng.choices("abcé\n 漢", k=rng.choice((1, 2, 3, 4, 5, 6, 9))))) for k in range(400)] + [(400, None), (401, ""), (402, "abc"), (403, "abc"), (404, "a" * 200)]
    got = substrings.contains_join(spark.createDataFrame(texts, "doc long, text string"), ["doc"], spark.createDataFrame(patterns, "pattern_id long, pattern string"))
    want = {(d, p) for d, t in texts if t for p, x in patterns if x and x in t}
    rows = [(r.doc, r.pattern_id) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    none = spark.createDataFrame([(1, "")], "pattern_id long, pattern string")
    assert substrings.contains_join(spark.createDataFrame(texts, "doc long, text string"), ["doc"], none).collect() == []


def test_hundred_thousand_patterns(spark):
    rng = random.Random(4)
    syllables = [a + b for a in "bcdfgklmnprst" for b in "aeiou"]
    text = lambda n: "".join(rng.choices(syllables, k=n))
    texts = [(k, text(300)) for k in range(300)]
    patterns = list(enumerate(sorted({text(rng.randint(3, 5)) for _ in range(130_000)})))[:100_000]
    assert len(patterns) == 100_000
    got = substrings.contains_join(spark.createDataFrame(texts, "doc long, text string"), ["doc"], spark.createDataFrame(patterns, "pattern_id long, pattern string"))
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    tree = ahocorasick.Automaton()
    for k, x in patterns:
        tree.add_word(x, k)
    tree.make_automaton()
    want = {(d, k) for d, t in texts for _, k in tree.iter(t)}
    assert {(r.doc, r.pattern_id) for r in got.collect()} == want and len(want) > 1000


def test_audit_by_table_is_the_audit(spark):
    texts = ["乡土植被恢复；设置光伏板；乡土植被恢复", "[ML推荐] 生态监测；矸石堆覆土改良覆绿", "选用耐污乡土植被钝化矿区重金属；露天采坑与尾矿治理；风机基础监测", None, "；；"]
    rows = [(i, kind, x, sites) for i, x in enumerate(texts) for kind in ("coal", "solar", "other") for sites in ([], ["gangue_or_tailings"], None)]
    df = spark.createDataFrame([(10 * n + r[0], *r[1:]) for n, r in enumerate(rows)], "id long, project_type string, measure_text string, sites array<string>")
    parts = measures.segments(df, ["id", "project_type", "sites"]).dropDuplicates(["id", "pos"])
    order = ["id", "pos"]
    want = measures.audit(parts, ["id"], features="sites").orderBy(*order).collect()
    got = measures.audit_by_table(parts, ["id"], measures.fragment_table(spark), features="sites").orderBy(*order).collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in want] and len({r.reason.split(":")[0] for r in want}) >= 5


def test_many_patterns_and_long_texts(spark, monkeypatch):
    """Patterns across the ends of parts, blanks at every place, null keys, odd characters; broadcast or not, the hits are the same."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices(["a", "é", "漢", "😀", "\n", "b"], k=rng.choice((1, 1, 2, 4, 9))))
    texts = [(k if k % 7 else None, " ".join(word() for _ in range(rng.choice((0, 1, 5, 300))))) for k in range(40)] + [(99, "😀a" * 3000), (98, "  a  b   c "), (97, " " * 700)]
    patterns = sorted({t[i : i + n] for _, t in texts if t for i in (*rng.choices(range(len(t)), k=6), 250, 256) for n in (1, 2, 3, 5, 8, 13, 40, 300)} | {" ", "  ", " a", "a ", " a  ", "  b   c "})
    want = {(d, p) for d, t in texts for p in patterns if p and p in t}
    for few, counted in ((substrings.FEW, 0), (substrings.FEW, 10**6), (0, 0)):
        monkeypatch.setattr(substrings, "FEW", few)
        monkeypatch.setattr(substrings, "COUNTED", counted)
        ps = spark.createDataFrame([(p, p) for p in patterns if p], "pattern_id string, pattern string")
        rows = [(r.doc, r.pattern_id) for r in substrings.contains_join(spark.createDataFrame(texts, "doc long, text string"), ["doc"], ps).collect()]
        assert set(rows) == want and len(rows) == len(want)


def test_few_patterns_leave_texts_where_they_are(spark, tmp_path):
    """The texts pass no exchange when phrases are looked up, and one, that of their duplicates, when they are audited."""
    spark.range(50).selectExpr("id AS doc", "repeat('ab cd ef ', 400) AS text").write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    patterns = spark.createDataFrame([(1, "cd ef ab"), (2, "zz")], "pattern_id long, pattern string")
    stages = lambda df: df._jdf.queryExecution().sparkPlan().toString() and df._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in stages(substrings.matches(texts, patterns)).splitlines() if "Exchange" in x]
    assert all("Broadcast" in x or "piece" in x or "pattern" in x for x in moved)
    parts = measures.segments(texts.selectExpr("doc", "'coal' AS project_type", "text AS measure_text"), ["doc", "project_type"])
    plan = stages(measures.audit_by_table(parts, ["doc", "project_type"], measures.fragment_table(spark)))
    assert len([x for x in plan.splitlines() if "Exchange hashpartitioning(doc" in x]) == 1 and "SortMergeJoin" not in plan


def test_audit_by_table_keeps_rows_that_are_alike(spark, monkeypatch):
    """Rows of the same key, place and text, and null types, give as many rows as the audit does; also with patterns that aren't few."""
    rows = [(1, "coal", "尾矿", 0)] * 3 + [(None, None, "尾矿 监测", 0), (2, None, "监测" * 300, 1), (2, "wind", "尾矿", 2), (2, "wind", "", 3)]
    parts = spark.createDataFrame(rows, "id long, project_type string, text string, pos int")
    want = sorted(map(str, measures.audit(parts, ["id"]).collect()))
    for few in (substrings.FEW, 0):
        monkeypatch.setattr(substrings, "FEW", few)
        assert sorted(map(str, measures.audit_by_table(parts, ["id"], measures.fragment_table(spark)).collect())) == want
