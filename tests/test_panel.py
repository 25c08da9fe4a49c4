"""Golden cases of the panel operators on small rows."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from panelyard.operators import analysis, evidence, incremental, measures, quality, risk, rules, text, trend

KEYS = ["k"]


def series(spark, by_name, start=2017):
    rows = [(k, start + i, None if v is None else float(v)) for k, vs in by_name.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "k string, year int, value double")


V2 = {
    "overall_up": [1, 2, 3, 4, 5], "overall_down": [5, 4, 3, 2, 1], "stable": [10, 10.1, 9.9, 10], "fluctuating_upward": [1, 3, 2, 4, 3, 6],
    "fluctuating_downward": [6, 4, 5, 3, 4, 1], "rise_then_fall": [1, 2, 4, 3, 1], "fall_then_rise": [4, 3, 1, 2, 5], "unknown": [1, 2],
}


def test_long_term_classes(spark):
    out = {r.k: r for r in trend.indicator_facts(series(spark, V2), KEYS).collect()}
    assert {k: r.long_term for k, r in out.items()} == {k: k for k in V2}
    assert not out["unknown"].valid and out["unknown"].recent == "unknown" and out["overall_up"].recent == "up"


def plain_fact(points):
    """The fact semantics once more, in plain Python, for one series of (year, value)."""
    from statistics import median

    vals = [v for _, v in points]
    years = [y for y, _ in points]

    def fit(xs, ys):
        mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
        s = sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / sum((x - mx) ** 2 for x in xs)
        return s, my, sum((y - my - s * (x - mx)) ** 2 for x, y in zip(xs, ys, strict=True))

    if len(vals) < 3:
        return "unknown", []
    smooth = [median(vals[max(0, i - 1) : i + 2]) if 0 < i < len(vals) - 1 else v for i, v in enumerate(vals)]
    mean = sum(vals) / len(vals)
    rel = fit(years, vals)[0] * (len(vals) - 1) / max(abs(mean), 1e-12)
    spread = (max(vals) - min(vals)) / max(abs(mean), 1e-12)
    best = None
    for k in range(2, len(vals) - 1):
        (ls, lm, le), (rs, rm, re) = fit(years[:k], smooth[:k]), fit(years[k - 1 :], smooth[k - 1 :])
        lc, rc = ls * (k - 1) / max(abs(lm), 1e-12), rs * (len(vals) - k) / max(abs(rm), 1e-12)
        if abs(lc) >= 0.1 and abs(rc) >= 0.1 and lc * rc < 0 and (best is None or le + re < best[0] - 1e-12):
            best = le + re, "rise_then_fall" if lc > 0 else "fall_then_rise"
    signs = [(d > mean_tol) - (d < -mean_tol) for d in (b - a for a, b in zip(vals, vals[1:], strict=False)) for mean_tol in [max(abs(mean), 1e-12) * 0.001]]
    nz = [s for s in signs if s]
    flips = sum(a != b for a, b in zip(nz, nz[1:], strict=False))
    turning = [years[i] for i in range(1, len(signs)) if signs[i] * signs[i - 1] == -1]
    if abs(rel) < 0.1 and spread < 0.1:
        kind = "stable"
    elif best:
        kind = best[1]
    elif rel >= 0.1:
        kind = "fluctuating_upward" if flips >= 2 else "overall_up"
    elif rel <= -0.1:
        kind = "fluctuating_downward" if flips >= 2 else "overall_down"
    else:
        kind = "stable"
    return kind, turning


def test_facts_against_plain_python(spark):
    rng = random.Random(4)
    data = {f"s{n}": [round(rng.gauss(5, 2), 3) for _ in range(rng.randint(2, 14))] for n in range(300)}
    out = {r.k: (r.long_term, r.turning_years) for r in trend.indicator_facts(series(spark, data), KEYS).collect()}
    assert out == {k: plain_fact([(2017 + i, v) for i, v in enumerate(vs)]) for k, vs in data.items()}


def test_facts_with_nulls_and_not_finite(spark):
    s = series(spark, {"a": [1, None, float("nan"), 3, float("inf"), 2], "b": [None, None]})
    a, b = trend.indicator_facts(s, KEYS).orderBy("k").collect()
    assert (a.valid_years, a.missing_years, a.current_year, a.min_year, a.max_year) == (3, [2018], 2022, 2017, 2020)
    assert (b.valid_years, b.missing_years, b.current_year, b.valid) == (0, [2017, 2018], None, False)


def test_facts_take_one_shuffle(spark):
    plan = trend.indicator_facts(series(spark, V2), KEYS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_v1_goldens(spark):
    s = series(spark, {"slope": [1, 3, 5], "turn": [0.4, 0.2, 0.3, 0.5], "flat": [2.253824, 2.254137], "one": [3]})
    out = {r.k: r for r in trend.trend_evidence(s, KEYS).collect()}
    assert out["slope"].slope_per_year == pytest.approx(2.0) and "one" not in out
    assert (out["turn"].pattern, out["turn"].recent_direction, out["turn"].turning_years) == ("decrease_then_increase", "increase", [2019])
    assert (out["flat"].pattern, out["flat"].direction) == ("stable", "stable")


def test_scale_index_and_carbon(spark):
    v = trend.min_max_scale(series(spark, {"v": [0.2, None, 0.4], "f": [3, 3, None]}), KEYS).orderBy("k", "year").collect()
    assert [r.scaled for r in v] == [0, 0, None, 0, None, 100]
    i = trend.index_to_first(series(spark, {"n": [10, 12], "z": [0, 1]}), KEYS).collect()
    assert [r.indexed for r in i] == [100.0, 120.0]
    c, e = trend.carbon_stock(F.lit(100.0), F.lit(0.5))
    assert spark.range(1).select(c, e).first() == (pytest.approx(22.5), pytest.approx(82.5))


def test_diagnosis_goldens(spark):
    rows = [("MEAN_NDVI", "overall_up", "up"), ("MEAN_NPP", "overall_up", "up"), ("NP", "overall_up", "down"), ("PD", "overall_up", "down")]
    facts = spark.createDataFrame([("p", i, True, long, near, [2019]) for i, long, near in rows], "project_key string, indicator string, valid boolean, long_term string, recent string, turning_years array<int>")
    projects = spark.createDataFrame([("p", "coal", {}, ["植被退化"])], "project_key string, project_type string, scope map<string, string>, risk_tags array<string>")
    d = {r.problem_id: r for r in rules.diagnose(facts, projects, rules.rule_table(spark)).collect()}
    assert len(d) == 13
    assert d["P001"].status == rules.IMPROVING and d["P003"].status == rules.INSUFFICIENT and d["P011"].status == rules.NOT_APPLICABLE
    assert d["P004"].status == rules.PROMINENT and d["P004"].trend == "recently_improving"
    assert d["P003"].limitations == ["数据条件未满足：ca_landcover_type", "指标数据不足：CA", "指标数据不足：LPI"]
    v1 = spark.createDataFrame([("p", "MEAN_NDVI", "increase"), ("p", "MEAN_NPP", "increase")], "project_key string, indicator string, direction string")
    d = {r.problem_id: r for r in rules.diagnose_v1(v1, projects, rules.rule_table(spark, rules.RULES_V1, rules.GATES_V1)).collect()}
    assert (d["P001"].status, d["P001"].level) == (rules.IMPROVING, "A")
    assert [d[p].status for p in ("P003", "P009", "P012", "P011")] == [rules.INSUFFICIENT] * 3 + [rules.NOT_APPLICABLE]


def test_measure_goldens(spark):
    texts = [("coal", "乡土植被恢复；设置光伏板；乡土植被恢复", []), ("coal", "[ML推荐] 生态　 修复", []), ("coal", "选用耐污乡土植被钝化矿区重金属", []), ("coal", "长时序植被覆盖动态归因监测", []), ("coal", "矸石堆覆土改良覆绿", []), ("coal", "矸石堆覆土改良覆绿", ["gangue_or_tailings"])]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, project_type string, measure_text string, have array<string>")
    a = measures.audit(measures.segments(df, ["id", "project_type", "have"]), ["id"], features="have").orderBy("id", "pos").collect()
    assert [r.reason for r in a] == ["accepted", "project_type_conflict:设置光伏板", "duplicate", "accepted", "requires_unavailable_problem_rule:重金属污染", "v1_monitoring_measure_excluded:监测", "requires_site_feature:gangue_or_tailings", "accepted"]
    assert (a[3].source, a[3].text) == ("ml_recommendation", "生态 修复")
    acc = spark.createDataFrame([("p", "coal", "矿区外围生态防护林带搭建")], "project_key string, project_type string, text string")
    problems = spark.createDataFrame([("p", "P005", 1), ("p", "P004", 2)], "project_key string, problem_id string, ord int")
    m = measures.match_knowledge(acc, problems, measures.knowledge_table(spark)).collect()
    assert [(r.measure_id, r.targets) for r in m] == [("M004", ["P005", "P004"])]


def test_greedy_against_plain_python(spark):
    rng = random.Random(2)
    words = list("abcdef")
    ps = [("e", i, f"P{i}", rng.sample(words, 3)) for i in range(5)]
    ms = [("e", i, "".join(rng.choices(words, k=3))) for i in range(20)]
    used, want = set(), []
    for _, _, p, kws in ps:
        n = 0
        for _, _, t in ms:
            k = next((k for k in kws if k in t), None)
            if t not in used and k and n < 3:
                want.append((p, t, k))
                used.add(t)
                n += 1
    got = measures.greedy(spark.createDataFrame(ps, "project_key string, ord int, problem string, keywords array<string>"), spark.createDataFrame(ms, "project_key string, pos int, text string")).orderBy("ord").collect()
    assert [(r.problem, r.text, r.keyword) for r in got] == want


def test_risk_goldens(spark):
    r = spark.createDataFrame([("s", 2017, "本体", 1.0), ("s", 2017, "0-1km", 3.0), ("s", 2024, "本体", 5.0), ("s", 2024, "0-1km", 7.0), ("w", 2024, "1-3km", 2.0), ("w", 2024, "本体", 9.0)], "k string, year int, scope string, value double")
    assert [x["mean"] for x in risk.annual_means(r.where("k = 's'"), "k").orderBy("year").collect()] == [2.0, 6.0]
    p, bad = risk.checked_p(F.lit(1.0985))
    assert spark.range(1).select(risk.significance(p), bad).first() == ("missing", True)
    fields = ", ".join(f"{f} double" for f in risk.RISK_FIELDS)
    full = lambda k, y, scope, v: (k, y, scope, *[None] * 6, v, "", 3, 7)
    records = spark.createDataFrame([full(x.k, x.year, x.scope, x.value) for x in r.collect()], f"project_key string, year int, scope string, {fields}, risk_level string, risk_level_code int, source_row int")
    projects = spark.createDataFrame([("s", "solar", 2024), ("w", "wind", 2024), ("n", "coal", 2024)], "project_key string, project_type string, target_year int")
    trends = spark.createDataFrame([("s", 1.0, 2.0, 3.0, 4.0, 1.0985, "up")], "project_key string, start_ceri double, end_ceri double, change_rate_percent double, sen_slope double, p_value_raw double, trend_type string")
    got = {x.project_key: x for x in risk.risk_evidence(projects, records, trends).collect()}
    assert [(a.year, a.mean_ceri, a.valid_scope_count) for a in got["s"].annual_series] == [(2017, 2.0, 2), (2024, 6.0, 2)]
    assert (got["s"].source_scope, got["s"].fallback, got["s"].quality_flags, got["s"].trend.significance_status) == ("本体", False, ["invalid_p_value_treated_as_missing"], "missing")
    assert (got["w"].source_scope, got["w"].fallback, got["w"].quality_flags) == ("1-3km", True, ["core_scope_missing_fallback"])
    assert [g.scope for g in got["w"].spatial_gradient] == ["1-3km"] and got["w"].source_scope_order == risk.SCOPE_ORDER[1:]
    assert got["n"].quality_flags == ["no_valid_target_ceri"] and got["n"].annual_series == []
    assert {x.project_key for x in risk.risk_evidence(projects, records, trends, source_present=False).collect()} == {"s", "w"}


def test_of_a_repeated_scope_the_last_row_counts(spark):
    kind = "project_key string, year int, scope string, " + ", ".join(f"{f} double" for f in risk.RISK_FIELDS) + ", risk_level string, risk_level_code int, source_row long"
    row = lambda scope, ceri, at: ("s", 2024, scope, *[None] * (len(risk.RISK_FIELDS) - 1), ceri, f"L{at}", at, at)
    assert risk.RISK_FIELDS[-1] == "CERI"
    records = spark.createDataFrame([row("0-1km", 7.0, 1), row("本体", 5.0, 2), row("本体", 6.0, 9), row("0-1km", None, 4)], kind)
    projects = spark.createDataFrame([("s", "solar", 2024)], "project_key string, project_type string, target_year int")
    trends = spark.createDataFrame([], "project_key string, start_ceri double, end_ceri double, change_rate_percent double, sen_slope double, p_value_raw double, trend_type string")
    got = risk.risk_evidence(projects, records, trends).first()
    assert [(g.scope, g["values"].CERI, g.source_row) for g in got.spatial_gradient] == [("本体", 6.0, 9), ("0-1km", None, 4)]
    assert got.risk_level == "L9" and [(a.mean_ceri, a.valid_scope_count) for a in got.annual_series] == [(6.0, 3)]


def test_context_goldens(spark):
    facts = spark.createDataFrame(
        [("p", "MEAN_NDVI", True, "overall_down", "up", [2019]), ("p", "MEAN_NPP", True, "stable", "down", [2018, 2019])], "project_key string, indicator string, valid boolean, long_term string, recent string, turning_years array<int>"
    )
    projects = spark.createDataFrame([("p", "coal", {}, [])], "project_key string, project_type string, scope map<string, string>, risk_tags array<string>")
    matches = spark.createDataFrame([("p", "M002", "b", "x", ["P001"], 1), ("p", "M001", "a", "y", ["P001"], 1)], "project_key string, measure_id string, name string, mechanism string, targets array<string>, first_target int")
    c = {r.problem_id: r for r in analysis.contexts(rules.diagnose(facts, projects, rules.rule_table(spark)), matches).collect()}
    p = c["P001"]
    assert (p.existence, p.overall_balance, p.relationship, p.support_strength, p.counter_strength, p.long_recent_relation) == ("possible", "mixed", "conflicting", "moderate", "moderate", "partially_divergent")
    assert p.features == ["indicator_conflict", "long_term_improvement", "long_term_stable", "moderate_direct_evidence", "recent_deterioration", "recent_improvement"]
    assert (p.supporting_ids, p.conflicting_ids, p.stable_ids, p.turning_points) == (["EV-P001-MEAN_NDVI"], ["EV-P001-MEAN_NPP"], ["EV-P001-MEAN_NPP"], [2018, 2019])
    assert [m.measure_id for m in p.matched] == ["M001", "M002"] and p.dimensions == ["vegetation_condition", "vegetation_productivity"]
    assert c["P003"].features == ["data_limitation"] and c["P003"].overall_balance == "insufficient" and c["P011"].features == ["data_limitation", "scope_limitation"] and c["P011"].overall_balance == "does_not_support_diagnosis"
    tie = spark.createDataFrame([("p", "P002", ["NP", "MEAN_NPP"], 1, 1), ("p", "P003", ["??"], 5, 5)], "project_key string, problem_id string, indicators array<string>, supported long, opposed long")
    assert [tuple(r)[1:] for r in analysis.dominant_dimension(analysis.dimension_profile(tie)).collect()] == [("landscape_structure", "景观空间结构", 2)]


def test_reported_risks_and_sites(spark):
    m = spark.createDataFrame([("p", "植被退化、ML综合预测；外来物种,植被退化")], "project_key string, risk_types string")
    risks = evidence.reported(m)
    assert [r.risk for r in risks.orderBy("pos").collect()] == ["植被退化", "外来物种", "植被退化"]
    t = spark.createDataFrame([("p", "MEAN_NPP")], "project_key string, indicator string")
    assert [(r.indicators, r.available_trends) for r in evidence.problem_evidence(risks, t).collect()] == [(["MEAN_NDVI", "MEAN_NPP"], ["MEAN_NPP"])] * 2
    both = spark.createDataFrame([(1, "coal", "尾矿与采坑治理", ["gangue_or_tailings"])], "id int, project_type string, measure_text string, have array<string>")
    assert [r.reason for r in measures.audit(measures.segments(both, ["id", "project_type", "have"]), ["id"], features="have").collect()] == ["accepted"]


def test_text_goldens(spark):
    md = "# 一\n| a | b |\n|---|:-:|\n| 1 |\n\n![x](y/z.png)\n**图 1-1 趋势**\n<!-- pagebreak -->\n- 项\n##### 五\n文 字"
    b = text.markdown_blocks(spark.createDataFrame([(1, md)], "k int, text string"), ["k"]).orderBy("ordinal").collect()
    assert [(r.kind, r.level, r.text, r.source) for r in b] == [("heading", 1, "一", ""), ("table", 0, "", ""), ("image", 0, "x", "y/z.png"), ("caption", 0, "图 1-1 趋势", ""), ("pagebreak", 0, "", ""), ("bullet", 0, "项", ""), ("paragraph", 0, "##### 五", ""), ("paragraph", 0, "文 字", "")]
    assert b[1].rows == [["a", "b"], ["1", ""]]
    p = text.paragraphs(spark.createDataFrame([(1, "# 流程参考\n一\n二\n\n三")], "k int, text string"), ["k"]).orderBy("ordinal").collect()
    assert [(r.kind, r.heading, r.block) for r in p] == [("heading", "流程参考", "流程参考"), ("paragraph", "流程参考", "一 二"), ("paragraph", "流程参考", "三")]
    t = spark.createDataFrame([(1, "由于开采导致退化，种植120株，V1.5米，极其严重。")], "k int, text string")
    found = {(r.code, r.detail) for r in text.lint(t, ["k"], text.lint_rules(1)).collect()}
    assert found - {("missing_heading", h) for h in text.HEADINGS_V1} == {("unsupported_causal_claim", "由于开采导致"), ("invented_implementation_parameter", "120株"), ("invented_implementation_parameter", "1.5米"), ("exaggerated_language", "极其严重")}


def test_increments(spark):
    key = spark.createDataFrame([("wind-0042",)], "k string")
    assert key.select(incremental.uuid5(F.col("k"))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "wind-0042"))
    new = spark.createDataFrame([(i, "h") for i in range(7)], "k int, full_hash string")
    old = spark.createDataFrame([(0, "succeeded", "h"), (1, "succeeded", "g"), (2, "failed", "h"), (3, "running", "h"), (4, "paused", "h"), (5, "succeeded", None)], "k int, status string, full_hash string")
    got = {r.k: r.action for r in incremental.enqueue(new, old, "k").collect()}
    assert got == {0: "skip", 1: "run_changed", 2: "skip", 3: "run_resume", 4: "run_resume", 5: "run_changed", 6: "run_new"}
    assert {r.action for r in incremental.enqueue(new, old, "k", True).where("k = 2").collect()} == {"run_retry"}


def test_quality_checks(spark):
    df = spark.createDataFrame([("3.9",), ("x",), (None,), ("1e12",), ("nan",), (" 5 ",)], "v string")
    assert [r[0] for r in df.select(quality.strict_int(F.col("v"))).collect()] == [3, None, None, None, None, 5]
    with pytest.raises(ValueError):
        quality.require_columns(df, ["v", "w"])
    docs = spark.createDataFrame([(1, '{"a": 1, "z": 2}'), (2, '{"a": 1, "b": "x"}')], "k int, j string")
    got = {(r.k, r.code, r.field) for r in quality.contract_issues(docs, "k", "j", ["a", "b"], ["a", "b"], {"b": ["y"]}).collect()}
    assert got == {(1, "missing", "b"), (1, "unexpected", "z"), (2, "not_allowed", "b")}


def test_locked_changes(spark):
    seed = spark.createDataFrame([(1, "x", 2), (2, "y", 3), (3, "z", None)], "k int, f string, g int")
    draft = spark.createDataFrame([(1, "x", 9), (3, "z", None), (4, "q", 1)], "k int, f string, g int")
    got = {(r.k, r.code, r.field) for r in analysis.locked_changes(seed, draft, ["f", "g"], ["k"]).collect()}
    assert got == {(1, "changed", "g"), (2, "missing", "*"), (4, "unexpected", "*")}


def test_greedy_collects_only_what_may_be_taken(spark):
    problems = spark.createDataFrame([("a", 1, "p", ["x"]), ("a", 2, "q", ["y", "x"])], "project_key string, ord int, problem string, keywords array<string>")
    texts = [f"{'x' if i % 3 else 'y'}{i // 2}" for i in range(3000)]
    candidates = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "project_key string, pos int, text string")
    out = measures.greedy(problems, candidates)
    assert [(r.ord, r.text, r.keyword) for r in out.orderBy("ord").collect()] == [(0, "x0", "x"), (1, "x1", "x"), (2, "x2", "x"), (3, "y0", "y"), (4, "y1", "y"), (5, "y3", "y")]
    asked = problems.groupBy("project_key").agg(F.array_sort(F.collect_list(F.struct("ord", "problem", "keywords"))).alias("ps"))
    assert measures.takeable(asked, candidates, "project_key", 3).count() <= 12


def test_strategy_sections(spark):
    selected = spark.createDataFrame([("p", 0, "b", "x", "k"), ("p", 1, "b", "y", "k"), ("p", 2, "a", "z", "m")], "project_key string, ord int, problem string, text string, keyword string")
    problems = spark.createDataFrame([("p", 1, "a", "s"), ("p", 2, "b", "s"), ("p", 3, "c", "s")], "project_key string, ord int, problem string, status string")
    got = measures.strategy_sections(selected, problems).orderBy("ord").collect()
    assert [(r.problem, [(m.text, m.match_type) for m in r.measures]) for r in got] == [("a", [("z", "keyword:m")]), ("b", [("x", "keyword:k"), ("y", "keyword:k")])]
