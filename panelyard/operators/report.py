"""Report texts and chart tables: sentences and paragraphs of each problem, one ordered text an entity, chart data as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analysis import lookup
from .rules import PROMINENT

# Labels.
INDICATOR_LABELS = {
    "MEAN_NDVI": "归一化植被指数（NDVI）", "MEAN_NPP": "净初级生产力（NPP）", "MEAN_NEP": "净生态系统生产力（NEP）", "MEAN_NCS": "净碳汇（NCS）", "CA": "斑块面积（CA）", "LPI": "最大斑块指数（LPI）", "NP": "斑块数量（NP）",
    "PD": "斑块密度（PD）", "ED": "边缘密度（ED）", "LSI": "景观形状指数（LSI）", "ERI": "生态风险指数（ERI）", "MEAN_VCI": "植被状况指数（VCI）", "MEAN_EVI": "增强型植被指数（EVI）", "MEAN_SIF": "日光诱导叶绿素荧光（SIF）",
    "MEAN_VCS_C": "植被固碳量（VCS-C）", "MEAN_VCS_CO2e": "植被固碳当量（VCS-CO2e）", "MEAN_VCR": "植被碳储量比率（VCR）",
}
TREND_LABELS = {
    "overall_up": "总体上升", "overall_down": "总体下降", "fluctuating_upward": "波动上升", "fluctuating_downward": "波动下降", "rise_then_fall": "先升后降", "fall_then_rise": "先降后升", "stable": "基本稳定", "unknown": "无法判断",
    "up": "上升", "down": "下降", "worsening": "恶化", "recently_worsening": "近期恶化", "mixed": "方向不一致", "recently_improving": "近期改善", "improving": "改善",
}
SEVERITY_LABELS = {"high": "高", "medium": "中", "low": "低", "unknown": "未知"}
CONFIDENCE_LABELS = {"high": "高", "medium": "中", "low": "低", "not_assessable": "不可评价"}
TYPE_LABELS = {"coal": "煤矿", "solar": "光伏", "wind": "风电", "other": "其他"}
MATRIX_TRENDS = {"worsening": "恶化", "recently_worsening": "近期恶化", "mixed": "波动", "stable": "稳定", "recently_improving": "近期改善", "improving": "改善", "unknown": "未知"}
# Sentences.
SUPPORTS, OPPOSES, UNCLEAR = "构成当前诊断的支持证据", "与风险方向并不一致，构成需要保留的反向证据", "当前不足以形成明确支持或反向判断"
RELATIONS = {
    "divergent": "长期与近期信号存在差异，近期变化不能单独推翻长期判断。", "partially_divergent": "近期信号并不完全一致，因此综合结论保留差异并控制判断强度。", "consistent": "长期与近期信号总体一致，证据关系较为清晰。",
    "unknown": "现有证据不足以比较长期与近期关系。",
}
MATCHED, UNMATCHED = "已有合规候选措施与该问题关联。", "现有候选措施与知识库没有形成合规匹配，不据此补造修复措施。"
NO_PROMINENT = "本次评价未识别到证据充分的突出问题。"
CONTROLLED = "报告中的指标趋势、问题状态和措施匹配均来自受控分析结果，正文不扩展现场事实或实施参数。"
BOUNDARY = "现有证据边界不支持进一步解释具体原因或现场机制。"


def labelled(labels: dict[str, str], code: Column) -> Column:
    """A code's label; a code without one stays."""
    return F.coalesce(lookup(labels, code), code)


def two_decimals(x: Column) -> Column:
    """The binary value of a double (0.01 to a million, or zero) with two decimals, a tie to the even digit.

    Its fraction is a whole number of 2**-60, so hundredths and what is left of them are worked out exactly."""
    size = F.abs(x)
    whole = F.floor(size).cast("long")
    share = ((size - whole) * F.lit(float(2**60))).cast("long").cast("decimal(38,0)") * 100
    cents = F.floor(share / F.lit(2**60).cast("decimal(38,0)")).cast("long")
    left = share - cents.cast("decimal(38,0)") * F.lit(2**60).cast("decimal(38,0)")
    half = F.lit(2**59).cast("decimal(38,0)")
    total = whole * 100 + cents + F.when((left > half) | ((left == half) & (cents % 2 == 1)), 1).otherwise(0)
    sign = F.when((x < 0) & (total > 0), "-").otherwise("")
    return F.concat(sign, F.floor(total / 100).cast("string"), F.lit("."), F.lpad((total % 100).cast("string"), 2, "0"))


def number_text(x: Column) -> Column:
    """Two decimals (``two_decimals``), scientific from a million on or under a hundredth (there a tie goes away from zero), a dash for
    what is missing or not finite."""
    far = (F.abs(x) >= 1e6) | ((F.abs(x) < 0.01) & (x != 0))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "—").when(far, F.format_string("%.2e", x)).otherwise(two_decimals(x))


def signal_sentence(signal: Column) -> Column:
    """What one indicator says of a problem."""
    relation = F.when(signal["supports_problem"], SUPPORTS).when(~signal["supports_problem"], OPPOSES).otherwise(UNCLEAR)
    return F.concat(labelled(INDICATOR_LABELS, signal["indicator"]), F.lit("长期呈"), labelled(TREND_LABELS, signal["long_term"]), F.lit("、近期呈"), labelled(TREND_LABELS, signal["recent"]), F.lit("，"), relation, F.lit("。"))


def problem_paragraphs(contexts: DataFrame) -> Column:
    """Three paragraphs of a problem's context: the finding with its evidence, how it relates over time, and measures."""
    from .analysis import NO_PLACES

    opening = F.concat(F.col("problem_name"), F.lit("诊断为“"), F.col("status"), F.lit("”，证据等级为"), F.col("evidence_level"), F.lit("、可信度为"), labelled(CONFIDENCE_LABELS, F.col("confidence")), F.lit("。"))
    evidence = F.array_join(F.transform(F.concat("supporting_signals", "conflicting_signals"), signal_sentence), "")
    time = F.concat(lookup(RELATIONS, F.col("long_recent_relation")), F.col("primary_finding"), F.array_join(F.concat("interpretation_limitations", "unsupported_inferences"), ""))
    return F.array(F.concat(opening, evidence), time, F.concat(F.when(F.col("match_status") == "matched", MATCHED).otherwise(UNMATCHED), F.lit(NO_PLACES)))


def assemble(lines: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, markdown, n_lines) from (key, ord, text), ord of any sortable type: the lines in their order."""
    g = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("ls"))
    return g.select(key, F.array_join(F.transform("ls", lambda z: z["text"]), "\n").alias("markdown"), F.size("ls").cast("long").alias("n_lines"))


def _table(title: str, names: list[str], right: str = "") -> list[str]:
    return [f"**{title}**", "", "| " + " | ".join(names) + " |", "|" + "|".join("---:" if k in right else "---" for k in "abcdefghi"[: len(names)]) + "|"]


def report_lines(projects: DataFrame, facts: DataFrame, problems: DataFrame, matches: DataFrame, run_date: str, key: str = "project_key") -> DataFrame:
    """(key, ord, text): all lines of every project's report.

    *projects*: (key, project_type, name, first_year, target_year, risk_level); *facts*: indicator facts; *problems*: the
    reportable contexts with ``ord``; *matches*: (key, measure_id, name, mechanism, targets, first_target).  A project's facts,
    problems and measures come as one array each (tens of entries), so that all lines are made in one row.
    """
    arrays = lambda df, name, *cols: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    f = arrays(facts, "fs", "indicator", "valid", "valid_years", "current_value", "min_year", "max_year", "long_term", "recent", "relative_slope")
    p = arrays(problems.withColumn("paragraphs", problem_paragraphs(problems)), "ps", "ord", "problem_id", "problem_name", "status", "severity", "trend", "confidence", "evidence_level", "match_status", "supporting_ids", "conflicting_ids", "paragraphs")
    m = arrays(matches, "ms", "first_target", "measure_id", "name", "mechanism", "targets")
    x = projects.join(f, key, "left").join(p, key, "left").join(m, key, "left")
    for c in ("fs", "ps", "ms"):
        x = x.withColumn(c, F.coalesce(c, F.array().cast(x.schema[c].dataType)))
    lit = lambda *xs: F.array(*[F.lit(z) if isinstance(z, str) else z for z in xs])
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    active, seen = F.filter("ps", lambda z: z["status"] == PROMINENT), F.filter("ps", lambda z: z["status"] != PROMINENT)
    year, level = F.col("target_year").cast("string"), F.nullif("risk_level", F.lit(""))
    names = lambda ok: F.array_join(F.transform(F.filter("fs", lambda z: z["valid"] == ok), lambda z: z["indicator"]), "、")
    problem_name = lambda pid: F.try_element_at(F.transform(F.filter("ps", lambda z: z["problem_id"] == pid), lambda z: z["problem_name"]), F.lit(1))
    bare = F.array_join(F.transform(F.filter(active, lambda z: z["match_status"] == "no_compliant_match"), lambda z: z["problem_name"]), "、")
    summary = F.concat(
        F.lit("本报告基于"), F.col("first_year").cast("string"), F.lit("—"), year, F.lit("年项目指标，对证据充分且适用于本项目的生态问题进行分析。"),
        F.when(level.isNotNull(), F.concat(F.lit("当前综合风险等级为"), level, F.lit("。"))).otherwise("基底数据未提供综合风险等级，本报告不据指标趋势另行推定。"),
    )
    overall = F.concat(
        F.when(level.isNotNull(), F.concat(year, F.lit("年项目综合风险等级为"), level, F.lit("。"))).otherwise("基底数据未提供综合风险等级，本报告不生成总体风险等级。"),
        F.lit("本次报告讨论"), F.size(active).cast("string"), F.lit("项突出问题和"), F.size(seen).cast("string"), F.lit("项需要持续观察的问题。"),
    )
    parts = [
        lit("# 生态状况智能诊断与修复决策报告", "", F.concat("name", F.lit(" "), year, F.lit("年度生态诊断")), "", F.concat(F.lit("评价年份："), year), "", f"生成日期：{run_date}", "", "<!-- pagebreak -->", "", "## 摘要", "", summary, "", CONTROLLED, ""),
        lit("**关键词：** 生态诊断；指标趋势；生态修复；证据追溯", "", "<!-- pagebreak -->", "", "## 目录", "", "<!-- toc -->", "", "<!-- pagebreak -->", "", "## 1 项目与评价基础", "", "### 1.1 项目基本信息", "", *_table("表 1-1 项目基本信息", ["项目", "内容"])),
        F.array(row(F.lit("项目名称"), F.col("name")), row(F.lit("项目类型"), labelled(TYPE_LABELS, F.col("project_type"))), row(F.lit("评价时段"), F.concat(F.col("first_year").cast("string"), F.lit("—"), year, F.lit("年")))),
        lit("", "### 1.2 数据完整性", "", *_table("表 1-2 数据完整性", ["指标范围", "内容"])),
        F.array(row(F.lit("可用指标"), names(True)), row(F.lit("数据不足指标"), F.coalesce(F.nullif(names(False), F.lit("")), F.lit("无")))),
        lit("", "## 2 综合生态状况", "", overall, "", "### 2.1 指标概览", "", *_table("表 2-1 指标趋势概览", ["指标", "当前值", "长期趋势", "最近变化", "数据质量"], "b")),
        F.transform("fs", lambda z: row(labelled(INDICATOR_LABELS, z["indicator"]), number_text(z["current_value"]), labelled(TREND_LABELS, z["long_term"]), labelled(TREND_LABELS, z["recent"]), F.when(z["valid"], "充分").otherwise("不足"))),
        lit("", "## 3 突出生态问题", ""), F.when(F.size(active) == 0, lit(NO_PROMINENT, "")).otherwise(F.array().cast("array<string>")),
        F.flatten(F.transform(active, lambda z, i: F.concat(F.array(F.concat(F.lit("### 3."), (i + 1).cast("string"), F.lit(" "), z["problem_name"]), F.lit("")), F.flatten(F.transform(z["paragraphs"], lambda t: F.array(t, F.lit(""))))))),
        lit("## 4 持续观察的潜在问题", "", *_table("表 4-1 持续观察问题汇总", ["问题", "当前判断", "趋势", "证据等级"])),
        F.transform(seen, lambda z: row(z["problem_name"], z["status"], labelled(TREND_LABELS, z["trend"]), z["evidence_level"])),
        lit("", "## 5 生态问题综合诊断", "", "综合解释应识别跨问题共同信号、维度差异和当前主要生态矛盾。", "", *_table("表 5-1 生态问题综合诊断", ["问题", "问题类别", "当前判断", "严重程度", "问题趋势", "可信度"])),
        F.transform("ps", lambda z: row(z["problem_name"], F.when(z["status"] == PROMINENT, PROMINENT).otherwise("持续观察"), z["status"], labelled(SEVERITY_LABELS, z["severity"]), labelled(TREND_LABELS, z["trend"]), labelled(CONFIDENCE_LABELS, z["confidence"]))),
        lit("", "## 6 生态修复策略", "", *_table("表 6-1 受控修复措施及来源", ["措施ID", "措施", "对应问题", "作用机制"])),
        F.transform("ms", lambda z: row(z["measure_id"], z["name"], F.array_join(F.transform(z["targets"], problem_name), "、"), z["mechanism"])),
        F.when(bare != "", F.array(F.lit(""), F.concat(F.lit("现有候选措施和结构化知识库未能为"), bare, F.lit("形成合规匹配；本报告不据此新增措施。")))).otherwise(F.array().cast("array<string>")),
        lit("", "## 7 综合修复建议", "", "现有措施只说明与相应生态问题的匹配关系。具体位置、工程量、密度、经费和工期需在现场调查及工程设计后确定。", "", "## 8 结论", ""),
        F.array(F.concat(F.lit("本次评价形成"), F.size("fs").cast("string"), F.lit("项指标事实，正文讨论"), F.size("ps").cast("string"), F.lit("项生态问题，并列出"), F.size("ms").cast("string"), F.lit("条已通过合规匹配的措施。"))),
        lit("", "## 附录 A 指标趋势结果", "", *_table("表 A-1 指标趋势与来源追溯", ["事实ID", "指标", "有效年份数", "最小值年份", "最大值年份", "相对斜率"], "cdef")),
        F.transform("fs", lambda z: row(F.concat(F.lit("IF-"), z["indicator"]), z["indicator"], z["valid_years"].cast("string"), F.coalesce(z["min_year"].cast("string"), F.lit("—")), F.coalesce(z["max_year"].cast("string"), F.lit("—")), number_text(z["relative_slope"]))),
        lit("", "## 附录 B 证据与措施追溯", "", *_table("表 B-1 问题证据追溯", ["问题ID", "问题", "证据ID", "当前判断"])),
        F.transform("ps", lambda z: row(z["problem_id"], z["problem_name"], F.coalesce(F.nullif(F.array_join(F.concat(z["supporting_ids"], z["conflicting_ids"]), "、"), F.lit("")), F.lit("无")), z["status"])), lit(""),
    ]
    return x.select(key, F.posexplode(F.concat(*parts)).alias("ord", "text"))


def problem_blocks(contexts: DataFrame) -> DataFrame:
    """Drafts as the rules alone would write them: (key columns, title, paragraphs)."""
    return contexts.withColumns({"title": F.col("problem_name"), "paragraphs": problem_paragraphs(contexts)})


#: Fields that a writer never sees, wherever they are.
HIDDEN = ("rule_id", "provenance", "priority", "priority_assessment", "audit", "report_assets", "project_attributes")


def writer_payloads(projects: DataFrame, contexts: DataFrame, matches: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, payload): one nested document a project for whoever writes its text: reportable problems with their nested contexts, in
    order, and measures with those of their targets that are reportable; fields named in HIDDEN are gone at any depth and
    every text is ``text.writer_text``.

    *projects*: (key and what else is said of a project); *contexts*: ``analysis.contexts``; *matches*: (key, measure_id, name,
    mechanism, targets, first_target), with further columns if there are any."""
    from .analysis import nested_contexts
    from .nested import rewritten
    from .rules import INSUFFICIENT, NOT_APPLICABLE
    from .text import writer_text

    shown = contexts.where(~F.col("status").isin(INSUFFICIENT, NOT_APPLICABLE))
    full = shown.select(key, "problem_id", "problem_name", "status", "rule_id", (F.col("status") != PROMINENT).alias("later")).join(nested_contexts(shown, key), [key, "problem_id"])
    problems = full.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("later", "problem_id", "problem_name", "status", "rule_id", "analysis_features", "analysis_context"))).alias("problem_diagnoses"))
    rest = [c for c in matches.columns if c not in (key, "first_target", "measure_id", "targets")]
    offered = matches.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first_target", "measure_id", "targets", *rest))).alias("k_measures"))
    x = projects.join(problems, key, "left").join(offered, key, "left")
    ids = F.coalesce(F.transform("problem_diagnoses", lambda p: p["problem_id"]), F.array().cast("array<string>"))
    aimed = F.filter(F.transform("k_measures", lambda m: m.withField("targets", F.filter(m["targets"], lambda t: F.array_contains(ids, t)))), lambda m: F.size(m["targets"]) > 0)
    payload = F.struct(F.struct(*projects.columns).alias("project"), F.transform("problem_diagnoses", lambda p: p.dropFields("later")).alias("problem_diagnoses"), F.transform(aimed, lambda m: m.dropFields("first_target")).alias("measure_recommendations"))
    made = x.select(key, payload.alias("payload"))
    return made.select(key, rewritten(F.col("payload"), made.schema["payload"].dataType, writer_text, HIDDEN).alias("payload"))


# --- charts ---------------------------------------------------------------------------


def series_chart(series: DataFrame, key: str, names: dict[str, str], title: str, y: str = "value") -> DataFrame:
    """(key, data_json): the points of an entity's series under their *names*, in the names' order; missing values left out."""
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("indicator"))
    g = series.where(F.col("indicator").isin(list(names)) & F.col(y).isNotNull()).groupBy(key, "indicator").agg(F.array_sort(F.collect_list(F.struct("year", F.col(y).alias("value")))).alias("points"))
    one = F.struct(rank.alias("k"), lookup(names, F.col("indicator")).alias("name"), "indicator", "points")
    s = g.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("ss"))
    inner = F.transform("ss", lambda z: z.dropFields("k"))
    return s.select(key, F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(title).alias("title"), inner.alias("series"))).alias("data_json"))


def matrix_chart(problems: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, data_json): one row a reportable problem (column ord), with severity and trend as labels."""
    one = F.struct("ord", "problem_id", "problem_name", "status", labelled(SEVERITY_LABELS, F.col("severity")).alias("severity"), labelled(MATRIX_TRENDS, F.col("trend")).alias("trend"))
    g = problems.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("rows"))
    return g.select(key, F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("生态问题诊断矩阵").alias("title"), F.transform("rows", lambda r: r.dropFields("ord")).alias("rows"))).alias("data_json"))


def risk_chart(evidence: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, data_json): yearly means and the gradient's scopes that have a value, of ``risk.risk_evidence`` rows."""
    annual = F.transform("annual_series", lambda z: F.struct(z["year"].alias("year"), z["mean_ceri"].alias("value"), z["valid_scope_count"].alias("valid_scope_count")))
    gradient = F.transform(F.filter("spatial_gradient", lambda z: z["values"]["CERI"].isNotNull()), lambda z: F.struct(z["scope"].alias("scope"), z["values"]["CERI"].alias("value"), z["risk_level"].alias("risk_level")))
    body = F.struct(F.lit(1).alias("schema_version"), F.lit("综合生态风险趋势与空间梯度").alias("title"), annual.alias("annual_series"), "target_year", gradient.alias("spatial_gradient"), "source_scope")
    return evidence.select(key, F.to_json(body).alias("data_json"))
