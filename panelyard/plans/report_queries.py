"""Registered queries of reports: their texts, charts, contracts, drafts and lint, over the panel's projects."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import analysis, assembly, drafts, evidence, measures, report, risk, rules, text, trend
from ..sources import sinks, tables
from . import panel
from .more_queries import _CONTEXT_SQL, _KNOW_SQL, _MATCH_SQL, _OFFER_SQL, _OFFERS, _REP_SQL, _case, _knowledge, _offers, offer
from .panel import FACTS_SQL, PANEL_SQL
from .queries import DIAGNOSE_SQL, KEYS, _diagnoses, query
from .risk_queries import _EVIDENCE_SQL, _PI_SQL, _SPLIT_SQL, RISK_SQL, matching, records, targets, trends

_KEY = "project_key"
_LEN = "length(project_key)"


def _len() -> Column:
    return F.length(_KEY)


def _label(c: str, labels: dict[str, str]) -> str:
    return f"coalesce({_case(c, labels)}, {c})"


class State(NamedTuple):
    """What all reports are made of, as tables: yearly rows with the measures offered, facts, diagnoses, matches, contexts."""

    rows: DataFrame
    facts: DataFrame
    diagnoses: DataFrame
    matches: DataFrame
    contexts: DataFrame

    def offers(self) -> DataFrame:
        return self.rows.select(_KEY, "project_type", F.explode("offers").alias("text")).distinct()

    def years(self) -> DataFrame:
        return self.rows.groupBy(_KEY).agg(F.first("project_type").alias("project_type"), F.min("year").alias("first_year"))


def _state(spark, sf_dir) -> State:
    """The state of all projects: orders are read once, and each table is written when it is there, so that what is built on
    several of them doesn't plan and run the same chain again.  Calling this runs those jobs."""

    def written(df, name):
        path = tables.scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = written(panel.wide(spark, sf_dir, F.collect_set(offer()).alias("offers")), "rows")
    facts = written(trend.indicator_facts(trend.unpivot_panel(rows, [_KEY, "year"], panel.INDICATORS), KEYS, by=[_KEY]), "facts")
    d = written(rules.diagnose(facts, panel.projects(spark, sf_dir), rules.rule_table(spark)), "diagnoses")
    state = State(rows, facts, d, d, d)
    m = written(measures.match_knowledge(state.offers(), rules.ordered(d), _knowledge(spark)), "matches")
    return State(rows, facts, d, m, written(analysis.contexts(d, m), "contexts"))


_BASE_SQL = f"{PANEL_SQL}, {FACTS_SQL}, {DIAGNOSE_SQL}, {_KNOW_SQL}, {_OFFER_SQL}, {_MATCH_SQL}, {_CONTEXT_SQL}"
_SENTENCE = f"""{_label("indicator", report.INDICATOR_LABELS)} || '长期呈' || {_label("long_term", report.TREND_LABELS)} || '、近期呈' || {_label("recent", report.TREND_LABELS)} || '，' || CASE WHEN sup THEN '{report.SUPPORTS}' ELSE '{report.OPPOSES}' END || '。'"""
_PARAGRAPH_SQL = f"""
sg2 AS (SELECT project_key, problem_id, coalesce(string_agg({_SENTENCE}, '' ORDER BY pos) FILTER (sup), '') || coalesce(string_agg({_SENTENCE}, '' ORDER BY pos) FILTER (sup = false), '') AS evid, coalesce(list(indicator) FILTER (sup = false), []) AS against FROM ce GROUP BY ALL),
par AS (SELECT c.project_key, c.problem_id, d.problem_name, c.status, c.evidence_level, d.confidence, d.severity, c.trend, c.sid, c.cid, coalesce(against, []) AS against, matched IS NOT NULL AS is_matched,
  d.problem_name || '诊断为“' || c.status || '”，证据等级为' || c.evidence_level || '、可信度为' || {_label("d.confidence", report.CONFIDENCE_LABELS)} || '。' || coalesce(sg2.evid, '') AS p1,
  (CASE WHEN n = 0 THEN '{report.RELATIONS["unknown"]}' WHEN c.trend IN ('recently_improving', 'recently_worsening') THEN '{report.RELATIONS["divergent"]}' WHEN near > 1 THEN '{report.RELATIONS["partially_divergent"]}' ELSE '{report.RELATIONS["consistent"]}' END) || '当前判断主要反映' || labels || '的变化信号。'
    || CASE WHEN c.status IN ('数据不足', '不适用') THEN '' ELSE '{analysis.CANNOT_TELL}' END || '{analysis.NO_CAUSES}' AS p2, (CASE WHEN matched IS NULL THEN '{report.UNMATCHED}' ELSE '{report.MATCHED}' END) || '{analysis.NO_PLACES}' AS p3
  FROM cx c JOIN diag d USING (project_key, problem_id) LEFT JOIN sg2 USING (project_key, problem_id) LEFT JOIN mm USING (project_key, problem_id))"""


@query(f"WITH {_BASE_SQL}, {_PARAGRAPH_SQL} SELECT project_key, problem_id, p1, p2, p3 FROM par")
def problem_paragraphs(spark, sf_dir):
    """The three paragraphs of every problem, codes decoded."""
    c = _state(spark, sf_dir).contexts
    c = c.withColumn("ps", report.problem_paragraphs(c))
    return c.select(_KEY, "problem_id", *[F.col("ps")[k].alias(f"p{k + 1}") for k in range(3)])


_NUM = "CASE WHEN {0} IS NULL THEN '—' WHEN abs({0}) >= 1e6 OR (abs({0}) < 0.01 AND {0} <> 0) THEN printf('%.2e', {0}) ELSE printf('%.2f', {0} + 0) END"
_N = "chr(10)"


def _head(title: str, names: list[str], right: str = "") -> str:
    return " || chr(10) || ".join(f"'{x}'" for x in report._table(title, names, right))


def _agg(inner: str) -> str:
    return f"coalesce(string_agg({inner} || chr(10), '' ORDER BY k), '')"


_REPORT_SQL = f"""{_PARAGRAPH_SQL},
pj AS (SELECT project_key, any_value(project_type) AS project_type, min("year") AS first_year, 2001 AS target_year, CASE WHEN {_LEN} % 2 = 0 THEN 'III_中风险' END AS risk_level FROM wide GROUP BY 1),
po AS (SELECT par.*, rep.ord AS k FROM par JOIN rep USING (project_key, problem_id)),
ra AS (SELECT project_key, 1 FROM pj),
fa AS (SELECT project_key, count(*) AS nf, string_agg(indicator, '、' ORDER BY indicator) FILTER (valid) AS av, string_agg(indicator, '、' ORDER BY indicator) FILTER (NOT valid) AS mi,
  string_agg('| ' || {_label("indicator", report.INDICATOR_LABELS)} || ' | ' || {_NUM.format("cv")} || ' | ' || {_label("long_term", report.TREND_LABELS)} || ' | ' || {_label("recent", report.TREND_LABELS)} || ' | ' || CASE WHEN valid THEN '充分' ELSE '不足' END || ' |' || chr(10), '' ORDER BY indicator) AS t21,
  string_agg('| IF-' || indicator || ' | ' || indicator || ' | ' || n || ' | ' || coalesce(loy::VARCHAR, '—') || ' | ' || coalesce(hiy::VARCHAR, '—') || ' | ' || {_NUM.format("(CASE WHEN valid THEN rsl END)")} || ' |' || chr(10), '' ORDER BY indicator) AS ta FROM facts GROUP BY 1),
pa AS (SELECT project_key, count(*) AS np, count(*) FILTER (status = '突出问题') AS na, coalesce(string_agg('### 3.' || k || ' ' || problem_name || chr(10) || chr(10) || p1 || chr(10) || chr(10) || p2 || chr(10) || chr(10) || p3 || chr(10) || chr(10), '' ORDER BY k) FILTER (status = '突出问题'), '') AS s3,
  coalesce(string_agg('| ' || problem_name || ' | ' || status || ' | ' || {_label("trend", report.TREND_LABELS)} || ' | ' || evidence_level || ' |' || chr(10), '' ORDER BY k) FILTER (status <> '突出问题'), '') AS t41,
  {_agg(f"'| ' || problem_name || ' | ' || CASE WHEN status = '突出问题' THEN status ELSE '持续观察' END || ' | ' || status || ' | ' || {_label('severity', report.SEVERITY_LABELS)} || ' | ' || {_label('trend', report.TREND_LABELS)} || ' | ' || {_label('confidence', report.CONFIDENCE_LABELS)} || ' |'")} AS t51,
  {_agg("'| ' || problem_id || ' | ' || problem_name || ' | ' || coalesce(nullif(concat_ws('、', replace(nullif(sid, ''), ',', '、'), replace(nullif(cid, ''), ',', '、')), ''), '无') || ' | ' || status || ' |'")} AS tb,
  string_agg(problem_name, '、' ORDER BY k) FILTER (status = '突出问题' AND NOT is_matched) AS bare FROM po GROUP BY 1),
mn AS (SELECT m1.project_key, m1.measure_id, min(first) AS first, string_agg(d.problem_name, '、' ORDER BY m1.ord) AS names FROM m1 JOIN diag d ON d.project_key = m1.project_key AND d.problem_id = m1.problem_id GROUP BY ALL),
ma AS (SELECT mn.project_key, count(*) AS nm, string_agg('| ' || mn.measure_id || ' | ' || k.name || ' | ' || names || ' | mechanism ' || substr(k.name, 7) || ' |' || chr(10), '' ORDER BY first, mn.measure_id) AS t61 FROM mn JOIN know k USING (measure_id) GROUP BY 1),
rp3 AS (SELECT pj.project_key, '# 生态状况智能诊断与修复决策报告' || {_N} || {_N} || pj.project_key || ' ' || target_year || '年度生态诊断' || {_N} || {_N} || '评价年份：' || target_year || {_N} || {_N} || '生成日期：2026-01-01' || {_N} || {_N} || '<!-- pagebreak -->' || {_N} || {_N} || '## 摘要' || {_N} || {_N}
  || '本报告基于' || first_year || '—' || target_year || '年项目指标，对证据充分且适用于本项目的生态问题进行分析。' || CASE WHEN risk_level IS NULL THEN '基底数据未提供综合风险等级，本报告不据指标趋势另行推定。' ELSE '当前综合风险等级为' || risk_level || '。' END || {_N} || {_N} || '{report.CONTROLLED}' || {_N} || {_N}
  || '**关键词：** 生态诊断；指标趋势；生态修复；证据追溯' || {_N} || {_N} || '<!-- pagebreak -->' || {_N} || {_N} || '## 目录' || {_N} || {_N} || '<!-- toc -->' || {_N} || {_N} || '<!-- pagebreak -->' || {_N} || {_N} || '## 1 项目与评价基础' || {_N} || {_N} || '### 1.1 项目基本信息' || {_N} || {_N} || {_head("表 1-1 项目基本信息", ["项目", "内容"])} || {_N}
  || '| 项目名称 | ' || pj.project_key || ' |' || {_N} || '| 项目类型 | ' || {_label("project_type", report.TYPE_LABELS)} || ' |' || {_N} || '| 评价时段 | ' || first_year || '—' || target_year || '年 |' || {_N} || {_N} || '### 1.2 数据完整性' || {_N} || {_N} || {_head("表 1-2 数据完整性", ["指标范围", "内容"])} || {_N}
  || '| 可用指标 | ' || coalesce(av, '') || ' |' || {_N} || '| 数据不足指标 | ' || coalesce(mi, '无') || ' |' || {_N} || {_N} || '## 2 综合生态状况' || {_N} || {_N}
  || CASE WHEN risk_level IS NULL THEN '基底数据未提供综合风险等级，本报告不生成总体风险等级。' ELSE target_year || '年项目综合风险等级为' || risk_level || '。' END || '本次报告讨论' || coalesce(na, 0) || '项突出问题和' || coalesce(np - na, 0) || '项需要持续观察的问题。' || {_N} || {_N} || '### 2.1 指标概览' || {_N} || {_N} || {_head("表 2-1 指标趋势概览", ["指标", "当前值", "长期趋势", "最近变化", "数据质量"], "b")} || {_N} || t21
  || {_N} || '## 3 突出生态问题' || {_N} || {_N} || CASE WHEN coalesce(na, 0) = 0 THEN '{report.NO_PROMINENT}' || {_N} || {_N} ELSE '' END || coalesce(s3, '') || '## 4 持续观察的潜在问题' || {_N} || {_N} || {_head("表 4-1 持续观察问题汇总", ["问题", "当前判断", "趋势", "证据等级"])} || {_N} || coalesce(t41, '')
  || {_N} || '## 5 生态问题综合诊断' || {_N} || {_N} || '综合解释应识别跨问题共同信号、维度差异和当前主要生态矛盾。' || {_N} || {_N} || {_head("表 5-1 生态问题综合诊断", ["问题", "问题类别", "当前判断", "严重程度", "问题趋势", "可信度"])} || {_N} || coalesce(t51, '')
  || {_N} || '## 6 生态修复策略' || {_N} || {_N} || {_head("表 6-1 受控修复措施及来源", ["措施ID", "措施", "对应问题", "作用机制"])} || {_N} || coalesce(t61, '') || CASE WHEN bare IS NULL THEN '' ELSE {_N} || '现有候选措施和结构化知识库未能为' || bare || '形成合规匹配；本报告不据此新增措施。' || {_N} END
  || {_N} || '## 7 综合修复建议' || {_N} || {_N} || '现有措施只说明与相应生态问题的匹配关系。具体位置、工程量、密度、经费和工期需在现场调查及工程设计后确定。' || {_N} || {_N} || '## 8 结论' || {_N} || {_N} || '本次评价形成' || nf || '项指标事实，正文讨论' || coalesce(np, 0) || '项生态问题，并列出' || coalesce(nm, 0) || '条已通过合规匹配的措施。' || {_N}
  || {_N} || '## 附录 A 指标趋势结果' || {_N} || {_N} || {_head("表 A-1 指标趋势与来源追溯", ["事实ID", "指标", "有效年份数", "最小值年份", "最大值年份", "相对斜率"], "cdef")} || {_N} || ta || {_N} || '## 附录 B 证据与措施追溯' || {_N} || {_N} || {_head("表 B-1 问题证据追溯", ["问题ID", "问题", "证据ID", "当前判断"])} || {_N} || coalesce(tb, '') AS markdown
  FROM pj JOIN fa USING (project_key) LEFT JOIN pa USING (project_key) LEFT JOIN ma USING (project_key))"""
_REPORT_SQL = _REPORT_SQL.replace("ra AS (SELECT project_key, 1 FROM pj),\n", "")


def _reports(spark, sf_dir, state=None):
    state = state or _state(spark, sf_dir)
    _, facts, d, m, c = state
    order = rules.ordered(d).select(_KEY, "problem_id", "ord")
    projects = state.years().withColumns({"target_year": F.lit(2001), "name": F.col(_KEY), "risk_level": F.when(_len() % 2 == 0, "III_中风险")})
    return report.assemble(report.report_lines(projects, facts, c.join(order, [_KEY, "problem_id"]), m, "2026-01-01"))


@query(f"WITH {_BASE_SQL}, {_REPORT_SQL} SELECT project_key, markdown FROM rp3")
def report_entry(spark, sf_dir):
    """The whole report text of every project, in order; the run's date is a parameter."""
    return _reports(spark, sf_dir).select(_KEY, "markdown")


@query(f"""WITH {_BASE_SQL}, {_REPORT_SQL}, im AS (SELECT project_key, replace(markdown, '<!-- pagebreak -->', '![a](b/c.png)') || CASE WHEN {_LEN} % 5 = 0 THEN 'http://x' ELSE '' END AS t, CASE WHEN {_LEN} % 3 = 0 THEN 4 ELSE 3 END AS charts FROM rp3),
isp AS (SELECT project_key, charts, t, string_split(t, '![a](b/c.png)') AS p FROM im), ie AS (SELECT project_key, charts, t, unnest(p) AS x, generate_subscripts(p, 1) AS i, len(p) - 1 AS n FROM isp)
SELECT project_key, CASE WHEN n <> charts THEN 'expected ' || charts || ' images, found ' || n WHEN contains(t, 'http://') THEN 'url remains' END AS issue, sha256(string_agg(CASE WHEN i = 1 THEN x ELSE '{{{{chart:' || (i - 1) || '}}}}' || x END, '' ORDER BY i)) AS digest FROM ie GROUP BY ALL""")
def export_placeholders(spark, sf_dir):
    """Reports with numbered placeholders for images, and why one can't go out (count of charts, URLs left)."""
    t = F.concat(F.replace("markdown", F.lit("<!-- pagebreak -->"), F.lit("![a](b/c.png)")), F.when(_len() % 5 == 0, "http://x").otherwise(""))
    x = _reports(spark, sf_dir).withColumn("t", t)
    return x.select(_KEY, text.export_issue(F.col("t"), F.when(_len() % 3 == 0, 4).otherwise(3)).alias("issue"), F.sha2(text.chart_placeholders(F.col("t")), 256).alias("digest"))


_FLAWED_SQL = f"""fl AS (SELECT project_key, replace(replace(replace(replace(markdown, '## 目录', CASE WHEN {_LEN} % 3 = 0 THEN '## 无' ELSE '## 目录' END), '**关键词：**', CASE WHEN {_LEN} % 4 = 0 THEN '词' ELSE '**关键词：**' END), 'P013', CASE WHEN {_LEN} % 5 = 0 THEN 'P1级 PR-P013' ELSE 'P013' END), '## 8 结论', '## 8 结论' || CASE {_LEN} % 6 WHEN 0 THEN ' 种植120株，面积 3.5公顷' WHEN 1 THEN ' 由于开采导致退化，极其严重' WHEN 2 THEN ' 综合风险等级为None' WHEN 3 THEN ' Brand#3 JSON' WHEN 4 THEN ' 图 2-3，2.2 综合生态风险证据' ELSE ' 外来物种扩散' END) AS text FROM rp3)"""


def _flawed(spark, sf_dir, state):
    """Reports with flaws by rule: headings and elements that lack, codes, parameters, causes, nulls, measures."""
    k = _len()
    t = F.replace("markdown", F.lit("## 目录"), F.when(k % 3 == 0, "## 无").otherwise("## 目录"))
    t = F.replace(t, F.lit("**关键词：**"), F.when(k % 4 == 0, "词").otherwise("**关键词：**"))
    t = F.replace(t, F.lit("P013"), F.when(k % 5 == 0, "P1级 PR-P013").otherwise("P013"))
    said = F.when(k % 6 == 0, " 种植120株，面积 3.5公顷").when(k % 6 == 1, " 由于开采导致退化，极其严重").when(k % 6 == 2, " 综合风险等级为None").when(k % 6 == 3, " Brand#3 JSON").when(k % 6 == 4, " 图 2-3，2.2 综合生态风险证据").otherwise(" 外来物种扩散")
    return _reports(spark, sf_dir, state).select(_KEY, F.replace(t, F.lit("## 8 结论"), F.concat(F.lit("## 8 结论"), said)).alias("text"))


def _lint_sql(rules_: list[tuple[str, str, str]]) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    out = []
    for code, how, x in rules_:
        if how == "each":
            out.append(f"SELECT project_key, '{code}' AS code, unnest(regexp_extract_all(text, {q('(^|[^0-9.])(' + x + ')')}, 2)) AS detail FROM fl")
        elif how == "any":
            x = x.replace("P[0-3](?!\\d)", "P[0-3]($|[^0-9])")
            out.append(f"SELECT project_key, '{code}', " + ("CASE WHEN contains(text, '优先级') THEN '优先级' ELSE regexp_extract(text, 'P[0-3]级') END" if "优先级" in x else f"regexp_extract(text, {q(x)})") + f" FROM fl WHERE regexp_matches(text, {q(x)})")
        elif how == "has":
            out.append(f"SELECT project_key, '{code}', {q(x)} FROM fl WHERE contains(text, {q(x)})")
        elif how == "lacks":
            out.append(f"SELECT project_key, '{code}', {q(x)} FROM fl WHERE NOT contains(text, {q(x)})")
        else:
            out.append(f"SELECT project_key, '{code}', {q(x)} FROM fl WHERE NOT regexp_matches(text, {q('(?m)^#{2,4}' + chr(92) + 's+' + x.replace('.', '[.]') + chr(92) + 's*$')})")
    return "SELECT project_key, code, detail FROM (SELECT NULL AS project_key, NULL AS code, NULL AS detail WHERE false UNION ALL " + " UNION ALL ".join(out) + ")"


_PHRASE_SQL = "ph AS (SELECT o.project_key, o.text AS phrase FROM offer o LEFT JOIN mn ON mn.project_key = o.project_key LEFT JOIN know k ON k.measure_id = mn.measure_id AND k.name = o.text GROUP BY ALL HAVING count(k.measure_id) = 0)"


@query(f"""WITH {_BASE_SQL}, {_REPORT_SQL}, {_FLAWED_SQL}, {_PHRASE_SQL}, {RISK_SQL}, {_SPLIT_SQL}, {_PI_SQL} {_lint_sql(text.lint_rules(1))} UNION ALL SELECT ph.project_key, 'rejected_measure_present', phrase FROM ph JOIN fl USING (project_key) WHERE contains(fl.text, phrase)
UNION ALL SELECT DISTINCT rt.project_key, 'unsupported_risk_present', risk FROM rt JOIN fl USING (project_key) WHERE risk NOT IN (SELECT risk FROM pi) AND contains(fl.text, risk)""")
def report_lint_v1(spark, sf_dir):
    """What the older lint finds in flawed reports: headings, sections, parameters, exaggeration, causes, measures, risks that
    nothing stands behind."""
    state = _state(spark, sf_dir)
    said = evidence.reported(matching(panel.projects(spark, sf_dir)))
    risks = said.where(~F.col("risk").isin(list(evidence.RISK_INDICATORS))).select(_KEY, F.lit("unsupported_risk_present").alias("code"), F.col("risk").alias("phrase"))
    phrases = _unapproved(state).select(_KEY, F.lit("rejected_measure_present").alias("code"), "phrase").unionByName(risks)
    return text.lint(_flawed(spark, sf_dir, state), [_KEY], text.lint_rules(1), phrases=phrases)


def _unapproved(state):
    """Measures that a project was offered but that its report may not name."""
    m = state.matches.select(_KEY, F.col("name").alias("phrase"))
    return state.offers().select(_KEY, F.col("text").alias("phrase")).join(m, [_KEY, "phrase"], "left_anti")


@query(f"""WITH {_BASE_SQL}, {_REPORT_SQL}, {_FLAWED_SQL}, {_PHRASE_SQL} {_lint_sql(text.lint_rules(2))} UNION ALL SELECT ph.project_key, 'unapproved_measure', phrase FROM ph JOIN fl USING (project_key) WHERE contains(fl.text, phrase)
UNION ALL SELECT d.project_key, 'omitted_problem_leaked', d.problem_name FROM diag d JOIN fl USING (project_key) WHERE d.status IN ('数据不足', '不适用') AND contains(fl.text, d.problem_name) AND NOT (d.problem_id = 'P013' AND {_LEN} % 3 = 0)
UNION ALL SELECT project_key, 'missing_heading', '{text.RISK_HEADING}' FROM fl WHERE {_LEN} % 3 = 0 AND NOT contains(text, '{text.RISK_HEADING}') UNION ALL SELECT project_key, 'missing_report_element', '图 2-3' FROM fl WHERE NOT contains(text, '图 2-3') UNION ALL SELECT project_key, 'missing_report_element', '图 5-1' FROM fl WHERE {_LEN} % 2 = 0 AND NOT contains(text, '图 5-1')""")
def report_lint_v2(spark, sf_dir):
    """What the later lint finds: headings and elements (some only if a report has risk evidence or a chart), machine and priority
    language, leaked problems (P013 may be named where there is risk evidence) and measures."""
    state = _state(spark, sf_dir)
    has_risk = _len() % 3 == 0
    needed = text.required(state.years().select(_KEY, has_risk.alias("has_risk"), F.when(_len() % 2 == 0, F.array(*map(F.lit, text.FIGURES))).otherwise(F.array(F.lit("figure-2-3"), F.lit("other"))).alias("charts")), [_KEY])
    omitted = state.diagnoses.where(F.col("status").isin(rules.INSUFFICIENT, rules.NOT_APPLICABLE) & ~((F.col("problem_id") == "P013") & has_risk))
    d = omitted.select(_KEY, F.lit("omitted_problem_leaked").alias("code"), F.col("problem_name").alias("phrase"))
    phrases = _unapproved(state).select(_KEY, F.lit("unapproved_measure").alias("code"), "phrase").unionByName(d)
    return text.lint(_flawed(spark, sf_dir, state), [_KEY], text.lint_rules(2), phrases=phrases, needed=needed)


# --- drafts ---------------------------------------------------------------------------

_ORD = f"({_LEN} * 3 + substr(problem_id, 2)::INT)"
_DRAFT_SQL = f"""{_PARAGRAPH_SQL}, pr2 AS (SELECT *, {_ORD} AS h FROM par WHERE status NOT IN ('数据不足', '不适用')),
dr AS (SELECT project_key, problem_id, CASE WHEN h % 8 = 1 THEN '标题' ELSE problem_name END AS title, CASE h % 7 WHEN 0 THEN [p2] WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN [p1, p2, p3 || repeat(p2, 5)] WHEN 3 THEN [p1 || '可能由于降水导致。', p2] WHEN 4 THEN [replace(p1, '反向', ''), p3] ELSE [p1, p2, p3] END AS ps FROM pr2 WHERE h % 9 <> 0
  UNION ALL SELECT project_key, problem_id, problem_name, [p1] FROM par WHERE status = '不适用' AND {_ORD} % 4 = 0),
ds AS (SELECT c.project_key, c.problem_id, c.problem_name, c.status = '突出问题' AS prominent, against, title, ps, array_to_string(ps, '') AS said, dr.project_key IS NOT NULL AS has, c.p1, c.p2, c.p3 FROM pr2 c LEFT JOIN dr USING (project_key, problem_id)),
dw AS (SELECT *, length(said) AS len, len(against) = 0 OR (len(list_filter(against, lambda i: contains(said, i) OR contains(said, {_label("i", report.INDICATOR_LABELS)}))) > 0 AND regexp_matches(said, '{assembly.WEIGHING}')) AS weighed, CASE WHEN prominent THEN 350 ELSE 80 END AS floor FROM ds)"""


def _drafts(spark, sf_dir):
    """(reportable contexts, drafts of their texts, with faults by rule)."""
    c = _state(spark, sf_dir).contexts
    h = _len() * 3 + F.substring("problem_id", 2, 3).cast("int")
    x = report.problem_blocks(c).withColumns({"h": h, "p": F.col("paragraphs")})
    p = [F.col("p")[k] for k in range(3)]
    ps = (
        F.when(h % 7 == 0, F.array(p[1])).when(h % 7 == 1, F.array().cast("array<string>")).when(h % 7 == 2, F.array(p[0], p[1], F.concat(p[2], F.repeat(p[1], 5)))).when(h % 7 == 3, F.array(F.concat(p[0], F.lit("可能由于降水导致。")), p[1]))
        .when(h % 7 == 4, F.array(F.replace(p[0], F.lit("反向"), F.lit("")), p[2])).otherwise(F.col("p"))
    )
    seen = ~F.col("status").isin(rules.INSUFFICIENT, rules.NOT_APPLICABLE)
    mine = x.where(seen & (h % 9 != 0)).select(_KEY, "problem_id", F.when(h % 8 == 1, "标题").otherwise(F.col("title")).alias("title"), ps.alias("paragraphs"))
    alien = x.where((F.col("status") == rules.NOT_APPLICABLE) & (h % 4 == 0)).select(_KEY, "problem_id", "title", F.array(p[0]).alias("paragraphs"))
    return c.where(seen), mine.unionByName(alien)


@query(f"""WITH {_BASE_SQL}, {_DRAFT_SQL} SELECT project_key, 'problem_block_mismatch' AS code, problem_id AS detail FROM ds WHERE NOT has UNION ALL SELECT project_key, 'problem_block_mismatch', problem_id FROM dr WHERE NOT EXISTS (SELECT 1 FROM pr2 WHERE pr2.project_key = dr.project_key AND pr2.problem_id = dr.problem_id)
UNION ALL SELECT project_key, 'invalid_problem_title', problem_id FROM ds WHERE has AND NOT contains(title, problem_name) UNION ALL SELECT project_key, 'invalid_problem_paragraphs', problem_id FROM ds WHERE has AND len(ps) = 0
UNION ALL SELECT project_key, 'problem_analysis_too_shallow', problem_id || ':' || len || '<' || floor FROM dw WHERE has AND len(ps) > 0 AND len < floor UNION ALL SELECT project_key, 'counter_evidence_omitted', problem_id FROM dw WHERE has AND len(ps) > 0 AND NOT weighed""")
def draft_issues(spark, sf_dir):
    """Faults of drafted problem texts."""
    c, d = _drafts(spark, sf_dir)
    return assembly.draft_issues(d, c)


@query(f"WITH {_BASE_SQL}, {_DRAFT_SQL}, b AS (SELECT *, CASE WHEN prominent THEN 800 ELSE 200 END AS low, CASE WHEN prominent THEN 1500 ELSE 500 END AS high FROM dw WHERE has) SELECT project_key, problem_id, len::INT AS length, low, high FROM b WHERE len < low OR len > high")
def draft_lengths(spark, sf_dir):
    """Drafts outside the recommended lengths, by whether the problem is prominent."""
    c, d = _drafts(spark, sf_dir)
    return assembly.length_warnings(d, c)


_BAD = "|".join([*(f"(?:{p})" for p in text.FORBIDDEN_WRITING), "(?i:" + text.MACHINE.removeprefix("(?i)") + ")", f"(?:{text.PRIORITY})"]).replace("'", "''")
_CLEAN = "array_to_string(list_filter(regexp_extract_all(@, '[^。！？；\n]+[。！？；]?|\n+'), lambda z: NOT regexp_matches(z, '" + _BAD + "')), '')"


@query(f"""WITH {_BASE_SQL}, {_DRAFT_SQL}, cl AS (SELECT *, list_filter([{_CLEAN.replace("@", "t")} for t in ps], lambda x: x <> '') AS cps, regexp_matches(said, '{_BAD}') AS hit, {_CLEAN.replace("@", "p1 || p2 || p3")} AS own FROM dw WHERE has),
c2 AS (SELECT *, array_to_string(cps, '') AS cs FROM cl),
c3 AS (SELECT *, coalesce(hit, false) OR length(cs) < floor OR NOT (len(against) = 0 OR (len(list_filter(against, lambda i: contains(cs, i) OR contains(cs, {_label("i", report.INDICATOR_LABELS)}))) > 0 AND regexp_matches(cs, '{assembly.WEIGHING}'))) AS replaced FROM c2)
SELECT project_key, problem_id, problem_name AS title, CASE WHEN replaced THEN own || repeat('{report.BOUNDARY}', greatest(0, ceil((floor - length(own)) / {len(report.BOUNDARY)}))::INT) ELSE cs END AS text, replaced FROM c3""")
def repaired_drafts(spark, sf_dir):
    """X11: drafts without offending sentences, or the rules' own text where too little is left."""
    c, d = _drafts(spark, sf_dir)
    return assembly.repaired_drafts(d, c).select(_KEY, "problem_id", "title", F.array_join("paragraphs", "").alias("text"), "replaced")


@query(f"""WITH {_BASE_SQL}, {_PARAGRAPH_SQL}, w AS (SELECT project_key, problem_id, '规则ID为PR-' || problem_id || '，' || p1 || '结论基于2项规则指定指标证据。可能受到气候导致。' || p2 || 'has_buffer_gradient，建议开展监测。' AS t FROM par WHERE status NOT IN ('数据不足', '不适用')),
r0 AS (SELECT project_key, problem_id, regexp_replace(regexp_replace(regexp_replace(t, '规则ID为PR-P\\d+[，,]?\\s*', '', 'g'), '规则\\s*(?:ID\\s*)?为?\\s*PR-P\\d+\\s*指定', '既定条件指定', 'g'), 'PR-P\\d+', '', 'g') AS t FROM w),
r1 AS (SELECT project_key, problem_id, {"".join("replace(" for _ in text.WRITER_WORDS)}t{"".join(f", '{a}', '{b}')" for a, b in text.WRITER_WORDS.items())} AS t FROM r0)
SELECT project_key, problem_id, {"".join("regexp_replace(" for _ in text.WRITER_SENTENCES)}t{"".join(f", '{p}', '{text.CANNOT_JUDGE}', 'g')" for p in text.WRITER_SENTENCES)} AS text FROM r1""")
def writer_payload(spark, sf_dir):
    """What a writer may see: reportable problems only, without rule ids, codes replaced, guesses rewritten."""
    c = _state(spark, sf_dir).contexts
    c = c.where(~F.col("status").isin(rules.INSUFFICIENT, rules.NOT_APPLICABLE)).withColumn("p", report.problem_paragraphs(c))
    t = F.concat(F.lit("规则ID为PR-"), "problem_id", F.lit("，"), F.col("p")[0], F.lit("结论基于2项规则指定指标证据。可能受到气候导致。"), F.col("p")[1], F.lit("has_buffer_gradient，建议开展监测。"))
    return c.drop("rule_id").select(_KEY, "problem_id", text.writer_text(t).alias("text"))


@query(f"""WITH {_BASE_SQL}, ms AS (SELECT project_key, string_agg(measure_id || ':' || ts, ';' ORDER BY first, measure_id) AS measures FROM (SELECT project_key, measure_id, min(ord) AS first, string_agg(problem_id, ',' ORDER BY ord) AS ts FROM mt GROUP BY ALL) GROUP BY 1)
SELECT cx.project_key, rep.ord::INT AS place, cx.problem_id, cx.status, '{analysis.EXPLANATIONS["basis", "basis_summary"].replace("规则指定指标", "核心指标")}' AS summary, '结论基于' || n || '项核心指标证据。' AS reason, coalesce(ms.measures, '') AS measures
FROM cx JOIN rep USING (project_key, problem_id) LEFT JOIN ms USING (project_key)""")
def writer_documents(spark, sf_dir):
    """The whole nested payload of every project, read back problem by problem: every text rewritten, hidden fields gone at any
    depth, measures with reportable targets only."""
    s = _state(spark, sf_dir)
    hidden = s.matches.withColumns({"priority": F.lit(1), "targets": F.concat("targets", F.array(F.lit("P099")))})
    made = report.writer_payloads(s.years().withColumn("project_attributes", F.lit("x")), s.contexts, hidden)
    if any(f"{name}:" in made.schema["payload"].dataType.simpleString() for name in report.HIDDEN):
        raise AssertionError("a hidden field is left")
    m = F.array_join(F.transform("payload.measure_recommendations", lambda z: F.concat(z["measure_id"], F.lit(":"), F.array_join(z["targets"], ","))), ";")
    each = made.select(_KEY, F.coalesce(m, F.lit("")).alias("measures"), F.posexplode("payload.problem_diagnoses").alias("k", "p"))
    c = F.col("p.analysis_context")
    return each.select(_KEY, (F.col("k") + 1).alias("place"), "p.problem_id", "p.status", c["basis"]["basis_summary"].alias("summary"), c["uncertainty"]["confidence_reason"].alias("reason"), "measures")


_LOCKED = ["features", "relationship", "supporting_ids", "conflicting_ids", "stable_ids", "turning_points", "long_recent_relation", "support_strength", "counter_strength", "overall_balance", "dimensions", "match_status"]


@query(f"""WITH {_BASE_SQL}, s AS (SELECT project_key, problem_id, n, a, sid, tp, {_ORD} AS h FROM cx), d AS (SELECT *, CASE WHEN h % 5 = 0 THEN 'x' ELSE sid END AS dsid, CASE WHEN h % 7 = 0 THEN tp || '1' ELSE tp END AS dtp FROM s)
SELECT project_key, problem_id, 'missing' AS code, '*' AS field FROM d WHERE h % 11 = 0 UNION ALL SELECT project_key, problem_id, 'changed', 'supporting_ids' FROM d WHERE h % 11 <> 0 AND sid <> dsid UNION ALL SELECT project_key, problem_id, 'changed', 'turning_points' FROM d WHERE h % 11 <> 0 AND tp <> dtp
UNION ALL SELECT project_key, problem_id, 'unknown_analysis_feature', 'own_idea' FROM d WHERE h % 11 <> 0 AND h % 13 = 0""")
def locked_context(spark, sf_dir):
    """Locked facts of the context that drafts changed or lost, and features that no draft may name."""
    c = _state(spark, sf_dir).contexts.select(_KEY, "problem_id", *_LOCKED)
    h = _len() * 3 + F.substring("problem_id", 2, 3).cast("int")
    d = c.where(h % 11 != 0).withColumns({"supporting_ids": F.when(h % 5 == 0, F.array(F.lit("x"))).otherwise(F.col("supporting_ids")), "turning_points": F.when(h % 7 == 0, F.concat("turning_points", F.array(F.lit(1)))).otherwise(F.col("turning_points"))})
    named = d.withColumn("features", F.when(h % 13 == 0, F.concat("features", F.array(F.lit("own_idea")))).otherwise(F.col("features")))
    wrong = analysis.draft_feature_issues(named, [_KEY, "problem_id"]).withColumnRenamed("detail", "field")
    return analysis.locked_changes(c, d, _LOCKED, [_KEY, "problem_id"]).unionByName(wrong)


@query(f"""WITH {_BASE_SQL}, s AS (SELECT cx.*, {_ORD} AS h, split_part(mm.matched, ',', 1) AS m1 FROM cx LEFT JOIN mm USING (project_key, problem_id)),
a AS (SELECT * FROM s WHERE h % 11 <> 0), b AS (SELECT * FROM a WHERE h % 7 <> 2)
SELECT project_key, problem_id, 'analysis_problem_mismatch' AS code, 'missing' AS detail FROM s WHERE h % 11 = 0 UNION ALL SELECT project_key, 'P099', 'analysis_problem_mismatch', 'unexpected' FROM s WHERE problem_id = 'P002' AND {_LEN} % 4 = 0 AND h % 11 <> 0
UNION ALL SELECT project_key, problem_id, CASE WHEN h % 17 = 0 THEN 'invalid_analysis_features' ELSE 'unknown_analysis_feature' END, CASE WHEN h % 17 = 0 THEN '' ELSE 'own_idea' END FROM a WHERE h % 17 = 0 OR h % 13 = 0
UNION ALL SELECT project_key, problem_id, 'invalid_analysis_context', 'restoration' FROM a WHERE h % 7 = 2
UNION ALL SELECT project_key, problem_id, 'analysis_changed_locked_fact', 'indicator_synthesis.supporting_signals[' || split_part(sid, ',', 1) || '].recent:changed' FROM b WHERE h % 5 = 0 AND sid <> ''
UNION ALL SELECT project_key, problem_id, 'analysis_changed_locked_fact', 'temporal.turning_points:changed' FROM b WHERE h % 7 = 1
UNION ALL SELECT project_key, problem_id, 'analysis_changed_locked_fact', 'restoration.matched_measures[' || m1 || '].name:changed' FROM b WHERE h % 7 = 3 AND m1 IS NOT NULL
UNION ALL SELECT project_key, problem_id, 'analysis_changed_locked_fact', 'indicator_synthesis.conflicting_signals[' || string_split(cid, ',')[-1] || ']:removed' FROM b WHERE h % 7 = 4 AND cid <> ''
UNION ALL SELECT project_key, problem_id, 'analysis_missing_locked_fact', 'restoration.implementation_limits:missing' FROM b WHERE h % 7 = 5
UNION ALL SELECT project_key, problem_id, 'missing_analysis_explanation', 'temporal.summary' FROM b WHERE h % 3 = 0
UNION ALL SELECT project_key, problem_id, 'invalid_interpretation', 'primary_finding' FROM b WHERE h % 4 = 1 UNION ALL SELECT project_key, problem_id, 'invalid_uncertainty', 'confidence_reason' FROM b WHERE h % 4 = 2""")
def analysis_issues(spark, sf_dir):
    """Whole nested contexts against drafts of them that are wrong at every depth: lost problems and sections, changed, lost
    and removed facts with their paths, explanations and interpretations that lack."""
    seeds = analysis.nested_contexts(_state(spark, sf_dir).contexts)
    h = _len() * 3 + F.substring("problem_id", 2, 3).cast("int")
    c = F.col("analysis_context")
    first = lambda part, field, new: F.transform(part, lambda z, i: F.when(i == 0, z.withField(field, new(z[field]))).otherwise(z))
    signals, against, years = c["indicator_synthesis"]["supporting_signals"], c["indicator_synthesis"]["conflicting_signals"], c["temporal"]["turning_points"]
    steps = [
        (h % 5 == 0, "indicator_synthesis.supporting_signals", first(signals, "recent", lambda _: F.lit("sideways"))), (h % 7 == 1, "temporal.turning_points", F.concat(years, F.array(F.lit(1)))),
        (h % 7 == 3, "restoration.matched_measures", first(c["restoration"]["matched_measures"], "name", lambda n: F.concat(n, F.lit("!")))), (h % 7 == 4, "indicator_synthesis.conflicting_signals", F.slice(against, F.lit(1), F.greatest(F.size(against) - 1, F.lit(0)))),
        (h % 7 == 5, "restoration.implementation_limits", F.lit(None).cast("array<string>")), (h % 3 == 0, "temporal.summary", F.lit(" ")), (h % 4 == 1, "interpretation.primary_finding", F.lit(None).cast("string")), (h % 4 == 2, "uncertainty.confidence_reason", F.lit(None).cast("string")),
        (h % 7 == 2, "restoration", F.lit(None).cast(seeds.schema["analysis_context"].dataType["restoration"].dataType)),
    ]
    drafts = seeds.where(h % 11 != 0)
    for test, path, new in steps:
        section, *field = path.split(".")
        drafts = drafts.withColumn("analysis_context", F.when(test, c.withField(section, c[section].withField(field[0], new) if field else new)).otherwise(c))
    feature = F.when(h % 17 == 0, F.array().cast("array<string>")).when(h % 13 == 0, F.concat("analysis_features", F.array(F.lit("own_idea")))).otherwise(F.col("analysis_features"))
    more = drafts.where((F.col("problem_id") == "P002") & (_len() % 4 == 0)).withColumn("problem_id", F.lit("P099"))
    return analysis.analysis_issues(seeds, drafts.withColumn("analysis_features", feature).unionByName(more))


@query(f"""WITH {_BASE_SQL}, {_REP_SQL}, t AS (SELECT project_key, {_LEN} % 6 AS h, min(dimension) AS dim FROM rp GROUP BY 1), sh AS (SELECT project_key, min(indicator) AS ind FROM (SELECT project_key, indicator FROM rp GROUP BY ALL HAVING count(DISTINCT problem_id) > 1) GROUP BY 1)
SELECT project_key, 'cross_changed_dimension_profiles' AS code, '[' || dim || '].supporting_signal_count:changed' AS detail FROM t WHERE h = 0 UNION ALL SELECT project_key, 'unknown_dominant_dimension', 'space' FROM t WHERE h = 1 UNION ALL SELECT project_key, 'missing_cross_interpretation', 'integrated_interpretation' FROM t WHERE h = 2
UNION ALL SELECT project_key, 'unknown_cross_problem_id', 'P099' FROM t JOIN sh USING (project_key) WHERE h = 3 UNION ALL SELECT project_key, 'unknown_cross_indicator', 'XX' FROM t JOIN sh USING (project_key) WHERE h = 4 UNION ALL SELECT project_key, 'invalid_cross_problem_analysis', '' FROM t WHERE h = 5""")
def cross_issues(spark, sf_dir):
    """Drafted cross-problem parts against what the problems say together, one fault a project."""
    d = _diagnoses(spark, sf_dir)
    seeds = analysis.cross_contexts(rules.reportable(d))
    known = d.groupBy(_KEY).agg(F.collect_set("problem_id").alias("problem_ids"), F.array_distinct(F.flatten(F.collect_list("indicators"))).alias("indicators"))
    h, c = _len() % 6, F.col("cross")
    first = lambda part, field, new: F.transform(part, lambda z, i: F.when(i == 0, z.withField(field, new(z[field]))).otherwise(z))
    wrong = (
        F.when(h == 0, c.withField("dimension_profiles", first(c["dimension_profiles"], "supporting_signal_count", lambda n: n + 1))).when(h == 1, c.withField("dominant_ecological_dimension", F.lit("space"))).when(h == 2, c.withField("integrated_interpretation", F.lit(" ")))
        .when(h == 3, c.withField("shared_signals", first(c["shared_signals"], "related_problem_ids", lambda p: F.concat(p, F.array(F.lit("P099")))))).when(h == 4, c.withField("shared_signals", first(c["shared_signals"], "indicators", lambda _: F.array(F.lit("XX")))))
    )
    return analysis.cross_issues(seeds, seeds.withColumn("cross", wrong), known)


_BAD_SENTENCE = "甲has_buffer_gradient。优先级。可能由于降水导致。"


def _whole_drafts(spark, sf_dir):
    """(contexts, unapproved measures, drafts): of every project a right draft and fifteen that are wrong in one way each (v), as JSON."""
    state = _state(spark, sf_dir)
    c, banned = state.contexts, _unapproved(state)
    shown = c.where(~F.col("status").isin(rules.INSUFFICIENT, rules.NOT_APPLICABLE))
    own = report.problem_paragraphs(shown)
    floor = F.when(F.col("status") == rules.PROMINENT, assembly.FLOORS[True]).otherwise(assembly.FLOORS[False])
    short = F.greatest(F.lit(0), F.ceil((floor - F.length(F.array_join(own, ""))) / len(report.BOUNDARY))).cast("int")
    made = shown.select(_KEY, F.struct("problem_id", F.col("problem_name").alias("title"), F.concat(own, F.array_repeat(F.lit(report.BOUNDARY), short)).alias("paragraphs")).alias("b"))
    blocks = made.groupBy(_KEY).agg(F.array_sort(F.collect_list("b")).alias("bs"))
    x = blocks.join(banned.groupBy(_KEY).agg(F.min("phrase").alias("bad")), _KEY, "left").withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(15))))
    v, texts = F.col("v"), lambda *t: F.array(*map(F.lit, t))
    summary = F.struct(F.when(v == 4, texts(" ")).when(v == 14, texts(_BAD_SENTENCE)).otherwise(texts("概述。")).alias("paragraphs"), F.when(v == 4, texts("a", "b")).when(v == 15, F.array(F.lit("a"), F.lit("b"), F.coalesce("bad", F.lit("c")))).otherwise(texts("a", "b", "c")).alias("keywords"))
    block = lambda b: F.struct(
        b["problem_id"].alias("problem_id"), F.when(v == 11, "标题").otherwise(b["title"]).alias("title"), F.when(v == 12, F.array().cast("array<string>")).when(v == 13, texts("短")).otherwise(b["paragraphs"]).alias("paragraphs"), F.when(v == 10, "x").alias("extra")
    )
    bs = F.transform(F.when(v == 9, F.slice("bs", F.lit(2), F.size("bs"))).otherwise(F.col("bs")), block)

    def section(name):
        title = F.when((v == 7) & F.lit(name == "restoration"), "").otherwise("题")
        if name == "problem_analysis":
            return F.when(v == 8, F.lit('{"section_id":"problem_analysis","title":"题","problem_blocks":"x"}')).otherwise(F.to_json(F.struct(F.lit(name).alias("section_id"), title.alias("title"), bs.alias("problem_blocks"))))
        paragraphs = F.when((v == 7) & F.lit(name == "overall_assessment"), texts(" ")).otherwise(texts("段。"))
        return F.when(~((v == 6) & F.lit(name == "conclusion")), F.to_json(F.struct(F.lit(name).alias("section_id"), title.alias("title"), paragraphs.alias("paragraphs"))))

    sections = F.concat(F.lit("["), F.concat_ws(",", *map(section, drafts.SECTIONS)), F.lit("]"))
    whole = lambda s, t: F.concat(F.lit('{"summary":'), s, F.lit(',"sections":'), t, F.lit("}"))
    text_ = (
        F.when(v == 1, "no JSON").when(v == 2, F.concat(F.lit('{"extra":1,'), F.substring(whole(F.to_json(summary), sections), 2, 2**31 - 1))).when(v == 3, whole(F.lit('"x"'), F.lit("[]"))).when(v == 5, whole(F.to_json(summary), F.lit("{}")))
        .otherwise(whole(F.to_json(summary), sections))
    )
    return c, banned, x.select(_KEY, "v", text_.alias("draft"))


@query(f"""WITH {_BASE_SQL}, {_REPORT_SQL}, {_PHRASE_SQL}, sh AS (SELECT * FROM par WHERE status NOT IN ('数据不足', '不适用')), pk AS (SELECT project_key, min(problem_id) AS first FROM sh GROUP BY 1), bd AS (SELECT pk.project_key, coalesce(min(phrase), 'c') AS bad FROM pk LEFT JOIN ph USING (project_key) GROUP BY 1),
one(v, code, detail) AS (VALUES (1, 'invalid_narrative_type', ''), (2, 'invalid_draft_top_level', 'extra,sections,summary'), (3, 'invalid_summary', ''), (4, 'invalid_summary_paragraphs', 'summary'), (4, 'invalid_keywords', ''), (5, 'invalid_sections', ''), (6, 'section_mismatch', 'conclusion'), (7, 'invalid_section', 'restoration'),
  (7, 'invalid_section_paragraphs', 'overall_assessment'), (8, 'invalid_problem_blocks', ''), (14, 'machine_language', 'has_buffer_gradient'), (14, 'priority_language', ''), (14, 'unsupported_inference_or_action', '可能由于降水导致'))
SELECT project_key, v, code, detail FROM pk, one UNION ALL SELECT project_key, 9, 'problem_block_mismatch', first FROM pk UNION ALL SELECT project_key, 10, 'invalid_problem_block', problem_id FROM sh UNION ALL SELECT project_key, 11, 'invalid_problem_title', problem_id FROM sh
UNION ALL SELECT project_key, 12, 'invalid_problem_paragraphs', problem_id FROM sh UNION ALL SELECT project_key, 13, 'problem_analysis_too_shallow', problem_id || CASE WHEN status = '突出问题' THEN ':1<350' ELSE ':1<80' END FROM sh UNION ALL SELECT project_key, 13, 'counter_evidence_omitted', problem_id FROM sh WHERE len(against) > 0
UNION ALL SELECT ph.project_key, 15, 'unapproved_measure', phrase FROM ph JOIN bd USING (project_key) WHERE contains(bad, phrase)""")
def draft_contract(spark, sf_dir):
    """Whole drafts, of every project a right one and fifteen wrong ones: every code of the contract, wrong types included."""
    c, banned, d = _whole_drafts(spark, sf_dir)
    return drafts.draft_contract_issues(d, c, banned, [_KEY, "v"])


# --- contracts ------------------------------------------------------------------------


@query(f"""WITH {_BASE_SQL},
t AS (SELECT project_key, {_LEN} AS h FROM projects), g2 AS (SELECT *, {_ORD} AS h FROM diag), tm AS (SELECT DISTINCT o.project_key, k.measure_id, k.targets, {_LEN} + substr(k.measure_id, 2)::INT AS h FROM offer o JOIN know k ON o.text = k.name)
SELECT project_key, 'invalid_schema_version' AS code, '' AS detail FROM t WHERE h % 7 = 0 UNION ALL SELECT project_key, 'missing_spatial_evidence', '' FROM t WHERE h % 7 <> 0 AND h % 5 = 0 UNION ALL SELECT project_key, 'invalid_landscape_class_semantics', '' FROM t WHERE h % 7 <> 0 AND h % 5 = 1
UNION ALL SELECT project_key, 'invalid_risk_level_status', '' FROM t WHERE h % 7 <> 0 AND h % 4 = 3 UNION ALL SELECT project_key, 'missing_provided_risk_level', '' FROM t WHERE h % 7 <> 0 AND h % 4 = 1 AND h % 3 = 0 UNION ALL SELECT project_key, 'missing_risk_evidence', '' FROM t WHERE h % 7 <> 0 AND h % 6 = 0
UNION ALL SELECT project_key, 'missing_risk_evidence', 'quality_flags' FROM t WHERE h % 7 <> 0 AND h % 6 = 1 UNION ALL SELECT project_key, 'invalid_risk_evidence', 'trend' FROM t WHERE h % 7 <> 0 AND h % 6 = 2
UNION ALL SELECT project_key, 'insufficient_confirmed', problem_id FROM g2 WHERE status = '数据不足' AND h % 2 = 0 UNION ALL SELECT project_key, 'missing_analysis_context', problem_id FROM g2 WHERE h % 17 = 0 UNION ALL SELECT project_key, 'missing_problem_provenance', problem_id FROM g2 WHERE h % 19 = 0
UNION ALL SELECT project_key, 'missing_evidence_provenance', problem_id FROM g2 WHERE ok AND h % 23 = 0
UNION ALL SELECT tm.project_key, 'measure_for_omitted_problem', measure_id FROM tm WHERE EXISTS (SELECT 1 FROM diag d WHERE d.project_key = tm.project_key AND d.status IN ('数据不足', '不适用') AND list_contains(tm.targets, d.problem_id))
UNION ALL SELECT project_key, 'measure_priority_present', measure_id FROM tm WHERE h % 3 = 0 UNION ALL SELECT project_key, 'invented_parameters', measure_id FROM tm WHERE h % 4 = 0""")
def report_issues(spark, sf_dir):
    """What must hold of a report, on reports that break it by rule, so that every code occurs."""
    state = _state(spark, sf_dir)
    d, c = state.diagnoses, state.contexts
    h = _len()
    tops = panel.projects(spark, sf_dir).select(
        _KEY, F.when(h % 7 == 0, "1.0").otherwise("2.5-mvp").alias("schema_version"), F.when(h % 5 == 0, None).when(h % 5 == 1, "other").otherwise("mapped_cls_v1").alias("landscape_class_semantics"), F.when(h % 3 != 0, "III").alias("risk_level"),
        F.when(h % 4 == 3, "maybe").when(h % 4 == 1, "provided").otherwise("not_provided").alias("risk_level_status"),
        F.when(h % 6 == 0, None).when(h % 6 == 1, F.array(*map(F.lit, assembly.RISK_PARTS[:-1]))).otherwise(F.array(*map(F.lit, assembly.RISK_PARTS))).alias("risk_parts"), F.when(h % 6 != 2, "multi_scope_mean").alias("trend_aggregation"),
    )
    g = _len() * 3 + F.substring("problem_id", 2, 3).cast("int")
    x = d.join(c.select(_KEY, "problem_id", "features"), [_KEY, "problem_id"]).select(
        _KEY, "problem_id", "status", F.when((F.col("status") == rules.INSUFFICIENT) & (g % 2 == 0), "confirmed").otherwise(F.col("existence")).alias("existence"), F.when(g % 17 != 0, F.col("features")).alias("features"), F.lit(True).alias("has_context"),
        F.when(g % 19 != 0, F.col("rule_id")).alias("rule_id"), F.transform("evidence", lambda e: F.struct(F.when(g % 23 != 0, e["evidence_id"]).alias("evidence_id"), e["fact_ref"].alias("fact_ref"))).alias("evidence"),
    )
    known = state.offers().join(F.broadcast(_knowledge(spark)), F.col("text") == F.col("name")).select(_KEY, "measure_id", "targets").distinct()
    k = _len() + F.substring("measure_id", 2, 3).cast("int")
    m = known.withColumns({"priority": F.when(k % 3 == 0, 1), "parameter_status": F.lit("not_provided"), "parameters": F.when(k % 4 == 0, "120株")})
    return assembly.report_issues(tops, x, m)


@query(f"""WITH {PANEL_SQL}, {_OFFERS}, t AS (SELECT project_key, {_LEN} AS h FROM projects), o AS (SELECT DISTINCT project_key, text, {_LEN} + length(text) AS h FROM offer)
SELECT project_key, 'target_year_not_in_series' AS code, '' AS detail FROM t WHERE NOT EXISTS (SELECT 1 FROM wide w WHERE w.project_key = t.project_key AND w."year" = CASE WHEN t.h % 4 = 0 THEN 2050 ELSE 2000 END) UNION ALL SELECT project_key, 'missing_risk_level', '' FROM t WHERE h % 3 = 0 UNION ALL SELECT project_key, 'accepted_rejected_overlap', text FROM o WHERE h % 5 = 0""")
def series_issues(spark, sf_dir):
    """The older report's invariants: target year in the series, a risk level, no measure on both sides."""
    h = _len()
    p = panel.projects(spark, sf_dir).select(_KEY, F.when(h % 4 == 0, 2050).otherwise(2000).alias("target_year"), F.when(h % 3 != 0, "III").otherwise("").alias("risk_level"))
    o = _offers(spark, sf_dir).select(_KEY, "text").distinct()
    k = _len() + F.length("text")
    sides = F.array(F.struct(F.lit(True).alias("accepted"), F.lit("accepted").alias("reason")), F.struct(F.lit(False).alias("accepted"), F.when(k % 5 == 0, "project_type_conflict").otherwise("duplicate").alias("reason")))
    m = o.select(_KEY, "text", F.explode(sides).alias("s")).select(_KEY, "text", "s.*")
    return assembly.series_issues(p, panel.wide(spark, sf_dir).select(_KEY, "year"), m)


# --- charts ---------------------------------------------------------------------------


@query(f"""WITH {PANEL_SQL}, p AS (SELECT project_key, indicator, "year", value, first_value(value) OVER (PARTITION BY project_key, indicator ORDER BY "year") AS base FROM long WHERE value IS NOT NULL AND indicator IN ('NP', 'PD', 'LPI'))
SELECT project_key, 'landscape' AS chart, indicator AS series, row_number() OVER (PARTITION BY project_key, indicator ORDER BY "year")::INT AS place, "year" AS x, round(100 * value / base, 6) AS y FROM p WHERE base <> 0
UNION ALL SELECT project_key, 'vegetation', CASE indicator WHEN 'MEAN_NDVI' THEN 'NDVI' ELSE 'NPP' END, row_number() OVER (PARTITION BY project_key, indicator ORDER BY "year")::INT, "year", round(value, 6) FROM long WHERE value IS NOT NULL AND indicator IN ('MEAN_NDVI', 'MEAN_NPP')""")
def chart_points(spark, sf_dir):
    """Vegetation and indexed landscape series as chart JSON, read back point by point."""
    p = panel.long(spark, sf_dir)
    land = report.series_chart(trend.index_to_first(p.where("indicator in ('NP', 'PD', 'LPI')"), KEYS), _KEY, {"NP": "NP", "PD": "PD", "LPI": "LPI"}, "关键景观指标时序图", y="indexed").withColumn("chart", F.lit("landscape"))
    veg = report.series_chart(p, _KEY, {"MEAN_NDVI": "NDVI", "MEAN_NPP": "NPP"}, "关键植被指标时序图").withColumn("chart", F.lit("vegetation"))
    back = F.from_json("data_json", "series array<struct<name: string, points array<struct<year: int, value: double>>>>")["series"]
    x = land.unionByName(veg).select(_KEY, "chart", F.explode(back).alias("s")).select(_KEY, "chart", F.col("s.name").alias("series"), F.posexplode("s.points").alias("k", "p"))
    return x.select(_KEY, "chart", "series", (F.col("k") + 1).alias("place"), F.col("p.year").alias("x"), F.round("p.value", 6).alias("y"))


@query(f"""WITH {_BASE_SQL} SELECT d.project_key, ord::INT AS place, d.problem_id, d.problem_name, d.status, {_label("severity", report.SEVERITY_LABELS)} AS severity, {_label("trend", report.MATRIX_TRENDS)} AS trend FROM diag d JOIN rep USING (project_key, problem_id)""")
def matrix_chart(spark, sf_dir):
    """The matrix of reportable problems as chart JSON, read back row by row."""
    c = report.matrix_chart(rules.ordered(_diagnoses(spark, sf_dir)))
    kind = "rows array<struct<problem_id: string, problem_name: string, status: string, severity: string, trend: string>>"
    return c.select(_KEY, F.posexplode(F.from_json("data_json", kind)["rows"]).alias("k", "r")).select(_KEY, (F.col("k") + 1).alias("place"), "r.*")


@query(f"""WITH {PANEL_SQL}, {RISK_SQL}, {_EVIDENCE_SQL}, pt AS (SELECT project_key, 'annual' AS part, "year"::VARCHAR AS x, m AS y FROM yr UNION ALL SELECT project_key, 'gradient', scope, "CERI" FROM gr WHERE "CERI" IS NOT NULL) SELECT project_key, part, x, round(y, 9) AS y FROM pt""")
def risk_chart(spark, sf_dir):
    """Yearly means and gradient as chart JSON, read back point by point."""
    r = records(spark, sf_dir)
    c = report.risk_chart(risk.risk_evidence(targets(spark, sf_dir), r, trends(r)))
    kind = "annual_series array<struct<year: int, value: double>>, spatial_gradient array<struct<scope: string, value: double>>"
    j = c.select(_KEY, F.from_json("data_json", kind).alias("j"))
    both = F.concat(F.transform("j.annual_series", lambda z: F.struct(F.lit("annual").alias("part"), z["year"].cast("string").alias("x"), z["value"].alias("y"))), F.transform("j.spatial_gradient", lambda z: F.struct(F.lit("gradient").alias("part"), z["scope"].alias("x"), z["value"].alias("y"))))
    return j.select(_KEY, F.explode(both).alias("p")).select(_KEY, "p.part", "p.x", F.round("p.y", 9).alias("y"))


@query(f"""WITH {PANEL_SQL}, {FACTS_SQL}, {DIAGNOSE_SQL}, pj AS (SELECT DISTINCT project_key FROM wide), chs AS (SELECT project_key, 1 AS k FROM long WHERE value IS NOT NULL AND indicator IN ('MEAN_NDVI', 'MEAN_NPP') GROUP BY 1 UNION ALL SELECT DISTINCT project_key, 2 FROM diag WHERE status NOT IN ('数据不足', '不适用'))
SELECT 'project_report_id' AS "table", count(*) AS "rows", count(*) AS reports, true AS intact FROM pj UNION ALL SELECT 'report_entry', count(*), count(*), true FROM pj UNION ALL SELECT 'report_chart', count(*), count(DISTINCT project_key), true FROM chs""")
def report_export(spark, sf_dir):
    """Reports, charts and ids in one write, with a manifest of every file's rows and digest; all of it is read back. The
    query writes the export when it is built."""
    state = _state(spark, sf_dir)
    long = trend.unpivot_panel(state.rows, [_KEY, "year"], panel.INDICATORS)
    veg = report.series_chart(long, _KEY, {"MEAN_NDVI": "NDVI", "MEAN_NPP": "NPP"}, "关键植被指标时序图").select(_KEY, F.lit(1).alias("insert_key"), F.lit("line").alias("type"), "data_json")
    matrix = report.matrix_chart(rules.ordered(state.diagnoses)).select(_KEY, F.lit(2).alias("insert_key"), F.lit("matrix").alias("type"), "data_json")
    path = tables.scratch(spark, "export")
    sinks.export_lines(sinks.report_tables(_reports(spark, sf_dir, state), veg.unionByName(matrix)), path, rows_per_file=50)
    said = tables.scratch(spark, "manifest")
    sinks.file_manifest(spark, path).write.json(said)
    manifest = spark.read.schema("table string, file string, bytes long, rows long, sha256 string").json(said)
    wrong = sinks.manifest_issues(manifest, sinks.file_manifest(spark, path)).groupBy("table").agg(F.count("*").alias("wrong"))
    rid = F.coalesce(F.get_json_object("value", "$.id"), F.get_json_object("value", "$.report_id"))
    back = spark.read.text(path).groupBy("table").agg(F.count("*").alias("k_rows"), F.countDistinct(rid).alias("reports"))
    of = manifest.groupBy("table").agg(F.sum("rows").alias("rows")).join(back, "table").join(wrong, "table", "left")
    return of.select("table", "rows", "reports", (F.col("wrong").isNull() & (F.col("rows") == F.col("k_rows"))).alias("intact"))
