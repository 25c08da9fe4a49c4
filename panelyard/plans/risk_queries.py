"""Registered queries of risk evidence, reported risks and spatial series.

Order priorities stand for the scopes; a record is a project's orders of one year and priority.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import evidence, measures, risk, rules, trend
from . import panel
from .more_queries import _KNOW_SQL, _OFFER_SQL, _knowledge, _offers
from .panel import FACTS_SQL, PANEL_SQL, TREND_SQL
from .queries import DIAGNOSE_SQL, KEYS, _diagnoses, joined, query

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_LEVELS = ["", "II_较低风险", "III_中风险", "IV_较高风险"]
_TYPES = ["植被退化、ML综合预测", "景观破碎化；荒漠化", "固碳能力下降,累计生态风险", "", "边缘效应与风蚀风险、外来物种，植被退化"]

RISK_SQL = f"""
tgt AS (SELECT project_key, project_type, (1999 + length(project_key) % 3)::INT AS target_year FROM projects),
rk AS (SELECT project_key, "year", CASE o_orderpriority {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(_PRIORITIES, risk.SCOPE_ORDER, strict=True))} END AS scope, count(*) AS k, count(*)::DOUBLE AS "LER", min(o_totalprice) AS "ES", max(o_totalprice) AS "EP",
  (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE AS "RER", (count(*) FILTER (o_orderstatus = 'O'))::DOUBLE / count(*) AS "CVR", sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 1e6 AS "CERI_raw",
  CASE WHEN count(*) >= 3 THEN sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 1e6 END AS "CERI", min(o_orderkey) AS source_row FROM ords GROUP BY ALL),
rec AS (SELECT *, (k % 4)::INT AS risk_level_code, {_LEVELS!r}[k % 4 + 1] AS risk_level FROM rk),
tr AS (SELECT CASE WHEN length(project_key) % 4 > 0 THEN project_key ELSE 'other-' || project_key END AS project_key, min("CERI_raw") AS start_ceri, max("CERI_raw") AS end_ceri, CASE WHEN count(*) % 4 > 0 THEN (count(*) % 9 - 1) / 5.0::DOUBLE END AS p_value_raw, CASE WHEN count(*) % 2 = 0 THEN '上升' ELSE '下降' END AS trend_type FROM rec GROUP BY 1),
mat AS (SELECT CASE WHEN length(project_key) % 7 > 0 THEN project_key ELSE 'other-' || project_key END AS project_key, CASE WHEN length(project_key) % 2 = 0 THEN 'III_中风险' ELSE '' END AS risk_level, (length(project_key) % 5)::INT AS risk_level_code, {_TYPES!r}[length(project_key) % 5 + 1] AS risk_types FROM projects)
"""


def _len() -> Column:
    return F.length("project_key")


def _mine(test: Column) -> Column:
    """The project's key where *test* holds; elsewhere the rows are another one's, which has no project: they stay in the
    table, and the project has none."""
    return F.when(test, F.col("project_key")).otherwise(F.concat(F.lit("other-"), "project_key")).alias("project_key")


def targets(spark, sf_dir):
    """Projects, each with a target year of its own."""
    return panel.projects(spark, sf_dir).select("project_key", "project_type", (1999 + _len() % 3).alias("target_year"))


def records(spark, sf_dir):
    n, cents = F.count("*"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 1e6
    scope = F.element_at(F.array(*map(F.lit, risk.SCOPE_ORDER)), F.array_position(F.array(*map(F.lit, _PRIORITIES)), F.col("o_orderpriority")).cast("int"))
    g = panel.orders(spark, sf_dir).groupBy("project_key", "year", scope.alias("scope")).agg(
        n.alias("k"), n.cast("double").alias("LER"), F.min("o_totalprice").alias("ES"), F.max("o_totalprice").alias("EP"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("RER"),
        (F.count_if(F.col("o_orderstatus") == "O") / n).alias("CVR"), cents.alias("CERI_raw"), F.when(n >= 3, cents).alias("CERI"), F.min("o_orderkey").alias("source_row"),
    )
    return g.withColumns({"risk_level_code": (F.col("k") % 4).cast("int"), "risk_level": F.element_at(F.array(*map(F.lit, _LEVELS)), (F.col("k") % 4 + 1).cast("int"))})


def trends(r):
    n = F.count("*")
    g = r.withColumn("project_key", _mine(_len() % 4 > 0)).groupBy("project_key").agg(
        F.min("CERI_raw").alias("start_ceri"), F.max("CERI_raw").alias("end_ceri"), F.when(n % 4 > 0, (n % 9 - 1) / 5.0).alias("p_value_raw"), F.when(n % 2 == 0, "上升").otherwise("下降").alias("trend_type"),
    )
    return g.withColumns({"change_rate_percent": F.lit(None).cast("double"), "sen_slope": F.lit(None).cast("double")})


def matching(projects):
    return projects.select(_mine(_len() % 7 > 0), F.when(_len() % 2 == 0, "III_中风险").otherwise("").alias("risk_level"), (_len() % 5).cast("int").alias("risk_level_code"), F.element_at(F.array(*map(F.lit, _TYPES)), (_len() % 5 + 1).cast("int")).alias("risk_types"))


_RANK = f"list_position({risk.SCOPE_ORDER!r}, scope)"
_EVIDENCE_SQL = f"""
gr AS (SELECT r.*, {_RANK} AS rank, t.project_type FROM rec r JOIN tgt t ON t.project_key = r.project_key AND t.target_year = r."year" WHERE t.project_type <> 'wind' OR scope <> '本体'),
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY rank) AS o FROM gr WHERE "CERI" IS NOT NULL) WHERE o = 1),
gs AS (SELECT project_key, string_agg(scope || '=' || coalesce(round("CERI", 6)::VARCHAR, '-') || '/' || coalesce(nullif(risk_level, ''), '-'), '|' ORDER BY rank) AS gradient FROM gr GROUP BY 1),
yr AS (SELECT project_key, "year", avg("CERI") AS m, count("CERI") AS n FROM rec GROUP BY ALL HAVING count("CERI") > 0),
ys AS (SELECT project_key, string_agg("year" || '=' || round(m, 9)::VARCHAR || '/' || n, '|' ORDER BY "year") AS annual FROM yr GROUP BY 1),
ev AS (SELECT t.project_key, t.target_year, nullif(s.risk_level, '') AS risk_level, s.risk_level_code, s."LER" AS ler, s."ES" AS es, s."EP" AS ep, s."RER" AS rer, round(s."CVR", 9) AS cvr, s."CERI_raw" AS ceri_raw, s."CERI" AS ceri, s.scope AS source_scope,
  coalesce(s.scope <> CASE WHEN t.project_type = 'wind' THEN '0-1km' ELSE '本体' END, false) AS fallback, s.project_key IS NULL AS none, coalesce(p_value_raw NOT BETWEEN 0 AND 1, false) AS bad, CASE WHEN p_value_raw BETWEEN 0 AND 1 THEN p_value_raw END AS p_value, tr.trend_type, coalesce(gradient, '') AS gradient, coalesce(annual, '') AS annual
  FROM tgt t LEFT JOIN sel s USING (project_key) LEFT JOIN tr USING (project_key) LEFT JOIN gs USING (project_key) LEFT JOIN ys USING (project_key))"""


@query(f"""WITH {PANEL_SQL}, {RISK_SQL}, {_EVIDENCE_SQL} SELECT project_key, target_year, risk_level, risk_level_code, ler, es, ep, rer, cvr, ceri_raw, ceri, source_scope, fallback, concat_ws(',', CASE WHEN fallback THEN 'core_scope_missing_fallback' END, CASE WHEN none THEN 'no_valid_target_ceri' END, CASE WHEN bad THEN 'invalid_p_value_treated_as_missing' END) AS flags,
  p_value, trend_type, CASE WHEN p_value IS NULL THEN 'missing' ELSE 'available' END AS significance, gradient, annual FROM ev""")
def risk_evidence(spark, sf_dir):
    """Current risk with flags, gradient, yearly means and trend of every project."""
    r = records(spark, sf_dir)
    e = risk.risk_evidence(targets(spark, sf_dir), r, trends(r))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    values = [F.round(F.col(f"values.{f}"), 9).alias(f.lower()) if f == "CVR" else F.col(f"values.{f}").alias(f.lower()) for f in risk.RISK_FIELDS]
    gradient = F.array_join(F.transform("spatial_gradient", lambda z: F.concat(z["scope"], F.lit("="), text(F.round(z["values"]["CERI"], 6)), F.lit("/"), F.coalesce(z["risk_level"], F.lit("-")))), "|")
    annual = F.array_join(F.transform("annual_series", lambda z: F.concat(z["year"].cast("string"), F.lit("="), text(F.round(z["mean_ceri"], 9)), F.lit("/"), z["valid_scope_count"].cast("string"))), "|")
    return e.select("project_key", "target_year", "risk_level", "risk_level_code", *values, "source_scope", "fallback", joined("quality_flags").alias("flags"), "trend.p_value", "trend.trend_type", F.col("trend.significance_status").alias("significance"), gradient.alias("gradient"), annual.alias("annual"))


@query(f"""WITH {PANEL_SQL}, {RISK_SQL}, {_EVIDENCE_SQL}, part AS (SELECT * REPLACE (CASE WHEN length(project_key) % 3 > 0 THEN project_key ELSE 'other-' || project_key END AS project_key) FROM ev)
SELECT t.project_key, CASE WHEN e.project_key IS NOT NULL THEN e.risk_level ELSE nullif(m.risk_level, '') END AS risk_level, CASE WHEN e.project_key IS NOT NULL THEN e.risk_level_code ELSE m.risk_level_code END AS risk_level_code,
  CASE WHEN CASE WHEN e.project_key IS NOT NULL THEN e.risk_level ELSE nullif(m.risk_level, '') END IS NULL THEN 'not_provided' ELSE 'provided' END AS risk_level_status, coalesce(m.risk_types, '') AS reported_risk_types FROM tgt t LEFT JOIN part e USING (project_key) LEFT JOIN mat m USING (project_key)""")
def overall_risk(spark, sf_dir):
    """The risk level that a report gives; evidence comes before the matching table, which is attached by key."""
    r, t = records(spark, sf_dir), targets(spark, sf_dir)
    e = risk.risk_evidence(t, r, trends(r)).withColumn("project_key", _mine(_len() % 3 > 0))  # the others have no risk source
    return risk.overall_risk(t, e, matching(t)).withColumn("reported_risk_types", joined("reported_risk_types"))


_SPLIT_SQL = "rt AS (SELECT project_key, trim(x) AS risk, i::INT AS pos FROM (SELECT project_key, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM (SELECT project_key, string_split_regex(risk_types, '[、,，;；]') AS s FROM mat)) WHERE trim(x) <> '' AND trim(x) <> 'ML综合预测')"
_PI_SQL = "pi(risk, pos, indicator) AS (VALUES " + ", ".join(f"('{k}', {n}, '{i}')" for k, v in evidence.RISK_INDICATORS.items() for n, i in enumerate(v)) + ")"


@query(f"""WITH {PANEL_SQL}, {TREND_SQL}, {RISK_SQL}, {_SPLIT_SQL}, {_PI_SQL} SELECT rt.project_key, rt.risk, string_agg(pi.indicator, ',' ORDER BY pi.pos) AS indicators, coalesce(string_agg(pi.indicator, ',' ORDER BY pi.pos) FILTER (t.indicator IS NOT NULL), '') AS available
FROM rt JOIN pi ON pi.risk = rt.risk LEFT JOIN (SELECT DISTINCT project_key, indicator FROM trends) t ON t.project_key = rt.project_key AND t.indicator = pi.indicator GROUP BY rt.project_key, rt.risk, rt.pos""")
def reported_risks(spark, sf_dir):
    """Indicators behind the risk labels that were reported, and those that have a trend."""
    t = trend.trend_evidence(panel.long(spark, sf_dir), KEYS)
    x = evidence.problem_evidence(evidence.reported(matching(panel.projects(spark, sf_dir))), t)
    return x.select("project_key", "risk", joined("indicators").alias("indicators"), joined("available_trends").alias("available"))


@query(f"""WITH {PANEL_SQL}, {FACTS_SQL}, {DIAGNOSE_SQL}, {_KNOW_SQL}, {_OFFER_SQL}, {RISK_SQL}, {_SPLIT_SQL}, {_PI_SQL},
have AS (SELECT DISTINCT o.project_key, unnest(k.targets) AS problem_id FROM offer o JOIN know k ON o.text = k.name AND list_contains(k.types, o.project_type))
SELECT project_key, 'unsupported_reported_risk_type:' || risk AS warning FROM rt WHERE risk NOT IN (SELECT risk FROM pi)
UNION ALL SELECT d.project_key, 'no_relevant_candidate_measure:' || d.problem_name FROM diag d LEFT JOIN have h ON h.project_key = d.project_key AND h.problem_id = d.problem_id WHERE d.status IN ('突出问题', '存在但改善中', '存在风险') AND h.project_key IS NULL""")
def report_warnings(spark, sf_dir):
    """Reported risks that nothing stands behind, and diagnosed problems without a measure."""
    d = _diagnoses(spark, sf_dir)
    matches = measures.match_knowledge(_offers(spark, sf_dir), rules.ordered(d), _knowledge(spark))
    selected = matches.select("project_key", F.explode("targets").alias("problem_id"))
    return evidence.report_warnings(evidence.reported(matching(panel.projects(spark, sf_dir))), d, selected)


@query(f"""WITH {PANEL_SQL}, {RISK_SQL} SELECT r.project_key, r."year", r.scope, CASE WHEN k % 3 = 0 THEN 'Total_Landscape' ELSE 'cls_' || k % 11 END AS class_code,
  CASE WHEN k % 3 = 0 THEN '总景观' ELSE coalesce(map_extract(MAP {{{', '.join(f"'{a}': '{b}'" for a, b in risk.LANDSCAPE_CLASSES.items())}}}, 'cls_' || k % 11)[1], '类别未提供') END AS class_name, r."LER", r."CERI", r.source_row FROM rec r JOIN tgt t USING (project_key) WHERE r."year" <= t.target_year""")
def spatial_series(spark, sf_dir):
    """Series by scope and class up to the target year, the total told apart, unknown codes with a default."""
    r = records(spark, sf_dir).join(targets(spark, sf_dir).select("project_key", "target_year"), "project_key").where("year <= target_year")
    code = F.when(F.col("k") % 3 == 0, "Total_Landscape").otherwise(F.concat(F.lit("cls_"), F.col("k") % 11))
    return risk.scope_series(r.withColumn("category", code), ["LER", "CERI"]).select("project_key", "year", "scope", "class_code", "class_name", "LER", "CERI", "source_row")
