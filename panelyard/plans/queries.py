"""Registered queries of the panel operators, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules, trend
from . import panel
from .panel import FACTS_SQL, PANEL_SQL, TREND_SQL

KEYS = ["project_key", "indicator"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def joined(c: str | Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def r6(c: str) -> Column:
    return F.round(c, 6).alias(c)


@query(f"""WITH {PANEL_SQL}, {FACTS_SQL}
SELECT project_key, indicator, valid, n AS valid_years, array_to_string(missing, ',') AS missing_years, cy AS current_year, round(cv, 6) AS current_value, loy AS min_year, hiy AS max_year, round(lo, 6) AS min_value, round(hi, 6) AS max_value,
  long_term, recent, array_to_string(CASE WHEN valid THEN turning ELSE [] END, ',') AS turning_years, CASE WHEN valid THEN round(rsl, 6) END AS relative_slope, CASE WHEN valid THEN round(rr, 6) END AS relative_range, CASE WHEN valid THEN round(rch, 6) END AS recent_change, reversals FROM facts""")
def trend_v2(spark, sf_dir):
    """Indicator facts of every project's nine series."""
    f = trend.indicator_facts(panel.long(spark, sf_dir), KEYS)
    return f.select(*KEYS, "valid", "valid_years", joined("missing_years").alias("missing_years"), "current_year", r6("current_value"), "min_year", "max_year", r6("min_value"), r6("max_value"), "long_term", "recent", joined("turning_years").alias("turning_years"), r6("relative_slope"), r6("relative_range"), r6("recent_change"), "reversals")


@query(f"""WITH {PANEL_SQL}, {TREND_SQL}
SELECT project_key, indicator, observations, start_year, end_year, round(start_value, 6) AS start_value, round(end_value, 6) AS end_value, round(end_value - start_value, 6) AS delta, round(slope, 3) AS slope_per_year, direction, pattern, recent AS recent_direction,
  array_to_string(turning, ',') AS turning_years, round(lo, 6) AS minimum_value, loy AS minimum_year, round(hi, 6) AS maximum_value, hiy AS maximum_year FROM trends""")
def trend_v1(spark, sf_dir):
    """The older trend evidence of the same series."""
    e = trend.trend_evidence(panel.long(spark, sf_dir), KEYS)
    return e.select(*KEYS, "observations", "start_year", "end_year", r6("start_value"), r6("end_value"), r6("delta"), F.round("slope_per_year", 3).alias("slope_per_year"), "direction", "pattern", "recent_direction", joined("turning_years").alias("turning_years"), r6("minimum_value"), "minimum_year", r6("maximum_value"), "maximum_year")


@query(f"""WITH {PANEL_SQL}, w AS (SELECT *, lag(value) OVER o AS a, lead(value) OVER o AS b FROM long WHERE value IS NOT NULL WINDOW o AS (PARTITION BY project_key, indicator ORDER BY "year"))
SELECT project_key, indicator, "year", round(CASE WHEN a IS NULL OR b IS NULL THEN value ELSE list_sort([a, value, b])[2] END, 6) AS smooth, round(value - a, 6) AS delta, round((value - a) / greatest(abs(a), 1e-12), 6) AS relative_change FROM w""")
def smooth_and_change(spark, sf_dir):
    """Median of three and year-over-year change of every point."""
    p = panel.long(spark, sf_dir).where("value is not null")
    return trend.year_over_year(trend.median_of_three(p, KEYS), KEYS).select(*KEYS, "year", r6("smooth"), r6("delta"), r6("relative_change"))


@query(f"""WITH {PANEL_SQL}, w AS (SELECT *, first_value(value) OVER (PARTITION BY project_key, indicator ORDER BY "year") AS base, min(value) OVER (PARTITION BY project_key, indicator) AS lo, max(value) OVER (PARTITION BY project_key, indicator) AS hi FROM long WHERE value IS NOT NULL)
SELECT project_key, indicator, "year", round(100 * value / base, 4) AS indexed, round(CASE WHEN hi = lo THEN 0 ELSE (value - lo) / (hi - lo) * 100 END, 4) AS scaled FROM w WHERE base <> 0""")
def index_and_scale(spark, sf_dir):
    """Every point indexed to its series' first year and scaled between its extremes."""
    p = trend.min_max_scale(panel.long(spark, sf_dir).where("value is not null"), KEYS)
    return trend.index_to_first(p, KEYS).select(*KEYS, "year", F.round("indexed", 4).alias("indexed"), F.round("scaled", 4).alias("scaled"))


def _rule_sql(rows=rules.RULES) -> str:
    lit = lambda x: "NULL" if x is None else "'" + x + "'"
    arr = lambda xs: "[" + ", ".join(map(lit, xs)) + "]::VARCHAR[]"
    out = [f"({lit(p)}, {lit(name)}, {arr(types)}, {k}, {lit(ind)}, {lit(adverse)}, {lit(logic)}, {lit(need[0][0] if need else None)}, {arr(al)})" for p, name, types, parts, logic, need, al in rows for k, (ind, adverse) in enumerate(parts)]
    return "rules(problem_id, problem_name, types, pos, indicator, adverse, logic, need, aliases) AS (VALUES " + ", ".join(out) + ")"


DIAGNOSE_SQL = f"""
{_rule_sql()},
pr AS (SELECT * FROM projects, rules),
ev AS (SELECT pr.*, coalesce(valid, false) AS usable, recent, CASE WHEN long_term IN ('overall_up', 'fluctuating_upward') THEN 'up' WHEN long_term IN ('overall_down', 'fluctuating_downward') THEN 'down'
  WHEN long_term = 'rise_then_fall' THEN CASE WHEN recent <> 'up' THEN 'down' ELSE 'mixed' END WHEN long_term = 'fall_then_rise' THEN CASE WHEN recent <> 'down' THEN 'up' ELSE 'mixed' END WHEN long_term = 'stable' THEN 'stable' ELSE 'unknown' END AS dir
  FROM pr LEFT JOIN facts ON facts.project_key = pr.project_key AND facts.indicator = pr.indicator),
e2 AS (SELECT *, CASE WHEN dir IN ('up', 'down') THEN dir = adverse WHEN dir <> 'unknown' THEN false END AS sup, CASE WHEN recent = adverse THEN 'adverse' WHEN recent IN ('up', 'down') THEN 'improving' ELSE 'stable' END AS eff,
  CASE need WHEN 'ca_landcover_type' THEN landcover = 'native_grassland' WHEN 'has_buffer_gradient' THEN buffer WHEN 'historical_abandoned_mine' THEN coalesce(mine, false) ELSE true END AS met FROM ev),
g AS (SELECT project_key, problem_id, any_value(problem_name) AS problem_name, any_value(logic) AS logic, any_value(need) AS need, bool_and(met) AS met, bool_and(list_contains(types, project_type)) AS applies, bool_or(list_contains(tags, problem_name) OR list_has_any(tags, aliases)) AS tagged,
  count(*) AS total, count(*) FILTER (sup) AS supported, count(*) FILTER (sup = false) AS opposed, count(*) FILTER (NOT usable) AS missing, count(*) FILTER (eff = 'adverse') AS worse, count(*) FILTER (eff = 'improving') AS better,
  string_agg('指标数据不足：' || indicator, '|' ORDER BY pos) FILTER (NOT usable) AS lacking, string_agg(indicator || ':' || dir || ':' || coalesce(sup::VARCHAR, '-'), '|' ORDER BY pos) AS evid FROM e2 GROUP BY project_key, problem_id),
h AS (SELECT *, applies AND met AND missing = 0 AS ok, CASE logic WHEN 'all' THEN supported = total WHEN 'any' THEN supported > 0 ELSE supported * 2 > total END AS conf FROM g),
h2 AS (SELECT *, CASE WHEN NOT applies THEN 'not_applicable' WHEN NOT ok THEN 'unknown' WHEN conf THEN 'confirmed' WHEN supported > 0 OR tagged THEN 'possible' ELSE 'not_observed' END AS existence,
  CASE WHEN NOT ok THEN 'insufficient' WHEN supported > 0 AND opposed > 0 THEN CASE WHEN supported = opposed THEN 'conflicting' ELSE 'partially_consistent' END WHEN supported = total THEN 'consistent' WHEN supported > 0 THEN 'partially_consistent' ELSE 'consistent' END AS consistency FROM h),
h3 AS (SELECT *, CASE WHEN NOT ok THEN 'unknown' WHEN existence = 'confirmed' THEN CASE WHEN supported = total THEN 'high' ELSE 'medium' END WHEN existence = 'possible' THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN NOT ok THEN 'not_assessable' WHEN existence = 'confirmed' THEN CASE WHEN supported = total THEN 'high' ELSE 'medium' END WHEN existence = 'possible' THEN CASE WHEN supported > 0 THEN 'medium' ELSE 'low' END WHEN consistency = 'consistent' THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN NOT ok THEN 'none' WHEN existence = 'possible' AND supported = 0 THEN 'B' ELSE 'A' END AS evidence_level,
  CASE WHEN NOT ok THEN 'unknown' WHEN worse > 0 AND better > 0 THEN 'mixed' WHEN worse > 0 THEN CASE WHEN existence = 'confirmed' THEN 'worsening' ELSE 'recently_worsening' END
    WHEN better > 0 THEN CASE WHEN existence IN ('confirmed', 'possible') THEN 'recently_improving' ELSE 'improving' END ELSE 'stable' END AS trend FROM h2),
diag AS (SELECT *, CASE WHEN NOT applies THEN '不适用' WHEN NOT ok THEN '数据不足' WHEN existence = 'confirmed' AND severity = 'high' THEN '突出问题' WHEN existence IN ('confirmed', 'possible') AND trend IN ('improving', 'recently_improving') THEN '存在但改善中' WHEN existence = 'possible' THEN '存在风险' ELSE '未见明显恶化' END AS status FROM h3)
"""


def _diagnoses(spark, sf_dir):
    facts = trend.indicator_facts(panel.long(spark, sf_dir), KEYS, by=["project_key"])
    return rules.diagnose(facts, panel.projects(spark, sf_dir), rules.rule_table(spark))


@query(f"""WITH {PANEL_SQL}, {FACTS_SQL}, {DIAGNOSE_SQL}
SELECT project_key, problem_id, problem_name, status, existence, severity, trend, confidence, consistency AS evidence_consistency, evidence_level, supported, opposed, total, CASE WHEN ok THEN evid ELSE '' END AS evidence,
  CASE WHEN NOT applies THEN '项目类型不适用' ELSE concat_ws('|', CASE WHEN NOT met THEN '数据条件未满足：' || need END, lacking) END AS limitations FROM diag""")
def rule_eval_v2(spark, sf_dir):
    """Every rule on every project, with its evidence."""
    d = _diagnoses(spark, sf_dir)
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["indicator"], e["observed_direction"], F.coalesce(e["supports_problem"].cast("string"), F.lit("-")))), "|")
    return d.select("project_key", "problem_id", "problem_name", "status", "existence", "severity", "trend", "confidence", "evidence_consistency", "evidence_level", "supported", "opposed", "total", evidence.alias("evidence"), F.array_join("limitations", "|").alias("limitations"))


DIAGNOSE_V1_SQL = f"""
{_rule_sql(rules.RULES_V1)},
v1 AS (SELECT p.project_key, p.project_type, p.mine, r.*, list_contains(tags, problem_name) OR list_has_any(tags, aliases) AS tagged, direction,
  CASE WHEN direction IS NULL THEN NULL WHEN direction = 'stable' THEN 'stable' WHEN r.indicator IN ('MEAN_NDVI', 'MEAN_NPP', 'CA', 'LPI') THEN CASE WHEN direction = 'increase' THEN 'improving' ELSE 'adverse' END ELSE CASE WHEN direction = 'increase' THEN 'adverse' ELSE 'improving' END END AS eff,
  CASE WHEN need = 'ca_landcover_type' AND landcover <> 'native_grassland' THEN 'unknown' WHEN need = 'has_buffer_gradient' AND NOT buffer THEN 'unknown' WHEN problem_id = 'P011' AND project_type <> 'solar' THEN 'no'
    WHEN need = 'historical_abandoned_mine' THEN CASE WHEN mine = false THEN 'no' WHEN mine THEN NULL ELSE 'unknown' END END AS gate FROM projects p CROSS JOIN rules r LEFT JOIN trends t ON t.project_key = p.project_key AND t.indicator = r.indicator),
vg AS (SELECT project_key, problem_id, any_value(gate) AS gate, bool_or(tagged) AS tagged, count(eff) AS n, coalesce(string_agg(indicator, ',' ORDER BY pos) FILTER (eff = 'adverse'), '') AS adverse, coalesce(string_agg(indicator, ',' ORDER BY pos) FILTER (eff = 'improving'), '') AS improving,
  coalesce(string_agg(indicator, ',' ORDER BY pos) FILTER (eff = 'stable'), '') AS stable FROM v1 GROUP BY ALL)
"""


@query(f"""WITH {PANEL_SQL}, {TREND_SQL}, {DIAGNOSE_V1_SQL}
SELECT project_key, problem_id, CASE WHEN gate = 'no' THEN '不适用' WHEN gate = 'unknown' THEN '数据不足' WHEN n = 0 THEN CASE WHEN tagged THEN '存在风险' ELSE '数据不足' END WHEN adverse <> '' AND improving = '' THEN '突出问题' WHEN improving <> '' AND adverse = '' THEN CASE WHEN tagged THEN '存在但改善中' ELSE '未见明显恶化' END
  WHEN adverse <> '' THEN '存在风险' WHEN tagged THEN '存在风险' ELSE '未见明显恶化' END AS status,
  CASE WHEN gate IS NOT NULL THEN 'none' WHEN n = 0 THEN CASE WHEN tagged THEN 'B' ELSE 'none' END WHEN adverse <> '' OR improving <> '' THEN 'A' WHEN tagged THEN 'B' ELSE 'A' END AS level,
  CASE WHEN gate IS NULL THEN adverse ELSE '' END AS adverse, CASE WHEN gate IS NULL THEN improving ELSE '' END AS improving, CASE WHEN gate IS NULL THEN stable ELSE '' END AS stable FROM vg""")
def rule_eval_v1(spark, sf_dir):
    """The older decision table on every project."""
    d = rules.diagnose_v1(trend.trend_evidence(panel.long(spark, sf_dir), KEYS), panel.projects(spark, sf_dir), rules.rule_table(spark, rules.RULES_V1, rules.GATES_V1))
    return d.select("project_key", "problem_id", "status", "level", *[F.array_join(c, ",").alias(c) for c in ("adverse", "improving", "stable")])
