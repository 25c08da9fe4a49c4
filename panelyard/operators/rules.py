"""Problem rules over trend facts: which problems each entity shows, how sure, and from what evidence.

Rules are rows, not code: a table of one row a rule with its indicators, gates and aliases (tens of rows, so it is
broadcast).  Facts are folded to one map an entity, so a rule reads all its indicators from one row and nothing is
shuffled for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ALL_TYPES = ["coal", "solar", "wind"]
# Rules (id, name, types, indicators with their adverse direction, how they combine, required scope as
# (field, operator, value), aliases).
RULES = [
    ("P001", "工程扰动引发植被退化", ALL_TYPES, [("MEAN_NDVI", "down"), ("MEAN_NPP", "down")], "majority", [], ["植被退化"]),
    ("P002", "生态系统固碳能力下降", ALL_TYPES, [("MEAN_NPP", "down")], "all", [], ["固碳能力下降"]),
    ("P003", "原生草原面积缩减", ALL_TYPES, [("CA", "down"), ("LPI", "down")], "all", [("ca_landcover_type", "equals", "native_grassland")], []),
    ("P004", "景观破碎化", ALL_TYPES, [("NP", "up"), ("PD", "up")], "all", [], ["景观破碎化"]),
    ("P005", "景观边缘效应", ALL_TYPES, [("ED", "up"), ("LSI", "up")], "majority", [], ["边缘效应"]),
    ("P006", "土地沙化", ALL_TYPES, [("MEAN_NDVI", "down"), ("CA", "down"), ("NP", "up"), ("PD", "up")], "majority", [], ["荒漠化", "土地沙化"]),
    ("P007", "生态修复成效", ALL_TYPES, [("MEAN_NDVI", "down"), ("MEAN_NPP", "down"), ("ERI", "up")], "majority", [], []),
    ("P008", "栖息地完整性受损", ALL_TYPES, [("LPI", "down"), ("NP", "up"), ("PD", "up"), ("ED", "up"), ("LSI", "up")], "majority", [], []),
    ("P009", "缓冲区生态溢出", ALL_TYPES, [("MEAN_NDVI", "down"), ("MEAN_NPP", "down"), ("NP", "up"), ("PD", "up"), ("ED", "up"), ("LSI", "up"), ("ERI", "up")], "majority", [("has_buffer_gradient", "equals", "true")], []),
    ("P010", "复杂人为镶嵌景观", ALL_TYPES, [("ED", "up"), ("LSI", "up"), ("NP", "up"), ("PD", "up")], "majority", [], []),
    ("P011", "光伏治沙双向效应", ["solar"], [("MEAN_NDVI", "down"), ("MEAN_NPP", "down"), ("CA", "down")], "majority", [], []),
    ("P012", "历史遗留废弃矿区损害", ["coal"], [("MEAN_NDVI", "down"), ("MEAN_NPP", "down"), ("CA", "down"), ("NP", "up"), ("PD", "up"), ("LPI", "down"), ("ERI", "up")], "majority", [("historical_abandoned_mine", "equals", "true")], []),
    ("P013", "综合生态风险", ALL_TYPES, [("ERI", "up")], "all", [], ["综合生态风险"]),
]
# The older rules differ in the indicators of one, and in what their gates mean: a value that must be given,
# a type that the entity must have, a flag that may be known to be false.
RULES_V1 = [(*r[:3], [("MEAN_NDVI", "down"), ("MEAN_NPP", "down"), ("CA", "down"), ("LPI", "down"), ("ERI", "up")], *r[4:]) if r[0] == "P007" else r for r in RULES]
GATES_V1 = {"P003": "given", "P009": "given", "P011": "type", "P012": "flag"}
# Statuses.
PROMINENT, IMPROVING, AT_RISK, NOT_WORSE, INSUFFICIENT, NOT_APPLICABLE = "突出问题", "存在但改善中", "存在风险", "未见明显恶化", "数据不足", "不适用"
# Which way an indicator is good, and its dimension.
HIGHER_IS_BETTER = ["MEAN_NDVI", "MEAN_NPP", "CA", "LPI", "MEAN_VCI", "MEAN_EVI", "MEAN_SIF", "MEAN_VCS_C", "MEAN_VCS_CO2e"]
HIGHER_IS_WORSE = ["NP", "PD", "ED", "LSI", "ERI"]
DIMENSIONS = {
    "MEAN_NDVI": "vegetation_condition", "MEAN_NPP": "vegetation_productivity", "MEAN_NEP": "carbon_sequestration", "MEAN_NCS": "carbon_sequestration",
    "MEAN_VCI": "vegetation_condition", "MEAN_EVI": "vegetation_condition", "MEAN_SIF": "vegetation_productivity", "MEAN_VCS_C": "carbon_sequestration",
    "MEAN_VCS_CO2e": "carbon_sequestration", "MEAN_VCR": "carbon_sequestration", "CA": "landscape_composition", "LPI": "landscape_structure", "NP": "landscape_structure",
    "PD": "landscape_structure", "ED": "landscape_structure", "LSI": "landscape_structure", "ERI": "integrated_ecological_risk",
}

DIMENSION_LABELS = {
    "vegetation_condition": "植被状态", "vegetation_productivity": "植被生产力", "carbon_sequestration": "生态系统固碳能力", "landscape_composition": "景观组成",
    "landscape_structure": "景观空间结构", "integrated_ecological_risk": "综合生态风险",
}


def rule_table(spark: SparkSession, rules: Sequence[tuple] = tuple(RULES), gates: dict[str, str] | None = None) -> DataFrame:
    """(problem_id, problem_name, types, parts array<struct<indicator, adverse>>, logic, requirements, aliases, gate): one row a rule."""
    rows = [(*r, (gates or {}).get(r[0])) for r in rules]
    return spark.createDataFrame(
        rows,
        "problem_id string, problem_name string, types array<string>, parts array<struct<indicator: string, adverse: string>>, logic string, requirements array<struct<field: string, operator: string, value: string>>, aliases array<string>, gate string",
    )


def required(requirement: Column, scope: Column) -> Column:
    """Whether a data requirement holds in *scope* (a map); an operator other than equals is an error."""
    fits = F.coalesce(F.try_element_at(scope, requirement["field"]) == requirement["value"], F.lit(False))
    return F.when(requirement["operator"] == "equals", fits).otherwise(F.raise_error(F.concat(F.lit("unsupported data requirement operator: "), requirement["operator"])).cast("boolean"))


def canonical_direction(pattern: Column, recent: Column) -> Column:
    return (
        F.when(pattern.isin("overall_up", "fluctuating_upward"), "up").when(pattern.isin("overall_down", "fluctuating_downward"), "down")
        .when(pattern == "rise_then_fall", F.when(recent != "up", "down").otherwise("mixed")).when(pattern == "fall_then_rise", F.when(recent != "down", "up").otherwise("mixed"))
        .when(pattern == "stable", "stable").otherwise("unknown")
    )


def diagnose(facts: DataFrame, projects: DataFrame, rules: DataFrame, fix_status: bool = False) -> DataFrame:
    """One row a project and rule: status, existence, severity, trend, confidence, consistency, level, evidence, limitations.

    *facts*: (project_key, indicator, valid, long_term, recent, turning_years); *projects*: (project_key, project_type, scope
    map of strings, risk_tags array).  A confirmed problem of medium severity that isn't improving falls through to "no
    evident deterioration", as the rules have it; *fix_status* calls it at risk instead.
    """
    entry = F.struct("indicator", F.struct("valid", "long_term", "recent", "turning_years"))
    by_project = facts.groupBy("project_key").agg(F.map_from_entries(F.collect_list(entry)).alias("facts"))
    x = projects.join(by_project, "project_key", "left").crossJoin(F.broadcast(rules))
    fact = lambda part: F.try_element_at("facts", part["indicator"])
    lacking = F.filter("parts", lambda p: ~F.coalesce(fact(p)["valid"], F.lit(False)))
    unmet = F.filter("requirements", lambda r: ~required(r, F.col("scope")))
    x = x.withColumns({"lacking": lacking, "unmet": unmet, "applies": F.array_contains("types", F.col("project_type"))})

    def evidence(part: Column) -> Column:
        f = fact(part)
        seen = canonical_direction(f["long_term"], f["recent"])
        supports = F.when(seen.isin("up", "down"), seen == part["adverse"]).when(seen != "unknown", F.lit(False))
        return F.struct(
            F.concat(F.lit("EV-"), "problem_id", F.lit("-"), part["indicator"]).alias("evidence_id"), part["indicator"].alias("indicator"), F.concat(F.lit("IF-"), part["indicator"]).alias("fact_ref"),
            part["adverse"].alias("adverse_direction"), seen.alias("observed_direction"), supports.alias("supports_problem"), f["long_term"].alias("long_term"), f["recent"].alias("recent"), f["turning_years"].alias("turning_years"),
        )

    x = x.withColumn("every", F.transform("parts", evidence))
    count = lambda test: F.size(F.filter("every", test)).cast("long")
    tagged = F.array_contains("risk_tags", F.col("problem_name")) | F.arrays_overlap("risk_tags", "aliases")
    x = x.withColumns(
        {
            "tagged": F.coalesce(tagged, F.lit(False)), "total": F.size("parts").cast("long"), "supported": count(lambda e: e["supports_problem"]), "opposed": count(lambda e: ~e["supports_problem"]),
            "worse": count(lambda e: e["recent"] == e["adverse_direction"]), "better": count(lambda e: e["recent"].isin("up", "down") & (e["recent"] != e["adverse_direction"])),
            "short": (F.size("unmet") > 0) | (F.size("lacking") > 0),
        }
    )
    short = F.col("short")
    assessed = F.col("applies") & ~short
    whole, some = F.col("supported") == F.col("total"), F.col("supported") > 0
    confirmed = F.when(F.col("logic") == "all", whole).when(F.col("logic") == "any", some).otherwise(F.col("supported") * 2 > F.col("total"))
    existence = F.when(~assessed, "unknown").when(confirmed, "confirmed").when(some | F.col("tagged"), "possible").otherwise("not_observed")
    consistency = (
        F.when(~assessed, "insufficient").when(some & (F.col("opposed") > 0), F.when(F.col("supported") == F.col("opposed"), "conflicting").otherwise("partially_consistent"))
        .when(whole, "consistent").when(some, "partially_consistent").otherwise("consistent")
    )
    g = x.withColumns({"existence": F.when(~F.col("applies"), "not_applicable").otherwise(existence), "evidence_consistency": consistency})
    is_ = lambda *v: F.col("existence").isin(*v)
    severity = F.when(~assessed, "unknown").when(is_("confirmed"), F.when(whole, "high").otherwise("medium")).when(is_("possible"), "medium").otherwise("low")
    confidence = F.when(~assessed, "not_assessable").when(is_("confirmed"), F.when(whole, "high").otherwise("medium")).when(is_("possible"), F.when(some, "medium").otherwise("low")).when(F.col("evidence_consistency") == "consistent", "high").otherwise("medium")
    level = F.when(~assessed, "none").when(is_("possible") & ~some, "B").otherwise("A")
    trend = (
        F.when(~assessed, "unknown").when((F.col("worse") > 0) & (F.col("better") > 0), "mixed").when(F.col("worse") > 0, F.when(is_("confirmed"), "worsening").otherwise("recently_worsening"))
        .when(F.col("better") > 0, F.when(is_("confirmed", "possible"), "recently_improving").otherwise("improving")).otherwise("stable")
    )
    g = g.withColumns({"severity": severity, "confidence": confidence, "evidence_level": level, "trend": trend})
    status = (
        F.when(~F.col("applies"), NOT_APPLICABLE).when(short, INSUFFICIENT).when(is_("confirmed") & (F.col("severity") == "high"), PROMINENT)
        .when(is_("confirmed", "possible") & F.col("trend").isin("improving", "recently_improving"), IMPROVING).when(is_("possible") | (F.lit(fix_status) & is_("confirmed")), AT_RISK).otherwise(NOT_WORSE)
    )
    limits = F.when(~F.col("applies"), F.array(F.lit("项目类型不适用"))).otherwise(
        F.concat(F.transform("unmet", lambda r: F.concat(F.lit("数据条件未满足："), r["field"])), F.transform("lacking", lambda p: F.concat(F.lit("指标数据不足："), p["indicator"])))
    )
    return g.select(
        "project_key", "problem_id", "problem_name", F.when(F.col("applies"), "applicable").otherwise("not_applicable").alias("applicability"),
        F.when(F.col("applies") & short, "insufficient").otherwise("sufficient").alias("data_sufficiency"), status.alias("status"), "existence", "severity", "trend", "confidence", "evidence_consistency", "evidence_level",
        "supported", "opposed", "total", F.transform("parts", lambda p: p["indicator"]).alias("indicators"), F.when(assessed, F.col("every")).otherwise(F.array().cast(x.schema["every"].dataType)).alias("evidence"),
        limits.alias("limitations"), F.concat(F.lit("PR-"), "problem_id").alias("rule_id"),
    )


def diagnose_v1(trends: DataFrame, projects: DataFrame, rules: DataFrame) -> DataFrame:
    """The older decision table over ``trend_evidence``: status, level, and the indicators on each side.

    *projects*: (project_key, project_type, scope map of strings, risk_tags array).  A rule's gate says what its scope
    means: given (else insufficient), type (else not applicable), flag (not applicable if known to be false, insufficient
    if unknown).
    """
    by_project = trends.groupBy("project_key").agg(F.map_from_entries(F.collect_list(F.struct("indicator", "direction"))).alias("trends"))
    x = projects.join(by_project, "project_key", "left").crossJoin(F.broadcast(rules))
    need = F.try_element_at("requirements", F.lit(1))
    have = F.try_element_at("scope", need["field"])
    fits = F.coalesce(have == need["value"], F.lit(False))
    gate = (
        F.when(F.col("gate") == "type", F.when(~F.array_contains("types", F.col("project_type")), "no")).when(F.col("gate") == "flag", F.when(have == "false", "no").when(~fits, "unknown"))
        .when(F.col("gate") == "given", F.when(~fits, "unknown"))
    )

    def effect(part: Column) -> Column:
        d, up = F.try_element_at("trends", part["indicator"]), F.try_element_at("trends", part["indicator"]) == "increase"
        good, bad = part["indicator"].isin(HIGHER_IS_BETTER), part["indicator"].isin(HIGHER_IS_WORSE)
        return F.when(d == "stable", "stable").when(d.isNull(), None).when(good, F.when(up, "improving").otherwise("adverse")).when(bad, F.when(up, "adverse").otherwise("improving")).otherwise("unknown")

    tagged = F.coalesce(F.array_contains("risk_tags", F.col("problem_name")) | F.arrays_overlap("risk_tags", "aliases"), F.lit(False))
    x = x.withColumns({"gate": gate, "tagged": tagged, "effects": F.transform("parts", lambda p: F.struct(p["indicator"].alias("indicator"), effect(p).alias("effect")))})
    side = lambda s: F.transform(F.filter("effects", lambda e: e["effect"] == s), lambda e: e["indicator"])
    g = x.withColumns({"n": F.size(F.filter("effects", lambda e: e["effect"].isNotNull())), "adverse": side("adverse"), "improving": side("improving"), "stable": side("stable")})
    a, b, tag = F.size("adverse") > 0, F.size("improving") > 0, F.col("tagged")
    status = (
        F.when(F.col("gate") == "no", NOT_APPLICABLE).when(F.col("gate") == "unknown", INSUFFICIENT).when(F.col("n") == 0, F.when(tag, AT_RISK).otherwise(INSUFFICIENT))
        .when(a & ~b, PROMINENT).when(b & ~a, F.when(tag, IMPROVING).otherwise(NOT_WORSE)).when(a & b, AT_RISK).when(tag, AT_RISK).otherwise(NOT_WORSE)
    )
    level = F.when(F.col("gate").isNotNull(), "none").when(F.col("n") == 0, F.when(tag, "B").otherwise("none")).when(a | b, "A").when(tag, "B").otherwise("A")
    keep = lambda c: F.when(F.col("gate").isNull(), F.col(c)).otherwise(F.array().cast("array<string>"))
    return g.select("project_key", "problem_id", "problem_name", status.alias("status"), level.alias("level"), keep("adverse").alias("adverse"), keep("improving").alias("improving"), keep("stable").alias("stable"))


def reportable(diagnoses: DataFrame) -> DataFrame:
    """Without problems that are insufficient or not applicable."""
    return diagnoses.where(~F.col("status").isin(INSUFFICIENT, NOT_APPLICABLE))


def ordered(diagnoses: DataFrame) -> DataFrame:
    """Reportable problems with ``ord``: prominent ones first, then by id."""
    w = Window.partitionBy("project_key").orderBy((F.col("status") != PROMINENT).cast("int"), "problem_id")
    return reportable(diagnoses).withColumn("ord", F.row_number().over(w))


def project_limitations(diagnoses: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, limitations): what limits any of a project's diagnoses, each once, sorted."""
    return diagnoses.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("limitations")))).alias("limitations"))
