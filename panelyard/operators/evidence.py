"""Risks as others reported them: labels taken apart, the indicators behind each, and warnings where nothing stands behind one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import AT_RISK, IMPROVING, PROMINENT

# Risk labels and their indicators; the label that only says that a model was used.
RISK_INDICATORS = {
    "植被退化": ["MEAN_NDVI", "MEAN_NPP"], "固碳能力下降": ["MEAN_NPP", "MEAN_VCS_C", "MEAN_VCS_CO2e"], "乡土草地面积变化": ["CA", "LPI"], "景观破碎化": ["NP", "PD", "LPI"], "边缘效应与风蚀风险": ["ED", "LSI"],
    "荒漠化": ["MEAN_NDVI", "CA", "NP", "PD"], "生境完整性下降": ["LPI", "NP", "PD", "ED", "LSI"], "复杂斑块镶嵌": ["ED", "LSI", "NP", "PD"],
    "历史矿山遗留影响": ["MEAN_NDVI", "MEAN_NPP", "CA", "NP", "PD", "LPI", "ERI"], "累计生态风险": ["ERI"],
}
MODEL_LABEL = "ML综合预测"


def split_labels(raw: Column) -> Column:
    """The labels of a text in their order, blanks and the model's mark left out; repeats stay."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), "[、,，;；]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & (x != MODEL_LABEL))


def reported(matching: DataFrame, key: str = "project_key", text: str = "risk_types") -> DataFrame:
    """(key, pos, risk): one row a reported label."""
    return matching.select(key, F.posexplode(split_labels(F.col(text))).alias("pos", "risk"))


def problem_evidence(risks: DataFrame, trends: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, pos, risk, source, indicators, available_trends): what stands behind each known label; unknown ones have no row.

    *trends*: (key, indicator).
    """
    have = trends.groupBy(key).agg(F.collect_set("indicator").alias("have"))
    known = F.create_map(*[z for k, v in RISK_INDICATORS.items() for z in (F.lit(k), F.array(*map(F.lit, v)))])
    x = risks.withColumn("indicators", F.try_element_at(known, F.col("risk"))).where("indicators is not null").join(have, key, "left")
    some = F.filter("indicators", lambda i: F.coalesce(F.array_contains("have", i), F.lit(False)))
    return x.select(key, "pos", "risk", F.lit("workbook_reported_risk_type").alias("source"), "indicators", some.alias("available_trends"))


def report_warnings(risks: DataFrame, diagnoses: DataFrame, selected: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, warning): reported labels without indicators, and problems that call for a measure but have none in *selected*
    (key, problem_id)."""
    unknown = risks.where(~F.col("risk").isin(list(RISK_INDICATORS))).select(key, F.concat(F.lit("unsupported_reported_risk_type:"), "risk").alias("warning"))
    called = diagnoses.where(F.col("status").isin(PROMINENT, IMPROVING, AT_RISK)).select(key, "problem_id", "problem_name")
    bare = called.join(selected.select(key, "problem_id").distinct(), [key, "problem_id"], "left_anti")
    return unknown.unionByName(bare.select(key, F.concat(F.lit("no_relevant_candidate_measure:"), "problem_name").alias("warning")))
