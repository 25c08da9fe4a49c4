"""Risk and spatial evidence: which scope speaks for an entity, gradients over scopes, yearly means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scopes from the core outward, and class codes.
SCOPE_ORDER = ["本体", "0-1km", "1-3km", "3-5km", "5-10km"]
RISK_FIELDS = ["LER", "ES", "EP", "RER", "CVR", "CERI_raw", "CERI"]
CORE_TYPES = ["solar", "coal"]
LANDSCAPE_CLASSES = {"cls_1": "耕地", "cls_2": "森林", "cls_3": "灌木", "cls_4": "草地", "cls_5": "水域", "cls_6": "裸地", "cls_7": "建设用地", "cls_8": "冰雪", "cls_9": "湿地"}


def rank_of(scope: Column, order: Sequence[str]) -> Column:
    """A scope's place in *order*, from 1; null if it isn't there."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), scope), F.lit(0))


def decode(code: Column, labels: dict[str, str], default: str | None = None) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(z) for kv in labels.items() for z in kv]), code), F.lit(default) if default is not None else code)


def first_records(records: DataFrame, keys: Sequence[str], order: str = "source_row") -> DataFrame:
    """The first record of each key; later ones never win."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def pick_scope(records: DataFrame, keys: Sequence[str], preferred: Sequence[str], scope: str = "scope", value: str = "value", least: int = 3) -> DataFrame:
    """(keys, scope, n): the first scope in *preferred* order with *least* or more values."""
    counts = records.groupBy(*keys, scope).agg(F.count(value).alias("n")).withColumn("rank", rank_of(F.col(scope), preferred)).where((F.col("n") >= least) & F.col("rank").isNotNull())
    return counts.groupBy(*keys).agg(F.min_by(F.struct(scope, "n"), "rank").alias("p")).select(*keys, "p.*")


def risk_evidence(projects: DataFrame, records: DataFrame, trends: DataFrame, source_present: bool = True, order: Sequence[str] = tuple(SCOPE_ORDER), key: str = "project_key") -> DataFrame:
    """One row a project: the current risk and the scope that speaks for it, fallback and quality flags, the gradient over
    scopes at the target year (of rows of one scope the last), yearly means over all scopes (not cut at the target year), and the trend with whether its
    significance is available.

    *projects*: (key, project_type, target_year); *records*: (key, year, scope, RISK_FIELDS, risk_level, risk_level_code,
    source_row); *trends*: (key, start_ceri, end_ceri, change_rate_percent, sen_slope, p_value_raw, trend_type), one row a
    project.  Only the types in CORE_TYPES have a core scope.  Without a risk source a project that has neither records nor
    a trend has no evidence and no row.
    """
    wide = records.join(projects.select(key, "project_type", "target_year"), key).withColumn("rank", rank_of(F.col("scope"), order))
    here = (F.col("year") == F.col("target_year")) & F.col("rank").isNotNull() & (F.col("project_type").isin(CORE_TYPES) | (F.col("rank") > 1))
    step = F.struct("rank", F.coalesce("source_row", F.lit(-1)).alias("place"), "scope", F.nullif("risk_level", F.lit("")).alias("risk_level"), "risk_level_code", F.struct(*RISK_FIELDS).alias("values"), "source_row")
    yearly = wide.repartition(key).groupBy(key, "year").agg(F.avg("CERI").alias("mean_ceri"), F.count("CERI").alias("valid_scope_count"), F.collect_list(F.when(here, step)).alias("steps"))
    means = F.array_sort(F.collect_list(F.when(F.col("valid_scope_count") > 0, F.struct("year", "mean_ceri", "valid_scope_count"))))
    g = yearly.groupBy(key).agg(means.alias("annual_series"), F.array_sort(F.flatten(F.collect_list("steps"))).alias("all_steps"))
    # Of a scope that comes twice the last row counts.
    last = F.filter(F.arrays_zip("all_steps", F.slice("all_steps", F.lit(2), F.size("all_steps")).alias("next")), lambda z: z["all_steps"].isNotNull() & ~z["all_steps"]["rank"].eqNullSafe(z["next"]["rank"]))
    g = g.withColumn("spatial_gradient", F.transform(last, lambda z: z["all_steps"].dropFields("place"))).drop("all_steps")
    value, invalid = checked_p(F.col("p_value_raw"))
    t = trends.withColumns({"p_value": value, "p_value_invalid": invalid, "in_trends": F.lit(True)})
    x = projects.select(key, "project_type", "target_year").join(g, key, "left").join(t, key, "left")
    if not source_present:
        x = x.where(F.col("annual_series").isNotNull() | F.col("in_trends"))
    chosen = F.try_element_at(F.filter("spatial_gradient", lambda z: z["values"]["CERI"].isNotNull()), F.lit(1))
    x = x.withColumn("s", chosen)
    first = F.when(F.col("project_type").isin(CORE_TYPES), order[0]).otherwise(order[1])
    fallback = F.col("s").isNotNull() & (F.col("s.scope") != first)
    flags = F.array_compact(F.array(F.when(fallback, "core_scope_missing_fallback"), F.when(F.col("s").isNull(), "no_valid_target_ceri"), F.when(F.col("p_value_invalid"), "invalid_p_value_treated_as_missing")))
    trend = F.struct(
        "start_ceri", "end_ceri", "change_rate_percent", "sen_slope", "p_value_raw", F.coalesce("p_value_invalid", F.lit(False)).alias("p_value_invalid"), "p_value", "trend_type", F.lit("multi_scope_mean").alias("aggregation"),
        significance(F.col("p_value")).alias("significance_status"), F.when(F.col("p_value").isNull(), "not_assessed").alias("significance_interpretation"),
    )
    empty = lambda c: F.coalesce(c, F.array().cast(x.schema[c].dataType))
    return x.select(
        key, "target_year", F.col("s.risk_level").alias("risk_level"), F.col("s.risk_level_code").alias("risk_level_code"), F.col("s.values").alias("values"), F.col("s.scope").alias("source_scope"), F.coalesce(fallback, F.lit(False)).alias("fallback"),
        flags.alias("quality_flags"), trend.alias("trend"), empty("annual_series").alias("annual_series"), empty("spatial_gradient").alias("spatial_gradient"),
        F.when(F.col("project_type").isin(CORE_TYPES), F.array(*map(F.lit, order))).otherwise(F.array(*map(F.lit, order[1:]))).alias("source_scope_order"),
    )


def overall_risk(projects: DataFrame, evidence: DataFrame, matching: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, risk_level, risk_level_code, risk_level_status, reported_risk_types): what the evidence says where there is any,
    else what the matching table says; a level that is empty isn't provided.  Reported types stay one text."""
    e = evidence.select(key, F.lit(True).alias("k_e"), F.col("risk_level").alias("e_level"), F.col("risk_level_code").alias("e_code"))
    m = matching.select(key, F.nullif("risk_level", F.lit("")).alias("m_level"), F.col("risk_level_code").alias("m_code"), F.nullif("risk_types", F.lit("")).alias("types"))
    x = projects.select(key).join(e, key, "left").join(m, key, "left")
    level = F.when(F.col("k_e"), F.col("e_level")).otherwise(F.col("m_level"))
    code = F.when(F.col("k_e"), F.col("e_code")).otherwise(F.col("m_code"))
    return x.select(key, level.alias("risk_level"), code.alias("risk_level_code"), F.when(level.isNotNull(), "provided").otherwise("not_provided").alias("risk_level_status"), F.array_compact(F.array("types")).alias("reported_risk_types"))


def annual_means(records: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(key, year, mean, scopes): the mean over the scopes that have a value, and how many have."""
    return records.groupBy(key, "year").agg(F.avg(value).alias("mean"), F.count(value).alias("scopes")).where("scopes > 0")


def checked_p(p: Column) -> tuple[Column, Column]:
    """(P value or null, whether a value was there and invalid)."""
    fine = ~F.isnan(p) & p.between(0, 1)
    return F.when(fine, p), p.isNotNull() & ~fine


def significance(p: Column) -> Column:
    """Whether a P value can be told at all; how small it is isn't judged."""
    return F.when(p.isNull(), "missing").otherwise("available")


def scope_series(records: DataFrame, fields: Sequence[str], key: str = "project_key", total: str = "Total_Landscape") -> DataFrame:
    """(key, year, scope, class_code, class_name, fields, source_row): landscape rows by class, named; *total* is all classes."""
    name = F.when(F.col("category") == total, "总景观").otherwise(decode(F.col("category"), LANDSCAPE_CLASSES, "类别未提供"))
    return records.select(key, "year", "scope", F.col("category").alias("class_code"), name.alias("class_name"), *fields, "source_row")
