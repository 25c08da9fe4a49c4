"""What the diagnoses of one entity say: features and context of each problem, and what its problems share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nested import differences

from .rules import DIMENSION_LABELS, DIMENSIONS, INSUFFICIENT, NOT_APPLICABLE

# Features of a problem, by its confidence, by how its evidence agrees, by long-term and recent classes.
CONFIDENCE_FEATURES = {"high": "strong_direct_evidence", "medium": "moderate_direct_evidence", "low": "weak_direct_evidence"}
RELATIONSHIPS = {"consistent": "consistent", "partially_consistent": "mostly_consistent", "conflicting": "conflicting", "insufficient": "insufficient"}
RELATIONSHIP_FEATURES = {"consistent": "indicator_consistency", "mostly_consistent": "partial_consistency", "mixed": "partial_consistency", "conflicting": "indicator_conflict", "insufficient": "data_limitation"}
LONG_FEATURES = {
    "overall_up": "long_term_deterioration", "fluctuating_upward": "long_term_deterioration", "overall_down": "long_term_improvement", "fluctuating_downward": "long_term_improvement",
    "stable": "long_term_stable", "rise_then_fall": "mixed_long_term_pattern", "fall_then_rise": "mixed_long_term_pattern",
}
RECENT_FEATURES = {"up": "recent_deterioration", "down": "recent_improvement", "stable": "recent_stable"}
# Features that a draft may name.
ALLOWED_FEATURES = [
    "data_limitation", "scope_limitation", "strong_direct_evidence", "moderate_direct_evidence", "weak_direct_evidence", "indicator_consistency", "partial_consistency", "indicator_conflict",
    "long_term_deterioration", "long_term_improvement", "long_term_stable", "mixed_long_term_pattern", "recent_deterioration", "recent_improvement", "recent_stable", "recent_reversal",
    "cross_dimension_contrast", "shared_signal", "restoration_relevance",
]
# Sentences.
CANNOT_TELL = "现有指标只能支持结构化生态信号判断，不能识别具体驱动因素。"
NO_CAUSES = "不得据此推断具体工程活动、施工位置或现场成因。"
NO_PLACES = "现有数据不足以确定具体位置、工程尺度和实施参数。"


def lookup(codes: dict[str, str], code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(z) for kv in codes.items() for z in kv]), code)


def _sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(values)))


def _strength(n: Column, total: Column) -> Column:
    ratio = n / F.greatest(total, F.lit(1))
    return F.when(n <= 0, "none").when(ratio >= 0.75, "strong").when(ratio >= 0.5, "moderate").otherwise("weak")


def features(diagnoses: DataFrame) -> Column:
    """The ordered features of a problem; polarity isn't looked at, as the class codes have it (an index that rises counts
    as deterioration whatever it measures)."""
    fixed = F.array(
        F.when(F.col("data_sufficiency") == "insufficient", "data_limitation"), F.when(F.col("applicability") == "not_applicable", "scope_limitation"), lookup(CONFIDENCE_FEATURES, F.col("confidence")),
        lookup(RELATIONSHIP_FEATURES, F.coalesce(lookup(RELATIONSHIPS, F.col("evidence_consistency")), F.lit("mixed"))), F.when(F.col("trend").isin("recently_improving", "recently_worsening"), "recent_reversal"),
    )
    return _sorted(F.concat(fixed, F.transform("evidence", lambda e: lookup(LONG_FEATURES, e["long_term"])), F.transform("evidence", lambda e: lookup(RECENT_FEATURES, e["recent"]))))


def contexts(diagnoses: DataFrame, matches: DataFrame | None = None, key: str = "project_key") -> DataFrame:
    """One row a project and rule with what a report may say of it: features, how the signals split, how strong each side is,
    how long-term and recent classes relate, dimensions, and the measures that match it.

    *diagnoses*: as ``rules.diagnose`` gives them; *matches*: (key, measure_id, name, mechanism, targets, first_target).
    """
    x = diagnoses
    kind = "array<struct<measure_id: string, name: string, mechanism: string>>"
    if matches is None:
        x = x.withColumn("matched", F.array().cast(kind))
    else:  # a project has tens of matches at most (one a known measure), so they come as one array
        m = matches.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first_target", "measure_id", "name", "mechanism", "targets"))).alias("ms"))
        mine = F.filter("ms", lambda z: F.array_contains(z["targets"], F.col("problem_id")))
        x = x.join(m, key, "left").withColumn("matched", F.coalesce(F.transform(mine, lambda z: F.struct(z["measure_id"], z["name"], z["mechanism"])), F.array().cast(kind)))
    support, counter = F.filter("evidence", lambda e: e["supports_problem"]), F.filter("evidence", lambda e: ~e["supports_problem"])
    stable = F.filter("evidence", lambda e: (e["long_term"] == "stable") | (e["recent"] == "stable"))
    x = x.withColumns({"support": support, "counter": counter, "steady": stable, "n": F.size("evidence"), "long": _sorted(F.transform("evidence", lambda e: e["long_term"])), "near": _sorted(F.transform("evidence", lambda e: e["recent"]))})
    a, b, n = F.size("support"), F.size("counter"), F.col("n")
    balance = (
        F.when((a > 0) & (b > 0), "mixed").when((a == n) & (n > 0), "strongly_supports_diagnosis").when(a > 0, "supports_diagnosis")
        .when(F.col("data_sufficiency") == "insufficient", "insufficient").otherwise("does_not_support_diagnosis")
    )
    relation = F.when(n == 0, "unknown").when(F.col("trend").isin("recently_improving", "recently_worsening"), "divergent").when(F.size("near") > 1, "partially_divergent").otherwise("consistent")
    ids = lambda c: F.transform(c, lambda e: e["evidence_id"])
    names = lambda c: F.transform(c, lambda e: e["indicator"])
    dims = _sorted(F.transform("indicators", lambda i: lookup(DIMENSIONS, i)))
    labels = F.transform(dims, lambda d: lookup(DIMENSION_LABELS, d))
    omitted = F.col("status").isin(INSUFFICIENT, NOT_APPLICABLE)
    none = F.array().cast("array<string>")
    return x.select(
        key, "problem_id", "problem_name", "status", "existence", "severity", "trend", "confidence", "evidence_level", "evidence_consistency", "limitations", "rule_id",
        features(x).alias("features"), F.coalesce(lookup(RELATIONSHIPS, F.col("evidence_consistency")), F.lit("mixed")).alias("relationship"),
        F.col("indicators").alias("core_indicators"), names("support").alias("supporting_indicators"), ids("support").alias("supporting_ids"), ids("counter").alias("conflicting_ids"), ids("steady").alias("stable_ids"),
        F.col("support").alias("supporting_signals"), F.col("counter").alias("conflicting_signals"), F.col("steady").alias("stable_signals"), F.col("evidence").alias("signals"),
        F.col("long").alias("long_term_patterns"), F.col("near").alias("recent_patterns"), _sorted(F.flatten(F.transform("evidence", lambda e: e["turning_years"]))).alias("turning_points"), relation.alias("long_recent_relation"),
        _strength(a, n).alias("support_strength"), _strength(b, n).alias("counter_strength"), (n > 0).alias("direct_evidence"), (F.col("evidence_level") == "B").alias("risk_label_support"), balance.alias("overall_balance"),
        dims.alias("dimensions"), labels.alias("dimension_labels"), F.concat(F.lit("当前判断主要反映"), F.when(F.size(labels) > 0, F.array_join(labels, "、")).otherwise("规则指定生态维度"), F.lit("的变化信号。")).alias("primary_finding"),
        F.when(omitted, none).otherwise(F.array(F.lit(CANNOT_TELL))).alias("interpretation_limitations"), F.array(F.lit(NO_CAUSES)).alias("unsupported_inferences"),
        F.when(omitted, "关键条件不足，当前结论不可评估。").otherwise(F.concat(F.lit("结论基于"), n.cast("string"), F.lit("项规则指定指标证据。"))).alias("confidence_reason"),
        "matched", F.when(F.size("matched") > 0, "matched").otherwise("no_compliant_match").alias("match_status"),
    )


def shared_indicators(diagnoses: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, indicator, problems array): indicators in which more than one reportable problem rests."""
    x = diagnoses.select(key, "problem_id", F.explode("indicators").alias("indicator"))
    return x.groupBy(key, "indicator").agg(F.array_sort(F.collect_set("problem_id")).alias("problems")).where(F.size("problems") > 1)


def dimension_profile(diagnoses: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, dimension, supporting, conflicting, weight, problems, seen): a problem's counts go to each of its dimensions once.
    Indicators without a dimension count for none."""
    dims = _sorted(F.transform("indicators", lambda i: lookup(DIMENSIONS, i)))
    x = diagnoses.select(key, "problem_id", "supported", "opposed", F.posexplode(dims).alias("pos", "dimension"))
    return x.groupBy(key, "dimension").agg(
        F.sum("supported").alias("supporting"), F.sum("opposed").alias("conflicting"), F.sum(F.greatest(F.lit(1), F.col("supported") + F.col("opposed"))).alias("weight"),
        F.count("*").alias("problems"), F.min(F.struct("problem_id", "pos")).alias("seen"),
    )


def dominant_dimension(profile: DataFrame, key: str = "project_key") -> DataFrame:
    """The dimension of the greatest weight; ties to the one seen first: problems in their order, then dimensions by name."""
    best = F.min_by(F.struct("dimension", "weight"), F.struct(-F.col("weight"), F.col("seen")))
    return profile.groupBy(key).agg(best.alias("d")).select(key, "d.dimension", lookup(DIMENSION_LABELS, F.col("d.dimension")).alias("label"), "d.weight")


# What each section of a context says besides its facts, and the fields of a section that no draft may change.
EXPLANATIONS = {
    ("basis", "basis_summary"): "仅使用问题规则指定指标及其可追溯证据形成判断。", ("temporal", "summary"): "长期和近期变化关系需结合逐指标证据解释。", ("indicator_synthesis", "synthesis"): "支持、反向和稳定信号必须同时保留并综合解释。",
    ("evidence_balance", "summary"): "证据强度由既定证据关系确定，不得由写作阶段提升。", ("restoration", "direction"): None,
}
DIRECTION = {True: "仅解释已匹配措施与诊断之间的关系，不扩展为工程设计。", False: "现有候选措施未形成合规匹配，不补造修复方向。"}
MEANING = "不同维度的证据必须分别保留，不将局部信号扩展为整体生态状态事实。"
INTEGRATED = "综合解释应识别跨问题共同信号、维度差异和当前主要生态矛盾。"
LOCKED = {
    "basis": ["core_indicators", "supporting_indicators", "rule_id"], "temporal": ["indicator_patterns", "long_term_patterns", "recent_patterns", "turning_points", "long_recent_relation"],
    "indicator_synthesis": ["relationship", "dominant_indicators", "supporting_evidence_ids", "conflicting_evidence_ids", "stable_evidence_ids", "supporting_signals", "conflicting_signals", "stable_signals"],
    "evidence_balance": ["support_strength", "counter_evidence_strength", "direct_evidence", "risk_label_support", "overall_balance"], "interpretation": ["primary_dimensions", "dimension_labels"],
    "uncertainty": ["data_limitations", "unsupported_inferences"], "restoration": ["matched_measure_ids", "matched_measures", "implementation_limits", "match_status"],
}


def nested_contexts(contexts: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, problem_id, analysis_features, analysis_context): ``contexts`` as one nested value a problem, the facts of every
    section beside what it says of them."""
    part = lambda name, *more: F.struct(*more, *[F.lit(t).alias(f) for (n, f), t in EXPLANATIONS.items() if n == name and t]).alias(name)
    direction = F.when(F.size("matched") > 0, DIRECTION[True]).otherwise(DIRECTION[False])
    col = lambda old, new: F.col(old).alias(new)
    context = F.struct(
        part("basis", "core_indicators", "supporting_indicators", "rule_id"),
        part("temporal", col("signals", "indicator_patterns"), "long_term_patterns", "recent_patterns", "turning_points", "long_recent_relation"),
        part("indicator_synthesis", "relationship", col("supporting_indicators", "dominant_indicators"), col("supporting_ids", "supporting_evidence_ids"), col("conflicting_ids", "conflicting_evidence_ids"), col("stable_ids", "stable_evidence_ids"), "supporting_signals", "conflicting_signals", "stable_signals"),
        part("evidence_balance", "support_strength", col("counter_strength", "counter_evidence_strength"), "direct_evidence", "risk_label_support", "overall_balance"),
        part("interpretation", col("dimensions", "primary_dimensions"), "dimension_labels", "primary_finding", F.array().cast("array<string>").alias("secondary_findings"), F.lit(MEANING).alias("ecological_meaning")),
        part("uncertainty", col("limitations", "data_limitations"), "interpretation_limitations", "unsupported_inferences", "confidence_reason"),
        part("restoration", F.transform("matched", lambda m: m["measure_id"]).alias("matched_measure_ids"), col("matched", "matched_measures"), direction.alias("direction"), F.array(F.lit(NO_PLACES)).alias("implementation_limits"), "match_status"),
    )
    return contexts.select(key, "problem_id", F.col("features").alias("analysis_features"), context.alias("analysis_context"))


def analysis_issues(seeds: DataFrame, drafts: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, problem_id, code, detail) where drafts (as ``nested_contexts`` gives them) depart from what must stay as it is in their
    seeds, or lack what they must say.  A problem that only one side has is told as such; a context without one of its sections
    is told as such and not looked at further."""
    on = [key, "problem_id"]
    kind = seeds.schema["analysis_context"].dataType
    x = seeds.select(*on, F.col("analysis_context").alias("s"), F.lit(True).alias("in_seed")).join(drafts.select(*on, "analysis_features", F.col("analysis_context").alias("d"), F.lit(True).alias("in_draft")), on, "full_outer")
    issue = lambda code, detail: F.struct(F.lit(code).alias("code"), detail.alias("detail"))
    none = F.array().cast("array<struct<code: string, detail: string>>")
    some = lambda *tests: F.array_compact(F.array(*[F.when(test, issue(code, F.lit(detail))) for code, detail, test in tests]))
    names = F.coalesce("analysis_features", F.array().cast("array<string>"))
    bad = F.transform(F.array_except(names, F.array(*map(F.lit, ALLOWED_FEATURES))), lambda f: issue("unknown_analysis_feature", f))
    of_features = F.when(F.size(names) == 0, F.array(issue("invalid_analysis_features", F.lit("")))).otherwise(bad)
    lost = some(*[("invalid_analysis_context", n, F.col("d")[n].isNull()) for n in LOCKED])
    locked = lambda c: F.struct(*[F.struct(*[F.col(c)[n][f].alias(f) for f in fields]).alias(n) for n, fields in LOCKED.items()])
    locked_kind = T.StructType([T.StructField(n, T.StructType([kind[n].dataType[f] for f in fields])) for n, fields in LOCKED.items()])
    changed = differences(locked("s"), locked("d"), locked_kind, "", {"evidence_id", "measure_id"})
    facts = F.transform(changed, lambda z: F.struct(F.when(z["code"] == "missing", "analysis_missing_locked_fact").otherwise("analysis_changed_locked_fact").alias("code"), F.concat(z["path"], F.lit(":"), z["code"]).alias("detail")))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    said = some(*[("missing_analysis_explanation", f"{n}.{f}", blank(F.col("d")[n][f])) for n, f in EXPLANATIONS])
    lacking = lambda n, fields: F.array_join(F.array_compact(F.array(*[F.when(F.col("d")[n][f].isNull(), F.lit(f)) for f in fields])), ",")
    meant, unsure = lacking("interpretation", ["primary_dimensions", "dimension_labels", "primary_finding", "secondary_findings", "ecological_meaning"]), lacking("uncertainty", ["data_limitations", "interpretation_limitations", "unsupported_inferences", "confidence_reason"])
    typed = F.array_compact(F.array(F.when(meant != "", issue("invalid_interpretation", meant)), F.when(unsure != "", issue("invalid_uncertainty", unsure))))
    found = (
        F.when(F.col("in_draft").isNull(), F.array(issue("analysis_problem_mismatch", F.lit("missing")))).when(F.col("in_seed").isNull(), F.array(issue("analysis_problem_mismatch", F.lit("unexpected"))))
        .otherwise(F.concat(of_features, F.when(F.size(lost) > 0, lost).otherwise(F.concat(facts, said, typed))))
    )
    return x.select(*on, F.explode(F.coalesce(found, none)).alias("i")).select(*on, "i.code", "i.detail")


def cross_contexts(diagnoses: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, cross): what a project's reportable problems say together: shared signals, dimension profiles, the dominant dimension."""
    profile = dimension_profile(diagnoses, key)
    entry = F.struct("dimension", lookup(DIMENSION_LABELS, F.col("dimension")).alias("label"), F.col("supporting").alias("supporting_signal_count"), F.col("conflicting").alias("conflicting_signal_count"))
    p = profile.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("dimension_profiles")).join(dominant_dimension(profile, key).select(key, F.col("dimension").alias("dominant")), key)
    shared = shared_indicators(diagnoses, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.array("indicator").alias("indicators"), F.col("problems").alias("related_problem_ids")))).alias("shared_signals"))
    x = p.join(shared, key, "left")
    none = F.array().cast(x.schema["shared_signals"].dataType)
    cross = F.struct(F.coalesce("shared_signals", none).alias("shared_signals"), "dimension_profiles", F.col("dominant").alias("dominant_ecological_dimension"), lookup(DIMENSION_LABELS, F.col("dominant")).alias("dominant_dimension_label"), F.lit(INTEGRATED).alias("integrated_interpretation"))
    return x.select(key, cross.alias("cross"))


def cross_issues(seeds: DataFrame, drafts: DataFrame, known: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, code, detail) of drafted cross-problem parts (key, cross) against their seeds; *known*: (key, problem_ids, indicators),
    the arrays of what a project's signals may name."""
    kind = seeds.schema["cross"].dataType
    x = seeds.withColumnRenamed("cross", "s").join(drafts.withColumnRenamed("cross", "d"), key, "left").join(known, key, "left")
    issue = lambda code, detail: F.struct(F.lit(code).alias("code"), detail.alias("detail"))
    named = lambda field, allowed, code: F.transform(F.array_except(F.flatten(F.transform(F.col("d.shared_signals"), lambda z: z[field])), F.col(allowed)), lambda v: issue(code, v))
    moved = F.transform(differences(F.col("s.dimension_profiles"), F.col("d.dimension_profiles"), kind["dimension_profiles"].dataType, "", {"dimension"}), lambda z: issue("cross_changed_dimension_profiles", F.concat(z["path"], F.lit(":"), z["code"])))
    main = F.col("d.dominant_ecological_dimension")
    allowed = F.transform("s.dimension_profiles", lambda z: z["dimension"])
    rest = F.array_compact(F.array(F.when(main.isNotNull() & ~F.array_contains(allowed, main), issue("unknown_dominant_dimension", main)), F.when(F.trim(F.coalesce("d.integrated_interpretation", F.lit(""))) == "", issue("missing_cross_interpretation", F.lit("integrated_interpretation")))))
    found = F.when(F.col("d").isNull(), F.array(issue("invalid_cross_problem_analysis", F.lit("")))).otherwise(F.concat(named("related_problem_ids", "problem_ids", "unknown_cross_problem_id"), named("indicators", "indicators", "unknown_cross_indicator"), moved, rest))
    return x.select(key, F.explode(found).alias("i")).select(key, "i.code", "i.detail")


def locked_changes(seeds: DataFrame, drafts: DataFrame, fields: list[str], on: list[str]) -> DataFrame:
    """(on, code, field): facts that a draft lacks or changed against its seed, compared null-safely whatever their type."""
    x = seeds.withColumn("in_seed", F.lit(True)).alias("s").join(drafts.withColumn("in_draft", F.lit(True)).alias("d"), on, "full_outer")
    issues = [F.when(F.col("in_draft").isNull(), F.struct(F.lit("missing").alias("code"), F.lit("*").alias("field"))), F.when(F.col("in_seed").isNull(), F.struct(F.lit("unexpected").alias("code"), F.lit("*").alias("field")))]
    both = F.col("in_draft") & F.col("in_seed")
    issues += [F.when(both & ~F.col(f"s.{f}").eqNullSafe(F.col(f"d.{f}")), F.struct(F.lit("changed").alias("code"), F.lit(f).alias("field"))) for f in fields]
    return x.select(*on, F.explode(F.array_compact(F.array(*issues))).alias("i")).select(*on, "i.code", "i.field")


def draft_feature_issues(drafts: DataFrame, on: list[str], features: str = "features") -> DataFrame:
    """(on, code, detail): drafts without features, or with one that isn't allowed."""
    bad = F.array_except(features, F.array(*map(F.lit, ALLOWED_FEATURES)))
    empty = F.size(F.coalesce(features, F.array().cast("array<string>"))) == 0
    issues = F.when(empty, F.array(F.struct(F.lit("invalid_analysis_features").alias("code"), F.lit("").alias("detail")))).otherwise(F.transform(bad, lambda f: F.struct(F.lit("unknown_analysis_feature").alias("code"), f.alias("detail"))))
    return drafts.select(*on, F.explode(issues).alias("i")).select(*on, "i.code", "i.detail")
