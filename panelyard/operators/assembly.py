"""Observations from the chosen scopes, report drafts and exports: checks that give issue rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .risk import first_records


def as_of(df: DataFrame, targets: DataFrame, key: str = "project_key", time: str = "year", target: str = "target_year") -> DataFrame:
    """Rows up to each entity's target; entities without a target are left out."""
    return df.join(targets.select(key, target), key).where(F.col(time) <= F.col(target)).drop(target)


def observations(records: DataFrame, picks: DataFrame, spine: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, year, indicator, value, source_row): every year of the spine with each picked indicator's first record at its scope.

    *records*: (key, year, scope, indicator, value, source_row); *picks*: (key, indicator, scope); *spine*: (key, year).
    """
    first = first_records(records, [key, "year", "scope", "indicator"]).select(key, "year", "scope", "indicator", "value", "source_row")
    wanted = spine.select(key, "year").distinct().join(picks, key)
    return wanted.join(first, [key, "year", "scope", "indicator"], "left").select(key, "year", "indicator", "value", F.coalesce("source_row", F.lit(0)).alias("source_row"))


def protected_areas(projects: DataFrame, areas: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, status, area, types): recorded or not, the sum of known areas (null where none is known), the kinds in order."""
    g = areas.groupBy(key).agg(F.sum("area").alias("area"), F.array_sort(F.collect_set("kind")).alias("types"))
    return projects.select(key).join(g, key, "left").select(key, F.when(F.col("types").isNull(), "not_recorded").otherwise("recorded").alias("status"), "area", F.coalesce("types", F.array().cast("array<string>")).alias("types"))


def source_years(df: DataFrame, key: str, target: Column, time: str = "year") -> DataFrame:
    """(key, years, has_target)."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(time)).alias("years")).withColumn("has_target", F.array_contains("years", target))


def ranked(df: DataFrame, column: str, first: Sequence[str]) -> list[Column]:
    """Sort columns: the values in *first* in their order, then the rest by value."""
    place = F.array_position(F.array(*map(F.lit, first)), F.col(column))
    return [F.when(place > 0, place).otherwise(len(first) + 1), F.col(column)]


def eligible(df: DataFrame, backend: str) -> Column:
    """Whether a result may be exported: valid, written by *backend*, no fallback."""
    return F.col("valid") & (F.col("backend") == backend) & (F.coalesce(F.trim("fallback"), F.lit("")) == "")


def set_differences(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(only in a, only in b, in both), each in order."""
    return F.array_sort(F.array_except(a, b)), F.array_sort(F.array_except(b, a)), F.array_sort(F.array_intersect(a, b))


def series_issues(projects: DataFrame, series: DataFrame, measures: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, code, detail) of the older report form: a target year that isn't in the series, no risk level, a measure text
    that is both accepted and rejected (duplicates don't count).

    *projects*: (key, target_year, risk_level); *series*: (key, year); *measures*: (key, text, accepted, reason).
    """
    years = series.select(key, F.col("year").alias("target_year")).distinct().withColumn("k_in", F.lit(True))
    x = projects.join(years, [key, "target_year"], "left")
    code = lambda test, name, detail="": F.when(test, F.struct(F.lit(name).alias("code"), F.lit(detail).alias("detail")))
    plain = F.array_compact(F.array(code(F.col("k_in").isNull(), "target_year_not_in_series"), code(F.coalesce("risk_level", F.lit("")) == "", "missing_risk_level")))
    out = x.select(key, F.explode(plain).alias("i")).select(key, "i.code", "i.detail")
    both = measures.groupBy(key, "text").agg(F.max(F.col("accepted").cast("int")).alias("a"), F.max((~F.col("accepted") & (F.col("reason") != "duplicate")).cast("int")).alias("r")).where("a = 1 and r = 1")
    return out.unionByName(both.select(key, F.lit("accepted_rejected_overlap").alias("code"), F.col("text").alias("detail")))


# Versions, and what may be said of classes and risk levels.
VERSIONS, CLASS_SEMANTICS, LEVEL_STATUSES = ["2.3-mvp", "2.4-mvp", "2.5-mvp"], ["unknown_codes", "mapped_cls_v1"], ["provided", "not_provided"]
RISK_PARTS = ["current", "trend", "spatial_gradient", "annual_series", "source_scope", "quality_flags"]


def report_issues(reports: DataFrame, diagnoses: DataFrame, measures: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, code, detail) where a report breaks what must hold of it.

    *reports*: (key, schema_version, landscape_class_semantics, risk_level, risk_level_status, risk_parts array of names or
    null, trend_aggregation); *diagnoses*: (key, problem_id, status, existence, features, has_context, rule_id, evidence
    array<struct<evidence_id, fact_ref>>); *measures*: (key, measure_id, targets, priority, parameter_status, parameters).
    """
    from .rules import INSUFFICIENT, NOT_APPLICABLE

    issue = lambda test, code, detail=None: F.when(test, F.struct(F.lit(code).alias("code"), (F.lit("") if detail is None else detail).alias("detail")))
    out = lambda df, *tests: df.select(key, F.explode(F.array_compact(F.array(*tests))).alias("i")).select(key, "i.code", "i.detail")
    v, parts = F.col("schema_version"), F.col("risk_parts")
    later = v.isin(VERSIONS[1:])
    level = F.coalesce("risk_level_status", F.lit(""))
    tops = out(
        reports, issue(~F.coalesce(v.isin(VERSIONS), F.lit(False)), "invalid_schema_version"), issue(later & F.col("landscape_class_semantics").isNull(), "missing_spatial_evidence"),
        issue(later & ~F.col("landscape_class_semantics").isin(CLASS_SEMANTICS), "invalid_landscape_class_semantics"), issue(later & ~level.isin(LEVEL_STATUSES), "invalid_risk_level_status"),
        issue(later & (level == "provided") & (F.coalesce("risk_level", F.lit("")) == ""), "missing_provided_risk_level"), issue((v == VERSIONS[2]) & parts.isNull(), "missing_risk_evidence"),
        issue((v == VERSIONS[2]) & parts.isNotNull() & (F.coalesce("trend_aggregation", F.lit("")) != "multi_scope_mean"), "invalid_risk_evidence", F.lit("trend")),
    )
    lacking = reports.where((v == VERSIONS[2]) & parts.isNotNull()).select(key, F.explode(F.array_except(F.array(*map(F.lit, RISK_PARTS)), parts)).alias("detail"))
    p = F.col("problem_id")
    unlinked = F.exists("evidence", lambda e: (F.coalesce(e["evidence_id"], F.lit("")) == "") | (F.coalesce(e["fact_ref"], F.lit("")) == ""))
    problems = out(
        diagnoses, issue((F.col("status") == INSUFFICIENT) & (F.col("existence") == "confirmed"), "insufficient_confirmed", p), issue((F.size(F.coalesce("features", F.array().cast("array<string>"))) == 0) | ~F.col("has_context"), "missing_analysis_context", p),
        issue(F.col("rule_id").isNull(), "missing_problem_provenance", p), issue(unlinked, "missing_evidence_provenance", p),
    )
    hidden = diagnoses.where(F.col("status").isin(INSUFFICIENT, NOT_APPLICABLE)).groupBy(key).agg(F.collect_set("problem_id").alias("hidden"))
    m = F.col("measure_id")
    kept = out(
        measures.join(hidden, key, "left"), issue(F.arrays_overlap("targets", F.coalesce("hidden", F.array().cast("array<string>"))), "measure_for_omitted_problem", m), issue(F.col("priority").isNotNull(), "measure_priority_present", m),
        issue((F.col("parameter_status") == "not_provided") & F.col("parameters").isNotNull(), "invented_parameters", m),
    )
    return tops.unionByName(lacking.select(key, F.lit("missing_risk_evidence").alias("code"), "detail")).unionByName(problems).unionByName(kept)


# Least and recommended lengths of a problem's text, by whether it is prominent; words that weigh a counter-signal.
FLOORS, RECOMMENDED = {True: 350, False: 80}, {True: (800, 1500), False: (200, 500)}
WEIGHING = "但|然而|不一致|反向|未支持|相对缓解|不能"


def _draft_state(drafts: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """Drafts beside the contexts that they are about, with the length of their text and whether counter-signals are weighed."""
    from .report import INDICATOR_LABELS, labelled
    from .rules import PROMINENT

    c = contexts.select(key, "problem_id", "problem_name", (F.col("status") == PROMINENT).alias("prominent"), F.transform("conflicting_signals", lambda s: s["indicator"]).alias("against"), F.lit(True).alias("in_context"))
    d = drafts.select(key, "problem_id", "title", "paragraphs", F.lit(True).alias("in_draft"))
    x = c.join(d, [key, "problem_id"], "full_outer")
    said = F.array_join("paragraphs", "")
    named = F.exists("against", lambda i: F.contains(said, i) | F.contains(said, labelled(INDICATOR_LABELS, i)))
    return x.withColumns({"said": said, "length": F.length(said), "weighed": (F.size("against") == 0) | (named & said.rlike(WEIGHING))})


def draft_issues(drafts: DataFrame, contexts: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, code, detail) of drafted problem texts (key, problem_id, title, paragraphs): problems without a text or texts
    without a problem, titles without the problem's name, empty or shallow texts, counter-evidence that is left out."""
    x = _draft_state(drafts, contexts, key)
    both = F.col("in_draft") & F.col("in_context")
    empty = (F.size("paragraphs") == 0) | F.exists("paragraphs", lambda t: F.trim(t) == "")
    floor = F.when(F.col("prominent"), FLOORS[True]).otherwise(FLOORS[False])
    issue = lambda test, code, detail=None: F.when(test, F.struct(F.lit(code).alias("code"), (F.col("problem_id") if detail is None else detail).alias("detail")))
    tests = F.array(
        issue(F.col("in_draft").isNull() | F.col("in_context").isNull(), "problem_block_mismatch"), issue(both & ~F.contains(F.coalesce("title", F.lit("")), F.col("problem_name")), "invalid_problem_title"), issue(both & empty, "invalid_problem_paragraphs"),
        issue(both & ~empty & (F.col("length") < floor), "problem_analysis_too_shallow", F.concat(F.col("problem_id"), F.lit(":"), F.col("length").cast("string"), F.lit("<"), floor.cast("string"))),
        issue(both & ~empty & ~F.col("weighed"), "counter_evidence_omitted"),
    )
    return x.select(key, F.explode(F.array_compact(tests)).alias("i")).select(key, "i.code", "i.detail")


def length_warnings(drafts: DataFrame, contexts: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, problem_id, length, low, high): texts outside the recommended lengths."""
    x = _draft_state(drafts, contexts, key).where("in_draft and in_context")
    low, high = (F.when(F.col("prominent"), RECOMMENDED[True][k]).otherwise(RECOMMENDED[False][k]) for k in (0, 1))
    return x.select(key, "problem_id", "length", low.alias("low"), high.alias("high")).where("length < low or length > high")


def repaired_drafts(drafts: DataFrame, contexts: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, problem_id, title, paragraphs, replaced): sentences that say what must not be said are taken out; where that hit
    anything, where a counter-signal isn't weighed or too little is left, the rules' own paragraphs stand in, filled up
    with a note to the least length."""
    from .report import BOUNDARY, problem_paragraphs
    from .text import FORBIDDEN_WRITING, MACHINE, PRIORITY

    bad = "|".join([*(f"(?:{p})" for p in FORBIDDEN_WRITING), f"(?i:{MACHINE.removeprefix('(?i)')})", f"(?:{PRIORITY})"])

    def clean(t: Column) -> Column:
        parts = F.regexp_extract_all(t, F.lit("[^。！？；\\n]+[。！？；]?|\\n+"), F.lit(0))
        return F.trim(F.array_join(F.filter(parts, lambda s: ~s.rlike(bad)), ""))

    cleaned = lambda ps: F.filter(F.transform(ps, clean), lambda t: t != "")
    own = contexts.select(key, "problem_id", cleaned(problem_paragraphs(contexts)).alias("own"))
    hit = drafts.select(key, "problem_id", F.array_join("paragraphs", "").rlike(bad).alias("hit"))
    x = _draft_state(drafts.withColumn("paragraphs", cleaned(F.col("paragraphs"))), contexts, key).where("in_draft and in_context").join(own, [key, "problem_id"]).join(hit, [key, "problem_id"])
    floor = F.when(F.col("prominent"), FLOORS[True]).otherwise(FLOORS[False])
    replaced = F.col("hit") | ~F.col("weighed") | (F.col("length") < floor)
    short = F.greatest(F.lit(0), F.ceil((floor - F.length(F.array_join("own", ""))) / len(BOUNDARY))).cast("int")
    filled = F.concat("own", F.array_repeat(F.lit(BOUNDARY), short))
    return x.select(key, "problem_id", F.col("problem_name").alias("title"), F.when(replaced, filled).otherwise(F.col("paragraphs")).alias("paragraphs"), replaced.alias("replaced"))
