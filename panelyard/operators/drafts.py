"""The contract of a whole drafted report, given as JSON text of whatever shape.

A draft is parsed to a variant, so that one of the wrong shape is a finding and no error: objects are taken apart as maps of
variants, lists as arrays of variants, and every part's type is asked before it is used.  Where a level is broken, nothing
below it is looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .assembly import FLOORS, WEIGHING
from .report import INDICATOR_LABELS, labelled
from .rules import INSUFFICIENT, NOT_APPLICABLE, PROMINENT
from .text import FORBIDDEN_WRITING, MACHINE, PRIORITY

# Sections of a draft.
SECTIONS = ["overall_assessment", "problem_analysis", "cross_problem", "restoration", "conclusion"]
_ISSUES = "array<struct<code: string, detail: string>>"


def _map(v: Column) -> Column:
    """An object's fields; null if it isn't an object."""
    return F.try_variant_get(v, "$", "map<string, variant>")


def _list(v: Column) -> Column:
    """A list's elements; null if it isn't a list."""
    return F.try_variant_get(v, "$", "array<variant>")


def _text(v: Column) -> Column:
    """A text; null if it isn't one, numbers included."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _full(v: Column) -> Column:
    """Whether a variant is a text with more than white space in it."""
    return F.coalesce(F.regexp_replace(_text(v), r"(?U)\s", "") != "", F.lit(False))


def _keys(fields: Column, *names: str) -> Column:
    """Whether an object has exactly these fields."""
    return F.coalesce(F.array_sort(F.map_keys(fields)) == F.array(*map(F.lit, sorted(names))), F.lit(False))


def _issue(code: str, detail: Column | str = "") -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def _found(*tests: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(test, issue) for test, issue in tests]))


def draft_contract_issues(drafts: DataFrame, contexts: DataFrame, unapproved: DataFrame, keys: list[str], key: str = "project_key") -> DataFrame:
    """(keys, code, detail) of whole drafts (*keys*, among them *key*; draft, a JSON text).

    *contexts*: the problems of every project (``analysis.contexts``; those that aren't reportable need no text); *unapproved*:
    (key, phrase), measures that a report may not name.
    """
    none = F.array().cast(_ISSUES)
    shown = contexts.where(~F.col("status").isin(INSUFFICIENT, NOT_APPLICABLE))
    p = F.struct("problem_id", "problem_name", (F.col("status") == PROMINENT).alias("prominent"), F.transform("conflicting_signals", lambda s: s["indicator"]).alias("against"))
    known = shown.groupBy(key).agg(F.array_sort(F.collect_list(p)).alias("ps"))
    banned = unapproved.groupBy(key).agg(F.array_sort(F.collect_set("phrase")).alias("banned"))
    x = drafts.join(known, key, "left").join(banned, key, "left").withColumns({"ps": F.coalesce("ps", F.array().cast("array<struct<problem_id: string, problem_name: string, prominent: boolean, against: array<string>>>")), "banned": F.coalesce("banned", F.array().cast("array<string>"))})
    x = x.withColumn("top", _map(F.try_parse_json("draft")))
    x = x.withColumns({"summary": _map(F.col("top")["summary"]), "sections": _list(F.col("top")["sections"])})
    named = F.transform("sections", lambda s: F.struct(_text(_map(s)["section_id"]).alias("id"), _map(s).alias("fields")))
    x = x.withColumn("named", named)
    of = lambda section: F.try_element_at(F.filter("named", lambda s: s["id"] == section), F.lit(1))["fields"]
    x = x.withColumn("analysis", of("problem_analysis")).withColumn("blocks", _list(F.coalesce(F.col("analysis")["problem_blocks"], F.parse_json(F.lit("[]")))))
    x = x.withColumn("block", F.transform("blocks", lambda b: F.struct(_text(_map(b)["problem_id"]).alias("id"), _map(b).alias("fields"), _list(_map(b)["paragraphs"]).alias("ps"))))

    head = F.col("summary")
    keywords, opening = _list(head["keywords"]), _list(head["paragraphs"])
    of_summary = _found(
        (~F.coalesce((F.size(opening) > 0) & F.forall(opening, _full), F.lit(False)), _issue("invalid_summary_paragraphs", "summary")),
        (~F.coalesce(F.size(keywords).between(3, 6), F.lit(False)), _issue("invalid_keywords")),
    )

    def of_section(s: Column) -> Column:
        f, deep = s["fields"], s["id"] == "problem_analysis"
        need = F.when(deep, F.array(*map(F.lit, ("section_id", "title", "problem_blocks")))).otherwise(F.array(*map(F.lit, ("section_id", "title", "paragraphs"))))
        may = F.when(deep, F.array(*map(F.lit, ("section_id", "title", "paragraphs", "problem_blocks")))).otherwise(need)
        fits = (F.size(F.array_except(need, F.map_keys(f))) == 0) & (F.size(F.array_except(F.map_keys(f), may)) == 0) & _full(f["title"])
        said = f["paragraphs"].isNull() | F.coalesce(F.forall(_list(f["paragraphs"]), _full), F.lit(False))
        return F.when(~F.coalesce(fits, F.lit(False)), F.array(_issue("invalid_section", s["id"]))).when(~said, F.array(_issue("invalid_section_paragraphs", s["id"]))).otherwise(none)

    def of_block(b: Column) -> Column:
        d = F.try_element_at(F.filter("ps", lambda z: z["problem_id"] == b["id"]), F.lit(1))
        title = F.contains(F.coalesce(_text(b["fields"]["title"]), F.lit("")), d["problem_name"])
        whole = F.coalesce((F.size(b["ps"]) > 0) & F.forall(b["ps"], _full), F.lit(False))
        said = F.array_join(F.transform(b["ps"], _text), "")
        floor = F.when(d["prominent"], FLOORS[True]).otherwise(FLOORS[False])
        length = F.length(said)
        weighed = (F.size(d["against"]) == 0) | (F.exists(d["against"], lambda i: F.contains(said, i) | F.contains(said, labelled(INDICATOR_LABELS, i))) & said.rlike(WEIGHING))
        shallow = F.concat(b["id"], F.lit(":"), length.cast("string"), F.lit("<"), floor.cast("string"))
        body = F.when(~whole, F.array(_issue("invalid_problem_paragraphs", b["id"]))).otherwise(_found((length < floor, _issue("problem_analysis_too_shallow", shallow)), (~weighed, _issue("counter_evidence_omitted", b["id"]))))
        return F.when(~_keys(b["fields"], "problem_id", "title", "paragraphs"), F.array(_issue("invalid_problem_block", b["id"]))).otherwise(F.concat(_found((~title, _issue("invalid_problem_title", b["id"]))), body))

    ids = F.transform("block", lambda b: F.coalesce(b["id"], F.lit("")))
    wanted = F.transform("ps", lambda z: z["problem_id"])
    apart = lambda a, b: F.array_join(F.array_sort(F.concat(F.array_except(a, b), F.array_except(b, a))), ",")
    same = (F.array_sort(F.array_distinct(ids)) == F.array_sort(wanted)) & (F.size(F.array_distinct(ids)) == F.size(ids))
    text = F.col("draft")
    one = lambda code, pattern: F.when(text.rlike(pattern), F.array(_issue(code, F.regexp_substr(text, F.lit(pattern))))).otherwise(none)
    words = F.concat(
        one("machine_language", MACHINE), F.when(text.rlike(PRIORITY), F.array(_issue("priority_language"))).otherwise(none), *[one("unsupported_inference_or_action", z) for z in FORBIDDEN_WRITING],
        F.transform(F.filter("banned", lambda m: F.contains(text, m)), lambda m: _issue("unapproved_measure", m)),
    )
    of_blocks = (
        F.when(F.col("blocks").isNull(), F.array(_issue("invalid_problem_blocks"))).when(~same, F.array(_issue("problem_block_mismatch", apart(ids, wanted))))
        .otherwise(F.concat(F.flatten(F.transform("block", of_block)), words))
    )
    section_ids = F.transform("named", lambda s: F.coalesce(s["id"], F.lit("")))
    all_sections = F.array(*map(F.lit, SECTIONS))
    complete = (F.array_sort(F.array_distinct(section_ids)) == F.array_sort(all_sections)) & (F.size(F.array_distinct(section_ids)) == F.size(section_ids))
    of_sections = (
        F.when(F.col("sections").isNull(), F.array(_issue("invalid_sections"))).when(~complete, F.array(_issue("section_mismatch", apart(section_ids, all_sections))))
        .otherwise(F.concat(F.flatten(F.transform("named", of_section)), of_blocks))
    )
    found = (
        F.when(F.col("top").isNull(), F.array(_issue("invalid_narrative_type"))).when(~_keys(F.col("top"), "summary", "sections"), F.array(_issue("invalid_draft_top_level", F.array_join(F.array_sort(F.map_keys("top")), ","))))
        .when(head.isNull() | ~_keys(head, "paragraphs", "keywords"), F.array(_issue("invalid_summary"))).otherwise(F.concat(of_summary, of_sections))
    )
    return x.select(*keys, F.explode(found).alias("i")).select(*keys, "i.code", "i.detail")
