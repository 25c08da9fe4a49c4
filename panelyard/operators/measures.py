"""Measure texts: segmentation, audit with reasons, knowledge match and greedy choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .substrings import matches, small

ML_PREFIX = "[ML推荐]"
SPREAD = 64
# Fragments that rule a measure out, by project type, by missing rule, as monitoring, by site feature.
PROHIBITED = {"coal": ["设置光伏板", "风机基础"], "solar": ["煤矸石", "尾矿", "露天采坑", "塌陷坑", "风机基础"], "wind": ["设置光伏板", "光伏组件", "煤矸石", "尾矿", "露天采坑", "塌陷坑"]}
UNAVAILABLE = {"重金属污染": ["重金属", "超富集", "耐污", "植-菌", "收割后无害化"]}
MONITORING = ["监测", "动态评估", "复盘"]
SITE_FEATURES = {"gangue_or_tailings": ["煤矸石", "矸石堆", "尾矿", "裸露堆体"], "open_pit_or_subsidence": ["露天采坑", "采坑", "塌陷坑"]}
# Measures that are known (id, name, types, problems that they target, mechanism).
KNOWLEDGE = [
    ("M001", "选用本土固碳乔灌草混播构建多层群落", ["coal"], ["P001", "P002"], "恢复乡土植被群落并增强植被固碳功能"),
    ("M002", "乡土耐旱灌草群落营建", ["coal", "solar", "wind"], ["P001", "P006"], "恢复耐旱乡土植被覆盖"),
    ("M003", "乡土种子库人工补播", ["coal", "solar", "wind"], ["P001", "P003"], "补充乡土植物繁殖材料"),
    ("M004", "矿区外围生态防护林带搭建", ["coal"], ["P004", "P005", "P006", "P008"], "增强生态空间连续性并缓冲边缘扰动"),
    ("M005", "人工辅助近自然基底修整", ["coal"], ["P004", "P008", "P010"], "改善受扰基底并促进近自然恢复"),
    ("M006", "关键节点人工补强", ["coal", "solar", "wind"], ["P004", "P008", "P010"], "补强生态网络关键节点的连通作用"),
    ("M007", "生态封禁管护划定", ["coal", "solar", "wind"], ["P001", "P003", "P008"], "降低持续扰动并为自然恢复提供条件"),
]
SOURCE, ML_SOURCE = "workbook_measure_text", "ml_recommendation"


def knowledge_table(spark: SparkSession, rows: Sequence[tuple] = tuple(KNOWLEDGE)) -> DataFrame:
    return spark.createDataFrame(list(rows), "measure_id string, name string, types array<string>, targets array<string>, mechanism string")


def segments(texts: DataFrame, keys: Sequence[str], text: str = "measure_text", delimiters: str = "[；;]") -> DataFrame:
    """(keys, pos, text, source): each segment trimmed, inner white space as one blank, prefix taken off and told as the source."""
    raw = texts.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), delimiters)).alias("pos", "raw"))
    tidy = lambda c: F.trim(F.regexp_replace(c, "(?U)\\s+", " "), F.lit(" ；;"))
    x = raw.withColumn("t", tidy(F.col("raw")))
    ml = F.startswith("t", F.lit(ML_PREFIX))
    return x.select(*keys, "pos", F.when(ml, tidy(F.substring("t", len(ML_PREFIX) + 1, 2**31 - 1))).otherwise(F.col("t")).alias("text"), F.when(ml, ML_SOURCE).otherwise(SOURCE).alias("source")).where("text <> ''")


def first_fragment(text: Column, fragments: Sequence[str]) -> Column:
    """The first of *fragments*, in their order, that *text* contains; null if none."""
    return F.coalesce(*[F.when(text.contains(f), F.lit(f)) for f in fragments], F.lit(None).cast("string"))


def audit(parts: DataFrame, keys: Sequence[str], project_type: str = "project_type", features: str | None = None, prohibited: Mapping = PROHIBITED, unavailable: Mapping = UNAVAILABLE, monitoring: Sequence[str] = tuple(MONITORING), sites: Mapping = SITE_FEATURES) -> DataFrame:
    """Adds ``reason`` and ``accepted``.  Reasons go by precedence: duplicate (of an earlier segment of the same keys,
    whatever became of it), type conflict, missing rule, monitoring, site feature (*features*: an array column)."""
    t = F.col("text")
    nth = F.row_number().over(Window.partitionBy(*keys, "text").orderBy("pos"))
    conflict = F.coalesce(*[F.when(F.col(project_type) == k, first_fragment(t, v)) for k, v in prohibited.items()], F.lit(None).cast("string"))
    missing = F.coalesce(*[F.when(first_fragment(t, v).isNotNull(), F.lit(k)) for k, v in unavailable.items()], F.lit(None).cast("string"))
    have = F.col(features) if features else F.array().cast("array<string>")
    # The first feature that the text names, and only that one, must be there.
    named = F.coalesce(*[F.when(first_fragment(t, v).isNotNull(), F.lit(k)) for k, v in sites.items()], F.lit(None).cast("string"))
    site = F.when(~F.coalesce(F.array_contains(have, named), F.lit(False)), named)
    watch = first_fragment(t, monitoring)
    reason = F.coalesce(
        F.when(F.col("nth") > 1, "duplicate"), F.concat(F.lit("project_type_conflict:"), conflict), F.concat(F.lit("requires_unavailable_problem_rule:"), missing),
        F.concat(F.lit("v1_monitoring_measure_excluded:"), watch), F.concat(F.lit("requires_site_feature:"), site), F.lit("accepted"),
    )
    return parts.withColumn("nth", nth).withColumn("reason", reason).drop("nth").withColumn("accepted", F.col("reason") == "accepted")


def fragment_table(spark: SparkSession, prohibited: Mapping = PROHIBITED, unavailable: Mapping = UNAVAILABLE, monitoring: Sequence[str] = tuple(MONITORING), sites: Mapping = SITE_FEATURES) -> DataFrame:
    """(pattern_id, pattern, kind, scope, name, rank): the fragments of ``audit`` as rows; such a table may be of any length.  Of
    one kind and scope the smallest rank wins; *name* is what the reason says."""
    rows = [("type", k, f, f) for k, v in prohibited.items() for f in v] + [("rule", "", k, f) for k, v in unavailable.items() for f in v]
    rows += [("watch", "", f, f) for f in monitoring] + [("site", "", k, f) for k, v in sites.items() for f in v]
    return spark.createDataFrame([(i, f, kind, scope, name, i) for i, (kind, scope, name, f) in enumerate(rows)], "pattern_id long, pattern string, kind string, scope string, name string, rank long")


def audit_by_table(parts: DataFrame, keys: Sequence[str], fragments: DataFrame, project_type: str = "project_type", features: str | None = None) -> DataFrame:
    """``audit`` with the fragments as a table (``fragment_table``; scopes count for the kind *type*), met through an index of
    their pieces.  The exchange that finds duplicates is the only one that texts pass; their hits are gathered where they are."""
    kinds = ("type", "rule", "watch", "site")
    scope = F.when(F.col("kind") == "type", F.col("scope")).otherwise("").alias("k_scope")
    of = fragments.select("pattern_id", F.col("kind").alias("k_kind"), scope, F.col("rank").alias("k_rank"), F.col("name").alias("k_name"))
    x = parts.withColumn("k_nth", F.row_number().over(Window.partitionBy(*keys, "text").orderBy("pos")))
    near = small(fragments)
    hits = matches(x, fragments, outer=True).join(near(of.drop("k_name")), "pattern_id", "left")
    applies = (F.col("k_kind") != "type") | (F.col("k_scope") == F.col(project_type))
    first = hits.groupBy(*x.columns).agg(*[F.min(F.when(applies & (F.col("k_kind") == k), F.col("k_rank"))).alias(f"k_{k}") for k in kinds])
    kind = F.coalesce(*[F.when(F.col(f"k_{k}").isNotNull(), k) for k in kinds])
    first = first.withColumn("k_kind", kind).withColumn("k_rank", F.coalesce(*[f"k_{k}" for k in kinds])).withColumn("k_scope", F.when(kind == "type", F.col(project_type)).otherwise(""))
    named = first.join(near(of.groupBy("k_kind", "k_scope", "k_rank").agg(F.min("k_name").alias("k_name"))), ["k_kind", "k_scope", "k_rank"], "left")
    have = F.coalesce(F.array_contains(F.col(features) if features else F.array().cast("array<string>"), F.col("k_name")), F.lit(False))
    said = {"type": "project_type_conflict:", "rule": "requires_unavailable_problem_rule:", "watch": "v1_monitoring_measure_excluded:"}
    reason = F.coalesce(
        F.when(F.col("k_nth") > 1, "duplicate"), *[F.when(F.col("k_kind") == k, F.concat(F.lit(v), "k_name")) for k, v in said.items()],
        F.when((F.col("k_kind") == "site") & ~have, F.concat(F.lit("requires_site_feature:"), "k_name")), F.lit("accepted"),
    )
    return named.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "accepted").select(*parts.columns, "reason", "accepted")


def match_knowledge(accepted: DataFrame, problems: DataFrame, knowledge: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, measure_id, name, mechanism, targets array, first_target): known measures of a project's type that target its reportable
    problems (*problems*: key, problem_id, ord), targets in the problems' order."""
    known = accepted.join(F.broadcast(knowledge), (F.col("text") == F.col("name")) & F.array_contains("types", F.col("project_type")))
    wanted = known.select(key, "measure_id", "name", "mechanism", F.explode("targets").alias("problem_id")).distinct().join(problems.select(key, "problem_id", "ord"), [key, "problem_id"])
    hits = F.array_sort(F.collect_list(F.struct("ord", "problem_id")))
    g = wanted.groupBy(key, "measure_id", "name", "mechanism").agg(hits.alias("hits"))
    return g.select(key, "measure_id", "name", "mechanism", F.transform("hits", lambda h: h["problem_id"]).alias("targets"), F.col("hits")[0]["ord"].alias("first_target"))


def unknown_measures(accepted: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Accepted segments that no known measure of their project type names."""
    known = knowledge.select(F.col("name").alias("text"), F.explode("types").alias("project_type"))
    return accepted.join(F.broadcast(known), ["text", "project_type"], "left_anti").withColumn("reason", F.lit("not_in_measure_knowledge"))


def takeable(asked: DataFrame, candidates: DataFrame, key: str, cap: int) -> DataFrame:
    """(key, pos, text) of *candidates* that a greedy choice for *asked* (key, ps) may reach: for each problem the first
    different texts that fit it, as many as all problems of the key take together."""
    each = asked.select(key, F.size("ps").alias("size"), F.posexplode("ps").alias("nr", "p")).select(key, "size", "nr", F.col("p.keywords").alias("keywords"))
    fits = candidates.groupBy(key, "text").agg(F.min("pos").alias("pos")).join(each, key).where(F.exists("keywords", lambda k: F.contains("text", k)))
    fits = fits.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(SPREAD)))
    for by in ([key, "nr", "part"], [key, "nr"]):
        fits = fits.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("pos", "text"))).where(F.col("nth") <= cap * F.col("size"))
    return fits.select(key, "pos", "text").distinct()


def greedy(problems: DataFrame, candidates: DataFrame, key: str = "project_key", cap: int = 3) -> DataFrame:
    """(key, problem, text, keyword): problems in order take up to *cap* measures each, a measure once, by first keyword.

    *problems*: (key, ord, problem, keywords array); *candidates*: (key, pos, text).  The choice runs over two arrays of
    one entity in one fold.  Of its measures only those come there that may be taken: the first different ones that fit
    a problem, as many as all problems take together; they are ranked in SPREAD parts first, so that none is ranked whole.
    """
    p = problems.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "problem", "keywords"))).alias("ps"))
    fits = takeable(p, candidates, key, cap)
    m = fits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("ms"))
    none = F.expr("cast(array() as array<struct<problem: string, text: string, keyword: string>>)")

    def step(done: Column, problem: Column) -> Column:
        used = F.transform(done, lambda d: d["text"])
        word = lambda t: F.try_element_at(F.filter(problem["keywords"], lambda k: F.contains(t, k)), F.lit(1))
        fit = F.filter(F.col("ms"), lambda c: ~F.array_contains(used, c["text"]) & word(c["text"]).isNotNull())
        return F.concat(done, F.transform(F.slice(fit, 1, cap), lambda c: F.struct(problem["problem"].alias("problem"), c["text"].alias("text"), word(c["text"]).alias("keyword"))))

    return p.join(m, key).select(key, F.posexplode(F.aggregate("ps", none, step)).alias("ord", "pick")).select(key, "ord", "pick.problem", "pick.text", "pick.keyword")


def strategy_sections(selected: DataFrame, problems: DataFrame, key: str = "project_key") -> DataFrame:
    """(key, ord, problem, status, measures array): what was selected, grouped by problem in the problems' order; problems
    without a measure have no section.  *selected*: (key, ord, problem, text, keyword); *problems*: (key, ord, problem, status)."""
    g = selected.groupBy(key, "problem").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "keyword"))).alias("ms"))
    g = g.select(key, "problem", F.transform("ms", lambda m: F.struct(m["text"].alias("text"), F.concat(F.lit("keyword:"), m["keyword"]).alias("match_type"))).alias("measures"))
    return problems.select(key, "ord", "problem", "status").join(g, [key, "problem"]).select(key, "ord", "problem", "status", "measures")
