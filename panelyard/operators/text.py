"""Text jobs over tables of texts: blocks of Markdown and pages, identities, sanitising, lint, sentence removal."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Ends of lines, and the white space that is stripped (Unicode's, and the separators U+001C to U+001F).
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
_SPACE = r"[\s\x1C-\x1F]"


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def _lines(texts: DataFrame, keys: Sequence[str], text: str, ends: str) -> DataFrame:
    return texts.select(*keys, F.posexplode(F.transform(F.split(F.coalesce(text, F.lit("")), ends, -1), stripped)).alias("pos", "line"))


def paragraphs(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, ordinal, kind, heading, block): headings (``#``) are blocks of their own and are carried down; other lines join up
    to a blank line or heading.  Lines end at any line break; white space inside a block is one blank."""
    x = _lines(texts, keys, text, LINE_ENDS)
    run = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = stripped(F.regexp_extract("line", r"(?Us)^#{1,6}\s+(.+)$", 1))
    x = x.withColumn("is_head", F.col("line").rlike(r"(?Us)^#{1,6}\s+.+$"))
    x = x.withColumns({"heading": F.last(F.when(F.col("is_head"), head), ignorenulls=True).over(run), "gap": F.count_if(F.col("is_head") | (F.col("line") == "")).over(run)})
    body = F.when(F.col("is_head"), F.col("heading")).otherwise(F.col("line"))
    g = x.where("line <> ''").groupBy(*keys, "gap", "is_head").agg(F.array_sort(F.collect_list(F.struct("pos", body.alias("line")))).alias("ls"), F.first("heading").alias("heading"))
    block = F.trim(F.regexp_replace(F.array_join(F.transform("ls", lambda z: z["line"]), " "), f"(?U){_SPACE}+", " "))
    g = g.withColumn("block", block).where("block <> ''")
    order = Window.partitionBy(*keys).orderBy("gap", F.desc("is_head"))
    return g.withColumn("ordinal", F.row_number().over(order)).select(*keys, "ordinal", F.when(F.col("is_head"), "heading").otherwise("paragraph").alias("kind"), F.coalesce("heading", F.lit("")).alias("heading"), "block")


def markdown_blocks(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, ordinal, kind, level, text, source, rows): pagebreak, toc, table (its rows together, without separator rows, each
    as wide as the first), image, caption, heading up to level 4, bullet or paragraph."""
    x = _lines(texts, keys, text, r"\r?\n").where("line <> ''")
    line = F.col("line")
    kind = (
        F.when(line == "<!-- pagebreak -->", "pagebreak").when(line == "<!-- toc -->", "toc").when(line.startswith("|") & line.endswith("|"), "table")
        .when(line.startswith("![") & line.contains("](") & line.endswith(")"), "image").when(line.rlike(r"(?Us)^\*\*[表图]\s+.+\*\*\z"), "caption").when(line.rlike(r"^#{1,4} "), "heading").when(line.startswith("- "), "bullet").otherwise("paragraph")
    )
    o = Window.partitionBy(*keys).orderBy("pos")
    x = x.withColumn("kind", kind)
    new = ~((F.col("kind") == "table") & F.coalesce((F.lag("kind").over(o) == "table") & (F.lag("pos").over(o) == F.col("pos") - 1), F.lit(False)))
    x = x.withColumn("part", F.count_if(new).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    cells = F.transform(F.split(F.trim(line, F.lit("|")), r"\|", -1), stripped)
    separator = F.forall(cells, lambda c: c.rlike(r"^[-:]+\z"))
    g = x.withColumn("cells", cells).where((F.col("kind") != "table") | ~separator).groupBy(*keys, "part", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "cells"))).alias("ls"))
    first = F.col("ls")[0]["line"]
    width = F.size(F.col("ls")[0]["cells"])
    rows = F.transform("ls", lambda r: F.transform(F.sequence(F.lit(1), width), lambda k: F.coalesce(F.try_element_at(r["cells"], k), F.lit(""))))
    at = F.instr(first, "](")
    said = (
        F.when(F.col("kind") == "image", F.substring(first, F.lit(3), at - 3)).when(F.col("kind") == "caption", stripped(F.substring(first, F.lit(3), F.length(first) - 4)))
        .when(F.col("kind") == "heading", stripped(F.regexp_replace(first, "^#+ ", ""))).when(F.col("kind") == "bullet", stripped(F.substring(first, F.lit(3), F.length(first)))).when(F.col("kind") == "paragraph", first).otherwise("")
    )
    return g.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy("part"))).select(
        *keys, "ordinal", "kind", F.when(F.col("kind") == "heading", F.length(F.regexp_extract(first, "^(#+)", 1))).otherwise(0).alias("level"), said.alias("text"),
        F.when(F.col("kind") == "image", F.substring(first, at + 2, F.length(first) - at - 2)).otherwise("").alias("source"), F.when(F.col("kind") == "table", rows).alias("rows"),
    )


def page_paragraphs(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, page, paragraph, block): pages end at form feeds, paragraphs at blank lines."""
    pages = texts.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\f")).alias("page", "body"))
    parts = pages.select(*keys, (F.col("page") + 1).alias("page"), F.posexplode(F.split("body", r"(?U)\n\s*\n")).alias("paragraph", "raw"))
    return parts.select(*keys, "page", (F.col("paragraph") + 1).alias("paragraph"), F.trim(F.regexp_replace("raw", f"(?U){_SPACE}+", " ")).alias("block")).where("block <> ''")


# What sources of a role may be used for.
FACTUAL_USE = {"prompt_spec": "none", "optimization_reference": "none", "indicator_method": "definition_only", "indicator_analysis": "interpretation_reference", "strategy_mapping": "structured_source", "legacy_example": "none"}


def block_id(*columns: Column | str) -> Column:
    """The first 20 hexadecimal digits of the SHA-256 of the columns, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *columns), 256), 1, 20)


def source_blocks(sources: DataFrame, key: str, text: str = "text", role: str = "role") -> DataFrame:
    """(key, role, factual_use, source_sha256, ordinal, kind, heading, block, block_id): the blocks of every source with what they
    may be used for; a role that isn't known has no use."""
    policy = F.create_map(*[F.lit(z) for kv in FACTUAL_USE.items() for z in kv])
    x = sources.withColumns({"source_sha256": F.sha2(F.coalesce(text, F.lit("")), 256), "factual_use": F.coalesce(F.try_element_at(policy, F.col(role)), F.lit("none"))})
    keys = [key, role, "factual_use", "source_sha256"]
    b = paragraphs(x, keys, text)
    return b.withColumn("block_id", block_id("source_sha256", F.col("ordinal").cast("string"), "kind", "heading", "block"))


def source_entries(sources: DataFrame, blocks: DataFrame, key: str, text: str = "text", role: str = "role") -> DataFrame:
    """(key, role, source_sha256, size, block_count, text_chars, duplicate): one row a source; duplicate: its bytes came under a
    smaller key already."""
    n = blocks.groupBy(key).agg(F.count("*").alias("block_count"), F.sum(F.length("block")).cast("long").alias("text_chars"))
    body = F.coalesce(text, F.lit(""))
    x = sources.select(key, role, F.sha2(body, 256).alias("source_sha256"), F.octet_length(body).cast("long").alias("size"))
    first = x.groupBy("source_sha256").agg(F.min(key).alias("k_first"))
    x = x.join(first, "source_sha256").join(n, key, "left")
    return x.select(key, role, "source_sha256", "size", F.coalesce("block_count", F.lit(0)).alias("block_count"), F.coalesce("text_chars", F.lit(0)).alias("text_chars"), (F.col(key) != F.col("k_first")).alias("duplicate"))


def corpus_fingerprint(entries: DataFrame, *columns: str) -> DataFrame:
    """(entries, fingerprint): one row, the same in whatever order the entries come: their digests' first 48 bits are added up."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("\0", *columns), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("fingerprint"))


def source_statistics(blocks: DataFrame, keys: Sequence[str], text: str = "block") -> DataFrame:
    return blocks.groupBy(*keys).agg(F.count("*").alias("blocks"), F.sum(F.length(text)).cast("long").alias("chars"))


def sanitise(text: Column, replacements: Mapping[str, str], drop: Sequence[str] = ()) -> Column:
    """Literal replacements in their order, then patterns taken out."""
    for old, new in replacements.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    for pattern in drop:
        text = F.regexp_replace(text, pattern, "")
    return text


# Headings, sections and phrases of the older lint, and the patterns of both.
HEADINGS_V1 = ["摘要", "1 项目与数据概况", "1.1 项目基本信息", "1.2 本次评价指标", "2 综合生态状况", "3 生态问题逐项诊断", "4 生态问题诊断汇总", "5 生态修复策略建议", "5.1 策略选择原则", "6 综合修复建议", "7 结论"]
FORBIDDEN_SECTIONS = ["修复效果监测建议", "修复指标目标值", "措施成效评价指标"]
EXAGGERATED = ["极其严重", "非常危险", "灾难性", "严重失控"]
PARAMETER_V1 = r"\d+(?:\.\d+)?\s*(?:米|公里|公顷|亩|吨|千克|公斤|万元|元|天|个月|年工期|株|克/平方米)"
CAUSAL = r"(?:由于|因).{0,40}(?:导致|造成)"
HEADINGS_V2 = ["摘要", "目录", "1 项目与评价基础", "2 综合生态状况", "3 突出生态问题", "4 持续观察的潜在问题", "5 生态问题综合诊断", "6 生态修复策略", "7 综合修复建议", "8 结论", "附录 A 指标趋势结果", "附录 B 证据与措施追溯"]
ELEMENTS_V2 = ["<!-- toc -->", "**关键词：**", "表 1-1"]
PARAMETER_V2 = r"\d+(?:\.\d+)?\s*(?:米|公里|公顷|亩|吨|千克|公斤|万元|元|天|个月|株|克/平方米)"
MACHINE = r"(?i)支持状态为\s*(?:True|False)|analysis_context|supports_problem|PR-P\d+|historical_abandoned_mine|ca_landcover_type|has_buffer_gradient|&#x20;|诊断规则|规则指定|关键条件.{0,20}未满足|当前结论不可评估|ReportIR|\bAgent\b|\bWriter\b|\bJSON\b"
PRIORITY = r"优先级|评分因子|归入\s*P[0-3]|P[0-3]级"
# What a report of the later kind must hold if it has risk evidence, or a chart of this name.
RISK_HEADING, FIGURES = "2.2 综合生态风险证据", {"figure-5-1": "图 5-1", "figure-2-3": "图 2-3"}
LEAKED_NULL = ["综合风险等级为None", "综合风险等级为null"]
FORBIDDEN_WRITING = [
    r"可能[^。；\n]{0,24}(?:反映|由于|导致|生效|受限于|源于|归因于)", r"可能[^。；\n]{0,32}(?:处于|来自|受到|关联)", r"通常反映|自然波动|局部环境因子|饱和点|污染压力|驱动机制|风险源解析|敏感性评估", r"未受显著负面干扰",
    r"(?:排查|建议)[^。；\n]{0,20}(?:因子|原因|开展|监测|监控|干预|投入)",
]


def lint_rules(version: int) -> list[tuple[str, str, str]]:
    """(code, how, pattern): lacks, lacks_line, has: the text itself; each, any: a pattern."""
    if version == 1:
        return [("missing_heading", "lacks_line", h) for h in HEADINGS_V1] + [("forbidden_section", "has", x) for x in FORBIDDEN_SECTIONS] + [("exaggerated_language", "has", x) for x in EXAGGERATED] + [("invented_implementation_parameter", "each", PARAMETER_V1), ("unsupported_causal_claim", "any", CAUSAL)]
    return (
        [("missing_heading", "lacks", h) for h in HEADINGS_V2] + [("missing_report_element", "lacks", x) for x in ELEMENTS_V2] + [("missing_risk_level_leaked", "has", x) for x in LEAKED_NULL]
        + [("invented_implementation_parameter", "each", PARAMETER_V2), ("machine_language", "any", MACHINE), ("priority_language", "any", PRIORITY + r"|P[0-3](?!\d)")]
    )


def required(reports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, code, phrase): what the text of a report must hold for what it has; *reports*: (keys, has_risk, charts array of names)."""
    heading = F.when(F.col("has_risk"), F.array(F.struct(F.lit("missing_heading").alias("code"), F.lit(RISK_HEADING).alias("phrase")))).otherwise(F.array().cast("array<struct<code: string, phrase: string>>"))
    figures = F.transform(F.filter("charts", lambda c: c.isin(list(FIGURES))), lambda c: F.struct(F.lit("missing_report_element").alias("code"), F.try_element_at(F.create_map(*[F.lit(z) for kv in FIGURES.items() for z in kv]), c).alias("phrase")))
    return reports.select(*keys, F.explode(F.concat(heading, figures)).alias("i")).select(*keys, "i.code", "i.phrase")


def lint(texts: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, str, str]], text: str = "text", phrases: DataFrame | None = None, needed: DataFrame | None = None) -> DataFrame:
    """(keys, code, detail): one row a finding.  A number that a digit or a point precedes is no parameter.  *phrases*: (keys,
    code, phrase), what one entity's text must not hold, such as rejected measures or problems that aren't reported; *needed*:
    the same of what it must hold (``required``)."""
    t = F.coalesce(text, F.lit(""))
    one = lambda code, test, detail: F.when(test, F.array(F.struct(F.lit(code).alias("code"), detail.alias("detail"))))
    found = []
    for code, how, x in rules:
        if how == "each":
            found.append(F.transform(F.regexp_extract_all(t, F.lit(rf"(?<![\d.])({x})"), F.lit(1)), lambda m: F.struct(F.lit(code).alias("code"), m.alias("detail"))))  # noqa: B023
        elif how == "any":
            found.append(one(code, t.rlike(x), F.regexp_substr(t, F.lit(x))))
        elif how == "has":
            found.append(one(code, F.contains(t, F.lit(x)), F.lit(x)))
        else:
            there = t.rlike(rf"(?m)^#{{2,4}}\s+{re.escape(x)}\s*$") if how == "lacks_line" else F.contains(t, F.lit(x))
            found.append(one(code, ~there, F.lit(x)))
    none = F.array().cast("array<struct<code: string, detail: string>>")
    out = texts.select(*keys, F.explode(F.concat(*[F.coalesce(f, none) for f in found])).alias("i")).select(*keys, "i.code", "i.detail")
    if needed is not None:
        lacks = texts.select(*keys, t.alias("k_text")).join(needed, list(keys)).where(~F.contains("k_text", F.col("phrase")))
        out = out.unionByName(lacks.select(*keys, "code", F.col("phrase").alias("detail")).distinct())
    if phrases is None:
        return out
    held = texts.select(*keys, t.alias("k_text")).join(phrases, list(keys)).where(F.contains("k_text", F.col("phrase")) & (F.col("phrase") != ""))
    return out.unionByName(held.select(*keys, "code", F.col("phrase").alias("detail")).distinct())


# What is replaced in a source's text before it is written from, in this order, and sentences that go.
WRITER_PATTERNS = [(r"规则ID为PR-P\d+[，,]?\s*", ""), (r"规则\s*(?:ID\s*)?为?\s*PR-P\d+\s*指定", "既定条件指定"), (r"PR-P\d+", "")]
WRITER_WORDS = {
    "问题规则指定的核心指标": "问题涉及的核心指标", "规则指定指标": "核心指标", "规则指定": "既定", "诊断规则": "诊断条件", "ca_landcover_type": "土地覆盖类型数据", "has_buffer_gradient": "缓冲区梯度数据",
    "historical_abandoned_mine": "历史遗留废弃矿区数据", "当前结论不可评估": "现有数据不足以形成该项判断", "关键条件不足": "必要证据不足",
}
WRITER_SENTENCES = [
    r"[^。！？；\n]*可能[^。！？；\n]{0,40}(?:反映|由于|导致|生效|受限于|源于|归因于)[^。！？；\n]*[。！？；]?", r"[^。！？；\n]*(?:通常反映|自然波动|局部环境因子|饱和点|污染压力|驱动机制|风险源解析|敏感性评估)[^。！？；\n]*[。！？；]?",
    r"[^。！？；\n]*可能[^。！？；\n]{0,40}(?:处于|来自|受到|关联|扩散)[^。！？；\n]*[。！？；]?", r"[^。！？；\n]*(?:排查|建议)[^。！？；\n]{0,30}(?:因子|原因|开展|监测|监控|干预|投入)[^。！？；\n]*[。！？；]?",
]
CANNOT_JUDGE = "现有数据不足以判断具体原因。"


def writer_text(text: Column) -> Column:
    """A text as a writer may see it: codes replaced, sentences that suppose causes or actions rewritten."""
    for pattern, new in WRITER_PATTERNS:
        text = F.regexp_replace(text, pattern, new)
    text = sanitise(text, WRITER_WORDS)
    for pattern in WRITER_SENTENCES:
        text = F.regexp_replace(text, pattern, CANNOT_JUDGE)
    return text


def drop_sentences(text: Column, pattern: str, end: str = "。") -> Column:
    """Without the sentences (up to *end*) that the pattern finds."""
    return F.array_join(F.filter(F.split(text, f"(?<={end})"), lambda s: ~s.rlike(pattern)), "")


IMAGE = r"!\[[^\]]*\]\([^)]+\)"


def chart_placeholders(text: Column) -> Column:
    """Every Markdown image becomes ``{{chart:N}}``, N from 1."""
    parts = F.split(text, IMAGE, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("{{chart:"), i.cast("string"), F.lit("}}"), p))), "")


def export_issue(text: Column, charts: Column) -> Column:
    """Why a report can't go out: another number of images than *charts*, or a URL left in the text; null if it can."""
    n = F.regexp_count(text, F.lit(IMAGE))
    return F.when(n != charts, F.concat(F.lit("expected "), charts.cast("string"), F.lit(" images, found "), n.cast("string"))).when(chart_placeholders(text).rlike("https?://"), "url remains")
