"""Registered queries of the text and report operators, over documents, pages and the panel's diagnoses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental, quality, rules, text, trend
from ..sources import sinks, tables
from . import panel
from .panel import FACTS_SQL, PANEL_SQL, table
from .queries import DIAGNOSE_SQL, _diagnoses, query

# Lines of documents become headings, table rows, separators, images, bullets, captions and breaks by their number, so
# that the block parsers have all kinds to tell apart; some end in CRLF, some have tabs around, some a lone CR within.
_KINDS = [
    ("# ", ""), None, ("| ", " | x |"), "|---|:-:|", ("| ", " |"), "![alt](y/z.png)", ("- ", ""), ("**图 1 ", "**"), "<!-- pagebreak -->", ("##### ", ""), "<!-- toc -->", ("## ", ""),
]
_KIND = "CASE i % 13 " + " ".join(f"WHEN {k} THEN " + ("''" if x is None else f"'{x}'" if isinstance(x, str) else f"'{x[0]}' || l || '{x[1]}'") for k, x in enumerate(_KINDS)) + " ELSE l END"
_MARKED = f"CASE WHEN i % 5 = 0 THEN ({_KIND}) || chr(13) WHEN i % 5 = 1 THEN chr(9) || ({_KIND}) || ' ' || chr(9) WHEN i % 35 = 2 THEN ({_KIND}) || chr(13) || 'x  y' ELSE {_KIND} END"


def _marked(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.split("text", "\n").alias("ls"))

    def line(l, i):  # noqa: E741
        made = [F.lit("") if x is None else F.lit(x) if isinstance(x, str) else F.concat(F.lit(x[0]), l, F.lit(x[1])) for x in _KINDS]
        said = F.coalesce(F.try_element_at(F.array(*made), (i % 13 + 1).cast("int")), l)
        return F.when(i % 5 == 0, F.concat(said, F.lit("\r"))).when(i % 5 == 1, F.concat(F.lit("\t"), said, F.lit(" \t"))).when(i % 35 == 2, F.concat(said, F.lit("\rx  y"))).otherwise(said)

    return lines.select("doc_id", "source", F.array_join(F.transform("ls", line), "\n").alias("text"))


_LINES_SQL = f"""ls AS (SELECT doc_id, source, unnest(s) AS l, generate_subscripts(s, 1) - 1 AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents)),
mk AS (SELECT doc_id, source, i, raw, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM (SELECT doc_id, source, i, {_MARKED} AS raw FROM ls))"""

_PARAGRAPHS_SQL = rf"""{_LINES_SQL},
br AS (SELECT doc_id, source, i, unnest(s) AS piece, generate_subscripts(s, 1) AS k FROM (SELECT doc_id, source, i, string_split(regexp_replace(raw, '\r$', ''), chr(13)) AS s FROM mk)),
h AS (SELECT doc_id, source, i * 10 + k AS i, line, regexp_matches(line, '^#{{1,6}}\s+.+$') AS is_head FROM (SELECT *, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS line FROM br)),
g AS (SELECT *, last_value(CASE WHEN is_head THEN regexp_replace(regexp_extract(line, '^#{{1,6}}\s+(.+)$', 1), '^\s+|\s+$', '', 'g') END IGNORE NULLS) OVER w AS heading, count(*) FILTER (is_head OR line = '') OVER w AS gap FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT doc_id, source, gap, is_head, coalesce(any_value(heading), '') AS heading, trim(regexp_replace(string_agg(CASE WHEN is_head THEN heading ELSE line END, ' ' ORDER BY i), '\s+', ' ', 'g'), ' ') AS block FROM g WHERE line <> '' GROUP BY ALL),
bl AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY gap, is_head DESC)::INT AS ordinal, CASE WHEN is_head THEN 'heading' ELSE 'paragraph' END AS kind, heading, block FROM b WHERE block <> '')"""


@query(f"WITH {_PARAGRAPHS_SQL} SELECT doc_id, ordinal, kind, heading, block FROM bl")
def md_paragraphs(spark, sf_dir):
    """Headings and paragraphs, each with the heading above it."""
    return text.paragraphs(_marked(spark, sf_dir), ["doc_id"])


@query(rf"""WITH {_LINES_SQL},
k AS (SELECT doc_id, i, line FROM mk WHERE line <> ''),
k2 AS (SELECT *, CASE WHEN line = '<!-- pagebreak -->' THEN 'pagebreak' WHEN line = '<!-- toc -->' THEN 'toc' WHEN starts_with(line, '|') AND ends_with(line, '|') THEN 'table' WHEN starts_with(line, '![') AND contains(line, '](') AND ends_with(line, ')') THEN 'image'
  WHEN regexp_matches(line, '^\*\*(表|图)\s+.+\*\*$', 's') THEN 'caption' WHEN regexp_matches(line, '^#{{1,4}} ') THEN 'heading' WHEN starts_with(line, '- ') THEN 'bullet' ELSE 'paragraph' END AS kind FROM k),
k3 AS (SELECT *, lag(kind) OVER w AS pk, lag(i) OVER w AS pi FROM k2 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k4 AS (SELECT *, count(*) FILTER (NOT (kind = 'table' AND coalesce(pk = 'table' AND pi = i - 1, false))) OVER (PARTITION BY doc_id ORDER BY i) AS part, [regexp_replace(c, '^\s+|\s+$', '', 'g') for c in string_split(trim(line, '|'), '|')] AS cells FROM k3),
k5 AS (SELECT * FROM k4 WHERE kind <> 'table' OR NOT list_bool_and([regexp_matches(c, '^[-:]+$') for c in cells])),
k6 AS (SELECT *, first_value(len(cells)) OVER (PARTITION BY doc_id, part ORDER BY i) AS w FROM k5),
k7 AS (SELECT doc_id, part, kind, arg_min(line, i) AS f, string_agg(array_to_string([coalesce(cells[j], '') for j in range(1, w + 1)], '¦'), '¶' ORDER BY i) AS rows FROM k6 GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part)::INT AS ordinal, kind, CASE WHEN kind = 'heading' THEN length(regexp_extract(f, '^(#+)', 1)) ELSE 0 END::INT AS level,
  CASE kind WHEN 'image' THEN substr(f, 3, instr(f, '](') - 3) WHEN 'caption' THEN trim(substr(f, 3, length(f) - 4), ' ') WHEN 'heading' THEN trim(regexp_replace(f, '^#+ ', ''), ' ') WHEN 'bullet' THEN trim(substr(f, 3), ' ') WHEN 'paragraph' THEN f ELSE '' END AS text,
  CASE WHEN kind = 'image' THEN substr(f, instr(f, '](') + 2, length(f) - instr(f, '](') - 2) ELSE '' END AS source, CASE WHEN kind = 'table' THEN rows ELSE '' END AS "rows" FROM k7""")
def md_blocks(spark, sf_dir):
    """Blocks by kind, a table's rows together and alike in width."""
    rows = F.coalesce(F.array_join(F.transform("rows", lambda r: F.array_join(r, "¦")), "¶"), F.lit(""))
    return text.markdown_blocks(_marked(spark, sf_dir), ["doc_id"]).withColumn("rows", rows)


@query(r"""WITH p AS (SELECT doc_id, unnest(s) AS body, generate_subscripts(s, 1) AS page FROM (SELECT doc_id, string_split(replace(text, '. ', chr(12)), chr(12)) AS s FROM documents)),
q AS (SELECT doc_id, page, unnest(s) AS raw, generate_subscripts(s, 1) AS paragraph FROM (SELECT doc_id, page, regexp_split_to_array(replace(body, ', ', chr(10) || chr(10)), '\n\s*\n') AS s FROM p))
SELECT doc_id, page::INT AS page, paragraph::INT AS paragraph, trim(regexp_replace(raw, '\s+', ' ', 'g'), ' ') AS block FROM q WHERE trim(regexp_replace(raw, '\s+', ' ', 'g'), ' ') <> ''""")
def page_paragraphs(spark, sf_dir):
    """Paragraphs of pages (sentences stand for pages, clauses for paragraphs)."""
    t = F.replace(F.replace("text", F.lit(". "), F.lit("\f")), F.lit(", "), F.lit("\n\n"))
    return text.page_paragraphs(table(spark, sf_dir, "documents").select("doc_id", t.alias("text")), ["doc_id"])


_ROLES = list(text.FACTUAL_USE)
_SOURCE_SQL = f"""{_PARAGRAPHS_SQL},
fl AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) AS text FROM mk GROUP BY 1), rl AS (SELECT doc_id, text, sha256(text) AS sha, {_ROLES!r}[length(text) % 6 + 1] AS role FROM fl)"""


def _sources(spark, sf_dir):
    """Documents as sources, each with a role."""
    return _marked(spark, sf_dir).select("doc_id", "text", F.element_at(F.array(*map(F.lit, _ROLES)), (F.length("text") % 6 + 1)).alias("role"))


@query(f"""WITH {_SOURCE_SQL} SELECT bl.doc_id, ordinal, role, {' '.join(["CASE role", *(f"WHEN '{k}' THEN '{v}'" for k, v in text.FACTUAL_USE.items()), "END"])} AS factual_use, substr(sha256(sha || chr(0) || ordinal || chr(0) || kind || chr(0) || heading || chr(0) || block), 1, 20) AS block_id FROM bl JOIN rl USING (doc_id)""")
def block_ids(spark, sf_dir):
    """Identities of all blocks, and what their sources may be used for."""
    return text.source_blocks(_sources(spark, sf_dir), "doc_id").select("doc_id", "ordinal", "role", "factual_use", "block_id")


@query(f"""WITH {_SOURCE_SQL}, n AS (SELECT doc_id, count(*) AS block_count, sum(length(block))::BIGINT AS text_chars FROM bl GROUP BY 1), fs AS (SELECT sha, min(doc_id) AS f FROM rl GROUP BY 1)
SELECT rl.doc_id, role, rl.sha AS source_sha256, strlen(text)::BIGINT AS size, coalesce(block_count, 0) AS block_count, coalesce(text_chars, 0) AS text_chars, rl.doc_id <> f AS duplicate FROM rl JOIN fs USING (sha) LEFT JOIN n USING (doc_id)""")
def source_entries(spark, sf_dir):
    """One row a source with its size and blocks, and whether its bytes came before."""
    s = _sources(spark, sf_dir)
    return text.source_entries(s, text.source_blocks(s, "doc_id"), "doc_id")


@query(f"""WITH {_SOURCE_SQL} SELECT count(*) AS entries, sum(('0x' || substr(sha256(role || chr(0) || sha || chr(0) || doc_id), 1, 12))::BIGINT)::VARCHAR AS fingerprint FROM rl""")
def corpus_fingerprint(spark, sf_dir):
    """The fingerprint of all sources with their roles, in whatever order."""
    s = _sources(spark, sf_dir).select("role", F.sha2("text", 256).alias("sha"), F.col("doc_id").cast("string").alias("name"))
    return text.corpus_fingerprint(s, "role", "sha", "name")


@query("""WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS block FROM documents) SELECT source, count(*) AS blocks, sum(length(block))::BIGINT AS chars FROM l GROUP BY 1""")
def source_statistics(spark, sf_dir):
    """Blocks and characters by source."""
    l = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("block"))  # noqa: E741
    return text.source_statistics(l, ["source"])


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(replace(text, '!!', '!'), '***', ''), '[$%&#]{3}', '', 'g'), '\|', '', 'g')) AS digest FROM documents""")
def sanitise(spark, sf_dir):
    """Replacements in order, then patterns taken out."""
    t = text.sanitise(F.col("text"), {"!!": "!", "***": ""}, ["[$%&#]{3}", r"\|"])
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("digest"))


_DOC_LINT = [("shouting", "each", "[A-Z]{6,}"), ("marks", "any", "[$%&#]{3}"), ("license", "has", "License"), ("missing_heading", "lacks", "The")]


@query(r"""SELECT doc_id, code, detail FROM (SELECT doc_id, 'shouting' AS code, unnest(regexp_extract_all(text, '(^|[^0-9.])([A-Z]{6,})', 2)) AS detail FROM documents UNION ALL SELECT doc_id, 'marks', regexp_extract(text, '[$%&#]{3}') FROM documents WHERE regexp_matches(text, '[$%&#]{3}')
UNION ALL SELECT doc_id, 'license', 'License' FROM documents WHERE contains(text, 'License') UNION ALL SELECT doc_id, 'missing_heading', 'The' FROM documents WHERE NOT contains(text, 'The'))""")
def text_lint(spark, sf_dir):
    """Findings of lint rules in every document."""
    return text.lint(table(spark, sf_dir, "documents"), ["doc_id"], _DOC_LINT)


@query(r"""WITH s AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i, len(p) AS n FROM (SELECT doc_id, string_split(text, '. ') AS p FROM documents)),
k AS (SELECT doc_id, i, CASE WHEN i < n THEN x || '. ' ELSE x END AS x FROM s)
SELECT doc_id, sha256(coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT regexp_matches(x, 'thth|[0-9]')), '')) AS digest FROM k GROUP BY 1""")
def drop_sentences(spark, sf_dir):
    """X11: sentences that a pattern finds go."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.drop_sentences(F.col("text"), "thth|[0-9]", r"\. "), 256).alias("digest"))


@query(rf"""WITH {_LINES_SQL}, t AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) AS text FROM mk GROUP BY 1), p AS (SELECT doc_id, string_split(text, '![alt](y/z.png)') AS p FROM t),
e AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i, len(p) - 1 AS images FROM p)
SELECT doc_id, images::BIGINT AS images, sha256(string_agg(CASE WHEN i = 1 THEN x ELSE '{{{{chart:' || (i - 1) || '}}}}' || x END, '' ORDER BY i)) AS digest FROM e GROUP BY ALL""")
def chart_placeholders(spark, sf_dir):
    """Images become numbered placeholders."""
    m = _marked(spark, sf_dir)
    return m.select("doc_id", F.regexp_count("text", F.lit(r"!\[[^\]]*\]\([^)]*\)")).cast("long").alias("images"), F.sha2(text.chart_placeholders(F.col("text")), 256).alias("digest"))


@query("""SELECT conv_id, sum(length(text))::BIGINT AS chars, count(*) AS turns, sum(length(text)) BETWEEN 200 AND 1500 AS within FROM conversations GROUP BY 1""")
def length_check(spark, sf_dir):
    """Soft length bounds."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).cast("long").alias("chars"), F.count("*").alias("turns"))
    return g.withColumn("within", F.col("chars").between(200, 1500))


@query(f"""WITH {PANEL_SQL}, c AS (SELECT project_key, count(*) AS n, sum("MEAN_NPP")::BIGINT AS total FROM wide GROUP BY 1) SELECT project_key, n, total FROM c""")
def nested_snapshot(spark, sf_dir):
    """One document a project with its yearly records inside, counted from inside again."""
    w = panel.wide(spark, sf_dir)
    nested = sinks.nest(w.select("project_key", "project_type").distinct(), {"main": w.drop("project_type")})
    return nested.select("project_key", F.size("main").cast("long").alias("n"), F.aggregate("main", F.lit(0.0), lambda a, m: a + m["MEAN_NPP"]).cast("long").alias("total"))


@query("""WITH e AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status FROM orders) SELECT status, count(*) AS n FROM e GROUP BY 1""")
def progress(spark, sf_dir):
    """Runs by status."""
    s = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return sinks.progress(table(spark, sf_dir, "orders").select("o_orderkey", s.alias("status")))


@query("""SELECT o_orderkey, status FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'paused' WHEN 2 THEN 'running' ELSE 'succeeded' END AS status FROM orders) WHERE status IN ('failed', 'paused')""")
def run_failures(spark, sf_dir):
    """K6: runs that failed or were paused."""
    s = F.element_at(F.array(*map(F.lit, ("failed", "paused", "running", "succeeded"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return sinks.failures(table(spark, sf_dir, "orders").select("o_orderkey", s.alias("status")))


@query(f"""WITH {PANEL_SQL}, {FACTS_SQL}, {DIAGNOSE_SQL}, l AS (SELECT project_key, '项目类型不适用' AS x FROM g WHERE NOT applies UNION SELECT project_key, '数据条件未满足：' || need FROM g WHERE applies AND NOT met UNION SELECT e2.project_key, '指标数据不足：' || indicator FROM e2 JOIN g ON g.project_key = e2.project_key AND g.problem_id = e2.problem_id WHERE applies AND NOT usable)
SELECT p.project_key, coalesce(string_agg(x, '；' ORDER BY x), '') AS limitations FROM (SELECT DISTINCT project_key FROM diag) p LEFT JOIN l USING (project_key) GROUP BY 1""")
def project_limitations(spark, sf_dir):
    """What limits the diagnoses of every project."""
    return rules.project_limitations(_diagnoses(spark, sf_dir)).withColumn("limitations", F.array_join("limitations", "；"))


@query("""WITH s AS (SELECT o_custkey % 8 AS batch, o_custkey % 8 = 0 AND o_orderkey % 100 = 1 AS stop, CASE WHEN o_custkey % 8 IN (1, 2) THEN 'succeeded' WHEN o_custkey % 8 IN (3, 4) THEN CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'succeeded' END WHEN o_orderkey % 3 = 0 THEN 'running' WHEN o_orderkey % 3 = 1 THEN 'paused' ELSE 'succeeded' END AS status FROM orders),
n AS (SELECT batch, count(*) AS selected, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status IN ('failed', 'paused')) AS failed, bool_or(stop) AS stop FROM s GROUP BY 1)
SELECT batch, selected, succeeded, failed, selected - succeeded - failed AS pending, CASE WHEN stop THEN 'paused' WHEN succeeded = selected THEN 'complete' WHEN selected - succeeded - failed > 0 THEN 'paused' ELSE 'complete_with_failures' END AS status FROM n""")
def batch_statuses(spark, sf_dir):
    """Counts and status of eight batches of runs, whole, paused and with failures."""
    b, k = F.col("o_custkey") % 8, F.col("o_orderkey")
    s = F.when(b.isin(1, 2), "succeeded").when(b.isin(3, 4), F.when(k % 3 == 0, "failed").otherwise("succeeded")).when(k % 3 == 0, "running").when(k % 3 == 1, "paused").otherwise("succeeded")
    runs = table(spark, sf_dir, "orders").select(b.alias("batch"), ((b == 0) & (k % 100 == 1)).alias("stop"), s.alias("status"))
    return incremental.batch_status(runs, F.col("stop"), ["batch"])


@query("""WITH p AS (SELECT DISTINCT c_custkey AS fid, ['coal', 'solar', 'wind'][c_custkey % 3 + 1] AS project_type FROM customer), f AS (SELECT o_custkey AS fid FROM orders GROUP BY 1 HAVING count(*) > 3), k AS (SELECT printf('%s-%04d', 'coal', c_custkey) AS project_key FROM customer WHERE c_acctbal > 0)
SELECT printf('%s-%04d', project_type, fid) AS project_key, project_type, fid FROM p WHERE project_type = 'coal' AND fid IN (SELECT fid FROM f) AND printf('%s-%04d', project_type, fid) IN (SELECT project_key FROM k)""")
def run_selection(spark, sf_dir):
    """The runs that are asked for by type, by a table of numbers and by a table of keys."""
    c = table(spark, sf_dir, "customer")
    kind = F.element_at(F.array(*map(F.lit, ("coal", "solar", "wind"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    named = lambda k: F.format_string("%s-%04d", k, F.col("c_custkey"))
    projects = c.select(named(kind).alias("project_key"), kind.alias("project_type"), F.col("c_custkey").alias("fid"))
    numbers = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("fid")).count().where("count > 3")
    return incremental.selected_runs(projects, "coal", numbers, c.where("c_acctbal > 0").select(named(F.lit("coal")).alias("project_key")))


@query("""SELECT p_partkey, CASE WHEN (contains(p_name, 'red')::INT + contains(p_name, 'green')::INT + contains(p_name, 'blue')::INT) = 1 THEN CASE WHEN contains(p_name, 'red') THEN 'coal' WHEN contains(p_name, 'green') THEN 'solar' ELSE 'wind' END END AS kind, printf('%s-%04d', 'part', p_partkey) AS project_key FROM part""")
def label_types(spark, sf_dir):
    """The type that exactly one token of a label gives, and entity keys."""
    kind = tables.type_of_label(F.col("p_name"), {"red": "coal", "green": "solar", "blue": "wind"})
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), tables.project_key(F.lit("part"), F.col("p_partkey")).alias("project_key"))


@query("""WITH j AS (SELECT o_orderkey, o_orderkey % 4 <> 1 AS has_s, o_orderkey % 6 = 0 AS extra, o_orderstatus AS s FROM orders)
SELECT o_orderkey, 'wrong_type' AS code, 'items' AS field FROM j WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'missing' AS code, 'status' AS field FROM j WHERE NOT has_s UNION ALL SELECT o_orderkey, 'unexpected', 'other' FROM j WHERE extra UNION ALL SELECT o_orderkey, 'not_allowed', 'status' FROM j WHERE has_s AND s NOT IN ('F', 'O')""")
def contract_issues(spark, sf_dir):
    """JSON documents against a top-level contract."""
    k = F.col("o_orderkey")
    j = F.to_json(F.struct(F.lit("1").alias("version"), F.when(k % 4 != 1, F.col("o_orderstatus")).alias("status"), F.when(k % 6 == 0, F.lit(1)).alias("other"), F.when(k % 5 == 0, F.lit("x")).otherwise(F.lit("[1]")).alias("items")))
    return quality.contract_issues(table(spark, sf_dir, "orders").select("o_orderkey", j.alias("j")), "o_orderkey", "j", ["version", "status"], ["version", "status", "items"], {"status": ["F", "O"]}, ["items"])


@query(f"""WITH {PANEL_SQL}, {FACTS_SQL}, {DIAGNOSE_SQL} SELECT p.project_key, count(d.problem_id) AS problems, count(*) FILTER (d.status = '突出问题') AS prominent FROM projects p LEFT JOIN diag d ON d.project_key = p.project_key AND d.status NOT IN ('数据不足', '不适用') GROUP BY 1""")
def status_counts(spark, sf_dir):
    """Reportable and prominent problems of every project."""
    d = rules.reportable(_diagnoses(spark, sf_dir)).select("project_key", "problem_id", "status")
    j = panel.projects(spark, sf_dir).select("project_key").join(d, "project_key", "left")
    return j.groupBy("project_key").agg(F.count("problem_id").alias("problems"), F.count_if(F.col("status") == rules.PROMINENT).alias("prominent"))


@query(f"""WITH {PANEL_SQL}, n AS (SELECT project_key, "year", max(value) FILTER (indicator = 'NP') AS x, max(value) FILTER (indicator = 'MEAN_NPP') AS y FROM long WHERE indicator IN ('NP', 'MEAN_NPP') GROUP BY ALL), i AS (SELECT project_key, 100 * x / first_value(x) OVER w AS x, 100 * y / first_value(y) OVER w AS y FROM n WINDOW w AS (PARTITION BY project_key ORDER BY "year"))
SELECT project_key, 'MEAN_NPP' AS "first", 'NP' AS second FROM i GROUP BY project_key HAVING max(abs(x - y)) < 20""")
def coincident_series(spark, sf_dir):
    """Indexed series of a project that run within 20 points of each other in every year (exact ones are rare here)."""
    p = panel.long(spark, sf_dir).where("indicator in ('NP', 'MEAN_NPP')")
    x = trend.index_to_first(p, ["project_key", "indicator"]).withColumn("value", F.col("indexed"))
    return trend.coincident(x, ["project_key"], within=20)


@query("""SELECT p_partkey, round(p_retailprice * p_size * 0.45, 6) AS carbon, round(p_retailprice * p_size * 0.45 * 44.0 / 12.0, 6) AS co2e FROM part""")
def carbon_stock(spark, sf_dir):
    """Carbon stock and its CO2 equivalent."""
    c, e = trend.carbon_stock(F.col("p_retailprice"), F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(c, 6).alias("carbon"), F.round(e, 6).alias("co2e"))
