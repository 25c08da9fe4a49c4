"""More registered queries: measures, analysis, risk and scopes, quality, increments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import analysis, incremental, measures, quality, refresh, risk, rules, substrings, trend
from ..sources import tables
from . import panel
from .panel import FACTS_SQL, PANEL_SQL, table
from .queries import DIAGNOSE_SQL, _diagnoses, joined, query, r6

_sql_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

# --- measures -----------------------------------------------------------------------

# The same operators with other word lists, since the documents are invented prose.
_PROHIBITED = {"en": ["thatth", "license"], "de": ["ungen"], "fr": ["tion"], "es": ["mente"]}
_UNAVAILABLE = {"heavy": ["ndnd", "erer"]}
_MONITOR = ["shsh", "hehe"]
_SITES = {"pit": ["inin"], "pile": ["onon", "esth"]}


def _parts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return measures.segments(docs, ["doc_id", "lang"], "text", "[.\n]")


_PART_SQL = r"""
raw AS (SELECT doc_id, lang, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, lang, string_split_regex(coalesce(text, ''), '[.\n]') AS s FROM documents)),
tidy AS (SELECT doc_id, lang, pos::INT AS pos, trim(regexp_replace(t, '\s+', ' ', 'g'), ' ；;') AS text FROM raw), parts AS (SELECT * FROM tidy WHERE text <> '')"""


@query(f"WITH {_PART_SQL} SELECT doc_id, pos, text, 'workbook_measure_text' AS source FROM parts")
def measure_segment(spark, sf_dir):
    """M1: texts cut into trimmed segments."""
    return _parts(spark, sf_dir).select("doc_id", "pos", "text", "source")


def _first(xs: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN contains(text, '{x}') THEN '{x}' END" for x in xs) + ", NULL)"


_AUDIT_SQL = f"""{_PART_SQL},
nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lang, text ORDER BY pos) AS k FROM parts),
aud AS (SELECT doc_id, lang, pos, text, coalesce(CASE WHEN k > 1 THEN 'duplicate' END, 'project_type_conflict:' || CASE lang {' '.join(f"WHEN '{k}' THEN {_first(v)}" for k, v in _PROHIBITED.items())} END,
  {', '.join(f"CASE WHEN {_first(v)} IS NOT NULL THEN 'requires_unavailable_problem_rule:{k}' END" for k, v in _UNAVAILABLE.items())}, 'v1_monitoring_measure_excluded:' || {_first(_MONITOR)},
  CASE (CASE {' '.join(f"WHEN {_first(v)} IS NOT NULL THEN '{k}'" for k, v in _SITES.items())} END) {' '.join(f"WHEN '{k}' THEN CASE WHEN doc_id % 3 <> {n} THEN 'requires_site_feature:{k}' END" for n, k in enumerate(_SITES))} END, 'accepted') AS reason FROM nth)"""


def _audited(spark, sf_dir):
    # Every third document has a pit, every third a pile.
    k = F.col("doc_id") % 3
    parts = _parts(spark, sf_dir).withColumn("features", F.array_compact(F.array(*[F.when(k == n, F.lit(s)) for n, s in enumerate(_SITES)])))
    return measures.audit(parts, ["doc_id", "lang"], "lang", "features", _PROHIBITED, _UNAVAILABLE, _MONITOR, _SITES)


@query(f"WITH {_AUDIT_SQL} SELECT doc_id, pos, text, reason FROM aud")
def measure_audit(spark, sf_dir):
    """A reason for every segment, by precedence."""
    return _audited(spark, sf_dir).select("doc_id", "pos", "text", "reason")


@query(f"WITH {_AUDIT_SQL} SELECT doc_id, pos, text, reason FROM aud")
def measure_audit_index(spark, sf_dir):
    """The same reasons with the fragments as a table, found through an index of their pieces."""
    k = F.col("doc_id") % 3
    parts = _parts(spark, sf_dir).withColumn("features", F.array_compact(F.array(*[F.when(k == n, F.lit(s)) for n, s in enumerate(_SITES)])))
    found = measures.audit_by_table(parts, ["doc_id", "lang"], measures.fragment_table(spark, _PROHIBITED, _UNAVAILABLE, _MONITOR, _SITES), "lang", "features")
    return found.select("doc_id", "pos", "text", "reason")


@query(r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT item_id::VARCHAR || '/' || i AS pattern_id, array_to_string(w[i : i + 2], ' ') AS pattern FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
h AS (SELECT doc_id, pattern_id, pattern FROM documents JOIN (SELECT pattern, min(pattern_id) AS pattern_id, count(*) AS n FROM p GROUP BY 1) q ON contains(text, pattern)),
f AS (SELECT h.doc_id, count(*) AS phrases, min(h.pattern) AS first_phrase FROM h GROUP BY 1)
SELECT doc_id, phrases, first_phrase FROM f""")
def phrase_scan(spark, sf_dir):
    """How many different phrases of three benchmark words every document contains, and the first of them."""
    words = table(spark, sf_dir, "benchmark").select(F.array_remove(F.split("text", r"\s+"), "").alias("w")).where("size(w) >= 3")
    three = F.transform(F.arrays_zip(*[F.slice("w", F.lit(j + 1), F.size("w") - 2).alias(str(j)) for j in range(3)]), lambda z: F.concat_ws(" ", z["0"], z["1"], z["2"]))
    phrases = words.select(F.explode(three).alias("pattern")).distinct().withColumn("pattern_id", F.col("pattern"))
    hits = substrings.contains_join(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], phrases)
    return hits.groupBy("doc_id").agg(F.count("*").alias("phrases"), F.min("pattern_id").alias("first_phrase"))


@query(f"WITH {_AUDIT_SQL} SELECT lang, split_part(reason, ':', 1) AS reason, count(*) AS n, count(DISTINCT doc_id) AS documents FROM aud GROUP BY ALL")
def audit_counts(spark, sf_dir):
    """How often each reason occurs."""
    a = _audited(spark, sf_dir).withColumn("reason", F.split_part("reason", F.lit(":"), F.lit(1)))
    return a.groupBy("lang", "reason").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


_PART_KNOWLEDGE = [(f"K{k:02d}", ["coal", "solar", "wind"][: k % 3 + 1], [f"P{(k * 5 + j) % 13 + 1:03d}" for j in range(3)]) for k in range(25)]
_KNOW_SQL = "know AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', 'Brand#{k}', {_sql_list(t)}, {_sql_list(p)})" for k, (a, t, p) in enumerate(_PART_KNOWLEDGE)) + ") k(measure_id, name, types, targets))"
_OFFERS = "offer AS (SELECT DISTINCT project_key, project_type, 'Brand#' || CASE WHEN o_orderkey % 2 = 0 THEN 25 + o_orderkey % 9 ELSE (length(project_key) * 7 + o_orderkey % 4 * 5) % 30 END AS text FROM ords)"
_OFFER_SQL = _OFFERS + """,
rep AS (SELECT project_key, problem_id, status, row_number() OVER (PARTITION BY project_key ORDER BY (status <> '突出问题')::INT, problem_id) AS ord FROM diag WHERE status NOT IN ('数据不足', '不适用'))"""


def offer() -> Column:
    """The measure that an order of a project offers: every order names a brand; known brands are few in each project."""
    k = F.col("o_orderkey")
    brand = F.when(k % 2 == 0, 25 + k % 9).otherwise((F.length("project_key") * 7 + k % 4 * 5) % 30)
    return F.concat(F.lit("Brand#"), brand)


def _offers(spark, sf_dir):
    return panel.orders(spark, sf_dir).select("project_key", "project_type", offer().alias("text")).distinct()


def _knowledge(spark):
    rows = [(a, f"Brand#{k}", t, p, f"mechanism {k}") for k, (a, t, p) in enumerate(_PART_KNOWLEDGE)]
    return measures.knowledge_table(spark, rows)


@query(f"""WITH {PANEL_SQL}, {FACTS_SQL}, {DIAGNOSE_SQL}, {_KNOW_SQL}, {_OFFER_SQL}
SELECT project_key, measure_id, string_agg(problem_id, ',' ORDER BY ord) AS targets, min(ord)::INT AS first_target FROM (SELECT o.project_key, measure_id, unnest(targets) AS problem_id FROM offer o JOIN know ON text = name AND list_contains(types, project_type)) JOIN rep USING (project_key, problem_id) GROUP BY ALL""")
def knowledge_match(spark, sf_dir):
    """Offered measures that are known and target a reportable problem."""
    problems = rules.ordered(_diagnoses(spark, sf_dir))
    return measures.match_knowledge(_offers(spark, sf_dir), problems, _knowledge(spark)).select("project_key", "measure_id", joined("targets").alias("targets"), "first_target")


@query(f"""WITH {PANEL_SQL}, {_KNOW_SQL}, {_OFFERS}
SELECT project_key, text, 'not_in_measure_knowledge' AS reason FROM offer o WHERE NOT EXISTS (SELECT 1 FROM know WHERE name = text AND list_contains(types, project_type))""")
def anti_knowledge(spark, sf_dir):
    """Offered measures that nothing is known of."""
    return measures.unknown_measures(_offers(spark, sf_dir), _knowledge(spark)).select("project_key", "text", "reason")


def _wanted(spark, parts):
    """Every brand's problems in order, each with its keywords."""
    words = F.array(*map(F.lit, ("STEEL", "TIN", "COPPER", "green", "red", "BRASS")))
    problems = rules.rule_table(spark).select("problem_id", F.substring("problem_id", 2, 3).cast("int").alias("k"))
    return parts.select("brand").distinct().crossJoin(F.broadcast(problems)).select("brand", F.col("k").alias("ord"), F.col("problem_id").alias("problem"), F.slice(words, F.col("k") % 4 + 1, F.lit(3)).alias("keywords"))


def _brand_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat(F.lit("b"), F.substring_index("p_brand", "#", -1)).alias("brand"), F.col("p_partkey").alias("pos"), F.concat_ws(" ", "p_type", "p_name").alias("text"))


@query()
def greedy_select(spark, sf_dir):
    """Problems take up to three parts each by keyword, each part once; a sequential choice, so without SQL."""
    parts = _brand_parts(spark, sf_dir)
    return measures.greedy(_wanted(spark, parts), parts, key="brand")


@query()
def strategy_sections(spark, sf_dir):
    """M5: what the greedy choice took, grouped by problem in the problems' order; tests hold it against plain code."""
    parts = _brand_parts(spark, sf_dir)
    wanted = _wanted(spark, parts)
    s = measures.strategy_sections(measures.greedy(wanted, parts, key="brand"), wanted.withColumn("status", F.lit(rules.AT_RISK)), key="brand")
    return s.select("brand", "ord", "problem", joined(F.transform("measures", lambda m: F.concat_ws("=", m["match_type"], m["text"]))).alias("measures"))


# --- analysis -----------------------------------------------------------------------

_DIMS_SQL = "dims(indicator, dimension) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in rules.DIMENSIONS.items()) + ")"
_REP_SQL = "rp AS (SELECT d.project_key, d.problem_id, d.supported, d.opposed, r.pos, r.indicator, dimension FROM diag d JOIN rules r ON r.problem_id = d.problem_id JOIN dims ON dims.indicator = r.indicator WHERE status NOT IN ('数据不足', '不适用'))"


@query(f"WITH {PANEL_SQL}, {FACTS_SQL}, {DIAGNOSE_SQL}, {_DIMS_SQL}, {_REP_SQL} SELECT project_key, indicator, string_agg(DISTINCT problem_id, ',' ORDER BY problem_id) AS problems FROM rp GROUP BY ALL HAVING count(DISTINCT problem_id) > 1")
def shared_indicators(spark, sf_dir):
    """Indicators in which several problems rest."""
    return analysis.shared_indicators(rules.reportable(_diagnoses(spark, sf_dir))).select("project_key", "indicator", joined("problems").alias("problems"))


_PROFILE_SQL = f"""{_DIMS_SQL}, {_REP_SQL},
pm AS (SELECT DISTINCT project_key, problem_id, supported, opposed, dimension FROM rp),
prof AS (SELECT project_key, dimension, sum(supported)::BIGINT AS supporting, sum(opposed)::BIGINT AS conflicting, sum(greatest(1, supported + opposed))::BIGINT AS weight, count(*) AS problems, min(problem_id) AS seen FROM pm GROUP BY ALL)"""


@query(f"WITH {PANEL_SQL}, {FACTS_SQL}, {DIAGNOSE_SQL}, {_PROFILE_SQL} SELECT project_key, dimension, supporting, conflicting, weight, problems FROM prof")
def dimension_profile(spark, sf_dir):
    """Evidence counts by dimension."""
    return analysis.dimension_profile(rules.reportable(_diagnoses(spark, sf_dir))).drop("seen")


_LABEL_SQL = "CASE dimension " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.DIMENSION_LABELS.items()) + " END"


@query(f"WITH {PANEL_SQL}, {FACTS_SQL}, {DIAGNOSE_SQL}, {_PROFILE_SQL} SELECT project_key, dimension, {_LABEL_SQL} AS label, weight FROM (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY weight DESC, seen, dimension) AS r FROM prof) WHERE r = 1")
def cross_problem(spark, sf_dir):
    """The dimension that weighs most in each project; ties to the one seen first, then by name."""
    return analysis.dominant_dimension(analysis.dimension_profile(rules.reportable(_diagnoses(spark, sf_dir))))


_case = lambda c, codes: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.items()) + " END"
_MATCH_SQL = """mt AS (SELECT o.project_key, k.measure_id, rep.problem_id, rep.ord FROM offer o JOIN know k ON o.text = k.name AND list_contains(k.types, o.project_type), rep WHERE rep.project_key = o.project_key AND list_contains(k.targets, rep.problem_id)),
m1 AS (SELECT *, min(ord) OVER (PARTITION BY project_key, measure_id) AS first FROM mt),
mm AS (SELECT project_key, problem_id, string_agg(measure_id, ',' ORDER BY first, measure_id) AS matched FROM m1 GROUP BY ALL)"""
_CONTEXT_SQL = f"""{_DIMS_SQL},
ce AS (SELECT e.project_key, e.problem_id, e.pos, e.indicator, e.sup, e.recent, f.long_term, f.turning FROM e2 e JOIN diag g ON g.project_key = e.project_key AND g.problem_id = e.problem_id AND g.ok JOIN facts f ON f.project_key = e.project_key AND f.indicator = e.indicator),
cs AS (SELECT project_key, problem_id, count(*) AS n, count(*) FILTER (sup) AS a, count(*) FILTER (sup = false) AS b, count(DISTINCT recent) AS near,
  coalesce(string_agg('EV-' || problem_id || '-' || indicator, ',' ORDER BY pos) FILTER (sup), '') AS sid, coalesce(string_agg('EV-' || problem_id || '-' || indicator, ',' ORDER BY pos) FILTER (sup = false), '') AS cid,
  coalesce(string_agg('EV-' || problem_id || '-' || indicator, ',' ORDER BY pos) FILTER (long_term = 'stable' OR recent = 'stable'), '') AS tid,
  string_agg(DISTINCT long_term, ',' ORDER BY long_term) AS lp, string_agg(DISTINCT recent, ',' ORDER BY recent) AS rp, array_to_string(list_sort(list_distinct(flatten(list(turning)))), ',') AS tp FROM ce GROUP BY ALL),
cf AS (SELECT project_key, problem_id, {_case("long_term", analysis.LONG_FEATURES)} AS f FROM ce UNION ALL SELECT project_key, problem_id, {_case("recent", analysis.RECENT_FEATURES)} FROM ce
  UNION ALL SELECT project_key, problem_id, {_case("confidence", analysis.CONFIDENCE_FEATURES)} FROM diag UNION ALL SELECT project_key, problem_id, CASE status WHEN '数据不足' THEN 'data_limitation' WHEN '不适用' THEN 'scope_limitation' END FROM diag
  UNION ALL SELECT project_key, problem_id, CASE consistency WHEN 'consistent' THEN 'indicator_consistency' WHEN 'partially_consistent' THEN 'partial_consistency' WHEN 'conflicting' THEN 'indicator_conflict' ELSE 'data_limitation' END FROM diag
  UNION ALL SELECT project_key, problem_id, 'recent_reversal' FROM diag WHERE trend IN ('recently_improving', 'recently_worsening')),
cff AS (SELECT project_key, problem_id, string_agg(DISTINCT f, ',' ORDER BY f) AS features FROM cf WHERE f IS NOT NULL GROUP BY ALL),
cd AS (SELECT problem_id, string_agg(DISTINCT dimension, ',' ORDER BY dimension) AS dimensions FROM rules JOIN dims USING (indicator) GROUP BY 1),
str AS (SELECT problem_id, string_agg(label, '、' ORDER BY dimension) AS labels FROM (SELECT DISTINCT problem_id, dimension, {_LABEL_SQL} AS label FROM rules JOIN dims USING (indicator)) GROUP BY 1),
cx AS (SELECT d.project_key, d.problem_id, d.status, d.trend, d.evidence_level, d.consistency, coalesce(n, 0) AS n, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(near, 0) AS near, coalesce(sid, '') AS sid, coalesce(cid, '') AS cid, coalesce(tid, '') AS tid, coalesce(lp, '') AS lp, coalesce(rp, '') AS rp, coalesce(tp, '') AS tp, features, dimensions, labels
  FROM diag d LEFT JOIN cs USING (project_key, problem_id) JOIN cff USING (project_key, problem_id) JOIN cd USING (problem_id) JOIN str USING (problem_id))"""
_STRENGTH = "CASE WHEN {0} = 0 THEN 'none' WHEN {0} / n >= 0.75 THEN 'strong' WHEN {0} / n >= 0.5 THEN 'moderate' ELSE 'weak' END"


@query(f"""WITH {PANEL_SQL}, {FACTS_SQL}, {DIAGNOSE_SQL}, {_KNOW_SQL}, {_OFFER_SQL}, {_MATCH_SQL}, {_CONTEXT_SQL}
SELECT project_key, problem_id, features, CASE consistency WHEN 'partially_consistent' THEN 'mostly_consistent' ELSE consistency END AS relationship, sid AS supporting_ids, cid AS conflicting_ids, tid AS stable_ids, lp AS long_term_patterns, rp AS recent_patterns, tp AS turning_points,
  CASE WHEN n = 0 THEN 'unknown' WHEN trend IN ('recently_improving', 'recently_worsening') THEN 'divergent' WHEN near > 1 THEN 'partially_divergent' ELSE 'consistent' END AS long_recent_relation, {_STRENGTH.format("a")} AS support_strength, {_STRENGTH.format("b")} AS counter_strength, n > 0 AS direct_evidence, evidence_level = 'B' AS risk_label_support,
  CASE WHEN a > 0 AND b > 0 THEN 'mixed' WHEN a = n AND n > 0 THEN 'strongly_supports_diagnosis' WHEN a > 0 THEN 'supports_diagnosis' WHEN status = '数据不足' THEN 'insufficient' ELSE 'does_not_support_diagnosis' END AS overall_balance, dimensions, '当前判断主要反映' || labels || '的变化信号。' AS primary_finding,
  CASE WHEN status IN ('数据不足', '不适用') THEN '' ELSE '{analysis.CANNOT_TELL}' END AS interpretation_limitations, CASE WHEN status IN ('数据不足', '不适用') THEN '关键条件不足，当前结论不可评估。' ELSE '结论基于' || n || '项规则指定指标证据。' END AS confidence_reason,
  coalesce(matched, '') AS matched, CASE WHEN matched IS NULL THEN 'no_compliant_match' ELSE 'matched' END AS match_status FROM cx LEFT JOIN mm USING (project_key, problem_id)""")
def analysis_context(spark, sf_dir):
    """Features, signals, balance, patterns, dimensions and matched measures of every project and rule."""
    d = _diagnoses(spark, sf_dir)
    c = analysis.contexts(d, measures.match_knowledge(_offers(spark, sf_dir), rules.ordered(d), _knowledge(spark)))
    lists = ("features", "supporting_ids", "conflicting_ids", "stable_ids", "long_term_patterns", "recent_patterns", "turning_points", "dimensions", "interpretation_limitations")
    plain = ("relationship", "long_recent_relation", "support_strength", "counter_strength", "direct_evidence", "risk_label_support", "overall_balance", "primary_finding", "confidence_reason", "match_status")
    return c.select("project_key", "problem_id", *plain, *[joined(x).alias(x) for x in lists], joined(F.transform("matched", lambda m: m["measure_id"])).alias("matched"))


# --- risk and scopes: the order priority stands for the scope -------------------------

_SCOPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_SCOPE_SQL = f"""{PANEL_SQL}, rec AS (SELECT project_key, project_type, "year", o_orderpriority AS scope, CASE WHEN count(*) >= 2 THEN sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 1e6 END AS value, min(o_orderkey) AS source_row FROM ords GROUP BY ALL)"""


def _records(spark, sf_dir):
    n = F.count("*")
    value = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 1e6
    return panel.orders(spark, sf_dir).groupBy("project_key", "project_type", "year", F.col("o_orderpriority").alias("scope")).agg(F.when(n >= 2, value).alias("value"), F.min("o_orderkey").alias("source_row"))


@query(f"""WITH {_SCOPE_SQL}, c AS (SELECT project_key, scope, count(value) AS n, list_position({_sql_list(_SCOPES[1:4])}, scope) AS k FROM rec GROUP BY ALL)
SELECT project_key, scope, n FROM (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY k) AS r FROM c WHERE n >= 3 AND k IS NOT NULL) WHERE r = 1""")
def scope_pick(spark, sf_dir):
    """The first preferred scope with three values."""
    return risk.pick_scope(_records(spark, sf_dir), ["project_key"], _SCOPES[1:4])


@query(f"WITH {_SCOPE_SQL} SELECT project_key, \"year\", round(avg(value), 9) AS mean, count(value) AS scopes FROM rec GROUP BY ALL HAVING count(value) > 0")
def annual_mean(spark, sf_dir):
    """Yearly means over the scopes."""
    return risk.annual_means(_records(spark, sf_dir), "project_key").select("project_key", "year", F.round("mean", 9).alias("mean"), "scopes")


@query("""WITH f AS (SELECT c_custkey, c_nationkey, (c_custkey % 7 - 1) / 5.0 AS p FROM customer)
SELECT c_custkey, CASE WHEN p BETWEEN 0 AND 1 THEN p::DOUBLE END AS p_value, NOT (p BETWEEN 0 AND 1) AS p_invalid, CASE WHEN NOT (p BETWEEN 0 AND 1) THEN 'missing' ELSE 'available' END AS status FROM f""")
def p_validity(spark, sf_dir):
    """P values outside 0 to 1 count as missing, and are told."""
    value, invalid = risk.checked_p((F.col("c_custkey") % 7 - 1) / 5.0)
    return table(spark, sf_dir, "customer").select("c_custkey", value.alias("p_value"), invalid.alias("p_invalid"), risk.significance(value).alias("status"))


@query(f"""WITH {PANEL_SQL}, rec AS (SELECT project_key, "year", 'cls_' || (o_orderkey % 11 + 1) AS category, count(*) AS n FROM ords GROUP BY ALL)
SELECT project_key, "year", coalesce(map_extract(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in risk.LANDSCAPE_CLASSES.items())}}}, category)[1], '其他') AS class, sum(n)::BIGINT AS n FROM rec GROUP BY ALL""")
def class_series(spark, sf_dir):
    """Series by decoded class, unknown codes as other."""
    o = panel.orders(spark, sf_dir).select("project_key", "year", F.concat(F.lit("cls_"), F.col("o_orderkey") % 11 + 1).alias("category"))
    return o.groupBy("project_key", "year", risk.decode(F.col("category"), risk.LANDSCAPE_CLASSES, "其他").alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1""")
def first_record(spark, sf_dir):
    """The first record of a key wins."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return risk.first_records(o, ["o_custkey", "o_orderpriority"], "o_orderkey").select(*o.columns)


# --- quality --------------------------------------------------------------------------


@query("""WITH k AS (SELECT DISTINCT c_custkey AS key FROM customer), r AS (SELECT DISTINCT CASE WHEN o_custkey % 5 = 0 THEN -1 - o_custkey ELSE o_custkey END AS key FROM orders)
SELECT coalesce(k.key, r.key) AS key, CASE WHEN r.key IS NULL THEN 'missing' ELSE 'extra' END AS side FROM k FULL JOIN r ON k.key = r.key WHERE k.key IS NULL OR r.key IS NULL""")
def key_diff(spark, sf_dir):
    """Keys that only one side has; a fifth of the orders' keys are turned into ones that no customer has."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 5 == 0, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("key"))
    return quality.key_differences(c, o, "key")


@query("""WITH k AS (SELECT DISTINCT c_custkey AS key FROM customer), r AS (SELECT DISTINCT o_custkey + 5 AS key FROM orders), d AS (SELECT coalesce(k.key, r.key) AS key, CASE WHEN r.key IS NULL THEN 'missing' ELSE 'extra' END AS side FROM k FULL JOIN r ON k.key = r.key WHERE k.key IS NULL OR r.key IS NULL)
SELECT side, string_agg(key::VARCHAR, ',' ORDER BY key) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY key) AS n FROM d) WHERE n <= 5 GROUP BY 1""")
def key_preview(spark, sf_dir):
    """The first five keys that only one side has, as a message shows them."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 5).alias("key"))
    return quality.preview(quality.key_differences(c, o, "key"), "key").withColumn("keys", joined("keys"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def fk_check(spark, sf_dir):
    """Lines whose order isn't among the finished ones."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    # Orders that aren't finished stand under other keys.
    done = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).otherwise(-1 - F.col("o_orderkey")).alias("o_orderkey"))
    return quality.orphans(lines, done, "l_orderkey", "o_orderkey")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def quality_dupes(spark, sf_dir):
    """Keys that occur more than once."""
    return quality.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("""WITH x AS (SELECT c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_nationkey % 5 = 0 AND c_custkey % 7 = 0 THEN 'other' ELSE ' r' || (c_nationkey % 4) END AS region FROM customer)
SELECT c_nationkey, min(nullif(trim(region), '')) AS region, coalesce(min(nullif(trim(region), '')) <> max(nullif(trim(region), '')), false) AS conflict FROM x GROUP BY 1""")
def region_consistency(spark, sf_dir):
    """The non-empty value wins, differing ones are a conflict."""
    v = F.when(F.col("c_custkey") % 3 == 0, "").when((F.col("c_nationkey") % 5 == 0) & (F.col("c_custkey") % 7 == 0), "other").otherwise(F.concat(F.lit(" r"), F.col("c_nationkey") % 4))
    return quality.coalesce_agreed(table(spark, sf_dir, "customer").select("c_nationkey", v.alias("region")), ["c_nationkey"], "region")


@query(f"""WITH {PANEL_SQL}, l AS (SELECT project_key, arg_max("LPI", "year") FILTER ("LPI" IS NOT NULL OR true) AS x, max("year") AS y FROM wide GROUP BY 1), w AS (SELECT wide.* FROM wide JOIN l ON l.project_key = wide.project_key AND l.y = wide."year")
SELECT project_key, 'missing_latest_metric:LPI' AS warning FROM w WHERE "LPI" IS NULL UNION ALL SELECT project_key, 'missing_latest_metric:CA' FROM w WHERE "CA" = 0 UNION ALL SELECT project_key, 'non_finite_latest_metric:ERI' FROM w WHERE "ERI" > 0.5""")
def warnings(spark, sf_dir):
    """Metrics of each project's latest year that are missing or not finite (set so by rule)."""
    latest = quality.latest_rows(panel.wide(spark, sf_dir), ["project_key"])
    x = latest.withColumns({"CA": F.when(F.col("CA") != 0, F.col("CA")), "ERI": F.when(F.col("ERI") > 0.5, float("nan")).otherwise(F.col("ERI"))})
    return quality.warnings(x, ["project_key"], ["LPI", "CA", "ERI"])


@query("""SELECT event_id, try_cast(trunc(try_cast(v AS DOUBLE)) AS INT) AS whole, try_cast(trim(v) AS DOUBLE) AS number FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id || '.7' WHEN 1 THEN 'x' || event_id WHEN 2 THEN '' WHEN 3 THEN ' -' || event_id || '.9 ' ELSE event_id || '' END AS v FROM events)""")
def strict_and_lenient(spark, sf_dir):
    """Whole and lenient numbers from text."""
    e, i = table(spark, sf_dir, "events").select("event_id"), F.col("event_id").cast("string")
    v = F.when(F.col("event_id") % 5 == 0, F.concat(i, F.lit(".7"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit("x"), i)).when(F.col("event_id") % 5 == 2, "").when(F.col("event_id") % 5 == 3, F.concat(F.lit(" -"), i, F.lit(".9 "))).otherwise(i)
    return e.select("event_id", quality.strict_int(v).alias("whole"), quality.lenient_number(v).alias("number"))


# --- increments -----------------------------------------------------------------------

_STATE_SQL = """v AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer),
neu AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name || '!' ELSE c_name END AS c_name, CASE WHEN c_custkey % 6 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM v)"""


def _versions(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    new = old.withColumns({"c_name": F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")), "c_mktsegment": F.when(F.col("c_custkey") % 6 == 0, "NEW").otherwise(F.col("c_mktsegment"))})
    hashed = lambda d: incremental.with_fingerprints(d, d.columns, ["c_name"], "v1")
    return hashed(old), hashed(new)


@query(f"WITH {_STATE_SQL} SELECT v.c_custkey, v.c_name <> neu.c_name OR v.c_mktsegment <> neu.c_mktsegment AS changed, v.c_mktsegment <> neu.c_mktsegment AS analysis_changed FROM v JOIN neu USING (c_custkey)")
def fingerprint_diff(spark, sf_dir):
    """A rename changes the full hash only."""
    old, new = _versions(spark, sf_dir)
    o = old.select("c_custkey", F.col("full_hash").alias("f"), F.col("analysis_hash").alias("a"))
    return new.join(o, "c_custkey").select("c_custkey", (F.col("full_hash") != F.col("f")).alias("changed"), (F.col("analysis_hash") != F.col("a")).alias("analysis_changed"))


@query(f"""WITH {_STATE_SQL} SELECT v.c_custkey, CASE WHEN v.c_custkey % 5 = 4 THEN 'run_new' WHEN v.c_custkey % 5 IN (0, 1) THEN CASE WHEN v.c_name <> neu.c_name OR v.c_mktsegment <> neu.c_mktsegment THEN 'run_changed' ELSE 'skip' END WHEN v.c_custkey % 5 = 2 THEN 'run_retry' ELSE 'run_resume' END AS action FROM v JOIN neu USING (c_custkey)""")
def enqueue(spark, sf_dir):
    """What to run again, against the state of the run before."""
    old, new = _versions(spark, sf_dir)
    k = F.col("c_custkey") % 5
    state = old.where(k != 4).select("c_custkey", "full_hash", F.when(k <= 1, "succeeded").when(k == 2, "failed").otherwise("running").alias("status"))
    return incremental.enqueue(new, state, "c_custkey", retry_failed=True)


@query("""WITH s AS (SELECT c_custkey, c_name || '*' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000000, c_name, c_acctbal FROM customer WHERE c_custkey % 10 = 0)
SELECT * FROM s UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM s)""")
def latest_upsert(spark, sf_dir):
    """Keyed upsert, the source wins."""
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = t.where("c_custkey % 3 = 0").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    new = t.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 1000000000).alias("c_custkey"), "c_name", "c_acctbal")
    return incremental.upsert(t, changed.unionByName(new), ["c_custkey"])


_REFRESH_SQL = f"""{PANEL_SQL}, {FACTS_SQL}, k AS (SELECT project_key, any_value(c_nationkey) AS nation, any_value(c_mktsegment) AS seg FROM cust GROUP BY 1),
ys AS (SELECT project_key, max("year") = (SELECT max("year") FROM wide) AS late, max("year") AS y, count(*) AS n FROM wide GROUP BY 1),
act AS (SELECT project_key, CASE WHEN seg = 'BUILDING' AND nation % 7 = 2 OR nation % 3 = 1 AND late AND n = 1 THEN 'run_new' WHEN nation % 5 = 4 THEN 'run_retry' WHEN nation % 6 = 1 THEN 'run_resume' WHEN nation % 3 = 1 AND late THEN 'run_changed' WHEN nation % 4 = 0 THEN 'rename' END AS action, nation FROM k JOIN ys USING (project_key))"""


def _projects_of(spark, sf_dir):
    c = panel.customers(spark, sf_dir)
    return c.groupBy("project_key").agg(F.first("c_nationkey").alias("nation"), F.first("c_mktsegment").alias("seg"))


def _facts_of(rows):
    return trend.indicator_facts(trend.unpivot_panel(rows, ["project_key", "year"], panel.INDICATORS), ["project_key", "indicator"]).select("project_key", "indicator", "valid_years", "long_term", "recent", "current_year", "current_value")


def refreshed(spark, sf_dir, parts: int = 16):
    """(refresh, todo) after a first run over yesterday's panel, ready to be run over today's, which the tables give.

    Yesterday some projects lacked the last year, some weren't there, some have failed or weren't finished, some had another
    name, and of each region one more project was there that has gone since.
    """
    k = _projects_of(spark, sf_dir)
    today = panel.wide(spark, sf_dir).drop("project_type")
    columns = ["year", *panel.INDICATORS]
    last = today.agg(F.max("year").alias("year")).withColumn("late", F.lit(True))
    marked = today.join(k, "project_key").join(last, "year", "left")
    before = marked.where(~((F.col("seg") == "BUILDING") & (F.col("nation") % 7 == 2)) & ~((F.col("nation") % 3 == 1) & F.col("late").isNotNull()))
    gone = before.where("nation % 4 = 3").withColumn("project_key", F.concat(F.lit("gone-"), "project_key"))
    yesterday = before.unionByName(gone).select("project_key", *columns)

    def candidates(rows, name):
        hashed = refresh.content_hash(rows, "project_key", columns).join(k, "project_key", "left").withColumn("name", name)
        return incremental.with_fingerprints(hashed, ["name", "content"], ["name"], "v1").select("project_key", "nation", "name", "full_hash", "analysis_hash")

    at = refresh.Refresh(*(tables.scratch(spark, n) for n in ("panel", "facts", "state")), key="project_key", parts=parts)
    refresh.write_parts(yesterday, at.inputs, "project_key", parts)
    first = candidates(yesterday, F.col("project_key"))
    at.first(first, _facts_of)
    # Some of the first run failed or weren't finished: their state says so, and they have no results.
    state = at.load(spark, at.state).join(k, "project_key", "left")
    status = F.when(F.col("nation") % 5 == 4, "failed").when(F.col("nation") % 6 == 1, "running").otherwise(F.col("status"))
    path = tables.scratch(spark, "state")
    refresh.write_parts(state.select("project_key", "full_hash", "analysis_hash", status.alias("status")), path, "project_key", parts)
    at.state = path
    refresh.write_parts(today.select("project_key", *columns), at.inputs, "project_key", parts)
    new = candidates(today, F.when(F.col("nation") % 4 == 0, F.concat("project_key", F.lit("*"))).otherwise(F.col("project_key")))
    todo = tables.scratch(spark, "todo")
    at.plan(new, retry_failed=True).write.parquet(todo)
    return at, spark.read.parquet(todo)


@query(f"""WITH {_REFRESH_SQL}
SELECT f.project_key, CASE WHEN nation % 4 = 0 AND action IS NOT NULL THEN f.project_key || '*' ELSE f.project_key END AS name, indicator, n AS valid_years, long_term, recent, cy AS current_year, round(cv, 6) AS current_value, action
FROM facts f JOIN act USING (project_key)""")
def incremental_refresh(spark, sf_dir):
    """A day's changes brought into the results of the day before, part by part; what is there then is what a full
    run gives.  The query writes the tables of both days and runs the refresh when it is built."""
    at, todo = refreshed(spark, sf_dir)
    at.run(todo, _facts_of)
    done = at.load(spark, at.results).join(todo.select("project_key", "action"), "project_key", "left")
    return done.select("project_key", "name", "indicator", "valid_years", "long_term", "recent", "current_year", r6("current_value"), "action")


@query()
def uuid5_key(spark, sf_dir):
    """Name-based UUIDs of customers; tests hold them against the standard library's."""
    return table(spark, sf_dir, "customer").select("c_custkey", incremental.uuid5(F.concat(F.lit("customer-"), F.format_string("%04d", "c_custkey"))).alias("id"))


@query("SELECT user_id, event_id, o FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events) WHERE o <= 3")
def numbering(spark, sf_dir):
    """Numbers within a group, and the first three of each."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("o", F.row_number().over(w).cast("long")).where("o <= 3").select("user_id", "event_id", "o")


@query("""SELECT time_bucket(INTERVAL 60 SECOND, ts) AS "start", event_type, count(*) AS n FROM events GROUP BY ALL""")
def event_counts(spark, sf_dir):
    """Z2 as a batch: events by minute and type."""
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "60 seconds").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n")
