"""Registered queries of scans, sinks, contracts, increments and streams; raw tables are derived from the star schema by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental, quality, rules, trend
from ..sources import sinks, tables
from ..streaming import feeds, keyed
from . import panel
from .panel import FACTS_SQL, PANEL_SQL, table
from .queries import DIAGNOSE_SQL, KEYS, joined, query
from .risk_queries import RISK_SQL, records

_KEY = "project_key"
_RAW_SQL = f"""{PANEL_SQL}, {RISK_SQL}, raw AS (SELECT r.*, p.project_type, (r.source_row % 9000)::INT AS fid FROM rec r JOIN projects p USING (project_key))"""
_K = "project_type || '-' || lpad(fid::VARCHAR, 4, '0')"


def _raw(spark, sf_dir):
    r = records(spark, sf_dir).join(panel.projects(spark, sf_dir).select(_KEY, "project_type"), _KEY)
    return r.withColumn("fid", (F.col("source_row") % 9000).cast("int"))


def _text(c):
    return F.col(c).cast("string")


@query(f"""WITH {_RAW_SQL} SELECT {_K} AS project_key, "year", scope, "LER" AS mean_ndvi, CASE WHEN k % 5 > 0 THEN "CVR" END AS mean_npp, source_row FROM raw WHERE k % 7 > 0""")
def scan_main(spark, sf_dir):
    """The main metrics of three type tables, typed, keyed and renamed; unusable rows told apart."""
    x = _raw(spark, sf_dir)
    none = [F.lit(None).cast("string").alias(f) for f in tables.MAIN_FIELDS[2:]]
    raw = x.select("project_type", F.concat(_text("fid"), F.lit(".0")).alias("序号"), F.when(F.col("k") % 7 == 0, "?").otherwise(_text("year")).alias("年份"), F.concat(F.lit(" "), "scope", F.lit(" ")).alias("研究范围"), _text("LER").alias("NDVI"), F.when(F.col("k") % 5 == 0, "n/a").otherwise(_text("CVR")).alias("NPP"), *none, "source_row")
    got = tables.rename_metrics(tables.main_records({t: raw.where(F.col("project_type") == t).drop("project_type") for t in ("coal", "solar", "wind")}))
    return got.where("issue is null").select(_KEY, "year", "scope", F.col("MEAN_NDVI").alias("mean_ndvi"), F.col("MEAN_NPP").alias("mean_npp"), "source_row")


@query(f"""WITH {_RAW_SQL} SELECT {_K} AS project_key, "year", scope, 'cls_' || k % 10 AS category, "ES" AS ca, CASE WHEN k % 4 > 0 THEN "EP" END AS lpi, source_row FROM raw""")
def scan_landscape(spark, sf_dir):
    """Landscape metrics of three type tables by scope and class."""
    x = _raw(spark, sf_dir)
    none = [F.lit("").alias(f) for f in tables.LANDSCAPE_FIELDS[2:]]
    raw = x.select("project_type", _text("fid").alias("FID"), _text("year").alias("年份"), F.col("scope").alias("距离"), F.concat(F.lit("cls_"), F.col("k") % 10).alias("类别"), _text("ES").alias("CA"), F.when(F.col("k") % 4 > 0, _text("EP")).alias("LPI"), *none, "source_row")
    got = tables.landscape_records({t: raw.where(F.col("project_type") == t).drop("project_type") for t in ("coal", "solar", "wind")})
    return got.select(_KEY, "year", "scope", "category", F.col("CA").alias("ca"), F.col("LPI").alias("lpi"), "source_row")


_LABEL = "CASE project_type WHEN 'coal' THEN '煤矿' WHEN 'solar' THEN '光伏' ELSE '风电' END"


def _typed(x):
    return F.when(F.col("project_type") == "coal", "煤矿").when(F.col("project_type") == "solar", "光伏").otherwise("风电")


@query(f"""WITH {_RAW_SQL} SELECT CASE WHEN k % 6 = 0 THEN NULL ELSE {_K} END AS project_key, scope, CASE WHEN k % 6 = 0 THEN 'unknown_project_type' END AS issue, CASE WHEN k % 3 > 0 THEN "LER" END AS area, source_row FROM raw""")
def scan_protected(spark, sf_dir):
    """Protected areas with type labels decoded; unknown labels are issues."""
    x = _raw(spark, sf_dir)
    raw = x.select(F.when(F.col("k") % 6 == 0, "水电").otherwise(_typed(x)).alias("类型"), _text("fid").alias("FID"), F.col("scope").alias("距离"), F.lit("KBA").alias("保护区类型"), F.when(F.col("k") % 3 == 0, "").otherwise(_text("LER")).alias("侵占面积(km²)"), "source_row")
    got = tables.protected_records(raw)
    return got.select(F.when(F.col("issue").isNull(), F.col(_KEY)).alias(_KEY), "scope", "issue", F.col("intersection_area_km2").alias("area"), "source_row")


@query(f"""WITH {_RAW_SQL} SELECT {_K} AS project_key, "year", scope, "CERI_raw" AS ceri_raw, "CERI" AS ceri, risk_level, risk_level_code::DOUBLE AS risk_level_code, source_row FROM raw""")
def scan_risk(spark, sf_dir):
    """Risk metrics, level and code."""
    x = _raw(spark, sf_dir)
    raw = x.select(_typed(x).alias("类型"), _text("fid").alias("FID"), _text("year").alias("年份"), F.col("scope").alias("距离"), "RISK_LEVEL", _text("risk_level_code").alias("RISK_LEVEL_CODE"), F.lit("").alias("盟市"), F.lit("").alias("旗县"), *[_text(f).alias(f) for f in tables.RISK_FIELDS], "source_row")
    got = tables.risk_records(raw)
    return got.select(_KEY, "year", "scope", F.col("CERI_raw").alias("ceri_raw"), F.col("CERI").alias("ceri"), "risk_level", "risk_level_code", "source_row")


@query(f"""WITH {_RAW_SQL} SELECT CASE WHEN k % 5 = 0 THEN NULL ELSE {_K} END AS project_key, CASE WHEN k % 5 = 0 THEN 'unknown_project_type' END AS issue, "CERI_raw" AS start_ceri, (k % 7 - 1) / 4.0::DOUBLE AS p_value_raw, source_row FROM raw""")
def scan_risk_trend(spark, sf_dir):
    """Risk trends, their type resolved from a free label."""
    x = _raw(spark, sf_dir)
    label = F.when(F.col("k") % 5 == 0, F.concat(F.lit("光伏风电项目 FID "), "fid")).otherwise(F.concat(_typed(x), F.lit("项目 FID "), "fid"))
    raw = x.select(label.alias("项目"), _text("fid").alias("FID"), F.lit("上升").alias("趋势类型"), _text("CERI_raw").alias("首年CERI"), F.lit("").alias("末年CERI"), F.lit("").alias("变化率(%)"), F.lit("").alias("Sen_slope"), ((F.col("k") % 7 - 1) / 4.0).cast("string").alias("P_value"), "source_row")
    got = tables.risk_trend_records(raw)
    return got.select(F.when(F.col("issue").isNull(), F.col(_KEY)).alias(_KEY), "issue", "start_ceri", "p_value_raw", "source_row")


@query(f"""WITH {_RAW_SQL} SELECT {_K} AS project_key, nullif(risk_level, '') AS risk_level, CASE WHEN k % 3 > 0 THEN risk_level_code END AS risk_level_code, source_row FROM raw WHERE "year" = 2000""")
def scan_matching(spark, sf_dir):
    """The target year's matching results of three tables, with lenient codes and texts."""
    x = _raw(spark, sf_dir)
    raw = x.select(F.col("project_type").alias("t"), F.concat(F.lit(" "), F.upper("project_type")).alias("PROJECT_TYPE"), _text("fid").alias("FID"), F.concat(_text("year"), F.lit(".0")).alias("YEAR"), F.col("risk_level").alias("RISK_LEVEL"), F.when(F.col("k") % 3 == 0, "?").otherwise(_text("risk_level_code")).alias("RISK_LEVEL_CODE"), F.lit(None).cast("string").alias("RISK_TYPES"), F.lit(" x ").alias("MEASURE_TEXT"), "source_row")
    got = tables.matching_records({t: raw.where(F.col("t") == t).drop("t") for t in ("coal", "solar", "wind")}, 2000)
    return got.where("issue is null").select(_KEY, "risk_level", "risk_level_code", "source_row")


@query("""WITH o AS (SELECT c_custkey AS fid, c_nationkey % 9 + 2010 AS "year", CASE WHEN c_custkey % 9 = 0 THEN 'wind' ELSE 'coal' END AS t, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT fid, "year", CASE WHEN t <> 'coal' THEN 'type_conflict' WHEN fid % 5 = 0 THEN 'duplicate_year' END AS issue FROM o UNION ALL SELECT fid, "year", CASE WHEN t <> 'coal' THEN 'type_conflict' ELSE 'duplicate_year' END FROM o WHERE fid % 5 = 0""")
def project_series(spark, sf_dir):
    """The rows of a type's table, with type conflicts and years that come twice as issues."""
    c = table(spark, sf_dir, "customer")
    o = c.select(F.col("c_custkey").alias("fid"), (F.col("c_nationkey") % 9 + 2010).alias("year"), F.when(F.col("c_custkey") % 9 == 0, "wind").otherwise("Coal ").alias("project_type"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "coal").otherwise("solar").alias("source_sheet"))
    return tables.project_series(o.unionByName(o.where("fid % 5 = 0")), "coal").select("fid", "year", "issue")


@query("""WITH n AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'x-' || c_custkey ELSE c_custkey::VARCHAR END AS k, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_name END AS name FROM customer)
SELECT k AS project_key, CASE WHEN k = '' OR trim(name) = '' THEN 'empty' ELSE 'unknown_key' END AS issue FROM n WHERE k = '' OR trim(name) = '' OR starts_with(k, 'x-')""")
def name_map(spark, sf_dir):
    """What is wrong with a map of project names: empty keys or names, keys that no project has."""
    c = table(spark, sf_dir, "customer")
    p = c.select(_text("c_custkey").alias(_KEY), F.lit("project").alias("project_name"))
    k = F.when(F.col("c_custkey") % 11 == 0, "").when(F.col("c_custkey") % 13 == 0, F.concat(F.lit("x-"), "c_custkey")).otherwise(_text("c_custkey"))
    return tables.named_projects(p, c.select(k.alias(_KEY), F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.col("c_name")).alias("name")))[1]


# --- files written and read again ------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def csv_scan(spark, sf_dir):
    """A summary written as CSV with padded headers and a blank one, scanned again with tidy names."""
    path = tables.scratch(spark, "summary")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(" o_orderkey "), F.col("o_orderstatus").alias("o_orderstatus "), F.col("o_totalprice").alias("o_totalprice"), F.lit("x").alias(" "))
    sinks.write_summary(o, path, o.columns)
    got = tables.scan(spark, path, "csv", "` o_orderkey ` long, `o_orderstatus ` string, o_totalprice double, ` ` string", ("o_orderkey", "o_orderstatus"), ignoreLeadingWhiteSpace="true")
    return got.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def ndjson_bundle(spark, sf_dir):
    """A bundle of report rows as NDJSON, read again and counted."""
    path = tables.scratch(spark, "bundle")
    sinks.write_bundle({"report_entry": table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")}, path)
    got = tables.bundle(spark, f"{path}/report_entry", "conv_id long, turn int, text string")
    return got.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("SELECT c_nationkey::VARCHAR AS key, count(*) AS n FROM customer GROUP BY 1")
def result_tree(spark, sf_dir):
    """Documents written in one folder a key, scanned again with the key from the path."""
    path = tables.scratch(spark, "tree")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("project_type"))
    sinks.write_documents(c, path)
    got = tables.result_tree(spark, f"{path}/*/*.json").select(F.regexp_extract("key", "=(.*)$", 1).alias("key"), F.size(F.split(F.trim(F.col("text"), F.lit("\n")), "\n")).cast("long").alias("n"))
    return got.groupBy("key").agg(F.sum("n").alias("n"))


@query(f"WITH {PANEL_SQL}, {FACTS_SQL}, {DIAGNOSE_SQL} SELECT project_key, problem_id, status FROM diag")
def rules_from_json(spark, sf_dir):
    """Rules kept as a JSON table, read with their schema and evaluated."""
    path = tables.scratch(spark, "rules")
    own = rules.rule_table(spark)
    sinks.write_bundle({"rules": own}, path)
    read = spark.read.schema(own.schema).json(f"{path}/rules")
    facts = trend.indicator_facts(panel.long(spark, sf_dir), KEYS, by=[_KEY])
    return rules.diagnose(facts, panel.projects(spark, sf_dir), read).select(_KEY, "problem_id", "status")


# --- sinks, contracts, increments ------------------------------------------------------


@query("""SELECT 'orders' AS name, count(*) AS "rows", sum(('0x' || substr(sha256(o_orderkey || chr(31) || o_orderstatus), 1, 12))::BIGINT)::VARCHAR AS digest FROM orders
UNION ALL SELECT 'customer', count(*), sum(('0x' || substr(sha256(c_custkey || chr(31) || c_name), 1, 12))::BIGINT)::VARCHAR FROM customer""")
def manifest(spark, sf_dir):
    """Rows and an order-free digest of every table."""
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return sinks.manifest({"orders": o, "customer": c})


@query("""SELECT 'ch-' || l_orderkey || '-' || l_linenumber AS chart, 'no_report' AS issue FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') UNION ALL SELECT 'report_entry', 'count:' || (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') || '<>' || (SELECT count(*) FROM orders)""")
def bundle_issues(spark, sf_dir):
    """Charts without a report, and tables with another number of rows than the manifest says."""
    reports = table(spark, sf_dir, "orders").select(_text("o_orderkey").alias("id"), "o_orderstatus")
    charts = table(spark, sf_dir, "lineitem").select(_text("l_orderkey").alias("report_id"), F.concat_ws("-", F.lit("ch"), "l_orderkey", "l_linenumber").alias("chart"))
    return sinks.bundle_issues(reports.where("o_orderstatus <> 'P'"), charts, reports.select(F.lit("report_entry").alias("name"), "id").groupBy("name").agg(F.count("*").alias("rows")))


@query("""WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'succeeded' ELSE 'failed' END AS status FROM orders) SELECT count(*) AS selected, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, 0::BIGINT AS pending, CASE WHEN count(*) FILTER (status = 'failed') = 0 THEN 'complete' ELSE 'complete_with_failures' END AS status FROM s""")
def batch_status(spark, sf_dir):
    """The roll-up of a batch and its status."""
    s = F.when(F.col("o_orderstatus") == "P", "failed").otherwise("succeeded")
    return incremental.batch_status(table(spark, sf_dir, "orders").select(s.alias("status")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_custkey ELSE c_name END AS c_name, c_custkey % 3 = 0 AS renamed, true AS analysis_kept, c_custkey % 3 <> 0 AS full_kept FROM customer")
def rename_projects(spark, sf_dir):
    """New names change the full fingerprint of their projects and nothing else."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    old = incremental.with_fingerprints(c, c.columns, ["c_name"], "v1")
    names = c.where("c_custkey % 3 = 0 or c_custkey % 5 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("new "), "c_custkey")).otherwise(F.col("c_name")).alias("name"))
    new = incremental.rename(old, names, "c_custkey", "c_name", c.columns, "v1")
    o = old.select("c_custkey", F.col("full_hash").alias("f"), F.col("analysis_hash").alias("a"))
    return new.join(o, "c_custkey").select("c_custkey", "c_name", "renamed", (F.col("analysis_hash") == F.col("a")).alias("analysis_kept"), (F.col("full_hash") == F.col("f")).alias("full_kept"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0")
def broken_results(spark, sf_dir):
    """Results whose stored hash isn't that of their content."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").withColumn("value_hash", incremental.fingerprint("o_orderkey", "o_orderstatus"))
    worn = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 6 == 0, "?").otherwise(F.col("o_orderstatus")))
    return incremental.intact(worn, "o_orderkey", ["o_orderkey", "o_orderstatus"])[1]


@query(f"""WITH {PANEL_SQL}, t AS (SELECT project_key, CASE WHEN length(project_key) % 3 = 0 THEN NULL ELSE 1998 + length(project_key) % 5 END AS target FROM projects), l AS (SELECT project_key, max("year") AS y FROM wide GROUP BY 1)
SELECT w.project_key, w."year", w."MEAN_NPP" AS npp, NULL AS issue FROM wide w JOIN t USING (project_key) JOIN l USING (project_key) WHERE w."year" = coalesce(target, l.y) UNION ALL
SELECT t.project_key, NULL, NULL, 'no_record_for_target:' || coalesce(target::VARCHAR, '-') FROM t JOIN l USING (project_key) WHERE NOT EXISTS (SELECT 1 FROM wide w WHERE w.project_key = t.project_key AND w."year" = coalesce(target, l.y))""")
def target_rows(spark, sf_dir):
    """Each project's row of its target year, the last year's without a target; targets that aren't there are issues."""
    n = F.length(_KEY)
    t = panel.projects(spark, sf_dir).select(_KEY, F.when(n % 3 > 0, 1998 + n % 5).cast("int").alias("target_year"))
    rows, missing = quality.target_rows(panel.wide(spark, sf_dir), t, [_KEY])
    return rows.select(_KEY, "year", F.col("MEAN_NPP").alias("npp"), F.lit(None).cast("string").alias("issue")).unionByName(missing.select(_KEY, F.lit(None).cast("int").alias("year"), F.lit(None).cast("double").alias("npp"), "issue"))


@query(f"""WITH {PANEL_SQL}, l AS (SELECT wide.* FROM wide JOIN (SELECT project_key, max("year") AS y FROM wide GROUP BY 1) m ON m.project_key = wide.project_key AND m.y = wide."year")
SELECT project_key, unnest(string_split(concat_ws(',', {", ".join(f"CASE WHEN {cond} THEN '{kind}_latest_metric:{m}' END" for m in quality.LATEST_METRICS for cond, kind in ([('"LPI" IS NULL', 'missing')] if m == "LPI" else [('"CA" = 0', 'missing')] if m == "CA" else [('"ERI" > 0.5', 'non_finite')] if m == "ERI" else [("false", "missing")] if m in panel.INDICATORS else [("true", "missing")]))}, CASE WHEN length(project_key) % 2 = 0 THEN 'ml_recommendation_present:requires_rule_review' END), ',')) AS warning FROM l""")
def input_warnings(spark, sf_dir):
    """The 21 metrics of each project's latest row that are missing, empty or not finite, and the model's flag."""
    latest = quality.latest_rows(panel.wide(spark, sf_dir), [_KEY])
    x = quality.metric_snapshot(latest, [_KEY])
    x = x.withColumns({"CA": F.when(F.col("CA") == 0, "").otherwise(_text("CA")), "ERI": F.when(F.col("ERI") > 0.5, float("nan")).otherwise(F.col("ERI")), "ML_ENABLED": F.when(F.length(_KEY) % 2 == 0, " 是").otherwise("否")})
    return quality.warnings(x, [_KEY], quality.LATEST_METRICS, "ML_ENABLED")


@query(f"""WITH {PANEL_SQL}, {FACTS_SQL} SELECT project_key, coalesce(string_agg(indicator, ',' ORDER BY indicator) FILTER (valid), '') AS available, coalesce(string_agg(indicator, ',' ORDER BY indicator) FILTER (NOT valid), '') AS missing FROM facts WHERE n > 0 GROUP BY 1""")
def data_profile(spark, sf_dir):
    """Each project's indicators with and without enough years; series without any value have no fact."""
    f = trend.with_values(trend.indicator_facts(panel.long(spark, sf_dir), KEYS, by=[_KEY]))
    names = lambda ok: joined(F.array_sort(F.collect_list(F.when(F.col("valid") == ok, F.col("indicator")))))
    return f.groupBy(_KEY).agg(names(True).alias("available"), names(False).alias("missing"))


@query(f"""WITH {PANEL_SQL}, {FACTS_SQL}, p AS (SELECT project_key, indicator, count(*) AS points, count(value) AS valued FROM long GROUP BY ALL)
SELECT f.project_key, f.indicator, f.long_term, p.points, p.points AS found, p.valued FROM facts f JOIN p USING (project_key, indicator)""")
def fact_lineage(spark, sf_dir):
    """Facts with the file and row of each of their points, which are looked up again in the files that the scan read."""
    path = tables.scratch(spark, "panel")
    panel.wide(spark, sf_dir).write.parquet(path)
    place = lambda d: d.withColumns({"source_file": F.col("_metadata.file_name"), "source_row": F.col("_metadata.row_index")})
    rows = place(spark.read.parquet(path))
    long = trend.unpivot_panel(rows, [_KEY, "year", "source_file", "source_row"], panel.INDICATORS)
    facts = trend.with_lineage(trend.indicator_facts(long, KEYS).select(*KEYS, "long_term"), long, KEYS)
    each = facts.select(*KEYS, "long_term", F.explode("time_series").alias("p")).select(*KEYS, "long_term", "p.*")
    again = place(spark.read.parquet(path)).select(F.col(_KEY).alias("k_key"), F.col("year").alias("k_year"), "source_file", "source_row", F.create_map(*[z for i in panel.INDICATORS for z in (F.lit(i), F.col(i))]).alias("k_values"))
    both = each.join(again, ["source_file", "source_row"], "left")
    same = (F.col(_KEY) == F.col("k_key")) & (F.col("year") == F.col("k_year")) & F.col("value").eqNullSafe(F.try_element_at("k_values", F.col("indicator")))
    return both.groupBy(*KEYS, "long_term").agg(F.count("*").alias("points"), F.count_if(same).alias("found"), F.count("value").alias("valued"))


# --- streams ---------------------------------------------------------------------------


def _stream(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    path = tables.scratch(spark, "feed")
    e.write.parquet(path)
    return spark.readStream.schema(e.schema).parquet(path)


def _drained(spark, df, mode):
    """All rows of a stream over files, by one run that stops when its input is used up."""
    out = tables.scratch(spark, "drained")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", tables.scratch(spark, "state")).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _drain(spark, feed, batch, mode="append"):
    """Run *batch* over all batches of a feed."""
    q = feed.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", tables.scratch(spark, "state")).trigger(availableNow=True).start()
    q.awaitTermination()


def _nations(spark, sf_dir):
    return panel.customers(spark, sf_dir).groupBy("project_key").agg(F.first("c_nationkey").alias("nation"))


@query("""SELECT "start", event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 10 SECOND, ts) - k * INTERVAL 10 SECOND for k in range(6)]) AS "start" FROM events) GROUP BY ALL""")
def sliding_counts(spark, sf_dir):
    """Events by type in windows of 60 seconds every 10 seconds; the stream's form run over the table as a batch."""
    return feeds.sliding_counts(table(spark, sf_dir, "events")).select("start", "event_type", "n")


@query("""WITH e AS (SELECT ts, event_type, least(2, (date_part('day', ts)::INT - 1) // 10) + CASE event_id % 10 WHEN 3 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS b FROM events),
m AS (SELECT b, max(ts) AS t FROM e GROUP BY 1),
w AS (SELECT e.b, event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS "start" FROM e),
x AS (SELECT w.*, (SELECT max(t) FROM m WHERE m.b < w.b - 1) - INTERVAL 5 DAY AS mark FROM w)
SELECT "start", event_type, count(*) FILTER (mark IS NULL OR "start" + INTERVAL 12 HOUR > mark) AS n, count(*) FILTER ("start" + INTERVAL 12 HOUR <= mark) AS late FROM x GROUP BY ALL""")
def late_events(spark, sf_dir):
    """Events by type in windows of twelve hours every six, from a feed in five batches, some of whose rows come one or two
    batches late; rows that the watermark of five days leaves out are counted apart, as what all windows hold less what the
    stream has counted.  Spark judges a batch by the watermark that the batch before it ran with.  The query writes the feed
    and runs the stream when it is built."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    delay = F.when(F.col("event_id") % 10 == 3, 1).when(F.col("event_id") % 10 == 7, 2).otherwise(0)
    arrives = F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10).cast("int")) + delay
    path = tables.scratch(spark, "feed")
    for k in range(5):  # one file a batch
        e.where(arrives == k).coalesce(1).write.mode("append").parquet(path)
    width = {"width": "12 hours", "slide": "6 hours"}
    counts = feeds.sliding_counts(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path), late="5 days", **width)
    t = keyed.KeyedTable(spark, tables.scratch(spark, "counts"), counts.select("start", "event_type", "n").schema, ["start", "event_type"], "n", ["start", "event_type"], buckets=8)
    _drain(spark, counts, keyed.feed(t), "update")
    every = feeds.sliding_counts(e, late="5 days", **width).select("start", "event_type", F.col("n").alias("total"))
    both = every.join(t.read(), ["start", "event_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.select("start", "event_type", "n", (F.col("total") - F.col("n")).alias("late"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_stream(spark, sf_dir):
    """The first event of each user and type, from a stream with a watermark."""
    d = feeds.distinct_events(_stream(spark, sf_dir), ["user_id", "event_type"], late="100 days")
    return _drained(spark, d, "append").select("user_id", "event_type")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_stream(spark, sf_dir):
    """A feed's latest row of each key, upserted batch by batch into a table."""
    kind = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type").schema
    t = keyed.KeyedTable(spark, tables.scratch(spark, "latest"), kind, ["user_id"], "event_id", ["user_id"], buckets=16)
    _drain(spark, _stream(spark, sf_dir).select(*kind.names), keyed.feed(t))
    return t.read()


@query(f"""WITH {PANEL_SQL}, {FACTS_SQL}, k AS (SELECT project_key, any_value(c_nationkey) AS nation FROM cust GROUP BY 1)
SELECT f.project_key, indicator, n AS valid_years, long_term, recent, round(cv, 6) AS current_value, CASE WHEN nation % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS batch FROM facts f JOIN k USING (project_key)""")
def observation_stream(spark, sf_dir):
    """A feed of yearly observations in two parts, of which the second corrects a third of the projects; facts are worked
    out anew for these alone.  The query writes the feed and runs the stream when it is built."""
    long = panel.long(spark, sf_dir).join(_nations(spark, sf_dir), "project_key")
    wrong = long.withColumns({"value": F.when(F.col("nation") % 3 == 0, F.col("value") * F.col("year") + 1).otherwise(F.col("value")), "seq": F.lit(0)})
    right = long.where("nation % 3 = 0").withColumn("seq", F.lit(1))
    path, names = tables.scratch(spark, "feed"), ["project_key", "year", "indicator", "value", "seq"]
    kind = wrong.select(*names).schema
    for part in (wrong, right):  # one file a batch
        part.select(*names).coalesce(1).write.mode("append").parquet(path)
    facts = lambda rows: trend.indicator_facts(rows, ["project_key", "indicator"]).select("project_key", "indicator", "valid_years", "long_term", "recent", "current_value")
    rows = keyed.KeyedTable(spark, tables.scratch(spark, "rows"), kind, ["project_key", "year", "indicator"], "seq", ["project_key"], buckets=16)
    made = facts(spark.createDataFrame([], kind)).schema.add("batch", "long")
    results = keyed.KeyedTable(spark, tables.scratch(spark, "facts"), made, ["project_key", "indicator"], "batch", ["project_key"], buckets=16)
    _drain(spark, spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path), keyed.feed(rows, results, facts))
    return results.read().select("project_key", "indicator", "valid_years", "long_term", "recent", F.round("current_value", 6).alias("current_value"), "batch")
