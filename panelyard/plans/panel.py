"""The panel that the registered queries work on, derived from the star-schema tables.

Entities are nation and market segment; years are order years, the last of them in part; the project type follows the
region; indicators are yearly aggregates of all orders under the panel's names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDICATORS = ["MEAN_NDVI", "MEAN_NPP", "CA", "LPI", "NP", "PD", "ED", "LSI", "ERI"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their project; nations are the small side of a join that Spark sizes itself."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    types = F.element_at(F.array(*map(F.lit, ("coal", "solar", "wind"))), (F.col("n_regionkey") % 3 + 1).cast("int"))
    joined = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", "c_nationkey", "c_mktsegment", "n_name", "n_regionkey", F.concat_ws("-", "n_name", "c_mktsegment").alias("project_key"), types.alias("project_type"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    who = customers(spark, sf_dir).select("c_custkey", "project_key", "project_type")
    return o.join(who, F.col("o_custkey") == F.col("c_custkey")).withColumn("year", F.year("o_orderdate"))


def wide(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """The yearly rows of every project; *more*: further aggregates of its orders."""
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    n = F.count("*")
    return orders(spark, sf_dir).groupBy("project_key", "project_type", "year").agg(
        (cents / 1e6).alias("MEAN_NDVI"), n.cast("double").alias("MEAN_NPP"), F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("CA"),
        F.when(n >= 3, F.max("o_totalprice") - F.min("o_totalprice")).alias("LPI"), F.countDistinct("c_custkey").cast("double").alias("NP"), (cents / n).alias("PD"),
        F.max("o_totalprice").alias("ED"), F.min("o_totalprice").alias("LSI"), (F.count_if(F.col("o_orderstatus") == "F") / n).alias("ERI"), *more,
    )


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.trend import unpivot_panel

    return unpivot_panel(wide(spark, sf_dir), ["project_key", "year"], INDICATORS)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_key, project_type, scope, risk_tags) of every project with a customer."""
    c = customers(spark, sf_dir).groupBy("project_key").agg(F.first("project_type").alias("project_type"), F.first("c_mktsegment").alias("seg"), F.first("n_regionkey").alias("region"), F.first("c_nationkey").alias("nation"))
    none = F.lit(None).cast("string")
    scope = F.create_map(
        F.lit("ca_landcover_type"), F.when(F.col("region").isin(2, 3), "native_grassland").otherwise("other"), F.lit("has_buffer_gradient"), F.when(F.col("seg") == "BUILDING", "true").otherwise("false"),
        F.lit("historical_abandoned_mine"), F.when(F.col("seg") == "MACHINERY", "true").when(F.col("seg") == "AUTOMOBILE", "false").otherwise(none),
    )
    k = F.col("nation") % 4
    tags = F.when(k == 0, F.array(F.lit("植被退化"))).when(k == 1, F.array(F.lit("景观破碎化"), F.lit("综合生态风险"))).when(k == 3, F.array(F.lit("土地沙化"))).otherwise(F.array().cast("array<string>"))
    return c.select("project_key", "project_type", scope.alias("scope"), tags.alias("risk_tags"))


PANEL_SQL = """
cust AS (SELECT c_custkey, c_nationkey, c_mktsegment, n_regionkey, n_name || '-' || c_mktsegment AS project_key, ['coal', 'solar', 'wind'][n_regionkey % 3 + 1] AS project_type FROM customer JOIN nation ON c_nationkey = n_nationkey),
ords AS (SELECT project_key, project_type, c_custkey, year(o_orderdate)::INT AS "year", o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders JOIN cust ON o_custkey = c_custkey),
wide AS (SELECT project_key, project_type, "year", sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 1e6 AS "MEAN_NDVI", count(*)::DOUBLE AS "MEAN_NPP", count(*) FILTER (o_orderpriority = '1-URGENT')::DOUBLE AS "CA",
  CASE WHEN count(*) >= 3 THEN max(o_totalprice) - min(o_totalprice) END AS "LPI", count(DISTINCT c_custkey)::DOUBLE AS "NP", sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(*) AS "PD",
  max(o_totalprice) AS "ED", min(o_totalprice) AS "LSI", (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE / count(*) AS "ERI" FROM ords GROUP BY ALL),
long AS (SELECT project_key, "year", indicator, value FROM wide UNPIVOT INCLUDE NULLS (value FOR indicator IN ("MEAN_NDVI", "MEAN_NPP", "CA", "LPI", "NP", "PD", "ED", "LSI", "ERI"))),
projects AS (SELECT DISTINCT project_key, project_type, CASE WHEN n_regionkey IN (2, 3) THEN 'native_grassland' ELSE 'other' END AS landcover, c_mktsegment = 'BUILDING' AS buffer,
  CASE c_mktsegment WHEN 'MACHINERY' THEN true WHEN 'AUTOMOBILE' THEN false END AS mine,
  CASE c_nationkey % 4 WHEN 0 THEN ['植被退化'] WHEN 1 THEN ['景观破碎化', '综合生态风险'] WHEN 3 THEN ['土地沙化'] ELSE []::VARCHAR[] END AS tags FROM cust)
"""

#: The facts, written as separate aggregates and a plain fit of both parts at every split.
FACTS_SQL = """
pts AS (SELECT project_key, indicator, "year" AS t, value AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY project_key, indicator) AS n, lag(value) OVER w AS pv, lead(value) OVER w AS nv, lag("year") OVER w AS pt,
  avg(value) OVER (PARTITION BY project_key, indicator) AS m FROM long WHERE value IS NOT NULL AND isfinite(value) WINDOW w AS (PARTITION BY project_key, indicator ORDER BY "year")),
sg AS (SELECT *, CASE WHEN pv IS NULL OR nv IS NULL THEN v ELSE list_sort([pv, v, nv])[2] END AS y,
  CASE WHEN v - pv > greatest(abs(m), 1e-12) * 0.001 THEN 1 WHEN v - pv < -greatest(abs(m), 1e-12) * 0.001 THEN -1 WHEN pv IS NOT NULL THEN 0 END AS s FROM pts),
nz AS (SELECT project_key, indicator, s, lag(s) OVER (PARTITION BY project_key, indicator ORDER BY t) AS ps FROM sg WHERE s <> 0),
rev AS (SELECT project_key, indicator, count(*) FILTER (s <> ps) AS reversals FROM nz GROUP BY ALL),
trn AS (SELECT project_key, indicator, list(pt ORDER BY pt) FILTER (s * ps2 = -1) AS turning FROM (SELECT *, lag(s) OVER (PARTITION BY project_key, indicator ORDER BY t) AS ps2 FROM sg) GROUP BY ALL),
st AS (SELECT project_key, indicator, count(*) AS n, avg(v) AS m, regr_slope(v, t) AS slope, arg_max(t, t) AS cy, arg_max(v, t) AS cv, arg_max(pv, t) AS prev, min(v) AS lo, max(v) AS hi,
  arg_min(t, struct_pack(a := v, b := t)) AS loy, arg_max(t, struct_pack(a := v, b := -t)) AS hiy FROM sg GROUP BY ALL),
sp AS (SELECT DISTINCT project_key, indicator, n, unnest(generate_series(2, n - 2)) AS split FROM sg WHERE n >= 4),
side AS (SELECT sp.project_key, sp.indicator, split, sp.n, regr_slope(y, t) FILTER (i <= split) AS ls, regr_slope(y, t) FILTER (i >= split) AS rs, avg(y) FILTER (i <= split) AS lm, avg(y) FILTER (i >= split) AS rm,
  coalesce(regr_syy(y, t) FILTER (i <= split) - regr_slope(y, t) FILTER (i <= split) * regr_sxy(y, t) FILTER (i <= split), 0) AS le, coalesce(regr_syy(y, t) FILTER (i >= split) - regr_slope(y, t) FILTER (i >= split) * regr_sxy(y, t) FILTER (i >= split), 0) AS re
  FROM sp JOIN sg ON sg.project_key = sp.project_key AND sg.indicator = sp.indicator GROUP BY ALL),
ch AS (SELECT *, CASE WHEN abs(ls * (split - 1) / greatest(abs(lm), 1e-12)) < 1000 THEN round(ls * (split - 1) / greatest(abs(lm), 1e-12), 12) ELSE ls * (split - 1) / greatest(abs(lm), 1e-12) END AS lc, CASE WHEN abs(rs * (n - split) / greatest(abs(rm), 1e-12)) < 1000 THEN round(rs * (n - split) / greatest(abs(rm), 1e-12), 12) ELSE rs * (n - split) / greatest(abs(rm), 1e-12) END AS rc FROM side),
pw AS (SELECT project_key, indicator, arg_min(CASE WHEN lc > 0 THEN 'rise_then_fall' ELSE 'fall_then_rise' END, struct_pack(a := le + re, b := split)) AS shape FROM ch WHERE abs(lc) >= 0.1 AND abs(rc) >= 0.1 AND lc * rc < 0 GROUP BY ALL),
mis AS (SELECT project_key, indicator, coalesce(list("year" ORDER BY "year") FILTER (value IS NULL), []) AS missing FROM long GROUP BY ALL),
f0 AS (SELECT mis.project_key, mis.indicator, coalesce(st.n, 0) AS n, missing, cy, cv, prev, lo, hi, loy, hiy, shape, coalesce(reversals, 0) AS reversals, coalesce(turning, []) AS turning,
  CASE WHEN abs(slope * (st.n - 1) / greatest(abs(m), 1e-12)) < 1000 THEN round(slope * (st.n - 1) / greatest(abs(m), 1e-12), 12) ELSE slope * (st.n - 1) / greatest(abs(m), 1e-12) END AS rsl, CASE WHEN abs((hi - lo) / greatest(abs(m), 1e-12)) < 1000 THEN round((hi - lo) / greatest(abs(m), 1e-12), 12) ELSE (hi - lo) / greatest(abs(m), 1e-12) END AS rr, CASE WHEN abs((cv - prev) / greatest(abs(prev), 1e-12)) < 1000 THEN round((cv - prev) / greatest(abs(prev), 1e-12), 12) ELSE (cv - prev) / greatest(abs(prev), 1e-12) END AS rch
  FROM mis LEFT JOIN st USING (project_key, indicator) LEFT JOIN rev USING (project_key, indicator) LEFT JOIN trn USING (project_key, indicator) LEFT JOIN pw USING (project_key, indicator)),
facts AS (SELECT *, n >= 3 AS valid, CASE WHEN n < 3 THEN 'unknown' WHEN abs(rsl) < 0.1 AND rr < 0.1 THEN 'stable' WHEN shape IS NOT NULL THEN shape
  WHEN rsl >= 0.1 THEN CASE WHEN reversals >= 2 THEN 'fluctuating_upward' ELSE 'overall_up' END WHEN rsl <= -0.1 THEN CASE WHEN reversals >= 2 THEN 'fluctuating_downward' ELSE 'overall_down' END ELSE 'stable' END AS long_term,
  CASE WHEN n < 3 THEN 'unknown' WHEN rch >= 0.03 THEN 'up' WHEN rch <= -0.03 THEN 'down' ELSE 'stable' END AS recent FROM f0)
"""

#: The older trend semantics.
TREND_SQL = """
q0 AS (SELECT project_key, indicator, "year" AS t, value AS v, lag(value) OVER w AS pv, greatest(max(abs(value)) OVER (PARTITION BY project_key, indicator), 1e-12) * 0.001 AS band FROM long WHERE value IS NOT NULL WINDOW w AS (PARTITION BY project_key, indicator ORDER BY "year")),
q1 AS (SELECT *, CASE WHEN pv IS NULL THEN NULL WHEN abs(v - pv) <= band THEN 0 ELSE sign(v - pv)::INT END AS s FROM q0),
q2 AS (SELECT *, lag(s) OVER (PARTITION BY project_key, indicator ORDER BY t) AS ps FROM q1),
qn AS (SELECT project_key, indicator, arg_min(s, t) AS fs, count(*) FILTER (s <> pz) AS rev FROM (SELECT *, lag(s) OVER (PARTITION BY project_key, indicator ORDER BY t) AS pz FROM q1 WHERE s <> 0) GROUP BY ALL),
q3 AS (SELECT project_key, indicator, count(*) AS observations, min(t) AS start_year, max(t) AS end_year, arg_min(v, t) AS start_value, arg_max(v, t) AS end_value, regr_slope(v, t) AS slope, max(band) AS band, min(v) AS lo, max(v) AS hi,
  arg_min(t, struct_pack(a := v, b := t)) AS loy, arg_max(t, struct_pack(a := v, b := -t)) AS hiy, arg_max(s, t) AS rs, count(*) FILTER (s > 0) AS ups, count(*) FILTER (s < 0) AS downs, coalesce(list(t ORDER BY t) FILTER (s * ps = -1), []) AS turning FROM q2 GROUP BY ALL HAVING count(*) >= 2),
q4 AS (SELECT q3.*, fs, coalesce(rev, 0) AS rev, hi - lo <= band AS flat, CASE WHEN hi - lo <= band OR abs(slope * (end_year - start_year)) <= band THEN 'stable' WHEN slope > 0 THEN 'increase' ELSE 'decrease' END AS direction FROM q3 LEFT JOIN qn USING (project_key, indicator)),
trends AS (SELECT *, CASE WHEN flat THEN 'stable' WHEN ups > 0 AND downs = 0 THEN 'overall_increase' WHEN downs > 0 AND ups = 0 THEN 'overall_decrease' WHEN rev = 1 AND fs < 0 THEN 'decrease_then_increase' WHEN rev = 1 AND fs > 0 THEN 'increase_then_decrease'
  WHEN direction = 'increase' THEN 'fluctuating_increase' WHEN direction = 'decrease' THEN 'fluctuating_decrease' ELSE 'stable' END AS pattern, CASE WHEN rs > 0 THEN 'increase' WHEN rs < 0 THEN 'decrease' ELSE 'stable' END AS recent FROM q4)
"""
