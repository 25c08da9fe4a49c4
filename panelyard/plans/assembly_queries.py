"""Registered queries of scope assembly, export and report checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, assembly, risk
from .more_queries import _SCOPE_SQL, _SCOPES, _records, _sql_list
from .panel import FACTS_SQL, PANEL_SQL, table
from .queries import DIAGNOSE_SQL, _diagnoses, joined, query


@query(f"""WITH {_SCOPE_SQL}, tg AS (SELECT DISTINCT project_key, 1998 + length(project_key) % 3 AS target FROM rec) SELECT r.project_key, count(*) AS n, max("year") AS last FROM rec r JOIN tg USING (project_key) WHERE "year" <= target GROUP BY 1""")
def as_of_target(spark, sf_dir):
    """Records up to each project's own target year."""
    r = _records(spark, sf_dir)
    targets = r.select("project_key").distinct().withColumn("target_year", 1998 + F.length("project_key") % 3)
    return assembly.as_of(r, targets).groupBy("project_key").agg(F.count("*").alias("n"), F.max("year").alias("last"))


@query(f"""WITH {_SCOPE_SQL}, c AS (SELECT project_key, scope, count(value) AS n, list_position({_sql_list(_SCOPES[1:])}, scope) AS k FROM rec GROUP BY ALL),
pick AS (SELECT project_key, scope FROM (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY k) AS r FROM c WHERE n >= 3 AND k IS NOT NULL) WHERE r = 1), spine AS (SELECT DISTINCT project_key, "year" FROM rec)
SELECT s.project_key, s."year", 'PRICE' AS indicator, r.value, coalesce(r.source_row, 0) AS source_row FROM spine s JOIN pick USING (project_key) LEFT JOIN rec r ON r.project_key = s.project_key AND r."year" = s."year" AND r.scope = pick.scope""")
def observation_assembly(spark, sf_dir):
    """Yearly observations from each project's chosen scope."""
    r = _records(spark, sf_dir).withColumn("indicator", F.lit("PRICE"))
    picks = risk.pick_scope(r, ["project_key", "indicator"], _SCOPES[1:]).drop("n")
    return assembly.observations(r.drop("project_type"), picks, r)


@query("""WITH a AS (SELECT CASE WHEN s_nationkey % 6 = 2 THEN s_nationkey + 1000 ELSE s_nationkey END AS s_nationkey, 'T' || s_suppkey % 3 AS kind, CASE WHEN s_suppkey % 4 > 0 THEN round(s_acctbal * 100)::BIGINT END AS area FROM supplier),
g AS (SELECT s_nationkey, sum(area)::BIGINT AS area, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types FROM a GROUP BY 1)
SELECT n_nationkey AS nation, CASE WHEN types IS NULL THEN 'not_recorded' ELSE 'recorded' END AS status, area, coalesce(types, '') AS types FROM nation LEFT JOIN g ON s_nationkey = n_nationkey""")
def protected_areas(spark, sf_dir):
    """Areas and kinds, where absence isn't zero."""
    s = table(spark, sf_dir, "supplier")
    nation = F.when(F.col("s_nationkey") % 6 == 2, F.col("s_nationkey") + 1000).otherwise(F.col("s_nationkey"))  # some nations' areas are others', so that they have none
    areas = s.select(nation.alias("nation"), F.concat(F.lit("T"), F.col("s_suppkey") % 3).alias("kind"), F.when(F.col("s_suppkey") % 4 > 0, F.round(F.col("s_acctbal") * 100).cast("long")).alias("area"))
    return assembly.protected_areas(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")), areas, "nation").withColumn("types", joined("types"))


@query("""SELECT o_custkey, string_agg(DISTINCT year(o_orderdate)::VARCHAR, ',' ORDER BY year(o_orderdate)::VARCHAR) AS years, bool_or(year(o_orderdate) = 1999) AS has_target FROM orders GROUP BY 1""")
def source_years(spark, sf_dir):
    """Years of every source, and whether the target is there."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    return assembly.source_years(o, "o_custkey", F.lit(1999)).withColumn("years", joined("years"))


@query("""SELECT o_orderpriority, count(*) AS n, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_orderpriority) AS place FROM orders GROUP BY 1""")
def custom_rank(spark, sf_dir):
    """Listed keys first, the rest by key."""
    from pyspark.sql.window import Window

    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(*assembly.ranked(g, "o_orderpriority", ["5-LOW", "3-MEDIUM"]))).cast("long"))


@query("""SELECT o_orderkey, o_orderstatus <> 'P' AND (CASE o_orderkey % 3 WHEN 0 THEN 'model' ELSE 'plain' END) = 'model' AND trim(CASE WHEN o_orderkey % 5 = 0 THEN 'x' WHEN o_orderkey % 5 = 1 THEN ' ' ELSE '' END) = '' AS eligible FROM orders""")
def export_eligible(spark, sf_dir):
    """Which results may be exported."""
    k = F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") != "P").alias("valid"), F.when(k % 3 == 0, "model").otherwise("plain").alias("backend"), F.when(k % 5 == 0, "x").when(k % 5 == 1, " ").alias("fallback"))
    return x.select("o_orderkey", assembly.eligible(x, "model").alias("eligible"))


@query("""WITH l AS (SELECT l_suppkey, list(DISTINCT l_partkey % 50) FILTER (l_returnflag = 'R') AS a, list(DISTINCT l_partkey % 50) FILTER (l_returnflag = 'A') AS b FROM lineitem GROUP BY 1), s AS (SELECT l_suppkey, coalesce(a, []) AS a, coalesce(b, []) AS b FROM l)
SELECT l_suppkey, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_a, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS only_b, array_to_string(list_sort(list_intersect(a, b)), ',') AS both FROM s""")
def set_differences(spark, sf_dir):
    """What two sets share and don't."""
    p = F.col("l_partkey") % 50
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", p)).alias("a"), F.collect_set(F.when(F.col("l_returnflag") == "A", p)).alias("b"))
    return g.select("l_suppkey", *[joined(c).alias(n) for c, n in zip(assembly.set_differences(F.col("a"), F.col("b")), ("only_a", "only_b", "both"), strict=True)])


@query(f"""WITH {PANEL_SQL}, {FACTS_SQL}, {DIAGNOSE_SQL}, s AS (SELECT project_key, problem_id, status, supported, total FROM diag), d AS (SELECT project_key, problem_id, CASE WHEN hash_k % 7 = 0 THEN 'x' ELSE status END AS status, CASE WHEN hash_k % 5 = 0 THEN supported + 1 ELSE supported END AS supported, total FROM (SELECT *, length(project_key) * 3 + substr(problem_id, 2)::INT AS hash_k FROM s) WHERE hash_k % 11 <> 0),
j AS (SELECT s.project_key, s.problem_id, s.status AS a, d.status AS b, s.supported AS x, d.supported AS y FROM s LEFT JOIN d USING (project_key, problem_id))
SELECT project_key, problem_id, 'missing' AS code, '*' AS field FROM j WHERE b IS NULL UNION ALL SELECT project_key, problem_id, 'changed', 'status' FROM j WHERE b IS NOT NULL AND a <> b UNION ALL SELECT project_key, problem_id, 'changed', 'supported' FROM j WHERE b IS NOT NULL AND x <> y""")
def locked_changes(spark, sf_dir):
    """Facts that drafts (derived by rule) changed or lost."""
    s = _diagnoses(spark, sf_dir).select("project_key", "problem_id", "status", "supported", "total")
    k = F.length("project_key") * 3 + F.substring("problem_id", 2, 3).cast("int")
    d = s.where(k % 11 != 0).withColumns({"status": F.when(k % 7 == 0, "x").otherwise(F.col("status")), "supported": F.when(k % 5 == 0, F.col("supported") + 1).otherwise(F.col("supported"))})
    return analysis.locked_changes(s, d, ["status", "supported", "total"], ["project_key", "problem_id"])
