"""Checks that give rows of issues instead of raising, so that they run over all entities at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """*df*, if it has all the columns; the schema alone is looked at."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def strict_int(x: Column) -> Column:
    """A whole number from text or a number, cut at the point; null if it isn't one or doesn't fit."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < 2147483648.0), d.cast("long")).try_cast("int")


def lenient_number(x: Column) -> Column:
    return F.trim(x.cast("string")).try_cast("double")


def text_or_empty(x: Column) -> Column:
    return F.coalesce(F.trim(x.cast("string")), F.lit(""))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of the two has: missing (in b) or extra."""
    x = a.select(key).distinct().withColumn("in_a", F.lit(True)).join(b.select(key).distinct().withColumn("in_b", F.lit(True)), key, "full_outer")
    return x.where("in_a is null or in_b is null").select(key, F.when(F.col("in_b").isNull(), "missing").otherwise("extra").alias("side"))


def preview(differences: DataFrame, key: str, n: int = 5) -> DataFrame:
    """(side, keys): the first *n* keys of each side of ``key_differences``, for a message; the rows themselves stay whole."""
    w = Window.partitionBy("side").orderBy(key)
    first = differences.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    return first.groupBy("side").agg(F.array_sort(F.collect_list(key)).alias("keys"))


def coalesce_agreed(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, column, conflict): the value that is not empty; conflict if several differ."""
    v = F.nullif(F.trim(column), F.lit(""))
    return df.groupBy(*keys).agg(F.min(v).alias(column), (F.min(v) != F.max(v)).alias("conflict")).withColumn("conflict", F.coalesce("conflict", F.lit(False)))


# Metrics of a project's latest row, and how a flag says yes.
LATEST_METRICS = ["MEAN_NDVI", "STD_NDVI", "MEAN_NPP", "STD_NPP", "CA", "LPI", "NP", "PD", "ED", "LSI", "MEAN_VCI", "MEAN_EVI", "MEAN_SIF", "MEAN_VCS_C", "MEAN_VCS_CO2e", "ERI", "LER", "ES", "EP", "RER", "CVR"]
YES = ["是", "true", "True", "1"]


def metric_snapshot(latest: DataFrame, keys: Sequence[str], metrics: Sequence[str] = tuple(LATEST_METRICS)) -> DataFrame:
    """(keys, metrics): the fixed set of metrics of the latest rows; one that the table lacks is null."""
    return latest.select(*keys, *[F.col(m) if m in latest.columns else F.lit(None).cast("double").alias(m) for m in metrics])


def warnings(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], flag: str | None = None) -> DataFrame:
    """(keys, warning): metrics of a row that are missing (null or empty text) or not finite, and *flag* if it says yes."""
    empty = lambda m: F.col(m).isNull() | (F.col(m).cast("string") == "")
    number = lambda m: F.col(m).try_cast("double")
    each = [F.when(empty(m), F.lit(f"missing_latest_metric:{m}")).when(F.isnan(number(m)) | (F.abs(number(m)) == float("inf")), F.lit(f"non_finite_latest_metric:{m}")) for m in metrics]
    if flag:
        each.append(F.when(F.trim(flag).isin(YES), F.lit("ml_recommendation_present:requires_rule_review")))
    return df.select(*keys, F.explode(F.array_compact(F.array(*each))).alias("warning"))


def target_rows(df: DataFrame, targets: DataFrame, keys: Sequence[str], time: str = "year", target: str = "target_year") -> tuple[DataFrame, DataFrame]:
    """(rows, issues): the row of each key's target time, or of its last one where the target is null; a target that isn't
    there is an issue."""
    last = df.groupBy(*keys).agg(F.max(time).alias("k_last"))
    t = targets.join(last, list(keys), "left").withColumn("k_at", F.coalesce(target, "k_last"))
    rows = df.join(t.select(*keys, F.col("k_at").alias(time)), [*keys, time])
    missing = t.join(rows.select(*keys), list(keys), "left_anti").select(*keys, F.concat(F.lit("no_record_for_target:"), F.coalesce(F.col(target).cast("string"), F.lit("-"))).alias("issue"))
    return rows, missing


def latest_rows(df: DataFrame, keys: Sequence[str], time: str = "year", until: Column | None = None) -> DataFrame:
    """The row of each key's last time (up to *until*)."""
    rest = [c for c in df.columns if c not in keys]
    x = df.where(F.col(time) <= until) if until is not None else df
    return x.groupBy(*keys).agg(F.max_by(F.struct(*rest), time).alias("r")).select(*keys, "r.*")


def contract_issues(docs: DataFrame, key: str, json: str, required: Sequence[str], allowed: Sequence[str] | None = None, enums: Mapping[str, Sequence[str]] | None = None, arrays: Sequence[str] = ()) -> DataFrame:
    """(key, code, field) of JSON documents against a top-level contract: keys that lack or are too many, values that aren't
    allowed, and *arrays* that hold something else."""
    names = F.json_object_keys(json)
    lit = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    tag = lambda code, xs: F.transform(xs, lambda f: F.struct(F.lit(code).alias("code"), f.alias("field")))
    issues = [tag("missing", F.array_except(lit(required), names))]
    if allowed is not None:
        issues.append(tag("unexpected", F.array_except(names, lit(allowed))))
    for f in arrays:
        body = F.trim(F.get_json_object(json, f"$.{f}"))
        issues.append(tag("wrong_type", F.when(body.isNotNull() & ~body.startswith("["), lit([f])).otherwise(lit([]))))
    for f, values in (enums or {}).items():
        got = F.get_json_object(json, f"$.{f}")
        issues.append(tag("not_allowed", F.when(got.isNotNull() & ~got.isin(list(values)), lit([f])).otherwise(lit([]))))
    return docs.select(key, F.explode(F.concat(*issues)).alias("i")).select(key, "i.code", "i.field")
