"""Fingerprints and which entities to run again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns' texts, nulls told apart from empty, in the order of their names."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def with_fingerprints(df: DataFrame, columns: Sequence[str], names_only: Sequence[str], dependency: str = "") -> DataFrame:
    """Adds ``full_hash`` over all and ``analysis_hash`` over all but *names_only*, so that a rename alone doesn't recompute."""
    x = df.withColumn("k_dependency", F.lit(dependency))
    return x.withColumns({"full_hash": fingerprint(*columns, "k_dependency"), "analysis_hash": fingerprint(*[c for c in columns if c not in names_only], "k_dependency")}).drop("k_dependency")


def enqueue(candidates: DataFrame, state: DataFrame, key: str, retry_failed: bool = False) -> DataFrame:
    """(key, action): run what is new, unfinished or changed; failed ones only with *retry_failed*."""
    s = state.select(key, F.col("status"), F.col("full_hash").alias("old_hash"))
    x = candidates.join(s, key, "left")
    action = (
        F.when(F.col("status").isNull(), "run_new").when(F.col("status") == "succeeded", F.when(F.col("old_hash").eqNullSafe(F.col("full_hash")), "skip").otherwise("run_changed"))
        .when(F.col("status") == "failed", F.lit("run_retry" if retry_failed else "skip")).otherwise("run_resume")
    )
    return x.select(key, action.alias("action"))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of *source* win over rows of *target* with the same keys."""
    return target.join(source.select(*keys).distinct(), list(keys), "left_anti").unionByName(source)


def rename(projects: DataFrame, names: DataFrame, key: str, column: str, hashed: Sequence[str], dependency: str = "") -> DataFrame:
    """*projects* with the names of *names* (key, name) put in where they differ, both fingerprints brought up to date, and
    ``renamed``: only these need a new report, none a new analysis."""
    x = projects.join(names.select(key, F.col("name").alias("k_name")), key, "left")
    x = x.withColumn("renamed", F.coalesce(F.col("k_name") != F.col(column), F.lit(False))).withColumn(column, F.coalesce("k_name", column)).drop("k_name")
    return with_fingerprints(x.drop("full_hash", "analysis_hash"), hashed, [column], dependency)


def intact(results: DataFrame, key: str, columns: Sequence[str], stored: str = "value_hash") -> tuple[DataFrame, DataFrame]:
    """(results whose stored hash is that of their content, keys of the others)."""
    same = F.coalesce(F.col(stored) == fingerprint(*columns), F.lit(False))
    return results.where(same), results.where(~same).select(key)


def batch_status(state: DataFrame, paused: Column | bool = False, by: Sequence[str] = ()) -> DataFrame:
    """How many are selected, succeeded, failed or pending, and the status, of each batch (*by*; without it, of all as one);
    *paused*: whether someone has paused it (of a batch, if any of its rows says so)."""
    said = F.coalesce(F.bool_or(F.lit(paused) if isinstance(paused, bool) else paused), F.lit(False))
    n = state.groupBy(*by).agg(F.count("*").alias("selected"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status").isin("failed", "paused")).alias("failed"), said.alias("k_paused"))
    n = n.withColumn("pending", F.col("selected") - F.col("succeeded") - F.col("failed"))
    status = F.when(F.col("k_paused"), "paused").when(F.col("succeeded") == F.col("selected"), "complete").when(F.col("pending") > 0, "paused").otherwise("complete_with_failures")
    return n.withColumn("status", status).drop("k_paused")


def selected_runs(projects: DataFrame, project_type: str | None = None, numbers: DataFrame | None = None, keys: DataFrame | None = None, key: str = "project_key", number: str = "fid") -> DataFrame:
    """The *projects* that a run is asked for: of a type, of some numbers (one column *number*) and of some keys (one column
    *key*); what isn't given doesn't narrow the choice, an empty table chooses nothing."""
    x = projects if project_type is None else projects.where(F.col("project_type") == project_type)
    x = x if numbers is None else x.join(numbers.select(number).distinct(), number, "left_semi")
    return (x if keys is None else x.join(keys.select(key).distinct(), key, "left_semi")).select(*projects.columns)


def uuid5(key: Column, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The name-based UUID (version 5) of a text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), key.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
