"""Scans: declared schemas, header clean-up, lineage, unions by type, optional tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import lenient_number, require_columns, strict_int, text_or_empty


def scan(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, required: tuple[str, ...] = (), **options) -> DataFrame:
    """A table with tidy headers and lineage (``source_file``); *required* columns must be there."""
    reader = spark.read.options(**({"header": "true"} if kind == "csv" else {}), **options)
    if schema is not None:
        reader = reader.schema(schema)
    raw = reader.format(kind).load(path)
    return require_columns(tidy_headers(raw.withColumn("source_file", F.col("_metadata.file_path"))), list(required))


def tidy_headers(df: DataFrame) -> DataFrame:
    """Names trimmed; columns with blank names go."""
    return df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in df.columns if c.strip()])


def union_types(tables: Mapping[str, DataFrame], column: str = "project_type") -> DataFrame:
    """One table of several, each row with its type; missing columns are null."""
    out = None
    for kind, df in tables.items():
        part = df.withColumn(column, F.lit(kind))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def optional(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """A table, or an empty one of *schema* where there is none."""
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def type_of_label(label: Column, tokens: Mapping[str, str]) -> Column:
    """The type whose token the label holds; null unless exactly one does."""
    found = F.array_compact(F.array(*[F.when(label.contains(t), F.lit(k)) for t, k in tokens.items()]))
    return F.when(F.size(found) == 1, found[0])


def project_key(kind: Column, number: Column) -> Column:
    return F.format_string("%s-%04d", kind, number)


def bundle(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """NDJSON rows."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def result_tree(spark: SparkSession, glob: str) -> DataFrame:
    """(key, name, text) of the files of one folder a key."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return spark.read.text(glob, wholetext=True).select(F.element_at(parts, -2).alias("key"), F.element_at(parts, -1).alias("name"), F.col("value").alias("text"))


# --- the domain's raw tables ------------------------------------------------------------

# Metrics and headers of the raw tables, type labels, and the names that metrics get.
MAIN_FIELDS, LANDSCAPE_FIELDS, RISK_FIELDS = ["NDVI", "NPP", "NEP", "NCS", "EVI", "SIF", "VCI", "VCS", "VCR"], ["CA", "LPI", "NP", "PD", "ED", "LSI"], ["LER", "ES", "EP", "RER", "CVR", "CERI_raw", "CERI"]
TYPE_LABELS = {"光伏": "solar", "风电": "wind", "煤矿": "coal"}
MAIN_NAMES = {"NDVI": "MEAN_NDVI", "NPP": "MEAN_NPP", "NEP": "MEAN_NEP", "NCS": "MEAN_NCS", "EVI": "MEAN_EVI", "SIF": "MEAN_SIF", "VCI": "MEAN_VCI", "VCS": "MEAN_VCS_C", "VCR": "MEAN_VCR"}


def _records(raw: DataFrame, kind: Column, number: str, year: str | None, texts: Mapping[str, str], numbers: Mapping[str, str]) -> DataFrame:
    """Typed rows of a raw table, each with its key; ``issue`` says what makes a row unusable (null: nothing)."""
    fid = strict_int(F.col(number))
    at = strict_int(F.col(year)) if year else None
    issue = F.when(kind.isNull(), "unknown_project_type").when(fid.isNull(), f"invalid_{number}")
    issue = issue.when(at.isNull(), f"invalid_{year}") if year else issue
    cols = [project_key(kind, fid).alias("project_key"), kind.alias("project_type"), fid.alias("fid"), *([at.alias("year")] if year else [])]
    cols += [text_or_empty(F.col(f"`{c}`")).alias(n) for n, c in texts.items()] + [lenient_number(F.col(f"`{c}`")).alias(n) for n, c in numbers.items()]
    return raw.select(*cols, "source_row", issue.alias("issue"))


def main_records(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The yearly main metrics of all types (type -> raw table with source_row)."""
    raw = union_types(tables, "k_type")
    return _records(raw, F.col("k_type"), "序号", "年份", {"scope": "研究范围"}, {f: f for f in MAIN_FIELDS})


def landscape_records(tables: Mapping[str, DataFrame]) -> DataFrame:
    raw = union_types(tables, "k_type")
    return _records(raw, F.col("k_type"), "FID", "年份", {"scope": "距离", "category": "类别"}, {f: f for f in LANDSCAPE_FIELDS})


def _labelled(column: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(z) for kv in TYPE_LABELS.items() for z in kv]), F.trim(column))


def protected_records(raw: DataFrame) -> DataFrame:
    return _records(raw, _labelled("类型"), "FID", None, {"scope": "距离", "protected_area_type": "保护区类型"}, {"intersection_area_km2": "侵占面积(km²)"})


def risk_records(raw: DataFrame) -> DataFrame:
    return _records(raw, _labelled("类型"), "FID", "年份", {"scope": "距离", "risk_level": "RISK_LEVEL", "league": "盟市", "banner": "旗县"}, {**{f: f for f in RISK_FIELDS}, "risk_level_code": "RISK_LEVEL_CODE"})


def risk_trend_records(raw: DataFrame) -> DataFrame:
    """One row a project; its type is the one that the project's label names."""
    kind = type_of_label(F.col("项目"), TYPE_LABELS)
    return _records(raw, kind, "FID", None, {"project_label": "项目", "trend_type": "趋势类型"}, {"start_ceri": "首年CERI", "end_ceri": "末年CERI", "change_rate_percent": "变化率(%)", "sen_slope": "Sen_slope", "p_value_raw": "P_value"})


def matching_records(tables: Mapping[str, DataFrame], target_year: int) -> DataFrame:
    """The target year's matching results of all types; the type a row names must be its table's."""
    raw = union_types(tables, "k_type")
    named = F.lower(text_or_empty(F.col("PROJECT_TYPE")))
    x = _records(raw.withColumn("k_named", F.when(named == F.col("k_type"), named)), F.col("k_named"), "FID", "YEAR", {"risk_level": "RISK_LEVEL", "risk_types": "RISK_TYPES", "measure_text": "MEASURE_TEXT", "code": "RISK_LEVEL_CODE"}, {})
    return x.where((F.col("year") == target_year) | F.col("issue").isNotNull()).withColumns({"risk_level": F.nullif("risk_level", F.lit("")), "risk_level_code": strict_int(F.col("code"))}).drop("code")


def rename_metrics(df: DataFrame, names: Mapping[str, str] = MAIN_NAMES) -> DataFrame:
    """Raw metric names to those of the rules; names that aren't there are left alone."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def project_series(observations: DataFrame, project_type: str, fid: int | None = None) -> DataFrame:
    """The rows of a type (and number) with ``issue``: another type than its table's, or a key that comes twice."""
    from pyspark.sql.window import Window

    x = observations.where(F.col("source_sheet") == project_type)
    x = x.where(F.col("fid") == fid) if fid is not None else x
    twice = F.count("*").over(Window.partitionBy("fid", "year")) > 1
    return x.withColumn("issue", F.when(F.lower(F.trim("project_type")) != project_type, "type_conflict").when(twice, "duplicate_year"))


def named_projects(projects: DataFrame, names: DataFrame, key: str = "project_key") -> tuple[DataFrame, DataFrame]:
    """(*projects* with ``project_name`` from *names* (key, name), issues): a project without a name keeps its default; empty
    keys or names and unknown keys are issues."""
    tidy = names.select(F.trim(key).alias(key), F.trim("name").alias("name"))
    empty = tidy.where((F.coalesce(key, F.lit("")) == "") | (F.coalesce("name", F.lit("")) == "")).select(key, F.lit("empty").alias("issue"))
    fine = tidy.where((F.col(key) != "") & (F.col("name") != ""))
    unknown = fine.join(projects.select(key), key, "left_anti").select(key, F.lit("unknown_key").alias("issue"))
    out = projects.join(fine.groupBy(key).agg(F.max("name").alias("k_name")), key, "left").withColumn("project_name", F.coalesce("k_name", "project_name")).drop("k_name")
    return out, empty.unionByName(unknown)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for *name* in the folder that spark.checkpoint.dir names; a local session without one gets its own."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
