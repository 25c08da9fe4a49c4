"""Sinks: nested documents, NDJSON bundles, summaries, manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def nest(parents: DataFrame, children: Mapping[str, DataFrame], key: str = "project_key") -> DataFrame:
    """One row a parent with an ordered array of each child table's rows."""
    out = parents
    for name, df in children.items():
        rest = [c for c in df.columns if c != key]
        out = out.join(df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name)), key, "left")
    return out


def write_documents(nested: DataFrame, path: str, by: str = "project_type") -> None:
    nested.write.partitionBy(by).mode("overwrite").json(path)


def write_bundle(tables: Mapping[str, DataFrame], path: str) -> None:
    """One NDJSON folder a table."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_summary(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with a header and these columns only."""
    df.select(*columns).write.mode("overwrite").option("header", "true").csv(path)


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(name, rows, digest): counts and an order-free digest of every table: the first 48 bits of each row's SHA-256, added up."""
    out = None
    for name, df in tables.items():
        text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns])
        h = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(38,0)")
        row = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest")).select(F.lit(name).alias("name"), "rows", "digest")
        out = row if out is None else out.unionByName(row)
    return out


def export_lines(tables: Mapping[str, DataFrame], path: str, rows_per_file: int = 100_000) -> None:
    """All tables in one write, as files of JSON lines under ``table=<name>``, none of more than *rows_per_file* rows."""
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
        out = part if out is None else out.unionByName(part)
    out.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("table").text(path)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(table, file, bytes, rows, sha256) of everything that ``export_lines`` has written to *path*."""
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    files = spark.read.format("binaryFile").load(path).select("table", name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    rows = spark.read.text(path).groupBy("table", F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))
    return files.join(rows, ["table", "file"], "left").select("table", "file", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"), "sha256")


def manifest_issues(said: DataFrame, there: DataFrame) -> DataFrame:
    """(table, file, issue): files that a manifest names and aren't there, that it doesn't name, or whose digest is another."""
    x = said.select("table", "file", F.col("sha256").alias("k_said")).join(there.select("table", "file", F.col("sha256").alias("k_there")), ["table", "file"], "full_outer")
    issue = F.when(F.col("k_there").isNull(), "missing").when(F.col("k_said").isNull(), "extra").when(F.col("k_said") != F.col("k_there"), "changed")
    return x.withColumn("issue", issue).where("issue is not null").select("table", "file", "issue")


def report_tables(reports: DataFrame, charts: DataFrame, key: str = "project_key") -> dict[str, DataFrame]:
    """The three export tables from (key, markdown) and (key, insert_key, type, data_json): entries and charts under a report's
    name-based id, and the ids by key."""
    from ..operators.incremental import uuid5

    rid = F.replace(uuid5(F.col(key), "41fdcf44-45e4-4da9-a9a4-c571331cb45f"), F.lit("-"), F.lit(""))
    return {
        "report_entry": reports.select(rid.alias("id"), F.col("markdown").alias("content"), F.lit("报告").alias("type")), "report_chart": charts.select(rid.alias("report_id"), "insert_key", "type", "data_json"),
        "project_report_id": reports.select(key, rid.alias("report_id")),
    }


def bundle_issues(reports: DataFrame, charts: DataFrame, said: DataFrame) -> DataFrame:
    """(chart, issue): charts (report_id, chart) without a report (id), and a table whose rows aren't as many as *said* (name,
    rows: one row for report_entry)."""
    alone = charts.join(reports.select(F.col("id").alias("report_id")).distinct(), "report_id", "left_anti").select("chart", F.lit("no_report").alias("issue"))
    n = reports.agg(F.count("*").alias("n"))
    wrong = said.crossJoin(F.broadcast(n)).where("n <> rows")  # one row each
    return alone.unionByName(wrong.select(F.col("name").alias("chart"), F.format_string("count:%d<>%d", "n", "rows").alias("issue")))


def progress(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count("*").alias("n"))


def failures(state: DataFrame) -> DataFrame:
    return state.where(F.col("status").isin("failed", "paused"))
