"""Merkle fixity audit of WARC archives: trees of record hashes over ordered offset ranges, compared from the roots down.

A record has a number; ``archive_records`` numbers make an archive.  A leaf's digest covers the record's bytes and
its offset range; a node covers up to ``fanout`` children by number, their digests in order, and the range from the
least start to the greatest stop.  Trees run on over the archives up to one root a replica.  The audit compares
roots, then level by level only the children of nodes that differ, and so comes to the damaged records.

Building is one aggregation a level, each over a ``fanout``-th of the rows of the one before; every level is written
once, as the audit reads few of its rows.  The number of levels is the logarithm of the largest record number.

Defined cases: null payloads are empty; records with a null number are left out, as they have no place in an
archive; numbers may be negative or beyond 2**53; records that share a number are one leaf, over their digests and ranges in order; empty replicas are
equal, and against an empty one every record is missing; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as C

FANOUT = 16
ARCHIVE_RECORDS = 4096


def _over(number: str, by: int) -> Column:
    """*number* (a long) divided by *by*, rounded down; exact beyond 2**53, too."""
    return F.expr(f"({number} - pmod({number}, {by}L)) div {by}L")


def warc_text(record_id: Column, uri: Column, payload: Column) -> Column:
    """A response record: header, blank line, payload and the closing blank lines."""
    body = F.coalesce(payload, F.lit(""))
    header = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:"), record_id.cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(header, body, F.lit("\r\n\r\n"))


def digest(record: Column) -> Column:
    return F.sha2(record.cast("binary"), 256)


def with_offsets(records: DataFrame, archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """*records* (record_id, sha, size, ...) with archive, start and stop: records follow each other by number."""
    archive = _over("record_id", archive_records)
    w = Window.partitionBy("archive").orderBy("record_id", "sha").rowsBetween(Window.unboundedPreceding, 0)
    return records.where(F.col("record_id").isNotNull()).withColumn("archive", archive).withColumn("stop", F.sum("size").over(w)).withColumn("start", F.col("stop") - F.col("size"))


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """One level up; all replicas at once."""
    kids = F.array_sort(F.collect_list(F.struct("node", "digest")))
    up = nodes.groupBy("replica", _over("node", fanout).alias("up")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), kids.alias("kids"))
    inside = F.concat_ws(",", F.transform("kids", lambda k: F.concat_ws(":", k["node"].cast("string"), k["digest"])))
    return up.select("replica", F.col("up").alias("node"), F.sha2(F.concat_ws("|", inside, F.col("start").cast("string"), F.col("stop").cast("string")), 256).alias("digest"), "start", "stop")


def build(records: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the trees, leaves first, of *records* (replica, record_id, sha, start, stop): (replica, node, digest, start, stop)."""
    one = F.array_sort(F.collect_list(F.struct("start", "stop", "sha")))
    leaves = records.where(F.col("record_id").isNotNull()).groupBy("replica", F.col("record_id").alias("node")).agg(one.alias("all"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    text = F.concat_ws(",", F.transform("all", lambda x: F.concat_ws(":", x["sha"], x["start"].cast("string"), x["stop"].cast("string"))))
    levels = [C.materialize(leaves.select("replica", "node", F.sha2(text, 256).alias("digest"), "start", "stop"))]
    least, most = levels[0].agg(F.min("node"), F.max("node")).first()
    while least is not None and least != most:
        levels.append(C.materialize(_parents(levels[-1], fanout)))
        before = least, most
        least, most = least // fanout, most // fanout
        if (least, most) == before:  # a negative and a non-negative half
            break
    return levels


def audit(records: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(record_id, status, start, stop, expected, found) of the records in which replica 1 differs from replica 0.

    status: changed (other bytes), moved (same bytes, other range), missing or extra; expected and found are the
    records' digests (of the least range, where several records share a number)."""
    levels = build(records, fanout)
    suspects = None
    for nodes in reversed(levels):
        if suspects is not None:
            nodes = nodes.withColumn("up", _over("node", fanout)).join(suspects, "up", "left_semi")
        of = lambda k: F.max(F.when(F.col("replica") == k, F.col("digest")))  # noqa: B023, E731
        differ = nodes.groupBy("node").agg(of(0).alias("a"), of(1).alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))
        suspects = differ.select(F.col("node").alias("up"))
    bad = records.join(suspects.select(F.col("up").alias("record_id")), "record_id", "left_semi")
    first = lambda k: F.min(F.when(F.col("replica") == k, F.struct("start", "stop", "sha")))
    # Whether all records of a number have the same bytes in both replicas, whatever their ranges.
    shas = lambda k: F.array_sort(F.collect_list(F.when(F.col("replica") == k, F.col("sha"))))
    both = bad.groupBy("record_id").agg(first(0).alias("a"), first(1).alias("b"), shas(0).alias("x"), shas(1).alias("y"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("x") == F.col("y"), "moved").otherwise("changed")
    here = F.coalesce("a", "b")
    return both.select("record_id", status.alias("status"), here["start"].alias("start"), here["stop"].alias("stop"), F.col("a.sha").alias("expected"), F.col("b.sha").alias("found"))
