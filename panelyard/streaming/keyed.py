"""A keyed table that a stream brings up to date batch by batch, and results that are recomputed for the keys it touched.

Rows lie in buckets by a hash of the entity columns.  A batch reads and rewrites only the buckets that its rows fall into, into
a folder of its own (``data/batch=n``), and is committed by an entry of the log (``log/batch=n``) that names, for every bucket,
the batch that holds it now.  Nothing is changed in place: a batch that is lost before its entry is there is written again over
its own folder, one that is replayed after it is known by its entry and left out, and readers go by the newest entry, so they
see whole batches only.  Buckets that no newer entry names are deleted by ``vacuum``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOG = "bucket int, held long"


@dataclass
class KeyedTable:
    """Latest rows by *keys*: of rows with equal keys the one of the greatest *order* (ties: the greatest whole row) counts.  *entity* are
    the keys that rows are dealt into buckets by, so that all rows of an entity lie in one."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: Sequence[str]
    order: str
    entity: Sequence[str]
    buckets: int = 64

    def _folder(self, name: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def committed(self) -> list[int]:
        """Numbers of the batches that have an entry, ascending."""
        system, folder = self._folder("log")
        if not system.exists(folder):
            return []
        names = [f.getPath().getName() for f in system.listStatus(folder)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch=") and system.exists(self._folder(f"log/{n}/_SUCCESS")[1]))

    def placed(self) -> dict[int, int]:
        """Which batch holds each bucket that has rows; at most as many entries as there are buckets."""
        done = self.committed()
        return {r.bucket: r.held for r in self.spark.read.schema(_LOG).json(f"{self.path}/log/batch={done[-1]}").collect()} if done else {}

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """The table, or those of its buckets in *only*; no file of another bucket is opened."""
        paths = [f"{self.path}/data/batch={n}/bucket={b}" for b, n in sorted(self.placed().items()) if only is None or b in set(only)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.entity), F.lit(self.buckets)).cast("int"))

    def latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max(F.struct(self.order, *[c for c in rest if c != self.order])).alias("r")).select(*[c if c in self.keys else F.col(f"r.{c}") for c in self.schema.names])

    def touched(self, rows: DataFrame) -> list[int]:
        return [r.bucket for r in self.bucketed(rows).select("bucket").distinct().orderBy("bucket").collect()]

    def upsert(self, batch: DataFrame, number: int, replace: bool = False) -> list[int]:
        """Bring *batch* in as the batch *number*; gives the buckets that were rewritten, none if it is in already.  *replace*:
        all rows of its entities go first, instead of those of its keys alone."""
        if number in self.committed():
            return []
        rows = batch.select(*self.schema.names)
        found = self.touched(rows)
        if not found:
            return []
        old = self.read(found)
        if replace:
            old = old.join(rows.select(*self.entity).distinct(), list(self.entity), "left_anti").select(*self.schema.names)
        self.bucketed(self.latest(old.unionByName(rows))).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={number}")
        held = self.placed() | {b: number for b in found}
        self.spark.createDataFrame(sorted(held.items()), _LOG).coalesce(1).write.mode("overwrite").json(f"{self.path}/log/batch={number}")
        return found

    def vacuum(self, keep: int = 1) -> int:
        """Delete entries but the newest *keep*, and bucket folders that none of these names; gives the number of folders."""
        done = self.committed()
        wanted = {(r.held, r.bucket) for n in done[-keep:] for r in self.spark.read.schema(_LOG).json(f"{self.path}/log/batch={n}").collect()}
        gone = 0
        for n in done:
            system, folder = self._folder(f"data/batch={n}")
            for f in system.listStatus(folder) if system.exists(folder) else []:
                name = f.getPath().getName()
                if name.startswith("bucket=") and (n, int(name.split("=")[1])) not in wanted:
                    system.delete(f.getPath(), True)
                    gone += 1
        for n in done[:-keep]:
            system, folder = self._folder(f"log/batch={n}")
            system.delete(folder, True)
        return gone


def feed(table: KeyedTable, results: KeyedTable | None = None, compute: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows go into *table*, and *compute* of all rows of the entities that they belong to into *results*.

    Both tables have the same entity columns.  A batch that is lost between them is replayed: *table* knows it already, and what
    *results* gets is worked out from *table* as it is then."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()  # it is asked for its buckets, its rows and its entities
        try:
            table.upsert(batch, number)
            if results is not None and number not in results.committed():
                entities = batch.select(*table.entity).distinct()
                all_rows = table.read(table.touched(batch)).join(entities, list(table.entity), "left_semi")
                results.upsert(compute(all_rows).withColumn("batch", F.lit(number).cast("long")), number, replace=True)
        finally:
            batch.unpersist()

    return run
