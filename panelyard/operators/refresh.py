"""Results kept by key and refreshed in parts.

Inputs, results and state are tables partitioned by ``part``, a hash of the key.  A run compares today's fingerprints with the
state, and touches only the parts in which something has to happen: it reads these parts of the inputs (a filter on the
partition column, so no other file is opened), computes the keys that need it, puts them in place of their old rows, and
overwrites the parts by dynamic partition overwrite.  The state is written last: a run that is lost in between is done again
by the next one, which changes nothing that is right already.

A key is computed if it is new, was left unfinished, failed (where wanted), or its analysis hash changed; if only the full hash
changed, its rows get the new name and nothing is computed; if it is gone, its rows go.  Keys are never null.  A computed key
without rows counts as failed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .incremental import enqueue

PART = "part"
STATE = ("full_hash", "analysis_hash", "status")


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int").alias(PART)


def write_parts(df: DataFrame, path: str, key: str, parts: int) -> None:
    """A whole table by parts; Spark sizes the files of a part, so a large one is several tasks' work."""
    df.drop(PART).withColumn(PART, part_of(key, parts)).hint("rebalance", PART).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(PART).parquet(path)


def content_hash(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, content): a digest of all rows of a key in whatever order: two 60-bit pieces of each row's SHA-256, added up."""
    text = F.concat_ws("\u001f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns])
    piece = lambda at: F.sum(F.conv(F.substring("k_sha", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    x = rows.select(key, F.sha2(text, 256).alias("k_sha")).groupBy(key).agg(F.count("*").cast("string").alias("n"), piece(1).alias("a"), piece(16).alias("b"))
    return x.select(key, F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("content"))


def actions(candidates: DataFrame, state: DataFrame, key: str, retry_failed: bool = False) -> DataFrame:
    """(key, action) of every key of either side: ``enqueue``'s, but rename where only the full hash changed, and remove."""
    todo = enqueue(candidates, state, key, retry_failed)
    same = state.select(key, F.col("analysis_hash").alias("k_old")).join(candidates.select(key, F.col("analysis_hash").alias("k_new")), key)
    x = todo.join(same, key, "left").withColumn("action", F.when((F.col("action") == "run_changed") & F.col("k_old").eqNullSafe(F.col("k_new")), "rename").otherwise(F.col("action")))
    gone = state.select(key).join(candidates.select(key), key, "left_anti").select(key, F.lit("remove").alias("action"))
    return x.select(key, "action").unionByName(gone)


@dataclass
class Refresh:
    """Where the three tables are, and how many parts they have (fixed when they are first written)."""

    inputs: str
    results: str
    state: str
    key: str
    parts: int
    schemas: dict = field(default_factory=dict)

    def load(self, spark: SparkSession, path: str, only: Sequence[int] | None = None) -> DataFrame:
        """A table, or its parts in *only*.  Its schema is looked up once; Spark then opens files of these parts alone."""
        if path not in self.schemas:
            self.schemas[path] = spark.read.parquet(path).schema
        df = spark.read.schema(self.schemas[path]).parquet(path)
        return df if only is None else df.where(F.col(PART).isin([int(p) for p in only]))

    def first(self, candidates: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> None:
        """Everything from the inputs, with the state of *candidates* (key, name, full_hash, analysis_hash)."""
        spark = candidates.sparkSession
        made = compute(self.load(spark, self.inputs).drop(PART)).join(candidates.select(self.key, "name"), self.key)
        write_parts(made, self.results, self.key, self.parts)
        ran = self.load(spark, self.results).select(self.key).distinct().withColumn("k_ran", F.lit(True))
        status = F.when(F.col("k_ran"), "succeeded").otherwise("failed")
        write_parts(candidates.join(ran, self.key, "left").select(self.key, "full_hash", "analysis_hash", status.alias("status")), self.state, self.key, self.parts)

    def plan(self, candidates: DataFrame, retry_failed: bool = False) -> DataFrame:
        """(key, action, part, name, full_hash, analysis_hash) of the keys that a run has to do with."""
        spark = candidates.sparkSession
        todo = actions(candidates, self.load(spark, self.state), self.key, retry_failed).where("action <> 'skip'")
        return todo.join(candidates.select(self.key, "name", "full_hash", "analysis_hash"), self.key, "left").withColumn(PART, part_of(self.key, self.parts))

    def stale(self, todo: DataFrame, touched: Sequence[int]) -> DataFrame:
        """The input rows that have to be computed."""
        run = todo.where(F.col("action").startswith("run")).select(self.key)
        return self.load(todo.sparkSession, self.inputs, touched).join(run, self.key, "left_semi").drop(PART)

    def merged(self, todo: DataFrame, touched: Sequence[int], fresh: DataFrame) -> DataFrame:
        """The new rows of the touched parts: *fresh* ones, renamed ones, and those that nothing happened to."""
        old = self.load(todo.sparkSession, self.results, touched).join(todo.select(self.key, "action", F.col("name").alias("k_name")), self.key, "left")
        kept = old.where("action is null or action = 'rename'").withColumn("name", F.when(F.col("action") == "rename", F.col("k_name")).otherwise(F.col("name"))).drop("action", "k_name")
        named = fresh.join(todo.select(self.key, "name", PART), self.key)
        return kept.unionByName(named)

    def run(self, todo: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Bring results and state up to date with *todo* (``plan``, written or cheap to work out); gives the touched parts."""
        spark = todo.sparkSession
        touched = [r[0] for r in todo.select(PART).distinct().orderBy(PART).collect()]  # at most as many as there are parts
        if not touched:
            return []
        self._overwrite(self.merged(todo, touched, compute(self.stale(todo, touched))), self.results, touched)
        there = self.load(spark, self.results, touched).select(self.key).distinct().withColumn("k_there", F.lit(True))
        done = todo.where("action <> 'remove'").join(there, self.key, "left")
        status = F.when(F.col("k_there"), "succeeded").otherwise("failed")
        old = self.load(spark, self.state, touched).join(todo.select(self.key), self.key, "left_anti")
        self._overwrite(old.unionByName(done.select(self.key, "full_hash", "analysis_hash", status.alias("status"), PART)), self.state, touched)
        return touched

    @staticmethod
    def _overwrite(df: DataFrame, path: str, touched: Sequence[int]) -> None:
        """The touched parts anew.  Spark moves them into place when all tasks are done, so they may be read meanwhile; a part
        that has no rows any more isn't among those it moves: its folder, whose files are the old ones, is deleted."""
        spark = df.sparkSession
        folders = {p: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{PART}={p}") for p in touched}
        system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        files = lambda p: {f.getPath().getName() for f in system.listStatus(folders[p])} if system.exists(folders[p]) else set()
        before = {p: files(p) for p in touched}
        df.hint("rebalance", PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
        for p, old in before.items():
            if old and files(p) == old:
                system.delete(folders[p], True)
