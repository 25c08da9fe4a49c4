"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that a worker handles at once (Spark bounds a batch's bytes).
ARROW_ROWS = 1000
#: Bytes of text that a numpy kernel handles at once, so that its arrays stay in the cache (a longer text is one chunk).
CHUNK_BYTES = 1 << 17
#: Rows under one id from which on rows that repeat are taken together before they meet in a task.
REPEATED = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table *name* of a data folder, as Spark reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settings(spark: SparkSession) -> None:
    """What an application with long texts sets for its session, as the registered queries and the pipeline do; the
    operators themselves leave the session alone.  A Python worker holds a few batches of so many rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what a worker makes of them stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where that is unset a local session gets a folder of its own; on a cluster
    it must be set, as no machine's own folder is seen by the others."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        path = spark.sparkContext.getCheckpointDir()
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write *df* as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Key of a document row: its id (null comes last) and its text's hash, so that
    rows that share an id but not a text stay apart, and exact repeats of a row act as one."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("k_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k_hash")]


def collapsed(docs: DataFrame) -> DataFrame:
    """(k_id, k_hash, text, n, hot) of *docs* (doc_id, text): rows of an id with more than REPEATED rows come once for each
    text, with their number n, so that no task gets a pile of equal rows; all others as they are, with n = 1."""
    keyed = docs.select(*row_key(), "text")
    ids = materialize(docs.select(row_key()[0]).groupBy("k_id").count().where(F.col("count") > REPEATED).select("k_id"))
    cold = lambda d: d.select("k_id", "k_hash", "text", F.lit(1).cast("long").alias("n"), F.lit(False).alias("hot"))
    if ids.isEmpty():
        return cold(keyed)
    hot = keyed.join(ids, "k_id", "left_semi").groupBy("k_id", "k_hash").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    return cold(keyed.join(ids, "k_id", "left_anti")).unionByName(hot.withColumn("hot", F.lit(True)))


def block_bytes(size: int, least: int, most: int) -> int:
    """Bytes of a block for *size* bytes of text: every block writes to every bucket, so both grow with the root of the
    input, which keeps what one of them sends to another at a kilobyte or so, from *least* up to what a task can hold."""
    return max(least, min(most, math.isqrt(1000 * size)))


def boxed(docs: DataFrame, *more: Column | str) -> DataFrame:
    """All columns of *docs* in one struct ``row``, and beside it only *more*: no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def unboxed(df: DataFrame, columns: list[str], **new: Column | str) -> DataFrame:
    """The columns of ``row`` again; those named in *new* are replaced, or come last if they weren't there."""
    put = {k: F.col(v) if isinstance(v, str) else v for k, v in new.items()}
    old = [(put[c] if c in put else F.col("row")[c]).alias(c) for c in columns]
    return df.select(*old, *[v.alias(k) for k, v in put.items() if k not in columns])


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after the last, bytes, offsets) over a batch's UTF-8 texts (null: empty).

    A chunk holds at most *limit* bytes, or one longer text.  Offsets count from the chunk's start.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A batch's texts as bytes, null as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]


# --- words of a chunk of bytes ------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 2**64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        made = []
        for base in (_P, _INV):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            made.append(p)
        if n > 32 * CHUNK_BYTES:  # a very long text; its tables aren't kept
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_table() -> np.ndarray:
    """For each byte its value in a word, lower-cased in A-Z, plus one; 0 if it ends words.

    Words are runs of ASCII letters and digits and of any code point from U+0080 on, and in
    UTF-8 the bytes of such a code point are exactly those from 0x80 on.
    """
    t = np.zeros(256, np.uint64)
    for b in [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        t[b] = (b + 32 if 0x41 <= b <= 0x5A else b) + 1
    return t


WORD_VALUE = word_table()
IS_WORD = WORD_VALUE > 0


def word_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of all words of a chunk, and the chunk row of each; words don't cross texts."""
    inside = IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word that begins at *starts*."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.add.reduceat(WORD_VALUE[data] * up[: len(data)], starts)
    return mix(sums * down[starts])


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive word hashes (of those that cross texts, too: mask them by row)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    have, size, acc, scale, step, done, left = words, 1, None, 1, 0xD6E8FEB86659FD93, 0, n
    while left:
        if left & 1:  # the next *size* words behind the *done* that acc has
            part = have[done : done + len(words) - n + 1] * np.uint64(scale)
            acc, done, scale = part if acc is None else acc + part, done + size, scale * step % 2**64
        left >>= 1
        if left:
            have, step, size = have[:-size] + have[size:] * np.uint64(step), step * step % 2**64, 2 * size
    return mix(acc)


def lists(offsets: Iterable[int], values: pa.Array) -> pa.ListArray:
    """A list column from its offsets and flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
