"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Each window of three consecutive lines is hashed (two 64-bit hashes: 128 bits); windows that occur again
anywhere in the corpus are found by one aggregation with map-side combining; every occurrence but the first
(smallest doc_id, then smallest line number) marks its three lines, marks that overlap merge, and the marked
lines go.  A window that a third of all documents share costs each task one row in the aggregation; in the
join back, its many positions are the side that adaptive execution splits.

Defined cases: lines are split at "\\n" and compared with outer blanks trimmed; windows whose three lines are
all blank are not counted; texts of fewer than three lines stay as they are; null texts stay null; rows that
share an id but not a text are told apart by the text's hash; rows that repeat id and text act as one, so
neither loses lines to the other; a null id sorts after all others.  Further columns pass through, but one
named like a result (``n_lines``, ``n_removed``) is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C


def _line_hashes(text: Column) -> Column:
    """Each line's two hashes, and whether it is blank."""
    trimmed = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x))
    return F.transform(trimmed, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"), (x == "").alias("blank")))


def _windows(hashes: Column, size: int) -> Column:
    """array<struct<a, b>>: the hashes of every window, null for a window of blank lines.

    Shifted copies of the lines' hashes are zipped, so no lambda looks into the whole array.
    """
    shifted = F.arrays_zip(*[F.slice(hashes, F.lit(j + 1), F.size(hashes) - (size - 1)) for j in range(size)])
    lines = [str(j) for j in range(size)]
    every_blank = lambda z: F.least(*[z[j]["blank"] for j in lines])
    return F.transform(shifted, lambda z: F.when(~every_blank(z), F.struct(F.xxhash64(*[z[j]["a"] for j in lines]).alias("a"), F.xxhash64(*[z[j]["b"] for j in lines]).alias("b"))))


def covered_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """(k_id, k_hash, covered array<int>): lines, from 0, of each document that lie in a later occurrence."""
    hashed = docs.where(F.col("text").isNotNull()).select(*C.row_key(), _line_hashes(F.col("text")).alias("hashes")).where(F.size("hashes") >= size)
    at = hashed.select("k_id", "k_hash", F.posexplode(_windows(F.col("hashes"), size)).alias("line", "w")).where("w is not null").select("k_id", "k_hash", "line", "w.a", "w.b")
    repeated = at.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("k_id", "line", "k_hash")).alias("first")).where("n > 1").select("a", "b", "first")
    later = at.join(repeated, ["a", "b"]).where(F.struct("k_id", "line", "k_hash") > F.col("first"))
    return later.groupBy("k_id", "k_hash").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("line"), F.col("line") + size - 1)))).alias("covered"))


def dedup_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """*docs* with repeated passages of *size* or more lines taken out of ``text``, and ``n_lines``, ``n_removed`` added."""
    # The text travels once, inside the row.
    text = F.col("row")["text"]
    keyed = C.boxed(docs, *C.row_key()).join(covered_lines(docs, size), ["k_id", "k_hash"], "left").withColumn("k_lines", F.split(text, "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("k_lines") - 1), F.col("covered"))
    kept = F.array_join(F.transform(left, lambda i: F.get("k_lines", i)), "\n")
    return C.unboxed(
        keyed,
        docs.columns,
        text=F.when(F.col("covered").isNull(), text).otherwise(kept),
        n_lines=F.when(text.isNull(), F.lit(0)).otherwise(F.size("k_lines")).cast("long"),
        n_removed=F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long"),
    )
