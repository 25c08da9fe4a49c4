"""What five document filters remove together, apart and in every order.

Four filters judge a text alone; the fifth, E, fails a text that a smaller doc_id has too.  For E a counting Bloom sketch
comes first: every task counts the positions that its texts' hashes set, the counts (one or more than one matters, so they
stop at two) are merged by segments of the sketch, and a text is guaranteed unique if one of its positions was counted
once.  Only the other texts travel, and the smallest id of each is found among whole texts, so a false alarm of the sketch
costs a shuffled row, never a wrong flag.  Ids of failing rows come back by 128-bit digests (by whole texts where two
texts share one) and meet the other flags as one number, a mask.  Counts of rows by part, mask and labels are additive and
small; what every order of the filters keeps and removes is worked out from them alone.

The sketch takes about SKETCH_ROOM counters for each row, at most MAX_COUNTERS; as a bit each it is broadcast, 128 MB at
most.  With more rows than that its bits fill, and more texts travel; the result is the same.

Defined cases: null is an empty text (and equal to other empty texts); rows of one id aren't duplicates of each other; a
null id comes after all others; labels of an id that comes twice count as 1 if one of them is; null labels count as 0; null
parts are the empty part; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

FILTERS = "ABCDE"
#: Counters for each row, counters of a segment, and the most counters of a sketch (their bits are broadcast).
SKETCH_ROOM, SEGMENT, MAX_COUNTERS = 16, 1 << 16, 1 << 30
PROBES = 4
_UPPER, _SIGNS = bytes(range(0x41, 0x5B)), b"#$%&*|"
_LATER = bytes(range(0x80, 0xC0))  # bytes of a code point after its first


def failures(text: bytes, least_words: int = 200, distinct_percent: int = 50, upper_percent: int = 3, signs: bytes = _SIGNS) -> int:
    """The mask of the filters A (few words), B (few different words), C (many capitals) and D (signs) that a text fails."""
    words = text.split()
    points = len(text.translate(None, _LATER))
    capitals = len(text) - len(text.translate(None, _UPPER))
    return (len(words) < least_words) | (100 * len(set(words)) < distinct_percent * len(words)) << 1 | (100 * capitals > upper_percent * points) << 2 | (len(text) != len(text.translate(None, signs))) << 3


def _digests(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of each text's 128-bit hash."""
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in rows), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _positions(a: np.ndarray, b: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, places): a text's counters, all in one segment."""
    segment = (a >> np.uint64(20)) % np.uint64(counters // SEGMENT)
    step = C.mix(b)[:, None] >> (np.arange(PROBES, dtype=np.uint64) * np.uint64(16))
    return segment.astype(np.int64), (step % np.uint64(SEGMENT)).astype(np.int64)


def judged(docs: DataFrame, part: str) -> DataFrame:
    """(k_id, part, mask, a, b) of every row: its filters' mask without E, and its text's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches):
            rows = C.texts(batch)
            a, b = _digests(rows)
            yield pa.RecordBatch.from_arrays([batch.column("k_id"), batch.column("part"), pa.array([failures(x) for x in rows], pa.int32()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["k_id", "part", "mask", "a", "b"])

    return docs.select(C.row_key()[0], F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text").mapInArrow(run, "k_id long, part string, mask int, a long, b long")


def sketch(rows: DataFrame, counters: int) -> dict[int, bytes]:
    """Of each segment in use, the bits of its counters of two or more, from *rows* (a, b)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's positions by segment, each as often as it was counted, but not over twice."""

        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            at = np.sort(np.concatenate(held))
            twice = np.ones(len(at), bool)
            twice[2:] = at[2:] != at[:-2]
            at = at[twice]
            segment = at // SEGMENT
            new = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            places = (at % SEGMENT).astype(np.uint16)
            return pa.RecordBatch.from_arrays([pa.array(segment[new]), pa.array([places[lo:hi].tobytes() for lo, hi in zip(new, np.append(new[1:], len(at)), strict=True)], pa.binary())], names=["segment", "places"])

        held, size = [], 0
        for batch in batches:
            segment, places = _positions(*(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("a", "b")), counters)
            places = np.sort(places, axis=1)
            once = np.ones(places.shape, bool)  # a text counts once at each of its places
            once[:, 1:] = places[:, 1:] != places[:, :-1]
            held.append((segment[:, None] * SEGMENT + places)[once])
            size += len(held[-1])
            if size > 1 << 22:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments come sorted; the counts of one are added up."""
        now, counts = None, np.zeros(SEGMENT, np.uint8)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(counts >= 2).tobytes()], pa.binary())], names=["segment", "bits"])
        for batch in batches:
            for segment, places in zip(batch.column("segment").to_pylist(), batch.column("places").to_pylist(), strict=True):
                if segment != now:
                    if now is not None:
                        yield done()
                    now, counts = segment, np.zeros(SEGMENT, np.uint8)
                counts = np.minimum(2, counts + np.bincount(np.frombuffer(places, np.uint16), minlength=SEGMENT).clip(max=2)).astype(np.uint8)
        if now is not None:
            yield done()

    merged = rows.select("a", "b").mapInArrow(count, "segment long, places binary").repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment long, bits binary")
    return {r.segment: bytes(r.bits) for r in merged.toLocalIterator()}


def possible_repeats(docs: DataFrame, bits: dict[int, bytes], counters: int) -> DataFrame:
    """(k_id, a, b, text): the rows of *docs* that the sketch doesn't clear."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches):
            rows = C.texts(batch)
            a, b = _digests(rows)
            segment, places = _positions(a, b, counters)
            keep = np.zeros(len(rows), bool)
            for s in np.unique(segment).tolist():
                full, mine = np.frombuffer(sent.value.get(s, bytes(SEGMENT // 8)), np.uint8), np.flatnonzero(segment == s)
                at = places[mine]
                keep[mine] = ((full[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
            if keep.any():
                k = np.flatnonzero(keep)
                yield pa.RecordBatch.from_arrays([batch.column("k_id").take(pa.array(k)), pa.array(a[k].view(np.int64)), pa.array(b[k].view(np.int64)), pa.array([rows[i] for i in k.tolist()], pa.binary())], names=["k_id", "a", "b", "text"])

    return docs.select(C.row_key()[0], "text").mapInArrow(run, "k_id long, a long, b long, text binary")


def with_repeats(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """*rows* (``judged``, written) with E's bit set in the masks of ids whose text a smaller id has, too."""
    n = rows.count()
    counters = SEGMENT * max(1, min(MAX_COUNTERS, SKETCH_ROOM * n) // SEGMENT)
    found = possible_repeats(docs, sketch(rows, counters), counters)
    # Whole texts are told apart here; copies are combined within the tasks that read them.
    groups = found.groupBy("a", "b", "text").agg(F.min("k_id").alias("first"), F.max("k_id").alias("last"))
    digests = C.materialize(groups.groupBy("a", "b").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.max("last").alias("last")))
    alone = digests.where("texts = 1 and first < last").select("a", "b", "first")
    out = rows.join(alone, ["a", "b"], "left").withColumn("again", F.coalesce(F.col("k_id") > F.col("first"), F.lit(False)))
    shared = digests.where("texts > 1").select("a", "b")
    if not shared.isEmpty():  # two texts of one digest: their ids by the texts themselves
        hit = found.join(shared, ["a", "b"], "left_semi")
        later = hit.join(hit.groupBy("a", "b", "text").agg(F.min("k_id").alias("least")), ["a", "b", "text"]).where("k_id > least")
        out = out.join(later.select("k_id", "a", "b", F.lit(True).alias("too")).distinct(), ["k_id", "a", "b"], "left").withColumn("again", F.col("again") | F.coalesce("too", F.lit(False)))
    return out.select("k_id", "part", F.when(F.col("again"), F.col("mask").bitwiseOR(16)).otherwise(F.col("mask")).alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): how many rows of each part fail exactly the filters of a mask (A is 1, E is 16), and
    how many of these are labelled so."""
    rows = C.materialize(judged(docs, part))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("k_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    flagged = with_repeats(docs, rows).join(known, "k_id", "left")
    return flagged.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from ``mask_counts``: what the step keeps and removes, what it
    would fail that is gone already, what it alone fails, labelled losses, and its removals over all orders."""
    steps = [("".join(o), k + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(x) for x in o[:k])) for o in permutations(FILTERS) for k, f in enumerate(o)]
    schema = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), T.StructField("own", T.IntegerType()), T.StructField("before", T.IntegerType())])
    table = counts.sparkSession.createDataFrame([(k, *s) for k, s in enumerate(steps)], schema)
    every = counts.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1)))).join(F.broadcast(table), "at")
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    here = fails & ~gone
    # In a share of 1 / k of all orders a filter is the first of the k that a row fails.
    first = sum(1 for s in steps if s[1] == 1) / F.greatest(F.bit_count("mask"), F.lit(1))
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    return every.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(here).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * first.cast("long")).otherwise(0)).cast("long").alias("shapley"),
    )
