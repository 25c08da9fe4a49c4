"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers, floor(scale * x), and dealt into blocks of rows.  A block's index holds
each attribute as bit slices (one bitmap over the rows for every binary digit above the block's least value).
A query's score is a sum of shifted slices: each signed binary digit of a query component adds the
attribute's slices, or their complements for a negative digit, and full adders on whole bitmaps bring every
weight down to one bitmap.  The top rows are then taken from the most significant slice downward; rows that
still tie at the boundary are resolved exactly, by the smaller id.  A block goes to its task once (to a few tasks
where there are fewer blocks than tasks), and the query groups stream past it there; each pair of a query and a
block hands on k rows, which a window cuts to k.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; a vector is only compared
with queries of its own length; rows with a null id take no part; rows that repeat an id are each a candidate, and
lie in any blocks, but an id asks once, with its least vector; a component of 2**62 or more after scaling, or a query
whose scores could leave a long, ends the job with an error that says so; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BLOCK_ROWS = 8192
QUERY_GROUP = 128
_MOST = 2.0**62
_INDEX = T.StructType(
    [T.StructField("dim", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("least", T.BinaryType()), T.StructField("width", T.BinaryType()), T.StructField("slices", T.BinaryType())]
)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id long, v array<long>, dim int) of the vectors that take part."""
    v = F.col(vec_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: x.cast("double") * scale)
    ints = F.transform(scaled, lambda y: F.when(F.abs(y) < _MOST, F.floor(y)).otherwise(F.raise_error(F.lit("a vector component of 2**62 or more after scaling")).cast("long")))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"), F.size(v).alias("dim"))


class BlockIndex:
    """Bit slices of a block of integer vectors, with the addition and selection on them."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, width: np.ndarray, slices: np.ndarray):
        self.ids, self.least, self.width, self.n = ids, least, width, len(ids)
        self.slices = slices
        full = np.zeros(slices.shape[1] * 64, np.uint8)
        full[: self.n] = 1
        self.valid = np.packbits(full, bitorder="little").view(np.uint64)
        self.both = np.concatenate([slices, ~slices])
        self.first = np.concatenate([[0], np.cumsum(width)])
        self.reach = np.maximum(np.abs(least.astype(np.float64)), np.abs(least.astype(np.float64) + 2.0**width))

    @classmethod
    def build(cls, ids: np.ndarray, values: np.ndarray) -> BlockIndex:
        """*values*: (rows, attributes) of integers; rows are kept in the order of their ids."""
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        least = values.min(axis=0)
        above = values - least
        width = np.array([int(x).bit_length() for x in above.max(axis=0)], np.int64)
        words = -(-len(ids) // 64)
        bits = np.zeros((int(width.sum()), words * 64), np.uint8)
        at = 0
        for j, w in enumerate(width.tolist()):
            for b in range(w):
                bits[at, : len(ids)] = (above[:, j] >> b) & 1
                at += 1
        return cls(ids, least, width, np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(len(bits), words))

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of the binary digits (lowest first) of every row's score, less the returned constant."""
        if float(np.dot(np.abs(query.astype(np.float64)), self.reach)) >= 2.0**63:
            raise OverflowError("a query's scores may not fit into a long")
        constant, columns, n = sum(a * b for a, b in zip(query.tolist(), self.least.tolist(), strict=True)), {}, len(self.slices)
        for j in np.flatnonzero(query).tolist():
            q, t, w = int(query[j]), 0, int(self.width[j])
            while q and w:
                if q & 1:
                    digit = 2 - (q & 3)  # signed digits, so that fewer are not zero
                    q -= digit
                    for b in range(w):
                        columns.setdefault(t + b, []).append(int(self.first[j]) + b + (n if digit < 0 else 0))
                    if digit < 0:  # the complement counts 2**w - 1 too much
                        constant -= ((1 << w) - 1) << t
                q >>= 1
                t += 1
        digits, carried, weight = [], [], 0
        while weight <= max(columns, default=-1) or carried:
            x = self.both[columns.get(weight, [])] if weight in columns else self.slices[:0]
            if carried:
                x = np.concatenate([x, *carried])
            carried = []
            while len(x) > 2:
                m = len(x) // 3
                a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
                ab = a ^ b
                carried.append((a & b) | (c & ab))
                x = np.concatenate([ab ^ c, x[3 * m :]])
            if len(x) == 2:
                carried.append(x[:1] & x[1:])
                x = x[:1] ^ x[1:]
            digits.append(x[0] if len(x) else np.zeros_like(self.valid))
            weight += 1
        return digits, constant

    def top(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k highest scores, ties to smaller ids; rows of the id *own* are left out."""
        digits, constant = self.sums(query)
        open_, taken = self.valid, np.zeros_like(self.valid)
        lo, hi = (np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right")) if own is not None else (0, 0)
        if lo < hi:
            open_ = open_.copy()
            for i in range(lo, hi):
                open_[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        have = 0
        for s in reversed(digits):
            part = open_ & s
            n = have + int(np.bitwise_count(part).sum())
            if n > k:
                open_ = part
            else:
                taken, have, open_ = taken | part, n, open_ & ~s
            if have == k:
                break
        rows = np.flatnonzero(np.unpackbits(taken.view(np.uint8), bitorder="little"))
        if have < k:  # all rows still open tie; they lie in the order of their ids
            rows = np.concatenate([rows, np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))[: k - have]])
        # Sums are taken modulo 2**64, as the complements may go beyond a long on the way.
        scores = np.full(len(rows), (constant + 2**63) % 2**64 - 2**63, np.int64)
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        for w, s in enumerate(digits[:64]):
            scores += ((s[word] >> bit) & np.uint64(1)).astype(np.int64) << w
        return self.ids[rows], scores


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    ids = table.column("id").to_numpy()
    values = table.column("v").combine_chunks()
    values = values.flatten().to_numpy().reshape(len(ids), key[0].as_py()) if key[0].as_py() else np.zeros((len(ids), 0), np.int64)
    x = BlockIndex.build(ids, values)
    cells = [x.ids.astype(np.int64), x.least.astype(np.int64), x.width.astype(np.int64), x.slices]
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), **{k: pa.array([c.tobytes()], pa.binary()) for k, c in zip(("ids", "least", "width", "slices"), cells, strict=True)}})


def index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """The bit-sliced index of ``quantised`` rows, one row a block, and the number of blocks.  Rows are dealt out by their
    place in the input, so that rows of one id or one vector spread as all others."""
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(_build, _INDEX), blocks


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by dim, block and lane, a block's index before the query groups that it meets."""
        key, x = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda c: batch.column(c)[r]  # noqa: B023, E731
                here = tuple(cell(c).as_py() for c in ("dim", "block", "lane"))
                if not cell("queries").is_valid:
                    ids, least, width, slices = (np.frombuffer(cell(c).as_buffer(), t) for c, t in (("ids", np.int64), ("least", np.int64), ("width", np.int64), ("slices", np.uint64)))
                    key, x = here, BlockIndex(ids, least, width, slices.reshape(int(width.sum()), -(-len(ids) // 64)))
                    continue
                if here != key:  # no vector of this length lies in the block
                    continue
                asked = cell("queries").values
                vectors = asked.field("v")
                out = []
                for i, q in enumerate(asked.field("id").to_pylist()):
                    got, scores = x.top(vectors[i].values.to_numpy(zero_copy_only=False).astype(np.int64), k, q)
                    out.append((np.full(len(got), q, np.int64), got, scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_group: int = QUERY_GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of *vectors* where *is_query*, its k best other rows."""
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vec_col, scale)
    asked = quantised(vectors.where(is_query), id_col, vec_col, scale).groupBy("dim", "id").agg(F.min("v").alias("v"))
    groups = max(1, -(-asked.count() // query_group))
    blocks_df, blocks = index(rows, block_rows)
    # A block is one row; only where blocks are fewer than tasks it goes to several lanes, each with its share of the groups.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lanes = min(groups, max(1, -(-2 * parts // blocks)))
    packed = asked.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group")).agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    none = [F.lit(None).cast("binary").alias(c) for c in ("ids", "least", "width", "slices")]
    left = packed.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), (F.col("group") % lanes).alias("lane"), *none, "queries")
    right = blocks_df.select("dim", "block", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "ids", "least", "width", "slices", F.lit(None).cast(left.schema["queries"].dataType).alias("queries"))
    met = right.unionByName(left).repartition(max(parts, min(blocks * lanes, 100_000)), "dim", "block", "lane")
    found = met.sortWithinPartitions("dim", "block", "lane", F.col("queries").isNotNull()).mapInArrow(_search(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
