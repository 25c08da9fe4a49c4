import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm import bitslice

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in sorted(ok, key=lambda r: (r[0], r[1]), reverse=True) if i % 20 == 0}.items():
        scored = sorted(((-sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(a)))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("block", F.lit("x"))
    return {tuple(r) for r in bitslice.top_k(df, F.col("vec_id") % 20 == 0, **more).collect()}


def test_against_brute_force_with_ties(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)] + [(400, [0.0] * 16)]
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, rows, block_rows=70, query_group=3) == brute(rows, 20)


def test_nulls_other_lengths_and_few_rows(spark):
    rows = [(0, [1.0, -1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [-0.5, 0.01]), (6, [0.1]), (None, [1.0, 1.0]), (20, [0.3, 0.3]), (40, []), (41, [])]
    assert run(spark, rows) == brute(rows, 20)


def test_repeated_ids(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [0.5]), (1, [0.5])]
    assert run(spark, rows) == {(0, 1, 1, 64 * 32), (0, 2, 1, 64 * 32)}


def test_empty(spark):
    assert run(spark, []) == set()


def test_wide_components_and_sums_beyond_a_long(spark):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * 2.0 ** rng.randint(0, 22))) for _ in range(5)]) for i in range(200)]
    assert run(spark, rows, block_rows=64) == brute(rows, 20)
    for bad in ([(0, [1e8] * 9), (1, [1e8] * 9)], [(0, [1.0]), (1, [1e20])]):
        with pytest.raises(Exception, match="long|2\\*\\*62"):
            run(spark, bad)


def test_one_hot_id(spark):
    df = spark.range(100_000).selectExpr("case when id % 3 = 0 then 40 else id + 41 end vec_id", "array(cast(1.0 as float)) embedding", "0 label")
    got = bitslice.top_k(df, F.col("vec_id") == 40, k=3).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(40, k + 1, v, 4096) for k, v in enumerate((42, 43, 45))]
