"""Periodic runs against brute force."""

import hashlib
import os
import random
import zlib

import pytest

from panelyard.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def brute(words, shortest=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def cases():
    rng = random.Random(3)
    for _ in range(1500):
        yield [rng.choice("ab" if rng.random() < 0.6 else "abc") for _ in range(rng.randint(0, 60))]
    for _ in range(1000):  # repeats of repeats with other words between
        x = [rng.choice("abc") for _ in range(rng.randint(1, 5))]
        for _ in range(rng.randint(1, 4)):
            m = rng.randint(1, 4)
            x = [rng.choice("abc") for _ in range(rng.randint(0, 3))] * rng.randint(0, 1) + (x * m)[: rng.randint(1, len(x) * m)] + [rng.choice("abc")] * rng.randint(0, 1)
            x = x * rng.choice((1, 1, 2))
        yield x[:150]
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    yield list(b)
    yield ["w"] * 3000  # one long run


@pytest.mark.parametrize("shortest", [2, 12])
def test_runs_equal_brute_force(shortest):
    texts = list(cases())
    for words, (runs, left) in zip(texts, periodic.runs_of_texts([" ".join(w).encode() for w in texts], shortest), strict=True):
        want = brute(words, shortest)
        assert sorted(runs) == want and runs == sorted(runs, key=lambda r: (r[0], r[2])) and left.decode() == collapsed(words, want)


def test_defined_cases(spark, prose):
    long = "x\ty  " * 30_000 + prose(2000)
    rows = [(1, None, "k"), (2, "", "k"), (3, " \n ", "k"), (4, "a b " * 6, "k"), (4, "a b " * 6, "k"), (None, "é " * 12, "k"), (5, long, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumnRenamed("runs", "k_id").selectExpr("*", "1 as runs", "2 as n")
    out = periodic.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "k_id", "n", "runs", "collapsed"]
    got = sorted(((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed[:3]) for r in out.collect()), key=str)
    assert got == sorted([(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 12, 2)], "a b"), (4, [(0, 12, 2)], "a b"), (0, [(0, 12, 1)], "é"), (5, [(0, 60_000, 2)], "x y")], key=str)
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want = {}
    for i, text in texts.items():
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute(words)
        best = min(((-m, a, q) for a, m, q in runs), default=None)
        longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        lines = "".join(f"{a},{m},{q}\n" for a, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
        want[i] = (len(runs), *longest, sha(lines), sha(collapsed(words, runs)))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert got == want and any(w[0] for w in want.values())
