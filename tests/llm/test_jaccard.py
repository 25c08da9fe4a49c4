"""The exact similarity join against all pairs."""

import random

import numpy as np
import pytest

from panelyard.llm import jaccard


def shingles(text, size=3):
    words = (text or "").translate({k: k + 32 for k in range(65, 91)}).split()
    return {" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), 2**63), ids[k])
    real = lambda i: None if i == 2**63 - 1 else i
    return sorted(((i, len(s), real(least[find(k)])) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def joined(spark, rows, percent=90, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as a", "3 as sid")
    return sorted(((r.k_id if r.k_id < 2**63 - 1 else None, r.n, r.least if r.least < 2**63 - 1 else None) for r in jaccard.similar_sets(docs, 3, percent, **more).collect()), key=str)


@pytest.fixture()
def rows(prose):
    rng = random.Random(5)
    out = []
    for length in (1, 2, 3, 8, 11, 12, 13, 20, 21, 40, 41, 90, 300):
        for _ in range(3):
            words = prose(length).split()
            out.append(" ".join(words))
            for _ in range(6):  # chains of small changes: words replaced, added, lost
                words = list(words)
                for _ in range(rng.choice((1, 1, max(1, length // 60)))):
                    k = rng.randrange(len(words))
                    words[k : k + rng.randint(0, 1)] = ["new%d" % rng.randrange(10**6)] * rng.randint(0, 1) or words[k : k + 1]
                out.append(" ".join(words).upper() if rng.random() < 0.2 else "  ".join(words))
    shared = prose(60)  # a passage that many texts hold
    out += [shared + " " + prose(rng.choice((2, 4, 7, 30))) for _ in range(40)]
    texts = [*out, None, "", " \n", "é ü ß", "É ü ß", prose(30_000)]
    pairs = [(k, t) for k, t in enumerate(texts)]
    return pairs + [pairs[0], pairs[0], (2, "another text of the same id"), (None, out[5]), (None, "alone without an id")]


def test_components_equal_all_pairs(spark, rows):
    assert joined(spark, rows) == brute(rows)


def test_dealt_out_groups_and_other_similarity(spark, rows):
    assert joined(spark, rows, 75, key_rows=2) == brute(rows, 75)


def test_allocation_loses_nothing(spark, rows, monkeypatch):
    """Signatures cost nothing here, so every segment that makes pairs is answered for by another one."""
    seen = []
    real = jaccard._allocation
    monkeypatch.setattr(jaccard, "SIGNATURE_COST", 0)
    monkeypatch.setattr(jaccard, "_allocation", lambda *a: seen.append(real(*a)) or seen[-1])
    assert joined(spark, rows) == brute(rows)
    assert any(seen[0][0].values())


def test_bands_hold_every_similar_pair():
    for percent in (50, 80, 90, 99):
        lows, slack = jaccard.bands(400, percent)
        for s in range(1, 401):
            for t in range(s, min(400, s * 100 // percent) + 1):
                a, b = np.searchsorted(lows, [s, t], "right") - 1
                both = -(-percent * (s + t) // (100 + percent))  # least intersection
                assert b - a in (0, 1) and s + t - 2 * both <= slack[b]


def test_allocate_keeps_the_sum():
    dropped, twice = jaccard.allocate({0: 1e9, 1: 5.0, 3: 1e8}, sets=1000, tokens=10_000, segments=6)
    assert dropped == [0, 3] and len(set(twice)) == 2 and not set(twice) & set(dropped)
    assert jaccard.allocate({0: 5.0}, sets=1000, tokens=10_000, segments=2) == ([], [])


def test_empty_table(spark):
    assert joined(spark, []) == [] and joined(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]
