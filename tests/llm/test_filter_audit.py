"""The filter audit against plain counting."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from panelyard.llm import filter_audit


def fails(docs, i):
    text = docs[i][1] or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    out = {"A"} if len(words) < 200 else set()
    out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
    out |= {"D"} if re.search("[#$%&*|]", text) else set()
    mine = 2**63 - 1 if docs[i][0] is None else docs[i][0]
    return out | ({"E"} if any((d[1] or "") == text and d[0] is not None and d[0] < mine for d in docs) else set())


def brute(docs, labels):
    quality, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    rows = [(d[2] or "", fails(docs, k), d[0] in quality, d[0] in toxic) for k, d in enumerate(docs)]
    out = {}
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for k, f in enumerate(order):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, order, k + 1] = [len(left), len(here), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in rows if r[0] == part), sum(r[2] for r in here), sum(r[3] for r in here)]
                gone += here
                shapley[f] += len(here)
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as mask", "2 as k_id", "3 as a")
    counts = filter_audit.mask_counts(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = filter_audit.audit(counts).collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}


@pytest.fixture()
def mixed(prose):
    rng = random.Random(11)
    base = [prose(rng.choice((5, 60, 230, 300))) for _ in range(40)]
    base += [b.upper() for b in base[:5]] + ["a b " * 150, "Ä # x", "", None, " ", prose(30_000)]
    texts = [rng.choice((x, x, x + " $" if x else x)) for x in rng.choices(base, k=160)]
    docs = [(k, t, rng.choice(("en", "de", None, ""))) for k, t in enumerate(texts)]
    docs += [docs[3], docs[4], (7, "seven again", "en"), (None, texts[9], "en"), (None, texts[9], "en")]
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1))) for k in range(0, 160, 2)]
    return docs, labels


def test_audit_equals_counting(spark, mixed):
    assert audited(spark, *mixed) == brute(*mixed)


def test_a_full_sketch_changes_nothing(spark, mixed, monkeypatch):
    monkeypatch.setattr(filter_audit, "_positions", lambda a, b, counters: ((a * 0).astype("int64"), (b % 2).astype("int64")[:, None]))
    assert audited(spark, *mixed) == brute(*mixed)


def test_texts_of_one_digest(spark, mixed, monkeypatch):
    halves = filter_audit._digests
    monkeypatch.setattr(filter_audit, "_digests", lambda rows: tuple(x % 7 for x in halves(rows)))
    assert audited(spark, *mixed) == brute(*mixed)


def test_sketch_clears_unique_texts(spark, prose):
    docs = spark.createDataFrame([(k, prose(30)) for k in range(3000)] + [(9000, "twice"), (9001, "twice")], "doc_id long, text string")
    rows = filter_audit.judged(docs.selectExpr("*", "'' as lang"), "lang").cache()
    counters = 1 << 16
    found = filter_audit.possible_repeats(docs, filter_audit.sketch(rows, counters), counters).collect()
    assert {9000, 9001} <= {r.k_id for r in found} and len(found) < 100


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, "x", "en")], []) == brute([(1, "x", "en")], [])
