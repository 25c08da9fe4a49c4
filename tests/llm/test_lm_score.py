import math
from collections import Counter

import pytest
from pyspark.sql import functions as F


from panelyard.llm import lm_score
from tests.llm.test_decontaminate import words

LABELS = "doc_id long, quality int, toxic int"
TARGET = "quality = 1 and toxic = 0"


def brute(docs, targets, mu=lm_score.MU):
    counts = {}
    for name, part in (("t", [t for i, t in docs if i in targets]), ("b", [t for _, t in docs])):
        uni, bi = Counter(), Counter()
        for t in part:
            ws = words(t)
            if ws:
                ws = ["<s>", *ws]
                uni.update(ws)
                bi.update(zip(ws, ws[1:], strict=False))
        counts[name] = uni, bi, sum(n for w, n in uni.items() if w != "<s>")
    v = len([w for w in counts["b"][0] if w != "<s>"])
    out = []
    for i, t in docs:
        ws = words(t)
        ce = []
        for uni, bi, size in counts.values():
            seq = ["<s>", *ws]
            ce.append(sum(-math.log((bi[h, w] + mu * (uni[w] + 1) / (size + v)) / (uni[h] + mu)) for h, w in zip(seq, ws, strict=False)) / max(1, len(ws)))
        out.append((i, len(ws), *((ce[0], ce[1], ce[0] - ce[1]) if ws else (None, None, None))))
    return out


def test_against_brute_force(spark, docs_of, prose):
    docs = [(i, prose(prose.rng.randint(1, 80)) + (" good words are here" if i % 3 else " bad things")) for i in range(1, 60)]
    docs += [(60, None), (61, ""), (62, "One"), (63, "the the the"), (5, docs[4][1]), (None, "null id words"), (64, "Été été x")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(1, 50)] + [(None, 1, 0), (3, None, None), (62, 1, None), (4, 1, 0)], LABELS)
    targets = {i for i in range(1, 50) if i % 3 and i % 7}
    rows = lm_score.score(docs_of(docs).withColumnRenamed("lang", "mark").withColumnRenamed("source", "block"), labels, F.expr(TARGET)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got, want = sorted(map(tuple, rows), key=key), sorted(brute(docs, targets), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[2:] == (pytest.approx(b[2:], rel=1e-9, abs=1e-9) if b[2] is not None else (None, None, None))


def test_target_like_texts_score_lower(spark, docs_of, prose):
    docs = [(i, " ".join(prose.rng.choices(("alpha beta gamma delta" if i % 2 else "one two three four").split(), k=40))) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], LABELS)
    rows = {r.doc_id: r.score for r in lm_score.score(docs_of(docs), labels, F.expr(TARGET)).collect()}
    assert max(rows[i] for i in range(21, 40, 2)) < min(rows[i] for i in range(20, 40, 2))


def test_no_targets_and_empty(spark, docs_of):
    none = spark.createDataFrame([], LABELS)
    r = lm_score.score(docs_of(["a b", None]), none, F.expr(TARGET)).orderBy("doc_id").collect()
    assert r[0].n_tokens == 2 and r[0].ce_target == pytest.approx(math.log(2)) and r[1].score is None
    assert lm_score.score(docs_of(["a"]).limit(0), none, F.expr(TARGET)).count() == 0


def test_very_many_rows_of_one_id(spark, docs_of, prose):
    docs = [(i, prose(prose.rng.randint(5, 40))) for i in range(1, 12)]
    hot = [(3, docs[2][1])] * 1100 + [(None, "null id words here")] * 1200 + [(3, prose(9)), (4, None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 3, 7)] + [(9, 0, 0)], LABELS)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(map(tuple, lm_score.score(docs_of(docs + hot), labels, F.expr(TARGET)).collect()), key=key)
    want = sorted(brute(docs + hot, {1, 3, 7}), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[2:] == (pytest.approx(b[2:], rel=1e-9, abs=1e-12) if b[2] is not None else b[2:])
