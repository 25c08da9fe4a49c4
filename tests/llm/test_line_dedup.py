from pyspark.sql import functions as F

from panelyard.llm import line_dedup


def brute(docs):
    """docs: (id, text) with distinct ids"""
    seen, gone = set(), {}
    for i, t in sorted((d for d in docs if d[1] is not None), key=lambda d: d[0]):
        ls = [x.strip(" ") for x in t.split("\n")]
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            if not any(w):
                continue
            if w in seen:
                gone.setdefault(i, set()).update(range(k, k + 3))
            seen.add(w)
    return {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in docs}


def test_against_brute_force(spark, docs_of, prose):
    pool = [prose(6) for _ in range(12)] + ["", "  ", "x "]
    texts = ["\n".join(prose.rng.choices(pool, k=prose.rng.randint(1, 14))) for _ in range(200)]
    texts += [None, "", "\n\n\n\n", "one line", "a\nb\nc\na\nb\nc\na\nb\nc", "\n".join(["same"] * 3000), " x\nx\nx ", "x\n x\nx"]
    docs = list(enumerate(texts, 1))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(docs)).collect()}
    want = brute(docs)
    assert {i: r.text for i, r in out.items()} == want
    for i, t in docs:
        assert out[i].n_lines == (0 if t is None else t.count("\n") + 1)
        assert (out[i].n_removed > 0) == (t != want[i])


def test_repeated_rows_nulls_and_clashes(spark, docs_of):
    t = "a\nb\nc"
    docs = docs_of([(5, t), (5, t), (None, t), (5, "z\na\nb\nc"), (9, t)]).withColumns({c: F.lit(1) for c in ("k_id", "k_hash", "covered", "k_lines", "hashes", "line")})
    out = line_dedup.dedup_lines(docs)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    got = sorted((str(r.doc_id), r.text) for r in out.collect())
    assert got[0] == ("5", t) and got[1] == ("5", t) or ("5", "z") in got
    assert ("9", "") in got and ("None", "") in got


def test_native_and_empty(spark, docs_of):
    out = line_dedup.dedup_lines(docs_of(["a\nb\nc"]))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert line_dedup.dedup_lines(docs_of(["x"]).limit(0)).count() == 0
