import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from panelyard.llm import decontaminate
from panelyard.llm._common import read
from tests.llm.conftest import plain_shingles

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_take_effect(spark):
    docs = read(spark, SF, "documents")
    columns, kept = docs.columns, [docs]
    for _, stage in P.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SF).cache())
        assert kept[-1].columns == columns
        assert kept[-1].count() <= kept[-2].count()
    good, lines, near, clean = kept[1:]
    y = read(spark, SF, "labels")
    assert good.join(y, "doc_id").where("quality = 0").count() <= 2  # few labels teach here
    assert lines.count() == good.count()
    seen, repeats = set(), 0
    for r in good.orderBy("doc_id").collect():
        ls = [x.strip(" ") for x in r.text.split("\n")]
        for w in zip(ls, ls[1:], ls[2:], strict=False):
            repeats += w in seen
            seen.add(w)
    assert (lines.agg(F.sum("n_chars")).first()[0] < good.agg(F.sum("n_chars")).first()[0]) == (repeats > 0)
    sets = [plain_shingles(r.text.encode(), 5) for r in near.collect()]
    assert sum(len(a & b) >= 0.8 * len(a | b) for k, a in enumerate(sets) for b in sets[:k]) == 0
    assert decontaminate.scan(clean.select("text"), read(spark, SF, "benchmark")).where("size(item_ids) > 0").count() == 0
    packed = P.STAGES[-1][1](spark, clean, SF)
    assert packed.select("doc_id").distinct().count() == clean.count()
    assert packed.count() == P.run(spark, SF).count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_run_against_plain_code(spark):
    """Every stage done again in plain code on what the classifier keeps, down to the tokens that are packed."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from panelyard.llm.queries import word_tokenizer
    from tests.llm.test_decontaminate import LOWER, WORD, words
    from tests.llm.test_simhash import brute_similar

    docs = sorted((r.doc_id, r.text) for r in P.keep_quality(spark, read(spark, SF, "documents"), SF).collect())
    seen, kept = set(), []
    for i, t in docs:  # line dedup
        lines, gone = t.split("\n"), set()
        tidy = [x.strip(" ") for x in lines]
        for k in range(len(tidy) - 2):
            if any(w := tuple(tidy[k : k + 3])):
                gone |= {k, k + 1, k + 2} if w in seen else set()
                seen.add(w)
        kept.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    first = {k - 1 for k in brute_similar([t for _, t in kept])}  # near duplicates, by place
    kept = [d for k, d in enumerate(kept) if k in first]
    windows = {}
    for r in read(spark, SF, "benchmark").collect():  # decontamination
        ws = words(r.text)
        n = min(10, len(ws))
        windows.setdefault(n, set()).update(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1) if ws)
    tok = Tokenizer.from_file(word_tokenizer())
    tok.encode_special_tokens = True
    want = []
    for i, t in kept:
        ws, at, hit = words(t), [m.span() for m in WORD.finditer(t.translate(LOWER))], set()
        for n, found in windows.items():
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in found:
                    hit |= set(range(k, k + n))
        left, done = [], 0
        for k in sorted(hit):
            if k - 1 in hit:
                done = at[k][1]
            else:
                left.append(t[done : at[k][0]])
                done = at[k][1]
        ids = tok.encode("".join([*left, t[done:]]), add_special_tokens=False).ids + [1]
        want += [(i, p, at, len(part := ids[at : at + 4096]), zlib.crc32(np.array(part, "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in P.run(spark, SF).collect()) == sorted(want)


def test_stages_with_odd_rows(spark, docs_of):
    docs = docs_of([(None, None), (1, None), (1, None), (2, ""), (3, "a\nb\nc"), (3, "a\nb\nc"), (4, "a\nb\nc\nd"), (5, "word " * 5000)]).withColumns({c: F.lit(1) for c in ("k_id", "covered", "keeper", "root", "row", "score", "item_ids", "n_lines")})
    for _, stage in P.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
