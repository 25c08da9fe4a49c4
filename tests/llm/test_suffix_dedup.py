import hashlib

import numpy as np
import pytest

from panelyard.llm import suffix_dedup as S


def brute(docs, length=100):
    """docs: (id, text) with distinct ids -> id: (bytes, removed mask)"""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - length + 1):
            w = raw[a : a + length]
            if w in seen:
                gone[a : a + length] = True
            seen.add(w)
        out[i] = raw, gone
    return out


def check(rows, docs, length=100):
    want = brute(docs, length)
    assert len(rows) == len(docs)
    for r in rows:
        raw, gone = want[r.doc_id]
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        assert (r.n_bytes, r.n_removed, [(s.start, s.stop) for s in r.spans]) == (len(raw), int(gone.sum()), list(zip(runs[::2], runs[1::2], strict=True))), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest() and r.kept == kept


@pytest.fixture()
def corpus(prose):
    rng = prose.rng
    base = [prose(rng.randint(5, 200)) for _ in range(30)]
    passage = prose(40)
    texts = list(base)
    for _ in range(30):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = "CHANGED" + str(rng.random())
        texts.append(" ".join(words))
    texts += [prose(rng.randint(1, 30)) + passage + prose(rng.randint(1, 30)) for _ in range(25)]
    texts += [base[3], base[3], None, "", "x" * 99, "x" * 100, "y" * 1000, "ab" * 400, "y" * 150 + "z", "é" * 60, passage * 4, prose(5000)]
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("hot", [S.HOT, 4])
def test_against_brute_force(spark, docs_of, corpus, hot):
    check(S.dedup_substrings(docs_of(corpus), hot=hot).collect(), corpus)


def test_other_length(spark, docs_of, corpus):
    small = corpus[:70]
    check(S.dedup_substrings(docs_of(small), length=24).collect(), small, 24)


def test_suffix_array_against_plain_sort():
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 26):
        strings = [rng.integers(97, 97 + alphabet, rng.integers(0, 60)).astype(np.uint8).tobytes() for _ in range(40)]
        text = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.uint16) + 1, 0) for s in strings]).astype(np.uint16)
        end = np.flatnonzero(text == 0)
        suffix = [text[i : end[np.searchsorted(end, i)] + 1].tobytes() for i in range(len(text))]
        key = lambda i: np.frombuffer(suffix[i], np.uint16).tolist()[:30]  # noqa: B023, E731
        got = S.suffix_array(text, 30)
        assert sorted(got.tolist()) == list(range(len(text)))
        keys = [key(i) for i in got]
        assert keys == sorted(keys)
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if k == 12 or x != y or not x), min(len(a), len(b), 12))
        assert S.common_prefixes(text, got, 12).tolist() == [0] + [common(a, b) for a, b in zip(keys, keys[1:], strict=False)]



def test_repeated_rows_null_ids_and_empty(spark, docs_of, prose):
    t = prose(50)
    rows = S.dedup_substrings(docs_of([(5, t), (5, t), (None, t), (3, "short")])).collect()
    n = len(t.encode())
    assert sorted((str(r.doc_id), r.n_removed) for r in rows) == [("3", 0), ("5", 0), ("5", 0), ("None", n)]
    assert S.dedup_substrings(docs_of(["x"]).limit(0)).count() == 0


def test_very_many_equal_rows(spark, docs_of, corpus):
    docs = corpus[:20] + [(5000, corpus[3][1]), (5001, None)]
    rows = docs_of(docs)
    many = rows.unionByName(rows.where("doc_id in (5, 5000, 5001)").crossJoin(spark.range(1500)).drop("id"))
    got = S.dedup_substrings(many).collect()
    assert len(got) == len(docs) + 3 * 1500
    check(list({r.doc_id: r for r in got}.values()), docs)
    assert len({(r.doc_id, r.n_removed, r.kept_sha256) for r in got}) == len(docs)
    assert not spark.catalog.listTables()
