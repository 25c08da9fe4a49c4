import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelyard.llm import simhash
from panelyard.llm.components import components
from tests.llm.conftest import plain_shingles


def brute_fingerprint(text, size=3):
    raw, word, words = (text or "").encode(), b"", []
    for b in raw + b" ":
        if b == 0x20 or 0x09 <= b <= 0x0D:
            if word:
                words.append(word)
            word = b""
        else:
            word += bytes([b + 32 if 0x41 <= b <= 0x5A else b])
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, budget=3):
    """fps: list of (id, fp)"""
    comp = {i: i for i, _ in fps}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k, (i, a) in enumerate(fps):
        for j, b in fps[:k]:
            if (a ^ b).bit_count() <= budget:
                x, y = top(i), top(j)
                comp[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in fps}


@pytest.mark.parametrize("text", [None, "", "  \n\t", "One", "One two", "one two three", "A a a a A a a", "x\x1cy z w\x0bv", "Ünïcode ÉÉ words go here", "ab " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("key_rows", [simhash.KEY_ROWS, 8])
def test_components_against_brute_force(spark, docs_of, prose, key_rows):
    base = [prose(120) for _ in range(30)]
    texts = list(base)
    for k in range(60):
        words = prose.rng.choice(base).split()
        for _ in range(prose.rng.randint(0, 4)):
            words[prose.rng.randrange(len(words))] = prose(1)
        texts.append(" ".join(words))
    texts += [None, "", " ", "short one", "short one"]
    out = simhash.near_duplicates(docs_of(texts), key_rows=key_rows).collect()
    fps = [(i + 1, brute_fingerprint(t)) for i, t in enumerate(texts)]
    want = brute_components(fps)
    assert {r.doc_id: r.fp % 2**64 for r in out} == dict(fps)
    assert {r.doc_id: r.component_id for r in out} == want
    assert sorted(r.doc_id for r in out if r.keeper) == sorted(set(want.values()))


def test_trie_links_on_dense_groups():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([centre[k % 12 : k % 12 + 1] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for k in range(800)]))
    node, root = simhash.trie_links(fps, np.zeros(len(fps), np.int64), 3)
    mine = np.arange(len(fps))
    mine[node] = root
    want = brute_components(list(enumerate(fps.tolist())))
    assert mine.tolist() == [want[i] for i in range(len(fps))]


def brute_similar(texts, words=5, least=0.8):
    sets = [plain_shingles((t or "").encode(), words) for t in texts]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return sorted({find(i) + 1 for i in range(len(texts))})


def test_near_dedup_against_brute_force(spark, docs_of, prose):
    base = [prose(prose.rng.randint(150, 400)) for _ in range(25)]
    texts = list(base)
    for _ in range(80):
        words = prose.rng.choice(base).split()
        for _ in range(prose.rng.randint(0, 3)):
            words[prose.rng.randrange(len(words))] = prose(1)
        texts.append(" ".join(words))
    texts += [base[0], base[0].upper(), None, "", "one two", "One  two", "x y z w v", other := prose(200), " ".join(sorted(other.split())), " ".join(other.split()[::-1])]
    kept = sorted(r.doc_id for r in simhash.near_dedup(docs_of(texts)).collect())
    assert kept == brute_similar(texts)


def test_a_passage_in_half_of_all_texts_pairs_nothing(spark):
    """The order of shingles comes from all rows, so what many texts share comes last and no text is looked up by it."""
    rng = np.random.default_rng(9)
    words = rng.integers(0, 10**9, (20_000, 20)).astype(str)
    texts = [" ".join(w) + (" this passage stands in many of the texts" if k % 2 else "") for k, w in enumerate(words)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[1] + " end", texts[3].replace("passage", "sentence")])), "doc_id long, text string")
    fp = simhash.fingerprints(docs, 1, True)
    table = fp.groupBy("k_hash", "fp").agg(F.min("k_id").alias("k_id"))
    alone = spark.createDataFrame([], "node long, root long")
    rows, counts = simhash.shared_rows(docs, table, alone, 5, 0.8)
    assert rows.count() < 200 and simhash.exact_pairs(rows, counts, alone, 0.8).count() <= 10
    kept = {r.doc_id for r in simhash.near_dedup(docs).select("doc_id").collect()}
    assert kept == set(range(20_000)) | ({20_001} if len(plain_shingles(texts[3].encode(), 5) & plain_shingles(texts[3].replace("passage", "sentence").encode(), 5)) < 0.8 * 28 else set())


def test_forest_has_the_fewest_bits():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([centre[k % 6 : k % 6 + 1] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 4).astype(np.uint64)) for k in range(300)]))
    i, j = simhash.trie_forest(fps, np.zeros(len(fps), np.int64), 6)
    cost = np.bitwise_count(fps[i] ^ fps[j])
    top = list(range(len(fps)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    want = []
    for d, a, b in sorted((int((x ^ y).bit_count()), a, b) for a, x in enumerate(fps.tolist()) for b, y in enumerate(fps.tolist()[:a]) if (x ^ y).bit_count() <= 6):
        if find(a) != find(b):
            top[find(a)] = find(b)
            want.append(d)
    assert sorted(cost.tolist()) == want


def test_rows_with_nulls_repeats_and_more_columns(spark, docs_of):
    d = docs_of([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (5, "z y x w v"), (None, "only null id here now")]).withColumn("fp", F.lit(1)).withColumn("k_hash", F.lit(2))
    out = simhash.near_duplicates(d).collect()
    assert len(out) == 5
    assert {(r.doc_id, r.component_id) for r in out} == {(None, 5), (5, 5), (None, None)}
    kept = simhash.near_dedup(docs_of([(9, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, None), (8, "")]))
    assert sorted(r.doc_id for r in kept.collect()) == [5, 7]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_table(spark, docs_of):
    assert simhash.near_duplicates(docs_of(["x"]).limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(50)] + [(7, 7), (None, 3)]
    out = components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.root for r in out.collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(50)}}


def kept_of(docs):
    return sorted(r.doc_id for r in simhash.near_dedup(docs).collect())


def pinned(monkeypatch, fps):
    """Give texts these fingerprints (a dict of text to number)."""
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.select(*simhash.C.row_key(), F.element_at(F.create_map(*[F.lit(x) for kv in fps.items() for x in kv]), F.col("text")).cast("long").alias("fp")))


def test_near_dedup_past_false_neighbours(spark, docs_of, prose, monkeypatch):
    a, c = prose(100), prose(100)
    b = a + " tail"
    # a and b lie six bits apart, and c, which is like neither, three bits from both.
    pinned(monkeypatch, {a: 0b000000, b: 0b111111, c: 0b000111})
    assert kept_of(docs_of([a, b, c])) == [1, 3]


def test_near_dedup_finds_longer_and_shorter_copies(spark, docs_of, prose):
    texts = []
    for k in range(40):
        words = prose(120).split()
        texts += [" ".join(words), " ".join(words + prose(26).split()) if k % 2 else " ".join(words[:-22])]
    assert kept_of(docs_of(texts)) == brute_similar(texts)


def test_near_dedup_among_texts_of_the_same_words(spark, docs_of, prose):
    words = prose(100).split()
    texts = []
    for _ in range(12):
        prose.rng.shuffle(words)
        texts += [" ".join(words), " ".join([*words[:-2], words[-1], words[-2]])]
    assert len({simhash.fingerprint(t.encode(), 1, True) for t in texts}) == 1
    assert kept_of(docs_of(texts)) == brute_similar(texts) == list(range(1, 25, 2))
