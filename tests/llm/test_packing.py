import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelyard.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def sequences_hold(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_plan_places_every_length_and_is_near_the_bound():
    rng = np.random.default_rng(5)
    for sizes, slack in ((rng.integers(1, 4097, 5000), 1.01), (np.minimum(4096, rng.lognormal(6, 1.2, 20000).astype(int) + 1), 1.002), (np.full(1000, 1400), 1.5), (rng.integers(1200, 1500, 3000), 1.2)):
        lengths, counts = np.unique(sizes, return_counts=True)
        counts = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
        classes = packing.plan(counts)
        placed = defaultdict(list)
        for c in classes:
            assert sum(s * t for s, _, t in c.parts) <= 4096
            for s, first, t in c.parts:
                placed[s].append((first, first + c.n * t))
        for s, n in counts.items():
            at = 0
            for a, b in sorted(placed[s]):
                assert a == at
                at = b
            assert at == n
        assert sum(c.n for c in classes) <= max(1, -(-int(sizes.sum()) // 4096)) * slack + 1
        more = packing.plan({k: v * 1000 for k, v in counts.items()})
        assert len(more) < 20 * len(classes) + 1000  # the plan doesn't grow with the corpus


def test_grouped_plan_equals_best_fit():
    rng = np.random.default_rng(1)
    lognormal = rng.lognormal(6, 1.2, 20000).astype(int) + 1
    for sizes in (rng.integers(1, 4097, 5000), rng.integers(1100, 3000, 5000), rng.integers(1400, 2700, 20000), lognormal[lognormal <= 4096], rng.choice([1300, 1400, 1500, 2000, 2600], 3000)):
        lengths, counts = np.unique(sizes, return_counts=True)
        counts = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
        best = sum(c.n for c in packing._best_fit([], dict(counts), dict.fromkeys(counts, 0), 4096))
        assert sum(c.n for c in packing.plan(counts)) <= best * 1.005


def test_best_configuration_against_all():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = np.sort(rng.choice(np.arange(1025, 4097), 7, replace=False))
        worth = rng.random(7)
        every = [c for n in (1, 2, 3) for c in itertools.combinations_with_replacement(range(7), n) if sizes[list(c)].sum() <= 4096]
        value, config = packing._best_configuration(sizes, worth, 4096)
        assert value == pytest.approx(max(worth[list(c)].sum() for c in every)) and config @ sizes <= 4096 and config @ worth == pytest.approx(value)


def test_equal_rows_are_numbered_apart(spark):
    docs = spark.range(100_000).selectExpr("cast(null as long) doc_id", "cast(null as string) text")
    rows = packing.pack(docs, PATH)
    assert rows.select("sequence_id", "offset").distinct().count() == 100_000
    assert rows.select("sequence_id").distinct().count() == -(-100_000 // 4096)


def test_pack_round_trip(spark, docs_of, prose):
    texts = [prose(prose.rng.randint(1, 900)) for _ in range(60)] + [prose(9000), None, "", "It's a TEST, of 123 ½ “quotes”", "naïve CAFÉ é  x\x1cy 日本語 <|endoftext|> don't", "same same", "same same"]
    docs = docs_of([*texts[:-1], (len(texts) - 1, texts[-1])])
    rows = packing.pack(docs, PATH).collect()
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    want = []
    for i, t in enumerate([*texts[:-1]], 1):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for _ in range(2 if i == len(texts) - 1 else 1):
            want += [(i, p, at, len(part := ids[at : at + 4096]), zlib.crc32(np.array(part, "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    n = sequences_hold(rows, 4096)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1


def test_ids_are_kept(spark, docs_of):
    r = packing.pieces(docs_of(["one two three"]), PATH, capacity=2, with_ids=True).collect()
    tok = Tokenizer.from_file(PATH)
    assert [i for x in r for i in x.ids] == tok.encode("one two three", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("capacity", [1, 7])
def test_small_capacity_and_empty(spark, docs_of, capacity):
    rows = packing.pack(docs_of(["a b c d e f g h i j", None, "a"]), PATH, capacity=capacity).collect()
    assert sequences_hold(rows, capacity) == -(-14 // capacity)
    assert packing.pack(docs_of(["x"]).limit(0), PATH).count() == 0


def test_encoder_equals_the_tokenizer():
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    rng = np.random.default_rng(2)
    bits = ["The", "é", "É", "ß", "'s", "'", "12", "½", ",", ".", "!!", "***", "ÿ", "ſ", "K", "İ", "ı", "Ǆ", "ŉ", "Ÿ", "Σ", "ς", "\u0301", "e\u0301", "“", "”", "—", "\u00a0", "\u2003", "\x1c", "\x85", "日本", "<|endoftext|>", "</w>", "a</w>", "_", "|", "$", "x" * 40, "\u200d", "\x00"]
    texts = ["".join(rng.choice([*bits, " ", "\n", "\t ", "the", "Tion", "é", "Ä", "éàü"], rng.integers(1, 30))) for _ in range(3000)]
    for most in (20, 100_000):
        enc = packing.WordEncoder(PATH, most)
        for lo in range(0, len(texts), 50):
            got = enc.encode([t.encode() for t in texts[lo : lo + 50]], 1)
            want = tok.encode_batch_fast(texts[lo : lo + 50], add_special_tokens=False)
            for t, g, e in zip(texts[lo:], got, want, strict=False):
                assert np.frombuffer(g, "<u4").tolist() == [*e.ids, 1], t
