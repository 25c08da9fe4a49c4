"""The registered queries of the operators: against their SQL, or their digests worked out anew from the tables."""

import hashlib
import os
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from panelyard.llm import queries, sql
from tests.llm.test_secrets import brute_base

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.sql("SELECT doc_id, text FROM documents").fetchall())


def rows(spark, name):
    return queries.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = queries.queries()[name](spark, SF)
    want = db.sql(sql.oracle_sql()[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())


def test_audit_shows_every_status(spark):
    assert {r.status for r in rows(spark, "op4_merkle_audit")} == {"changed", "missing", "extra", "moved"}


def test_op7_digests(spark, texts):
    seen, want = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if (s := raw[k : k + 100]) in seen:
                gone[k : k + 100] = b"\x01" * 100
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        want[i] = (len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in rows(spark, "op7_suffix_dedup")} == want


def test_op8_base_digests(spark, texts):
    for r in rows(spark, "op8_secret_scan"):
        base = brute_base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[0] == k for b in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(",")) | {""}


def test_op9_fingerprints_and_components(spark, texts):
    def fingerprint(text):
        words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate({k: k + 32 for k in range(65, 91)})) if w]
        if not words:
            return 0
        hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = {i: fingerprint(t) for i, t in texts.items()}
    ids = sorted(fps)
    x = np.array([fps[i] for i in ids], np.uint64)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(x[:k] ^ x[k]) <= 3):
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op9_simhash")} == {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def test_op10_places(spark, texts):
    got = rows(spark, "op10_best_fit_packing")
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 4096
    assert {r.doc_id for r in got} == set(texts)
    assert len(by) <= -(-sum(r.length for r in got) // 4096) + 1


def test_op5_scores(spark, db, texts):
    got = {r.doc_id: r for r in rows(spark, "op5_quality_mil")}
    assert set(got) == set(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_op5_on_held_out_documents(spark):
    """What the classifier has never seen: its labels against the scores."""
    sf = "/root/testdata/sf0.01"
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    seen = [(r.score, r.predicted, label[r.doc_id]) for r in queries.op5_quality_mil(spark, sf).collect() if r.held_out and r.doc_id in label]
    good, bad = [s for s, _, y in seen if y], [s for s, _, y in seen if not y]
    assert len(seen) > 50 and np.mean([p == y for _, p, y in seen]) >= 0.95
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) >= 0.98  # area under the curve
