"""Cross-entropy difference: how much better a target model than a background model predicts each document.

Both are bigram models over one vocabulary, all words of the corpus, with the same smoothing: counts of a bigram
are joined by ``mu`` pseudo-counts shared out by add-one unigrams.  The background is every document, targets too, and
so is larger than the target; it isn't cut down to the target's size, so that what is gathered grows with the corpus.
The target is the documents that the label table marks.  The score is the mean over a document's tokens of the
target's loss less the background's (nats): the lower, the closer to the target.

Documents are dealt into blocks, by id (rows of one id that are very many: by their texts, equal ones as one row with
a count).  A block sends the n-grams that it holds and their counts to buckets of the
hash range, as sorted packed arrays; a bucket adds up what all blocks sent and answers each block in the same
order, so a block gets the model's entries that it needs and no more, and nothing of the model is broadcast but
three totals.  Both sides grow with the input.  A very frequent word is one entry a block.

Defined cases: null and empty texts have no tokens and null scores; repeated rows count and score each; label rows
with nulls mark nothing; a document with any marking label row is a target; without targets the target model is
uniform; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

MU = 10.0
#: Bytes of text of a block, from small to very large inputs.
BLOCK_BYTES = 8 << 20, 128 << 20
_BEGIN = np.uint64(0x5851F42D4C957F2D)
_ONE = np.uint64(1)


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with a begin mark before each text's first word, and each one's row; the lowest bit is clear."""
    starts, _, row = C.word_runs(data, offs)
    words = C.word_hashes(data, starts)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    return np.insert(words, first, _BEGIN) & ~_ONE, np.insert(row, first, row[first])


def _pairs(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all pairs of neighbours in one text, and where each pair's second word is."""
    at = np.flatnonzero(row[1:] == row[:-1]) + 1
    return (C.ngram_hashes(words, 2)[at - 1] if len(at) else np.zeros(0, np.uint64)) & ~_ONE, at


def _chunks(texts: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    lo = 0
    for batch in texts.to_batches():
        for a, _, data, offs in C.text_chunks(batch):
            yield lo + a, data, offs
        lo += batch.num_rows


def _split(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A block's documents, and which of them are targets: those known to be, and of the others those with a mark here."""
    mark = table.column("mark").to_numpy(zero_copy_only=False)
    docs = table.filter(pa.array(~mark))
    marked = pc.is_in(docs.column("doc_id"), value_set=pc.unique(table.filter(pa.array(mark)).column("doc_id")).drop_null(), skip_nulls=True)
    return docs.select(["doc_id", "text", "n"]), pc.coalesce(docs.column("known"), marked).to_numpy(zero_copy_only=False).astype(bool)


def _entries(docs: pa.Table, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's n-grams, ascending, with their counts in targets and in all documents."""
    found, times, n = [], [], docs.column("n").to_numpy()
    for lo, data, offs in _chunks(docs):
        words, row = _tokens(data, offs)
        pairs, at = _pairs(words, row)
        hit = targets[lo + row].astype(np.uint64)
        found += [words | hit, pairs | hit[at]]
        times += [n[lo + row], n[lo + row[at]]] if (n != 1).any() else []
    every = np.concatenate(found) if found else np.zeros(0, np.uint64)
    if times:
        order = np.argsort(every, kind="stable")
        every, times = every[order], np.concatenate(times)[order]
    else:
        every.sort()
    new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    count = (np.add.reduceat(times, new) if len(times) else np.diff(np.append(new, len(every)))).astype(np.uint64)
    key, hit = every[new] & ~_ONE, (every[new] & _ONE) > 0
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    add = lambda x: np.add.reduceat(x, first) if len(first) else x
    return key[first], add(np.where(hit, count, np.uint64(0))), add(count)


def _pack(x: np.ndarray) -> bytes:
    """Counts, most of them small: a byte each, and those from 255 on once more in full."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype(np.uint64).tobytes()


def _unpack(raw: pa.Scalar, n: int) -> np.ndarray:
    raw = np.frombuffer(raw.as_buffer(), np.uint8)
    out = raw[:n].astype(np.uint64)
    out[out == 255] = raw[n:].view(np.uint64) if n % 8 == 0 else np.frombuffer(raw[n:].tobytes(), np.uint64)
    return out


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, all first bytes, then all second bytes and so on: the high ones compress away."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack_keys(raw: pa.Scalar) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw.as_buffer(), np.uint8).reshape(8, -1).T).view(np.uint64).ravel())


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so that their order is the keys'."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _send(buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, t, b = _entries(*_split(table))
        to = _bucket(keys, buckets)
        cut = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]]) if len(to) else np.zeros(1, np.int64)
        pack = lambda x, how: pa.array([how(x[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
        return pa.table({"bucket": pa.array(to[cut[:-1]].astype(np.int32)), "block": pa.array(np.full(len(cut) - 1, key[0].as_py(), np.int32)), "keys": pack(keys, _pack_keys), "t": pack(t, _pack), "b": pack(b, _pack)})

    return run


def _answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Each block's entries again, with the counts of all blocks."""
    sent = [_unpack_keys(x) for x in table.column("keys")]
    unique, back = np.unique(np.concatenate(sent), return_inverse=True)
    cut = np.cumsum([0, *map(len, sent)])
    out = {"bucket": table.column("bucket"), "block": table.column("block"), "n": pa.array(np.diff(cut), pa.int64())}
    for c in ("t", "b"):
        total = np.zeros(len(unique), np.uint64)
        np.add.at(total, back, np.concatenate([_unpack(x, len(k)) for x, k in zip(table.column(c), sent, strict=True)]))
        mine = total[back]
        out[c] = pa.array([_pack(mine[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
    return pa.table(out)


def _scorer(totals: tuple[int, int, int], mu: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        docs, targets = _split(table)
        keys, _, _ = _entries(docs, targets)
        order = np.argsort(answers.column("bucket").to_numpy())
        t, b = (np.concatenate([np.zeros(0, np.uint64), *(_unpack(answers.column(c)[int(k)], answers.column("n")[int(k)].as_py()) for k in order)]).astype(np.float64) for c in ("t", "b"))
        n_tokens, sums = np.zeros(docs.num_rows, np.int64), np.zeros((2, docs.num_rows))
        for lo, data, offs in _chunks(docs):
            words, row = _tokens(data, offs)
            pairs, at = _pairs(words, row)
            if not len(at):
                continue
            one, two = np.searchsorted(keys, words), np.searchsorted(keys, pairs)
            n = len(offs) - 1
            n_tokens[lo : lo + n] = np.bincount(row[at], minlength=n)
            for k, (c, size) in enumerate(((t, totals[0]), (b, totals[1]))):
                uni = (c[one[at]] + 1) / (size + totals[2])
                loss = -np.log((c[two] + mu * uni) / (c[one[at - 1]] + mu))
                sums[k, lo : lo + n] = np.bincount(row[at], loss, minlength=n)
        some = n_tokens > 0
        mean = [pa.array(s / np.maximum(n_tokens, 1), mask=~some) for s in (sums[0], sums[1], sums[0] - sums[1])]
        return pa.table({"doc_id": docs.column("doc_id"), "n": docs.column("n"), "n_tokens": pa.array(n_tokens), "ce_target": mean[0], "ce_background": mean[1], "score": mean[2]})

    return run


def _totals(docs: DataFrame, is_target: DataFrame, buckets: int) -> tuple[int, int, int]:
    """Tokens in targets and in all documents (doc_id, text, n), and how many words the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def words() -> pa.RecordBatch:
            keys = np.unique(np.concatenate(held))
            to = _bucket(keys, buckets)
            cut = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]])
            n = len(cut) - 1
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(to[cut[:-1]].astype(np.int32)), pa.array([_pack_keys(keys[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["doc_id", "n", "bucket", "keys"])

        for batch in C.sliced(batches):
            n = np.zeros(batch.num_rows, np.int64)
            for lo, hi, data, offs in C.text_chunks(batch):
                starts, _, row = C.word_runs(data, offs)
                n[lo:hi] = np.bincount(row, minlength=hi - lo)
                if len(starts):
                    held.append(np.unique(C.word_hashes(data, starts) & ~_ONE))
                    size += len(held[-1])
            n *= batch.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=["doc_id", "n", "bucket", "keys"])
            if size > 1 << 21:
                yield words()
                held, size = [], 0
        if held:
            yield words()

    def distinct(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({"n": pa.array([len(np.unique(np.concatenate([_unpack_keys(x) for x in table.column("keys")])))], pa.int64())})

    found = C.materialize(docs.select("doc_id", "text", "n").mapInArrow(run, "doc_id long, n long, bucket int, keys binary"))
    counts = found.where("bucket is null").select("doc_id", "n")
    vocabulary = found.where("bucket is not null").select("bucket", "keys").groupBy("bucket").applyInArrow(distinct, "n long").agg(F.sum("n")).first()[0]
    target = counts.join(is_target, "doc_id", "left_semi").agg(F.sum("n")).first()[0]
    return target or 0, counts.agg(F.sum("n")).first()[0] or 0, vocabulary or 0


def score(docs: DataFrame, labels: DataFrame, is_target: Column, mu: float = MU) -> DataFrame:
    """(doc_id, n_tokens, ce_target, ce_background, score) for every row of *docs*; rows of *labels* where *is_target*
    mark the target documents."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(-(-size // C.block_bytes(size, *BLOCK_BYTES)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = labels.where(is_target & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = C.collapsed(docs).withColumn("doc_id", F.nullif("k_id", F.lit(2**63 - 1)))
    totals = _totals(rows, marks, blocks)
    # Whether a document is a target is found in its block; for the few ids with very many rows, and for null, beforehand.
    hot = rows.where("hot").join(marks.withColumn("known", F.lit(True)), "doc_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    cold = rows.where("not hot").withColumn("known", F.when(F.col("doc_id").isNull(), F.lit(False)))
    by_text = F.col("known").isNotNull()
    place = lambda c: F.pmod(c, F.lit(blocks)).cast("int").alias("block")
    texts = hot.unionByName(cold).select(place(F.when(by_text, F.xxhash64("k_id", "k_hash")).otherwise(F.xxhash64("doc_id"))), "doc_id", "text", "n", F.lit(False).alias("mark"), "known")
    sign = lambda c, kind: F.lit(None).cast(kind).alias(c)
    dealt = texts.unionByName(marks.select(place(F.xxhash64("doc_id")), "doc_id", sign("text", "string"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("mark"), sign("known", "boolean")))
    sent = dealt.groupBy("block").applyInArrow(_send(blocks), "bucket int, block int, keys binary, t binary, b binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "bucket int, block int, n long, t binary, b binary")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scorer(totals, mu), "doc_id long, n long, n_tokens long, ce_target double, ce_background double, score double")
    return scored.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n", "nth")
