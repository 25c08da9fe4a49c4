"""Quality classifier: attention-based multiple-instance learning over passages.

A text is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage is encoded from what it looks like (shares
of kinds of characters, word lengths, repeats, hashed pairs of bytes).  A gated attention (tanh times sigmoid)
gives each passage a weight, learned from labels of whole documents; the weighted mean of the passage codes is
scored.  Learning takes at most ``max_train_docs`` labelled documents, those of the smallest id hashes, and of these
as many as have ``max_train_bytes`` of text together, each with all its passages; this bounded sample alone reaches
the driver.  Scoring is one narrow Python stage over whole texts, with the fixed-size weights broadcast.

Defined cases: null and empty texts are one empty passage and get a score, too; repeated rows score alike; a
document with several label rows counts with the highest; labels that are null or of no document are ignored; of
several texts under one id the one of the smallest hash teaches; a document over ``max_train_bytes`` doesn't teach;
without labels of both classes every score is the share of label 1 (1 if there are none); a null id is never held
out; an empty table gives no rows; further columns pass through, but one named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

PASSAGE_WORDS = 48
MAX_TRAIN_DOCS, MAX_TRAIN_BYTES = 4000, 16 << 20
THRESHOLD = 0.7
_PAIRS, _CODE, _ATTENTION = 128, 32, 16
_SINGLE = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n", np.uint8)
_N_STATS = len(_SINGLE) + 9
N_FEATURES = _N_STATS + _PAIRS


def _class_table() -> np.ndarray:
    """Each byte's column: 0 lower, 1 upper, 2 digit, 3 blank, 4 beyond ASCII, 5 other, then the single characters."""
    t = np.full(256, 5)
    t[97:123], t[65:91], t[48:58], t[[9, 13, 32]], t[128:] = 0, 1, 2, 3, 4
    t[_SINGLE] = 6 + np.arange(len(_SINGLE))
    return t


_CLASS = _class_table()
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a chunk of texts, and the row of each; a text has one at least."""
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    start = ~blank & (edge[:-1] | np.concatenate([[True], blank[:-1]]))
    words = np.flatnonzero(start)
    row = np.searchsorted(offs, words, "right") - 1
    first = np.searchsorted(words, offs[:-1])
    nth = np.arange(len(words)) - first[row]
    # A passage begins with each text and at every PASSAGE_WORDS-th word of it.
    lead = words[(nth % PASSAGE_WORDS == 0) & (nth > 0)]
    rows = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs, lead, "right") - 1])
    begins = np.concatenate([offs[:-1], lead])
    order = np.lexsort((begins, rows))
    begins, rows = begins[order], rows[order]
    n = len(rows)
    size = np.diff(np.concatenate([begins, [len(data)]]))
    # A byte's passage: the last one that begins at or before it and isn't empty.
    full = np.flatnonzero(size > 0)
    of = np.repeat(full, size[full])
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(data):
        return out, rows
    bytes_ = np.maximum(size, 1)[:, None]
    classes = np.bincount(of * 64 + _CLASS[data], minlength=n * 64).reshape(n, 64)[:, : 6 + len(_SINGLE)]
    out[:, : 6 + len(_SINGLE)] = np.sqrt(classes / bytes_)
    count = np.bincount(of[words], minlength=n)
    k = 6 + len(_SINGLE)
    out[:, k] = size / np.maximum(count, 1) / 10
    if len(words):
        hashes = C.word_hashes(data, words)
        same = np.zeros(len(words), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (of[words[1:]] == of[words[:-1]])
        out[:, k + 1] = np.bincount(of[words], same, minlength=n) / np.maximum(count, 1)
        key = np.sort((hashes >> np.uint64(24)) ^ (of[words].astype(np.uint64) << np.uint64(40)))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        out[:, k + 2] = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)[:n] / np.maximum(count, 1)
    low = data.astype(np.uint32)
    pair = ((low[:-1] * np.uint32(2654435761) + low[1:] * np.uint32(40503) * np.uint32(65537)) >> np.uint32(25)).astype(np.int64)
    pairs = np.bincount(of[:-1] * _PAIRS + pair, minlength=n * _PAIRS).reshape(n, _PAIRS)
    out[:, _N_STATS:] = np.sqrt(pairs / bytes_)
    return out, rows


class Model:
    """Codes h = tanh(xE); weights a = softmax(w (tanh(hV) * sigmoid(hU))); score = sigmoid(c sum(a h) + b)."""

    def __init__(self, weights: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.w, self.mean, self.scale = weights, mean, scale

    def _forward(self, x: np.ndarray, rows: np.ndarray):
        w = self.w
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        s = (t * g) @ w["w"]
        begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        index = np.cumsum(np.concatenate([[0], rows[1:] != rows[:-1]]))
        a = np.exp(s - np.maximum.reduceat(s, begin)[index])
        a /= np.add.reduceat(a, begin)[index]
        z = np.add.reduceat(a[:, None] * h, begin, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -40, 40)))
        return h, t, g, begin, index, a, z, p

    def score(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """A score for each run of equal *rows*."""
        return self._forward((x - self.mean) * self.scale, rows)[-1].astype(np.float64)

    @classmethod
    def fit(cls, x: np.ndarray, rows: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> Model:
        """Adam on the cross entropy of bags; *rows* ascend, y has a label for each run of them."""
        rng = np.random.default_rng(seed)
        mean, scale = x.mean(axis=0), 1 / (x.std(axis=0) + 0.02)
        x = (x - mean) * scale
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        w = {"E": draw(x.shape[1], _CODE), "e": np.zeros(_CODE, np.float32), "V": draw(_CODE, _ATTENTION), "U": draw(_CODE, _ATTENTION), "w": draw(_ATTENTION), "c": draw(_CODE), "b": np.zeros((), np.float32)}
        m, v = ({k: np.zeros_like(q) for k, q in w.items()} for _ in range(2))
        model = cls(w, mean, scale)
        begin = np.concatenate([np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])), [len(rows)]])
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for lo in range(0, len(order), batch):
                bags = order[lo : lo + batch]
                take = np.concatenate([np.arange(begin[k], begin[k + 1]) for k in bags])
                of = np.repeat(np.arange(len(bags)), [begin[k + 1] - begin[k] for k in bags])
                grad = model._gradient(x[take], of, y[bags])
                step += 1
                for k in w:
                    g = grad[k] + decay * w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = (w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return model

    def _gradient(self, x: np.ndarray, rows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        h, t, g, begin, index, a, z, p = self._forward(x, rows)
        d = (p - y) / len(y)
        dz = d[:, None] * w["c"]
        da = (dz[index] * h).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, begin)[index])
        dt, dg = ds[:, None] * w["w"] * g * (1 - t * t), ds[:, None] * w["w"] * t * g * (1 - g)
        dh = a[:, None] * dz[index] + dt @ w["V"].T + dg @ w["U"].T
        dx = dh * (1 - h * h)
        return {"E": x.T @ dx, "e": dx.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ d, "b": d.sum()}


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document: all its passages' features, as half-precision numbers."""
    for batch in C.sliced(batches):
        for lo, hi, data, offs in C.text_chunks(batch):
            x, rows = passages(data, offs)
            x = x.astype(np.float16)
            cut = np.searchsorted(rows, np.arange(hi - lo + 1))
            cells = [x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), pa.array(cells, pa.binary())], names=["doc_id", "label", "x"])


def taught_rows(docs: DataFrame, labels: DataFrame, label: str, max_train_docs: int, max_train_bytes: int, skip_held_out: bool) -> list[tuple[int, int, int]]:
    """(doc_id, text hash, label) of the documents that teach: at most *max_train_docs*, in the order of their ids' hashes,
    as long as their texts fit into *max_train_bytes*."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if skip_held_out:
        y = y.where(~held_out(F.col("doc_id")))
    y = y.groupBy(F.col("doc_id").cast("long").alias("k_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    text = F.struct("k_hash", F.col("size"))
    have = docs.select(*C.row_key(), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(y, "k_id").groupBy("k_id", "label").agg(F.min(text).alias("t"))
    first = have.orderBy(F.xxhash64("k_id"), "k_id").limit(max_train_docs).select("k_id", "t.k_hash", "label", "t.size").collect()
    out, room = [], max_train_bytes
    for k_id, k_hash, y, size in first:
        if size <= room:
            out.append((k_id, k_hash, y))
            room -= size
    return out


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train_docs: int = MAX_TRAIN_DOCS, max_train_bytes: int = MAX_TRAIN_BYTES, skip_held_out: bool = True) -> Model | float:
    """A model, or the share of label 1 where there aren't both classes."""
    chosen = taught_rows(docs, labels, label, max_train_docs, max_train_bytes, skip_held_out)
    if len({y for *_, y in chosen}) < 2:
        return chosen[0][2] * 1.0 if chosen else 1.0
    # At most max_train_docs rows: small enough for every task.
    wanted = docs.sparkSession.createDataFrame(chosen, "k_id long, k_hash long, label int")
    taught = docs.select(*C.row_key(), "text").join(F.broadcast(wanted), ["k_id", "k_hash"]).dropDuplicates(["k_id", "k_hash"])
    table = taught.select(F.col("k_id").alias("doc_id"), "label", "text").mapInArrow(_encode, "doc_id long, label int, x binary").toArrow()
    order = np.argsort(table["doc_id"].to_numpy())
    y = table["label"].to_numpy()[order]
    bags = [np.frombuffer(x.as_buffer(), np.float16).reshape(-1, N_FEATURES) for x in table["x"].take(pa.array(order))]
    x, rows = np.concatenate(bags).astype(np.float32), np.repeat(np.arange(len(bags)), list(map(len, bags)))
    del table, bags
    pa.default_memory_pool().release_unused()
    return Model.fit(x, rows, y.astype(np.float32))


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """*docs* and a column ``score``: how likely each text has label 1 (a column of that name is replaced)."""
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in C.sliced(batches):
            if isinstance(model, float):
                scores = [np.full(batch.num_rows, model)]
            else:
                scores = [model.score(*passages(data, offs)) for _, _, data, offs in C.text_chunks(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, max_train_docs: int = MAX_TRAIN_DOCS, max_train_bytes: int = MAX_TRAIN_BYTES) -> DataFrame:
    """*docs* with ``held_out``, ``score`` and ``predicted`` (1 from *threshold* on), learned from the rows that aren't held out."""
    scored = score(docs, learn(docs, labels, label, max_train_docs, max_train_bytes))
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, max_train_docs: int = MAX_TRAIN_DOCS, max_train_bytes: int = MAX_TRAIN_BYTES) -> DataFrame:
    """The rows of *docs* that the classifier accepts."""
    scored = score(C.boxed(docs, "text"), learn(docs, labels, label, max_train_docs, max_train_bytes))
    return C.unboxed(scored.where(F.col("score") >= threshold), docs.columns)
