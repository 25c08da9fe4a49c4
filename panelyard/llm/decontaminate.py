"""Benchmark decontamination: a broadcast hash set of the test items' n-grams is held against every
window of the documents' words; hits are verified word by word, then spans or documents go.

The scan is one narrow Python stage over the documents (no shuffle).  What is broadcast is part of the
benchmark of at most ``part_bytes`` of text: its windows' hashes in order and where each lies in one buffer of the
items' words, about nine bytes a byte of text.  Tasks work out words and hashes, the driver only sorts a part's.
A larger benchmark is taken in several parts, one scan behind the other; after PARTS_AT_ONCE of them the rows are
written and read again, so that no task holds more parts than that.

Defined cases: null and empty texts have no words and no hits; an item without words never hits; an item
of fewer than n words is one window of all its words; an item whose id is null takes part, but isn't named; ids may be
of any type; repeated documents or items give the same answer each time; an empty benchmark leaves every document
clean; further columns pass through untouched, but one named like a result of the scan is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

#: Most text of the benchmark in one broadcast, and how many broadcasts a task may hold.
PART_BYTES, PARTS_AT_ONCE = 8 << 20, 4
_SPAN = pa.struct([("first", pa.int64()), ("stop", pa.int64())])


def scan_fields(benchmark: DataFrame) -> list[T.StructField]:
    """What the scan adds: words in all, hit words as runs of word numbers, and the items that hit."""
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("stop", T.LongType())])
    return [T.StructField("n_words", T.LongType()), T.StructField("word_spans", T.ArrayType(span)), T.StructField("item_ids", T.ArrayType(benchmark.schema["item_id"].dataType))]


def _item_windows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every item with words: its words, joined, their places there, and the hashes of its windows."""
        for batch in C.sliced(batches):
            cells = []
            for k, raw in enumerate(C.texts(batch)):
                data = np.frombuffer(raw, np.uint8)
                starts, ends, _ = C.word_runs(data, np.array([0, len(data)]))
                if not len(starts):
                    continue
                low = raw.lower()
                joined = b" ".join([low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
                stops = np.cumsum(ends - starts + 1) - 1
                at = (stops - (ends - starts)).astype(np.int64)
                hashes = C.ngram_hashes(C.word_hashes(np.frombuffer(joined, np.uint8), at), min(n, len(at)))
                cells.append((k, joined, at.tobytes(), hashes.tobytes()))
            of, *cols = zip(*cells, strict=True) if cells else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(of, pa.int64())), *(pa.array(c, pa.binary()) for c in cols)], names=["item_id", "words", "at", "hashes"])

    return run


class Windows:
    """The windows of one size: hashes in order, where each window's words lie in the buffer, and its item's number."""

    def __init__(self, size: int, hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray):
        order = np.lexsort((item, hashes))
        self.size, self.hashes, self.lo, self.hi, self.item = size, hashes[order], lo[order], hi[order], item[order]
        # One byte for every value of the last bits, some eight times as many as there are windows.
        self.mask = np.uint64((1 << min(24, max(12, int(len(hashes) * 8).bit_length()))) - 1)
        self.seen = np.zeros(int(self.mask) + 1, bool)
        self.seen[(self.hashes & self.mask).astype(np.int64)] = True


def window_sets(items: pa.Table, n: int) -> tuple[bytes, pa.Array, list[Windows]]:
    """(buffer of all words, item ids by number, windows by size) of the rows of ``_item_windows``."""
    words = [x.as_py() for x in items.column("words")]
    base = np.cumsum([0, *(len(w) + 1 for w in words)])
    by: dict[int, list] = {}
    for k, (at, hashes) in enumerate(zip(items.column("at"), items.column("hashes"), strict=True)):
        at, hashes = np.frombuffer(at.as_buffer(), np.int64), np.frombuffer(hashes.as_buffer(), np.uint64)
        size = min(n, len(at))
        ends = np.append(at[1:] - 1, len(words[k]))
        by.setdefault(size, []).append((hashes, base[k] + at[: len(hashes)], base[k] + ends[size - 1 :], np.full(len(hashes), k)))
    return b" ".join(words), items.column("item_id").combine_chunks(), [Windows(size, *(np.concatenate(c) for c in zip(*found, strict=True))) for size, found in by.items()]


def _hits(data: np.ndarray, offs: np.ndarray, buffer: bytes, sets: list[Windows]) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, set]]]:
    """Word count of each text, and for those with hits the mask of hit words and the numbers of the items."""
    starts, ends, row = C.word_runs(data, offs)
    counts = np.bincount(row, minlength=len(offs) - 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    hashes = C.word_hashes(data, starts)
    found: dict[int, tuple[np.ndarray, set]] = {}
    for w in sets:
        h = C.ngram_hashes(hashes, w.size)
        if not len(h):
            continue
        at = np.flatnonzero(w.seen[(h & w.mask).astype(np.int64)])
        at = at[row[at] == row[at + w.size - 1]]
        lo, hi = np.searchsorted(w.hashes, h[at]), np.searchsorted(w.hashes, h[at], "right")
        ok = hi > lo
        for i, a, b in zip(at[ok].tolist(), lo[ok].tolist(), hi[ok].tolist(), strict=True):
            here = b" ".join([data[x:y].tobytes().lower() for x, y in zip(starts[i : i + w.size], ends[i : i + w.size], strict=True)])
            items = [int(w.item[k]) for k in range(a, b) if buffer[w.lo[k] : w.hi[k]] == here]
            if items:
                r = int(row[i])
                mask, every = found.setdefault(r, (np.zeros(counts[r], bool), set()))
                mask[i - first[r] : i - first[r] + w.size] = True
                every.update(items)
    return counts, found


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _scanner(part, state: bool, then=None):
    """Scan with one part of the benchmark; *state*: the rows carry what earlier parts found; *then*: what follows
    in the same worker."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, names, sets = part.value
        for batch in C.sliced(batches):
            n_words, spans, ids = [], [], []
            for lo, hi, data, offs in C.text_chunks(batch):
                counts, found = _hits(data, offs, buffer, sets)
                n_words.append(counts)
                for r in range(hi - lo):
                    mask, items = found.get(r, (None, ()))
                    named = {x for x in names.take(pa.array(sorted(items), pa.int64())).to_pylist() if x is not None} if items else set()
                    if state and (old := batch.column("word_spans")[lo + r].as_py()):
                        mask = np.zeros(counts[r], bool) if mask is None else mask
                        for s in old:
                            mask[s["first"] : s["stop"]] = True
                        named |= set(batch.column("item_ids")[lo + r].as_py())
                    spans.append([] if mask is None else [{"first": a, "stop": b} for a, b in _runs(mask)])
                    ids.append(sorted(named))
            new = {"n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), "word_spans": pa.array(spans, pa.list_(_SPAN)), "item_ids": pa.array(ids, pa.list_(names.type))}
            keep = [k for k in batch.schema.names if not state or k not in new]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keep), *new.values()], names=[*keep, *new])

    return scan if then is None else lambda batches: then(scan(batches))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """*docs* (with a column ``text``) and the columns of ``scan_fields``: what of each text is in *benchmark* (item_id, text)."""
    return _scan(docs.drop(*[f.name for f in scan_fields(benchmark)]), benchmark, n, part_bytes)


def _scan(docs: DataFrame, benchmark: DataFrame, n: int, part_bytes: int, then=None, then_schema: T.StructType | None = None) -> DataFrame:
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text is not null").dropDuplicates()
    kind = benchmark.schema["item_id"].dataType.simpleString()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // part_bytes) or 1
    schema = T.StructType([*docs.schema.fields, *scan_fields(benchmark)])
    out = docs
    for k in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        rows = mine.mapInArrow(_item_windows(n), f"item_id {kind}, words binary, at binary, hashes binary").toArrow()
        if k and k % PARTS_AT_ONCE == 0:
            out = C.materialize(out)
        last = then is not None and k == parts - 1
        out = out.mapInArrow(_scanner(spark.sparkContext.broadcast(window_sets(rows, n)), k > 0, then if last else None), then_schema if last else schema)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, raw = batch.column("word_spans").to_pylist(), C.texts(batch)
        texts = batch.column("text").to_pylist()
        for i, mine in enumerate(spans):
            if mine:
                data = np.frombuffer(raw[i], np.uint8)
                starts, ends, _ = C.word_runs(data, np.array([0, len(data)]))
                left, at = [], 0
                for s in mine:
                    left.append(raw[i][at : starts[s["first"]]])
                    at = ends[s["stop"] - 1]
                texts[i] = b"".join([*left, raw[i][at:]]).decode()
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "spans", part_bytes: int = PART_BYTES) -> DataFrame:
    """*docs* without what is in *benchmark*: ``remove='spans'`` cuts every run of hit words out of its text,
    ``remove='documents'`` drops each document with a hit.  Clean rows stay as they are, null texts too.
    Windows that only arise where two remainders meet are no occurrences and stay."""
    rows = C.boxed(docs, "text")
    if remove == "documents":
        return C.unboxed(scan(rows, benchmark, n, part_bytes).where(F.size("item_ids") == 0), docs.columns)
    cut = _scan(rows, benchmark, n, part_bytes, _cut, T.StructType([rows.schema["row"], rows.schema["text"]]))
    return C.unboxed(cut, docs.columns, text="text")
