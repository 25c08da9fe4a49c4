"""Removal of repeated byte strings by suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document of smaller id, or
earlier in the same one.  The steps:

1. Documents are dealt into blocks by the hash of their key and written once as a bucketed table, so that the
   later passes over the texts need no shuffle; a bucket holds several blocks where there are more than BUCKETS.
2. Every window of *length* bytes has an anchor, the least hash of the GRAM-byte strings inside it.  Windows of
   equal bytes have equal anchors.  A run of windows with one anchor is a segment, about one every 31 bytes.
   Blocks send the anchors they hold to buckets, as packed arrays, and hear which occur more than once.
3. Segments of repeated anchors are compared by a 128-bit cryptographic digest (BLAKE2b) of all their bytes: later
   occurrences of a whole segment go at once.  What is left are segments that differ but share an anchor, or repeat in
   themselves, and only these bring their bytes.
4. Those bytes are suffix sorted by two-stage sorting: only suffixes smaller than their successors are sorted
   directly, the others are induced from them bucket by bucket; then the lengths of neighbours' common prefixes are
   computed (as far as *length* bytes, more isn't needed), and in each run of neighbours with *length* common bytes all
   but the earliest go.

Copies: within a block equal segments count once, so that a group holds at most one row a block.  Rows of one id that
are very many come once for each text, with their number, and are multiplied at the end.  An anchor with
more than ``hot`` different segments (text around a very common passage) is dealt out by single windows.

Defined cases: null texts are empty; texts shorter than *length* stay; a null id comes after all others; rows that
share an id but not a text are ordered by the text's hash; rows that repeat id and text act as one, so neither
loses bytes to the other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

LENGTH = 100
GRAM = 40
#: Bytes of text of a block, from small to very large inputs, and the most buckets of the written table.
BLOCK_BYTES, BUCKETS = (32 << 20, 256 << 20), 50_000
HOT = 1000
_SORT_BYTES = 1 << 20


# --- anchors ----------------------------------------------------------------------


def _least_of(x: np.ndarray, width: int, ties: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Minimum of every *width* neighbours, and whether it occurs twice among them (None: it nowhere does)."""
    n = len(x) - width + 1
    acc, have, size, done, left = None, (x, np.zeros(len(x), bool)), 1, 0, width

    def both(a, b):
        (u, fu), (v, fv) = a, b
        if ties:
            return np.minimum(u, v), (fu & (u <= v)) | (fv & (v <= u)) | (u == v)
        if (u == v).any():
            raise StopIteration
        return np.minimum(u, v), fu[: len(u)]

    try:
        while left:
            if left & 1:
                part = tuple(y[done : done + n] for y in have)
                acc, done = part if acc is None else both(acc, part), done + size
            left >>= 1
            if left:
                have, size = both(tuple(y[:-size] for y in have), tuple(y[size:] for y in have)), 2 * size
    except StopIteration:
        return _least_of(x, width, True)
    return acc[0], acc[1] if ties else None


def segments(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window start, windows, tied) of a chunk's segments, in order; windows don't cross texts.

    A segment is cut to as many windows as there are GRAM-byte strings in one.  So where two of its windows are
    equal, some window of it holds the anchor twice: *tied*.
    """
    gram = min(GRAM, length)
    most = length - gram + 1
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    least, twice = _least_of(C.ngram_hashes(data.astype(np.uint64) + np.uint64(1), gram), most)
    change = np.zeros(len(least) + 1, np.int32)
    long = offs[1:] - offs[:-1] >= length
    np.add.at(change, offs[:-1][long], 1)
    np.add.at(change, offs[1:][long] - (length - 1), -1)
    valid = np.cumsum(change[:-1], dtype=np.int32) > 0
    new = np.empty(len(least), bool)
    new[0] = True
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    new[offs[:-1][offs[:-1] < len(least)]] = True
    begin = np.flatnonzero(new & valid)
    end = np.flatnonzero((new | ~valid)[1:] & valid[:-1]) + 1
    if len(valid) and valid[-1]:
        end = np.append(end, len(least))
    count = end - begin
    cuts = -(-count // most)
    nth = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    start = np.repeat(begin, cuts) + nth * most
    count = np.minimum(most, np.repeat(end, cuts) - start)
    if twice is None:
        return least[start], start, count, np.zeros(len(start), bool)
    sums = np.concatenate([[0], np.cumsum(twice)])
    return least[start], start, count, sums[start + count] > sums[start]


def segment_digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 128-bit digest of the bytes of each data[start:stop], as two numbers."""
    raw, digest = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    return np.frombuffer(b"".join([digest(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), stop.tolist(), strict=True)]), np.int64).reshape(-1, 2)


# --- two-stage suffix sorting -------------------------------------------------------


def _windows(text: np.ndarray, depth: int) -> np.ndarray:
    """Every suffix's first *depth* symbols, as a view."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(depth, text.dtype)]), depth)


def _as_strings(rows: np.ndarray) -> np.ndarray:
    """Rows of symbols as byte strings that sort alike."""
    rows = rows if rows.dtype == np.uint8 else rows.astype(">u2")
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1] * rows.itemsize}").ravel()


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes of *text* (unsigned; 0 ends a string and is less than all) by their first *depth* symbols.

    Suffixes less than their successor are sorted directly; each other suffix is (first symbol, rank of the
    successor), and its successor lies in no later bucket, so buckets in rising order induce them.
    """
    n = len(text)
    end = text == 0
    nxt = np.append(text[1:], text.dtype.type(0))
    differ = np.flatnonzero((text != nxt) | end)
    to = differ[np.searchsorted(differ, np.arange(n))]  # where the run of equal symbols ends
    small = (text[to] < nxt[to]) & ~end
    direct = np.flatnonzero(small)
    stop = np.flatnonzero(end)
    left = stop[np.searchsorted(stop, direct)] - direct
    view = _windows(text, depth)[direct]
    view[np.arange(depth)[None, :] > left[:, None]] = 0
    order = direct[np.argsort(_as_strings(view), kind="stable")]
    sizes = np.bincount(text, minlength=258)
    heads = np.concatenate([[0], np.cumsum(sizes)])
    array = np.empty(n, np.int64)
    rank = np.empty(n, np.int64)
    ends = np.flatnonzero(end)
    array[: len(ends)] = ends
    rank[ends] = np.arange(len(ends))
    by_symbol = np.argsort(text, kind="stable")
    of_order = text[order]
    for c in np.flatnonzero(sizes[1:]) + 1:
        mine = by_symbol[heads[c] : heads[c + 1]]
        large = mine[~small[mine]]
        at = heads[c]
        run = large[nxt[large] != c] if len(large) else large
        rest = large[nxt[large] == c] if len(large) else large
        run = run[np.argsort(rank[np.minimum(run + 1, n - 1)], kind="stable")]
        while True:  # suffixes whose successors were just placed in this bucket come next, in that order
            array[at : at + len(run)] = run
            rank[run] = np.arange(at, at + len(run))
            at += len(run)
            if not len(rest):
                break
            placed = rank[rest + 1] if len(rest) else rest
            ready = np.isin(rest + 1, run, assume_unique=True)
            run = rest[ready][np.argsort(placed[ready], kind="stable")]
            rest = rest[~ready]
        lo, hi = np.searchsorted(of_order, c), np.searchsorted(of_order, c, "right")
        array[at : heads[c + 1]] = order[lo:hi]
        rank[order[lo:hi]] = np.arange(at, heads[c + 1])
    return array


def common_prefixes(text: np.ndarray, array: np.ndarray, depth: int, rows: int = 1 << 13) -> np.ndarray:
    """How many symbols each suffix of *array* (in order; some may be left out) has in common with the one before it, up to
    *depth*; a string's end is common to nothing, and the first has 0."""
    stop = np.flatnonzero(text == 0)
    left = np.minimum(stop[np.searchsorted(stop, array)] - array, depth)
    view = _windows(text, depth)
    out = np.zeros(len(array), np.int64)
    for lo in range(1, len(array), rows):
        k = np.arange(lo, min(lo + rows, len(array)))
        a, b = view[array[k]], view[array[k - 1]]
        whole = _as_strings(a) == _as_strings(b)
        common = np.full(len(k), depth)
        if len(part := np.flatnonzero(~whole)):
            differ = a[part] != b[part]
            common[part] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
        out[k] = np.minimum(common, np.minimum(left[k], left[k - 1]))
    return out


def later_windows(strings: list[bytes], windows: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """(string, window) rows whose *length* bytes also start in an earlier place.

    String k has *windows*[k] starts; *order* gives its place among all strings, then starts count upward.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    every = np.frombuffer(b"".join(strings), np.uint8)
    # A symbol is a byte plus one; UTF-8 has no byte 255, other bytes need wider symbols.
    text = np.zeros(len(every) + len(strings), np.uint16 if (every == 255).any() else np.uint8)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    mask = np.ones(len(text), bool)
    mask[begin + sizes] = False
    text[mask] = every.astype(text.dtype) + text.dtype.type(1)
    array = suffix_array(text, length)
    of = np.searchsorted(begin, array, "right") - 1
    inside = array - begin[of] < windows[of]
    array, of = array[inside], of[inside]
    group = np.cumsum(common_prefixes(text, array, length) < length)
    rank = np.argsort(np.lexsort((array - begin[of], order[of], group)))
    first = np.full(int(group.max(initial=0)) + 1, len(array))
    np.minimum.at(first, group, rank)
    late = rank != first[group]
    return np.stack([of[late], array[late] - begin[of[late]]], axis=1)


# --- the passes ---------------------------------------------------------------------


def _spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans, as maximal runs by document."""
    if not len(doc):
        return doc, start, stop
    o = np.lexsort((start, doc))
    doc, start, stop = doc[o], start[o], stop[o]
    big = int(stop.max()) + 1
    reach = np.maximum.accumulate(doc * big + stop)
    new = np.concatenate([[True], doc[1:] * big + start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], start[first], reach[last] - doc[first] * big


class _Block:
    """A block's documents, each key once, in their order."""

    def __init__(self, table: pa.Table):
        ids, hashes = table.column("k_id").to_numpy(), table.column("k_hash").to_numpy()
        order = np.lexsort((hashes, ids))
        new = np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])]) if len(order) else np.zeros(0, bool)
        self.rows = order[new]
        self.k_id, self.k_hash = ids[self.rows], hashes[self.rows]
        self.number = np.empty(len(order), np.int64)  # of each row's document
        self.number[order] = np.cumsum(new) - 1
        self.texts = table.column("text").cast(pa.large_binary()).combine_chunks()

    def chunks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, bytes, offsets)"""
        lo = 0
        while lo < len(self.rows):
            parts, size, hi = [], 0, lo
            while hi < len(self.rows) and (hi == lo or size < C.CHUNK_BYTES):
                parts.append(self.text(hi))
                size += len(parts[-1])
                hi += 1
            yield lo, np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            lo = hi

    def text(self, doc: int) -> bytes:
        return self.texts[int(self.rows[doc])].as_py() or b""

    def find(self, k_id: np.ndarray, k_hash: np.ndarray) -> np.ndarray:
        """Document numbers of keys that are there."""
        at = {k: i for i, k in enumerate(zip(self.k_id.tolist(), self.k_hash.tolist(), strict=True))}
        return np.array([at[k] for k in zip(k_id.tolist(), k_hash.tolist(), strict=True)], np.int64)


def _send_anchors(length: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = [(m, tied) for _, data, offs in _Block(table).chunks() for m, _, _, tied in [segments(data, offs, length)]]
        every, tied = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, bool))
        m, n = np.unique(np.concatenate([every, every[tied]]), return_counts=True)
        to = (m % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        m, n, to = m[order], n[order], to[order]
        cut = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]]) if len(to) else np.zeros(1, int)
        rows = [(int(to[a]), key[0].as_py(), m[a:b].tobytes(), np.packbits(n[a:b] > 1).tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "block": pa.array(cols[1], pa.int32()), "anchors": pa.array(cols[2], pa.binary()), "more": pa.array(cols[3], pa.binary())})

    return run


def _answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each block of a bucket: those of its anchors that occur more than once in all."""
    sent = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("anchors")]
    more = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(m)).view(bool) for x, m in zip(table.column("more"), sent, strict=True)]
    every = np.concatenate(sent)
    unique, count = np.unique(every, return_counts=True)
    repeated = count > 1
    repeated[np.searchsorted(unique, np.concatenate([m[x] for m, x in zip(sent, more, strict=True)]))] = True
    return pa.table({"block": table.column("block"), "repeated": pa.array([m[repeated[np.searchsorted(unique, m)]].tobytes() for m in sent], pa.binary())})


_MARK = "kind int, m long, sg long, sh long, k_id long, k_hash long, start long, n long"


def _marks(kind: int, block: _Block, doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    zero = np.zeros(len(doc), np.int64)
    return [np.full(len(doc), kind, np.int32), zero, zero, zero, block.k_id[doc], block.k_hash[doc], start, stop - start]


def _repeats(length: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Kind 0 (2: tied): a block's first occurrence of every segment whose anchor repeats; kind 1: spans of its others."""
        block = _Block(docs)
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for x in answers.column("repeated"))]))
        got = []
        for first, data, offs in block.chunks():
            m, start, n, tied = segments(data, offs, length)
            if not len(known) or not len(m):
                continue
            at = np.minimum(np.searchsorted(known, m), len(known) - 1)
            keep = known[at] == m
            m, start, n, tied = m[keep], start[keep], n[keep], tied[keep]
            doc = np.searchsorted(offs, start, "right") - 1
            got.append((m, *segment_digests(data, start, start + n + length - 1).T, doc + first, start - offs[doc], n, tied))
        none = [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)]
        m, sg, sh, doc, start, n, tied = (np.concatenate(x) for x in zip(*got, strict=True)) if got else none
        order = np.lexsort((start, doc, sh, sg, m))
        m, sg, sh, doc, start, n, tied = (x[order] for x in (m, sg, sh, doc, start, n, tied))
        new = np.concatenate([[True], (m[1:] != m[:-1]) | (sg[1:] != sg[:-1]) | (sh[1:] != sh[:-1])]) if len(m) else np.zeros(0, bool)
        firsts = [np.where(tied[new], 2, 0).astype(np.int32), m[new].view(np.int64), sg[new], sh[new], block.k_id[doc[new]], block.k_hash[doc[new]], start[new], n[new]]
        late = _marks(1, block, *_spans(doc[~new], start[~new], (start + n + length - 1)[~new]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(firsts, late, strict=True)], names=["kind", "m", "sg", "sh", "k_id", "k_hash", "start", "n"])

    return run


def _bring(length: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, asked: pa.Table) -> pa.Table:
        """Kind 0: the bytes of the segments asked for, single windows for a hot anchor; kind 1: spans of repeated windows."""
        block = _Block(docs)
        doc = block.find(asked.column("k_id").to_numpy(), asked.column("k_hash").to_numpy())
        start, n, m, hot = (asked.column(c).to_numpy() for c in ("start", "n", "m", "hot"))
        part, of, begin, count, strings, late = [], [], [], [], [], []
        seen: set[bytes] = set()
        text, have = b"", -1
        for i in np.lexsort((start, doc)).tolist():
            d, s, w = int(doc[i]), int(start[i]), int(n[i])
            if d != have:
                text, have = block.text(d), d
            for a in range(s, s + w) if hot[i] else [s]:
                size = length if hot[i] else w + length - 1
                string = text[a : a + size]
                if hot[i]:
                    if string in seen:
                        late.append((d, a, a + length))
                        continue
                    seen.add(string)
                    part.append(int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True))
                else:
                    part.append(int(m[i]))
                of.append(d)
                begin.append(a)
                count.append(1 if hot[i] else w)
                strings.append(string)
        of, late = np.array(of, np.int64), np.array(late, np.int64).reshape(-1, 3)
        marks = _marks(1, block, *_spans(*late.T))
        firsts = [np.zeros(len(of), np.int32), np.array(part, np.int64), *[np.zeros(len(of), np.int64)] * 2, block.k_id[of], block.k_hash[of], np.array(begin, np.int64), np.array(count, np.int64)]
        return pa.table([*(pa.array(np.concatenate(x)) for x in zip(firsts, marks, strict=True)), pa.array([*strings, *([None] * len(late[: len(marks[0])]))], pa.binary())], names=["kind", "m", "sg", "sh", "k_id", "k_hash", "start", "n", "bytes"])

    return run


def _sort(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by m; all segments of some anchors are sorted at once, about _SORT_BYTES at a time."""

        def out(rows: pa.Table) -> pa.RecordBatch:
            k_id, k_hash, start, n = (rows.column(c).to_numpy() for c in ("k_id", "k_hash", "start", "n"))
            order = np.argsort(np.lexsort((start, k_hash, k_id)))
            hit = later_windows(rows.column("bytes").to_pylist(), n, order, length)
            of, a, b = _spans(hit[:, 0], hit[:, 1], hit[:, 1] + length)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (k_id[of], k_hash[of], start[of] + a, b - a)], names=["k_id", "k_hash", "start", "n"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= _SORT_BYTES:
                rows = pa.Table.from_batches(held)
                m = rows.column("m").to_numpy()
                if len(done := np.flatnonzero(m[1:] != m[:-1])):
                    cut = int(done[-1]) + 1
                    yield out(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
                    size = sum(x.nbytes for x in held)
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield out(rows)

    return run


def _kept(with_text: bool):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, marks: pa.Table) -> pa.Table:
        block = _Block(docs)
        doc = block.find(marks.column("k_id").to_numpy(), marks.column("k_hash").to_numpy())
        start = marks.column("start").to_numpy()
        doc, start, stop = _spans(doc, start, start + marks.column("n").to_numpy())
        first = np.searchsorted(doc, np.arange(len(block.rows) + 1))
        out = []
        for d in range(len(block.rows)):
            text, spans = block.text(d), list(zip(start[first[d] : first[d + 1]].tolist(), stop[first[d] : first[d + 1]].tolist(), strict=True))
            at, left = 0, []
            for a, b in spans:
                left.append(text[at:a])
                at = b
            kept = b"".join([*left, text[at:]])
            out.append((len(text), len(text) - len(kept), [{"start": a, "stop": b} for a, b in spans], hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        cols = list(zip(*(out[k] for k in block.number.tolist()), strict=True)) or [[]] * 5
        return pa.table(
            {
                "k_id": docs.column("k_id"), "rows": docs.column("rows"), "n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()),
                "spans": pa.array(cols[2], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), "kept_sha256": pa.array(cols[3], pa.string()), "kept": pa.array(cols[4], pa.binary()),
            }
        )

    return run


def dedup_substrings(docs: DataFrame, length: int = LENGTH, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256, kept) for every row of *docs*: the spans, in bytes, that go, and
    the bytes that stay (``kept`` is null without *with_text*; a cut may fall inside a code point)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(-(-size // C.block_bytes(size, *BLOCK_BYTES)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    block = F.pmod(F.xxhash64("k_id", "k_hash"), F.lit(blocks)).cast("int").alias("block")
    # 1. One shuffle of the texts; the passes below read the buckets.
    buckets = min(blocks, BUCKETS)
    name = f"suffix_dedup_{uuid.uuid4().hex}"
    placed = C.collapsed(docs).select(block, "k_id", "k_hash", "text", F.col("n").alias("rows")).repartition(buckets, "block")
    placed.write.bucketBy(buckets, "block").option("compression", "zstd").option("path", f"{C.shared_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    here = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay, and *here* knows their buckets
    # 2. Anchors that repeat, 3. segments that repeat.
    sent = here.groupBy("block").applyInArrow(_send_anchors(length, blocks), "bucket int, block int, anchors binary, more binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "block int, repeated binary")
    found = C.materialize(here.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_repeats(length), _MARK))
    firsts = found.where("kind <> 1")
    place = F.struct("k_id", "k_hash", "start")
    least = firsts.groupBy("m", "sg", "sh").agg(F.min(place).alias("first"), F.max("n").alias("n"), F.max("kind").alias("kind"))
    mark = ["k_id", "k_hash", "start", "n"]
    copies = firsts.join(least.select("m", "sg", "sh", "first"), ["m", "sg", "sh"]).where(place > F.col("first")).select("k_id", "k_hash", "start", (F.col("n") + length - 1).alias("n"))
    # 4. Different segments of one anchor, or one that repeats in itself: the suffix sort.
    mixed = least.groupBy("m").agg(F.count("*").alias("c"), F.max("kind").alias("tied")).where("c > 1 or tied = 2").select("m", "c")
    asked = least.join(mixed, "m").select("m", "first.k_id", "first.k_hash", "first.start", "n", (F.col("c") > hot).alias("hot")).withColumn("block", block)
    brought = C.materialize(here.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_bring(length), _MARK + ", bytes binary"))
    rows = brought.where("kind = 0").select("m", *mark, "bytes")
    parts = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = rows.repartition(parts, "m").sortWithinPartitions("m").mapInArrow(_sort(length), "k_id long, k_hash long, start long, n long")
    marks = found.where("kind = 1").select(mark).unionByName(copies).unionByName(brought.where("kind = 1").select(mark)).unionByName(sorted_)
    out = here.groupBy("block").cogroup(marks.withColumn("block", block).groupBy("block")).applyInArrow(
        _kept(with_text), "k_id long, rows long, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept_sha256 string, kept binary"
    )
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return out.select(F.when(F.col("k_id") != 2**63 - 1, F.col("k_id")).alias("doc_id"), "n_bytes", "n_removed", "spans", "kept_sha256", "kept")
