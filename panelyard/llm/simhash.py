"""SimHash near-duplicates by a binary-trie self-join.

A text's fingerprint has bit b set if over half of its shingles' XXH64 values have it.  Equal fingerprints
are taken together first, so a group of copies counts once.  Fingerprints within the Hamming budget then meet
by the pigeonhole rule: cut into blocks, some of the blocks agree, so each fingerprint goes once to every
choice of blocks, keyed by the bits there.  Inside a key a binary trie of the fingerprints is joined with
itself: pairs of nodes go down together, differing bits add up, and a pair over the budget is dropped.  Links
are thinned to a spanning forest within each task (union-find) before they leave it.  A key with more than
``key_rows`` fingerprints is dealt out as pairs of chunks, so that no task holds more than two chunks; no
link is lost.  The links' connected components are found by a distributed star algorithm.

``near_duplicates`` takes all links of the budget as they are.  ``near_dedup`` uses the same join to find candidates,
holds the texts themselves against each other, and then adds by an exact join on rare shingles what fingerprints miss.

Defined cases: null and empty texts have no words and fingerprint zero, and are linked like others; texts of
fewer words than a shingle are one shingle; repeated rows fall into one component; rows that share an id but
not a text are told apart by the text's hash; a null id comes after all others and a component of null ids
alone has a null component_id; further columns are ignored (``near_dedup`` passes them through).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .components import components

#: Most fingerprints that may be expected to share a key by chance; more blocks must agree beyond that.
CHANCE_ROWS = 64
KEY_ROWS = 20_000
#: Texts under one shared shingle beyond which they are dealt out; shingles that set the order of shingles.
SHARED_ROWS, ORDER_SHINGLES = 1000, 500_000
#: Bits of a text's sketch, each the parity of how many of its shingles' hashes end so.
SKETCH_BITS = 512
_FRONTIER = 1 << 19


def _blocks(n: int, budget: int) -> tuple[int, int]:
    """Into how many blocks *n* fingerprints are cut, and how many of these agree at least: all but *budget*."""
    return next(((budget + m, m) for m in (1, 2, 3) if n <= CHANCE_ROWS * 2 ** (64 * m / (budget + m))), (budget + 4, 4))


def fingerprint(text: bytes, size: int = 3, distinct: bool = False) -> int:
    """The SimHash of a text's shingles of *size* words, as an unsigned number; *distinct*: of its different words."""
    words = text.lower().split()
    if distinct:
        words, size = list(dict.fromkeys(words)), 1
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    ones, n = np.zeros(64, np.int64), len(words) - size + 1
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[lo:hi].tolist(), stops[lo + size - 1 : hi + size - 1].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3, distinct: bool = False) -> DataFrame:
    """(k_id, k_hash, fp long): the fingerprint of every row of *docs* (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches):
            fp = np.array([fingerprint(x, size, distinct) for x in C.texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("k_id"), batch.column("k_hash"), pa.array(fp)], names=["k_id", "k_hash", "fp"])

    return docs.select(*C.row_key(), "text").mapInArrow(run, "k_id long, k_hash long, fp long")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components of links between rows 0..n-1."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        live = low < high
        if not live.any():
            break
        a, b, low, high = a[live], b[live], low[live], high[live]
        np.minimum.at(root, high, low)
        while not np.array_equal(root, up := root[root]):
            root = up
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def trie_links(fps: np.ndarray, groups: np.ndarray, budget: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (row, root) of rows within *budget* bits, inside each run of equal *groups*."""
    node, root = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i, j, _ in trie_pairs(fps, groups, budget, side):
        node, root = _forest(np.concatenate([node, i]), np.concatenate([root, j]), len(fps))
    return node, root


def trie_forest(fps: np.ndarray, groups: np.ndarray, budget: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) of a spanning forest of the fewest differing bits: the trie is joined once for every number of
    bits, and a link counts if what fewer bits link doesn't connect its ends."""
    found: list[tuple[int, int]] = []
    node, root = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for bits in range(budget + 1):
        for i, j, d in trie_pairs(fps, groups, bits, side):
            top = np.arange(len(fps))
            top[node] = root
            new = (d == bits) & (top[i] != top[j])
            if not new.any():
                continue
            i, j = i[new], j[new]
            # One link for each pair of components, then those that still join two.
            a, b = np.minimum(top[i], top[j]), np.maximum(top[i], top[j])
            _, one = np.unique(a * len(fps) + b, return_index=True)
            up: dict[int, int] = {}

            def find(x: int) -> int:
                while x in up:  # noqa: B023
                    x = up[x]  # noqa: B023
                return x

            for k in one.tolist():
                x, y = find(int(a[k])), find(int(b[k]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    found.append((int(i[k]), int(j[k])))
            node, root = _forest(np.concatenate([node, a[one]]), np.concatenate([root, b[one]]), len(fps))
    i, j = np.array(found, np.int64).reshape(-1, 2).T
    return i, j


def trie_pairs(fps: np.ndarray, groups: np.ndarray, budget: int, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All links (i, j, bits) of rows within *budget* bits, inside each run of equal *groups*, in slices.

    *fps* ascend within a group.  A trie node at depth d is a range of rows that share d leading bits.
    *side* 0, 1: only links from side 0 to side 1 are wanted; -1: any.
    """
    n = len(fps)
    cuts = np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1, [n]]) if n else np.zeros(1, np.int64)
    lo, hi = cuts[:-1], cuts[1:]
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    bits = {}

    def ones(depth: int) -> np.ndarray:
        if depth not in bits:
            bits[depth] = np.concatenate([[0], np.cumsum((fps >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        return bits[depth]

    stack = [(0, *(x[k : k + _FRONTIER] for x in (lo, hi, lo, hi, np.zeros(len(lo), np.int8)))) for k in range(0, len(lo), _FRONTIER)]
    while stack:
        depth, alo, ahi, blo, bhi, d = stack.pop()
        small = ((ahi - alo) * (bhi - blo) <= 16) | (depth == 64)
        if small.any():
            la, ha, lb, hb = alo[small], ahi[small], blo[small], bhi[small]
            wide = hb - lb
            total = (ha - la) * wide
            for s in _slices(total):
                reps = np.repeat(np.arange(s.start, s.stop), total[s])
                k = np.arange(len(reps)) - np.repeat(np.cumsum(total[s]) - total[s], total[s])
                i, j = la[reps] + k // wide[reps], lb[reps] + k % wide[reps]
                ok = (i < j) | (lb[reps] != la[reps])
                bits_ = np.bitwise_count(fps[i] ^ fps[j])
                ok &= bits_ <= budget
                if side is not None:
                    ok &= (side[i] < 0) | (side[i] != side[j])
                if ok.any():
                    yield i[ok], j[ok], bits_[ok]
        rest = ~small
        if not rest.any():
            continue
        alo, ahi, blo, bhi, d = alo[rest], ahi[rest], blo[rest], bhi[rest], d[rest]
        c = ones(depth)
        am, bm = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        same = alo == blo
        parts = [(alo, am, blo, bm, d), (am, ahi, bm, bhi, d), (alo, am, bm, bhi, d + 1)]
        parts.append(tuple(x[~same] for x in (am, ahi, blo, bm, d + 1)))
        nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
        live = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= budget)
        live &= (nxt[0] != nxt[2]) | (nxt[1] - nxt[0] > 1)
        nxt = [x[live] for x in nxt]
        for k in range(0, len(nxt[0]), _FRONTIER):
            stack.append((depth + 1, *(x[k : k + _FRONTIER] for x in nxt)))


def _slices(total: np.ndarray, most: int = 1 << 21) -> Iterator[slice]:
    ends, lo = np.cumsum(total), 0
    while lo < len(total):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield slice(lo, hi)
        lo = hi


def _joiner(budget: int, join=trie_links, flush: int = 1 << 18):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and fingerprint; whole keys are joined together, about *flush* rows at a time."""

        def out(key, fp, side):
            node, root = join(fp, key, budget, side)
            return pa.RecordBatch.from_arrays([pa.array(fp[node].view(np.int64) ^ np.int64(-(2**63))), pa.array(fp[root].view(np.int64) ^ np.int64(-(2**63)))], names=["a", "b"])

        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)]
        for batch in batches:
            new = [batch.column("part").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(2**63), batch.column("side").to_numpy(zero_copy_only=False)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) >= flush and (done := np.flatnonzero(held[0][1:] != held[0][:-1])).size:
                cut = int(done[-1]) + 1
                yield out(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield out(*held)

    return run


def links(distinct: DataFrame, budget: int = 3, key_rows: int = KEY_ROWS, join=trie_links) -> DataFrame:
    """(a, b): spanning links between the distinct fingerprints (column fp) within *budget* bits of each other; with
    *join* ``trie_forest`` they are links of the fewest bits themselves, with ``trie_links`` they may be short cuts."""
    spark = distinct.sparkSession
    n = distinct.count()
    blocks, agree = _blocks(n, budget)
    cuts = [round(k * 64 / blocks) for k in range(blocks + 1)]
    masks = [sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in chosen) for chosen in combinations(range(blocks), agree)]
    signed = lambda m: m - 2**64 if m >= 2**63 else m
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("bits")) for k, m in enumerate(masks)])).alias("key")
    sent = distinct.select("fp", keys).select("fp", "key.k", "key.bits")
    hot = sent.groupBy("k", "bits").count().where(F.col("count") > key_rows).select("k", "bits", F.ceil(F.col("count") / key_rows).cast("int").alias("c"))
    c = F.coalesce("c", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), c).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), c - 1), lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j")))
    spread = sent.join(hot, ["k", "bits"], "left").withColumn("mine", mine).withColumn("pair", F.explode(pairs))
    side = F.when(F.col("pair.i") == F.col("pair.j"), -1).when(F.col("mine") == F.col("pair.i"), 0).otherwise(1).cast("byte")
    # Groups are told apart by a hash of the key; two keys that share one only meet in vain.
    rows = spread.select(F.xxhash64("k", "bits", "pair.i", "pair.j").alias("part"), "fp", side.alias("side"))
    parts = max(1, -(-n * len(masks) // 500_000), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "part").sortWithinPartitions("part", "fp").mapInArrow(_joiner(budget, join), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, budget: int = 3, key_rows: int = KEY_ROWS) -> DataFrame:
    """(doc_id, k_id, k_hash, fp, component_id, keeper): the component of every row of *docs*; keeper marks the
    rows of the component's smallest doc_id (of these, of the smallest text hash)."""
    fp = C.materialize(fingerprints(docs, size))
    distinct = fp.groupBy("fp").agg(F.min(F.struct("k_id", "k_hash")).alias("first"))
    roots = components(links(distinct.select("fp"), budget, key_rows))
    mine = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = mine.groupBy("root").agg(F.min("first").alias("first"))
    of = mine.select("fp", "root").join(least, "root").select("fp", "first")
    real = lambda c: F.when(F.col(c) != 2**63 - 1, F.col(c))
    return fp.join(of, "fp").select(real("k_id").alias("doc_id"), "k_id", "k_hash", "fp", real("first.k_id").alias("component_id"), (F.struct("k_id", "k_hash") == F.col("first")).alias("keeper"))


def _shingles(text: bytes, size: int) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def _verifier(size: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches, 100):
            keep = []
            for x, y in zip(C.texts(batch, "ta"), C.texts(batch, "tb"), strict=True):
                a, b = _shingles(x, size), _shingles(y, size)
                both = len(a & b)
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(docs: DataFrame, texts: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those *pairs* (a, b of k_hash) whose texts are similar."""
    wanted = pairs.select(F.col("a").alias("k_hash")).unionByName(pairs.select(F.col("b").alias("k_hash"))).distinct()
    # One row of each text is taken by its whole key, so that copies don't meet in one task; what is written once is
    # dealt out anew by the joins below, which may split a text that many are held against.
    keys = wanted.join(texts, "k_hash").select("k_id", "k_hash")
    taken = docs.select(*C.row_key(), F.coalesce("text", F.lit("")).alias("text")).join(keys, ["k_id", "k_hash"], "left_semi").dropDuplicates(["k_id", "k_hash"])
    body = C.materialize(taken.select("k_hash", "text"))
    of = lambda k: body.select(F.col("k_hash").alias(k), F.col("text").alias(f"t{k}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_verifier(words, similarity), "a long, b long")


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """The ascending 64-bit hashes of a text's different shingles of *size* words (fewer words: the whole sequence)."""
    words = text.lower().split()
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    return np.unique(C.ngram_hashes(np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64), size))


def _common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(ascending hashes, level): the shingles that recur most over all rows and how often, as a power of two.  They only say
    which shingles come last in the order of ``exact_pairs``; any order gives the same links.

    A task counts its shingles and sends those that it has seen twice, or that make up a share of 1 / (16 ORDER_SHINGLES) of
    what it has seen if that is more; so one with this share of all rows isn't missed, and what a task holds is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, seen, new, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, at = np.unique(np.concatenate([held, *new]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([counts, np.ones(size, np.int64)]), minlength=len(h)).astype(np.int64)
            keep = n >= max(2, -(-(seen + size) // (16 * ORDER_SHINGLES)))
            return h[keep], n[keep]

        for batch in batches:
            for x in C.texts(batch):
                new.append(shingle_hashes(x, words))
                size += len(new[-1])
                if size >= 1 << 20:
                    held, counts = merged()
                    seen, new, size = seen + size, [], 0
        held, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(counts)], names=["h", "n"])

    found = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 4").orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], np.log2(n[order]).astype(np.uint64)


def _prefixes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(k_id, k_hash, n, sketch, hs) of every row: how many shingles a text has, its sketch, and the first shingles in a
    fixed order, rare ones first: so many that two similar texts share one of them."""
    sent = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, level = sent.value
        for batch in C.sliced(batches):
            ns, sketches, hs = [], [], []
            for x in C.texts(batch):
                h = shingle_hashes(x, words)
                late = np.zeros(len(h), np.uint64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    late = np.where(common[at] == h, level[at], late)
                ns.append(len(h))
                odd = np.bincount((h % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
                sketches.append(np.packbits(odd.astype(np.uint8)).tobytes())
                hs.append(h[np.lexsort((h, late))[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]].view(np.int64))
            packed = C.lists(np.concatenate([[0], np.cumsum([len(h) for h in hs])]), pa.array(np.concatenate([np.zeros(0, np.int64), *hs])))
            yield pa.RecordBatch.from_arrays([batch.column("k_id"), batch.column("k_hash"), pa.array(ns, pa.int32()), pa.array(sketches, pa.binary()), packed], names=["k_id", "k_hash", "n", "sketch", "hs"])

    return docs.select(*C.row_key(), "text").mapInArrow(run, "k_id long, k_hash long, n int, sketch binary, hs array<long>")


def _strongest(part: np.ndarray, a: np.ndarray, b: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Which links (a, b) make up a spanning forest of the highest *rate* within each run of equal *part*."""
    keep, up = [], {}
    last = None
    for k in np.lexsort((-rate, part)).tolist():
        if part[k] != last:
            last, up = part[k], {}
        x, y = int(a[k]), int(b[k])
        while x in up:
            x = up[x]
        while y in up:
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
            keep.append(k)
    return np.array(keep, np.int64)


def _shared(similarity: float, one: bool = False, flush: int = 1 << 17):
    """Pairs of different roots within each run of equal ``part``, but those whose counts rule the similarity out: of
    the first shingle that two texts share, what comes behind bounds their overlap, as do the parities that differ.
    *one*: only a forest of the likeliest pairs over the roots of a run."""

    def out(part, root, node, n, pos, side, sketch):
        size = len(part)
        edge = np.flatnonzero(part[1:] != part[:-1]) + 1
        run = np.flatnonzero((part[1:] != part[:-1]) | (root[1:] != root[:-1])) + 1
        ends, runs = np.append(edge, size), np.append(run, size)
        stop = ends[np.searchsorted(edge, np.arange(size), "right")]
        start = runs[np.searchsorted(run, np.arange(size), "right")]
        found = [np.zeros((0, 2), np.int64)]
        total = stop - start
        for s in _slices(total, 1 << 18):
            i = np.repeat(np.arange(s.start, s.stop), total[s])
            j = start[i] + np.arange(len(i)) - np.repeat(np.cumsum(total[s]) - total[s], total[s])
            ok = (side[i] < 0) | (side[i] != side[j])
            i, j = i[ok], j[ok]
            both, most = n[i] + n[j], np.minimum(n[i] - pos[i], n[j] - pos[j])
            for bound in (most, None):  # the cheap bound first
                most = bound if bound is not None else np.minimum(most, (both - np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)) // 2)
                ok = most * (1 + similarity) + 1e-6 >= similarity * both
                i, j, most, both = i[ok], j[ok], most[ok], both[ok]
            if one and len(i):
                keep = _strongest(part[i], root[i], root[j], most / both)
                i, j = i[keep], j[keep]
            x, y = node[i], node[j]
            found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        columns = ["part", "root", "k_hash", "n", "pos", "side"]
        for batch in batches:
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            held.append([*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns), sketch])
            rows += batch.num_rows
            if rows >= flush:
                now = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(now[0], now[0][-1]))
                if cut:
                    yield out(*(x[:cut] for x in now))
                held, rows = [[x[cut:] for x in now]], len(now[0]) - cut
        if rows:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def shared_rows(docs: DataFrame, texts: DataFrame, roots: DataFrame, words: int, similarity: float, key_rows: int = SHARED_ROWS) -> tuple[DataFrame, DataFrame]:
    """((k_hash, pos, part, side), (k_hash, n, sketch)) of *texts*: what ``exact_pairs`` joins.

    Shingles under which only one root comes are left out before any pair is made; one of more than *key_rows* texts is
    dealt out as pairs of chunks."""
    mine = _prefixes(docs, words, similarity).join(texts.select("k_id", "k_hash"), ["k_id", "k_hash"], "left_semi").dropDuplicates(["k_id", "k_hash"])
    own = C.materialize(mine.join(roots.select(F.col("node").alias("k_hash"), "root"), "k_hash", "left").withColumn("root", F.coalesce("root", "k_hash")))
    at = own.select("k_hash", "root", F.posexplode("hs").alias("pos", "h"))
    many = at.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("h", F.ceil(F.col("c") / key_rows).cast("int").alias("c"))
    chunk = F.pmod(F.xxhash64("k_hash"), F.col("c")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: F.struct(F.least("chunk", j).alias("i"), F.greatest("chunk", j).alias("j")))
    spread = at.select("k_hash", "pos", "h").join(many, "h").withColumn("chunk", chunk).withColumn("pair", F.explode(pairs))
    side = F.when(F.col("pair.i") == F.col("pair.j"), -1).when(F.col("chunk") == F.col("pair.i"), 0).otherwise(1).cast("byte")
    return C.materialize(spread.select("k_hash", "pos", F.xxhash64("h", "pair.i", "pair.j").alias("part"), side.alias("side"))), own.select("k_hash", "n", "sketch")


def exact_pairs(rows: DataFrame, counts: DataFrame, roots: DataFrame, similarity: float, one: bool = False) -> DataFrame:
    """(a, b): every pair of texts under different *roots* (node, root; a text that isn't there is its own) that may
    have the similarity: by prefix filtering none is missed, whatever its fingerprints.  *one*: only a forest of the
    likeliest over the roots under a shingle."""
    under = counts.join(roots.select(F.col("node").alias("k_hash"), "root"), "k_hash", "left").withColumn("root", F.coalesce("root", "k_hash"))
    return rows.join(under, "k_hash").repartition("part").sortWithinPartitions("part", "root").mapInArrow(_shared(similarity, one), "a long, b long").distinct()


def similar_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8, budget: int = 7, key_rows: int = KEY_ROWS) -> DataFrame:
    """(k_id, k_hash, keeper) for every row of *docs*: keeper marks the row to keep of each group of near-duplicates.

    Two texts are linked if their sets of *words*-word shingles have a Jaccard similarity of *similarity* or more.
    First come links of a spanning forest of the fewest bits over fingerprints of the texts' different words, and texts
    of one fingerprint held against the first of them: cheap, and most copies are found so.  ``exact_pairs`` then gives
    all other pairs that may be similar and aren't connected yet, and these are compared too, so no group is left apart.
    """
    fp = C.materialize(fingerprints(docs, 1, True))
    texts = C.materialize(fp.groupBy("k_hash", "fp").agg(F.min("k_id").alias("k_id")))
    first = texts.groupBy("fp").agg(F.min("k_hash").alias("rep"))
    found = links(first.select("fp"), budget, key_rows, trie_forest).distinct()
    a, b = first.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), first.select(F.col("fp").alias("b"), F.col("rep").alias("rb"))
    far = found.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    near = texts.select("k_hash", "fp").join(first, "fp").where("k_hash <> rep").select(F.col("rep").alias("a"), F.col("k_hash").alias("b"))
    same = C.materialize(_verified(docs, texts, C.materialize(far.unionByName(near)), words, similarity))
    roots = components(same)
    rows, counts = shared_rows(docs, texts, roots, words, similarity)
    for one in (True, False):  # first a forest of the likeliest pairs, which links most groups; then all pairs that are left
        rest = C.materialize(exact_pairs(rows, counts, roots, similarity, one))
        same = same.unionByName(C.materialize(_verified(docs, texts, rest, words, similarity)))
        roots = components(same)
    roots = roots.withColumnRenamed("node", "k_hash")
    mine = fp.select("k_id", "k_hash").join(roots, "k_hash", "left").withColumn("root", F.coalesce("root", "k_hash"))
    least = mine.groupBy("root").agg(F.min(F.struct("k_id", "k_hash")).alias("first"))
    return mine.join(least, "root").select("k_id", "k_hash", (F.struct("k_id", "k_hash") == F.col("first")).alias("keeper"))


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, budget: int = 7) -> DataFrame:
    """*docs* with one row of each group of ``similar_texts``: the one of the smallest doc_id."""
    keep = similar_texts(docs, words, similarity, budget).where("keeper").select("k_id", "k_hash").distinct()
    mine = C.boxed(docs, *C.row_key()).join(keep, ["k_id", "k_hash"], "left_semi").dropDuplicates(["k_id", "k_hash"])
    return C.unboxed(mine, docs.columns)
