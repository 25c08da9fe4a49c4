"""Exact set-similarity join of texts by their word n-grams: a partition of the universe with pigeonhole and deletions.

Two texts are linked if the Jaccard similarity of their sets of *size*-word shingles is *percent* in a hundred or more, which
bounds the shingles that only one of them has.  Sizes are cut into bands so wide that similar sets lie in one band or in two
neighbours; a band's scheme takes the bound H of its largest sets, and hashes shingles into H + 1 segments.  Similar sets
agree in one segment at least, so each set is indexed by its shingles in every segment, under the scheme of its band and of
the next.  A segment may be left out where another one answers for two: there, each set is indexed by its one-deletion
neighbourhood as well, so that two sets which differ by one shingle meet.  Which segments are dropped and which answer for
two, is allocated band by band from what all rows cost: pairs that a segment's groups make, against signatures that
deletions add.

Equal sets are taken together first.  Every set is then held against one other, the smallest under most of its signatures, and
what links is united; then come forests of the likeliest pairs over what isn't connected under a signature, and at last all
pairs that are left, but those that sizes or 512-bit parity sketches rule out.  Every candidate is verified by the sets themselves, sent as ascending 64-bit hashes of shingles.  A group of more
than KEY_ROWS sets is dealt out as pairs of chunks.  No link between different groups is lost.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; a text of fewer words than a
shingle is one shingle; rows that share an id but not a text are told apart by the text's hash; repeated rows act as one; a
null id comes after all others, and a component of null ids alone has a null component_id; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .components import components
from .simhash import _strongest

#: Sets under one signature beyond which they are dealt out; most segments of a band that others answer for.
KEY_ROWS, SWAPS = 1000, 64
#: What a signature costs in terms of a pair within a group.
SIGNATURE_COST = 20
SKETCH_WORDS = 8
_SEGMENT, _TOKEN, _SCHEME = (np.uint64(x) for x in (0x8F14E45FCEEA167A, 0xC9F0F895FB98AB91, 0x45C48CCE2E2D7FBD))


class _Words(dict):
    """Hashes of words, each worked out once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes, size: int, words: dict[bytes, int]) -> np.ndarray:
    """The ascending 64-bit hashes of a text's different shingles."""
    seen = text.lower().split()
    if not seen:
        return np.zeros(0, np.uint64)
    return np.unique(C.ngram_hashes(np.array([words[w] for w in seen], np.uint64), min(size, len(seen))))


def bands(longest: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(first size of each band, H of its scheme) for sets of up to *longest* shingles, and one band more."""
    lows, slack, low = [], [], 1
    while not lows or lows[-1] <= longest:
        high = low * 100 // percent
        lows.append(low)
        slack.append((100 - percent) * 2 * high // (100 + percent))
        low = high + 1
    return np.array(lows, np.int64), np.array(slack, np.int64)


def _set_arrays(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    words = _Words()
    return [shingle_set(x, size, words) for x in C.texts(batch)]


def described(docs: DataFrame, size: int) -> DataFrame:
    """(k_id, k_hash, n, a, b, sketch) of every row: its set's size, 128-bit digest and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches):
            sets = _set_arrays(batch, size)
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in sets), np.int64).reshape(-1, 2)
            bits = np.zeros((len(sets), SKETCH_WORDS * 64), np.uint8)
            for k, h in enumerate(sets):
                bits[k] = np.bincount((h % np.uint64(SKETCH_WORDS * 64)).astype(np.int64), minlength=SKETCH_WORDS * 64) & 1
            sketch = pa.array(np.packbits(bits, axis=1).view(np.int64).reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k_id"), batch.column("k_hash"), pa.array([len(h) for h in sets], pa.int32()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), C.lists(np.arange(len(sets) + 1) * SKETCH_WORDS, sketch)],
                names=["k_id", "k_hash", "n", "a", "b", "sketch"],
            )

    return docs.select(*C.row_key(), "text").mapInArrow(run, "k_id long, k_hash long, n int, a long, b long, sketch array<long>")


def _segments(sets: list[np.ndarray], segments: np.ndarray, scheme: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, segment) of all segments of all sets, the sum of each over its shingles, and for each shingle the place of its
    segment and its summand."""
    h = np.concatenate([np.zeros(0, np.uint64), *sets])
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    base = np.concatenate([[0], np.cumsum(segments)])
    place = base[row] + (C.mix(h ^ _SEGMENT) % segments[row].astype(np.uint64)).astype(np.int64)
    token = C.mix(h ^ _TOKEN)
    sums = np.zeros(base[-1], np.uint64)
    np.add.at(sums, place, token)
    owner = np.repeat(np.arange(len(sets)), segments)
    return owner, np.arange(base[-1]) - base[owner], sums, place, token


def _signature(scheme: np.ndarray, segment: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return C.mix(sums + C.mix((scheme.astype(np.uint64) << np.uint64(32)) ^ segment.astype(np.uint64) ^ _SCHEME)).view(np.int64)


#: ``tag``: bit 0, the set is at home in the scheme's band; bit 1, the signature is of a whole segment; then the segment
#: and, from bit 34 on, the scheme.
_INDEX = "sig long, sid long, tag long"


def _indexer(size: int, lows: np.ndarray, slack: np.ndarray, twice: dict[int, list[int]] | None):
    """Signatures of sets: of whole segments, or (*twice*: segments of each band) of one-deletion neighbourhoods only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches, 200):
            sids, sets = batch.column("sid").to_numpy(), _set_arrays(batch, size)
            ns = np.array([len(h) for h in sets], np.int64)
            band = np.searchsorted(lows, ns, "right") - 1
            for up in (0, 1):
                scheme = band + up
                use = np.flatnonzero(slack[scheme] > 0 if twice is None else [int(k) in twice for k in scheme])
                if not len(use):
                    continue
                owner, segment, sums, place, token = _segments([sets[i] for i in use], slack[scheme[use]] + 1, scheme[use])
                if twice is not None:
                    chosen = np.zeros(len(owner), bool)
                    starts = np.searchsorted(owner, np.arange(len(use)))
                    for r, k in enumerate(scheme[use].tolist()):
                        chosen[starts[r] + np.array(twice[k], np.int64)] = True
                    mine = chosen[place]
                    owner, segment, sums = owner[place[mine]], segment[place[mine]], sums[place[mine]] - token[mine]
                who = use[owner]
                sig = _signature(scheme[who], segment, sums)
                tag = (scheme[who] << 34) | (segment << 2) | ((twice is None) << 1) | (not up)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(sids[who]), pa.array(tag)], names=["sig", "sid", "tag"])

    return run


def allocate(pairs: dict[int, float], sets: int, tokens: int, segments: int, swaps: int = SWAPS) -> tuple[list[int], list[int]]:
    """(dropped, twice) segments of one band's scheme: each dropped one is answered for by one of the other.  *pairs*: those
    that each segment's groups make (0 if it isn't there); *sets* and *tokens*: those that the scheme indexes."""
    dear = sorted(pairs, key=lambda i: (-pairs[i], i))
    cheap = [i for i in range(min(segments, len(pairs) + swaps)) if i not in pairs] + dear[::-1]
    dropped, twice = [], []
    for i, j in zip(dear[:swaps], cheap, strict=False):
        if i in twice or j in dropped or i == j or pairs[i] + SIGNATURE_COST * sets <= pairs.get(j, 0.0) + SIGNATURE_COST * tokens / segments:
            break
        dropped.append(i)
        twice.append(j)
    return dropped, twice


def _allocation(rows: DataFrame, counts: DataFrame, lows: np.ndarray, slack: np.ndarray) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    """Dropped and answering segments of every band, from the groups (``rows``) of all sets."""
    edges = F.array(*[F.lit(int(x)) for x in lows])
    of = counts.select(F.size(F.filter(edges, lambda e: e <= F.col("n"))).alias("above"), "n").select((F.col("above") - 1).alias("k"), "n")
    both = of.unionByName(of.select((F.col("k") + 1).alias("k"), "n"))
    load = {r.k: (r.sets, r.tokens) for r in both.groupBy("k").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")).collect()}
    costs = rows.selectExpr("sig", "int(shiftright(tag, 34)) AS k", "int(shiftright(tag & 17179869183, 2)) AS seg").groupBy("k", "seg", "sig").agg(F.count("*").alias("c")).groupBy("k", "seg").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs"))
    # Only segments that cost more than their signatures come to the driver, and of a band the dearest.
    worth = [k for k in load if k < len(slack) and slack[k] > 0]
    if not worth:
        return {}, {}
    least = F.element_at(F.create_map(*[x for k in worth for x in (F.lit(int(k)), F.lit(float(SIGNATURE_COST * (load[k][1] / (slack[k] + 1) - load[k][0]))))]), F.col("k"))
    top = costs.where(F.col("pairs") > least).groupBy("k").agg(F.slice(F.sort_array(F.collect_list(F.struct("pairs", "seg")), asc=False), 1, 4 * SWAPS).alias("dear")).collect()
    dropped, twice = {}, {}
    for r in top:
        out, more = allocate({x.seg: x.pairs for x in r.dear}, *load[r.k], int(slack[r.k]) + 1)
        if out:
            dropped[r.k], twice[r.k] = out, more
    return dropped, twice


def _groups(index: DataFrame, root: str) -> DataFrame:
    """(sig, lo, c) of the signatures under which different roots come, one of them whole and one at home; *root* is sid if
    every set is its own."""
    several = [F.max(root).alias("hi")] if root != "sid" else []  # a set comes once under a signature
    found = index.groupBy("sig").agg(F.min(root).alias("lo"), F.count("*").alias("c"), F.bit_or(F.col("tag").bitwiseAND(3)).alias("has"), *several)
    return found.where("has = 3 and " + ("lo <> hi" if several else "c > 1")).select("sig", "lo", "c")


def _met(index: DataFrame) -> DataFrame:
    """(sig, sid, tag, lo): the rows of *index* whose signature other sets have, too, and the smallest of its sets."""
    return C.materialize(index.join(_groups(index, "sid").select("sig", "lo"), "sig"))


def _bounded(pairs: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """Those *pairs* (x, y of sid) that sizes and sketches don't rule out."""
    of = lambda k: counts.select(F.col("sid").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    both = pairs.join(of("x"), "x").join(of("y"), "y")
    apart = sum((F.bit_count(F.col("sx")[k].bitwiseXOR(F.col("sy")[k])) for k in range(SKETCH_WORDS)), F.lit(0))
    total = (F.col("nx") + F.col("ny")).cast("long")
    fits = (100 * F.least("nx", "ny").cast("long") >= percent * F.greatest("nx", "ny").cast("long")) & (apart * (100 + percent) <= (100 - percent) * total)
    return both.where(fits).select("x", "y")


def _verified(texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The links (a, b) among *pairs* (x, y)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches, 200):
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array([h.tobytes() for h in _set_arrays(batch, size)], pa.binary())], names=["sid", "hs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches, 100):
            keep = []
            for x, y in zip(batch.column("hx"), batch.column("hy"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("x").alias("sid")).unionByName(pairs.select(F.col("y").alias("sid"))).distinct()
    body = C.materialize(texts.select("sid", "text").join(wanted, "sid", "left_semi").mapInArrow(hashed, "sid long, hs binary"))
    of = lambda k: body.select(F.col("sid").alias(k), F.col("hs").alias(f"h{k}"))
    return pairs.join(of("x"), "x").join(of("y"), "y").mapInArrow(run, "a long, b long")


def _pairer(percent: int, one: bool, flush: int = 1 << 17):
    """Pairs of different roots within each run of equal ``part`` that sizes and sketches don't rule out; *one*: only those of
    a spanning forest over a run's roots, of sets with the fewest differing parities."""

    def out(part, root, sid, n, side, tag, sketch):
        size = len(part)
        edge = np.flatnonzero(part[1:] != part[:-1]) + 1
        run = np.flatnonzero((part[1:] != part[:-1]) | (root[1:] != root[:-1])) + 1
        ends, runs = np.append(edge, size), np.append(run, size)
        stop, start = ends[np.searchsorted(edge, np.arange(size), "right")], runs[np.searchsorted(run, np.arange(size), "right")]
        found, total = [np.zeros((0, 2), np.int64)], stop - start
        sums, lo = np.cumsum(total), 0
        while lo < size:
            hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + (1 << 19), "right")))
            t = total[lo:hi]
            i = np.repeat(np.arange(lo, hi), t)
            j = start[i] + np.arange(len(i)) - np.repeat(np.cumsum(t) - t, t)
            both = n[i] + n[j]
            ok = ((side[i] < 0) | (side[i] != side[j])) & ((tag[i] | tag[j]) & 3 == 3) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j, both = i[ok], j[ok], both[ok]
            apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
            ok = apart * (100 + percent) <= (100 - percent) * both
            i, j, rate = i[ok], j[ok], -apart[ok] / both[ok]
            if one and len(i):
                best = np.lexsort((-rate, root[j], root[i], part[i]))  # of two roots, the likeliest pair
                i, j, rate = i[best], j[best], rate[best]
                new = np.ones(len(i), bool)
                new[1:] = (root[i[1:]] != root[i[:-1]]) | (root[j[1:]] != root[j[:-1]]) | (part[i[1:]] != part[i[:-1]])
                i, j, rate = i[new], j[new], rate[new]
                keep = _strongest(part[i], root[i], root[j], rate)
                i, j = i[keep], j[keep]
            x, y = sid[i], sid[j]
            found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0))
            lo = hi
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            sketch = batch.column("sketch").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)
            held.append([*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "root", "sid", "n", "side", "tag")), sketch])
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


def _left(rows: DataFrame, counts: DataFrame, roots: DataFrame, percent: int, one: bool, key_rows: int) -> DataFrame:
    """(x, y): pairs under one signature of ``rows`` that *roots* (node, root; a set that isn't there is its own) don't
    connect; *one*: only a forest of the likeliest over the roots under a signature."""
    under = C.materialize(rows.select("sig", "sid", "tag").join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    many = _groups(under, "root").select("sig", F.ceil(F.col("c") / key_rows).cast("int").alias("c"))
    chunk = F.pmod(F.xxhash64("sid"), F.col("c")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: F.struct(F.least("chunk", j).alias("i"), F.greatest("chunk", j).alias("j")))
    spread = under.join(many, "sig").withColumn("chunk", chunk).withColumn("pair", F.explode(pairs))
    side = F.when(F.col("pair.i") == F.col("pair.j"), -1).when(F.col("chunk") == F.col("pair.i"), 0).otherwise(1).cast("byte")
    dealt = spread.select(F.xxhash64("sig", "pair.i", "pair.j").alias("part"), "root", "sid", side.alias("side"), F.col("tag").bitwiseAND(3).alias("tag")).join(counts, "sid")
    return dealt.repartition("part").sortWithinPartitions("part", "root").mapInArrow(_pairer(percent, one), "x long, y long").distinct()


def similar_sets(docs: DataFrame, size: int = 3, percent: int = 90, key_rows: int = KEY_ROWS) -> DataFrame:
    """(k_id, k_hash, n, least) for every row of *docs* (doc_id, text): the size of its set, and the smallest id that links of
    *percent* similarity or more reach."""
    mine = C.materialize(described(docs, size))
    longest = mine.agg(F.max("n")).first()[0] or 0
    lows, slack = bands(longest, percent)
    first = mine.where("n > 0").groupBy("a", "b").agg(F.min(F.struct("k_id", "k_hash")).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("a", "b", "n", "sketch", "first.*")
    keyed = docs.select(*C.row_key(), "text").join(first.select("k_id", "k_hash"), ["k_id", "k_hash"], "left_semi").dropDuplicates(["k_id", "k_hash"])
    # One row a set; its number is fixed by being written.
    texts = C.materialize(keyed.withColumn("sid", F.monotonically_increasing_id()))
    counts = C.materialize(texts.select("k_id", "k_hash", "sid").join(first, ["k_id", "k_hash"]).select("sid", "a", "b", "n", "sketch"))
    sized = counts.select("sid", "n", "sketch")

    index = C.materialize(texts.select("sid", "text").mapInArrow(_indexer(size, lows, slack, None), _INDEX))
    rows = _met(index)
    dropped, twice = _allocation(rows, counts, lows, slack)
    if dropped:
        gone = F.array(*[F.lit((int(k) << 32) | int(i)) for k, ss in dropped.items() for i in ss])
        plain = index.where(~F.array_contains(gone, F.shiftright("tag", 2)))
        rows = _met(C.materialize(plain.unionByName(texts.select("sid", "text").mapInArrow(_indexer(size, lows, slack, twice), _INDEX))))
    # First every set is held against one other, the smallest under most of its signatures; then forests of the likeliest pairs
    # over what isn't connected; then all pairs that are left.
    star = rows.where("lo <> sid").groupBy("sid", "lo").agg(F.count("*").alias("c")).groupBy("sid").agg(F.max_by("lo", F.struct("c", -F.col("lo"))).alias("lo"))
    links = C.materialize(_verified(texts, C.materialize(_bounded(star.select(F.col("lo").alias("x"), F.col("sid").alias("y")), sized, percent)), size, percent))
    roots = components(links)
    for one in (True, False):
        rest = C.materialize(_left(rows, sized, roots, percent, one, key_rows))
        if rest.isEmpty():
            break
        links = links.unionByName(C.materialize(_verified(texts, rest, size, percent)))
        roots = components(links)
    of = counts.select("a", "b", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("a", "b", F.coalesce("root", "sid").alias("root"))
    placed = mine.select("k_id", "k_hash", "n", "a", "b").join(of, ["a", "b"], "left")
    least = placed.where("root is not null").groupBy("root").agg(F.min("k_id").alias("least"))
    return placed.join(least, "root", "left").select("k_id", "k_hash", "n", F.coalesce("least", "k_id").alias("least"))


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of *docs*."""
    real = lambda c: F.when(F.col(c) != 2**63 - 1, F.col(c))
    return similar_sets(docs, size, percent).select(real("k_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), real("least").alias("component_id"))
