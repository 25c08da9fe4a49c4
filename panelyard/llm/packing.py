"""Best-fit packing of documents into token sequences by a linear grouping scheme.

Documents are tokenised and, where longer than a sequence, cut into pieces.  How many pieces have each length
is all that the plan needs: a table of at most ``capacity`` rows, whatever the corpus, and the only thing that
reaches the driver.  There large lengths are put into groups of equal cardinality, each rounded up to its
group's longest; a linear programme over configurations of these few sizes is solved by column generation;
the configurations get actual lengths in place of rounded ones, and the rest is grouped and solved again; what
that leaves over and the small lengths go best-fit into the gaps.  Sequences that hold the same lengths are
planned as one class with a count, so the plan's size depends on ``capacity`` alone.  Pieces of a length are then
numbered without any large group (rows of the written pieces get a salt by their place in the files; numbers within
a length and a salt, plus the counts of smaller salts) and looked up in the plan.

Defined cases: null and empty texts are one piece of just the end token; repeated rows are pieces each; null
ids are kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as C

CAPACITY = 4096
END_ID = 1
#: Most words (and most stems) whose ids a worker remembers, twice at the turn of a generation.
CACHE_WORDS = 250_000
GROUPS = 48
#: Lengths above this share of a sequence are large; this share of the programme's solution is carried out at a time.
LARGE, SHARE = 1 / 3, 0.3


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


#: Marks that end many words; a run of them behind an ASCII letter or digit is always a token run of its own.
_MARKS = b",.!?;:$%&*#|"


def _byte_chars() -> list[str]:
    """The byte alphabet of byte-level models: printable bytes stand for themselves, others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_BYTE_CHARS = _byte_chars()


class _Memory:
    """A dict of bounded size: when full, what wasn't used since the last time goes."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys: set[bytes], room: int = 0) -> list[bytes]:
        """The keys that aren't known; the others are in ``new`` from now on.  *room*: for how many more there must be place."""
        if len(self.new) + max(room, len(keys)) > self.most:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        out = []
        for k in keys:
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    out.append(k)
        return out


class WordEncoder:
    """Ids of whole texts by a tokenizer that lower-cases, drops white space and never joins across it.

    Each stretch between ASCII white space is encoded once and remembered, and so is what is left of it without
    trailing marks.  Stretches of ASCII letters are one token run each, so the model alone encodes them.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        self.tokenizer, self.words, self.stems = _tokenizer(path), _Memory(most), _Memory(most)

    def _ids(self, stem: bytes) -> bytes:
        """The ids of one stretch."""
        if stem.isalpha():
            ids = [t.id for t in self.tokenizer.model.tokenize(stem.decode())]
        elif (word := stem.decode()).isalpha() and max(word) < "\u0250" and "\u0130" not in word:
            # Latin letters: composed and one to one in lower case, so only the model's byte alphabet is left to apply.
            ids = [t.id for t in self.tokenizer.model.tokenize("".join([_BYTE_CHARS[x] for x in word.lower().encode()]))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        self.stems.missing(set(words[:1]), len(words))
        new, old, out = self.stems.new, self.stems.old, self.words.new
        for w in words:
            low = w.lower()
            stem = low.rstrip(_MARKS)
            if len(stem) == len(low) or not stem[-1:].isalnum():
                stem, tail = low, None
            else:
                tail = low[len(stem) :]
            ids = new.get(stem) or old.get(stem) or self._ids(stem)
            new[stem] = ids
            if tail is not None:
                more = new.get(tail) or old.get(tail) or self._ids(tail)
                new[tail] = more
                ids += more
            out[w] = ids

    def encode(self, texts: list[bytes], end_id: int) -> list[bytes]:
        """Each text's ids and *end_id*, as little-endian 32-bit numbers."""
        words = [t.split() for t in texts]
        if new := self.words.missing({w for ws in words for w in ws}):
            self._learn(new)
        end, known = end_id.to_bytes(4, "little"), self.words.new
        return [b"".join([known[w] for w in ws]) + end for ws in words]


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """The worker's encoder; what it knows serves later tasks, too."""
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of at most *capacity* ids of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in C.sliced(batches):
            rows, cells, raw = [], [], C.texts(batch)
            for lo in range(0, len(raw), 256):
                for k, ids in enumerate(encoder.encode(raw[lo : lo + 256], end_id), lo):
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((k, p, at // 4, len(part) // 4, zlib.crc32(part)))
                        if with_ids:
                            cells.append(np.frombuffer(part, "<u4").astype(np.int32))
            of, piece, start, length, crc = np.array(rows, np.int64).reshape(-1, 5).T
            out = [pc.take(batch.column("doc_id"), pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(C.lists(np.concatenate([[0], np.cumsum(length)]), pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


# --- the plan: lengths and counts only ------------------------------------------


def _linear_grouping(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths from long to short in runs (length, count), cut into groups of equal cardinality."""
    total = sum(counts.values())
    size = max(1, -(-total // groups))
    out, room = [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = size
            take = min(left, room)
            out[-1].append((length, take))
            left, room = left - take, room - take
    return out


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the highest worth.  *sizes* ascend and are over a quarter of a sequence, so it holds three
    at most: two are tried in every way, and behind each the best third one that fits."""
    best = np.maximum.accumulate(worth)
    where = np.maximum.accumulate(np.where(np.append(True, best[1:] > best[:-1]), np.arange(len(worth)), 0))

    def with_last(room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(sizes, room, "right") - 1
        return np.where(k >= 0, best[np.maximum(k, 0)], 0.0), np.where(k >= 0, where[np.maximum(k, 0)], -1)

    pair_room = capacity - sizes[:, None] - sizes[None, :]
    third, which = with_last(pair_room)
    two = np.where(pair_room >= 0, worth[:, None] + worth[None, :] + third, -1.0)
    second, other = with_last(capacity - sizes)
    one = worth + second
    i, j = divmod(int(np.argmax(two)), len(sizes))
    k = int(np.argmax(one))
    chosen = [i, j, which[i, j]] if two[i, j] >= one[k] else [k, other[k]]
    config = np.zeros(len(sizes), np.int64)
    np.add.at(config, [x for x in chosen if x >= 0], 1)
    return float(max(two[i, j], one[k])), config


def configurations(sizes: list[int], need: list[int], capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Configurations of the ascending *sizes* and how often the linear programme uses each, by column generation."""
    s, n = np.array(sizes), np.array(need, float)
    columns = np.diag(capacity // s).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(columns)
        value, config = _best_configuration(s, np.maximum(inverse.sum(axis=0), 0), capacity)
        if value <= 1 + 1e-9:
            break
        x, step = inverse @ n, inverse @ config
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        columns[:, int(np.argmin(ratio))] = config
    x = np.linalg.solve(columns, n)
    return [(columns[:, k].astype(np.int64), float(x[k])) for k in range(len(s)) if x[k] >= 1 - 1e-9]


class _Class:
    """*n* sequences alike: (length, first number among its length, how many a sequence) each, and free room."""

    __slots__ = ("n", "parts", "gap")

    def __init__(self, n: int, parts: list[tuple[int, int, int]], gap: int):
        self.n, self.parts, self.gap = n, parts, gap

    def split(self, m: int) -> _Class:
        """Keep the first m sequences, give the rest."""
        rest = _Class(self.n - m, [(size, first + m * t, t) for size, first, t in self.parts], self.gap)
        self.n = m
        return rest


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE, share: float = SHARE) -> list[_Class]:
    """Classes of sequences that hold counts[length] pieces of each length.

    Large lengths are grouped and solved again and again: each time *share* of what the programme uses of every
    configuration is made up of actual lengths.  A slot takes the longest piece that leaves room for the rounded sizes
    still to come, so what rounding saved in one slot serves the next, and room for one more large piece is used.  When
    no configuration comes out any more, what is left and all small lengths go best-fit into the gaps."""
    if not 1 / 4 <= large < 1:
        raise ValueError("large must be a quarter at least and less than 1")
    counts = {k: v for k, v in counts.items() if v}
    used = dict.fromkeys(counts, 0)  # pieces of each length that have a place
    left = {k: v for k, v in counts.items() if k > large * capacity}
    lengths = sorted(left)
    classes: list[_Class] = []

    def longest(most: int, taken: dict[int, int]) -> int | None:
        """The longest length of *most* at most that has a piece besides those *taken*."""
        k = bisect.bisect_right(lengths, most) - 1
        while k >= 0 and left[lengths[k]] <= taken.get(lengths[k], 0):
            k -= 1
        return lengths[k] if k >= 0 else None

    def fill(slots: list[int]) -> tuple[dict[int, int], int]:
        """Actual lengths for the rounded *slots* (none if a slot finds no piece), and the room that is left."""
        taken: dict[int, int] = {}
        room = capacity
        for k in range(len(slots)):
            if (size := longest(room - sum(slots[k + 1 :]), taken)) is None:
                return {}, room
            taken[size] = taken.get(size, 0) + 1
            room -= size
        while (size := longest(room, taken)) is not None:
            taken[size] = taken.get(size, 0) + 1
            room -= size
        return taken, room

    done = len(lengths)
    while done:
        done = 0
        need: dict[int, int] = {}  # pieces by their group's longest length
        for runs in _linear_grouping({k: left[k] for k in lengths}, groups):
            need[runs[0][0]] = need.get(runs[0][0], 0) + sum(n for _, n in runs)
        sizes = sorted(need)
        found = [(np.repeat(sizes, config)[::-1].tolist(), max(1, int(n * share))) for config, n in (configurations(sizes, [need[k] for k in sizes], capacity) if sizes else [])]
        for slots, n in sorted(found, reverse=True):
            while n:
                taken, room = fill(slots)
                if not taken:
                    break
                m = min([n, *(left[size] // t for size, t in taken.items())])  # so many sequences alike
                classes.append(_Class(m, [(size, used[size], t) for size, t in taken.items()], room))
                for size, t in taken.items():
                    used[size] += m * t
                    left[size] -= m * t
                    if not left[size]:
                        lengths.remove(size)
                n -= m
                done += m
    return _best_fit(classes, {k: counts[k] - used[k] for k in counts}, used, capacity)


def _best_fit(classes: list[_Class], rest: dict[int, int], used: dict[int, int], capacity: int) -> list[_Class]:
    """Put what has no place yet, from long to short, where the least room is left."""
    by_gap: dict[int, list[_Class]] = {}
    for c in classes:
        by_gap.setdefault(c.gap, []).append(c)
    gaps = sorted(by_gap)
    full: list[_Class] = []

    def put(c: _Class) -> None:
        if c.gap <= 0:
            full.append(c)
            return
        if c.gap not in by_gap:
            bisect.insort(gaps, c.gap)
        by_gap.setdefault(c.gap, []).append(c)

    for size in sorted(rest, reverse=True):
        n = rest[size]
        while n:
            k = bisect.bisect_left(gaps, size)
            if k == len(gaps):
                fit = capacity // size
                c = _Class(max(1, n // fit), [], capacity)
            else:
                gap = gaps[k]
                c = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap]
                    gaps.pop(k)
            t = min(c.gap // size, n)
            m = min(c.n, n // t)
            if m < c.n:
                put(c.split(m))
            c.parts.append((size, used[size], t))
            used[size] += m * t
            n -= m * t
            c.gap -= t * size
            put(c)
    return full + [c for cs in by_gap.values() for c in cs]


def placements(classes: list[_Class]) -> np.ndarray:
    """Rows (length, first number, sequences, pieces a sequence, first sequence, offset), sorted by length and number."""
    rows, sequence = [], 0
    for c in classes:
        at = 0
        for size, first, t in c.parts:
            rows.append((size, first, c.n, t, sequence, at))
            at += size * t
        sequence += c.n
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def _placer(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, each, sequence, offset = table.value.T
        key = (length.astype(np.uint64) << np.uint64(44)) + first.astype(np.uint64)
        for batch in batches:
            size, number = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "number"))
            k = np.searchsorted(key, (size.astype(np.uint64) << np.uint64(44)) + number.astype(np.uint64), "right") - 1
            inside = number - first[k]
            new = {"sequence_id": pa.array(sequence[k] + inside // each[k]), "offset": pa.array(offset[k] + inside % each[k] * size)}
            keep = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new.values()], names=[*keep, *new])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS, large: float = LARGE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a place for every piece of every row's text."""
    spark = docs.sparkSession
    cut = C.materialize(pieces(docs, tokenizer, capacity, end_id))
    # Rows of the written table are numbered: its file and the row's place there tell even equal rows apart.
    place = [F.col("_metadata.file_name").alias("k_file"), F.col("_metadata.row_index").alias("k_row")]
    salts = max(64, math.isqrt(cut.count()))
    salted = cut.select(*cut.columns, *place).withColumn("salt", F.pmod(F.xxhash64("k_file", "k_row"), F.lit(salts)))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most *capacity* rows
    table = spark.sparkContext.broadcast(placements(plan(counts, capacity, groups, large)))
    before = sums.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    mine = F.row_number().over(Window.partitionBy("length", "salt").orderBy("k_file", "k_row"))
    numbered = salted.withColumn("mine", mine).join(before, ["length", "salt"])
    numbered = numbered.select(*cut.columns, (F.col("before") + F.col("mine") - 1).alias("number"))
    return numbered.mapInArrow(_placer(table), cut.schema.add("sequence_id", "long").add("offset", "long"))
