"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of words with smallest period q that is at least twice q (and *shortest* words) long and that no
neighbouring word extends.  Each text's factors of 1, 2, 4, 8 ... words get names, a length from the one before it, and
only factors that occur again in their text are named, so the work ends with the longest repeat.  For factors of L words,
occurrences at most L/2 apart make up an arithmetic progression (the factor is periodic there).  A run whose period q lies
in [L, 2L) starts with such a factor, which occurs again q words on: either as the first of its progression, or, if the
progression that the run starts in ends inside the first period, then the last elements of both progressions are q apart.
So it is enough that every occurrence proposes the distances to first elements, and each last element those to last
elements, between L and 2L words on: a bounded number for each word and length.  A proposal is extended both ways by
comparing names from the longest down, and runs found more than once, or with a multiple of their period, are kept once.

Everything happens within a text, so nothing is shuffled; texts are taken together up to CHUNK_WORDS words.  A text of n
words takes some 4 n log2(longest repeat) bytes for its names.

Defined cases: null, empty and blank texts have no words and no runs, and collapse to an empty text; repeated rows each get
their result; other columns pass through, but those named like a result (``runs``, ``collapsed``) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _common as C

#: Words of the texts that are handled together (a longer text is alone).
CHUNK_WORDS = 1 << 17
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _named(at: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, group, names): those of *at* whose key occurs twice or more, sorted by key and position, the group of
    each, and for all n + 1 positions the group's number or -1."""
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    again = ~new
    again[:-1] |= ~new[1:]
    at, group = at[again], np.cumsum(new[again]) - 1
    names = np.full(n + 1, -1, np.int32)
    names[at] = group
    return at, group, names


def _proposals(at: np.ndarray, group: np.ndarray, length: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period): what the occurrences of factors of *length* words propose as periods in [length, 2 length)."""
    key = group.astype(np.int64) * (n + 1) + at
    gap = np.full(len(at) + 1, 4 * n + 4, np.int64)  # to the occurrence before each, and at the end
    if len(at) > 1:
        gap[1:-1] = np.where(group[1:] == group[:-1], at[1:] - at[:-1], gap[0])
    first, last = 2 * gap[:-1] > length, 2 * gap[1:] > length
    near = gap[1:] < 2 * length
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for heads, froms in ((key[first], np.flatnonzero(near)), (key[last], np.flatnonzero(near & last))):
        base = key[froms] - at[froms]
        stop = base + np.minimum(at[froms] + 2 * length, n)
        k = np.searchsorted(heads, base + np.minimum(at[froms] + length, n))
        while len(froms):
            live = k < len(heads)
            live[live] = heads[k[live]] < stop[live]
            froms, stop, k = froms[live], stop[live], k[live]
            found.append((at[froms], heads[k] - key[froms]))
            k = k + 1
    where, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((where, period))
    where, period = where[order], period[order]
    # One that begins inside the stretch which the one before it of the same period vouches for, extends to the same run.
    alone = np.ones(len(where), bool)
    alone[1:] = (period[1:] != period[:-1]) | (where[1:] - where[:-1] > length)
    return where[alone], period[alone]


def _extended(levels: list[np.ndarray], where: np.ndarray, period: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the longest stretch of each period around each position."""
    right, left = where.copy(), where.copy()
    for k in range(len(levels) - 1, -1, -1):
        names, step = levels[k], 1 << k
        mine = names[np.minimum(right, n)]
        right = right + step * ((mine >= 0) & (mine == names[np.minimum(right + period, n)]))
        back = left - step
        mine = np.where(back >= 0, names[np.maximum(back, 0)], -1)
        left = left - step * ((mine >= 0) & (mine == names[np.clip(back + period, 0, n)]))
    return left, right + period


def runs_of(ids: np.ndarray, offs: np.ndarray, shortest: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of all runs, by start and period, of texts that lie at *offs* of *ids*; words are equal if
    their ids are, and words of different texts never have the same id."""
    n = len(ids)
    ends = np.repeat(offs[1:], np.diff(offs))
    at, group, names = _named(np.arange(n), ids, n)
    levels, proposed, length = [], [], 1
    while len(at):
        levels.append(names)
        proposed.append(_proposals(at, group, length, n))
        next_ = np.sort(at)
        next_ = next_[next_ + length < ends[next_]]
        next_ = next_[names[next_ + length] >= 0]
        at, group, names = _named(next_, names[next_].astype(np.int64) * (n + 1) + names[next_ + length], n)
        length *= 2
    if not proposed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    where, period = (np.concatenate(x) for x in zip(*proposed, strict=True))
    start, stop = _extended(levels, where, period, n)
    good = stop - start >= np.maximum(2 * period, shortest)
    start, stop, period = start[good], stop[good], period[good]
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    new = np.ones(len(start), bool)  # of one stretch, its smallest period
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[new], stop[new], period[new]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def _chunks(rows: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of each row) of texts that have about CHUNK_WORDS words together."""
    held, size, lo = [], 0, 0
    for k, text in enumerate(rows):
        words = text.split()
        if held and size + len(words) > CHUNK_WORDS:
            yield lo, held
            held, size, lo = [], 0, k
        held.append(words)
        size += len(words)
    if held:
        yield lo, held


def runs_of_texts(rows: list[bytes], shortest: int = 12) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text its runs (start, length, period) and what is left when each run keeps its first period only."""
    for _, texts in _chunks(rows):
        offs = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        ids, base = np.empty(offs[-1], np.int64), 0
        for k, words in enumerate(texts):
            seen: dict[bytes, int] = {}
            ids[offs[k] : offs[k + 1]] = [seen.setdefault(w, len(seen)) for w in words]
            ids[offs[k] : offs[k + 1]] += base
            base += len(seen)
        start, stop, period = runs_of(ids, offs, shortest)
        cut = np.searchsorted(start, offs)
        for k, words in enumerate(texts):
            a, b, q = (x[cut[k] : cut[k + 1]] for x in (start, stop, period))
            if not len(a):
                yield [], b" ".join(words)
                continue
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, a + q - offs[k], 1)
            np.add.at(depth, b - offs[k], -1)
            kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
            yield list(zip((a - offs[k]).tolist(), (b - a).tolist(), q.tolist(), strict=True)), b" ".join([words[i] for i in kept.tolist()])


def periodic_runs(docs: DataFrame, shortest: int = 12) -> DataFrame:
    """*docs* with ``runs`` (array of start, length and period in words, by start and period) and ``collapsed`` (the words,
    joined by blanks, without those that a run contains after its first period)."""
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("runs", "collapsed")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches, 200):
            found = list(runs_of_texts(C.texts(batch), shortest))
            flat = np.array([r for rs, _ in found for r in rs], np.int64).reshape(-1, 3)
            each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            runs = C.lists(np.concatenate([[0], np.cumsum([len(rs) for rs, _ in found])]), each)
            yield pa.RecordBatch.from_arrays([*batch.columns, runs, pa.array([c.decode("utf-8", "replace") for _, c in found], pa.string())], names=[*batch.schema.names, "runs", "collapsed"])

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{plain}, runs array<{RUN}>, collapsed string")
