"""Secret scans: fixed patterns, and formats learned by grammar inference.

The base patterns find assignments, access keys and long hex strings.  Their values are labelled credentials;
every other credential-like token (a run of 12 or more of ``A-Za-z0-9+/_.=-`` with a digit, not touching a base
span) is background.  Tokens are abstracted to shapes (a class a character), which are counted over the whole
corpus.  For each label a prefix tree of its shapes is generalised by merging states whose outgoing and final
frequencies are compatible (Hoeffding bound), which gives a probabilistic automaton.  Every candidate, base
values too, is then scored by the best label's log-likelihood less the background's; background tokens over
``min_odds`` are added as spans of kind ``format``.  Base spans always stay.

Both passes are narrow Python stages; between them only counts by label and shape are shuffled, combined in
each task first.  The driver learns from at most ``max_shapes`` labelled shapes a label, with at most
``max_symbols`` characters: half of them are the most frequent, the others are drawn by a hash from all the rest
and weighted so that they stand for all of it.  A shape longer than what is left of the characters is passed over alone.

Defined cases: null and empty texts have no spans; repeated rows each get theirs; an empty table gives no rows;
without any labelled credential only base spans are found, without scores; further columns are ignored by
``find_secrets`` and kept by ``redact``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import _common as C

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(rb"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "format"]
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH, CANDIDATE_LENGTH = 8, 16, 32, 12
MAX_SHAPES, MAX_SYMBOLS, MIN_ODDS, ALPHA = 5000, 400_000, 3.0, 0.05
_UNSEEN = math.log(1e-6)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars, np.uint8)] = True
    return t


_DIGIT = _table(b"0123456789")
_TOKEN = _table(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_.=-")
_SHAPES = [(b"0123456789", "d"), (b"0123456789abcdef", "h"), (b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "u")]


def shape(token: bytes) -> str:
    """One symbol a character: punctuation and capitals among the first four stand for themselves; the rest by
    the narrowest alphabet that holds the token's letters and digits: d digits, h hex, u capitals, m mixed."""
    plain = token.translate(None, b"+/_.=-")
    kind = next((k for chars, k in _SHAPES if not plain.translate(None, chars)), "m")
    return "".join(chr(b) if b in b"+/_.=-" or (i < 4 and 65 <= b <= 90) else kind for i, b in enumerate(token))


def base_spans(raw: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, end, kind, value) of the base patterns' matches, in bytes, by start and then kind."""
    out, low = [], raw.lower()
    if any(k in low for k in (b"passw", b"secret", b"token", b"api")):
        out += [(m.start(), m.end(), 0, m[1]) for m in ASSIGN.finditer(raw) if len(m[1]) >= ASSIGN_VALUE]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(raw) if len(m[0]) >= ACCESS_LENGTH]
    return out


def _hex_runs(data: np.ndarray, offs: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of maximal runs of *least* or more bytes of *table*; runs don't cross texts."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


_HEX = _table(b"0123456789abcdef")


def chunk_spans(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, bytes, list, list]]:
    """For every text of a chunk with any: (row, bytes, base spans, candidates as (start, end))."""
    rows: dict[int, tuple[list, list]] = {}
    whole = data.tobytes()
    for r in range(len(offs) - 1):
        if got := base_spans(whole[offs[r] : offs[r + 1]]):
            rows[r] = (got, [])
    for a, b, r in zip(*(x.tolist() for x in _hex_runs(data, offs, _HEX, HEX_LENGTH)), strict=True):
        at = int(offs[r])
        rows.setdefault(r, ([], []))[0].append((a - at, b - at, 2, whole[a:b]))
    starts, ends, of = _hex_runs(data, offs, _TOKEN, CANDIDATE_LENGTH)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    some = digits[ends] > digits[starts]
    for a, b, r in zip(starts[some].tolist(), ends[some].tolist(), of[some].tolist(), strict=True):
        at, (base, found) = int(offs[r]), rows.setdefault(r, ([], []))
        if not any(s < b - at and a - at < e for s, e, *_ in base):
            found.append((a - at, b - at))
    for r, (base, found) in sorted(rows.items()):
        yield r, whole[offs[r] : offs[r + 1]], sorted(base, key=lambda x: (x[0], x[2], x[1])), found


# --- grammar inference ------------------------------------------------------------


class Automaton:
    """A probabilistic deterministic automaton: moves[state][symbol] = (state, log p), ends[state] = log p."""

    def __init__(self, moves: list[dict[str, tuple[int, float]]], ends: list[float]):
        self.moves, self.ends = moves, ends

    def score(self, symbols: str) -> float:
        """The log-likelihood; a symbol or an end that was never seen costs a fixed amount and stays."""
        state, total = 0, 0.0
        for s in symbols:
            to = self.moves[state].get(s)
            if to is None:
                total += _UNSEEN
            else:
                state, p = to
                total += p
        return total + self.ends[state]


def infer(counts: dict[str, float], alpha: float = ALPHA) -> Automaton:
    """Generalise the prefix tree of *counts* by merging compatible states, from the root on."""
    seen, final, moves, used = [0], [0], [{}], [{}]
    for text, n in sorted(counts.items()):
        at = 0
        seen[0] += n
        for s in text:
            if s not in moves[at]:
                moves[at][s] = len(seen)
                seen.append(0)
                final.append(0)
                moves.append({})
                used.append({})
            used[at][s] = used[at].get(s, 0) + n
            at = moves[at][s]
            seen[at] += n
        final[at] += n
    slack = math.sqrt(0.5 * math.log(2 / alpha))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            bound = slack * (seen[a] ** -0.5 + seen[b] ** -0.5)
            if abs(final[a] / seen[a] - final[b] / seen[b]) > bound:
                return False
            for s in {*used[a], *used[b]}:
                if abs(used[a].get(s, 0) / seen[a] - used[b].get(s, 0) / seen[b]) > bound:
                    return False
                if s in moves[a] and s in moves[b]:
                    todo.append((moves[a][s], moves[b][s]))
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            seen[a] += seen[b]
            final[a] += final[b]
            for s, n in used[b].items():
                used[a][s] = used[a].get(s, 0) + n
                if s in moves[a]:
                    todo.append((moves[a][s], moves[b][s]))
                else:
                    moves[a][s] = moves[b][s]

    kept, known = [0], {0}
    while True:
        fringe = [(r, s) for r in kept for s in sorted(moves[r]) if moves[r][s] not in known]
        if not fringe:
            break
        parent, symbol = max(fringe, key=lambda x: seen[moves[x[0]][x[1]]])
        q = moves[parent][symbol]
        r = next((r for r in kept if compatible(r, q)), None)
        if r is None:
            kept.append(q)
            known.add(q)
        else:
            moves[parent][symbol] = r
            fold(r, q)
    number = {q: k for k, q in enumerate(kept)}
    out = [{s: (number[to], math.log(used[q][s] / seen[q])) for s, to in moves[q].items()} for q in kept]
    return Automaton(out, [math.log(final[q] / seen[q]) if final[q] else _UNSEEN for q in kept])


# --- the two passes ---------------------------------------------------------------


def shape_counts(docs: DataFrame) -> DataFrame:
    """(label, shape, n) over all texts: label 0..2 for the base kinds, 3 for background tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches):
            n: Counter = Counter()
            for _, _, data, offs in C.text_chunks(batch):
                for _, raw, base, found in chunk_spans(data, offs):
                    n.update((k, shape(v)) for _, _, k, v in base)
                    n.update((3, shape(raw[a:b])) for a, b in found)
            label, form = zip(*n, strict=True) if n else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(form, pa.string()), pa.array(list(n.values()), pa.int64())], names=["label", "shape", "n"])

    return docs.select("text").mapInArrow(run, "label int, shape string, n long").groupBy("label", "shape").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, max_shapes: int = MAX_SHAPES, alpha: float = ALPHA, max_symbols: int = MAX_SYMBOLS) -> dict[int, Automaton]:
    """An automaton for each label that occurs."""
    counts = C.materialize(shape_counts(docs))
    spread = F.pmod(F.xxhash64("shape"), F.lit(64))

    def first(df: DataFrame, order: list, most: int) -> DataFrame:
        """The first rows of each label, ranked in parts before they are ranked together."""
        for by in (["label", "part"], ["label"]):
            df = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)
        return df

    def fitting(df: DataFrame) -> dict[int, dict[str, float]]:
        """The shapes of each label by rank, as long as their symbols stay under the bound; one that is too long for what is
        left is passed over, and those behind it still count."""
        left: dict[int, int] = {}
        chosen: dict[int, list[int]] = {}
        for r in df.select("label", "rank", F.length("shape").alias("size")).orderBy("label", "rank").collect():
            if r["size"] <= left.setdefault(r["label"], max_symbols // 2):
                left[r["label"]] -= r["size"]
                chosen.setdefault(r["label"], []).append(r["rank"])
        out: dict[int, dict[str, float]] = {}
        for label, ranks in chosen.items():
            for r in df.where((F.col("label") == label) & F.col("rank").isin(ranks)).select("shape", "n").collect():
                out.setdefault(label, {})[r["shape"]] = r["n"]
        return out

    top = C.materialize(first(counts.withColumn("part", spread), [F.desc("n"), F.xxhash64("shape"), "shape"], max_shapes - max_shapes // 2).select("label", "shape", "n", "rank"))
    rest = counts.join(top.select("label", "shape"), ["label", "shape"], "left_anti")
    mass = {r["label"]: r["n"] for r in rest.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    drawn = C.materialize(first(rest.withColumn("part", spread), [F.xxhash64("shape", F.lit("draw")), "shape"], max_shapes // 2).select("label", "shape", "n", "rank"))
    taught, tail = fitting(top), fitting(drawn)
    for label, some in tail.items():
        weight = mass[label] / sum(some.values())
        taught.setdefault(label, {}).update({k: n * weight for k, n in some.items()})
    return {k: infer(v, alpha) for k, v in taught.items()}


def odds(models: dict[int, Automaton], form: str) -> float:
    """Log-likelihood of the best credential format less the background's."""
    known = [m.score(form) for k, m in models.items() if k != 3]
    return (max(known) - (models[3].score(form) if 3 in models else len(form) * _UNSEEN)) if known else -math.inf


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
_SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("score", T.DoubleType())]))


def _scan(rows: DataFrame, models: dict[int, Automaton], min_odds: float) -> DataFrame:
    """*rows* (with a column text) and ``spans``."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}

        def rate(token: bytes) -> float:
            form = shape(token)
            if form not in known:
                if len(known) > 50_000:
                    known.clear()
                known[form] = odds(sent.value, form)
            return known[form]

        for batch in C.sliced(batches):
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for lo, _, data, offs in C.text_chunks(batch):
                for r, raw, base, found in chunk_spans(data, offs):
                    spans = [(a, b, k, rate(v)) for a, b, k, v in base]
                    spans += [(a, b, 3, score) for a, b in found if (score := rate(raw[a:b])) >= min_odds]
                    if spans:
                        # Bytes to code points: those before a place, less the continuation bytes.
                        points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                        out[lo + r] = [{"kind": KINDS[k], "start": int(points[a]), "stop": int(points[b]), "score": s if math.isfinite(s) else None} for a, b, k, s in sorted(spans, key=lambda x: (x[0], x[2], x[1]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _SPANS)], names=[*batch.schema.names, "spans"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("spans", _SPAN_TYPE)]))


def find_secrets(docs: DataFrame, max_shapes: int = MAX_SHAPES, min_odds: float = MIN_ODDS, alpha: float = ALPHA, max_symbols: int = MAX_SYMBOLS) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, stop, score>>) for every row: code points, stop exclusive, by start
    and then kind; score is the log odds of a credential's format (of the value, in an assignment)."""
    return _scan(docs.select("doc_id", "text"), learn(docs, max_shapes, alpha, max_symbols), min_odds).select("doc_id", "spans")


def redact(docs: DataFrame, mark: str = "[secret]", max_shapes: int = MAX_SHAPES, min_odds: float = MIN_ODDS, alpha: float = ALPHA, max_symbols: int = MAX_SYMBOLS) -> DataFrame:
    """*docs* with every span of ``text`` replaced by *mark*; overlapping spans are one."""
    found = _scan(C.boxed(docs, "text"), learn(docs, max_shapes, alpha, max_symbols), min_odds)
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    step = lambda a, s: F.when(
        s["start"] >= a["at"], F.struct(F.concat(a["text"], F.substring("text", a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("text"), s["stop"].alias("at"))
    ).otherwise(F.struct(a["text"].alias("text"), F.greatest(a["at"], s["stop"]).alias("at")))
    cut = F.aggregate("spans", start, step, lambda a: F.concat(a["text"], F.substring("text", a["at"] + 1, F.length("text"))))
    return C.unboxed(found, docs.columns, text=F.when(F.size("spans") == 0, F.col("text")).otherwise(cut))
