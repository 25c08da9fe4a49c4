"""Which texts contain which patterns, by an inverted index of pieces.

Each pattern is looked up by one of its pieces, the one that the fewest texts hold: a blank with the character before it and *2q*
(or *q + 1*, or *q - 1*) behind it where the pattern has such, else any *q* characters; a pattern shorter than *q* is looked up whole.  Texts are cut into parts that
overlap by the longest pattern, parts into their different pieces; an equi-join on the piece gives the candidates, and each is
verified by ``contains`` on its part.  So the work grows with the texts and the hits, not with texts times patterns nor with the
square of a text, and no list of keywords is written into the plan.

Of up to COUNTED patterns the first piece of each will do, since to count pieces takes longer than to verify what more comes.
Patterns of up to FEW characters altogether are broadcast: texts stay where they are, nothing of them is shuffled.  With more,
pieces travel with a digest of their text (SHA-256) and the number of the part, and meet the parts again once candidates are known.

Null texts and patterns and empty patterns match nothing; patterns that come twice under different ids each match.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FEW = 16_000_000
COUNTED = 100
PART = 256


def pieces(text: Column, least: int, most: int, word: bool = False) -> Column:
    """The different pieces of *most* characters (at the end of the text of *least* or more), or those that have a blank second."""
    shape = f". .{{{least - 2},{most - 2}}}" if word else f".{{{least},{most}}}"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({shape}))"), F.lit(1)))


def _kind(pattern: Column, q: int) -> Column:
    """(word, size): by which pieces a pattern is looked up."""
    n, blank = F.length(pattern), F.locate(" ", pattern, 2)
    kind = F.struct(F.lit(False).alias("word"), F.least(n, F.lit(q)).alias("size"))
    for behind in (q - 1, q + 1, 2 * q):
        kind = F.when((blank > 0) & (n - blank >= behind), F.struct(F.lit(True).alias("word"), F.lit(behind + 2).alias("size"))).otherwise(kind)
    return kind


def kinds_of(patterns: DataFrame, pattern: str, q: int) -> list[Row]:
    """(word, size, patterns, chars, longest) of every kind of piece that *patterns* are looked up by."""
    known = patterns.where(F.length(pattern) > 0).select(_kind(F.col(pattern), q).alias("k"), F.length(pattern).cast("long").alias("n"))
    return sorted(known.groupBy("k.word", "k.size").agg(F.count("*").alias("patterns"), F.sum("n").alias("chars"), F.max("n").alias("longest")).collect())


def small(patterns: DataFrame, pattern: str = "pattern") -> Callable[[DataFrame], DataFrame]:
    """What marks tables of as many rows as *patterns* for a broadcast, if these are few; their plans don't tell their size."""
    few = (patterns.agg(F.sum(F.length(pattern).cast("long"))).first()[0] or 0) <= FEW
    return F.broadcast if few else lambda x: x


def _parts(text: Column, longest: int) -> Column:
    """The parts of a text: whatever is no longer than *longest* lies in one of them as a whole."""
    step = max(PART, longest)
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{step + longest - 1}}}+)).{{1,{step}}}+"), F.lit(1))


def _cut(parts: DataFrame, kinds: Sequence[Row], *more: str) -> DataFrame:
    """*parts* with a row for every ``piece`` of ``k_part`` and every one of *more*: of each sort the longest pieces are taken out
    once, their beginnings are the shorter ones."""
    sizes = {word: [k.size for k in kinds if k.word == word] for word in (False, True)}
    longest = F.flatten(F.array(*[pieces(F.col("k_part"), min(s), max(s), word) for word, s in sizes.items() if s]))
    own = F.concat(F.coalesce(longest, F.array().cast("array<string>")), F.array(*map(F.lit, more))) if more else longest
    return parts.select("*", F.explode(own).alias("k_long")).select("*", F.explode(F.array(*[F.left("k_long", F.lit(n)) for n in sorted({k.size for k in kinds})])).alias("piece")).drop("k_long")


def anchors(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, pattern_key: str, q: int, kinds: Sequence[Row], few: bool) -> DataFrame:
    """(piece, pattern_key, pattern): one piece of each pattern, of its rarest in *texts*; patterns of which a piece is in no
    text at all are left out.  Of COUNTED patterns or fewer just one piece of each."""
    small = F.broadcast if few else lambda x: x
    known = patterns.where(F.length(pattern) > 0).select(F.col(pattern_key), F.col(pattern)).withColumn("k", _kind(F.col(pattern), q))
    own = F.coalesce(*[F.when((F.col("k.word") == k.word) & (F.col("k.size") == k.size), pieces(F.col(pattern), k.size, k.size, k.word)) for k in kinds])
    each = known.select(pattern_key, pattern, F.explode(own).alias("piece"))
    if sum(k.patterns for k in kinds) <= COUNTED:
        return each.groupBy(pattern_key, pattern).agg(F.min("piece").alias("piece")).select("piece", pattern_key, pattern)
    parts = texts.select(F.explode(_parts(F.col(text), max(k.longest for k in kinds))).alias("k_part"))
    seen = _cut(parts, kinds).select("piece").join(small(each.select("piece").distinct()), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("k_texts"))
    rarest = Window.partitionBy(pattern_key, pattern).orderBy(F.coalesce("k_texts", F.lit(0)), "piece")
    best = each.join(small(seen), "piece", "left").withColumn("k_nth", F.row_number().over(rarest))
    return best.where("k_nth = 1 and k_texts is not null").select("piece", pattern_key, pattern)


def matches(texts: DataFrame, patterns: DataFrame, text: str = "text", pattern: str = "pattern", pattern_key: str = "pattern_id", q: int = 4, outer: bool = False) -> DataFrame:
    """Every row of *texts* with the key of every pattern that it contains, perhaps more than once; *outer*: and at least once
    with a null key, if it contains none.  Few patterns leave the partitioning of *texts* as it is."""
    kinds = kinds_of(patterns, pattern, q)
    if not kinds:
        return texts.withColumn(pattern_key, F.lit(None).cast(patterns.schema[pattern_key].dataType)).where(F.lit(outer))
    longest, few = max(k.longest for k in kinds), sum(k.chars for k in kinds) <= FEW
    best = anchors(texts, patterns, text, pattern, pattern_key, q, kinds, few)
    contained = F.contains("k_part", pattern)
    if few:
        parts = texts.select("*", (F.explode_outer if outer else F.explode)(_parts(F.col(text), longest)).alias("k_part"))
        rows = _cut(parts, kinds, *[""] * outer)  # the empty piece stands for the row itself
        best = F.broadcast(best.withColumnRenamed("piece", "k_piece"))
        found = rows.join(best, (F.col("piece") == F.col("k_piece")) & contained, "left" if outer else "inner")
        return (found.where((F.col("piece") == "") | F.col(pattern_key).isNotNull()) if outer else found).select(*texts.columns, pattern_key)
    named = texts.withColumn("k_text", F.sha2(text, 256))
    parts = named.select("k_text", F.posexplode(_parts(F.col(text), longest)).alias("k_nr", "k_part"))
    found = _cut(parts, kinds).select("k_text", "k_nr", "piece").join(best, "piece").drop("piece").distinct()
    hits = found.join(parts, ["k_text", "k_nr"]).where(contained).select("k_text", pattern_key).distinct()
    return named.join(hits, "k_text", "left" if outer else "inner").select(*texts.columns, pattern_key)


def contains_join(texts: DataFrame, keys: Sequence[str], patterns: DataFrame, text: str = "text", pattern: str = "pattern", pattern_key: str = "pattern_id", q: int = 4) -> DataFrame:
    """(keys, pattern_key): every text (*keys* name it) with every pattern that it contains, once."""
    return matches(texts.select(*dict.fromkeys((*keys, text))), patterns, text, pattern, pattern_key, q).select(*keys, pattern_key).distinct()


def first_hits(hits: DataFrame, keys: Sequence[str], ranks: DataFrame, by: Sequence[str] = (), pattern_key: str = "pattern_id") -> DataFrame:
    """(keys, by, pattern_key): of each text's hits the one of the smallest rank (*ranks*: pattern_key, rank and *by*, such as
    the list that it stands in)."""
    x = hits.join(ranks.select(pattern_key, "rank", *by), pattern_key)
    return x.groupBy(*keys, *by).agg(F.min_by(pattern_key, "rank").alias(pattern_key))
