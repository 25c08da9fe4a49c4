"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common, bitslice, decontaminate, filter_audit, jaccard, line_dedup, lm_score, merkle, packing, periodic, quality, secrets, simhash, suffix_dedup


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, in a session that is set for long texts."""
    _common.settings(spark)
    return _common.read(spark, sf_dir, name)


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def word_tokenizer() -> str:
    """The installed vocabulary file that the packing query counts tokens with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bitslice_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every 20th embedding, over the bit-sliced index of all."""
    return bitslice.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and hit items of every document against the whole benchmark."""
    found = decontaminate.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), n=10)
    n_hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["first"])
    items = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), _sha(items).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and a digest of what is left of every document."""
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", _sha(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op4_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged records of a replica of the archive of all pages.

    The replicas are derived from the pages by rule.  Of every 17 page ids, in the second one record has its payload's
    first character overwritten, one its last five characters, one is lost, and one lies seven bytes further on; one
    record is only in the second."""
    pages = read(spark, sf_dir, "pages").where("page_id is not null")
    id_, body = F.col("page_id"), F.coalesce("html", F.lit(""))
    record = merkle.warc_text(id_, F.col("url"), body)
    head = F.substring(record, 1, F.length(record) - F.length(body) - 4)
    worn = (
        F.when(id_ % 17 == 3, F.concat(head, F.lit("#"), F.substring(body, 2, 2**31 - 1), F.lit("\r\n\r\n")))
        .when(id_ % 17 == 5, F.concat(head, F.substring(body, 1, F.greatest(F.length(body) - 5, F.lit(0))), F.lit("?????\r\n\r\n")))
        .otherwise(record)
    )
    both = pages.select(id_.cast("long").alias("record_id"), merkle.digest(record).alias("sha"), F.octet_length(record).cast("long").alias("size"), merkle.digest(worn).alias("worn"))
    k = F.col("record_id") % 17
    placed = merkle.with_offsets(both)
    first = F.when(k != 13, F.struct(F.lit(0).alias("replica"), "sha", "start", "stop"))
    late = F.when(k == 11, F.lit(7)).otherwise(0)
    second = F.when(k != 7, F.struct(F.lit(1).alias("replica"), F.col("worn").alias("sha"), (F.col("start") + late).alias("start"), (F.col("stop") + late).alias("stop")))
    records = placed.select("record_id", F.explode(F.array_compact(F.array(first, second))).alias("r")).select("r.replica", "record_id", "r.sha", "r.start", "r.stop")
    return merkle.audit(records).select("record_id", "status", "start", "stop", "expected", "found")


def op5_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from the labels that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, read(spark, sf_dir, "labels"), threshold=0.7).select("doc_id", "held_out", "score", "predicted")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document between good, clean documents and all."""
    target = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return lm_score.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), target)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings of every document: how many bytes and spans go, and a digest of what stays."""
    out = suffix_dedup.dedup_substrings(read(spark, sf_dir, "documents"), length=100, with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and learned secret spans of every document."""
    out = secrets.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", of("assign"), of("access"), of("hex"), _sha(joined(F.filter("spans", lambda s: s["kind"] != "format"))).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), size=3, budget=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """A place in sequences of at most 4096 tokens for every piece of every document."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer or word_tokenizer(), capacity=4096, end_id=1)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep and remove in every order, in each language."""
    counts = filter_audit.mask_counts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), part="lang")
    return filter_audit.audit(_common.materialize(counts))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document, of three-word shingle sets that are similar to 90 % or more."""
    return jaccard.jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=90)


def planted(docs: DataFrame) -> DataFrame:
    """*docs* (doc_id, text) in which every tenth document by the CRC of its id turns periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"), F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), "").alias("words"))
    placed = words.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")).withColumn("left", (F.col("n") - F.col("a")).cast("int"))
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(F.col("left") / F.col("p")).cast("int"))), F.lit(1), F.col("left"))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return placed.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of words of every document, the longest of them, and a digest of what stays without them."""
    out = periodic.periodic_runs(planted(read(spark, sf_dir, "documents").select("doc_id", "text")), shortest=12)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = out.withColumn("best", longest)
    start, length, period = -F.col("best.s"), F.col("best.l"), -F.col("best.q")
    milli = F.floor(1000 * length / period).cast("long")
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), _sha(lines).alias("runs_sha256"), _sha(F.col("collapsed")).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bitslice_topk, op2_decontaminate, op3_line_dedup, op4_merkle_audit, op5_quality_mil, op6_lm_score, op7_suffix_dedup, op8_secret_scan, op9_simhash, op10_best_fit_packing, op11_filter_audit, op12_jaccard_join, op13_periodic_runs)}
