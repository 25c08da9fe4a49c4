"""A corpus pipeline over the table ``documents``.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and returns a
DataFrame; all but the last return the columns of ``documents``.  ``run`` writes each stage's result as Parquet
in the shared folder and reads it again for the next, so a lost executor costs one stage at most.

1. quality: documents that the attention classifier scores under 0.7 go (labels: those not held out).
2. line_dedup: later occurrences of windows of three lines go; a text may become shorter or empty.
3. near_dedup: of documents whose five-word shingles have a Jaccard similarity of 0.8 or more (found by SimHash and
   an exact join), one stays, that of the smallest doc_id.
4. decontaminate: runs of words that lie in a benchmark window of ten words are cut out.
5. pack: tokens of every document get places in sequences of 4096.

Null texts, empty tables, repeated rows and further columns fare as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import _common, decontaminate, line_dedup, packing, quality, simhash
from panelyard.llm.queries import word_tokenizer


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars brought up to date."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _common.settings(spark)
    return quality.keep_good(docs, _common.read(spark, sf_dir, "labels"), threshold=0.7)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.dedup_lines(docs, size=3), docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _common.settings(spark)
    return simhash.near_dedup(docs, words=5, similarity=0.8, budget=7)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _common.settings(spark)
    return _counted(decontaminate.decontaminate(docs, _common.read(spark, sf_dir, "benchmark"), n=10, remove="spans"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _common.settings(spark)
    return packing.pack(docs, word_tokenizer(), capacity=4096, end_id=1)


STAGES = [("quality", keep_quality), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontaminate", remove_benchmark), ("pack", pack)]

#: SQL can't express the classifier, the trie join's components or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table documents."""
    docs = _common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = _common.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
