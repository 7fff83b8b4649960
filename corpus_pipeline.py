"""The corpus pipeline: documents in, packed training sequences out.

Stages, in order: quality rules (rejected documents go), line dedup (repeated
lines go), n-gram Jaccard join (one document of each group stays), benchmark
decontamination (contaminated documents go), best-fit packing. Every stage but
the last returns the columns of ``documents``; each works on all rows that its
predecessor kept. Rows with null or empty text have no words and go in the
first stage. An empty table goes through all stages.

The line stage follows op2's rule: a line of ten or more documents goes from all
of them. A group of ten or more exact copies loses all its lines there and goes
on without words, so the n-gram join does not see it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import decontam, line_dedup, ngram_join, packing, quality
from rollcall.llm.common import written
from rollcall.llm.queries import TOKENIZER
from rollcall.sources.tables import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``documents``; n_chars, if there, follows the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.score_quality(docs).where("kept").select(*docs.columns)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(docs, min_chars=1, min_docs=10)
    return _sized(cleaned, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # near duplicates: five words, similarity 0.8 or more
    found = ngram_join.jaccard_components(docs, words=5, num=4, den=5)
    return found.where("keep").select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bench = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return decontam.decontaminate(docs, bench).where("NOT contaminated").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_repeats),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", benchmark_passages),
    ("packing", pack),
]

#: no SQL: the vote fit of the first stage and the packing of the last are
#: iterative; tests/llm checks run() against a brute-force version
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and
    read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
