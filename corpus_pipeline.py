"""The corpus pipeline: documents in, packed training sequences out.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents. run() writes each stage's result as Parquet and gives what it reads back to the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rallyframe.llm import decontamination, line_dedup, near_duplicates, packing, quality
from rallyframe.llm.common import stored
from rallyframe.llm.queries import table

#: Distinct pieces of text that packing's workers keep: they serve the other stages too, so fewer than where packing is alone.
HELD_PIECES = 500_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling does not draw go."""
    return quality.drawn(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too large a share of their source's distinct documents have go; documents stay."""
    return line_dedup.drop_boilerplate(docs, copies_once=True)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity of 0.8 or more."""
    return near_duplicates.without_near_duplicates(docs, words=5, threshold=(80, 100))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: each piece of each document with its place."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), packing.CAPACITY, held=HELD_PIECES)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", duplicate_stage),
    ("decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL expresses neither the fitted models nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
