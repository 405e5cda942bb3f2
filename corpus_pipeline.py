"""A corpus pipeline: quality rules, language, near duplicates, repeated byte strings, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
``run`` writes each stage's result as Parquet and hands it to the next stage as read back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracegrain.llm import jaccard, language, packing, prefix_free, quality
from tracegrain.llm.common import table, written

# Near duplicates: shingles of five words, four fifths of the union in common.
SHINGLE = 5
PERCENT = 80
# Repeated strings go from so many bytes on: fifty words of the shortest kind. Phrases are short enough that nearly
# every such string holds several.
REPEAT_BYTES = 240
PHRASE_BYTES = 30


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cascade; null and empty texts go."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is found; the classifier learns from the labelled rows of ``docs``."""
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near duplicates."""
    return jaccard.keep_first(docs, PERCENT, SHINGLE)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the byte strings that occur more than once; ``n_chars`` follows the text."""
    return prefix_free.stripped(docs, REPEAT_BYTES, PHRASE_BYTES)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("best-fit packing", best_fit_packing),
]

# The language classifier and the byte-pair encoder are not for SQL; the tests use a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
