"""Documents to a mixed training corpus, in five stages.

Every stage reads what its predecessor kept and returns the columns of
``documents``; the last adds ``mix_source, mix_slot, mix_position``, the order
in which the corpus is to be read. Each stage's edge cases are those of its
operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import decontaminate, language_id, line_dedup, mixing, ngram_join
from shelfmark.llm.common import stored
from shelfmark.llm.queries import MIXTURE, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; text without letters goes."""
    return language_id.keep_identified(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source repeats."""
    return line_dedup.drop_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar shingles (five words, 0.8)."""
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word window of a benchmark item."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture."""
    return mixing.mix(docs, MIXTURE)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", decontaminated),
    ("mix_sources", mixed),
]

# Language identification is a trained model; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
