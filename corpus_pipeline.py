"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage works on all that the one before kept, and but for the last returns rows with
the columns of ``documents``.  Between stages the rows are written to the shared folder.

Edge cases are those of the operators: a document without words fails the quality rules;
copies of a document, exact or near, are one place where its lines stand, so a document copied
to many sites does not count as boilerplate, while menus go whatever share of a page they are;
of equal rows and of each class of near copies one stays, by what texts hold and not by their
ids; empty tables run through; extra columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caliper.llm import decontaminate, line_dedup, near_dedup, quality_rules, sentencepiece_trie
from caliper.llm.common import saved
from caliper.plans.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_boilerplate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The contract of operator 4 fixes four words for its query; a pipeline stage takes five.
    return near_dedup.keep_one(docs, size=5)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_trie.digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near),
          ("decontaminate", benchmarks), ("sentencepiece", encoding)]

#: A hashed likelihood ratio and a trie of merges are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
