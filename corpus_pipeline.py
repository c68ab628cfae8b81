"""The corpus pipeline: toxicity, quality, repeated lines, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Between stages the table is written and read again, so a stage's lineage ends with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import line_dedup, packing, quality, simhash, toxicity
from quantloom.llm.common import materialise, table

#: Word shingles and the similarity from which two documents are near copies.
WORDS, SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go."""
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers reject go."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; documents stay."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return simhash.one_of_each(docs, WORDS, SIMILARITY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in fixed-length sequences."""
    return packing.pack_documents(docs, packing.default_tokens())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: The classifiers and the packing are not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
