"""A corpus for training, from `documents`: toxic documents, copies, benchmark passages and secrets go, and what stays is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of
`documents`. SQL can't express the classifier, the alignment, the lexer and the encoder: `tests/llm` holds the stages
against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlake.llm import decontam, ngram_join, secret_scan, toxicity, viterbi
from siftlake.llm.textkit import table, written

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return viterbi.encode(docs)


STAGES = [("toxicity", drop_toxic), ("n-gram jaccard join", drop_copies), ("benchmark decontamination", drop_leaks), ("secret scans", mask_secrets), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage runs once: its rows are written to the shared folder and read again as the next one's; the last one's are returned."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
