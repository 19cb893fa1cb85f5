"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.

All stages but the last carry columns other than doc_id, text and, in language_id, lang, whatever their names; the last gives ids instead.
In all: null ids are ids like any
other, told apart by their texts; an empty table gives an empty one with the same columns. What else is defined stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollbook.llm import bpe, decontam, langid, minhash, simhash, substring
from rollbook.llm.common import staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told (operator 2): null, empty and blank texts and those without a letter go; repeated rows are judged each, so all or none stay."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: a Jaccard similarity of 0.8 or more on five-word shingles.

    Candidates come from operator 7's search and, since SimHash at 3 of 64 bits finds a tenth of such pairs (README), from MinHash bands;
    all are verified on the shingles. Components and the choice of a row are operator 7's. The row of the smallest doc_id stays, one of rows that repeat; texts without words are one group; null ids come last.
    """
    return simhash.keep_one(docs, minhash.near_copies)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that a document before them has (operator 8): rows stay, a text may become empty; rows without doc_id neither lose words nor take any."""
    return substring.remove_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark (operator 4): null and empty texts are clean; without a benchmark all stay."""
    return decontam.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids (operator 6): doc_id, n_tokens, ids and the digest of what they decode to; null texts have no ids."""
    return bpe.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: SQL has neither the classifier's training nor XXH64 nor byte-pair merging; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
