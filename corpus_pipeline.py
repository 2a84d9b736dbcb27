"""The corpus pipeline: documents that are good, unique, free of benchmarks and of personal data,
as token ids.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. It gets what its predecessor kept, reread
from Parquet, and returns the rows it keeps, with their columns; the last adds the column ids.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import decontaminate, jaccard, perplexity, pieces, pii
from flowloom.llm.common import stored, table

#: The vocabulary file; a path on the driver's disk.
PIECES = os.environ.get("FLOWLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit; those without a text go."""
    return perplexity.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of similar ones: four fifths of the
    shingles of five words, so that copies with a passage added or cut off are found."""
    return jaccard.keep_one(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms of the same format for personal data."""
    return pii.pseudonymize(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the ids of their texts."""
    return pieces.encode(docs, pieces.read_model(spark, PIECES))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", pseudonyms),
    ("sentence pieces", tokens),
]

#: A trained model's perplexity, keyed permutations and merges are beyond SQL: tests compare the
#: pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
