"""A training-data pipeline over ``documents``: rate, drop near-copies, drop test leaks, mask secrets, segment.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm import decontaminate, pieces, quality, secrets, simhash
from tideframe.llm.base import table, written

#: Sampled segmentations per document.
SAMPLES = pieces.K


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of ``docs``."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group of near-copies (3-word shingles, 3 bits)."""
    return simhash.keep_one(docs)


def no_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_leaks(docs, decontaminate.questions(table(spark, sf_dir, "benchmark")))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows the text."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document: the model's segmentation and sampled ones, and whether they decode to the text."""
    out = pieces.segment(docs, k=SAMPLES)
    return out.select("doc_id", "lang", "source", "pieces", "samples", "decodes")


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", one_of_each),
    ("benchmark_decontamination", no_test_items),
    ("secret_scans", no_secrets),
    ("sentencepiece", token_ids),
]

#: Trained scores, fingerprints and sampled segmentations are beyond SQL; a test compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each on what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = written(docs)
    return docs
