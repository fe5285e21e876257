"""The corpus pipeline: five training-data operators one after another over documents.

Each stage works on all rows that the one before it kept, and returns the columns of documents (the last: what the mix takes,
and how often). Between stages the rows are written to the shared folder, so that no stage runs twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthline.llm.common import staged, table, unstage
from hearthline.llm.decontaminate import without_leaks
from hearthline.llm.mixing import mix_sources
from hearthline.llm.quality import keep_good
from hearthline.llm.resemblance import keep_one_of_resembling
from hearthline.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores 0.7 or more."""
    return keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a five-word similarity of 0.8 or more: the one of the smallest doc_id.

    Candidates are what operator 6 links by SimHash fingerprints, and besides, since at that similarity these differ in ten bits on
    average, which no block keys reach, texts with an equal band of minimum hashes. Every link is checked on the whole texts.
    """
    return keep_one_of_resembling(docs, least=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"), window=8, run=6)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by marks."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, and how many epochs of each."""
    return mix_sources(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]
ORACLE_SQL = None  # SQL can express neither the classifier nor the bands; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage wrote is deleted once the next one's rows are written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
            if k:
                unstage(before)
    return docs
