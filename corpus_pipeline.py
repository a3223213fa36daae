"""Corpus pipeline: from raw documents to packed training windows, in five stages.

Each stage works on all that its predecessor kept, is written as Parquet and read again: an executor that is
lost, or a run that is broken off, repeats one stage at most. All stages but the last return the columns of
documents. Empty tables pass through every stage; null texts have no language and go in the first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lettermill.llm import decontaminate, langid, neardup, packing, secrets
from lettermill.llm.common import shared_dir, table


#: A document whose language is no likelier than this is rejected.
LANGUAGE_LEAST = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the corpus names, by a score of LANGUAGE_LEAST at least; those without a letter go."""
    return langid.keep_language(spark, docs, LANGUAGE_LEAST)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least doc_id."""
    return neardup.keep_one(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text."""
    return secrets.redact(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows, each window in the sources' proportions."""
    return packing.pack(spark, docs, with_ids=False)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("packing", packed)]

#: Alignment and tokenisation have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
