"""Corpus pipeline: stages over ``documents``, each on all that its predecessor kept.

The quality classifier drops what it rejects; the n-gram Jaccard join keeps one
document of each group of near copies; suffix-array deduplication removes bytes
of strings seen earlier; decontamination drops documents that hold benchmark
windows; the rest is encoded as pieces. SQL can't express these stages; the
tests hold each against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cascadia.llm.common import saved, table
from cascadia.llm.decontaminate import decontaminate
from cascadia.llm.jaccard_join import keep_first
from cascadia.llm.pieces import encode
from cascadia.llm.quality import keep_good
from cascadia.llm.suffix_dedup import remove_repeats


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, doesn't reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies."""
    return keep_first(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without bytes of 100-byte strings that stand earlier."""
    return remove_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of ``benchmark``."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document."""
    return encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", suffix_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece", piece_stage),
]

#: The stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage{k}")
    return docs
