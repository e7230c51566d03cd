"""Corpus pipeline: classify quality, deduplicate lines, keep one of each near-duplicate group, decontaminate, pack."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import release, table, written
from lumenlog.llm.decontaminate import decontaminated
from lumenlog.llm.line_dedup import line_dedup
from lumenlog.llm.ngram_join import one_of_each
from lumenlog.llm.packing import pack
from lumenlog.llm.quality_classifier import quality_classifier


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at one half or more stay, whole and with all their columns.

    Null and empty texts have no passages and get one low score, so they go. Repeated rows and rows with null ids are
    judged alike, each by its text. An empty table stays empty.
    """
    return quality_classifier(docs, table(spark, sf_dir, "labels"), "__quality").filter("__quality >= 0.5").select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which no word is left goes, and n_chars follows the text.

    Documents without a removed line stay as they are: null texts, empty ones, any n_chars. Of repeated rows the first
    keeps its lines, so the others mostly go. Rows with null ids come first in the order. An empty table stays empty.
    """
    left = line_dedup(docs, counts=("__lines", "__gone")).filter(F.col("__gone").eqNullSafe(0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("__gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 stays, that of the least doc_id.

    Of repeated rows one stays; null and empty texts are linked with nothing and stay, as do rows with null ids that no
    other row is linked to. An empty table stays empty.
    """
    return one_of_each(docs, words=5, percent=80).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; repeated rows stay or go together; items with a null id or text aren't
    searched for. An empty table stays empty.
    """
    return decontaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, in sequences of 2048 tokens.

    Null and empty texts give the end id alone; repeated rows and null ids are packed like others. No documents, no pieces.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [("quality_classifier", classify), ("line_dedup", dedup_lines), ("ngram_join", dedup_documents), ("decontamination", decontaminate), ("packing", packed)]

#: The classifier, the sampled embedding and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
