"""The production corpus pipeline: stages over documents, each written and read again as the next one's input.

Quality classifier (rejected documents go), exact dedup, MinHash near-dedup (one
document of each group stays), mixing to target weights (a document stands in the mix
as often as its leaf's epochs hold it), SentencePiece encoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, mixing, near_dedup, quality, sentencepiece_codec
from millrace.llm.session import remove, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts; it is fitted on labels of sf_dir and texts of docs."""
    docs = docs.select(*COLUMNS)
    return quality.accepted(docs, quality.train(spark, sf_dir, docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest id."""
    return exact_dedup.kept_texts(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that with the smallest id."""
    return near_dedup.kept_documents(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the production weights and budget, upsampled ones repeated."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids and exact (whether decoding gave back the text)."""
    return sentencepiece_codec.encode(docs)


STAGES = [("quality", classify), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("sentencepiece", encode)]

#: The quality model is fitted by an iterative solver, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents. What the last stage reads stays in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        folder = shared_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return STAGES[-1][1](spark, docs, sf_dir)
