"""Session helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import attach, cut, remove, shared_folder, small_enough, table

__all__ = ["attach", "cut", "documents", "fold", "partitions", "remove", "shared_folder", "small_batches", "small_enough", "table"]

#: Rows and bytes in one Arrow batch: what a Python worker holds at a time.
BATCH_ROWS = 512
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts don't fill a worker's memory."""
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fold(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo buckets."""
    return F.crc32(doc_id.cast("string")) % F.lit(buckets)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null texts as empty; other columns, whatever their names, go."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for stages whose work isn't in proportion to their bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
