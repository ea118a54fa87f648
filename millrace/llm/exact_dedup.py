"""Exact duplicates by composable polynomial fingerprints, then a chunkwise comparison.

A chunk of bytes b1..bn has the fingerprint sum((bi + 1) * B**(n - i)) modulo two
primes. Two neighbouring chunks combine by length-shifted arithmetic,

    H(left + right) = H(left) * B**len(right) + H(right),

so all chunks of all texts in a batch are hashed at once, and those of a huge
text are combined afterwards, in any grouping. Texts of equal length and
fingerprint are candidates: each is compared with its group's representative,
chunk by chunk, in a stream that holds one representative at a time. A text that
differs (a collision) leaves the group and is grouped by its SHA-256 instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import column_bytes, tidy
from millrace.llm.session import attach, cut, small_batches, small_enough, table

MODULI = (2147483647, 2147483629)
BASES = (1_000_003 * 641 + 7, 998_244_353)
CHUNK = 1 << 16
#: Texts that meet one copy of their representative; a larger group spans several blocks.
BLOCK = 64


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint (bytes, first, second) of two neighbouring pieces; associative, with (0, 0, 0) neutral."""
    return (left[0] + right[0], *((left[i + 1] * pow(BASES[i], right[0], MODULI[i]) + right[i + 1]) % MODULI[i] for i in (0, 1)))


def fingerprints(data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK) -> list[np.ndarray]:
    """For rows data[offsets[i]:offsets[i + 1]] their lengths and the two residues."""
    lengths = np.diff(offsets)
    pieces = -(-lengths // chunk)
    row = np.repeat(np.arange(len(lengths)), pieces)
    within = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = offsets[row] + within * chunk
    ends = np.minimum(starts + chunk, offsets[row + 1])
    out = [lengths]
    exponents = np.repeat(ends - 1, ends - starts) - np.arange(len(data))
    for base, modulus in zip(BASES, MODULI):
        table_ = np.ones(chunk, np.uint64)
        filled = 1
        while filled < chunk:  # powers 0 .. filled - 1 give as many more
            more = min(filled, chunk - filled)
            table_[filled : filled + more] = table_[:more] * np.uint64(pow(base, filled, modulus)) % np.uint64(modulus)
            filled += more
        each = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * table_[exponents], starts) % np.uint64(modulus) if len(starts) else np.zeros(0, np.uint64)
        total = np.zeros(len(lengths), np.uint64)
        single = pieces == 1
        total[single] = each[np.flatnonzero(np.isin(row, np.flatnonzero(single)))] if single.any() else 0
        for i in np.flatnonzero(pieces > 1):
            h = 0
            for k in np.flatnonzero(row == i):
                h = (h * pow(base, int(ends[k] - starts[k]), modulus) + int(each[k])) % modulus
            total[i] = h
        out.append(total)
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        n, h1, h2 = fingerprints(data, offsets)
        held = memoryview(data)
        sha = [hashlib.sha256(held[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(h1.astype(np.int64)), pa.array(h2.astype(np.int64)), pa.array(sha)], ["doc_id", "x", "n_bytes", "h1", "h2", "text_sha256"])


def equal_by_chunks(left: str, right: str, chunk: int = CHUNK) -> bool:
    return len(left) == len(right) and all(left[i : i + chunk] == right[i : i + chunk] for i in range(0, len(left), chunk))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h1, h2, n_bytes, block), the representative of a block first; yields the members that differ."""
    key = text = None
    for batch in batches:
        ids, xs = [], []
        columns = [c.to_pylist() for c in batch.columns]
        for first, second, size, block, member, doc_id, x, own in zip(*columns):
            if not member:
                key, text = (first, second, size, block), own
            elif key != (first, second, size, block) or not equal_by_chunks(text, own):
                ids.append(doc_id)
                xs.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(xs, pa.int64())], ["doc_id", "x"])


KEYS = ["n_bytes", "h1", "h2", "clash"]


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256, n_bytes, and x, a hash of the text.

    Texts are equal when identical after no change; null counts as empty, and empty
    texts are equal to one another. Of equal texts that with the largest doc_id stays.
    Rows repeated with id and text count once; one id with several texts is several
    documents. A null id is smaller than any other. Empty input gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("x"))
    prints = own.select("doc_id", "text", "x").mapInArrow(tidy(_fingerprint), "doc_id long, x long, n_bytes long, h1 long, h2 long, text_sha256 string")
    prints = cut(prints.dropDuplicates(["doc_id", "n_bytes", "h1", "h2", "x"]).withColumn("clash", F.lit("")))
    groups = cut(_groups(prints))
    # texts go through the shuffle only where another has the same fingerprint
    members = cut(attach(prints, groups, KEYS, "group_size", total := prints.count()).filter("group_size > 1").select("doc_id", "x", "h1", "h2", "n_bytes", "keep_id", "keep_x", "group_size"))
    ids = members.select(F.col("doc_id").alias("m_id"), F.col("x").alias("m_x"), "h1", "h2", F.col("n_bytes"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("x") == F.col("keep_x"))).alias("first"), F.ceil(F.col("group_size") / BLOCK).cast("int").alias("blocks"))
    if small_enough(ids):
        ids = F.broadcast(ids)
    texts = own.join(ids, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("x") == F.col("m_x")))
    placed = texts.select("h1", "h2", "n_bytes", F.explode(F.when(F.col("first"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))).alias("block"), (~F.col("first")).cast("int").alias("member"), "doc_id", "x", "text")
    sorted_ = placed.repartition("h1", "h2", "n_bytes", "block").sortWithinPartitions("h1", "h2", "n_bytes", "block", "member")
    differing = cut(sorted_.mapInArrow(tidy(_compare), "doc_id long, x long").distinct())
    if differing.head(1):  # collisions of both residues: those texts are grouped by their SHA-256
        apart = differing.select(F.col("doc_id").alias("m_id"), F.col("x").alias("m_x"), F.lit(True).alias("apart"))
        prints = cut(prints.join(apart, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("x") == F.col("m_x")), "left").withColumn("clash", F.when(F.col("apart"), F.col("text_sha256")).otherwise("")).drop("m_id", "m_x", "apart"))
        groups = cut(_groups(prints))
    found = attach(prints, groups, KEYS, "group_size", total)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "n_bytes", "x")


def kept_texts(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each text: that which exact_duplicates keeps."""
    found = cut(exact_duplicates(docs))
    gone = cut(found.filter("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("x").alias("gone_x")))
    marked = docs.withColumn("__x", F.xxhash64(F.coalesce("text", F.lit(""))))
    left = marked.join(F.broadcast(gone) if small_enough(gone) else gone, F.col("doc_id").cast("bigint").eqNullSafe(F.col("gone_id")) & (F.col("__x") == F.col("gone_x")), "left_anti")
    if docs.count() > found.count():  # rows repeated with id and text
        left = left.dropDuplicates(["doc_id", "__x"])
    return left.drop("__x")


def _groups(prints: DataFrame) -> DataFrame:
    return prints.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"), F.max_by("x", F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("keep_x")).filter("group_size > 1")


def op7_exact_dedup(spark, sf_dir):
    """Every document with the one that stays of those with its text."""
    return exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_bytes")


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256, strlen(coalesce(text, '')) AS n_bytes
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
