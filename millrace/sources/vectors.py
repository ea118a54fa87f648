"""Vector tables: resumable export, checks and a cache keyed by text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import clean
from millrace.session import cut


def embed(rows: DataFrame, make_client: Callable, key: str, column: str, batch: int = 64) -> DataFrame:
    """(key, embedding) of a text column; make_client() is called once per task and gives embed(list of texts) -> list of vectors."""
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in parts:
            for i in range(0, len(pdf), batch):
                own = pdf.iloc[i : i + batch]
                yield pd.DataFrame({key: own[key], "embedding": list(client.embed(own[column].fillna("").tolist()))})

    return rows.select(key, column).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def query_text(title, content, chars: int = 1600):
    return F.substring(F.concat(F.lit("标题："), clean(title), F.lit("\n正文："), clean(content)), 1, chars)


def export(rows: DataFrame, make_client: Callable, path: str, key: str = "article_id", chars: int = 1600, model: str = "") -> int:
    """Append the vectors of rows (key, title, content) that path doesn't have yet; how many were added.

    A run that broke off is resumed by calling it again; a path that holds vectors of
    another model or truncation is refused.
    """
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    todo = rows.select(key, query_text("title", "content", chars).alias("text")).dropDuplicates([key])
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        held = spark.read.parquet(path)
        if held.filter((F.col("model") != model) | (F.col("chars") != chars)).head(1):
            raise ValueError("the vectors there are of another model or truncation")
        todo = todo.join(held.select(key), key, "left_anti")
    todo = cut(todo)
    embed(todo, make_client, key, "text").withColumn("model", F.lit(model)).withColumn("chars", F.lit(chars)).write.mode("append").parquet(path)
    return todo.count()


def checked(vectors: DataFrame, key: str, place: str) -> DataFrame:
    """vectors, if `place` numbers their rows from 0 without gaps and every key stands once; else an error."""
    c = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("low"), F.max(place).alias("high"), F.count_distinct(place).alias("places"), F.count_distinct(key).alias("keys")).first()
    if c["n"] and (c["low"] != 0 or c["high"] != c["n"] - 1 or c["places"] != c["n"] or c["keys"] != c["n"]):
        raise ValueError("the rows of the vector table aren't numbered 0 to n - 1")
    return vectors


def cached(texts: DataFrame, cache: DataFrame, make_client: Callable, model: str) -> tuple[DataFrame, DataFrame]:
    """(vectors of texts, rows to add to the cache): only texts whose (model, SHA-256) the cache doesn't have are embedded, each once.

    texts (text); cache (model, digest, embedding).
    """
    keyed = texts.withColumn("digest", F.sha2("text", 256))
    own = cache.filter(F.col("model") == model).select("digest", "embedding")
    missing = keyed.dropDuplicates(["digest"]).join(own, "digest", "left_anti")
    new = cut(embed(missing, make_client, "digest", "text"))
    return keyed.join(own.unionByName(new), "digest").drop("digest"), new.withColumn("model", F.lit(model)).select("model", "digest", "embedding")
