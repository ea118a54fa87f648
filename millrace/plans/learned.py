"""Queries over models, agents and streams (inventory 2.13, 2.14 and the streaming extension).

Models and agents have no SQL; the stream's windows do, as they equal a batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import agents, metrics, models
from millrace.plans.bindings import articles, news
from millrace.plans.ranking import scaled
from millrace.session import shared_folder, table
from millrace.streaming import events as streams


def language_model(spark, sf_dir):
    """243-246: languages of documents by a text model that is fitted on three quarters of them: counts of right and wrong ones."""
    a = articles(spark, sf_dir).select("id", F.col("content").alias("text"), "lang")
    fitted = models.text_model(a.filter("id % 4 <> 0"), "text", "lang")
    rows = models.predicted(fitted, a.filter("id % 4 = 0"))
    return metrics.error_pairs(rows, truth="lang").unionByName(rows.filter("lang = predicted").groupBy(F.col("lang").alias("a"), F.col("predicted").alias("b")).agg(F.count(F.lit(1)).alias("n")))


def vector_probe(spark, sf_dir):
    """248: labels of vectors by a linear probe on half of them."""
    v = table(spark, sf_dir, "embeddings").withColumn("name", F.col("label").cast("string"))
    rows = models.linear_probe(v.filter("vec_id % 2 = 0"), v.filter("vec_id % 2 = 1").select("vec_id", "embedding", "name"), "embedding", "name")
    return rows.select("vec_id", "name", "predicted")


def term_ratios(spark, sf_dir):
    """242: log-count ratios of words in toxic and other documents."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.split(F.lower("text"), "[^a-z]+").alias("w"), "toxic")
    return models.log_count_ratio(docs, "w", "toxic").select("term", scaled("ratio").alias("ratio"))


TERM_RATIOS = """WITH d AS (SELECT doc_id, toxic, list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents JOIN labels USING (doc_id)),
c AS (SELECT term, sum(toxic) + 1.0 AS p, sum(1 - toxic) + 1.0 AS q FROM (SELECT toxic, unnest(w) AS term FROM d) GROUP BY 1)
SELECT term, round(ln((p / sum(p) OVER ()) / (q / sum(q) OVER ())) * 1e6)::BIGINT AS ratio FROM c"""


def agent_decisions(spark, sf_dir):
    """125, 126, 271-275: what a rule-driven agent decides on news, and what its verifier lets stand."""
    n = news(spark, sf_dir).select("article_id", "title", "content", F.col("event_type").alias("baseline"), F.array(F.lit("error"), F.lit("view")).alias("candidates"))
    chat = lambda: agents.RuleChat([("definitions:", '{"action": "final", "decision": "select", "label": "error"}'), ("evidence:", '{"action": "definitions"}'), ("违规", '{"action": "evidence"}'), ("accept or reject", '{"answer": "accept"}')])
    d = agents.run_expert(n, chat)
    both = agents.verified(n.select("article_id", "baseline").join(d, "article_id"), chat)
    return both.groupBy("decision", "baseline", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("steps").cast("bigint").alias("steps"))


def semantic_pairs(spark, sf_dir):
    """231, 232, 265-268: cosines of neighbouring titles by a stub's vectors."""
    a = articles(spark, sf_dir).select("id", "title")
    pairs = a.join(a.select((F.col("id") - 1).alias("id"), F.col("title").alias("other")), "id").select(F.col("id").cast("string").alias("pair_id"), F.col("title").alias("left_text"), F.col("other").alias("right_text"))
    return agents.pair_scores(pairs, agents.HashEmbedding)


def stream_windows(spark, sf_dir):
    """Tumbling day windows of events, computed as a stream that is run to its end."""
    name = f"w{uuid.uuid4().hex}"
    stream = streams.window_counts(streams.read_events(spark, sf_dir), "1 day")
    q = streams.to_memory(stream, name, shared_folder(spark, "stream"), "complete")
    q.awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", scaled("value", 2).alias("value"))


STREAM_WINDOWS = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value) * 1e2)::BIGINT AS value FROM events GROUP BY ALL"

QUERIES = {f.__name__: f for f in (language_model, vector_probe, term_ratios, agent_decisions, semantic_pairs, stream_windows)}
ORACLE_SQL = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
