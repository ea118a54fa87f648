"""The whole path from articles to guarded alerts, as a batch and as the answer to a request."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schemas
from millrace.config import DEFAULTS, Settings
from millrace.functions import rules, text
from millrace.operators import clustering, lifecycle
from millrace.operators.components import components
from millrace.session import cut

#: Articles up to which all pairs are compared where no block is given.
ALL_PAIRS = 2000
REQUEST = range(1, 21)


def keyword_predictions(articles: DataFrame) -> DataFrame:
    return articles.select("article_id", *(c.alias(k) for k, c in rules.keyword_event("title", "content").items()))


def run(articles: DataFrame, predict: Callable[[DataFrame], DataFrame] = keyword_predictions, block: list[str] | None = None, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """articles (see schemas.ARTICLE) -> predictions, decisions, clusters, alerts, claims, gates, lifecycles and signals.

    Articles of a block are compared in pairs; without a block all are, so more than
    ALL_PAIRS articles need one (columns of articles, such as the entity). An article_id
    that stands twice is one article.
    """
    articles = cut(articles.dropDuplicates(["article_id"]))
    if block is None:
        if articles.count() > ALL_PAIRS:
            raise ValueError("so many articles need a block to be compared in")
        block = []
    predictions = cut(predict(articles))
    rows = articles.join(predictions, "article_id").filter("has_event")
    active = cut(rows.withColumn("id", F.xxhash64("article_id")))
    decisions = cut(clustering.rule_decisions(active.select("id", "title", F.col("evidence_sentence").alias("evidence"), "entity", "event_type", F.col("publish_time").alias("ts"), *(c for c in block if c not in ("title", "entity", "event_type"))), block, settings.cluster))
    reached = components(decisions.filter("merged").select("left", "right"))
    members = cut(active.join(reached.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("cluster_id", F.coalesce("component", "id")).withColumn("confidence", F.col("classifier_confidence")).drop("component"))
    clusters = cut(lifecycle.clusters(members).withColumn("event_cluster_id", clustering.cluster_id(F.col("article_ids"))))
    alerts = cut(lifecycle.alerts(members, clusters))
    lives = cut(lifecycle.lifecycles(lifecycle.evidence(members), settings.lifecycle))
    delivery = lifecycle.delivery_gates(alerts, lives, settings.evidence_gate)
    claims = lifecycle.claims(alerts, lives)
    gates = delivery.unionByName(lifecycle.stage_gates(lives, settings.evidence_gate), allowMissingColumns=True)
    names = active.select("id", "article_id")
    named = decisions.join(names.select(F.col("id").alias("left"), F.col("article_id").alias("left_article_id")), "left").join(names.select(F.col("id").alias("right"), F.col("article_id").alias("right_article_id")), "right").drop("left", "right", "pair_id")
    return {"predictions": predictions, "decisions": named, "clusters": clusters, "alerts": lifecycle.guarded(alerts, delivery, claims), "claims": claims, "gates": gates, "lifecycles": lives, "signals": lifecycle.signals(lives, alerts, settings.learning)}


def analyse(spark: SparkSession, payload: dict) -> dict:
    """The answer to a request of 1 to 20 articles (title, source, publish_time, content): all tables as plain rows.

    What a request says about subjects and labels is ignored; they are for the engine to find.
    """
    given = payload.get("articles") or []
    if len(given) not in REQUEST:
        raise ValueError("a request has 1 to 20 articles")
    scope = payload.get("scope", "company")
    rows = [(f"REQ-{i + 1}", a.get("title"), a.get("publish_time"), a.get("source"), a.get("content")) for i, a in enumerate(given)]
    raw = spark.createDataFrame(rows, "article_id string, title string, publish_time string, source string, content string")
    empty = {f.split()[0] for f in schemas.ARTICLE.split(", ")} - {"article_id", "title", "publish_time", "source", "content", "task_scope"}
    articles = raw.select("article_id", text.clean("title").alias("title"), text.parse_time("publish_time").alias("publish_time"), text.clean("source").alias("source"), text.clean("content").alias("content"), F.lit(f"{scope}_event").alias("task_scope"), *(F.lit(None).cast("string").alias(c) for c in sorted(empty)))
    return {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in run(articles).items()}
