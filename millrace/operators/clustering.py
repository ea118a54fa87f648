"""Events grouped by rules, by vectors along candidate edges, and by grids of thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import DEFAULTS, Cluster
from millrace.functions.similarity import cosine
from millrace.functions.text import compact
from millrace.operators.components import components
from millrace.operators.metrics import cluster_metrics
from millrace.operators.pairs import mergeable_pairs, scored_pairs
from millrace.operators.ranking import top_candidates
from millrace.session import dimension


def assigned(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """nodes with `root`, the smallest id of their component under edges (two columns of ids); numeric ids."""
    reached = components(edges)
    return nodes.join(reached.select(F.col("node").alias(key), "component"), key, "left").withColumn("root", F.coalesce("component", key)).drop("component")


def cluster_id(members) -> object:
    """An id that depends on nothing but the members."""
    return F.concat(F.lit("EC-"), F.substring(F.sha2(F.array_join(F.transform(F.array_sort(members), lambda x: x.cast("string")), "|"), 256), 1, 16))


def rule_decisions(rows: DataFrame, block: list[str], cfg: Cluster = DEFAULTS.cluster, semantic: DataFrame | None = None) -> DataFrame:
    """Every pair of a block with its rule score and whether it merges.

    semantic (pair_id, semantic) may decide what the rule leaves open: pairs of one
    subject within the window that score at least the candidate threshold, the best of
    each left. Where it has no score for a pair the pair stays apart, or, unless the
    settings fail open, an error is raised.
    """
    pairs = scored_pairs(rows, block, cfg.time_window_days)
    by_rule = pairs.withColumn("merged", F.col("score") >= cfg.threshold)
    if semantic is None:
        return by_rule.select("left", "right", "pair_id", "score", F.lit(None).cast("double").alias("semantic"), "merged", F.when(F.col("merged"), "rule").otherwise("none").alias("method"))
    open_ = top_candidates(by_rule.filter(~F.col("merged") & (F.col("score") >= cfg.candidate_threshold) & F.col("same_subject") & F.col("near")), cfg.top_k).drop("rank", "merged").join(semantic, "pair_id", "left")
    score = F.col("semantic") if cfg.fail_open else F.when(F.col("semantic").isNull(), F.raise_error(F.lit("no semantic score")).cast("double")).otherwise(F.col("semantic"))
    by_vector = open_.withColumn("semantic", score).withColumn("merged", F.coalesce(F.col("semantic") >= cfg.similarity_threshold, F.lit(False)))
    return by_rule.filter("merged").select("left", "right", "pair_id", "score", F.lit(None).cast("double").alias("semantic"), "merged", F.lit("rule").alias("method")).unionByName(by_vector.select("left", "right", "pair_id", "score", "semantic", "merged", F.when(F.col("semantic").isNull(), "semantic_fallback").otherwise("semantic").alias("method")))


def all_rule_decisions(rows: DataFrame, cfg: Cluster = DEFAULTS.cluster) -> DataFrame:
    """Rule decisions over all pairs of rows, without blocks: of every pair that can still merge by its entity, type, time and words; all others stay apart."""
    pairs = mergeable_pairs(rows, cfg.threshold, cfg.time_window_days).withColumn("merged", F.col("score") >= cfg.threshold)
    return pairs.withColumn("method", F.when(F.col("merged"), "rule").otherwise("none"))


def edge_decisions(edges: DataFrame, vectors: DataFrame, recalls: DataFrame, threshold: float) -> DataFrame:
    """Supplied edges (left, right) merge if both ends have the same first candidate (subject, event) and a cosine of threshold.

    vectors (id, embedding); recalls (id, candidates). An end without candidate never merges.
    """
    key = recalls.select("id", F.get("candidates", 0)["subject_code"].alias("subject"), F.get("candidates", 0)["event_name"].alias("event")).join(vectors, "id")
    l, r = (key.select(*(F.col(c).alias(f"{s}_{c}") for c in ("id", "subject", "event", "embedding"))) for s in "lr")
    joined = edges.join(l, edges["left"] == l["l_id"]).join(r, edges["right"] == r["r_id"])
    same = F.coalesce((F.col("l_subject") == F.col("r_subject")) & (F.col("l_event") == F.col("r_event")), F.lit(False))
    similarity = cosine("l_embedding", "r_embedding")
    return joined.select("left", "right", same.alias("same_event"), similarity.alias("similarity")).withColumn("merged", F.col("same_event") & (F.col("similarity") >= threshold))


def edge_report(nodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """nodes (id, truth) clustered by merged decisions: metrics with the numbers of edges and merges; one row."""
    roots = assigned(nodes, decisions.filter("merged").select("left", "right"))
    counts = decisions.agg(F.count(F.lit(1)).alias("edges"), F.count_if("merged").alias("merges"))
    return cluster_metrics(roots.select("id", "truth", F.col("root").alias("predicted"))).crossJoin(counts)  # one row each


def threshold_grid(nodes: DataFrame, scores: DataFrame, thresholds: list[float], pair_gain: float = 0.05, b3_gain: float = 0.02) -> DataFrame:
    """Cluster metrics at each threshold and whether it beats the first one without losing precision.

    nodes (id, truth), scores (left, right, score); ids below 2**40, as the thresholds'
    graphs are solved at once with the grid's place in the upper bits.
    """
    spark = nodes.sparkSession
    grid = spark.createDataFrame(list(enumerate(thresholds)), "place long, threshold double")
    shift = 1 << 40
    spread = nodes.crossJoin(F.broadcast(grid))  # as many rows per node as thresholds
    edges = scores.crossJoin(F.broadcast(grid)).filter(F.col("score") >= F.col("threshold")).select((F.col("left") + F.col("place") * shift).alias("a"), (F.col("right") + F.col("place") * shift).alias("b"))
    roots = assigned(spread.withColumn("node_id", F.col("id") + F.col("place") * shift), edges, "node_id")
    out = None
    for place, threshold in enumerate(thresholds):
        one = cluster_metrics(roots.filter(F.col("place") == place).select("id", "truth", F.col("root").alias("predicted"))).select(F.lit(place).alias("place"), F.lit(threshold).alias("threshold"), "*")
        out = one if out is None else out.unionByName(one)
    base = out.filter("place = 0").select(F.col("b3_f1").alias("base_b3"), F.col("pair_recall").alias("base_recall"), F.col("pair_precision").alias("base_precision"))
    gains = out.crossJoin(base)  # one row
    return gains.withColumn("eligible", ((F.col("b3_f1") >= F.col("base_b3") + b3_gain) | (F.col("pair_recall") >= F.col("base_recall") + pair_gain)) & (F.col("pair_precision") >= F.col("base_precision"))).drop("base_b3", "base_recall", "base_precision")


def group_subjects(members: DataFrame, subjects: DataFrame, lead: int = 240, least: int = 2) -> DataFrame:
    """The one subject of each group: by the members' own code, else the only name in titles, else the only one in leads; two at any level leave none.

    members (group, id, code, title, content), subjects (code, name), a dimension.
    """
    names = subjects.select("code", compact("name").alias("alias")).filter(F.length("alias") >= least).withColumnRenamed("code", "hit")

    def found(text):
        hits = members.select("group", compact(text).alias("t")).join(dimension(names), F.contains(F.col("t"), F.col("alias")))
        return hits.groupBy("group").agg(F.collect_set("hit").alias("codes"))

    direct = members.groupBy("group").agg(F.collect_set(F.nullif("code", F.lit(""))).alias("codes"))
    levels = direct.join(found(F.col("title")).withColumnRenamed("codes", "title_codes"), "group", "left").join(found(F.concat_ws(" ", "title", F.substring("content", 1, lead))).withColumnRenamed("codes", "lead_codes"), "group", "left")
    none = F.array().cast("array<string>")
    code, method = F.lit(""), F.lit("unresolved")
    for column, name in (("lead_codes", "unique_lead_alias"), ("title_codes", "unique_title_alias"), ("codes", "direct")):
        n = F.size(F.coalesce(column, none))
        code = F.when(n == 1, F.get(column, 0)).when(n > 1, "").otherwise(code)
        method = F.when(n == 1, name).when(n > 1, f"ambiguous_{name}").otherwise(method)
    return levels.select("group", code.alias("subject"), method.alias("method"))


def group_contexts(members: DataFrame, subjects: DataFrame) -> DataFrame:
    """Groups of two members and more: subject, first label, earliest time and the articles."""
    base = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("ts"), F.min_by("label", "id").alias("label"), F.array_sort(F.collect_list("id")).alias("ids")).filter("n >= 2")
    return base.join(group_subjects(members, subjects), "group", "left")
