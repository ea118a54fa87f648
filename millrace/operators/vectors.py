"""Vectors: centroids, prototypes, exemplars, routing and constrained retrieval.

Class tables (centroids, subjects, definitions) are dimensions: as many rows as classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.config import DEFAULTS, Routing
from millrace.functions.similarity import cosine, dot, norm
from millrace.functions.text import col
from millrace.session import dimension


def unit(a) -> Column:
    n = norm(a)
    return F.transform(col(a), lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): the mean vector of each class, summed position by position."""
    each = rows.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def rocchio(rows: DataFrame, label: str, vector: str, weight: float) -> DataFrame:
    """(label, prototype): the class's mean minus weight times the mean of all others, of length 1."""
    each = rows.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    all_ = W.partitionBy("i")
    rest = F.coalesce(F.try_divide(F.sum("s").over(all_) - F.col("s"), F.sum("n").over(all_) - F.col("n")), F.lit(0.0))
    moved = each.withColumn("m", F.col("s") / F.col("n") - weight * rest)
    return moved.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("p")).select(label, unit("p").alias("prototype"))


def scored(queries: DataFrame, classes: DataFrame, vector: str, class_vector: str, how=cosine) -> DataFrame:
    """Every query with every class and the score of their vectors."""
    return queries.crossJoin(dimension(classes)).withColumn("score", how(vector, class_vector))  # classes: a dimension


def class_similarity(classes: DataFrame, label: str, vector: str) -> DataFrame:
    """(a, b, similarity) of all classes; -1 for a class with itself."""
    a, b = classes.select(F.col(label).alias("a"), F.col(vector).alias("va")), classes.select(F.col(label).alias("b"), F.col(vector).alias("vb"))
    return a.crossJoin(dimension(b)).select("a", "b", F.when(F.col("a") == F.col("b"), -1.0).otherwise(cosine("va", "vb")).alias("similarity"))


def exemplar_scores(train: DataFrame, queries: DataFrame, label: str, vector: str, key: str, k: int) -> DataFrame:
    """(key, label, score): the mean of the k best cosines of each class; train is a labelled set of bounded size."""
    t = train.select(label, F.col(vector).alias("__v"))
    pairs = queries.select(key, F.col(vector).alias("__q")).crossJoin(dimension(t)).select(key, label, cosine("__q", "__v").alias("c"))
    return pairs.withColumn("k", F.row_number().over(W.partitionBy(key, label).orderBy(F.desc("c")))).filter(F.col("k") <= k).groupBy(key, label).agg(F.avg("c").alias("score"))


def hard_negatives(confusion: DataFrame, similarity: DataFrame, k: int, weight: float = 0.35) -> DataFrame:
    """confusion (truth, predicted, n), similarity (a, b, similarity) -> of each class the k labels most easily taken for it."""
    rate = confusion.withColumn("rate", F.col("n") / F.sum("n").over(W.partitionBy("truth"))).select(F.col("truth").alias("a"), F.col("predicted").alias("b"), "rate")
    joined = similarity.filter("a <> b").join(rate, ["a", "b"], "left").withColumn("score", (1 - weight) * F.coalesce("rate", F.lit(0.0)) + weight * F.col("similarity"))
    return joined.withColumn("place", F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))).filter(F.col("place") <= k).select("a", "b", "place")


def subject_corpus(definitions: DataFrame, chars: int = 1800) -> DataFrame:
    """(code, name, text): each subject's definitions in one text, by event name."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("event_name", "description"))), lambda s: F.concat(s["event_name"], F.lit("："), s["description"]))
    return definitions.groupBy(F.col("subject_code").alias("code")).agg(F.min("subject_name").alias("name"), F.substring(F.concat(F.min("subject_name"), F.lit("。事件体系："), F.array_join(lines, "；")), 1, chars).alias("text"))


def subject_aliases(definitions: DataFrame, scope: str) -> DataFrame:
    """(aliases): the distinct subject names of a scope, two characters and more, longest first; one row."""
    names = definitions.filter(F.col("scope") == scope).select(F.trim("subject_name").alias("name")).filter(F.length("name") >= 2).distinct()
    return names.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("n"), "name"))), lambda s: s["name"]).alias("aliases"))


def route(articles: DataFrame, subjects: DataFrame, hits: DataFrame, cfg: Routing = DEFAULTS.routing) -> DataFrame:
    """articles (article_id, embedding) to subjects (code, name, embedding): the k best and the subject accepted, with method and reason.

    hits (article_id, hits): subjects named in the text. One name is accepted; without any
    the best vector is, if its score and its distance to the second reach the thresholds.
    """
    pairs = scored(articles.select("article_id", "embedding"), subjects.select("code", "name", F.col("embedding").alias("subject_vector")), "embedding", "subject_vector")
    order = F.struct((-F.col("score")).alias("s"), "code", "name")
    best = pairs.groupBy("article_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, max(2, cfg.top_k)).alias("b")).join(hits, "article_id", "left")
    top, second = -F.get("b", 0)["s"], F.coalesce(-F.get("b", 1)["s"], F.lit(-1.0))
    n = F.size(F.coalesce("hits", F.array().cast("array<string>")))
    by_name = (n == 1) & F.lit(cfg.exact_alias)
    by_vector = (n == 0) & F.lit(cfg.vector_route) & (top >= cfg.score_threshold) & (top - second >= cfg.margin_threshold)
    reason = F.when(by_name, "unique_exact_alias").when(by_vector, "score_and_margin_gate_met").when(n > 1, "ambiguous_exact_alias").when(n == 1, "exact_alias_hard_route_disabled").when(F.lit(not cfg.vector_route), "vector_route_disabled").otherwise("hard_route_gate_not_met")
    return best.select("article_id", F.when(by_name, F.get("hits", 0)).when(by_vector, F.get("b", 0)["code"]).alias("accepted"), F.when(by_name, "exact_alias").when(by_vector, "vector_high_confidence").otherwise("candidate_only").alias("method"), reason.alias("reason"), top.alias("top1_score"), (top - second).alias("top1_margin"), F.transform(F.slice("b", 1, cfg.top_k), lambda s: F.struct(s["code"].alias("subject_code"), s["name"].alias("subject_name"), F.bround(-s["s"], 6).alias("score"))).alias("candidates"))


def recall(articles: DataFrame, definitions: DataFrame, k: int = 3) -> DataFrame:
    """articles (article_id, embedding, codes) against the definitions (subject_code, event_name, embedding) of their subjects: the k best by (score to 6 places, name)."""
    each = articles.select("article_id", "embedding", F.explode("codes").alias("subject_code"))
    pairs = each.join(definitions.select("subject_code", "event_name", F.col("embedding").alias("d")), "subject_code").withColumn("score", F.bround(cosine("embedding", "d"), 6))
    best = pairs.groupBy("article_id").agg(F.count(F.lit(1)).alias("candidate_count"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "event_name", "subject_code"))), 1, k).alias("b"))
    found = best.select("article_id", "candidate_count", F.transform("b", lambda s: F.struct(s["event_name"].alias("event_name"), (-s["s"]).alias("score"), s["subject_code"].alias("subject_code"))).alias("candidates"))
    return articles.select("article_id").join(found, "article_id", "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))


def allowed_best(scores: DataFrame, allowed: DataFrame, row: str = "row", label: str = "label", score: str = "score") -> DataFrame:
    """Of each row the best label among its allowed ones (row, labels array); an empty set allows all. Ties to the smallest label."""
    joined = scores.join(allowed, row, "left")
    ok = F.array_contains("labels", F.col(label))
    best = lambda c: F.min(F.when(c, F.struct((-F.col(score)).alias("s"), F.col(label).alias("l"))))
    return joined.groupBy(row).agg(best(F.coalesce(ok, F.lit(False))).alias("own"), best(F.lit(True)).alias("all")).select(row, F.coalesce("own", "all")["l"].alias("label"))


def guarded(rows: DataFrame, k: int) -> DataFrame:
    """rows (baseline, candidates): the baseline if it is among the k first candidates, else the first; without candidates the baseline."""
    top = F.slice("candidates", 1, k)
    return rows.withColumn("label", F.when((F.size("candidates") == 0) | F.array_contains(top, F.col("baseline")), F.col("baseline")).otherwise(F.get("candidates", 0)))


def structural_match(label, accepted, method, candidates, policy: str) -> Column:
    """Whether a pseudo label agrees with retrieval: first candidate, first three, only hard-routed rows, or only rows routed by name."""
    first, three = F.get(col(candidates), 0) == col(label), F.array_contains(F.slice(col(candidates), 1, 3), col(label))
    rules = {"top1": first, "top3": three, "hard_top3": three & col(accepted).isNotNull(), "exact_top3": three & (col(method) == "exact_alias")}
    return F.coalesce(rules[policy], F.lit(False))


def chosen_scores(rows: DataFrame, gate: str = "hard") -> DataFrame:
    """rows (method, global_score, expert_score): the expert's where the route allows it."""
    open_ = {"hard": F.col("method") != "candidate_only", "exact": F.col("method") == "exact_alias", "none": F.lit(False)}[gate]
    return rows.withColumn("score", F.when(open_ & F.col("expert_score").isNotNull(), F.col("expert_score")).otherwise(F.col("global_score")))


def aligned_scores(scores: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Scores of every row for every class; -1e9 where the model doesn't know the class. classes is a dimension."""
    return rows.crossJoin(dimension(classes)).join(scores, ["row", "label"], "left").withColumn("score", F.coalesce("score", F.lit(-1e9)))


def candidate_rows(ranked: DataFrame, recalls: DataFrame, priors: DataFrame, score_k: int = 5, recall_k: int = 5, limit: int = 10) -> DataFrame:
    """A row per article and candidate with features from both rankings and the label's prior.

    ranked and recalls (row, labels array, best first), priors (label, n).
    """
    both = ranked.select("row", F.slice("labels", 1, score_k).alias("by_score")).join(recalls.select("row", F.slice("labels", 1, recall_k).alias("by_recall")), "row", "full")
    none = F.array().cast("array<string>")
    merged = both.withColumn("by_score", F.coalesce("by_score", none)).withColumn("by_recall", F.coalesce("by_recall", none)).withColumn("label", F.explode(F.slice(F.array_distinct(F.concat("by_score", "by_recall")), 1, limit)))
    placed = merged.select("row", "label", F.array_position("by_score", F.col("label")).alias("score_rank"), F.array_position("by_recall", F.col("label")).alias("recall_rank"))
    return placed.join(dimension(priors), "label", "left").select("row", "label", "score_rank", "recall_rank", ((F.col("score_rank") > 0) & (F.col("recall_rank") > 0)).alias("in_both"), F.coalesce("n", F.lit(0)).cast("bigint").alias("prior"))


def training_pairs(rows: DataFrame, negatives: int = 5) -> DataFrame:
    """rows (row, truth, candidates): one positive and up to `negatives` negatives each, (row, label, target)."""
    wrong = F.slice(F.filter(F.array_distinct("candidates"), lambda c: c != F.col("truth")), 1, negatives)
    return rows.select("row", F.explode(F.concat(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("target"))), F.transform(wrong, lambda c: F.struct(c.alias("label"), F.lit(0).alias("target"))))).alias("p")).select("row", "p.*")


def with_truth(candidates, truth, limit: int = 10) -> Column:
    """Candidates with the truth among them: in the last place if it was missing and the list is full."""
    c, t = col(candidates), col(truth)
    return F.when(F.array_contains(F.slice(c, 1, limit), t), F.slice(c, 1, limit)).otherwise(F.concat(F.slice(c, 1, limit - 1), F.array(t)))


def group_best(scores: DataFrame) -> DataFrame:
    """scores (row, label, score): the best label of each row, ties to the one that comes first (place)."""
    return scores.groupBy("row").agg(F.min_by("label", F.struct((-F.col("score")).alias("s"), "place")).alias("label"))


def local_fusion(scores: DataFrame, weight: float) -> DataFrame:
    """scores (row, label, primary, reranker, is_candidate): ranks blended within the candidates, -1e9 elsewhere."""
    here = W.partitionBy("row", "is_candidate")
    many = F.count(F.lit(1)).over(here)
    rank = lambda c: F.when(many == 1, 1.0).otherwise(1 - (F.row_number().over(here.orderBy(F.desc(c), "label")) - 1) / (many - 1))
    return scores.withColumn("fused", F.when(F.col("is_candidate"), (1 - weight) * rank("primary") + weight * rank("reranker")).otherwise(F.lit(-1e9)))


def triplets(rows: DataFrame, negatives: DataFrame, seed: int = 42) -> DataFrame:
    """rows (id, label), negatives (label, negative label): of each row another of its label and one of a hard negative's, by hash.

    Each label keeps its rows in hash order; a row's positive is the next one there, its
    negative that at the same place of the negative's label, counted round.
    """
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), 256)
    here = W.partitionBy("label")
    placed = rows.withColumn("place", F.row_number().over(here.orderBy(h, "id")) - 1).withColumn("many", F.count(F.lit(1)).over(here))
    positive = placed.select("label", "place", F.col("id").alias("positive"))
    first = negatives.groupBy("label").agg(F.min_by("negative", "place").alias("negative_label"))
    sizes = placed.groupBy("label").agg(F.max("many").alias("negative_many")).withColumnRenamed("label", "negative_label")
    anchored = placed.filter("many > 1").join(dimension(first), "label").join(dimension(sizes), "negative_label").withColumn("next", (F.col("place") + 1) % F.col("many")).withColumn("there", F.col("place") % F.col("negative_many"))
    with_positive = anchored.join(positive.withColumnRenamed("place", "next"), ["label", "next"])
    return with_positive.join(positive.select(F.col("label").alias("negative_label"), F.col("place").alias("there"), F.col("positive").alias("negative")), ["negative_label", "there"]).select(F.col("id").alias("anchor"), "positive", "negative")


def dot_scores(queries: DataFrame, prototypes: DataFrame, vector: str, prototype: str = "prototype") -> DataFrame:
    return scored(queries, prototypes, vector, prototype, dot)
