"""Quality of clusters, classifiers, retrieval and routing, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import choose_two, harmonic
from millrace.operators.ordering import ordered


def ratio(a, b, empty: float = 0.0):
    return F.coalesce(F.try_divide(a, b), F.lit(empty))


def cluster_counts(assigned: DataFrame) -> DataFrame:
    """assigned (id, truth, predicted) -> the integers that all cluster metrics are made of; one row."""
    cells = assigned.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    truth = cells.groupBy("truth").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    predicted = cells.groupBy("predicted").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    sized = cells.join(truth.select("truth", F.col("n").alias("t")), "truth").join(predicted.select("predicted", F.col("n").alias("p")), "predicted")
    inside = sized.agg(F.sum("n").alias("rows"), F.sum(choose_two("n")).alias("both"), F.sum(F.col("n") * F.col("n") / F.col("p")).alias("b3_p"), F.sum(F.col("n") * F.col("n") / F.col("t")).alias("b3_r"))
    by_truth = truth.agg(F.sum(choose_two("n")).alias("true_pairs"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("parts") > 1).alias("split"))
    by_cluster = predicted.agg(F.sum(choose_two("n")).alias("found_pairs"), F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("parts") > 1).alias("merged"))
    return inside.crossJoin(by_truth).crossJoin(by_cluster)  # one row each


def cluster_metrics(assigned: DataFrame) -> DataFrame:
    """Pairwise and B-cubed precision, recall and F1, over-merge and split rates. Without pairs a precision or recall is 1."""
    c = cluster_counts(assigned)
    p, r = ratio(F.col("both"), F.col("found_pairs"), 1.0), ratio(F.col("both"), F.col("true_pairs"), 1.0)
    bp, br = ratio(F.col("b3_p"), F.col("rows"), 1.0), ratio(F.col("b3_r"), F.col("rows"), 1.0)
    return c.select(p.alias("pair_precision"), r.alias("pair_recall"), harmonic(p, r).alias("pair_f1"), bp.alias("b3_precision"), br.alias("b3_recall"), harmonic(bp, br).alias("b3_f1"), ratio(F.col("merged"), F.col("clusters")).alias("over_merge_rate"), ratio(F.col("split"), F.col("groups")).alias("split_rate"))


def per_class(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Support, true and false positives, misses and F1 of each label of truth or prediction."""
    cells = rows.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)
    as_truth = cells.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    as_found = cells.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("found"))
    both = as_truth.join(as_found, "label", "full").fillna(0, ["support", "tp", "found"])
    return both.select("label", "support", "tp", (F.col("found") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), ratio(2 * F.col("tp"), F.col("support") + F.col("found")).alias("f1"))


def classification(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Accuracy and macro F1 over the labels of truth and prediction; one row."""
    return per_class(rows, truth, predicted).agg(ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"), F.coalesce(F.sum("support"), F.lit(0)).alias("rows"))


def confusion_matrix(rows: DataFrame, labels: Sequence, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(truth).pivot(predicted, list(labels)).agg(F.count(F.lit(1))).fillna(0)


def closed_set_coverage(train: DataFrame, valid: DataFrame, label: str = "label") -> DataFrame:
    """Rows of valid, those whose label train has, and the number of labels that it doesn't have; one row."""
    known = train.select(label).distinct().withColumn("known", F.lit(True))
    return valid.join(known, label, "left").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("known")).alias("covered"), F.count_distinct(F.when(F.col("known").isNull(), F.col(label))).alias("unseen_labels"))


def binary(rows: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """Counts at a threshold with precision, recall, F1 and accuracy; one row."""
    s, y = F.col(score) >= threshold, F.col(label) == 1
    c = rows.agg(F.count_if(s & y).alias("tp"), F.count_if(s & ~y).alias("fp"), F.count_if(~s & ~y).alias("tn"), F.count_if(~s & y).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "tn", "fn", p.alias("precision"), r.alias("recall"), harmonic(p, r).alias("f1"), ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("accuracy"))


def retrieval(rows: DataFrame, k: int, expected: str = "expected", candidates: str = "candidates") -> DataFrame:
    """Hit@1, hit@k and mean reciprocal rank over rows that have candidates; one row of counts and means."""
    place = F.array_position(F.slice(candidates, 1, k), F.col(expected))
    covered = rows.filter(F.col(expected).isNotNull() & (F.size(candidates) > 0)).withColumn("place", place)
    return covered.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("place") == 1).alias("hit_1"), F.count_if(F.col("place") > 0).alias("hit_k"), F.coalesce(F.avg(F.when(F.col("place") > 0, 1 / F.col("place")).otherwise(0.0)), F.lit(0.0)).alias("mrr"))


def routing(rows: DataFrame, k: int) -> DataFrame:
    """rows (truth, accepted, candidates): coverage and precision of hard routes, hits with the accepted subject first; one row."""
    first = F.coalesce("accepted", F.get("candidates", 0))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count("accepted").alias("routed"), F.count_if(F.col("accepted") == F.col("truth")).alias("routed_right"), F.count_if(first == F.col("truth")).alias("hit_1"), F.count_if((F.col("accepted") == F.col("truth")) | (F.col("accepted").isNull() & F.array_contains(F.slice("candidates", 1, k), F.col("truth")))).alias("hit_k"))


def route_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count("accepted").alias("accepted"), F.count_if(F.col("method") == "exact_alias").alias("exact_alias"), F.count_if(F.col("method") == "vector_high_confidence").alias("vector"), F.count_if(F.col("method") == "candidate_only").alias("candidate_only"))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """pairs (label, subject, group, method) -> counts and the number of pairs of each method as JSON; one row."""
    counts = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"), F.count_distinct("subject").alias("subjects"), F.count_distinct("group").alias("groups"))
    methods = pairs.groupBy("method").count().agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "count"))))).alias("methods"))
    return counts.crossJoin(methods)  # one row each


def error_pairs(rows: DataFrame, ordered: bool = True, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Counts of confused labels; unordered ones have the smaller label first."""
    wrong = rows.filter(F.col(truth) != F.col(predicted))
    a, b = (F.col(truth), F.col(predicted)) if ordered else (F.least(truth, predicted), F.greatest(truth, predicted))
    return wrong.groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n"))


def concentration(rows: DataFrame, top: int) -> DataFrame:
    """Errors, kinds of errors, and errors of the `top` most frequent kinds; one row."""
    pairs = error_pairs(rows)
    best = pairs.orderBy(F.desc("n"), "a", "b").limit(top).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("top_errors"))
    return pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("errors"), F.count(F.lit(1)).alias("kinds")).crossJoin(best)  # one row each


def frequent_pairs(rows: DataFrame, least: int) -> DataFrame:
    return error_pairs(rows, ordered=False).filter(F.col("n") >= least)


def candidate_coverage(rows: DataFrame) -> DataFrame:
    """rows (truth, predicted, candidates): errors, and those whose truth was a candidate; one row."""
    return rows.filter("truth <> predicted").agg(F.count(F.lit(1)).alias("errors"), F.count_if(F.array_contains("candidates", F.col("truth"))).alias("recoverable"))


def worst_classes(rows: DataFrame, support: int, top: int) -> DataFrame:
    return per_class(rows).filter(F.col("support") >= support).orderBy("f1", F.desc("support"), "label").limit(top)


def shadow_summary(decisions: DataFrame) -> DataFrame:
    """decisions (final, fallback, steps, latency_ms) -> counts, means and the nearest-rank 95th percentile of the latency; one row."""
    return decisions.agg(F.count(F.lit(1)).alias("rows"), F.count_if("changed").alias("changed"), F.count_if("fallback").alias("fallback"), F.sum("steps").alias("steps"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("latency_p95"))


def tool_usage(decisions: DataFrame) -> DataFrame:
    return decisions.select(F.explode("tools").alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


def agent_effect(rows: DataFrame) -> DataFrame:
    """rows (truth, baseline, agent): accuracies and what the agent corrected and harmed; one row."""
    was, now = F.col("baseline") == F.col("truth"), F.col("agent") == F.col("truth")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(was).alias("baseline_right"), F.count_if(now).alias("agent_right"), F.count_if(~was & now).alias("corrected"), F.count_if(was & ~now).alias("harmed"))


def slices(rows: DataFrame, named: dict) -> DataFrame:
    """Accuracy counts of overlapping slices: each row counts in every slice whose condition it meets."""
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named.items())))
    return rows.withColumn("slice", F.explode(names)).groupBy("slice").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("truth") == F.col("predicted")).alias("right"))


def margin_profile(rows: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """rows (margin, is_error): below each quantile of the margin, how many rows and errors there are. Quantiles interpolate."""
    cuts = rows.agg(F.percentile("margin", F.array(*(F.lit(q) for q in quantiles))).alias("c")).select(F.posexplode("c").alias("place", "threshold"))
    cuts = cuts.select(F.element_at(F.array(*(F.lit(q) for q in quantiles)), F.col("place") + 1).alias("quantile"), "threshold")
    return rows.crossJoin(F.broadcast(cuts)).groupBy("quantile", "threshold").agg(F.count_if(F.col("margin") <= F.col("threshold")).alias("rows"), F.count_if((F.col("margin") <= F.col("threshold")) & F.col("is_error")).alias("errors"))  # as many cuts as quantiles


def oracle_frontier(rows: DataFrame, key: str, quantiles: Sequence[float]) -> DataFrame:
    """rows (key, truth, predicted, margin): accuracy if the lowest-margin share of rows were corrected."""
    placed = ordered(rows, F.col("margin"), F.col(key)).crossJoin(rows.agg(F.count(F.lit(1)).alias("all")))  # one row
    spread = placed.withColumn("quantile", F.explode(F.array(*(F.lit(q) for q in quantiles))))
    fixed = F.col("place") <= F.floor(F.col("quantile") * F.col("all"))
    return spread.groupBy("quantile").agg(F.count_if(fixed).alias("corrected"), F.count_if(fixed | (F.col("truth") == F.col("predicted"))).alias("right"), F.count(F.lit(1)).alias("rows"))


def poisson_weight(seed, b, key):
    """A Poisson(1) number from a hash: the same for the same seed, replicate and key."""
    u = F.pmod(F.xxhash64(F.lit(seed), b, key), F.lit(1 << 52)) / float(1 << 52)
    total, term, out = 0.0, 0.36787944117144233, F.lit(8)
    edges = []
    for k in range(8):
        total += term
        edges.append((total, k))
        term /= k + 1
    for edge, k in reversed(edges):
        out = F.when(u < edge, k).otherwise(out)
    return out


def bootstrap(rows: DataFrame, key: str, replicates: int, seed: int = 42) -> DataFrame:
    """rows (key, truth, predicted, optionally other): accuracy of each replicate, and its gain over the other prediction.

    Each row gets a Poisson(1) weight per replicate, so no replicate is ever gathered; both
    predictions share the weights.
    """
    paired = "other" in rows.columns
    drawn = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", poisson_weight(seed, F.col("b"), F.col(key)))
    right = F.sum(F.col("w") * (F.col("truth") == F.col("predicted")).cast("int"))
    other = F.sum(F.col("w") * (F.col("truth") == F.col("other")).cast("int")) if paired else F.lit(0)
    each = drawn.groupBy("b").agg(F.sum("w").alias("n"), right.alias("right"), other.alias("other_right"))
    return each.select("b", ratio(F.col("right"), F.col("n")).alias("accuracy"), *([ratio(F.col("right") - F.col("other_right"), F.col("n")).alias("gain")] if paired else []))


def interval(replicates: DataFrame, value: str, confidence: float = 0.95) -> DataFrame:
    tail = (1 - confidence) / 2
    return replicates.agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"), F.avg((F.col(value) > 0).cast("int")).alias("share_positive"))


def seed_summary(reports: DataFrame, metric: str) -> DataFrame:
    """reports (config, seed, metric): mean, population deviation and range; several configurations or a seed twice raise."""
    c = reports.agg(F.count_distinct("config").alias("configs"), F.count_distinct("seed").alias("seeds"), F.count(F.lit(1)).alias("runs"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("sd"), F.min(metric).alias("low"), F.max(metric).alias("high"))
    bad = (F.col("configs") > 1) | (F.col("seeds") < F.col("runs"))
    return c.select("runs", F.when(bad, F.raise_error(F.lit("reports of different configurations, or a seed twice")).cast("double")).otherwise(F.col("mean")).alias("mean"), "sd", "low", "high")


def class_weights(rows: DataFrame, label: str, power: float = 1.0) -> DataFrame:
    """(N / (K * n)) ** power for each label, scaled to a mean of 1 over rows."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    all_ = W.partitionBy()
    raw = sizes.withColumn("raw", F.pow(F.sum("n").over(all_) / (F.count(F.lit(1)).over(all_) * F.col("n")), F.lit(power)))
    return raw.withColumn("weight", F.col("raw") * F.sum("n").over(all_) / F.sum(F.col("raw") * F.col("n")).over(all_)).drop("raw")


def inverse_weights(rows: DataFrame, label: str, power: float = 0.5) -> DataFrame:
    """n ** -power for each label, scaled to a mean of 1 over labels."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("raw", F.pow(F.col("n").cast("double"), F.lit(-power)))
    return sizes.withColumn("weight", F.col("raw") / F.avg("raw").over(W.partitionBy())).drop("raw")


def sampler(rows: DataFrame, label: str, exponent: float, epochs: int = 3) -> DataFrame:
    """Drawing rows with probability n_label ** -exponent: effective sample size and the expected share of rows drawn; one row."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.pow(F.col("n").cast("double"), F.lit(-exponent)))
    t = sizes.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("w")).alias("mass"), F.sum(F.col("n") * F.col("w") * F.col("w")).alias("square"))
    p = sizes.crossJoin(t).withColumn("p", F.col("w") / F.col("mass"))  # t is one row
    unseen = F.sum(F.col("n") * F.exp(F.col("rows") * epochs * F.log1p(-F.least(F.col("p"), F.lit(1 - 1e-12)))))
    return p.agg(F.max("rows").alias("rows"), (F.max("mass") * F.max("mass") / F.max("square")).alias("effective_size"), (1 - unseen / F.max("rows")).alias("unique_share"))
