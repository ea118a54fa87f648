"""Top-K, margins, quotas and round robins. Ties are always broken by an id, so results are the same at any partitioning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.ordering import ordered, running


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group in an order; Spark keeps k rows a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= max(1, k))


def top_candidates(pairs: DataFrame, k: int) -> DataFrame:
    """pairs (left, right, pair_id, score): of each left its k best, ties by pair_id."""
    return top_k(pairs, ["left"], [F.desc("score"), "pair_id"], k)


def selected_pairs(features: DataFrame, threshold: float, k: int, need_semantic: bool = True) -> DataFrame:
    """features (left, right, pair_id, score, semantic) of at least threshold, the k best of each left, each pair once."""
    found = features.filter(F.col("score") >= threshold)
    if need_semantic:
        found = found.filter(F.col("semantic").isNotNull())
    return top_k(found.dropDuplicates(["pair_id"]), ["left"], [F.desc("score"), "pair_id"], k)


def best_neighbours(candidates: DataFrame, limit: int) -> DataFrame:
    """candidates (left, right, score, gap), a pair possibly often: each pair's best, then of each right the `limit` best (score, gap, larger left first)."""
    best = candidates.groupBy("right", "left").agg(F.max(F.struct("score", (-F.col("gap")).alias("nearness"))).alias("best"))
    return top_k(best.select("right", "left", "best.score", (-F.col("best.nearness")).alias("gap")), ["right"], [F.desc("score"), "gap", F.desc("left")], limit)


def rank_scores(scores: DataFrame, row: str = "row", label: str = "label", score: str = "score") -> DataFrame:
    """1 for a row's best label down to 0 for its last, ties by label; a single label has 1."""
    here = W.partitionBy(row)
    place = F.row_number().over(here.orderBy(F.desc(score), label)) - 1
    many = F.count(F.lit(1)).over(here) - 1
    return scores.withColumn("rank_score", F.when(many == 0, 1.0).otherwise(1 - place / many))


def blended(primary: DataFrame, semantic: DataFrame, weight: float) -> DataFrame:
    """Convex combination of two tables (row, label, rank_score)."""
    other = semantic.select("row", "label", F.col("rank_score").alias("__other"))
    return primary.join(other, ["row", "label"]).select("row", "label", ((1 - weight) * F.col("rank_score") + weight * F.col("__other")).alias("score"))


def margins(scores: DataFrame, row: str = "row", label: str = "label", score: str = "score") -> DataFrame:
    """Of each row the best label (ties: smallest), its score and the distance to the second best (null if there is none)."""
    best = F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(label).alias("l"))))
    top = scores.groupBy(row).agg(F.slice(best, 1, 2).alias("top"))
    return top.select(row, F.get("top", 0)["l"].alias("best"), (-F.get("top", 0)["s"]).alias("best_score"), (F.get("top", 1)["s"] - F.get("top", 0)["s"]).alias("margin"))


def gated(df: DataFrame, primary: str, secondary: str, margin: str, threshold: float) -> DataFrame:
    """The secondary label where the margin is at most threshold."""
    return df.withColumn("label", F.when(F.col(margin) <= threshold, F.col(secondary)).otherwise(F.col(primary)))


def row_z(scores: DataFrame, row: str = "row", score: str = "score", least: float = 1e-6) -> DataFrame:
    here = W.partitionBy(row)
    return scores.withColumn("z", (F.col(score) - F.avg(score).over(here)) / F.greatest(F.stddev_pop(score).over(here), F.lit(least)))


def calibrated(train: DataFrame, scores: DataFrame, method: str = "zscore") -> DataFrame:
    """Scores (row, label, score) calibrated per label on train: identity, zscore, or platt (train also has hit, 0 or 1)."""
    if method == "identity":
        return scores.withColumn("calibrated", F.col("score"))
    if method == "zscore":
        fitted = train.groupBy("label").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
        return scores.join(fitted, "label", "left").withColumn("calibrated", (F.col("score") - F.coalesce("mean", F.lit(0.0))) / F.greatest(F.coalesce("sd", F.lit(1.0)), F.lit(1e-6))).drop("mean", "sd")
    if method != "platt":
        raise ValueError(f"no such calibration: {method}")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["score"].to_numpy(float), pdf["hit"].to_numpy(float)
        spread = x.std() or 1.0
        z = np.column_stack([(x - x.mean()) / spread, np.ones(len(x))])
        b = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            b -= np.clip(np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (p - y) + 0.1 * b), -2, 2)
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "slope": [b[0] / spread], "shift": [b[1] - b[0] * x.mean() / spread]})

    kind = train.schema["label"].dataType.simpleString()
    # one small state per label: the sample of a label must fit one task
    fitted = train.select("label", "score", "hit").groupBy("label").applyInPandas(fit, f"label {kind}, slope double, shift double")
    return scores.join(fitted, "label", "left").withColumn("calibrated", 1 / (1 + F.exp(-(F.coalesce("slope", F.lit(1.0)) * F.col("score") + F.coalesce("shift", F.lit(0.0)))))).drop("slope", "shift")


def round_robin(df: DataFrame, by: str, order: Sequence[Column], count: int) -> DataFrame:
    """The k-th of every class in turn until count rows: classes in their own order within a turn."""
    turn = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return df.withColumn("turn", turn).orderBy("turn", by).limit(count)


def low_margins(df: DataFrame, by: str, margin: str, key: str, count: int) -> DataFrame:
    return round_robin(df, by, [F.asc(margin), F.asc(key)], count)


def disagreements(df: DataFrame, primary: str, secondary: str, margin: str, key: str, count: int) -> DataFrame:
    """Class-balanced low margins among rows on which two models differ."""
    return low_margins(df.filter(F.col(primary) != F.col(secondary)), primary, margin, key, count)


def stable_top(df: DataFrame, keys: Sequence[Column], key: str, count: int) -> DataFrame:
    return df.orderBy(*keys, key).limit(count)


def water_filled(sizes: dict, count: int) -> dict:
    """Equal shares of count over classes that hold so many; what a class can't take goes to the others, smaller names first."""
    left, out = count, dict.fromkeys(sizes, 0)
    open_ = sorted(k for k in sizes if sizes[k] > 0)
    while left > 0 and open_:
        share = max(1, left // len(open_))
        for k in list(open_):
            take = min(share, sizes[k] - out[k], left)
            out[k] += take
            left -= take
            if out[k] == sizes[k]:
                open_.remove(k)
            if not left:
                break
    return out


def temporal_coverage(df: DataFrame, by: str, time: str, key: str, count: int) -> DataFrame:
    """Equal quotas per class, each spread evenly over the class's time axis (nulls last). The driver holds one number per class."""
    sizes = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    quotas = df.sparkSession.createDataFrame([(k, q) for k, q in water_filled(sizes, count).items() if q], f"{by} {df.schema[by].dataType.simpleString()}, quota long")
    placed = df.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(F.asc_nulls_last(time), key)) - 1).withColumn("held", F.count(F.lit(1)).over(W.partitionBy(by)))
    wanted = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("quota") - 1), lambda i: F.when(F.col("quota") == 1, F.lit(0).cast("bigint")).otherwise(F.bround(i * (F.col("held") - 1) / (F.col("quota") - 1)).cast("bigint")))
    return placed.join(F.broadcast(quotas), by).filter(F.array_contains(wanted, F.col("place"))).drop("place", "held", "quota")


def risk_quota(sizes: dict, error_rate: dict, count: int) -> dict:
    """Places dealt one by one to the class with the largest deficit against its share of errors (ties: smaller name)."""
    weights = {k: max(0.0, error_rate.get(k, 0.0)) * sizes[k] for k in sizes}
    total = sum(weights.values())
    out = dict.fromkeys(sizes, 0)
    for i in range(min(count, sum(sizes.values()))):
        open_ = [k for k in sorted(sizes) if out[k] < sizes[k]]
        share = {k: (weights[k] / total if total else 1 / len(sizes)) * (i + 1) - out[k] for k in open_}
        out[max(open_, key=lambda k: (share[k], [-ord(c) for c in str(k)]))] += 1
    return out


def risk_weighted(df: DataFrame, by: str, margin: str, key: str, error_rate: dict, count: int) -> DataFrame:
    """The lowest margins of each class, as many as its risk quota. The driver holds one number per class."""
    sizes = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    quotas = df.sparkSession.createDataFrame([(k, q) for k, q in risk_quota(sizes, error_rate, count).items() if q], f"{by} {df.schema[by].dataType.simpleString()}, quota long")
    placed = df.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(margin, key)))
    return placed.join(F.broadcast(quotas), by).filter("place <= quota").drop("place", "quota")


def diverse(df: DataFrame, by: str, margin: str, vector: str, key: str, per_class: int, weight: float = 0.5, group: str | None = None) -> DataFrame:
    """Greedy choice within each class: low margins far from those chosen before; of a duplicate group at most one.

    df (key, by, margin, vector, group). A class's candidates must fit one task; cut them
    by top_k on the margin before.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([margin, key]).reset_index(drop=True)
        x = np.array(pdf[vector].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        near = np.full(len(x), 1.0)
        free = np.ones(len(x), bool)
        rows = []
        while free.any() and len(rows) < per_class:
            value = np.where(free, weight * near - pdf[margin].to_numpy(float), -np.inf)
            i = int(value.argmax())
            rows.append((pdf[key][i], pdf[by][i], len(rows) + 1))
            free[i] = False
            if group is not None and pd.notna(pdf[group][i]):
                free &= (pdf[group] != pdf[group][i]).to_numpy()
            near = np.minimum(near, 1 - x @ x[i])
        return pd.DataFrame(rows, columns=[key, by, "turn"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.groupBy(by).applyInPandas(choose, f"{key} {kinds[key]}, {by} {kinds[by]}, turn int")


def majority(votes: DataFrame, row: str = "row", label: str = "label") -> DataFrame:
    """The most frequent label of each row, ties to the smallest."""
    return top_k(votes.groupBy(row, label).agg(F.count(F.lit(1)).alias("votes")), [row], [F.desc("votes"), F.asc(label)], 1).drop("rank")


def margin_threshold(df: DataFrame, margin: str, hit: str, precision: float, support: int) -> DataFrame:
    """The smallest margin such that rows at or above it are right often enough and many enough; one row, null if there is none."""
    by_margin = df.groupBy(margin).agg(F.sum(F.col(hit).cast("bigint")).alias("hits"), F.count(F.lit(1)).alias("n"))
    good = (F.col("hits") >= precision * F.col("n")) & (F.col("n") >= support)
    return running(by_margin, F.desc(margin), "hits", "n").filter(good).agg(F.min(margin).alias("threshold"), F.max("n").alias("support"), F.min_by("hits", margin).alias("hits"))


def best_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """The score threshold of the best (F1, precision, accuracy, threshold), with its counts; one row."""
    totals = df.agg(F.sum(F.col(label).cast("bigint")).alias("positives"), F.count(F.lit(1)).alias("rows"))
    by_score = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(label).cast("bigint")).alias("tp"), F.count(F.lit(1)).alias("predicted"))
    swept = running(by_score, F.desc("threshold"), "tp", "predicted").crossJoin(F.broadcast(totals))  # totals is one row
    swept = swept.withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("positives") - F.col("tp")).withColumn("tn", F.col("rows") - F.col("positives") - F.col("fp"))
    key = F.struct((2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"), (F.col("tp") / F.col("predicted")).alias("precision"), ((F.col("tp") + F.col("tn")) / F.col("rows")).alias("accuracy"), "threshold")
    return swept.agg(F.max_by(F.struct("threshold", "tp", "fp", "fn", "tn"), key).alias("best")).select("best.*")


def whole_groups(df: DataFrame, subject: str, group: str, size: str, cap: int) -> DataFrame:
    """Groups taken in turns over subjects (more groups first) while the running size stays within cap; a group that would pass it is left out.

    df (subject, group, size). The order is distributed; only the sequential skip rule
    runs in one task, over a row of three numbers per group that may still fit.
    """
    many = df.withColumn("groups", F.count(F.lit(1)).over(W.partitionBy(subject))).withColumn("turn", F.row_number().over(W.partitionBy(subject).orderBy(group)))
    order = many.filter(F.col(size) <= cap).withColumn("place", F.row_number().over(W.orderBy("turn", F.desc("groups"), subject)))

    def take(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used = 0
        for pdf in parts:
            keep = []
            for n in pdf[size]:
                keep.append(used + n <= cap)
                used += n if keep[-1] else 0
            yield pdf[keep]

    return order.coalesce(1).sortWithinPartitions("place").mapInPandas(take, order.schema).drop("groups", "turn")


def hard_examples(df: DataFrame, subject_margin: float, event_margin: float, most: int, rejection: bool = True) -> DataFrame:
    """df (article_id, accepted, subject_margin, event_scores array): rows worth a second look with reasons and an additive priority."""
    gap = F.when(F.size("event_scores") > 1, F.get("event_scores", 0) - F.get("event_scores", 1))
    low_subject = F.col("subject_margin") < subject_margin
    low_event = F.coalesce(gap < event_margin, F.lit(False))
    none = F.size("event_scores") == 0
    rejected = F.col("accepted").isNull() & F.lit(rejection)
    reasons = F.array_compact(F.array(F.when(rejected, "subject_rejected"), F.when(low_subject, "subject_low_margin"), F.when(low_event, "event_low_margin"), F.when(none, "event_no_candidate")))
    priority = F.when(rejected, 2.0).otherwise(0.0) + F.when(low_subject, subject_margin - F.col("subject_margin")).otherwise(0.0) + F.when(low_event, event_margin - gap).otherwise(0.0) + F.when(none, 2.0).otherwise(0.0)
    return df.withColumn("reasons", reasons).withColumn("priority", F.bround(priority, 6)).filter(F.size("reasons") > 0).orderBy(F.desc("priority"), "article_id").limit(most)


def agent_cases(df: DataFrame, most: int, confidence: float, margin: float) -> DataFrame:
    """df (idx, method, confidence, subject_margin, disagrees): hard-routed rows by 2 for a disagreement, 1 for low confidence, 1 for a low margin; ties to the larger idx."""
    points = F.when(F.col("disagrees"), 2).otherwise(0) + F.when(F.col("confidence") <= confidence, 1).otherwise(0) + F.when(F.col("subject_margin") <= margin, 1).otherwise(0)
    return df.filter(F.col("method") != "candidate_only").withColumn("points", points).filter("points > 0").orderBy(F.desc("points"), F.asc("confidence"), F.desc("idx")).limit(most)


def lowest_percent(df: DataFrame, margin: str, key: str, percent: int) -> DataFrame:
    """The percent of rows with the lowest margins, ties by key, rounded down."""
    placed = ordered(df, F.asc(margin), F.asc(key))
    return placed.filter(F.col("place") <= placed.count() * percent // 100).drop("place")


def review_items(df: DataFrame, scope: str, reason: str = "low_margin_top20pct") -> DataFrame:
    """df (article_id, baseline, margin, candidates, status) of chosen rows -> review queue with priorities from 1 (lowest margin) down."""
    placed = ordered(df, F.asc("margin"), F.asc("article_id"))
    n = max(1, placed.count())
    seed = F.concat_ws("|", F.lit(scope), "article_id", "baseline", F.array_join("candidates", ","), "status")
    return placed.select(F.concat(F.lit("RV-"), F.substring(F.sha2(F.concat_ws("|", seed, F.lit(reason)), 256), 1, 16)).alias("review_id"), "article_id", F.lit(scope).alias("scope"), F.col("baseline").alias("baseline_event"), F.col("candidates").alias("candidate_events"), F.col("margin").alias("svc_margin"), F.col("status").alias("route_status"), (1 - (F.col("place") - 1) / n).alias("priority"), F.lit(reason).alias("reason"), F.sha2(seed, 256).alias("provenance_hash"))


def batches(df: DataFrame, order: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """Rows in order dealt into batches of the given sizes, whose sum must be the number of rows."""
    placed = ordered(df, *map(F.asc, order))
    if placed.count() != sum(sizes):
        raise ValueError("the sizes of the batches don't add up to the rows")
    ends = np.cumsum(sizes).tolist()
    number = F.lit(len(ends))
    for i in range(len(ends) - 1, 0, -1):
        number = F.when(F.col("place") <= ends[i - 1], i).otherwise(number)
    return placed.withColumn("batch", number).drop("place")
