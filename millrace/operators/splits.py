"""Train, validation and holdout splits that keep groups on one side.

Shuffles are replaced by SHA-256 order of (seed, key), which is the same everywhere.
Splits by a share of all rows need the rows' global order: it is found by ranks within
ranges (`ordering.ordered`), so no task sorts everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import hash_rank
from millrace.operators.ordering import ordered
from millrace.session import cut


def time_split(df: DataFrame, time: str, key: str, ratio: float = 0.8) -> DataFrame:
    """side train for the first share in time (nulls last), valid for the rest; of two rows and more both have some."""
    n = df.count()
    cut_at = min(max(1, int(n * ratio)), max(1, n - 1))
    return ordered(df, F.col(time).asc_nulls_last(), F.col(key)).withColumn("side", F.when(F.col("place") <= cut_at, "train").otherwise("valid"))


def key_holdout(df: DataFrame, group: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole groups held out: the first share of them by hash, one at least; df gets `side`."""
    groups = cut(df.select(group).distinct())
    n = groups.count()
    wanted = max(1, int(n * ratio))
    chosen = ordered(groups.withColumn("__h", hash_rank(seed, group)), F.col("__h"), F.col(group)).filter(F.col("place") <= wanted).select(group, F.lit(True).alias("__held"))
    return df.join(chosen, group, "left").withColumn("side", F.when(F.col("__held"), "holdout").otherwise("train")).drop("__held")


def duplicate_holdout(df: DataFrame, group: str, key: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """key_holdout by duplicate group; rows without one are groups of their own."""
    own = F.coalesce(F.concat(F.lit("dup:"), F.nullif(F.col(group).cast("string"), F.lit(""))), F.concat(F.lit("article:"), F.col(key).cast("string")))
    return key_holdout(df.withColumn("__g", own), "__g", ratio, seed).drop("__g")


def stratified(df: DataFrame, label: str, key: str, ratio: float, seed: int) -> DataFrame:
    """Of each label the first round-half-even share by hash is calibration, the rest evaluation."""
    place = F.row_number().over(W.partitionBy(label).orderBy(hash_rank(seed, key), key))
    many = F.count(F.lit(1)).over(W.partitionBy(label))
    return df.withColumn("side", F.when(place <= F.bround(many * ratio), "calibration").otherwise("evaluation"))


def time_groups(df: DataFrame, group: str, time: str, cuts: list) -> DataFrame:
    """Groups wholly within one of the ranges that ascending cuts make (a cut belongs to the later range); others are dropped.

    df gets `side`, the range's number or -1; rows without time are dropped too.
    """
    side = F.lit(0)
    for c in cuts:
        side = side + F.when(F.col(time) >= c, 1).otherwise(0)
    sided = df.withColumn("__s", F.when(F.col(time).isNull(), -1).otherwise(side))
    spans = sided.groupBy(group).agg(F.min("__s").alias("__low"), F.max("__s").alias("__high"))
    return sided.join(spans, group).withColumn("side", F.when(F.col("__low") == F.col("__high"), F.col("__s")).otherwise(-1)).drop("__s", "__low", "__high")


def cut_times(df: DataFrame, time: str, key: str, shares: list[float]) -> list:
    """The times at which the given shares of dated rows are over."""
    dated = cut(ordered(df.filter(F.col(time).isNotNull()).select(time, key), F.col(time), F.col(key)))
    n = dated.count()
    places = [min(n, int(n * s) + 1) for s in shares]
    found = {r["place"]: r[time] for r in dated.filter(F.col("place").isin(places)).collect()}
    return [found[p] for p in places]


def temporal_two_way(df: DataFrame, group: str, time: str, key: str, holdout: float) -> DataFrame:
    return time_groups(df, group, time, cut_times(df, time, key, [1 - holdout]))


def temporal_three_way(df: DataFrame, group: str, time: str, key: str, review: float = 0.15, future: float = 0.15, end: float = 1.0) -> DataFrame:
    """History, review and future; with end below 1 later rows are ignored first."""
    if end < 1:
        last = cut_times(df, time, key, [end])[0]
        df = df.filter(F.col(time) < last)
    return time_groups(df, group, time, cut_times(df, time, key, [1 - review - future, 1 - future]))


def recent(df: DataFrame, time: str, key: str, ratio: float = 0.25) -> DataFrame:
    """The most recent share of rows."""
    wanted = max(1, round(df.count() * ratio))
    return ordered(df, F.col(time).desc_nulls_last(), F.col(key).desc()).filter(F.col("place") <= wanted)


def recent_groups(df: DataFrame, group: str, time: str, key: str, keep: float = 0.75) -> DataFrame:
    """Groups wholly within the most recent share of time."""
    first = cut_times(df, time, key, [1 - keep])[0]
    return df.withColumn("__first", F.min(time).over(W.partitionBy(group))).filter(F.col("__first") >= first).drop("__first")


def hash_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """The fold of each row by the first four bytes of its group's SHA-256."""
    return df.withColumn("fold", (F.conv(F.substring(F.sha2(F.col(group).cast("string"), 256), 1, 8), 16, 10).cast("bigint") % folds).cast("int"))


def stratified_validation(df: DataFrame, label: str, key: str, ratio: float, seed: int) -> DataFrame:
    """Per label the first share by hash validates; a label with a single row trains."""
    here = W.partitionBy(label)
    place, many = F.row_number().over(here.orderBy(hash_rank(seed, key), key)), F.count(F.lit(1)).over(here)
    wanted = F.greatest(F.lit(1), F.least(F.bround(many * ratio), many - 1))
    return df.withColumn("side", F.when((many >= 2) & (place <= wanted), "validation").otherwise("train"))


def tranches(df: DataFrame, time: str, key: str, ends: list[float], width: float) -> list[tuple[DataFrame, DataFrame]]:
    """For rolling backtests: at each end the history before it and the tranche of the given share after it."""
    placed = cut(ordered(df.filter(F.col(time).isNotNull()), F.col(time), F.col(key)))
    n = placed.count()
    return [(placed.filter(F.col("place") <= int(n * e)), placed.filter((F.col("place") > int(n * e)) & (F.col("place") <= int(n * (e + width))))) for e in ends]
