"""Similarities of sets, times, vectors and sequences."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import lexicon as L
from millrace.functions.text import char_grams, col, tokens

DAY = 86_400


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


@F.pandas_udf(T.StructType([T.StructField("shared", T.LongType()), T.StructField("either", T.LongType())]))
def gram_overlap(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """How many character bigrams two texts without white space (text.packed) share, and how many either has; the set of a text that stands in many pairs is made once a batch."""
    grams = {x: {x[i : i + 2] for i in range(len(x) - 1)} or set(filter(None, [x])) for x in {*a, *b}}
    shared = np.fromiter((len(grams[x] & grams[y]) for x, y in zip(a, b)), np.int64, len(a))
    size = lambda c: np.fromiter((len(grams[x]) for x in c), np.int64, len(a))
    return pd.DataFrame({"shared": shared, "either": size(a) + size(b) - shared})


def title_similarity(a, b) -> Column:
    """Jaccard of character bigrams, to 6 places."""
    return F.bround(jaccard(char_grams(a), char_grams(b)), 6)


def token_overlap(a, b) -> Column:
    return jaccard(tokens(a), tokens(b))


def gap_seconds(a, b) -> Column:
    """Seconds between two times, not negative; null if either is."""
    return F.abs(F.timestamp_diff("MICROSECOND", col(a), col(b))) / 1e6


def day_gap(a, b) -> Column:
    return F.bround(gap_seconds(a, b) / DAY, 4)


def within_days(a, b, days: int) -> Column:
    """Whether two times are at most so many days apart; false if either is null."""
    return F.coalesce(F.abs(F.timestamp_diff("MICROSECOND", col(a), col(b))) <= F.lit(days * DAY * 1_000_000), F.lit(False))


def time_close(a, b, days: int) -> Column:
    """1 at once, falling to 0 at days; one half if either time is null."""
    gap = gap_seconds(a, b)
    return F.when(gap.isNull(), 0.5).otherwise(1 - F.least(gap / DAY, F.lit(float(days))) / days)


def time_closeness(days) -> Column:
    """1 / (1 + gap), to 6 places; 0 for a null gap."""
    return F.when(col(days).isNull(), 0.0).otherwise(F.bround(1 / (1 + F.greatest(F.lit(0.0), col(days))), 6))


#: Texts below this length are matched in arrays; from it on SequenceMatcher leaves frequent characters out.
SHORT = 200
#: Pairs that are matched at once.
TOGETHER = 4096


def _matched(a: list[str], b: list[str]) -> np.ndarray:
    """How many characters SequenceMatcher matches in each pair of texts shorter than SHORT.

    A piece is a part of one text and one of the other; its longest common block (the first
    in a, then in b) leaves a piece before and one after it. Blocks of all pieces are looked for together:
    `run` holds the length (times 256) of the block that ends at each place of b, which `near` orders.
    """
    size = lambda x: np.fromiter(map(len, x), np.int32, len(x))
    points = lambda x, n: np.array(x, dtype=f"U{max(1, n.max())}").view(np.uint32).reshape(len(x), -1).T
    m, n, none = size(a), size(b), np.zeros(len(a), np.int32)
    a, b, total = points(a, m), points(b, n), np.zeros(len(a), np.int64)
    pieces = np.stack([np.arange(len(total), dtype=np.int32), none, m, none, n])
    while pieces.shape[1]:
        pieces = pieces[:, (pieces[2] > pieces[1]) & (pieces[4] > pieces[3])]
        pieces = pieces[:, np.argsort((pieces[2] - pieces[1]) * SHORT + pieces[4] - pieces[3], kind="stable")]
        left = [pieces[:, :0]]
        for s in range(0, pieces.shape[1], TOGETHER):
            pair, a_from, a_to, b_from, b_to = pieces[:, s : s + TOGETHER]
            i = a_from + np.arange((a_to - a_from).max(), dtype=np.int32)[:, None]
            j = b_from + np.arange((b_to - b_from).max(), dtype=np.int32)[:, None]
            x = np.where(i < a_to, a[np.minimum(i, len(a) - 1), pair], np.uint32(0xFFFFFFFF))  # no character, and unlike those of y
            y = np.where(j < b_to, b[np.minimum(j, len(b) - 1), pair], np.uint32(0xFFFFFFFE))
            run, near = np.zeros((len(y) + 1, len(pair)), np.uint16), (255 - np.arange(len(y), dtype=np.uint16))[:, None]
            best, end = np.zeros(len(pair), np.uint16), np.zeros(len(pair), np.int32)
            for place, c in enumerate(x, 1):
                run[1:] = (run[:-1] + np.uint16(256)) * (y == c)
                top = (run[1:] | near).max(axis=0)
                better = (top >> 8) > (best >> 8)
                best, end = np.where(better, top, best), np.where(better, place, end)
            held = (best >> 8).astype(np.int32)
            a_end, b_end = a_from + end, b_from + 256 - (best & 255).astype(np.int32)
            np.add.at(total, pair, held)
            left += [np.stack(x)[:, held > 0] for x in ((pair, a_from, a_end - held, b_from, b_end - held), (pair, a_end, a_to, b_end, b_to))]
        pieces = np.concatenate(left, axis=1)
    return total


def sequence_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """SequenceMatcher's ratio of each pair of texts."""
    out = np.ones(len(a))
    short = np.array([len(x) < SHORT and len(y) < SHORT and len(x) + len(y) > 0 for x, y in zip(a, b)], bool)
    at = np.flatnonzero(short)
    if len(at):
        a_short, b_short = [a[i] for i in at], [b[i] for i in at]
        out[at] = 2.0 * _matched(a_short, b_short) / np.fromiter((len(x) + len(y) for x, y in zip(a_short, b_short)), np.int64, len(at))
    for i in np.flatnonzero(~short):
        out[i] = SequenceMatcher(None, a[i], b[i]).ratio()
    return out


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; the order of its two texts matters."""
    return pd.Series(sequence_ratios([x or "" for x in a], [y or "" for y in b]), dtype="float64")


def dot(a, b) -> Column:
    products = F.zip_with(F.transform(col(a), lambda x: x.cast("double")), F.transform(col(b), lambda x: x.cast("double")), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """In doubles; 0 where a vector is zero. Vectors of different lengths raise."""
    checked = F.when(F.size(col(a)) == F.size(col(b)), dot(a, b)).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))
    return F.coalesce(F.try_divide(checked, norm(a) * norm(b)), F.lit(0.0))


def pair_score(text, same_entity, same_event, time, overlap) -> Column:
    """The weighted sum of the five factors of a pair."""
    w = L.PAIR_WEIGHTS
    return w["text"] * col(text) + w["entity"] * col(same_entity).cast("double") + w["event_type"] * col(same_event).cast("double") + w["time"] * col(time) + w["tokens"] * col(overlap)
