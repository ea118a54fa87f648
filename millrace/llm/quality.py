"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

A text's features are the indicators of its word n-grams (lower-case words, one and
two in a row) and of its shape n-grams (one to three in a row; a word's shape maps
letters to x or X and digits to 9, collapses runs and keeps punctuation, and a word
equal to the one before it has a shape of its own). The indicators are scaled by the
classes' log-count ratio, a linear hinge-loss model is fitted on them by dual
coordinate descent, and its weights are interpolated with their mean magnitude.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import BLANKS, column_bytes, gram_hashes, lower_ascii, mixed, run_hashes, spans, tidy
from millrace.llm.session import cut, documents, fold, small_batches, table
from millrace.llm.toxicity import fit_logistic, labelled_sample

#: Hashed features are numbered below 2**BITS.
BITS = 18
#: Documents of either class that calibration on held documents needs; with fewer, all are fitted and calibrate.
ENOUGH = 25
REPEATED = np.uint64(0x5851F42D4C957F2D)


def _shape_classes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[ord("a") : ord("z") + 1] = ord("x")
    out[0x80:] = ord("x")
    out[ord("A") : ord("Z") + 1] = ord("X")
    out[ord("0") : ord("9") + 1] = ord("9")
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every distinct indicator of the rows data[offsets[i]:offsets[i + 1]], by row."""
    starts, ends, first = spans(data, offsets, BLANKS)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    words = run_hashes(lower_ascii(data), starts, ends)
    classes = _shape_classes()[data]
    keep = np.ones(len(data), bool)
    keep[1:] = classes[1:] != classes[:-1]
    keep[starts] = True
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    shapes = run_hashes(classes[keep], place[starts], place[ends])
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    shapes = np.where(again, REPEATED, shapes)
    rows, ids = [], []
    for salt, stream, k in ((1, words, 1), (2, words, 2), (3, shapes, 1), (4, shapes, 2), (5, shapes, 3)):
        grams = gram_hashes(stream, k)
        whole = row[: len(grams)] == row[k - 1 :]
        rows.append(row[: len(grams)][whole])
        ids.append(mixed(grams[whole] + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - BITS))
    joined = np.unique((np.concatenate(rows) << BITS) | np.concatenate(ids).astype(np.int64))
    return joined >> BITS, joined & ((1 << BITS) - 1)


@dataclass
class NaiveBayesSVM:
    """weights of the indicators, an intercept, and the slope and intercept of the probability."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, weights=self.weights[feature], minlength=n) + self.bias

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + cost * sum hinge(y * (w . x + b)), x[j] = scale[j] for j in rows[i]; the bias is a column of ones."""
    w, b = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    values = [scale[r] for r in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    order = np.arange(len(rows))
    shuffle = np.random.default_rng(seed)
    for _ in range(epochs):
        shuffle.shuffle(order)
        most = 0.0
        for i in order:
            gradient = y[i] * (values[i] @ w[rows[i]] + b) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                b += step
                most = max(most, abs(new - alpha[i]) * norms[i])
                alpha[i] = new
        if most < 1e-3:
            break
    return w, b


def fit_rows(rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0, mixing: float = 0.25, held: int = 5) -> NaiveBayesSVM:
    """Fit on the distinct feature numbers of each document; every held-th document only calibrates the probability.

    With a single class the model answers that class for every text.
    """
    size = 1 << BITS
    if not len(rows) or len(set(y.tolist())) < 2:
        share = float(np.mean(y)) if len(rows) else 0.5
        return NaiveBayesSVM(np.zeros(size), 0.0, 0.0, 5.0 if share >= 0.5 else -5.0)
    train = np.arange(len(rows)) % held != 0
    if min(np.bincount(y[~train], minlength=2)) < ENOUGH or min(np.bincount(y[train], minlength=2)) < ENOUGH:
        train[:] = True
    p, q = np.full(size, smoothing), np.full(size, smoothing)
    for r, label, own in zip(rows, y, train):
        if own:
            (p if label else q)[r] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    picked = np.flatnonzero(train)
    w, b = dual_coordinate_descent([rows[i] for i in picked], np.where(y[picked] > 0, 1.0, -1.0), ratio)
    w = (1 - mixing) * np.abs(w).sum() / max(1, np.count_nonzero(w)) + mixing * w
    w = w * ratio
    model = NaiveBayesSVM(w, b * mixing)
    check = np.flatnonzero(~train) if not train.all() else picked
    margins = np.array([w[rows[i]].sum() + model.bias for i in check])
    spread = float(margins.std()) or 1.0
    slope, shift = fit_logistic(margins / spread, y[check])
    model.slope, model.shift = slope / spread, shift
    return model


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column(0))
        row, feature = features(data, offsets)
        edges = np.searchsorted(row, np.arange(len(batch.column(0)) + 1))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(feature, pa.int32())), batch.column(1)], ["features", "y"])


def fit(sample: DataFrame) -> NaiveBayesSVM:
    """Fit on sample (doc_id, text, y), which must be bounded: its feature numbers go to the driver."""
    rows = sample.orderBy(F.xxhash64("doc_id", "text"), "doc_id").select("text", "y").mapInArrow(tidy(_sample_features), "features array<int>, y int").toArrow()
    lists = rows.column("features").combine_chunks()
    values, edges = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    return fit_rows([values[a:b] for a, b in zip(edges[:-1], edges[1:])], rows.column("y").to_numpy())


def score(docs: DataFrame, model: NaiveBayesSVM) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score, predicted.

    One row per row of docs, repeated rows included. A null text counts as empty; an
    empty text has no indicator and gets the score of the bias alone.
    """
    small_batches(docs.sparkSession)
    weights, bias, slope, shift = model.weights.astype(np.float32), model.bias, model.slope, model.shift  # 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = NaiveBayesSVM(weights, bias, slope, shift)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            p = own.probabilities(own.margins(*features(data, offsets), len(offsets) - 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents(docs).mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: NaiveBayesSVM, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose text scores below least."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)
    weights, bias, slope, shift = model.weights.astype(np.float32), model.bias, model.slope, model.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = NaiveBayesSVM(weights, bias, slope, shift)
        for batch in batches:
            data, offsets = column_bytes(batch.column(place))
            p = own.probabilities(own.margins(*features(data, offsets), len(offsets) - 1))
            yield batch.filter(pa.array(p >= least))

    return docs.mapInArrow(tidy(run), docs.schema)


#: Labelled documents of either class that the production model is fitted on.
PER_CLASS = 2500


def train(spark, sf_dir, docs: DataFrame) -> NaiveBayesSVM:
    """The production model: fitted on rows whose crc32(doc_id) mod 3 is not 1."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 3) != 1)
    return fit(cut(labelled_sample(documents(docs), labels, "quality", PER_CLASS)))


def op3_quality(spark, sf_dir):
    """Every document scored by a model fitted on labelled rows with crc32(doc_id) mod 3 other than 1."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(spark, sf_dir, docs)).select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
