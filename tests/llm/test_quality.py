from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import quality as q
from millrace.llm.arrays import column_bytes


def of(*texts):
    data, offsets = column_bytes(pa.array(list(texts)))
    row, feature = q.features(data, offsets)
    return [set(feature[row == i].tolist()) for i in range(len(texts))]


def test_features_are_sets_of_ngrams_of_a_row():
    a, b, both, upper, empty, none = of("red fox", "blue fox", "red fox blue fox", "Red Fox", "", None)
    assert empty == none == set()
    words = lambda *t: of(*t)[0]
    assert len(words("red fox")) <= 2 + 1 + 2 + 1 and (a & b) and a != b
    assert of("red fox", "zz") [0] == a and of("zz", "red fox")[1] == a  # rows don't touch
    assert a & both and upper != a  # shapes differ, lower-cased words don't
    assert of("go go go")[0] & of("up up up")[0]  # repetition has a shape of its own


def test_dual_coordinate_descent_reaches_the_optimum():
    r = np.random.default_rng(0)
    rows = [np.flatnonzero(r.random(12) < 0.4) for _ in range(60)]
    y = np.where(np.array([0 in x for x in rows]), 1.0, -1.0)
    scale = r.uniform(0.5, 2, 12)
    w, b = q.dual_coordinate_descent(rows, y, scale, epochs=400)
    objective = lambda w, b: (w @ w + b * b) / 2 + sum(max(0, 1 - t * (scale[x] @ w[x] + b)) for x, t in zip(rows, y))
    best = objective(w, b)
    assert all(best <= objective(w + r.normal(size=12) * s, b + r.normal() * s) + 1e-6 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(30))


def test_one_class_and_no_rows():
    for y, wanted in ((np.array([1, 1]), 1), (np.array([0]), 0)):
        m = q.fit_rows([np.array([1, 2])] * len(y), y)
        assert (m.probabilities(m.margins(np.zeros(0, int), np.zeros(0, int), 1))[0] >= 0.5) == wanted
    assert q.fit_rows([], np.zeros(0, int)).weights.sum() == 0


@pytest.fixture(scope="module")
def model(spark):
    return q.train(spark, "/root/testdata/sf0.1", spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_held_out_rows(spark, model):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = q.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), model).join(labels, "doc_id")
    n = Counter({(r["quality"], r["predicted"]): r["count"] for r in scored.filter(q.fold(q.F.col("doc_id"), 3) == 1).groupBy("quality", "predicted").count().collect()})
    assert (n[0, 0] + n[1, 1]) / sum(n.values()) > 0.98


def test_hard_rows(spark, hard_rows, no_rows, model):
    out = q.score(hard_rows, model)
    assert out.count() == hard_rows.count() and out.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert q.score(no_rows, model).count() == 0
    kept = q.accepted(hard_rows, model)
    assert kept.columns == hard_rows.columns and kept.count() == out.filter("predicted = 1").count() and q.accepted(no_rows, model).count() == 0
