import math

import numpy as np
import pytest

from millrace.llm import embedding_dedup as e


def expected(rows, threshold=0.98):
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    n = len(rows)
    links, comp = [0] * n, list(range(n))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    def cosine(a, b):
        a, b = np.array(a, float), np.array(b, float)
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return a @ b / math.sqrt((a @ a) * (b @ b))

    for i in range(n):
        for j in range(i):
            (a, u, l), (b, v, m) = rows[i], rows[j]
            if a is not None and b is not None and l is not None and l == m and ok(u) and ok(v) and len(u) == len(v) and cosine(u, v) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                comp[x] = y
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return sorted(((rows[i][0], links[i], least.get(find(i)) if rows[i][0] is not None else None) for i in range(n)), key=str)


def found(out):
    rows = out.collect()
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in rows)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=str)


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], f"vec_id long, embedding array<{kind}>, label int, k1 int, copies string").repartition(3)


def near(r, v, angle):
    w = r.normal(size=len(v))
    w -= w @ v / (v @ v) * v
    return math.cos(angle) * v / np.linalg.norm(v) + math.sin(angle) * w / np.linalg.norm(w)


@pytest.mark.parametrize("seed", range(2))
def test_links_equal_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 16)
    r = np.random.default_rng(seed)
    rows = []
    for label in (0, 1):
        for _ in range(12):
            base = r.normal(size=64)
            rows += [(0, near(r, base, r.choice([0, 0.03, 0.08, 0.13, 0.2])), label) for _ in range(r.integers(1, 14))]
        base = r.normal(size=64)
        rows += [(0, base, label)] * 40
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (_, v, label) in enumerate(rows)]
    assert found(e.near_vectors(table(spark, rows))) == expected(rows)


def test_hard_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (3, [1.0, 2.0], 2), (4, [1.0, 2.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [1.0, 2.0, 0.0], 1), (12, [1.0, 2.0], 1), (12, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (13, [1e-300, 2e-300], 1), (14, [1e300, 2e300], 1), (15, [3.0], 1), (16, [-3.0], 1)]
    df = table(spark, rows, "double")
    assert found(e.near_vectors(df)) == expected(rows)
    assert e.near_vectors(df.limit(0)).count() == 0


def test_more_vertices_find_the_same(spark):
    r = np.random.default_rng(5)
    rows = []
    for _ in range(25):
        base = r.normal(size=32)
        rows += [near(r, base, 0.1) for _ in range(3)]
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(rows)]
    assert found(e.near_vectors(table(spark, rows), vertices=2, tables=3)) == expected(rows)


def test_rotation_keeps_angles():
    r = np.random.default_rng(2)
    x = e.unit_rows(r.normal(size=(20, 48)))
    y = e.rotated(x, 3)
    assert y.shape == (20, 64) and np.allclose(y @ y.T, x @ x.T)


def test_recall_of_buckets():
    r = np.random.default_rng(4)
    x = e.unit_rows(r.normal(size=(4000, 64)))
    y = np.array([near(r, v, math.acos(0.98)) for v in x])
    met = np.zeros(4000, bool)
    for t in range(e.plan(4000, 64)[1]):
        a, b = e.buckets(x, t), e.buckets(y, t)
        met |= (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
    assert met.mean() > 0.999


def test_names_grow_with_the_logarithm_of_the_vectors():
    assert e.plan(0, 1) == (1, 2) and e.plan(65_536, 64) == (1, 2) and e.plan(65_537, 64) == (2, 3) and e.plan(10**9, 64) == (4, 3)
    for n in (10**4, 10**6, 10**8, 10**10):  # a vector is sent for few blocks of a bucket, however many vectors there are
        vertices, _ = e.plan(n, 64)
        assert n * e.PROBES**vertices / 128**vertices <= e.BLOCKS * e.BLOCK


def test_an_id_with_several_vectors_or_labels(spark):
    r = np.random.default_rng(8)
    a, b = r.normal(size=64), r.normal(size=64)
    rows = [(5, a, 1), (5, b, 1), (6, near(r, a, 0.05), 1), (7, near(r, b, 0.05), 1), (5, a, 2), (9, near(r, a, 0.05), 2), (3, near(r, b, 0.04), 1), (8, b, 1), (5, b, 3)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert found(e.near_vectors(table(spark, rows))) == expected(rows)


@pytest.mark.parametrize(("dimension", "vertices"), [(64, 1), (64, 2), (64, 3), (768, 1), (768, 2), (768, 3)])
def test_recall_at_the_threshold(dimension, vertices):
    r = np.random.default_rng(dimension + vertices)
    x = e.unit_rows(r.normal(size=(600, dimension)))
    y = np.array([near(r, v, math.acos(0.98)) for v in x])
    met = np.zeros(600, bool)
    for t in range(e.TABLES.get(vertices, e.MORE_TABLES)):
        p, q = e.buckets(x, t, vertices), e.buckets(y, t, vertices)
        met |= (p == q[:, :1]).any(1) | (q == p[:, :1]).any(1)
    assert met.mean() > 0.99
