import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import near_dedup as n
from millrace.llm.arrays import column_bytes


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def expected(rows):
    sets, parent = {}, {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
            parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(shingles(t)), None if i is None else find(i), i is not None and find(i) == i) for i, t in rows), key=str)


def found(out):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()), key=str)


def edited(r, words, share):
    out = list(words)
    for _ in range(int(len(words) * share)):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


def corpus(seed, groups=12, most=25):
    r = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([4, 30, 120]))]
        for _ in range(r.randint(1, most)):
            rows.append((i, " ".join(edited(r, base, r.choice([0, 0.01, 0.02, 0.03, 0.05])))))
            i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_all_pairs(spark, seed):
    rows = corpus(seed)
    assert found(n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == expected(rows)


def test_blocks_and_stars_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(n, "STAR", 4)
    monkeypatch.setattr(n, "BLOCK", 8)
    monkeypatch.setattr(n, "DEALT", 8)
    rows = corpus(7, 5, 60)
    assert found(n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


def crowd(spark, n):
    """n texts around one passage, of which most are too far from one another, and n near copies of one text that hold it too."""
    r = random.Random(n)
    passage, base = [f"p{i}" for i in range(60)], [f"b{i}" for i in range(40)]
    far = [" ".join(passage + [f"f{k}_{i}" for i in range(25)]) for k in range(n)]
    near = [" ".join(passage + edited(r, base, 0.04)) for _ in range(n)]
    rows = list(enumerate(far + near))
    r.shuffle(rows)
    return rows


def test_a_common_passage_gives_rows_in_proportion_to_its_members(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 8)
    made = {}
    for size in (60, 240):
        dealt, whole = [], n._whole

        def counted(f):
            def run(*a):
                out = f(*a)
                dealt.append(out.count())
                return out

            return run

        with monkeypatch.context() as m:
            m.setattr(n, "_whole", counted(whole))
            m.setattr(n, "_dealt", counted(n._dealt))
            rows = crowd(spark, size)
            out = found(n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
        if size == 60:
            assert out == expected(rows)
        made[size] = sum(dealt)
        assert len(dealt) == 3  # buckets, postings and those dealt: larger buckets were there
    assert 0 < made[240] <= 6 * made[60]


def test_prefixes_of_near_duplicates_share_a_shingle():
    r = np.random.default_rng(3)
    universe = r.integers(0, 1 << 63, 300).astype(np.uint64)
    frequent = np.sort(universe[:200])
    counts = r.integers(1, 9, 200)
    met = 0
    for _ in range(300):
        x = np.unique(r.choice(universe, r.integers(1, 60)))
        y = np.unique(np.r_[r.permutation(x)[: max(1, int(len(x) * r.uniform(0.7, 1)))], r.choice(universe, r.integers(0, 6))])
        if n.linked(x, y):
            met += 1
            assert len(np.intersect1d(n.prefix(x, frequent, counts), n.prefix(y, frequent, counts)))
    assert met > 30


def test_texts_with_equal_sets_in_another_order(spark):
    rows = [(1, "a b c d e a b c d e a"), (2, "b c d e a b c d e a b"), (3, "a b c d e  A b c d e a")]
    assert found(n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


def test_very_long_texts_and_words(spark):
    words = [f"w{i % 90_001}" for i in range(4_000_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-40])), (3, "x" * 3_000_000 + " a b c d e f g"), (4, "a " * 9 + "y" * 2_000_000)]
    assert {(i, c) for i, _, c, _ in found(n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))} == {(1, 1), (2, 1), (3, 3), (4, 4)}


def test_hard_rows(spark, hard_rows, no_rows):
    assert found(n.near_duplicates(hard_rows)) == expected([(r["doc_id"], r["text"]) for r in hard_rows.collect()])
    kept = n.kept_documents(hard_rows)
    assert kept.columns == hard_rows.columns and kept.filter("doc_id IS NULL").count() == 2 and kept.filter("doc_id IN (7, 6)").count() == 0
    assert n.near_duplicates(no_rows).count() == 0 and n.kept_documents(no_rows).count() == 0


def test_an_id_with_several_texts_ties_their_components(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, a), (9, a), (9, b), (20, b + " z"), (21, "c d e f g"), (9, "x y z"), (30, "x y z")]
    out = found(n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {(i, c) for i, _, c, _ in out} == {(3, 3), (9, 3), (20, 3), (21, 21), (30, 3)}


def test_shingle_sets_and_rows_without_words():
    data, offsets = column_bytes(pa.array(["A b c d e f", "a B c d e f a b c d e f", "x y", "", None, "x y"]))
    sets = n.shingle_sets(data, offsets)
    assert [len(s) for s in sets] == [2, 6, 1, 0, 0, 1] and (sets[2] == sets[5]).all() and len(np.intersect1d(sets[0], sets[1])) == 2


def test_bounds_prune_only_what_is_unlikely():
    bounds = [n.least_matches(k) for k in range(n.BATCH, n.HASHES + 1, n.BATCH)]
    assert bounds == sorted(bounds) and all(b < 0.75 * k for b, k in zip(bounds, range(n.BATCH, n.HASHES + 1, n.BATCH)))
    r = np.random.default_rng(0)
    left = r.integers(0, 1 << 16, (300, n.HASHES)).astype(np.uint16)
    for similarity, low, high in ((0.78, 0.999, 1.0), (0.3, 0.0, 0.01)):
        right = np.where(r.random(left.shape) < similarity, left, left + 1).astype(np.uint16)
        survived = n.prune(left, right, np.eye(300, dtype=bool), bounds).sum() / 300
        assert low <= survived <= high


def test_exact_test_at_the_threshold():
    a = np.arange(7, dtype=np.uint64)
    assert n.linked(np.arange(3, dtype=np.uint64), np.arange(4, dtype=np.uint64)) and not n.linked(np.arange(5, dtype=np.uint64), a) and not n.linked(a[:0], a[:0])


def test_signatures_estimate_similarity():
    a, b = n.permutations()
    r = np.random.default_rng(1)
    errors = []
    for share in (0.2, 0.5, 0.8) * 10:
        x = r.integers(0, 1 << 63, 600).astype(np.uint64)
        y = np.concatenate([x[: int(600 * share)], r.integers(0, 1 << 63, 600 - int(600 * share)).astype(np.uint64)])
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        errors.append((n.signature(np.unique(x), a, b) == n.signature(np.unique(y), a, b)).mean() - true)
    assert abs(np.mean(errors)) < 0.02


def test_components_of_one_third_copies(spark):
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one two three four five six")).otherwise(F.concat(F.lit("t"), "id", F.lit(" a"), "id", F.lit(" b c d"))).alias("text"))
    out = n.near_duplicates(df)
    assert out.filter("component_id = 0").count() == 300 and out.filter("kept").count() == 601
