import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import exact_dedup as x
from millrace.llm.arrays import column_bytes


def prints(texts, chunk=x.CHUNK):
    return list(zip(*(a.tolist() for a in x.fingerprints(*column_bytes(pa.array(texts)), chunk))))


def one(data: bytes):
    h = [0, 0]
    for b in data:
        h = [(h[i] * x.BASES[i] + b + 1) % x.MODULI[i] for i in (0, 1)]
    return (len(data), *h)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=6), st.sampled_from([1, 3, 7, 64]))
def test_fingerprints_are_the_polynomial_at_any_chunk_size(texts, chunk):
    assert prints(texts, chunk) == [one(t.encode()) for t in texts]


@given(st.binary(max_size=30), st.binary(max_size=30), st.binary(max_size=30))
def test_combine_is_concatenation_and_associative(a, b, c):
    assert x.combine(one(a), one(b)) == one(a + b)
    assert x.combine(x.combine(one(a), one(b)), one(c)) == x.combine(one(a), x.combine(one(b), one(c)))
    assert x.combine((0, 0, 0), one(a)) == one(a) == x.combine(one(a), (0, 0, 0))


def test_long_texts():
    text = "é" * 100_000
    assert prints([text, text + "!"])[0] == one(text.encode()) and x.equal_by_chunks(text, text) and not x.equal_by_chunks(text, text[:-1] + "e")


def expected(rows):
    rows = {(i, t or "") for i, t in rows}
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    top = {t: max(g, key=lambda i: (i is not None, i or 0)) for t, g in groups.items()}
    return sorted(((i, top[t], len(groups[t]), i == top[t]) for i, t in rows), key=str)


def test_hard_rows(spark, hard_rows, no_rows):
    out = x.exact_duplicates(hard_rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out.collect()), key=str) == expected([(r["doc_id"], r["text"]) for r in hard_rows.collect()])
    kept = x.kept_texts(hard_rows)
    assert kept.columns == hard_rows.columns and sorted((r["text"] or "") for r in kept.collect()) == sorted({r["text"] or "" for r in hard_rows.collect()})
    assert x.exact_duplicates(no_rows).count() == 0 and x.kept_texts(no_rows).count() == 0


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(x, "fingerprints", lambda data, offsets, chunk=x.CHUNK: [np.diff(offsets), np.zeros(len(offsets) - 1, np.uint64), np.zeros(len(offsets) - 1, np.uint64)])
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "bb"), (5, "bb"), (6, "cc"), (7, "d")]
    out = x.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out.collect()), key=str) == expected(rows)


def test_a_large_group_spans_blocks(spark):
    rows = [(i, "same") for i in range(500)] + [(1000 + i, f"t{i}") for i in range(50)]
    out = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in x.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == 550 and all(out[i] == (499, 500) for i in range(500)) and out[1003] == (1003, 1)
