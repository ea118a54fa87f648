import hashlib
import random

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from millrace.llm import mixing as m


def brute(rows, share, epochs, seed, dw, lw, sw):
    """rows (doc_id, domain, lang, source, tokens) -> copies by doc_id, by a plain walk of the tree."""

    leaves = {}
    for r in rows:
        leaves.setdefault(r[1:4], []).append(r)
    weights = [lambda x: dw.get(x[0], 1), lambda x: lw.get(x[1], 1), lambda x: sw.get(x[2], 1)]

    def room(prefix):
        """What the leaves below a node may take: nothing where a weight on the way is 0."""
        return sum(r[4] * epochs for leaf, own in leaves.items() if leaf[: len(prefix)] == prefix and all(weights[k](leaf) for k in range(len(prefix), 3)) for r in own)

    def share_out(prefix, budget):
        """Pour the budget of a node over its children until none that has room is left out of a full round."""
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        open_, out, left = {x[: depth + 1] for x in leaves if x[:depth] == prefix}, {}, budget
        open_ = {c for c in open_ if weights[depth](c) or out.setdefault(c, 0)}
        while True:
            total = sum(weights[depth](c) for c in open_)
            full = {c for c in open_ if room(c) * total <= left * weights[depth](c)}
            if not full:
                break
            out |= {c: room(c) for c in full}
            left, open_ = left - sum(map(room, full)), open_ - full
        out |= {c: left * weights[depth](c) // total for c in open_}
        return {leaf: n for c in out for leaf, n in share_out(c, out[c]).items()}

    copies = {}
    for leaf, b in share_out((), sum(r[4] for r in rows) * share[0] // share[1]).items():
        own = leaves[leaf]
        tokens = sum(r[4] for r in own)
        whole = b // tokens if tokens else 0
        rest = b - whole * tokens
        run = 0
        for r in sorted(own, key=lambda r: (hashlib.md5(f"{seed}|{whole + 1}|{r[0]}".encode()).hexdigest(), r[0])):
            run += r[4]
            copies[r[0]] = whole + (1 if run <= rest and whole < epochs else 0)
    return copies


@pytest.mark.parametrize("seed", range(3))
def test_mix_equals_a_plain_walk(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice("pq"), r.choice(["en", "de"]), r.choice(["s1", "s2", "s1"]), r.choice([0, 1, 3, 10, 50])) for i in range(400)]
    df = spark.createDataFrame([(a, "w " * e, c, d, b) for a, b, c, d, e in rows], "doc_id long, text string, lang string, source string, dom string")
    weights = ({"p": 9, "q": 1}, {"en": 3, "de": 0}, {"s2": 5})
    for share, epochs in (((1, 2), 1), ((3, 2), 2), ((9, 1), 3)):
        out = m.mix(df, F.col("dom"), share, epochs, "t", *weights)
        assert {x["doc_id"]: x["copies"] for x in out.collect()} == brute(rows, share, epochs, "t", *weights)


def test_shortage_goes_to_siblings_first(spark):
    rows = [(1, "w " * 2, "en", "a1", "A"), (2, "w " * 100, "en", "a2", "A"), (3, "w " * 100, "en", "b1", "B")]
    out = m.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, dom string"), F.col("dom"), (1, 2), 1, "t", {}, {}, {})
    granted = {r["source"]: r["leaf_granted"] for r in out.collect()}
    assert granted == {"a1": 2, "a2": 48, "b1": 50}  # half of 202 tokens: 50 a domain, and a2 takes what a1 hasn't


def test_what_stands_below_a_weight_of_0_takes_no_budget(spark):
    rows = [(1, "w " * 500, "en", "a1", "A"), (2, "w " * 500, "de", "a2", "A"), (3, "w " * 1000, "de", "b1", "B")]
    out = m.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, dom string"), F.col("dom"), (1, 2), 1, "t", {"A": 7, "B": 1}, {"en": 0}, {})
    granted = {r["source"]: r["leaf_granted"] for r in out.collect()}
    assert granted == {"a1": 0, "a2": 500, "b1": 500}  # A may take 500 of its 875, so B has all the rest


def test_hard_rows(spark, hard_rows, no_rows):
    out = m.mix(hard_rows)
    assert out.count() == hard_rows.count() and out.filter("copies IS NULL OR copies < 0 OR copies > 2").count() == 0
    assert {r["source"] for r in out.select("source").collect()} >= {"unknown", "src1"}
    mixed = m.mixed_documents(hard_rows)
    assert mixed.columns == hard_rows.columns and mixed.count() > 0
    assert m.mix(no_rows).count() == 0 and m.mixed_documents(no_rows).count() == 0


def test_one_leaf_holds_a_third(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "src0").otherwise(F.concat(F.lit("src"), (F.col("id") % 40).cast("string"))).alias("source"))
    import duckdb

    c = duckdb.connect()
    c.register("documents", df.toPandas())
    assert_same(m.mix(df).select("doc_id", "domain", "lang", "source", "n_tokens", F.col("copies").cast("bigint").alias("copies"), "leaf_granted"), c, m.OP4_SQL)
