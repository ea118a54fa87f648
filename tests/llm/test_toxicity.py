from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import toxicity as t

GRAMMAR = t.Grammar({"moron": 4.0}, {"lowei": 3.0})


@pytest.mark.parametrize(("clause", "weight"), [
    ("a fine day", None), ("what a moron", 4.0), ("you moron", 5.0), ("not moron", 1.6), ("said moron", 2.0), ("said not a moron", 2.0 * t.NEGATED), ("you said not moron", 4.0 * t.NEGATED * t.REPORTED * t.TARGETED),
    ("kill it", None), ("kill you", t.THREAT_WEIGHT), ("loweichen", 3.0), ("lowei", None), ("moron moron", 8.0),
])
def test_clauses(clause, weight):
    total, most, n = GRAMMAR.evidence(clause)
    assert (n, most) == ((0, 0.0) if weight is None else (1, pytest.approx(weight)))


def test_negation_ends_with_its_clause_and_reach():
    assert GRAMMAR.evidence("not. moron")[1] == 4.0 and GRAMMAR.evidence("not at all one moron")[1] == 4.0
    assert GRAMMAR.evidence("not a complete moron")[1] == pytest.approx(1.6) and GRAMMAR.evidence("he isn’t a moron")[1] == pytest.approx(1.6)


@pytest.mark.parametrize(("text", "weight"), [
    ('he said: "you moron"', 2.5), ('"you moron," he said', 2.5), ("she said, you are a moron", 2.5), ("„you moron“, sagte er", 2.5), ("he told us «fine. you moron!» again", 2.5), ("he said, moron", 2.0),
    ('a "moron" you are', 5.0), ('he said "fine" and left. you moron', 5.0), ("he said it. you moron", 5.0), ("you moron, that is what i think", 5.0), ('they left "here" you moron "there"', 5.0),
])
def test_reported_speech_is_weakened(text, weight):
    assert GRAMMAR.evidence(text)[1] == pytest.approx(weight)


def test_every_clause_counts():
    assert GRAMMAR.evidence("moron. fine! you moron")[2] == 2


def test_fit_scores_and_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = t.op1_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = Counter({(r["toxic"], r["predicted"]): r["count"] for r in rows})
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.85 and n[0, 0] / (n[0, 0] + n[0, 1]) > 0.93
    assert docs.count() == t.op1_toxicity(spark, "/root/testdata/sf0.1").count()


def test_hard_rows(spark, hard_rows, no_rows):
    out = t.score(hard_rows, GRAMMAR)
    assert out.count() == hard_rows.count() and out.filter("score IS NULL OR score < 0 OR score > 1 OR predicted <> 0").count() == 0
    assert t.score(no_rows, GRAMMAR).count() == 0


def test_a_row_without_id_is_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "a"), (1, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r["doc_id"]: r["held_out"] for r in t.op1_toxicity(spark, str(tmp_path)).collect()}[None] is False


def test_samples_without_a_class(spark, no_rows):
    docs = no_rows.select("doc_id", "text")
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    assert t.fit(t.cut(t.labelled_sample(docs, labels, "toxic", 10))).insults == {}
    one = spark.createDataFrame([(1, "a moron", 1)], "doc_id long, text string, y int")
    assert t.fit(one).probability((0.0, 0.0, 0)) < 0.5


def test_sample_is_bounded_and_takes_the_largest_label(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert {r["y"]: r["count"] for r in t.labelled_sample(docs, labels.unionByName(labels.withColumn("toxic", F.lit(0))), "toxic", 5).groupBy("y").count().collect()} == {0: 5, 1: 5}
