"""What shows only at size: plans that would fill the driver, order of sums, order of ties."""

import datetime
import hashlib
import itertools
import os
import random
import re

from oracle import assert_same, connect
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from millrace.functions import similarity
from millrace.operators import models, pairs
from millrace.plans import incidents, joining, learned, texts

T = datetime.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _tables(spark, folder, **frames):
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(os.path.join(folder, f"{name}.parquet"))
    return str(folder)


def _events(spark, folder):
    rows = [(i, T + datetime.timedelta(hours=i), i % 3, "click", float(i % 7), "") for i in range(60)]
    return _tables(spark, folder, events=(rows, EVENTS))


def _joins(df):
    """The joins as planned before anything runs, by estimates alone."""
    return set(re.findall(r"\w+Join\b", df._jdf.queryExecution().sparkPlan().toString()))


def test_edge_recall_broadcasts_no_exploded_rows(spark, tmp_path):
    assert _joins(joining.edge_recall(spark, _events(spark, tmp_path))) == {"SortMergeJoin"}


def test_subject_edges_broadcasts_no_exploded_rows(spark, tmp_path):
    assert _joins(joining.subject_edges(spark, _events(spark, tmp_path))) == {"SortMergeJoin"}


def test_top_pairs_broadcasts_no_exploded_rows(spark, tmp_path):
    assert _joins(joining.top_pairs(spark, _events(spark, tmp_path))) == {"SortMergeJoin"}


def _dealt(spark, folder):
    """Events of sf0.1 in order for DuckDB, and dealt over files for Spark."""
    e = spark.read.parquet("/root/testdata/sf0.1/events.parquet").filter("user_id < 400")
    e.coalesce(1).sort("event_id").write.parquet(f"{folder}/a/events.parquet")
    e.repartition(7, F.hash("event_id")).write.parquet(f"{folder}/b/events.parquet")
    duck = connect(f"{folder}/a")
    duck.sql("SET threads = 1")  # with more the SQL's own sums depend on who took which rows
    return f"{folder}/b", duck


def test_cluster_credibility_sums_in_order(spark, tmp_path):
    folder, duck = _dealt(spark, tmp_path)
    assert_same(incidents.cluster_credibility(spark, folder), duck, incidents.CLUSTER_CREDIBILITY)


def test_incident_alerts_sum_in_order(spark, tmp_path):
    folder, duck = _dealt(spark, tmp_path)
    assert_same(incidents.incident_alerts(spark, folder), duck, incidents.INCIDENT_ALERTS)


def test_duplicate_pairs_take_ties_as_their_sql(spark, tmp_path):
    rows = [(i * 1080 + 5, f"text {i}", "en", "s", 6) for i in range(60)]  # all at one time: 1,770 pairs, of which 500 are taken
    folder = _tables(spark, tmp_path, documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert_same(joining.duplicate_pairs(spark, folder), connect(folder), joining.DUPLICATE_PAIRS)


def test_hard_negatives_take_each_pair_once(spark):
    rows = [("g", "s", "x", "a", T), ("h", "s", "y", "b", T), ("g", "u", "x", "a", T), ("h", "u", "y", "b", T), ("h", "u", "z", "c", T + datetime.timedelta(hours=30)), ("k", "u", "v", "d", T + datetime.timedelta(days=3))]
    df = spark.createDataFrame(rows, "group string, subject string, id string, print string, ts timestamp_ntz")
    found = [(r["left_id"], r["right_id"], r["subject"]) for r in pairs.hard_negatives(df, 2, 2).collect()]
    assert found == [("x", "y", "s"), ("x", "z", "u")]
    assert pairs.hard_negatives(df, 2, 100).count() == 3  # z and v of different groups within two days, too


def test_positive_pairs_sort_few_and_lose_none(spark, monkeypatch):
    ids = {"a": range(300), "b": range(1000, 1040), "c": range(2000, 2002), "d": [3000]}
    rows = [(g, i) for g in ids for i in ids[g]]
    digest = lambda p: hashlib.sha256(f"42:{p}".encode()).hexdigest()
    expected = {(g, *p) for g in ids for p in sorted(itertools.combinations(ids[g], 2), key=lambda p: digest(f"{p[0]}::{p[1]}"))[:5]}
    df = spark.createDataFrame(rows, "group string, id long")
    own, sorted_ = pairs._hashed_pairs, []

    def counted(*args):
        out = own(*args)
        sorted_.append(out.count())
        return out

    monkeypatch.setattr(pairs, "_hashed_pairs", counted)
    monkeypatch.setattr(pairs, "DEALT", 32)  # groups are dealt into several blocks
    for spare in (16, 1):  # with 1 a group may fall short and is done again
        monkeypatch.setattr(pairs, "SPARE", spare)
        found = [(r["group"], r["left"], r["right"]) for r in pairs.positive_pairs(df, most=5).collect()]
        assert len(found) == len(expected) and set(found) == expected
    assert sorted_[0] < 400  # of 45,631 pairs


def _shuffled_bytes(spark, act):
    """Bytes that all stages of act() write for shuffles."""
    jvm, context = spark._jvm, spark.sparkContext

    def written():
        context._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    act()
    return sum(n for k, n in written().items() if k not in before)


def test_rule_clusters_sends_rows_not_pairs(spark, tmp_path):
    rows = [(i, T + datetime.timedelta(minutes=i), 1, "click", 1.0, "") for i in range(300)]  # 44,850 pairs of one entity
    folder = _tables(spark, tmp_path, events=(rows, EVENTS))
    found = []
    assert _shuffled_bytes(spark, lambda: found.append(joining.rule_clusters(spark, folder).count())) < 200_000
    assert found == [44_850]


def test_sequence_ratios_equal_sequence_matcher(monkeypatch):
    r = random.Random(2)
    said = lambda letters, most: "".join(r.choice(letters) for _ in range(r.randint(0, most)))
    pairs_ = [(said(k, n), said(k, n)) for k, n in (("ab", 199), ("ab好", 30), ("ab好\U0001f600 \0x", 60), ("ab好 ", 240)) for _ in range(150)] + [("", ""), ("", "a"), ("a" * 199, "a" * 199), ("a" * 200, "a" * 200)]
    whole, asked = similarity.SequenceMatcher, []
    monkeypatch.setattr(similarity, "SequenceMatcher", lambda *x: asked.append(x) or whole(*x))
    for together in (4096, 7):
        monkeypatch.setattr(similarity, "TOGETHER", together)
        assert list(similarity.sequence_ratios(*map(list, zip(*pairs_)))) == [whole(None, a, b).ratio() for a, b in pairs_]
    assert all(max(len(x[1]), len(x[2])) >= 200 or x[1:] == ("", "") for x in asked)  # no short text goes through Python
    assert list(similarity.sequence_ratios([], [])) == []


def test_title_pairs_send_words_not_grams(spark, tmp_path):
    said = [" ".join(f"word{(i * 7 + k * (1 + i % 5)) % 23}" for k in range(8)) for i in range(400)]
    rows = [(i, f"{said[i]} {i}", "en", "s", 60) for i in range(400)]
    folder = _tables(spark, tmp_path, documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert _shuffled_bytes(spark, lambda: assert_same(texts.title_pairs(spark, folder), connect(folder), texts.TITLE_PAIRS)) < 500_000


def test_pairs_found_are_spread_over_tasks(spark, tmp_path):
    rows = [(i, f"alpha beta gamma delta {i}", "en", "s", 60) for i in range(40)] + [(50 + i, t, "en", "s", 9) for i, t in enumerate(["aé 好\U0001f600", "aé 好\U0001f600\t", "\u3000", "", None, "xx", "xx xx", "ab", "a b"])]
    folder = _tables(spark, tmp_path, documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    df = texts.title_pairs(spark, folder)
    assert_same(df, connect(folder), texts.TITLE_PAIRS)
    held = df.withColumn("part", F.spark_partition_id())
    assert held.count() > 780 and held.select("part").distinct().count() > 4  # the few bytes of these pairs would fit one task


def test_grams_are_counted_as_hashing_tf_counts_them(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, "".join(r.choice(["a", "b", " ", "é", "好", "\U0001f600", "\t", "　", "A"]) for _ in range(r.randint(0, 40)))) for i in range(200)] + [(200, None), (201, ""), (202, "x")]
    grams = {}
    for i, said in rows:  # words padded by spaces; of one shorter than an n-gram the whole
        words = [f" {w} " for w in (said or "").lower().split()]
        grams[i] = [w[k : k + n] for n in (2, 3, 4) for w in words for k in range(max(1, len(w) - n + 1))]
    tf = HashingTF(inputCol="g", outputCol="tf", numFeatures=models.FEATURES)
    expected = {x["id"]: x["tf"] for x in tf.transform(spark.createDataFrame(list(grams.items()), "id long, g array<string>")).collect()}
    df = spark.createDataFrame(rows, "id long, t string")
    for piece in (1 << 20, 30):  # with 30 bytes longer texts are counted in pieces
        monkeypatch.setattr(models, "PIECE", piece)
        assert {x["id"]: x["tf"] for x in models.gram_counts(df, "t").collect()} == expected


def test_text_model_makes_no_array_of_grams(spark, tmp_path):
    rows = [(i, f"{said} {i}", said, "s", 9) for i, said in enumerate(["und", "the"] * 8)]
    folder = _tables(spark, tmp_path, documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    plan = learned.language_model(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "flatten(" not in plan and "MapInArrow" in plan
