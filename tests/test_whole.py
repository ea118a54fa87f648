"""Queries do their whole job: small tables whose telling rows lie where a cut would lose them."""

import datetime
import os
import random
from collections import Counter

from oracle import assert_same, connect
from pyspark.sql import functions as F

from millrace.operators import clustering, pairs
from millrace.plans import incidents, joining, learned
from millrace.plans import ranking as ranking_queries
from millrace.plans.bindings import news

T = datetime.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _tables(spark, folder, **frames):
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(os.path.join(folder, f"{name}.parquet"))
    return str(folder)


def test_language_model_reads_whole_texts(spark, tmp_path):
    said = {"de": "und der hund läuft", "en": "the dog is walking", "es": "el perro camina"}
    rows = [(i, "0 " * 300 + said[lang], lang, "s", 600 + len(said[lang])) for i, lang in enumerate(list(said) * 16)]
    folder = _tables(spark, tmp_path, documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    found = {(r["a"], r["b"]): r["n"] for r in learned.language_model(spark, folder).collect()}
    assert found == {(lang, lang): 4 for lang in said}


def test_agent_decisions_judges_all_news(spark, tmp_path):
    kinds = ["click", "error", "view", "purchase"]
    rows = [(i, T, 1, kinds[i % 4], 1.0, "") for i in range(390, 1010)]
    folder = _tables(spark, tmp_path, events=(rows, EVENTS))
    expected = Counter()
    for r in rows:  # only titles of errors get past the first question
        expected["keep" if r[3] == "error" else "abstain", r[3], r[3]] += 1
    found = {(r["decision"], r["baseline"], r["label"]): (r["n"], r["steps"]) for r in learned.agent_decisions(spark, folder).collect()}
    assert found == {k: (n, n * (3 if k[0] == "keep" else 1)) for k, n in expected.items()}
    assert sum(n for n, _ in found.values()) == len(rows)


def test_edge_recall_finds_more_than_a_few_edges_of_an_event(spark, tmp_path):
    rows = [(i, T + datetime.timedelta(hours=4 * i), 1, "click", 1.0, "{}") for i in range(30)]  # each has 12 others before it within 2 days
    odd = [(100, T, 1, "click", 1.0, None), (101, T, 1, "click", 1.0, None), (102, T, None, "click", 1.0, "{}"), (103, None, 1, "click", 1.0, "{}"), (None, T, 1, "click", 1.0, "{}")]
    folder = _tables(spark, tmp_path, events=(rows + odd, EVENTS))
    assert_same(joining.edge_recall(spark, folder), connect(folder), joining.EDGE_RECALL)
    near = sum(4 * (j - i) <= 48 for j in range(30) for i in range(j))
    assert joining.edge_recall(spark, folder).first().asDict() == {"positives": 30 * 31 // 2, "found": near, "eligible": near, "eligible_found": near}


def test_cluster_credibility_keeps_events_without_user(spark, tmp_path):
    rows = [(i, T, None if i % 3 == 0 else 1, "click", 1.0, "") for i in range(12)]
    folder = _tables(spark, tmp_path, events=(rows, EVENTS))
    assert_same(incidents.cluster_credibility(spark, folder), connect(folder), incidents.CLUSTER_CREDIBILITY)
    assert incidents.cluster_credibility(spark, folder).filter("cluster_id IS NULL").first()["n"] == 4


def _merged(decisions):
    return {(r["left"], r["right"]): round(r["score"], 9) for r in decisions.filter("merged").collect()}


def test_rule_clusters_equals_all_pairs(spark, tmp_path):
    r = random.Random(5)
    near = [(1, T - datetime.timedelta(minutes=1), 1, "click", 1.0, ""), (2, T, 1, "click", 1.0, "")]  # 23:59 and 00:00
    rows = near + [(i, T + datetime.timedelta(hours=r.randint(0, 400)), r.randint(1, 6), r.choice(["click", "error", "view"]), 1.0, "") for i in range(3, 120)]
    rows[96] = (97, T, 1, "click", 1.0, "")  # undated
    folder = _tables(spark, tmp_path, events=(rows, EVENTS))
    n = news(spark, folder).select("id", "title", F.substring("content", 1, 80).alias("evidence"), "entity", "event_type", F.col("publish_time").alias("ts"))
    expected = _merged(clustering.rule_decisions(n, []))
    found = _merged(joining.rule_clusters(spark, folder))
    assert found == expected and (1, 2) in found
    assert any(97 in k for k in found)


def test_rule_decisions_over_all_pairs_without_common_entity(spark, monkeypatch):
    r = random.Random(7)
    words = ["甲方", "乙方", "增长", "下降", "合同", "处罚", "公告", "订单"]
    rows = []
    for i in range(150):
        said = " ".join(words[: r.choice([4, 5, 6])] + r.sample(words, r.choice([0, 0, 1])))
        rows.append((i, said, r.choice(["e", "f"]), r.choice(["", "", "甲", "乙", None]), r.choice(["k", "z", None]), None if r.random() < 0.1 else T + datetime.timedelta(hours=r.randint(0, 90))))
    df = spark.createDataFrame(rows, "id long, title string, evidence string, entity string, event_type string, ts timestamp_ntz")
    monkeypatch.setattr(pairs, "MEETING", 16)  # groups are dealt into several blocks
    every = clustering.rule_decisions(df, [])
    apart = every.join(df.select(F.col("id").alias("left"), "entity"), "left").filter("merged AND coalesce(entity, '') = ''")
    assert apart.count() > 0
    found = clustering.all_rule_decisions(df)
    assert _merged(found) == _merged(every) and found.count() == found.select("left", "right").distinct().count()


def test_like_pairs_equal_all_pairs(spark, monkeypatch):
    r = random.Random(11)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, r.choice(["e", "f", None]), r.sample(words, r.randint(0, 6))) for i in range(120)] + [(i, "e", words[:3]) for i in range(120, 160)]
    alike = lambda x, y: x and y and 2 * len(set(x) & set(y)) >= len(set(x) | set(y))
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] is not None and a[1] == b[1] and alike(a[2], b[2])}
    monkeypatch.setattr(pairs, "MEETING", 4)  # groups are dealt into several blocks
    found = pairs.like_pairs(spark.createDataFrame(rows, "id long, kind string, words array<string>"), 0.5)
    assert {(x["l_id"], x["r_id"]) for x in found.collect()} == expected and found.count() == len(expected)
    assert pairs.like_pairs(spark.createDataFrame([], "id long, kind string, words array<string>"), 0.5).count() == 0


def test_review_queue_takes_a_share_of_all_orders(spark, tmp_path):
    rows = [(i, "O", "p", float(i * 37 % 101)) for i in range(101)]
    folder = _tables(spark, tmp_path, orders=(rows, "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double"))
    found = ranking_queries.review_queue(spark, folder).collect()
    assert {int(x["article_id"]) for x in found} == {r[0] for r in rows if r[3] < 20}
    assert Counter(x["batch"] for x in found) == {1: 8, 2: 8, 3: 4}
