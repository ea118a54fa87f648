"""Operators on small frames with known answers."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import clustering, components, learning, lifecycle, metrics, models, pairs, ranking, splits, vectors
from millrace.streaming import events as streams

T = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("few", [components.FEW, -1])
def test_components_chain_cycle_loop_and_repeats(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)  # in one task, and in rounds
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 52), (52, 50), (60, 60), (70, 71), (71, 70), (70, 71)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(edges.repartition(7)).collect()}
    assert {found[i] for i in range(1, 41)} == {1} and {found[i] for i in (50, 51, 52)} == {50} and found[71] == 70 and 60 not in found
    assert components.components(edges.limit(0)).count() == 0


def test_cluster_metrics_of_a_merge_and_a_split(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, "c", 2), (5, "c", 3)], "id int, truth string, predicted int")
    m = metrics.cluster_metrics(df).first()
    assert m["pair_precision"] == pytest.approx(1 / 3) and m["pair_recall"] == pytest.approx(1 / 2)
    assert m["over_merge_rate"] == pytest.approx(1 / 3) and m["split_rate"] == pytest.approx(1 / 3)
    alone = metrics.cluster_metrics(df.filter("id > 4")).first()
    assert alone["pair_precision"] == 1.0 and alone["b3_f1"] == 1.0


def _evidence(spark, rows):
    return spark.createDataFrame(rows, "cluster_id long, evidence_id string, article_id string, source string, source_type string, source_key string, stance string, authority double, ts timestamp_ntz, summary string")


def _some_evidence(spark, seed=3, clusters=12):
    import random

    r = random.Random(seed)
    rows = []
    for c in range(clusters):
        for i in range(r.randint(1, 9)):
            kind, score = r.choice([("官方", 1.0), ("公司", 0.9), ("主流财经媒体", 0.75), ("自媒体", 0.35)])
            rows.append((c, f"E{c}-{i}", f"a{i}", kind, kind, r.choice("xyz"), r.choice(["supports", "refutes", "neutral"]), score, None if r.random() < 0.1 else T + datetime.timedelta(hours=r.randint(0, 50)), r.choice(["", "已经结案", "影响扩大"])))
    return rows


def test_lifecycle_fold_equals_a_plain_fold(spark):
    rows = _some_evidence(spark)
    found = {r["cluster_id"]: r for r in lifecycle.lifecycles(_evidence(spark, rows)).collect()}
    names = ["cluster_id", "evidence_id", "article_id", "source", "source_type", "source_key", "stance", "authority", "ts", "summary"]
    for c in {r[0] for r in rows}:
        own = sorted((dict(zip(names, r)) for r in rows if r[0] == c), key=lambda r: (r["ts"] is None, r["ts"] or T, r["article_id"]))
        state, steps = (0.0, set(), 0, set(), 0, 0), []
        for row in own:
            state, out = streams.step(state, row)
            steps.append(out)
        assert [(s["stage"], s["claim_status"]) for s in found[c]["snapshots"]] == [s[:2] for s in steps]
        assert [s["score"] for s in found[c]["snapshots"]] == pytest.approx([s[2] for s in steps], abs=2e-4)
        assert found[c]["stage"] == steps[-1][0] and found[c]["n_evidence"] == len(own)


def test_gates_and_guard(spark):
    ev = _evidence(spark, [(1, "e1", "a1", "s", "自媒体", "s", "supports", 0.35, T, ""), (2, "e2", "a2", "证监会", "官方", "o", "supports", 1.0, T, "")])
    lives = lifecycle.lifecycles(ev)
    alerts = spark.createDataFrame([(1, "高风险", "甲", "监管处罚", 0.5, 0.9), (2, "高风险", "乙", "监管处罚", 0.9, 0.9), (3, "观察", "", "x", 0.1, 0.1)], "cluster_id long, risk_level string, company string, event_type string, credibility_score double, severity double")
    gates = lifecycle.delivery_gates(alerts, lives)
    assert {r["cluster_id"]: r["reason"] for r in gates.collect()} == {1: "needs_official_or_sources", 2: "passed", 3: "no_lifecycle"}
    claims = lifecycle.claims(alerts, lives)
    assert claims.count() == 6 and claims.filter("kind = 'fact'").count() == 1
    guarded = {r["cluster_id"]: r for r in lifecycle.guarded(alerts, gates, claims).collect()}
    assert not guarded[1]["delivery_allowed"] and guarded[2]["claim_evidence_coverage"] == 1.0 and guarded[3]["claim_evidence_coverage"] == 0.0
    assert {r["cluster_id"] for r in lifecycle.collection_requests(gates).collect()} == {1, 3}


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted((r for r in _some_evidence(spark, 5) if r[8] is not None), key=lambda r: (r[8], r[2]))
    df = _evidence(spark, rows).withColumn("ts", F.col("ts").cast("timestamp"))
    half = len(rows) // 2
    cut_at = rows[half][8]
    for i, cond in enumerate((F.col("ts") < F.lit(cut_at), F.col("ts") >= F.lit(cut_at))):
        df.filter(cond).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    import pathlib
    import shutil

    (tmp_path / "flat").mkdir()
    for i in range(2):
        shutil.copy(next(pathlib.Path(tmp_path / f"in/part{i}").glob("*.parquet")), tmp_path / f"flat/{i}.parquet")
        os.utime(tmp_path / f"flat/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in the order of their times
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
    q = streams.to_ledger(streams.lifecycle_stream(stream), str(tmp_path / "ledger"), str(tmp_path / "cp"))
    q.awaitTermination()
    last = learning.latest(spark.read.parquet(str(tmp_path / "ledger")), "cluster_id", "seq")
    own = {r["cluster_id"]: (r["seq"], r["stage"], r["claim_status"]) for r in last.collect()}
    batch = {r["cluster_id"]: (r["n_evidence"], r["stage"], r["claim_status"]) for r in lifecycle.lifecycles(_evidence(spark, rows)).collect()}
    assert own == batch


def test_stream_sessions_and_distinct(spark, tmp_path):
    import shutil

    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "events.parquet")
    for k, build in enumerate((lambda e: streams.sessions(e, "1 day"), lambda e: streams.distinct_events(e, "event_id").select("event_id"), lambda e: streams.window_counts(e, "2 days", "1 day"))):
        q = streams.to_memory(build(streams.read_events(spark, str(tmp_path))), f"out{k}", str(tmp_path / f"cp{k}"), "append")
        q.awaitTermination()
        assert spark.table(f"out{k}").count() > 0


def test_edges_respect_window_and_limit(spark):
    rows = [(i, "c", T + datetime.timedelta(days=d), float(s)) for i, d, s in ((1, 0, 1), (2, 1, 5), (3, 2, 3), (4, 9, 2))] + [(5, "c", None, 1.0), (6, "d", T, 1.0)]
    df = spark.createDataFrame(rows, "article_id int, code string, ts timestamp_ntz, score double")
    found = {(r["left_article_id"], r["right_article_id"]) for r in pairs.subject_time_edges(df, 7, 1).collect()}
    assert found == {(1, 2), (2, 3), (3, 4)}  # exactly seven days are within the window


def test_reviews_are_checked(spark):
    q = spark.createDataFrame([("r1", "a1", "e0", "p1")], "review_id string, article_id string, baseline_event string, provenance_hash string")
    review = lambda *rows: spark.createDataFrame(list(rows), "review_id string, provenance_hash string, expected_event_type string, reviewer string, approved boolean, note string")
    ok = ("r1", "p1", "e1", "pat", True, "")
    assert pairs.reviewed(q, review(ok), ["e1"]).count() == 1
    for bad, message in (((ok, ok), "reviewed twice"), ((("r2", *ok[1:]),), "unknown review"), ((("r1", "p2", *ok[2:]),), "provenance"), ((("r1", "p1", "e1", " ", True, ""),), "no reviewer"), ((("r1", "p1", "e9", "pat", True, ""),), "unknown event")):
        with pytest.raises(Exception, match=message):
            pairs.reviewed(q, review(*bad), ["e1"]).collect()


def test_aligned_refuses_other_keys(spark):
    a, b = spark.range(3).withColumn("x", F.lit(1)), spark.range(1, 4).withColumn("y", F.lit(1))
    assert pairs.aligned(a, spark.range(3).withColumn("y", F.lit(2)), key="id").count() == 3
    with pytest.raises(ValueError, match="same keys"):
        pairs.aligned(a, b, key="id")


def test_quotas():
    assert ranking.water_filled({"a": 1, "b": 10, "c": 10}, 9) == {"a": 1, "b": 4, "c": 4}
    assert sum(ranking.water_filled({"a": 2, "b": 0}, 9).values()) == 2
    assert ranking.risk_quota({"a": 5, "b": 5}, {"a": 0.9, "b": 0.1}, 4) == {"a": 4, "b": 0} or sum(ranking.risk_quota({"a": 5, "b": 5}, {"a": 0.9, "b": 0.1}, 4).values()) == 4


def test_platt_and_diverse(spark):
    train = spark.createDataFrame([("a", float(i), int(i > 5)) for i in range(12)], "label string, score double, hit int")
    out = {r["score"]: r["calibrated"] for r in ranking.calibrated(train, spark.createDataFrame([("a", 1.0, 1), ("a", 10.0, 1)], "label string, score double, row int"), "platt").collect()}
    assert out[1.0] < 0.2 and out[10.0] > 0.8
    v = spark.createDataFrame([(1, "a", 0.1, [1.0, 0.0], 1), (2, "a", 0.2, [1.0, 0.01], 2), (3, "a", 0.3, [0.0, 1.0], 3), (4, "a", 0.1, [0.0, 1.0], 1)], "id int, c string, m double, v array<double>, g int")
    picks = [r["id"] for r in ranking.diverse(v, "c", "m", "v", "id", 2, group="g").orderBy("turn").collect()]
    assert picks[0] in (1, 4) and len(picks) == 2 and not {1, 4} <= set(picks)


def test_whole_groups_skips_what_does_not_fit(spark):
    g = spark.createDataFrame([("s1", "g1", 5), ("s1", "g2", 4), ("s2", "g3", 6), ("s2", "g4", 1), ("s3", "g5", 99)], "subject string, group string, size int")
    kept = {r["group"] for r in ranking.whole_groups(g, "subject", "group", "size", 10).collect()}
    assert kept == {"g1", "g2", "g4"}


def test_split_sides_are_disjoint_and_keep_groups(spark):
    df = spark.createDataFrame([(i, i // 3, T + datetime.timedelta(days=i % 11) if i % 7 else None) for i in range(60)], "id int, g int, ts timestamp_ntz")
    held = splits.key_holdout(df, "g")
    assert held.groupBy("g").agg(F.count_distinct("side").alias("n")).filter("n > 1").count() == 0 and held.filter("side = 'holdout'").count() == 12
    timed = splits.time_split(df, "ts", "id")
    assert timed.filter("side = 'train'").count() == 48 and timed.filter("side = 'train' AND ts IS NULL").count() == 0
    three = splits.temporal_three_way(df, "g", "ts", "id", 0.3, 0.3)
    assert three.filter("side >= 0").groupBy("g").agg(F.count_distinct("side").alias("n")).filter("n > 1").count() == 0
    assert splits.recent_groups(df.filter("ts IS NOT NULL"), "g", "ts", "id").count() > 0


def test_skills_rollback_and_registry(spark):
    rows = [(f"f{i}", "wrong_type", "甲", "乙", "合并案 被误判为乙", None) for i in range(3)] + [("g1", "other", "", "乙", "x", ["ab"])]
    fb = spark.createDataFrame(rows, "feedback_id string, kind string, expected_event_type string, observed_event_type string, note string, trigger_terms array<string>")
    both = learning.flywheel(fb, {"macro_f1": 0.7}, {"macro_f1": 0.72}, True)
    now = learning.active(both).collect()
    assert len(now) == 1 and now[0]["trigger_terms"] == ["合并案"] and now[0]["status"] == "active"
    back = learning.rolled_back(both, now[0]["skill_id"], "test")
    assert learning.active(both.unionByName(back)).count() == 0
    with pytest.raises(ValueError, match="rolled back"):
        learning.rolled_back(both.unionByName(back), now[0]["skill_id"], "again")
    decide = lambda *a: spark.range(1).select(learning.release(learning.gate(*(F.lit(float(x)) for x in a[:4])), F.lit(a[4]))).first()[0]
    assert decide(0.7, 0.70, 0, 0, True) == "rejected" and decide(0.7, 0.8, 0.1, 0.2, True) == "rejected" and decide(0.7, 0.8, 0, 0, False) == "shadow" and decide(0.7, 0.8, 0, 0, True) == "active"


def test_semantic_clusters_and_grid(spark):
    rows = spark.createDataFrame([(1, "业绩 增长", "e", "甲", "k", T), (2, "业绩 增长", "e", "甲", "k", T), (3, "完全 不同", "f", "甲", "z", T)], "id long, title string, evidence string, entity string, event_type string, ts timestamp_ntz").withColumn("b", F.lit(1))
    d = {(r["left"], r["right"]): r for r in clustering.rule_decisions(rows, ["b"]).collect()}
    assert d[1, 2]["merged"] and not d[1, 3]["merged"]
    sem = spark.createDataFrame([("1::3", 0.99)], "pair_id string, semantic double")
    from dataclasses import replace

    from millrace.config import DEFAULTS

    low = replace(DEFAULTS.cluster, candidate_threshold=0.2)
    merged = {(r["left"], r["right"]): (r["merged"], r["method"]) for r in clustering.rule_decisions(rows, ["b"], low, sem).collect()}
    assert merged[1, 3] == (True, "semantic") and merged[2, 3] == (False, "semantic_fallback")
    with pytest.raises(Exception, match="no semantic score"):
        clustering.rule_decisions(rows, ["b"], replace(low, fail_open=False), sem).collect()
    nodes = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, truth string")
    grid = {r["threshold"]: r for r in clustering.threshold_grid(nodes, spark.createDataFrame([(1, 2, 0.8), (2, 3, 0.4)], "left long, right long, score double"), [0.9, 0.5, 0.3]).collect()}
    assert grid[0.5]["pair_f1"] == 1.0 and grid[0.5]["eligible"] and not grid[0.3]["eligible"]


def test_group_subjects(spark):
    m = spark.createDataFrame([("g1", "1", "7", "t", "c"), ("g2", "2", "", "谈 甲乙 事", "c"), ("g3", "3", "", "甲乙 与 丙丁", ""), ("g4", "4", "", "无", "文中丙丁")], "group string, id string, code string, title string, content string")
    s = spark.createDataFrame([("9", "甲乙"), ("8", "丙丁")], "code string, name string")
    found = {r["group"]: (r["subject"], r["method"]) for r in clustering.group_subjects(m, s).collect()}
    assert found == {"g1": ("7", "direct"), "g2": ("9", "unique_title_alias"), "g3": ("", "ambiguous_unique_title_alias"), "g4": ("8", "unique_lead_alias")}


def test_model_of_one_class_and_reranker(spark):
    one = models.text_model(spark.createDataFrame([("a b", "x")], "t string, l string"), "t", "l")
    assert models.predicted(one, spark.createDataFrame([("q",)], "t string")).first()["predicted"] == "x"
    two = models.text_model(spark.createDataFrame([("好 增长", "x"), ("增长 中标", "x"), ("处罚 违规", "y"), ("违规 立案", "y")] * 3, "t string, l string"), "t", "l", domain=spark.createDataFrame([("其他",)], "t string"))
    rows = models.predicted(two, spark.createDataFrame([("增长",), ("违规",), (None,)], "t string"))
    assert [r["predicted"] for r in rows.filter("t IS NOT NULL").collect()] == ["x", "y"] and 0 <= rows.first()["confidence"] <= 1
    for other in ("svc", "boosted"):
        assert models.predicted(models.text_model(spark.createDataFrame([("好 增长", "x"), ("处罚 违规", "y")] * 4, "t string, l string"), "t", "l", other), spark.createDataFrame([("增长",)], "t string")).count() == 1
    pair = lambda n: spark.createDataFrame([(str(i), "甲乙丙", "甲乙丙" if i % 2 else "丁戊己", float(i % 2), float(i % 2), i % 2) for i in range(n)], "pair_id string, left_title string, right_title string, cosine double, closeness double, label int")
    threshold, scored = models.reranked(pair(8), pair(6), pair(4))
    assert scored.filter((F.col("score") >= threshold) & (F.col("label") == 1)).count() == 2


def test_reranker_stability(spark):
    pair = lambda n: spark.createDataFrame([(str(i), "甲乙丙", "甲乙丙" if i % 2 else "丁戊己", 0.4 + 0.2 * (i % 3 == 0), float(i % 2), i % 2) for i in range(n)], "pair_id string, left_title string, right_title string, cosine double, closeness double, label int")
    out = models.reranker_stability(pair(40), pair(12), 0.5, [1, 2])
    assert out["recommended"] and out["mean_f1"] == 1.0 and len(out["runs"]) == 2


def test_samples_and_aliases(spark):
    from millrace.functions import text

    long = "内容" * 40
    rows = spark.createDataFrame([("题", long, "甲", ["乙"]), ("题", "短", "甲", []), ("", long, "甲", []), ("题甲", long, "甲", []), ("题", long + "乙", "甲", ["乙"]), ("题", long + "分类标签", "甲", None)], "t string, c string, l string, f array<string>")
    assert [r[0] for r in rows.select(text.valid_sample("t", "c", "l", "f")).collect()] == [True, False, False, False, False, False]
    d = spark.createDataFrame([("company", "1", "甲乙", "e", ""), ("company", "1", "甲乙", "f", ""), ("company", "2", "甲乙丙", "e", ""), ("company", "3", "甲", "e", ""), ("industry", "4", "行业", "e", "")], "scope string, subject_code string, subject_name string, event_name string, description string")
    assert vectors.subject_aliases(d, "company").first()["aliases"] == ["甲乙丙", "甲乙"]


def test_policies_and_lists(spark):
    rows = spark.createDataFrame([(0.9, True, True), (0.5, True, False), (0.1, False, True)], "margin double, hit boolean, p boolean")
    assert models.pseudo_policy(rows.withColumn("q", F.lit(True)), ["p", "q"], 1.0, 1).count() == 2
    df = spark.createDataFrame([(1, "a", "a", "exact_alias", ["b", "a"])], "row int, label string, accepted string, method string, candidates array<string>")
    match = lambda p: df.select(vectors.structural_match("label", "accepted", "method", "candidates", p)).first()[0]
    assert [match(p) for p in ("top1", "top3", "hard_top3", "exact_top3")] == [False, True, True, True]
    assert df.select(vectors.with_truth("candidates", F.lit("z"), 2).alias("c")).first()["c"] == ["b", "z"]
    t = df.withColumn("truth", F.lit("a"))
    assert {(r["label"], r["target"]) for r in vectors.training_pairs(t).collect()} == {("a", 1), ("b", 0)}
    s = spark.createDataFrame([("candidate_only", 1.0, 9.0), ("exact_alias", 1.0, 9.0), ("exact_alias", 1.0, None)], "method string, global_score double, expert_score double")
    assert [r["score"] for r in vectors.chosen_scores(s).collect()] == [1.0, 9.0, 1.0]
    known = vectors.aligned_scores(spark.createDataFrame([(1, "a", 0.5)], "row int, label string, score double"), spark.createDataFrame([("a",), ("b",)], "label string"), spark.createDataFrame([(1,)], "row int"))
    assert {r["label"]: r["score"] for r in known.collect()} == {"a": 0.5, "b": -1e9}
    corpus = vectors.subject_corpus(spark.createDataFrame([("c", "n", "e2", "d2"), ("c", "n", "e1", "d1")], "subject_code string, subject_name string, event_name string, description string"))
    assert corpus.first()["text"] == "n。事件体系：e1：d1；e2：d2"


def test_agent_metrics_and_bootstrap(spark):
    rows = spark.createDataFrame([("a", "a", "b"), ("a", "b", "a"), ("b", "b", "b")], "truth string, baseline string, agent string")
    e = metrics.agent_effect(rows).first()
    assert (e["corrected"], e["harmed"]) == (1, 1)
    d = spark.createDataFrame([(True, False, 2, 10, ["x"]), (False, True, 1, 20, ["x", "y"])], "changed boolean, fallback boolean, steps int, latency_ms long, tools array<string>")
    assert metrics.shadow_summary(d).first()["latency_p95"] == 20 and {r["tool"]: r["n"] for r in metrics.tool_usage(d).collect()} == {"x": 2, "y": 1}
    with pytest.raises(Exception, match="seed twice"):
        metrics.seed_summary(spark.createDataFrame([("c", 1, 0.5), ("c", 1, 0.6)], "config string, seed int, m double"), "m").collect()
    b = metrics.bootstrap(spark.range(400).select(F.col("id").alias("key"), F.lit(1).alias("truth"), (F.col("id") % 4 > 0).cast("int").alias("predicted")), "key", 50)
    i = metrics.interval(b, "accuracy").first()
    assert i["low"] < 0.75 < i["high"] and abs(i["mean"] - 0.75) < 0.02
    pairs_ = spark.createDataFrame([(1, "s", "g", "direct"), (0, "s", "h", "alias")], "label int, subject string, group string, method string")
    assert metrics.pair_summary(pairs_).first()["methods"] == '{"alias":1,"direct":1}'
    worst = metrics.worst_classes(spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "b")], "truth string, predicted string"), 1, 1).first()
    assert worst["label"] in ("a", "b")
    ctx = clustering.group_contexts(spark.createDataFrame([("g", "1", "7", "t", "c", T, "l"), ("g", "2", "7", "t", "c", T, "m"), ("h", "3", "", "", "", T, "l")], "group string, id string, code string, title string, content string, ts timestamp_ntz, label string"), spark.createDataFrame([("7", "甲乙")], "code string, name string"))
    assert [(r["group"], r["n"], r["label"], r["subject"]) for r in ctx.collect()] == [("g", 2, "l", "7")]


@pytest.mark.parametrize("seed", range(3))
def test_best_earlier_equals_a_plain_search(spark, seed):
    import random

    r = random.Random(seed)
    spread = r.choice([3, 30, 3000])
    rows = [(i, r.choice("ab"), T + datetime.timedelta(minutes=r.randint(-spread * 40, spread * 40)), float(r.randint(0, 5))) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, code string, ts timestamp_ntz, s double")
    window, most = datetime.timedelta(days=1), 3
    found = {}
    for x in pairs.best_earlier(df, "code", "id", "ts", "s", 1, most).collect():
        found.setdefault(x["right"], set()).add(x["left"])
    for i, c, t, _ in rows:
        earlier = sorted((-s, u, j) for j, d, u, s in rows if d == c and (u, j) < (t, i) and t - u <= window)
        assert found.get(i, set()) == {j for _, _, j in earlier[:most]}


def test_running_sums_and_places(spark):
    from millrace.operators.ordering import ordered, running

    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(2).alias("v")).repartition(7)
    assert all(r["v"] == 2 * (1000 - r["k"]) for r in running(df, F.desc("k"), "v").collect())
    assert all(r["place"] == r["k"] + 1 for r in ordered(df, F.col("k")).collect())
    assert running(df.limit(0), F.col("k"), "v").count() == 0
