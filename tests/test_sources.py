"""Workbooks, JSON tables, ledgers, vector tables and clients."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import agents
from millrace.sources import jsonl, vectors, workbook


@pytest.fixture(scope="module")
def book(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("book") / "news.xlsx")
    workbook.write_workbook(path, {
        "个股新闻": [["article_file_id", "article_title", "article_publish_time", "article_source", "content", "trading_code", "secu_abbr", "event_name", "note"], ["a1", "　标题 一", "45292", "证券时报", "正文", "1", "甲乙股份有限公司", "业绩预告", "n1"], [None, "二", "bad", "", "", "2.0", "", "", None]],
        "个股重复新闻": [["article_file_id", "article_title", "duplication_id"], ["d1", "重复", "7.0"]],
        "other": [["x"], ["1"], ["2"], ["3"]],
    })
    return path


def test_workbook(spark, book):
    rows = {r["article_id"]: r for r in workbook.articles(workbook.read_workbook(spark, book)).collect()}
    first, second = rows["a1"], rows["ROW-2"]
    assert first["title"] == "标题 一" and first["trading_code"] == "000001" and first["entity"] == "甲乙" and str(first["publish_time"]) == "2024-01-01 00:00:00"
    assert first["task_scope"] == "company_event" and first["extra"] == {"note": "n1"} and first["source_row"] == 2 and first["event_label"] == "业绩预告"
    assert second["publish_time"] is None and second["event_label"] is None and second["source_row"] == 3
    assert rows["d1"]["task_scope"] == "company_duplicate" and rows["d1"]["duplication_id"] == "7" and rows["d1"]["event_label"] is None
    assert [r["cells"]["x"] for r in workbook.read_workbook(spark, book, "other", 2).collect()] == ["1", "2"]
    assert workbook.read_workbook(spark, book, 1).count() == 1
    assert [s["dimension"] for s in workbook.structure(book)] == ["A1:I3", "A1:C2", "A1:A4"]
    with pytest.raises(Exception, match="no such sheet"):
        workbook.read_workbook(spark, book, "none").collect()
    assert workbook.renamed(spark.createDataFrame([("1", "2", "3")], "Article_Title string, title string, x string")).columns == ["title", "title", "x"]


def test_json_tables(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"feedback_id": "1", "article_id": "a", "kind": "wrong_type", "metadata": {"k": "v"}}\n{"feedback_id": "2"}\n')
    rows = jsonl.read_lines(spark, str(tmp_path / "f.jsonl"), "feedback")
    assert rows.count() == 2 and rows.filter("feedback_id = '1'").first()["metadata"] == {"k": "v"} and jsonl.read_lines(spark, str(tmp_path / "f.jsonl"), "feedback", 1).count() == 1
    (tmp_path / "bad.jsonl").write_text("not json\n")
    with pytest.raises(Exception):
        jsonl.read_lines(spark, str(tmp_path / "bad.jsonl"), "edges").collect()
    (tmp_path / "m.json").write_text('{"macro_f1": 1}')
    assert jsonl.read_metrics(str(tmp_path / "m.json")) == {"macro_f1": 1.0}
    (tmp_path / "c.json").write_text(json.dumps([{"company": {"trading_code": "1", "secu_abbr": "甲"}, "event_schema": [{"event_name": "e", "description": "d"}, {"event_name": " ", "description": ""}]}]))
    (tmp_path / "i.json").write_text(json.dumps([{"industry": {"inducode": "9", "induname": "业"}, "event_schema": [{"event_name": "e"}]}]))
    t = jsonl.read_taxonomy(spark, str(tmp_path / "c.json"), str(tmp_path / "i.json"))
    assert {(r["scope"], r["subject_code"], r["event_name"]) for r in t.collect()} == {("company", "000001", "e"), ("industry", "9", "e")} and jsonl.read_taxonomy(spark).count() == 0
    prof = {r["key"]: r for r in jsonl.key_profile(spark.createDataFrame([('{"a": 1}',), ('{"a": "x", "b": 2}',), ("no",)], "j string"), "j").collect()}
    assert prof["a"]["n"] == 2 and prof["b"]["n"] == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "甲")], "id int, name string")
    jsonl.write_lines(df, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).first()["name"] == "甲"
    assert jsonl.write_document(df, str(tmp_path / "d/doc.json")) == json.loads((tmp_path / "d/doc.json").read_text()) == {"id": 1, "name": "甲"}
    with pytest.raises(ValueError):
        jsonl.write_document(df.unionByName(df), str(tmp_path / "x.json"))
    life = spark.createDataFrame([(7, "2024-01-01")], "cluster_id long, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    for _ in range(2):
        jsonl.write_run(str(tmp_path / "run"), {"lifecycles": life, "alerts": df}, str(tmp_path / "ledger"))
    ledger = spark.read.parquet(str(tmp_path / "ledger"))
    assert sorted(r["version"] for r in ledger.collect()) == [1, 2]
    skill = spark.createDataFrame([("S1", "active"), ("S2", "shadow")], "skill_id string, status string")
    jsonl.export_skills(skill, str(tmp_path / "skills"))
    assert [p.name for p in (tmp_path / "skills").glob("skill=*")] == ["skill=S1"]
    report = jsonl.evaluation_report("r", spark.createDataFrame([("a", "a"), ("a", "b")], "truth string, predicted string"), ["a", "b"])
    assert "accuracy: 0.5" in report and "## confusion" in report


def test_vector_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t", "c"), ("b", "u", None)], "article_id string, title string, content string")
    path = str(tmp_path / "v")
    assert vectors.export(rows.limit(1), agents.HashEmbedding, path, model="h") == 1
    assert vectors.export(rows, agents.HashEmbedding, path, model="h") == 1 and vectors.export(rows, agents.HashEmbedding, path, model="h") == 0
    with pytest.raises(ValueError, match="another model"):
        vectors.export(rows, agents.HashEmbedding, path, model="other")
    assert len(spark.read.parquet(path).first()["embedding"]) == 64
    assert vectors.checked(spark.range(3).select(F.col("id").cast("string").alias("k"), F.col("id").alias("row")), "k", "row").count() == 3
    with pytest.raises(ValueError):
        vectors.checked(spark.range(1, 3).select("id", F.col("id").alias("row")), "id", "row")
    empty = spark.createDataFrame([], "model string, digest string, embedding array<float>")
    texts = spark.createDataFrame([("x",), ("x",), ("y",)], "text string")
    found, new = vectors.cached(texts, empty, agents.HashEmbedding, "h")
    assert found.count() == 3 and new.count() == 2
    again, none = vectors.cached(texts, new, agents.HashEmbedding, "h")
    assert again.count() == 3 and none.count() == 0


def test_http_embedding_halves_and_retries():
    calls = []

    def post(url, payload, timeout):
        calls.append(len(payload["input"]))
        if len(payload["input"]) > 1:
            raise RuntimeError("too many")
        return {"embeddings": [[1.0]] * len(payload["input"])}

    assert agents.HttpEmbedding("u", "m", batch=4, post=post).embed(["a"] * 4) == [[1.0]] * 4 and calls == [4, 2, 1, 1, 2, 1, 1]
    tries = []

    def flaky(url, payload, timeout):
        tries.append(1)
        raise RuntimeError("CUDA out of memory" if len(tries) > 2 else "down")

    with pytest.raises(RuntimeError, match="out of memory"):
        agents.HttpEmbedding("u", "m", retries=5, delay=0, post=flaky).embed(["a"])
    chat = agents.HttpChat("u", "m", "k", post=lambda *a: {"choices": [{"message": {"content": "hi"}}], "usage": {"total_tokens": 3}})
    assert chat.ask("q") == "hi" and chat.tokens == 3


def test_expert_rules(spark):
    row = {"article_id": "1", "title": "t", "content": "c", "baseline": "x", "candidates": ["y"]}
    say = lambda *answers: type("C", (), {"ask": lambda self, p, it=iter(answers): next(it)})()
    look, defs, pick = '{"action": "evidence"}', '{"action": "definitions"}', '{"action": "final", "decision": "select", "label": "y"}'
    assert agents.expert(row, say(look, defs, pick))["label"] == "y"
    assert agents.expert(row, say(look, pick))["fallback"] and agents.expert(row, say(pick))["fallback"]
    assert agents.expert(row, say(look, defs, '{"action": "final", "label": "z"}'))["label"] == "x"
    assert agents.expert(row, say('{"action": "final", "decision": "abstain"}'))["decision"] == "abstain"
    assert agents.expert(row, say("nonsense"))["fallback"] and agents.expert(row, say(look, look, look, look))["steps"] == 4
    cases = spark.createDataFrame([("1", "标题", ["a", "b"])], "article_id string, title string, candidates array<string>")
    assert agents.taught(cases, lambda: agents.RuleChat([("label:", '{"label": "b"}')])).first()["label"] == "b"
    assert agents.taught(cases, lambda: agents.RuleChat([("label:", '{"label": "q"}')])).first()["label"] is None
    d = spark.createDataFrame([("1", "x", "y"), ("2", "x", "x")], "article_id string, baseline string, label string")
    assert {r["article_id"]: r["label"] for r in agents.verified(d, lambda: agents.RuleChat([])).collect()} == {"1": "x", "2": "x"}
