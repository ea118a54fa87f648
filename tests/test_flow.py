"""The whole path on small sets of articles."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.plans import flow
from millrace.sources import jsonl


def articles(spark, *rows):
    names = [f.split()[0] for f in schemas.ARTICLE.split(", ")]
    blank = dict.fromkeys(names)
    return spark.createDataFrame([tuple((blank | {"task_scope": "company_event", "extra": {}} | r)[n] for n in names) for r in rows], schemas.ARTICLE)


def test_two_articles_of_one_event(spark, tmp_path):
    day = datetime.datetime(2024, 5, 1)
    both = articles(
        spark,
        {"article_id": "1", "title": "某公司收到处罚决定书", "content": "监管确认某公司违规并处罚。", "source": "证监会", "entity": "某甲", "publish_time": day},
        {"article_id": "2", "title": "某公司收到处罚决定书", "content": "监管确认某公司违规并处罚。", "source": "证券时报", "entity": "某甲", "publish_time": day + datetime.timedelta(days=1)},
    )
    out = flow.run(both)
    cluster = out["clusters"].collect()
    assert len(cluster) == 1 and cluster[0]["article_ids"] == ["1", "2"] and cluster[0]["event_type"] == "监管处罚" and cluster[0]["company"] == "某甲"
    alert = out["alerts"].first()
    assert alert["risk_level"] == "高风险" and alert["delivery_allowed"] and alert["claim_evidence_coverage"] == 1.0
    life = out["lifecycles"].first()
    assert life["stage"] == "corroborated" and [s["stage"] for s in life["snapshots"]] == ["official_confirmed", "corroborated"]
    assert out["gates"].filter("NOT passed").count() == 0 and out["claims"].count() == 3 and out["decisions"].filter("merged").count() == 1
    for version in (1, 2):
        jsonl.write_run(str(tmp_path / "run"), {"lifecycles": out["lifecycles"].select("cluster_id", "stage", "score").withColumn("created_at", F.lit("2024-05-01").cast("timestamp")), "alerts": out["alerts"]}, str(tmp_path / "ledger"))
        assert spark.read.parquet(str(tmp_path / "ledger")).agg(F.max("version")).first()[0] == version


def test_positive_article_and_one_without_event(spark):
    out = flow.run(articles(spark, {"article_id": "1", "title": "公司中标大订单", "content": "订单增长。", "source": "公司公告"}, {"article_id": "2", "title": "天气", "content": "晴。", "source": "x"}))
    alert = out["alerts"].collect()
    assert len(alert) == 1 and alert[0]["impact_direction"] == "正面" and "机会" in alert[0]["risk_level"]
    assert out["predictions"].filter("NOT has_event").count() == 1


def test_requests(spark):
    answer = flow.analyse(spark, {"scope": "company", "articles": [{"title": "甲涉嫌财务造假", "source": "雪球", "content": "虚增收入，立案。", "entity": "ignored"}]})
    assert answer["predictions"][0]["event_type"] == "监管处罚" and not answer["alerts"][0]["company"] and len(answer["lifecycles"]) == 1
    assert not answer["alerts"][0]["delivery_allowed"] or answer["alerts"][0]["risk_level"] not in ("高风险", "待核实重点关注")
    for bad in ([], [{}] * 21):
        with pytest.raises(ValueError, match="1 to 20"):
            flow.analyse(spark, {"articles": bad})


def test_many_articles_need_a_block(spark, monkeypatch):
    monkeypatch.setattr(flow, "ALL_PAIRS", 1)
    rows = articles(spark, *({"article_id": str(i), "title": "处罚", "content": "处罚。", "source": "s", "entity": f"e{i % 2}"} for i in range(4)))
    with pytest.raises(ValueError, match="need a block"):
        flow.run(rows)
    assert flow.run(rows, block=["entity"])["clusters"].count() == 2
