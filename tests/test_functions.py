"""Scalar functions and rules on literals."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import rules, similarity, text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: text.clean(F.lit("　a \n b c ")), "a b c"),
        (lambda: text.clean(F.lit(None)), ""),
        (lambda: text.is_blank(F.lit(" 　")), True),
        (lambda: text.is_blank(F.lit(float("nan"))), True),
        (lambda: text.entity_name(F.lit("甲乙股份有限公司，丙公司")), "甲乙"),
        (lambda: text.entity_name(F.lit("甲集团")), "甲"),
        (lambda: text.polarity(F.lit("POS")), "正面"),
        (lambda: text.polarity(F.lit("增长但有处罚")), "负面"),
        (lambda: text.polarity(F.lit(""), F.lit("中标")), "正面"),
        (lambda: text.polarity(F.lit(None)), "中性"),
        (lambda: text.identifier(F.lit("1.0"), 6), "000001"),
        (lambda: text.identifier(F.lit("12345678"), 6), "12345678"),
        (lambda: text.identifier(F.lit("A1"), 6), "A1"),
        (lambda: text.source_key(F.lit(" 新 华　社 "), F.lit("abcdefabcdefabc")), "新华社"),
        (lambda: text.source_key(F.lit(None), F.lit("abcdefabcdefabc")), "unknown-abcdefabcdef"),
        (lambda: text.tokens(F.lit("公司A 增长,B2 x 增长")), ["公司A", "增长", "B2"]),
        (lambda: text.char_grams(F.lit("a b a")), ["ab", "ba"]),
        (lambda: text.char_grams(F.lit("a")), ["a"]),
        (lambda: text.char_grams(F.lit(None)), []),
        (lambda: text.compact(F.lit("Ab-C 公司!")), "abc公司"),
        (lambda: text.evidence_sentence(F.lit("今天晴。业绩增长！其他"), F.lit("t")), "业绩增长！"),
        (lambda: text.evidence_sentence(F.lit("今天晴。明天雨"), F.lit("t")), "今天晴。"),
        (lambda: text.evidence_sentence(F.lit(""), F.lit("题")), "题"),
        (lambda: text.sampled(F.lit("abcdefghij"), "head_tail", 4), "ab\nij"),
        (lambda: text.sampled(F.lit("abcdefghij"), "head_middle_tail", 6), "ab\nef\nij"),
        (lambda: text.sampled(F.lit("abc"), "head_tail", 4), "abc"),
        (lambda: text.masked(F.lit("甲乙和甲"), F.array(F.lit("甲乙"), F.lit("甲"))), "[SUBJECT]和[SUBJECT]"),
        (lambda: text.pair_key(F.lit("b"), F.lit("a")), "a::b"),
        (lambda: text.split_ids(F.lit(" a, ,b，c")), ["a", "b", "c"]),
        (lambda: text.merged_lists(F.array(F.lit("b"), F.lit(" a")), F.array(F.lit("a"), F.lit("c")), limit=3), ["b", "a", "c"]),
        (lambda: text.trigger_terms(F.array(F.lit(" ab "), F.lit("x"), F.lit("ab"))), ["ab"]),
        (lambda: F.variant_get(text.json_action(F.lit('```json {"a": 1} ```')), "$.a", "int"), 1),
        (lambda: text.json_action(F.lit("none")).isNull(), True),
        (lambda: text.dependency(F.lit("db:fallback"))["fallback_available"], True),
        (lambda: text.parse_time(F.lit("soon")), None),
        (lambda: text.parse_sheet_time(F.lit("45292")), datetime.datetime(2024, 1, 1)),
        (lambda: text.parse_sheet_time(F.lit("45292.5")), datetime.datetime(2024, 1, 1, 12)),
        (lambda: text.parse_sheet_time(F.lit("2024年1月2日")), datetime.datetime(2024, 1, 2)),
        (lambda: rules.source_type(F.lit("上海证券报官网")), "公司"),
        (lambda: rules.source_authority(F.lit(None)), 0.35),
        (lambda: rules.stance(F.lit("确认后澄清")), "refutes"),
        (lambda: rules.severity(F.lit("重大诉讼与业绩预告")), 0.72),
        (lambda: rules.alert_level(F.lit(0.8), F.lit(0.7), F.lit("负面")), "高风险"),
        (lambda: rules.alert_level(F.lit(0.2), F.lit(0.7), F.lit("负面")), "待核实重点关注"),
        (lambda: rules.direction_of(F.lit(1), F.lit(1), F.lit(1), F.lit("")), "负面"),
        (lambda: rules.backoff_seconds(F.lit(9)), 300),
        (lambda: similarity.time_close(F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"), 7), 0.5),
        (lambda: similarity.time_closeness(F.lit(1.0)), 0.5),
        (lambda: similarity.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), 0.0),
        (lambda: similarity.sequence_ratio(F.lit("tide"), F.lit("diet")), 0.25),
        (lambda: similarity.sequence_ratio(F.lit("diet"), F.lit("tide")), 0.5),
    ],
)
def test_value(spark, column, expected):
    assert value(spark, column()) == expected


def test_bad_dependency_raises(spark):
    with pytest.raises(Exception, match="not a dependency"):
        value(spark, text.dependency(F.lit("db:maybe"))["name"])


def test_within_days_is_inclusive(spark):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    assert value(spark, similarity.within_days(t("2024-01-01"), t("2024-01-08"), 7))
    assert not value(spark, similarity.within_days(t("2024-01-01"), t("2024-01-08 00:00:01"), 7))


SNAPSHOTS = [
    ("healthy", 100, 1, 0, True, True, None, 0, "continue", "healthy"),
    ("backlog", 800, 1, 0, True, True, None, 0, "scale_up", "healthy"),
    ("idle", 10, 3, 0, True, True, None, 0, "scale_down", "healthy"),
    ("one failure", 100, 1, 1, True, True, None, 0, "retry", "healthy"),
    ("crash", 100, 1, 1, False, True, None, 0, "restart", "degraded"),
    ("failing", 100, 1, 3, True, True, None, 0, "degrade", "degraded"),
    ("broken", 100, 1, 5, True, True, None, 0, "stop", "stopped"),
    ("replaced", 100, 1, 0, True, True, (False, True, True), 0, "fallback", "degraded"),
    ("lost", 100, 1, 0, True, True, (False, True, False), 0, "stop", "stopped"),
    ("invalid", 0, 1, 0, True, False, None, 0, "stop", "stopped"),
    ("gap", 100, 1, 0, True, True, None, 1, "collect_evidence", "healthy"),
]


def test_runtime_scenarios(spark):
    rows = [(n, q, w, f, a, v, [("x", *d)] if d else [], r) for n, q, w, f, a, v, d, r, _, _ in SNAPSHOTS]
    df = spark.createDataFrame(rows, "name string, q int, w int, f int, a boolean, v boolean, d array<struct<name:string,healthy:boolean,required:boolean,fallback_available:boolean>>, r int")
    found = {r["name"]: r for r in df.select("name", *(c.alias(k) for k, c in rules.runtime_actions("q", "w", "f", "a", "v", "d", "r").items())).collect()}
    for name, *_, action, state in SNAPSHOTS:
        assert action in [a["action"] for a in found[name]["actions"]], name
        assert found[name]["state"] == state and not found[name]["unsafe_continue"]
        priorities = [a["priority"] for a in found[name]["actions"]]
        assert priorities == sorted(priorities, reverse=True)


def test_settings(tmp_path, monkeypatch):
    from millrace.config import DEFAULTS, load_env, load_settings

    assert DEFAULTS.cluster.threshold == 0.72 and DEFAULTS.runtime.backoff_seconds == (30, 120, 300)
    good, bad, env = tmp_path / "a.yaml", tmp_path / "b.yaml", tmp_path / ".env"
    good.write_text("cluster: {threshold: 0.8}\nruntime: {backoff_seconds: [1, 2]}\n")
    bad.write_text("cluster: {treshold: 0.8}\n")
    assert load_settings(str(good)).cluster.threshold == 0.8 and load_settings(str(good)).runtime.backoff_seconds == (1, 2)
    assert load_settings(str(good)) is load_settings(str(good))
    with pytest.raises(ValueError, match="treshold"):
        load_settings(str(bad))
    env.write_text("# note\nMR_A=1\nMR_B='2'\n")
    monkeypatch.setenv("MR_A", "0")
    monkeypatch.delenv("MR_B", raising=False)
    assert load_env(str(env)) == {"MR_B": "2"} and load_env(str(tmp_path / "none")) == {}
    monkeypatch.delenv("MR_B", raising=False)
