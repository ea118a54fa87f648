"""Tables of the engine's kinds derived from the standard tables by rule, and the same as SQL.

`news` makes an article of every event: its words come from the event's type and number,
so that every rule of the engine has rows that meet it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import table

# Titles by event type, sources by number modulo 7, closing sentences by number modulo 11.
TITLES = {"click": "供应订单更新", "purchase": "业绩增长", "signup": "董事长任命", "error": "违规处罚", "view": "政策补贴发布"}
SOURCES = ("证监会网站", "某公司公告", "证券时报", "新华社", "雪球", "论坛 A", "")
CLOSINGS = ("公司澄清不实传闻。", "确认属实。", "影响扩大升级。", "已经结案，恢复正常。", "市场关注；后续待观察。")

EPOCH = "2024-01-01"


def _case(column, values: dict, otherwise):
    out = None
    for k, v in values.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(otherwise)


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    title = _case(F.col("event_type"), TITLES, "其他")
    closing = _case(i % 11, dict(enumerate(CLOSINGS[:4])), CLOSINGS[4])
    return e.select(
        i.alias("id"), F.concat(F.lit("N"), i.cast("string")).alias("article_id"), title.alias("title"), _case(i % 7, dict(enumerate(SOURCES)), "").alias("source"),
        F.concat(F.lit("　快讯："), title, F.lit("。"), closing, F.lit("编号"), i.cast("string")).alias("content"), F.when(i % 97 != 0, F.col("ts")).alias("publish_time"),
        F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("甲"), F.col("user_id").cast("string"), F.lit("股份有限公司"))).alias("entity"), F.col("user_id").cast("string").alias("trading_code"),
        F.when(i % 13 == 0, "1").otherwise("0").alias("duplicate_flag"), F.when(i % 4 == 0, F.when(i % 3 == 0, "正面").when(i % 3 == 1, "负面").otherwise("中性")).alias("polarity_label"),
        "user_id", "event_type", "value",
    )


NEWS_SQL = f"""news AS (SELECT *, '　快讯：' || title || '。' || closing || '编号' || id AS content FROM (
SELECT event_id AS id, 'N' || event_id AS article_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in TITLES.items())} ELSE '其他' END AS title,
  CASE event_id % 7 {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SOURCES))} END AS source,
  CASE event_id % 11 {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(CLOSINGS[:4]))} ELSE '{CLOSINGS[4]}' END AS closing,
  CASE WHEN event_id % 97 <> 0 THEN ts END AS publish_time, CASE WHEN user_id % 5 = 0 THEN '' ELSE '甲' || user_id || '股份有限公司' END AS entity, user_id::VARCHAR AS trading_code,
  CASE WHEN event_id % 13 = 0 THEN '1' ELSE '0' END AS duplicate_flag,
  CASE WHEN event_id % 4 = 0 THEN CASE event_id % 3 WHEN 0 THEN '正面' WHEN 1 THEN '负面' ELSE '中性' END END AS polarity_label, user_id, event_type, value
FROM events))"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the first 60 characters are the title, the id makes the time."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"), "source", "lang", "n_chars", F.timestamp_add("HOUR", (F.col("doc_id") % 1080).cast("int"), F.lit(EPOCH).cast("timestamp_ntz")).alias("ts"))


ARTICLES_SQL = f"articles AS (SELECT doc_id AS id, substring(text, 1, 60) AS title, text AS content, source, lang, n_chars, TIMESTAMP '{EPOCH}' + to_hours((doc_id % 1080)::INT) AS ts FROM documents)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a score table: of each order (row) and line number (label) the largest price, which is exact."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("row"), F.col("l_linenumber").cast("bigint").alias("label")).agg(F.max("l_extendedprice").alias("score"), F.min("l_quantity").alias("other"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))


SCORES_SQL = "scores AS (SELECT l_orderkey AS row, l_linenumber::BIGINT AS label, max(l_extendedprice) AS score, min(l_quantity) AS other, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM lineitem GROUP BY ALL)"
