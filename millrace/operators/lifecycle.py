"""Evidence lifecycles, credibility, alerts, claims and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace import lexicon as L
from millrace.config import DEFAULTS, EvidenceGate, Learning, Lifecycle
from millrace.functions import rules
from millrace.functions.text import contains_any, source_key


def evidence(articles: DataFrame) -> DataFrame:
    """articles (article_id, cluster_id, title, content, source, publish_time, evidence_sentence) -> one evidence row each."""
    nn = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = F.trim(F.concat_ws(" ", nn("title"), nn("content"), nn("evidence_sentence")))
    digest = F.sha2(F.concat_ws("|", nn("source"), nn("title"), nn("content")), 256)
    return articles.select(
        "cluster_id", F.concat(F.lit("EVD-"), F.substring(digest, 1, 16)).alias("evidence_id"), "article_id", F.when(nn("source") == "", L.UNKNOWN_SOURCE).otherwise(F.col("source")).alias("source"),
        rules.source_type("source").alias("source_type"), source_key("source", digest).alias("source_key"), rules.stance(text).alias("stance"), rules.source_authority("source").alias("authority"),
        F.col("publish_time").alias("ts"), F.substring(F.when(nn("evidence_sentence") != "", F.col("evidence_sentence")).otherwise(nn("title")), 1, 300).alias("summary"),
    )


def stages(rows: DataFrame, cfg: Lifecycle = DEFAULTS.lifecycle) -> DataFrame:
    """Evidence rows in order with stage, claim status and whether the source is new, by running aggregates.

    Rows of a cluster are ordered by time, undated ones last, then by article.
    """
    order = W.partitionBy("cluster_id").orderBy(F.col("ts").isNull(), "ts", "article_id")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    supports, refutes = F.col("stance") == "supports", F.col("stance") == "refutes"
    seen = rows.withColumn("seq", F.row_number().over(order)).withColumn("source_seq", F.row_number().over(W.partitionBy("cluster_id", "source_key").orderBy(F.col("ts").isNull(), "ts", "article_id")))
    # the first support of each source, so that a running sum counts distinct sources
    first_support = F.min(F.when(supports, F.col("seq"))).over(W.partitionBy("cluster_id", "source_key"))
    seen = seen.withColumn("new_supporter", F.coalesce((F.col("seq") == first_support).cast("int"), F.lit(0)))
    run = seen.withColumns({
        "n_support": F.sum(supports.cast("int")).over(so_far), "n_refute": F.sum(refutes.cast("int")).over(so_far), "n_supporters": F.sum("new_supporter").over(so_far),
        "n_official": F.sum((supports & (F.col("source_type") == "官方")).cast("int")).over(so_far),
    })
    refuted = refutes & (F.col("authority") >= cfg.company_authority) & F.col("source_type").isin("公司", "官方")
    confirmed = supports & (F.col("authority") >= cfg.official_authority) & (F.col("source_type") == "官方")
    disputed = (F.col("n_support") > 0) & (F.col("n_refute") > 0)
    resolved = contains_any("summary", L.RESOLUTION_WORDS)
    escalated = contains_any("summary", L.ESCALATION_WORDS) & (F.col("n_support") > 0)
    company = F.col("source_type") == "公司"
    corroborated = F.col("n_supporters") >= cfg.corroborated_sources
    stage = (
        F.when(refuted, "official_clarified").when(confirmed, "official_confirmed").when(disputed, "disputed").when(resolved, "resolved").when(escalated, "impact_escalated")
        .when(company, "company_responded").when(corroborated, "corroborated").otherwise("media_reported")
    )
    status = (
        F.when(refuted, "refuted").when(confirmed, "confirmed").when(disputed, "disputed").when(resolved, "resolved").when(escalated, F.when(F.col("n_official") > 0, "confirmed").otherwise("supported"))
        .when(company, F.when(supports, "supported").otherwise("unverified")).when(corroborated, "supported").otherwise("unverified")
    )
    return run.withColumn("stage", stage).withColumn("claim_status", status).withColumn("new_source", F.col("source_seq") == 1).drop("source_seq", "new_supporter", "n_support", "n_refute", "n_official")


def next_score(score: Column, row: Column, cfg: Lifecycle = DEFAULTS.lifecycle) -> Column:
    """The credibility after one more piece of evidence (a struct of stance, stage, authority, new_source), to 4 places."""
    gain = cfg.evidence_gain * row["authority"]
    bonus = F.when(row["new_source"], cfg.new_source_bonus).otherwise(0.0)
    up = score + gain + bonus + F.when(row["stage"] == "official_confirmed", cfg.official_bonus).otherwise(0.0)
    down = F.when(row["stage"] == "official_clarified", F.greatest(score, row["authority"] * 0.7 + cfg.clarification_bonus)).otherwise(score * cfg.dispute_factor)
    other = score + gain * 0.35 + bonus * 0.35
    moved = F.when(row["stance"] == "supports", up).when(row["stance"] == "refutes", down).otherwise(other)
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), moved)), 4)


def lifecycles(evidence_rows: DataFrame, cfg: Lifecycle = DEFAULTS.lifecycle) -> DataFrame:
    """One row per cluster: its final stage, status and score, and a snapshot per piece of evidence.

    The score is a recurrence that rounds at every step, so it is folded over the
    cluster's ordered array; the array holds a few numbers per piece of evidence.
    """
    row = F.struct("seq", "stance", "stage", "claim_status", "authority", "new_source", "source_key", "source_type", "evidence_id", "ts")
    grouped = stages(evidence_rows, cfg).groupBy("cluster_id").agg(F.sort_array(F.collect_list(row)).alias("evidence"))
    folded = F.aggregate("evidence", F.array().cast("array<double>"), lambda scores, r: F.concat(scores, F.array(next_score(F.coalesce(F.try_element_at(scores, F.lit(-1)), F.lit(0.0)), r, cfg))))
    scored = grouped.withColumn("scores", folded)
    snapshots = F.zip_with("evidence", "scores", lambda r, s: F.struct(r["seq"].alias("seq"), r["stage"].alias("stage"), r["claim_status"].alias("claim_status"), s.alias("score")))
    last = F.element_at("evidence", -1)
    return scored.select("cluster_id", F.size("evidence").cast("bigint").alias("n_evidence"), last["stage"].alias("stage"), last["claim_status"].alias("claim_status"), F.element_at("scores", -1).alias("score"), snapshots.alias("snapshots"), "evidence")


def _summed(members: DataFrame, order: str, **values: Column) -> DataFrame:
    """members with each value, not negative, summed through the row in its cluster's order: the largest is the sum, whose last bits don't depend on how rows were dealt."""
    so_far = W.partitionBy("cluster_id").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return members.withColumns({k: F.sum(v).over(so_far) for k, v in values.items()})


def credibility(members: DataFrame, now: Column | None = None, order: str | None = None) -> DataFrame:
    """members (cluster_id, title, publish_time, source, content, entity, duplicate_flag) -> the parts and the sum of each cluster's credibility.

    Without `now` recency is measured from the cluster's own latest date, so it is 1 for
    every dated cluster. With `order`, a column of unique values, averages of doubles are
    summed in that order, else in any.
    """
    filled = sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0) for c in ("title", "publish_time", "source", "content", "entity")), F.lit(0)) / 5
    authority = rules.source_authority("source")
    average = {"authority": F.avg(authority), "filled": F.avg(filled)}
    if order is not None:
        members = _summed(members.select("cluster_id", "title", "publish_time", "source", "content", "entity", "duplicate_flag", order), order, _authority=authority, _filled=filled)
        average = {k: F.max(f"_{k}") / F.count(F.lit(1)) for k in average}
    base = members.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), average["authority"].alias("source_authority"), F.least(F.lit(1.0), F.count_distinct(F.nullif("source", F.lit(""))) / 3).alias("multi_source_consistency"),
        F.when(F.max(authority) >= 0.9, 1.0).otherwise(0.0).alias("official_endorsement"), average["filled"].alias("content_completeness"),
        F.least(F.lit(0.2), F.avg(rules.duplicate_flagged("duplicate_flag").cast("int")) * 0.1).alias("duplicate_penalty"), F.max("publish_time").alias("latest"),
    )
    anchor = F.col("latest") if now is None else now
    days = F.abs(F.timestamp_diff("SECOND", F.col("latest"), anchor)) / 86400
    recency = F.when(F.col("latest").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.least(days, F.lit(30.0)) / 30))
    scored = base.withColumn("recency_score", recency)
    return scored.withColumn("credibility", rules.credibility_score("source_authority", "multi_source_consistency", "official_endorsement", "content_completeness", "recency_score", "duplicate_penalty")).drop("latest")


def directions(members: DataFrame) -> DataFrame:
    """Each cluster's direction: the most frequent label, else by the words of its texts."""
    label = lambda x: F.count_if(F.col("polarity_label") == x)
    text = lambda words: F.max(contains_any(F.concat_ws(" ", "title", "content"), words))
    base = members.groupBy("cluster_id").agg(label(L.POSITIVE).alias("p"), label(L.NEGATIVE).alias("n"), label(L.NEUTRAL).alias("z"), text(L.NEGATIVE_WORDS).alias("tn"), text(L.POSITIVE_WORDS).alias("tp"))
    by_text = F.when(F.col("tn"), L.NEGATIVE).when(F.col("tp"), L.POSITIVE).otherwise(L.NEUTRAL)
    by_label = F.when((F.col("n") >= F.col("p")) & (F.col("n") >= F.col("z")), L.NEGATIVE).when(F.col("p") >= F.col("z"), L.POSITIVE).otherwise(L.NEUTRAL)
    return base.select("cluster_id", F.when(F.col("p") + F.col("n") + F.col("z") == 0, by_text).otherwise(by_label).alias("direction"))


def clusters(members: DataFrame) -> DataFrame:
    """members (cluster_id, article_id, event_type, confidence, entity, publish_time, evidence_sentence): one row per cluster.

    The representative is the most confident member, ties to the smallest id; the company
    that of the first member that has one.
    """
    first = F.min_by(F.struct("article_id", "event_type", "evidence_sentence"), F.struct(-F.col("confidence"), F.col("article_id")))
    named = F.min(F.when(F.coalesce("entity", F.lit("")) != "", F.struct("article_id", "entity")))
    return members.groupBy("cluster_id").agg(first.alias("r"), named["entity"].alias("company"), F.min("publish_time").alias("start_time"), F.max("publish_time").alias("latest_time"), F.array_sort(F.collect_list("article_id")).alias("article_ids"), F.avg("confidence").alias("cluster_confidence")).select("cluster_id", F.coalesce("company", F.lit("")).alias("company"), F.col("r.event_type").alias("event_type"), "start_time", "latest_time", "article_ids", F.col("r.article_id").alias("representative_id"), F.col("r.evidence_sentence").alias("representative_evidence"), "cluster_confidence")


def alerts(members: DataFrame, cluster_rows: DataFrame, now: Column | None = None, order: str | None = None) -> DataFrame:
    """An alert per cluster: credibility, severity, direction, level and its first five sources."""
    sources = members.groupBy("cluster_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("article_id", F.when(F.coalesce("source", F.lit("")) == "", L.UNKNOWN_SOURCE).otherwise(F.col("source")).alias("source"), F.coalesce(F.date_format("publish_time", "yyyy-MM-dd"), F.lit("")).alias("date"), F.when(rules.source_authority("source") >= 0.9, "官方/权威").otherwise("媒体/其他").alias("type")))), 1, 5).alias("evidence_sources"))
    parts = credibility(members, now, order).join(directions(members), "cluster_id").join(sources, "cluster_id")
    joined = cluster_rows.join(parts, "cluster_id").withColumn("severity", rules.severity("event_type"))
    named = joined.withColumn("risk_level", rules.alert_level("credibility", "severity", "direction"))
    who = F.when(F.col("company") == "", "相关公司").otherwise(F.col("company"))
    return named.select(F.concat(F.lit("ALT-"), F.col("cluster_id").cast("string")).alias("alert_id"), "cluster_id", "company", "event_type", "risk_level", F.col("direction").alias("impact_direction"), "credibility", F.bround("credibility", 4).alias("credibility_score"), "severity", "evidence_sources", F.col("n").alias("related_article_count"), F.concat(who, F.lit("发生"), "event_type", F.lit("事件，当前聚合到"), F.col("n").cast("string"), F.lit("篇相关报道。")).alias("event_summary"), F.format_string("可信度=%.2f，影响强度=%.2f，方向=%s，矩阵判定为%s。", "credibility", "severity", "direction", "risk_level").alias("push_reason"))


def claims(alert_rows: DataFrame, lifecycle_rows: DataFrame) -> DataFrame:
    """Three claims per alert that has a lifecycle, each bound to all of its evidence."""
    joined = alert_rows.join(lifecycle_rows.select("cluster_id", "claim_status", F.transform("evidence", lambda r: r["evidence_id"]).alias("evidence_ids")), "cluster_id")
    has = F.size("evidence_ids") > 0
    who = F.when(F.coalesce("company", F.lit("")) == "", "相关主体").otherwise(F.col("company"))
    fact = F.when(F.col("claim_status").isin("supported", "confirmed", "resolved"), "fact").otherwise("unverified")
    one = lambda name, text, kind: F.struct(F.concat(F.lit("CLM-"), F.col("cluster_id").cast("string"), F.lit(f"-{name}")).alias("claim_id"), text.alias("claim_text"), kind.alias("kind"), has.alias("supported"))
    three = F.array(one("event", F.concat(who, F.lit("发生"), "event_type", F.lit("事件")), fact), one("credibility", F.format_string("事件可信度评分为%.4f", "credibility_score"), F.lit("inference")), one("action", F.concat(F.lit("建议处置等级为"), "risk_level"), F.lit("inference")))
    return joined.select("cluster_id", "evidence_ids", F.explode(three).alias("c")).select("cluster_id", "c.*", "evidence_ids")


def stage_gates(lifecycle_rows: DataFrame, cfg: EvidenceGate = DEFAULTS.evidence_gate) -> DataFrame:
    """A gate per snapshot: whether the evidence so far allows its stage."""
    each = lifecycle_rows.select("cluster_id", "evidence", F.explode("snapshots").alias("s")).withColumn("held", F.expr("slice(evidence, 1, s.seq)"))
    supporters = F.size(F.array_distinct(F.transform(F.filter("held", lambda r: r["stance"] == "supports"), lambda r: r["source_key"])))
    has = lambda test: F.exists("held", test)
    ok = (
        F.when(F.col("s.stage") == "corroborated", supporters >= cfg.min_sources)
        .when(F.col("s.stage") == "official_confirmed", has(lambda r: (r["source_type"] == "官方") & (r["stance"] == "supports")))
        .when(F.col("s.stage") == "disputed", has(lambda r: r["stance"] == "supports") & has(lambda r: r["stance"] == "refutes"))
        .when(F.col("s.stage") == "official_clarified", has(lambda r: r["source_type"].isin("官方", "公司") & (r["stance"] == "refutes")))
        .otherwise(F.size("held") > 0)
    )
    return each.select("cluster_id", F.concat(F.lit("GATE-"), F.col("cluster_id").cast("string"), F.lit("-life-"), F.col("s.seq").cast("string")).alias("gate_id"), F.lit("lifecycle_transition").alias("gate_type"), F.col("s.stage").alias("target"), ok.alias("passed"))


def delivery_gates(alert_rows: DataFrame, lifecycle_rows: DataFrame, cfg: EvidenceGate = DEFAULTS.evidence_gate) -> DataFrame:
    """A gate per alert: high levels need official evidence or enough independent sources; no lifecycle or evidence blocks."""
    joined = alert_rows.join(lifecycle_rows.select("cluster_id", "evidence"), "cluster_id", "left")
    sources = F.size(F.array_distinct(F.transform("evidence", lambda r: r["source_key"])))
    official = F.exists("evidence", lambda r: (r["source_type"] == "官方") & (r["authority"] >= cfg.official_authority))
    high = F.col("risk_level").isin(*L.HIGH_RISK_LEVELS)
    reason = F.when(F.col("evidence").isNull(), "no_lifecycle").when(F.size("evidence") == 0, "no_evidence").when(high & ~(official | (sources >= cfg.min_sources)), "needs_official_or_sources").otherwise("passed")
    return joined.select("cluster_id", F.concat(F.lit("GATE-"), F.col("cluster_id").cast("string"), F.lit("-alert")).alias("gate_id"), F.lit("alert_delivery").alias("gate_type"), F.col("risk_level").alias("target"), (reason == "passed").alias("passed"), reason.alias("reason"))


def guarded(alert_rows: DataFrame, gates: DataFrame, claim_rows: DataFrame) -> DataFrame:
    """Alerts with their gate's decision and the share of their claims that evidence supports."""
    coverage = claim_rows.groupBy("cluster_id").agg(F.avg(F.col("supported").cast("int")).alias("coverage"))
    return alert_rows.join(gates.select("cluster_id", F.col("passed").alias("delivery_allowed"), F.col("reason").alias("delivery_reason")), "cluster_id", "left").join(coverage, "cluster_id", "left").withColumn("delivery_allowed", F.coalesce("delivery_allowed", F.lit(False))).withColumn("claim_evidence_coverage", F.bround(F.coalesce("coverage", F.lit(0.0)), 6)).drop("coverage")


def collection_requests(gates: DataFrame) -> DataFrame:
    """The first failed delivery gate of each cluster."""
    return gates.filter((F.col("gate_type") == "alert_delivery") & ~F.col("passed")).groupBy("cluster_id").agg(F.min_by("reason", "gate_id").alias("reason"))


def signals(lifecycle_rows: DataFrame, alert_rows: DataFrame, cfg: Learning = DEFAULTS.learning) -> DataFrame:
    """Clusters worth learning from, with reasons and an additive priority of 1 at most."""
    joined = lifecycle_rows.join(alert_rows.select("cluster_id", "severity"), "cluster_id", "left")
    tests = ((F.col("score") < cfg.low_confidence) & (F.col("n_evidence") >= 2), F.col("claim_status") == "disputed", F.col("claim_status") == "refuted", F.coalesce(F.col("severity") >= cfg.high_severity, F.lit(False)))
    names, points = ("低置信事件", "证据冲突", "官方澄清或事实反转", "高影响事件"), (0.35, 0.45, 0.50, 0.25)
    reasons = F.array_compact(F.array(*(F.when(t, n) for t, n in zip(tests, names))))
    priority = F.least(F.lit(1.0), F.bround(sum((F.when(t, p).otherwise(0.0) for t, p in zip(tests, points)), F.lit(0.0)), 4))
    found = joined.withColumn("reasons", reasons).withColumn("priority", priority).filter(F.size("reasons") > 0)
    return found.select("cluster_id", F.concat(F.lit("LS-"), F.substring(F.sha2(F.concat_ws("|", F.col("cluster_id").cast("string"), F.array_join("reasons", "|"), F.lit("1")), 256), 1, 16)).alias("signal_id"), F.array_join("reasons", "、").alias("reason"), "priority")
