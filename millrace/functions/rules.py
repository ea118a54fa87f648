"""Ordered rules as CASE expressions: sources, stances, severity, events, alert levels, runtime decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace import lexicon as L
from millrace.config import DEFAULTS, Runtime
from millrace.functions.text import col, contains_any, evidence_sentence, first_group, polarity


def source_type(source) -> Column:
    """The first kind of source whose word the name holds."""
    return first_group(source, {name: words for _, name, _, words in L.SOURCE_KINDS}, L.UNKNOWN_SOURCE)


def source_authority(source) -> Column:
    out = None
    for _, _, score, words in L.SOURCE_KINDS:
        found = contains_any(source, words)
        out = F.when(found, F.lit(score)) if out is None else out.when(found, F.lit(score))
    return out.otherwise(F.lit(L.UNKNOWN_SCORE))


def source_category(source) -> Column:
    """The kind's key, for profiles; blank sources are 'missing'."""
    return F.when(F.trim(F.coalesce(col(source), F.lit(""))) == "", "missing").otherwise(first_group(source, {key: words for key, _, _, words in L.SOURCE_KINDS}, "other"))


def stance(text) -> Column:
    """refutes before supports, else neutral."""
    return F.when(contains_any(text, L.REFUTE_WORDS), "refutes").when(contains_any(text, L.SUPPORT_WORDS), "supports").otherwise("neutral")


def severity(event_type) -> Column:
    """The score of the first event type that the text names."""
    out = None
    for name, score in L.SEVERITY.items():
        found = F.contains(F.coalesce(col(event_type), F.lit("")), F.lit(name))
        out = F.when(found, F.lit(score)) if out is None else out.when(found, F.lit(score))
    return out.otherwise(F.lit(L.DEFAULT_SEVERITY))


def keyword_event(title, content) -> dict[str, Column]:
    """Columns of a prediction by keywords: event_type, has_event, confidence, polarity, evidence_sentence."""
    text = F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(content), F.lit("")))
    kind = first_group(text, L.EVENT_WORDS, L.NO_EVENT)
    found = kind != L.NO_EVENT
    return {
        "event_type": kind, "has_event": found, "classifier_confidence": F.when(found, 0.62).otherwise(0.35),
        "event_polarity": polarity(F.lit(""), text), "evidence_sentence": evidence_sentence(content, title, kind),
    }


def alert_level(credibility, severity_, direction) -> Column:
    """Ten levels by credibility, severity and direction."""
    c, s, d = col(credibility), col(severity_), col(direction)
    c_high, c_mid = c >= L.HIGH_CREDIBILITY, c >= L.MEDIUM_CREDIBILITY
    s_high, s_mid = s >= L.HIGH_SEVERITY, s >= L.MEDIUM_SEVERITY
    both_high, both_mid = c_high & s_high, c_mid & s_mid
    return (
        F.when((d == L.POSITIVE) & both_high, "高价值机会").when((d == L.POSITIVE) & both_mid, "中价值机会").when(d == L.POSITIVE, "机会观察")
        .when((d == L.NEUTRAL) & both_high, "高关注").when((d == L.NEUTRAL) & both_mid, "中关注").when(d == L.NEUTRAL, "常规披露")
        .when(both_high, "高风险").when(~c_mid & s_high, "待核实重点关注").when(c_high & ~s_mid, "常规披露").when(both_mid, "中风险").otherwise("观察")
    )


def direction_of(positive, negative, neutral, text) -> Column:
    """The most frequent label of a group by its counts (ties: negative, positive, neutral), else by the words of its text."""
    n, p, z = col(negative), col(positive), col(neutral)
    return F.when(n + p + z == 0, polarity(F.lit(""), text)).when((n >= p) & (n >= z), L.NEGATIVE).when(p >= z, L.POSITIVE).otherwise(L.NEUTRAL)


def duplicate_flagged(flag) -> Column:
    return F.coalesce(F.trim(col(flag).cast("string")).isin("1", "true", "True", "是"), F.lit(False))


def credibility_score(authority, sources, official, complete, recency, duplicates) -> Column:
    w = L.CREDIBILITY_WEIGHTS
    total = w["source_authority"] * col(authority) + w["multi_source_consistency"] * col(sources) + w["official_endorsement"] * col(official) + w["content_completeness"] * col(complete) + w["recency_score"] * col(recency) - col(duplicates)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def backoff_seconds(failures, cfg: Runtime = DEFAULTS.runtime) -> Column:
    steps = F.array(*(F.lit(x) for x in cfg.backoff_seconds))
    return F.element_at(steps, F.least(F.greatest(col(failures), F.lit(1)), F.lit(len(cfg.backoff_seconds))).cast("int"))


ACTION = "struct<priority:int,action:string,workers:int,retry_after:int>"


def _action(name: str, priority: int, workers=None, retry=None) -> Column:
    return F.struct(F.lit(priority).alias("priority"), F.lit(name).alias("action"), (F.lit(None) if workers is None else workers).cast("int").alias("workers"), (F.lit(None) if retry is None else retry).cast("int").alias("retry_after"))


def runtime_actions(queue_depth, workers, failures, alive, valid, dependencies, open_requests, cfg: Runtime = DEFAULTS.runtime) -> dict[str, Column]:
    """state, actions (by priority, highest first) and unsafe_continue of a runtime snapshot.

    dependencies is array<struct<name, healthy, required, fallback_available>>. Stop rules
    over all others; scaling up needs a run without failures.
    """
    depth, own, failed, alive, valid, requests = (col(x) for x in (queue_depth, workers, failures, alive, valid, open_requests))
    broken = F.exists(col(dependencies), lambda d: d["required"] & ~d["healthy"] & ~d["fallback_available"])
    replaced = F.exists(col(dependencies), lambda d: ~d["healthy"] & d["fallback_available"])
    stop = broken | (failed >= cfg.stop_after) | ~valid
    retry = backoff_seconds(failed, cfg)
    up = (depth >= cfg.scale_up_depth) & (own < cfg.max_workers) & (failed == 0)
    down = ~up & (depth <= cfg.scale_down_depth) & (own > cfg.min_workers)
    planned = F.array_compact(F.array(
        F.when(~alive, _action("restart", 95, retry=retry)),
        F.when(replaced, _action("fallback", 90)),
        F.when(failed >= cfg.degrade_after, _action("degrade", 85)),
        F.when((failed > 0) & (failed < cfg.degrade_after) & alive, _action("retry", 75, retry=retry)),
        F.when(requests > 0, _action("collect_evidence", 80)),
        F.when(up, _action("scale_up", 60, workers=F.least(F.lit(cfg.max_workers), F.greatest(F.lit(cfg.min_workers), own + 1)))),
        F.when(down, _action("scale_down", 40, workers=F.greatest(F.lit(cfg.min_workers), own - 1))),
    ))
    actions = F.when(stop, F.array(_action("stop", 100))).when(F.size(planned) == 0, F.array(_action("continue", 10))).otherwise(F.sort_array(planned, asc=False))
    shaky = F.exists(planned, lambda a: a["action"].isin("degrade", "fallback", "restart"))
    state = F.when(stop, "stopped").when(shaky, "degraded").otherwise("healthy")
    unsafe = F.exists(actions, lambda a: a["action"] == "continue") & (~alive | broken | ~valid)
    return {"state": state, "actions": actions, "unsafe_continue": unsafe}
