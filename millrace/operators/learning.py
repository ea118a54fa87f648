"""Feedback to skills: diagnosis, distillation, gates, release, registry and application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace import lexicon as L
from millrace.config import DEFAULTS, Learning
from millrace.functions.text import col, trigger_terms
from millrace.session import dimension


def diagnosis(kind) -> Column:
    out = F.lit(L.OTHER_DIAGNOSIS)
    for name, code in L.DIAGNOSES.items():
        out = F.when(col(kind) == name, code).otherwise(out)
    return out


def note_prefix(note, expected, observed) -> Column:
    """What a note says before the marker of the mistake, without the event names; null if not 2 to 20 characters are left."""
    start = F.get(F.split(F.regexp_replace(F.coalesce(col(note), F.lit("")), r"(?U)\s+", ""), "|".join(L.NOTE_MARKERS), 2), 0)
    for name in (expected, observed):
        start = F.when(F.coalesce(col(name), F.lit("")) != "", F.replace(start, col(name), F.lit(""))).otherwise(start)
    text = F.regexp_replace(start, "[^A-Za-z0-9\\u4e00-\\u9fff]", "")
    return F.when(F.length(text).between(2, 20), text)


def note_words(note) -> Column:
    return F.regexp_extract_all(F.coalesce(col(note), F.lit("")), F.lit("[A-Za-z0-9\\u4e00-\\u9fff]{2,12}"), F.lit(0))


def skills(feedback: DataFrame, cfg: Learning = DEFAULTS.learning, most: int = 8) -> DataFrame:
    """feedback (feedback_id, kind, expected_event_type, observed_event_type, note, trigger_terms array) -> candidate skills.

    Groups of one diagnosis and pair of events with enough feedback. Their triggers are
    the given terms; else note prefixes by frequency, length and name; else the notes'
    words. Groups without an expected event or triggers give none.
    """
    nn = lambda c: F.coalesce(F.col(c), F.lit(""))
    key = ["diagnosis", "expected", "observed"]
    rows = feedback.select("feedback_id", diagnosis("kind").alias("diagnosis"), nn("expected_event_type").alias("expected"), nn("observed_event_type").alias("observed"), "note", "trigger_terms")
    rows = rows.withColumn("prefix", note_prefix("note", "expected", "observed")).withColumn("words", note_words("note"))
    prefixes = rows.filter("prefix IS NOT NULL").groupBy(*key, "prefix").agg(F.count(F.lit(1)).alias("n"))
    ranked = prefixes.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.length("prefix")).alias("l"), "prefix"))), lambda s: s["prefix"]).alias("by_note"))
    in_order = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("feedback_id", F.coalesce(c, F.array().cast("array<string>")).alias("t")))), lambda s: s["t"]))
    grouped = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("feedback_id")).alias("source_feedback_ids"), in_order(F.col("trigger_terms")).alias("given"), in_order(F.col("words")).alias("words"))
    joined = grouped.filter((F.col("n") >= cfg.min_feedback) & (F.col("expected") != "")).join(ranked, key, "left")
    stop = F.array(*(F.lit(w) for w in L.NOTE_STOP_WORDS), F.col("expected"), F.col("observed"))
    words = F.array_except(trigger_terms("words"), stop)
    terms = F.when(F.size("given") > 0, trigger_terms("given")).when(F.col("by_note").isNotNull(), F.col("by_note")).otherwise(words)
    found = joined.withColumn("trigger_terms", F.slice(terms, 1, most)).filter(F.size("trigger_terms") > 0)
    digest = F.sha2(F.concat_ws("|", "diagnosis", "expected", "observed", F.array_join("trigger_terms", "|")), 256)
    return found.select(F.concat(F.lit("SK-"), F.substring(digest, 1, 16)).alias("skill_id"), F.concat(F.lit("event-boundary-"), F.substring(digest, 1, 8)).alias("name"), F.col("expected").alias("target_event_type"), F.nullif("observed", F.lit("")).alias("observed_event_type"), "trigger_terms", F.lit("candidate").alias("status"), "source_feedback_ids", F.sha2(F.array_join("source_feedback_ids", "|"), 256).alias("provenance_hash"))


def gate(baseline_f1, candidate_f1, baseline_critical, candidate_critical, cfg: Learning = DEFAULTS.learning) -> Column:
    """passed, no_gain or critical_regression."""
    return F.when(col(candidate_f1) - col(baseline_f1) < cfg.min_f1_gain, "no_gain").when(col(candidate_critical) - col(baseline_critical) > cfg.max_critical_regression, "critical_regression").otherwise("passed")


def release(decision, approved, cfg: Learning = DEFAULTS.learning) -> Column:
    """rejected, shadow (waiting for a person) or active."""
    return F.when(col(decision) != "passed", "rejected").when(F.lit(cfg.human_approval) & ~col(approved), "shadow").otherwise("active")


def flywheel(feedback: DataFrame, baseline: dict, candidate: dict, approved: bool, cfg: Learning = DEFAULTS.learning) -> DataFrame:
    """Both registry rows of every distilled skill: as candidate (seq 1) and as released (seq 2)."""
    found = skills(feedback, cfg)
    decision = gate(F.lit(float(baseline.get("macro_f1", 0))), F.lit(float(candidate.get("macro_f1", 0))), F.lit(float(baseline.get("critical_error_rate", 0))), F.lit(float(candidate.get("critical_error_rate", 0))), cfg)
    first = found.withColumn("reason", F.lit(None).cast("string")).withColumn("seq", F.lit(1).cast("bigint"))
    second = found.withColumn("status", release(decision, F.lit(approved), cfg)).withColumn("reason", decision).withColumn("seq", F.lit(2).cast("bigint"))
    return first.unionByName(second)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key of an append-only table, all columns."""
    own = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(key).agg(F.max_by(own, F.struct(*order)).alias("r")).select("r.*")


def active(registry: DataFrame) -> DataFrame:
    return latest(registry, "skill_id", "seq").filter("status = 'active'").orderBy("skill_id")


def rolled_back(registry: DataFrame, skill_id: str, reason: str) -> DataFrame:
    """The row that takes a skill back, to be appended; a skill that is neither active nor shadow raises."""
    now = latest(registry, "skill_id", "seq").filter(F.col("skill_id") == skill_id)
    held = now.select("status").collect()
    if not held or held[0][0] not in ("active", "shadow"):
        raise ValueError(f"{skill_id} can't be rolled back")
    return now.withColumn("status", F.lit("rolled_back")).withColumn("reason", F.lit(reason)).withColumn("seq", F.col("seq") + 1)


def applied(predictions: DataFrame, skill_rows: DataFrame) -> DataFrame:
    """predictions (article_id, event_type, text) corrected by active skills (skill_id, target, observed, triggers).

    A skill matches if its observed event is the predicted one (or none) and a trigger
    stands in the text. Skills that want different events change nothing but the trace;
    else the smallest id decides. Skills are a dimension and are broadcast.
    """
    s = skill_rows.select("skill_id", "target_event_type", "observed_event_type", "trigger_terms")
    hit = (F.col("observed_event_type").isNull() | (F.col("observed_event_type") == F.col("event_type"))) & F.exists("trigger_terms", lambda t: F.contains(F.col("text"), t))
    found = predictions.join(dimension(s), hit).groupBy("article_id").agg(F.size(F.collect_set("target_event_type")).alias("targets"), F.min(F.struct("skill_id", "target_event_type")).alias("first"))
    joined = predictions.join(found, "article_id", "left")
    change = F.coalesce(F.col("targets") == 1, F.lit(False))
    trace = F.when(change, F.concat(F.lit("skill:"), F.col("first.skill_id"))).when(F.col("targets") > 1, "skills:conflict")
    return joined.select("article_id", F.when(change, F.col("first.target_event_type")).otherwise(F.col("event_type")).alias("event_type"), F.when(change, F.col("first.skill_id")).alias("applied_skill_id"), trace.alias("trace"))


def group_label(rows: DataFrame, group: str, label: str, time: str, key: str) -> DataFrame:
    """The earliest member's label over the whole group; rows without group keep theirs."""
    first = F.first_value(label).over(W.partitionBy(group).orderBy(F.col(time).isNull(), time, key))
    return rows.withColumn("group_label", F.when(F.col(group).isNull(), F.col(label)).otherwise(first))
