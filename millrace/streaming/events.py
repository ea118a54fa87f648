"""Structured Streaming over event-like sources: windows, deduplication, lifecycles and ledgers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.config import DEFAULTS, Lifecycle

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet", delay: str = "1 hour", files: int = 1) -> DataFrame:
    """A folder of event files as a stream with a watermark on its time."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def window_counts(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Events and their summed value by type in tumbling or sliding windows."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Events of a user until a gap."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def distinct_events(events: DataFrame, *key: str) -> DataFrame:
    """The first event of each key as long as the watermark allows to remember it."""
    return events.dropDuplicatesWithinWatermark(list(key))


STATE = "score double, sources string, supports long, supporters string, refutes long, official long, last timestamp"
OUT = "cluster_id long, article_id string, seq long, stage string, claim_status string, score double, late boolean"


def step(state: tuple, row: dict, cfg: Lifecycle = DEFAULTS.lifecycle) -> tuple[tuple, tuple]:
    """One piece of evidence: (next state, (stage, claim status, score)).

    State: score, sources seen, supports, supporting sources, refutations, official supports.
    The rules are those of the batch fold.
    """
    from millrace import lexicon as L

    score, sources, supports, supporters, refutes, official = state
    supports_it, refutes_it, kind, key, authority = row["stance"] == "supports", row["stance"] == "refutes", row["source_type"], row["source_key"], row["authority"]
    new = key not in sources
    sources = sources | {key}
    if supports_it:
        supports, supporters, official = supports + 1, supporters | {key}, official + (kind == "官方")
    refutes += refutes_it
    summary = row["summary"] or ""
    says = lambda words: any(w in summary for w in words)
    if refutes_it and authority >= cfg.company_authority and kind in ("公司", "官方"):
        stage, status = "official_clarified", "refuted"
    elif supports_it and authority >= cfg.official_authority and kind == "官方":
        stage, status = "official_confirmed", "confirmed"
    elif supports and refutes:
        stage, status = "disputed", "disputed"
    elif says(L.RESOLUTION_WORDS):
        stage, status = "resolved", "resolved"
    elif says(L.ESCALATION_WORDS) and supports:
        stage, status = "impact_escalated", "confirmed" if official else "supported"
    elif kind == "公司":
        stage, status = "company_responded", "supported" if supports_it else "unverified"
    elif len(supporters) >= cfg.corroborated_sources:
        stage, status = "corroborated", "supported"
    else:
        stage, status = "media_reported", "unverified"
    gain, bonus = cfg.evidence_gain * authority, cfg.new_source_bonus if new else 0.0
    if supports_it:
        score = score + gain + bonus + (cfg.official_bonus if stage == "official_confirmed" else 0.0)
    elif refutes_it:
        score = max(score, authority * 0.7 + cfg.clarification_bonus) if stage == "official_clarified" else score * cfg.dispute_factor
    else:
        score = score + gain * 0.35 + bonus * 0.35
    score = round(min(1.0, max(0.0, score)), 4)
    return (score, sources, supports, supporters, refutes, official), (stage, status, score)


def lifecycle_stream(evidence: DataFrame, timeout_ms: int = 0) -> DataFrame:
    """evidence (cluster_id, article_id, ts, source_type, source_key, stance, authority, summary) -> a row per piece with the lifecycle after it.

    The state of a cluster is a few numbers and its source names. Rows that are older than
    what the cluster has already seen can't be sorted in any more: they are folded as they
    come and marked late, for a batch replay of the ledger.
    """

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            score, sources, supports, supporters, refutes, official, last = state.get
            held, seq = (score, set(json.loads(sources)["s"]), supports, set(json.loads(supporters)), refutes, official), json.loads(sources)["n"]
        else:
            held, last, seq = (0.0, set(), 0, set(), 0, 0), None, 0
        rows = pd.concat(list(parts)).sort_values(["ts", "article_id"], na_position="last")
        out = []
        for row in rows.to_dict("records"):
            late = last is not None and not pd.isna(row["ts"]) and row["ts"] < last
            held, (stage, status, score) = step(held, row)
            seq += 1
            last = row["ts"] if not pd.isna(row["ts"]) and (last is None or row["ts"] > last) else last
            out.append((key[0], row["article_id"], seq, stage, status, score, late))
        state.update((held[0], json.dumps({"s": sorted(held[1]), "n": seq}), held[2], json.dumps(sorted(held[3])), held[4], held[5], None if last is None else pd.Timestamp(last).to_pydatetime()))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    columns = ["cluster_id", "article_id", "ts", "source_type", "source_key", "stance", "authority", "summary"]
    return evidence.select(*columns).groupBy("cluster_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def to_ledger(stream: DataFrame, ledger: str, checkpoint: str):
    """A query that appends each micro-batch to a ledger once: a batch that is repeated after a failure overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("ledger_recorded_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_memory(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append"):
    """A query that runs over what is there and ends; its rows are the table `name`. For tests."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    return (q if checkpoint is None else q.option("checkpointLocation", checkpoint)).start()
