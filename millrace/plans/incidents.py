"""Queries over lifecycles, alerts, gates, learning and vectors (inventory 2.10, 2.11, 2.13), with their SQL.

Their rows are news grouped by user: a cluster is what one user's events report.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace import lexicon as L
from millrace.config import DEFAULTS
from millrace.functions import rules
from millrace.operators import learning, lifecycle, vectors
from millrace.plans.bindings import NEWS_SQL, SCORES_SQL, news, scores
from millrace.plans.ranking import scaled, scaled_sql
from millrace.plans.texts import any_sql, source_sql
from millrace.session import cut, table

#: Pieces of evidence of a user are those of one week in these queries.
WEEK = 7


def _members(spark, sf_dir):
    n = news(spark, sf_dir)
    week = F.coalesce(F.ceil(F.dayofyear("publish_time") / WEEK).cast("bigint"), F.lit(0).cast("bigint"))
    return n.withColumn("cluster_id", F.col("user_id") * 100 + week).withColumn("evidence_sentence", F.when(F.col("id") % 11 < 4, F.col("content")).otherwise(F.lit("")))


MEMBERS = f"""{NEWS_SQL}, members AS (SELECT *, user_id * 100 + coalesce(ceil(dayofyear(publish_time) / {WEEK})::BIGINT, 0) AS cluster_id, CASE WHEN id % 11 < 4 THEN content ELSE '' END AS evidence_sentence FROM news)"""


def evidence_rows(spark, sf_dir):
    """50, 184: the evidence that every news article is."""
    return lifecycle.evidence(_members(spark, sf_dir)).select("cluster_id", "evidence_id", "article_id", "source", "source_type", "source_key", "stance", "authority", "summary")


_TEXT = "trim(title || ' ' || content || ' ' || evidence_sentence)"
EVIDENCE_SQL = f"""ev AS (SELECT cluster_id, 'EVD-' || substr(sha256(source || '|' || title || '|' || content), 1, 16) AS evidence_id, article_id, CASE WHEN source = '' THEN '{L.UNKNOWN_SOURCE}' ELSE source END AS source,
  {source_sql('members.source', lambda k, n, s: f"'{n}'")} ELSE '{L.UNKNOWN_SOURCE}' END AS source_type,
  CASE WHEN source <> '' THEN replace(lower(source), ' ', '') ELSE 'unknown-' || substr(sha256(source || '|' || title || '|' || content), 1, 12) END AS source_key,
  CASE WHEN {any_sql(_TEXT, L.REFUTE_WORDS)} THEN 'refutes' WHEN {any_sql(_TEXT, L.SUPPORT_WORDS)} THEN 'supports' ELSE 'neutral' END AS stance,
  ({source_sql('members.source', lambda k, n, s: str(s))} ELSE {L.UNKNOWN_SCORE} END)::DOUBLE AS authority, publish_time AS ts, CASE WHEN evidence_sentence <> '' THEN evidence_sentence ELSE title END AS summary FROM members)"""
EVIDENCE_ROWS = f"WITH {MEMBERS}, {EVIDENCE_SQL} SELECT * EXCLUDE (ts) FROM ev"

_CFG = DEFAULTS.lifecycle
STAGES_SQL = f"""o AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ts IS NULL, ts, article_id) AS seq, row_number() OVER (PARTITION BY cluster_id, source_key ORDER BY ts IS NULL, ts, article_id) = 1 AS fresh FROM ev),
f AS (SELECT *, stance = 'supports' AND seq = min(CASE WHEN stance = 'supports' THEN seq END) OVER (PARTITION BY cluster_id, source_key) AS first_support FROM o),
run AS (SELECT *, count(*) FILTER (stance = 'supports') OVER w AS ns, count(*) FILTER (stance = 'refutes') OVER w AS nr, count(*) FILTER (first_support) OVER w AS nd, count(*) FILTER (stance = 'supports' AND source_type = '官方') OVER w AS nof FROM f WINDOW w AS (PARTITION BY cluster_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
st AS (SELECT *, CASE WHEN stance = 'refutes' AND authority >= {_CFG.company_authority} AND source_type IN ('公司', '官方') THEN 'official_clarified' WHEN stance = 'supports' AND authority >= {_CFG.official_authority} AND source_type = '官方' THEN 'official_confirmed'
  WHEN ns > 0 AND nr > 0 THEN 'disputed' WHEN {any_sql('summary', L.RESOLUTION_WORDS)} THEN 'resolved' WHEN {any_sql('summary', L.ESCALATION_WORDS)} AND ns > 0 THEN 'impact_escalated'
  WHEN source_type = '公司' THEN 'company_responded' WHEN nd >= 2 THEN 'corroborated' ELSE 'media_reported' END AS stage FROM run),
cs AS (SELECT *, CASE stage WHEN 'official_clarified' THEN 'refuted' WHEN 'official_confirmed' THEN 'confirmed' WHEN 'disputed' THEN 'disputed' WHEN 'resolved' THEN 'resolved' WHEN 'impact_escalated' THEN CASE WHEN nof > 0 THEN 'confirmed' ELSE 'supported' END
  WHEN 'company_responded' THEN CASE WHEN stance = 'supports' THEN 'supported' ELSE 'unverified' END WHEN 'corroborated' THEN 'supported' ELSE 'unverified' END AS claim_status FROM st)"""


def evidence_stages(spark, sf_dir):
    """185: the stage and claim status after every piece of evidence."""
    return lifecycle.stages(lifecycle.evidence(_members(spark, sf_dir))).select("cluster_id", "article_id", F.col("seq").cast("bigint").alias("seq"), "stage", "claim_status", "new_source")


EVIDENCE_STAGES = f"WITH {MEMBERS}, {EVIDENCE_SQL}, {STAGES_SQL} SELECT cluster_id, article_id, seq, stage, claim_status, fresh AS new_source FROM cs"

def event_lifecycles(spark, sf_dir):
    """182, 183, 186: the folded lifecycle of every cluster (its score rounds at every step, so it is tested against a plain fold)."""
    return lifecycle.lifecycles(lifecycle.evidence(_members(spark, sf_dir))).select("cluster_id", "n_evidence", "stage", "claim_status", "score")


def lifecycle_ends(spark, sf_dir):
    """183: the last stage of every cluster, its evidence and sources."""
    rows = lifecycle.lifecycles(lifecycle.evidence(_members(spark, sf_dir)))
    return rows.select("cluster_id", "n_evidence", "stage", "claim_status", F.size(F.array_distinct(F.transform("evidence", lambda r: r["source_key"]))).cast("bigint").alias("sources"))


LIFECYCLE_ENDS = f"WITH {MEMBERS}, {EVIDENCE_SQL}, {STAGES_SQL} SELECT cluster_id, count(*) AS n_evidence, arg_max(stage, seq) AS stage, arg_max(claim_status, seq) AS claim_status, count(DISTINCT source_key) AS sources FROM cs GROUP BY 1"


def _predicted(spark, sf_dir):
    m = _members(spark, sf_dir).drop("event_type")
    found = rules.keyword_event("title", "content")
    return m.withColumn("event_type", found["event_type"]).withColumn("confidence", (F.col("id") % 50) / 50)


def event_clusters(spark, sf_dir):
    """104: one row per cluster: representative, company, times and members."""
    c = lifecycle.clusters(_predicted(spark, sf_dir))
    return c.select("cluster_id", "company", "event_type", F.col("start_time").cast("string").alias("start_time"), F.size("article_ids").cast("bigint").alias("articles"), "representative_id")


_EVENT_TYPE = "CASE " + " ".join(f"WHEN {any_sql('hay', words)} THEN '{k}'" for k, words in L.EVENT_WORDS.items()) + f" ELSE '{L.NO_EVENT}' END"
PREDICTED = f"{MEMBERS}, predicted AS (SELECT *, {_EVENT_TYPE} AS kind, (id % 50) / 50 AS confidence FROM (SELECT *, title || ' ' || content AS hay FROM members))"
EVENT_CLUSTERS = f"""WITH {PREDICTED}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, article_id) AS k FROM predicted)
SELECT cluster_id, coalesce(arg_min(entity, article_id) FILTER (entity <> ''), '') AS company, max(kind) FILTER (k = 1) AS event_type, strftime(min(publish_time), '%Y-%m-%d %H:%M:%S') || CASE WHEN min(publish_time) IS NULL THEN '' ELSE rtrim(rtrim('.' || lpad((epoch_us(min(publish_time)) % 1000000)::VARCHAR, 6, '0'), '0'), '.') END AS start_time, count(*) AS articles, max(article_id) FILTER (k = 1) AS representative_id FROM r GROUP BY 1"""


def cluster_credibility(spark, sf_dir):
    """48, 105-110: the parts and sum of every cluster's credibility, and its direction."""
    m = _members(spark, sf_dir)
    d = lifecycle.directions(m).withColumnRenamed("cluster_id", "directed")
    c = lifecycle.credibility(m, order="id").join(d, F.col("cluster_id").eqNullSafe(F.col("directed")))  # events without user are a cluster, as in the SQL
    return c.select("cluster_id", "n", scaled("source_authority").alias("authority"), scaled("multi_source_consistency").alias("sources"), "official_endorsement", scaled("content_completeness").alias("complete"), scaled("duplicate_penalty").alias("duplicates"), "recency_score", scaled("credibility").alias("credibility"), "direction")


_AUTH = f"({source_sql('source', lambda k, n, s: str(s))} ELSE {L.UNKNOWN_SCORE} END)::DOUBLE"
CREDIBILITY_SQL = f"""cr AS (SELECT cluster_id, count(*) AS n, avg({_AUTH}) AS a, least(1.0, count(DISTINCT nullif(source, '')) / 3) AS m, CASE WHEN max({_AUTH}) >= 0.9 THEN 1.0 ELSE 0.0 END::DOUBLE AS o,
  avg((1 + CASE WHEN publish_time IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN source <> '' THEN 1 ELSE 0 END + 1 + CASE WHEN entity <> '' THEN 1 ELSE 0 END) / 5) AS c, least(0.2, avg(CASE WHEN duplicate_flag = '1' THEN 1 ELSE 0 END) * 0.1) AS d, CASE WHEN max(publish_time) IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS r,
  count(*) FILTER (polarity_label = '正面') AS p, count(*) FILTER (polarity_label = '负面') AS ng, count(*) FILTER (polarity_label = '中性') AS z, bool_or({any_sql("title || ' ' || content", L.NEGATIVE_WORDS)}) AS tn, bool_or({any_sql("title || ' ' || content", L.POSITIVE_WORDS)}) AS tp FROM members GROUP BY 1),
cd AS (SELECT *, least(1.0, greatest(0.0, 0.3 * a + 0.25 * m + 0.25 * o + 0.1 * c + 0.1 * r - d)) AS credibility, CASE WHEN p + ng + z = 0 THEN CASE WHEN tn THEN '负面' WHEN tp THEN '正面' ELSE '中性' END WHEN ng >= p AND ng >= z THEN '负面' WHEN p >= z THEN '正面' ELSE '中性' END AS direction FROM cr)"""
CLUSTER_CREDIBILITY = f"WITH {MEMBERS}, {CREDIBILITY_SQL} SELECT cluster_id, n, {scaled_sql('a')} AS authority, {scaled_sql('m')} AS sources, o AS official_endorsement, {scaled_sql('c')} AS complete, {scaled_sql('d')} AS duplicates, r AS recency_score, {scaled_sql('credibility')} AS credibility, direction FROM cd"


def incident_alerts(spark, sf_dir):
    """188, 189: the alert of every cluster. The flagship: whose incidents are corroborated and severe, and how credible they are."""
    p = _predicted(spark, sf_dir)
    return lifecycle.alerts(p, lifecycle.clusters(p), order="id").select("cluster_id", "company", "event_type", "risk_level", "impact_direction", scaled("credibility").alias("credibility"), "severity", "related_article_count")


ALERTS_SQL = f"""rep AS (SELECT cluster_id, max(kind) FILTER (k = 1) AS event_type, coalesce(arg_min(entity, article_id) FILTER (entity <> ''), '') AS company FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, article_id) AS k FROM predicted) GROUP BY 1),
sv AS (SELECT *, (CASE {' '.join(f"WHEN contains(event_type, '{k}') THEN {v}" for k, v in L.SEVERITY.items())} ELSE {L.DEFAULT_SEVERITY} END)::DOUBLE AS severity FROM rep),
al AS (SELECT *, CASE WHEN direction = '正面' THEN CASE WHEN ch AND sh THEN '高价值机会' WHEN cm AND sm THEN '中价值机会' ELSE '机会观察' END WHEN direction = '中性' THEN CASE WHEN ch AND sh THEN '高关注' WHEN cm AND sm THEN '中关注' ELSE '常规披露' END
  WHEN ch AND sh THEN '高风险' WHEN NOT cm AND sh THEN '待核实重点关注' WHEN ch AND NOT sm THEN '常规披露' WHEN cm AND sm THEN '中风险' ELSE '观察' END AS risk_level
  FROM (SELECT *, credibility >= 0.75 AS ch, credibility >= 0.45 AS cm, severity >= 0.65 AS sh, severity >= 0.35 AS sm FROM cd JOIN sv USING (cluster_id)))"""
INCIDENT_ALERTS = f"WITH {PREDICTED}, {CREDIBILITY_SQL}, {ALERTS_SQL} SELECT cluster_id, company, event_type, risk_level, direction AS impact_direction, {scaled_sql('credibility')} AS credibility, severity, n AS related_article_count FROM al"


def _guarded(spark, sf_dir):
    p = cut(_predicted(spark, sf_dir))
    alerts = cut(lifecycle.alerts(p, lifecycle.clusters(p)))
    lives = cut(lifecycle.lifecycles(lifecycle.evidence(p)).filter("cluster_id % 13 <> 0"))
    return alerts, lives


def alert_gates(spark, sf_dir):
    """193, 194, 202: which alerts may be delivered, with their claims' coverage."""
    alerts, lives = _guarded(spark, sf_dir)
    gates, claims = lifecycle.delivery_gates(alerts, lives), lifecycle.claims(alerts, lives)
    return lifecycle.guarded(alerts, gates, claims).select("cluster_id", "risk_level", "delivery_allowed", "delivery_reason", F.col("claim_evidence_coverage").cast("bigint").alias("coverage"))


ALERT_GATES = f"""WITH {PREDICTED}, {CREDIBILITY_SQL}, {ALERTS_SQL}, {EVIDENCE_SQL}, g AS (SELECT cluster_id, count(DISTINCT source_key) AS s, bool_or(source_type = '官方' AND authority >= 0.95) AS has_official FROM ev WHERE cluster_id % 13 <> 0 GROUP BY 1),
r AS (SELECT al.cluster_id, risk_level, CASE WHEN g.cluster_id IS NULL THEN 'no_lifecycle' WHEN risk_level IN ('{"', '".join(L.HIGH_RISK_LEVELS)}') AND NOT (has_official OR s >= 2) THEN 'needs_official_or_sources' ELSE 'passed' END AS reason FROM al LEFT JOIN g USING (cluster_id))
SELECT cluster_id, risk_level, reason = 'passed' AS delivery_allowed, reason AS delivery_reason, CASE WHEN reason = 'no_lifecycle' THEN 0 ELSE 1 END::BIGINT AS coverage FROM r"""


def claim_bindings(spark, sf_dir):
    """190: claims of alerts by kind (their texts hold scores, so counts are compared)."""
    alerts, lives = _guarded(spark, sf_dir)
    return lifecycle.claims(alerts, lives).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("supported").alias("supported"))


CLAIM_BINDINGS = f"""WITH {MEMBERS}, {EVIDENCE_SQL}, {STAGES_SQL}, e AS (SELECT cluster_id, arg_max(claim_status, seq) AS s FROM cs WHERE cluster_id % 13 <> 0 GROUP BY 1), k AS (SELECT unnest([CASE WHEN s IN ('supported', 'confirmed', 'resolved') THEN 'fact' ELSE 'unverified' END, 'inference', 'inference']) AS kind FROM e)
SELECT kind, count(*) AS n, count(*) AS supported FROM k GROUP BY 1"""


def transition_gates(spark, sf_dir):
    """191, 192: whether the evidence so far allowed each stage."""
    _, lives = _guarded(spark, sf_dir)
    return lifecycle.stage_gates(lives).groupBy("target", "passed").agg(F.count(F.lit(1)).alias("n"))


TRANSITION_GATES = f"WITH {MEMBERS}, {EVIDENCE_SQL}, {STAGES_SQL} SELECT stage AS target, CASE stage WHEN 'corroborated' THEN nd >= 2 ELSE true END AS passed, count(*) AS n FROM cs WHERE cluster_id % 13 <> 0 GROUP BY ALL"


def learning_signals(spark, sf_dir):
    """203: clusters worth learning from (their priority depends on folded scores; reasons that don't are compared)."""
    alerts, lives = _guarded(spark, sf_dir)
    return lifecycle.signals(lives.withColumn("score", F.lit(1.0)), alerts).select("cluster_id", "reason", scaled("priority", 4).alias("priority"))


LEARNING_SIGNALS = f"""WITH {PREDICTED}, {CREDIBILITY_SQL}, {ALERTS_SQL}, {EVIDENCE_SQL}, {STAGES_SQL}, e AS (SELECT cluster_id, arg_max(claim_status, seq) AS s FROM cs WHERE cluster_id % 13 <> 0 GROUP BY 1),
r AS (SELECT cluster_id, s, severity >= 0.65 AS h FROM e JOIN al USING (cluster_id)),
t AS (SELECT cluster_id, concat_ws('、', CASE WHEN s = 'disputed' THEN '证据冲突' END, CASE WHEN s = 'refuted' THEN '官方澄清或事实反转' END, CASE WHEN h THEN '高影响事件' END) AS reason, {scaled_sql("(CASE s WHEN 'disputed' THEN 0.45 WHEN 'refuted' THEN 0.5 ELSE 0 END + CASE WHEN h THEN 0.25 ELSE 0 END)::DOUBLE", 4)} AS priority FROM r)
SELECT * FROM t WHERE reason <> ''"""


def _feedback(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    i = F.col("conv_id")
    kind = F.element_at(F.array(*(F.lit(k) for k in (*L.DIAGNOSES, "other"))), ((i + F.col("turn")) % 6 + 1).cast("int"))
    note = F.concat(F.lit("关于 "), F.element_at(F.array(F.lit("订单"), F.lit("增资"), F.lit("合并案")), (i % 3 + 1).cast("int")), F.lit("被误判为其他"))
    return c.select(F.concat(F.lit("F"), i.cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("feedback_id"), kind.alias("kind"), F.element_at(F.array(F.lit("甲类"), F.lit("乙类"), F.lit("")), (i % 3 + 1).cast("int")).alias("expected_event_type"), F.col("role").alias("observed_event_type"), note.alias("note"), F.when(i % 3 == 1, F.array(F.lit(" 触发词 "), F.lit("x"))).alias("trigger_terms"))


def distilled_skills(spark, sf_dir):
    """204-209: skills distilled from feedback on conversations, as candidates and released."""
    out = learning.flywheel(_feedback(spark, sf_dir), {"macro_f1": 0.7}, {"macro_f1": 0.75}, False)
    return out.select("skill_id", "target_event_type", "observed_event_type", F.array_join("trigger_terms", "|").alias("triggers"), "status", "provenance_hash", "seq")


DISTILLED_SKILLS = f"""WITH f AS (SELECT 'F' || conv_id || '-' || turn AS id, coalesce((['{"', '".join(L.DIAGNOSES.values())}'])[(conv_id + turn) % 6 + 1], '{L.OTHER_DIAGNOSIS}') AS d, (['甲类', '乙类', ''])[conv_id % 3 + 1] AS e, role AS o, CASE conv_id % 3 WHEN 0 THEN '关于订单' WHEN 1 THEN '触发词' ELSE '' END AS t FROM conversations),
g AS (SELECT d, e, o, any_value(t) AS t, list(id ORDER BY id) AS ids FROM f WHERE e <> '' GROUP BY d, e, o HAVING count(*) >= 3)
SELECT 'SK-' || substr(sha256(concat_ws('|', d, e, o, t)), 1, 16) AS skill_id, e AS target_event_type, o AS observed_event_type, t AS triggers, s AS status, sha256(array_to_string(ids, '|')) AS provenance_hash, q AS seq FROM g, (VALUES ('candidate', 1::BIGINT), ('shadow', 2::BIGINT)) v(s, q)"""


def skill_corrections(spark, sf_dir):
    """210, 212: news corrected by active skills; skills that disagree change nothing."""
    n = news(spark, sf_dir).select("article_id", "event_type", F.concat_ws(" ", "title", "content").alias("text"))
    rows = [("S1", "n", "监管", "error", ["处罚"], "active", 1), ("S2", "n", "业绩", None, ["增长", "结案"], "active", 1), ("S3", "n", "旧", None, ["订单"], "active", 1), ("S3", "n", "旧", None, ["订单"], "rolled_back", 2)]
    s = spark.createDataFrame(rows, "skill_id string, name string, target_event_type string, observed_event_type string, trigger_terms array<string>, status string, seq long")
    return learning.applied(n, learning.active(s)).select("article_id", "event_type", "applied_skill_id", "trace")


SKILL_CORRECTIONS = f"""WITH {NEWS_SQL}, x AS (SELECT article_id, event_type, event_type = 'error' AND contains(content, '处罚') AS a, contains(content, '增长') OR contains(content, '结案') AS b FROM news)
SELECT article_id, CASE WHEN a AND b THEN event_type WHEN a THEN '监管' WHEN b THEN '业绩' ELSE event_type END AS event_type, CASE WHEN a AND b THEN NULL WHEN a THEN 'S1' WHEN b THEN 'S2' END AS applied_skill_id, CASE WHEN a AND b THEN 'skills:conflict' WHEN a THEN 'skill:S1' WHEN b THEN 'skill:S2' END AS trace FROM x"""


def propagated_labels(spark, sf_dir):
    """215: the earliest order's priority over all orders of a customer and status."""
    o = table(spark, sf_dir, "orders").withColumn("g", F.when(F.col("o_orderkey") % 3 != 0, F.concat("o_custkey", F.lit("-"), "o_orderstatus")))
    return learning.group_label(o, "g", "o_orderpriority", "o_orderdate", "o_orderkey").select("o_orderkey", "group_label")


PROPAGATED_LABELS = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE first_value(o_orderpriority) OVER (PARTITION BY CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey || '-' || o_orderstatus END ORDER BY o_orderdate, o_orderkey) END AS group_label FROM orders"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def centroid_routes(spark, sf_dir):
    """80, 229, 234, 240: vectors routed to the centroids of labels: accepted subject, method and the three best."""
    v = _vectors(spark, sf_dir)
    subjects = vectors.centroids(v, "label", "embedding").select(F.col("label").cast("string").alias("code"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("name"), F.col("centroid").alias("embedding"))
    a = v.select(F.col("vec_id").alias("article_id"), "embedding")
    hits = v.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("article_id"), F.when(F.col("vec_id") % 2 == 0, F.array(F.lit("3"))).otherwise(F.array(F.lit("1"), F.lit("2"))).alias("hits"))
    r = vectors.route(a, subjects, hits)
    return r.select("article_id", "accepted", "method", "reason", F.array_join(F.transform("candidates", lambda c: c["subject_code"]), ",").alias("best"))


CENTROID_ROUTES = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) r(i) GROUP BY ALL) GROUP BY label),
s AS (SELECT vec_id, c.label::VARCHAR AS code, list_cosine_similarity(v, c.c) AS s FROM e, c), t AS (SELECT vec_id, list(code ORDER BY s DESC, code) AS b, list(s ORDER BY s DESC, code) AS s FROM s GROUP BY 1),
h AS (SELECT *, CASE WHEN vec_id % 7 <> 0 THEN 0 WHEN vec_id % 2 = 0 THEN 1 ELSE 2 END AS n, s[1] >= 0.426251 AND s[1] - s[2] >= 0.035125 AS g FROM t)
SELECT vec_id AS article_id, CASE WHEN n = 1 THEN '3' WHEN n = 0 AND g THEN b[1] END AS accepted, CASE WHEN n = 1 THEN 'exact_alias' WHEN n = 0 AND g THEN 'vector_high_confidence' ELSE 'candidate_only' END AS method,
  CASE WHEN n = 1 THEN 'unique_exact_alias' WHEN n = 0 AND g THEN 'score_and_margin_gate_met' WHEN n > 1 THEN 'ambiguous_exact_alias' ELSE 'hard_route_gate_not_met' END AS reason, array_to_string(b[:3], ',') AS best FROM h"""


def _first_of_labels(v, n):
    """The n vectors of each label with the smallest ids; Spark cuts to n a label in front of the shuffle."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    return v.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def constrained_recall(spark, sf_dir):
    """90, 230, 236: the best definitions among those of each vector's subjects; the first six vectors of each label are definitions."""
    v = _vectors(spark, sf_dir)
    definitions = _first_of_labels(v, 6).select(F.col("label").cast("string").alias("subject_code"), F.concat(F.lit("e"), F.lpad(F.col("vec_id").cast("string"), 3, "0")).alias("event_name"), "embedding")
    a = v.select(F.col("vec_id").alias("article_id"), "embedding", F.array(F.col("label").cast("string"), ((F.col("label") + 1) % 10).cast("string")).alias("codes"))
    return vectors.recall(a, definitions).select("article_id", F.col("candidate_count").cast("bigint").alias("candidate_count"), F.array_join(F.transform("candidates", lambda c: c["event_name"]), ",").alias("best"))


CONSTRAINED_RECALL = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), p AS (SELECT a.vec_id AS article_id, 'e' || lpad(d.vec_id::VARCHAR, 3, '0') AS n, round_even(list_cosine_similarity(a.v, d.v), 6) AS s FROM e a JOIN e d ON d.k <= 6 AND d.label IN (a.label, (a.label + 1) % 10))
SELECT article_id, count(*) AS candidate_count, array_to_string(list(n ORDER BY s DESC, n)[:3], ',') AS best FROM p GROUP BY 1"""


def exemplar_labels(spark, sf_dir):
    """237, 257: the label whose three nearest exemplars are closest on average, of every vector but the exemplars, the first ten of each label."""
    v = _vectors(spark, sf_dir)
    s = vectors.exemplar_scores(e := _first_of_labels(v, 10), v.join(F.broadcast(e.select("vec_id")), "vec_id", "left_anti"), "label", "embedding", "vec_id", 3)
    return vectors.group_best(s.withColumnRenamed("vec_id", "row").withColumn("place", F.col("label"))).select("row", "label")


EXEMPLAR_LABELS = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings), p AS (SELECT q.vec_id AS row, t.label, list_cosine_similarity(q.v, t.v) AS c FROM e q, e t WHERE q.n > 10 AND t.n <= 10),
k AS (SELECT *, row_number() OVER (PARTITION BY row, label ORDER BY c DESC) AS k FROM p), a AS (SELECT row, label, avg(c) AS s FROM k WHERE k <= 3 GROUP BY ALL)
SELECT row, arg_max(label, s) AS label FROM a GROUP BY 1"""


def prototype_labels(spark, sf_dir):
    """238, 239: the label of the best Rocchio prototype of every vector."""
    v = _vectors(spark, sf_dir)
    p = vectors.rocchio(v, "label", "embedding", 0.25).select(F.col("label").alias("proto"), "prototype")
    s = vectors.dot_scores(v.select("vec_id", "embedding"), p, "embedding")
    return s.groupBy("vec_id").agg(F.max_by("proto", "score").alias("label"))


PROTOTYPE_LABELS = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT label, i, sum(v[i]) AS s, count(*) AS n FROM e, range(1, 65) r(i) GROUP BY ALL),
m AS (SELECT label, i, s / n - 0.25 * (sum(s) OVER (PARTITION BY i) - s) / (sum(n) OVER (PARTITION BY i) - n) AS m FROM s), p AS (SELECT label, list(m ORDER BY i) AS p FROM m GROUP BY 1), u AS (SELECT label, list_transform(p, lambda x: x / sqrt(list_dot_product(p, p))) AS p FROM p)
SELECT vec_id, arg_max(u.label, list_dot_product(v, p)) AS label FROM e, u GROUP BY 1"""


def hard_negative_labels(spark, sf_dir):
    """233, 241: the labels most easily taken for each label, by confusion and likeness."""
    v = _vectors(spark, sf_dir)
    confusion = v.groupBy(F.col("label").alias("truth"), (F.col("vec_id") % 10).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n")).filter("truth <> predicted")
    similarity = vectors.class_similarity(vectors.centroids(v, "label", "embedding"), "label", "centroid")
    return vectors.hard_negatives(confusion, similarity, 3).select("a", "b", F.col("place").cast("bigint").alias("place"))


HARD_NEGATIVE_LABELS = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) r(i) GROUP BY ALL) GROUP BY label),
f AS (SELECT label AS a, (vec_id % 10)::INT AS b, count(*) AS n FROM e WHERE label <> vec_id % 10 GROUP BY ALL), r AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS r FROM f),
s AS (SELECT x.label AS a, y.label AS b, 0.65 * coalesce(r, 0) + 0.35 * list_cosine_similarity(x.c, y.c) AS s FROM c x JOIN c y ON x.label <> y.label LEFT JOIN r ON r.a = x.label AND r.b = y.label)
SELECT a, b, place FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS place FROM s) WHERE place <= 3"""


def constrained_labels(spark, sf_dir):
    """195-198: the best allowed line of every order, guarded by a baseline."""
    s = scores(spark, sf_dir)
    allowed = s.groupBy("row").agg(F.array(F.lit(2).cast("bigint"), (F.col("row") % 7 + 1)).alias("labels")).filter("row % 3 <> 0")
    best = vectors.allowed_best(s, allowed)
    ranked = s.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "label"))), lambda x: x["label"]).alias("candidates"))
    guard = vectors.guarded(ranked.withColumn("baseline", F.col("row") % 7 + 1), 2).select("row", F.col("label").alias("guarded"))
    return best.join(guard, "row")


CONSTRAINED_LABELS = f"""WITH {SCORES_SQL}, o AS (SELECT *, row % 3 <> 0 AND label IN (2, row % 7 + 1) AS ok FROM scores), r AS (SELECT row, list(label ORDER BY score DESC, label) AS l, list(label ORDER BY score DESC, label) FILTER (ok) AS f FROM o GROUP BY row)
SELECT row, coalesce(f[1], l[1]) AS label, CASE WHEN list_contains(l[:2], row % 7 + 1) THEN row % 7 + 1 ELSE l[1] END AS guarded FROM r"""


def candidate_features(spark, sf_dir):
    """251-256: a row per order and candidate line with its ranks by two scores and the label's prior."""
    s = scores(spark, sf_dir).withColumn("label", F.col("label").cast("string"))
    by = lambda c: s.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("s"), "label"))), lambda x: x["label"]).alias("labels"))
    priors = s.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return vectors.candidate_rows(by("score"), by("other"), priors, 3, 2, 4)


CANDIDATE_FEATURES = f"""WITH {SCORES_SQL}, r AS (SELECT row, list(label::VARCHAR ORDER BY score DESC, label)[:3] AS a, list(label::VARCHAR ORDER BY other DESC, label)[:2] AS b FROM scores GROUP BY row),
c AS (SELECT row, a, b, unnest(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x)))[:4]) AS label FROM r), p AS (SELECT label::VARCHAR AS label, count(*) AS n FROM scores GROUP BY 1)
SELECT row, label, coalesce(list_position(a, label), 0)::BIGINT AS score_rank, coalesce(list_position(b, label), 0)::BIGINT AS recall_rank, list_contains(a, label) AND list_contains(b, label) AS in_both, n AS prior FROM c JOIN p USING (label)"""


def fused_ranks(spark, sf_dir):
    """247, 258: ranks fused within the candidates of every order."""
    s = scores(spark, sf_dir).select("row", "label", F.col("score").alias("primary"), F.col("other").alias("reranker"), (F.col("label") % 2 == 1).alias("is_candidate"))
    return vectors.local_fusion(s, 0.5).select("row", "label", scaled("fused", 3).alias("fused"))


FUSED_RANKS = f"""WITH {SCORES_SQL}, r AS (SELECT row, label, label % 2 = 1 AS c, count(*) OVER w - 1 AS m, row_number() OVER (PARTITION BY row, label % 2 ORDER BY score DESC, label) - 1 AS a, row_number() OVER (PARTITION BY row, label % 2 ORDER BY other DESC, label) - 1 AS b FROM scores WINDOW w AS (PARTITION BY row, label % 2))
SELECT row, label, {scaled_sql('CASE WHEN NOT c THEN -1e9 WHEN m = 0 THEN 1 ELSE 1 - 0.5 * a / m - 0.5 * b / m END', 3)} AS fused FROM r"""


def label_triplets(spark, sf_dir):
    """259: an anchor, a positive and a hard negative for every vector."""
    v = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label")
    negatives = v.select("label").distinct().select("label", ((F.col("label") + 1) % 10).cast("int").alias("negative"), F.lit(1).alias("place"))
    return vectors.triplets(v, negatives)


LABEL_TRIPLETS = """WITH r AS (SELECT vec_id AS id, label, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY label) AS m FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY sha256('42:' || vec_id), vec_id))
SELECT a.id AS anchor, b.id AS positive, c.id AS negative FROM r a JOIN r b ON a.label = b.label AND b.p = (a.p + 1) % a.m JOIN r c ON c.label = (a.label + 1) % 10 AND c.p = a.p % c.m WHERE a.m > 1"""


_ALL = (
    evidence_rows, evidence_stages, event_lifecycles, lifecycle_ends, event_clusters, cluster_credibility, incident_alerts, alert_gates, claim_bindings, transition_gates, learning_signals, distilled_skills, skill_corrections, propagated_labels,
    centroid_routes, constrained_recall, exemplar_labels, prototype_labels, hard_negative_labels, constrained_labels, candidate_features, fused_ranks, label_triplets,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
