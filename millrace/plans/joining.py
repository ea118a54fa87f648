"""Queries over joins, set operations, graphs and clusters (inventory 2.5, 2.8, 2.9), with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import clustering, components, metrics, pairs, ranking
from millrace.plans.bindings import ARTICLES_SQL, NEWS_SQL, articles, news
from millrace.session import table

DAY = 86_400_000_000


def _candidates(e, *carried):
    """Two candidate subjects of every event: its user, and one of 40 by its number."""
    codes = F.array(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("code"), F.col("value").alias("score")), F.struct(F.concat(F.lit("x"), (F.col("event_id") % 40).cast("string")).alias("code"), (F.col("value") / 2).alias("score")))
    return e.select(F.col("event_id").alias("article_id"), "ts", *carried, F.explode(codes).alias("c")).select("article_id", "ts", *carried, "c.*")


CANDIDATES = "e AS (SELECT event_id AS i, epoch_us(ts) AS t, 'u' || user_id AS c, value AS s FROM events UNION ALL SELECT event_id, epoch_us(ts), 'x' || event_id % 40, value / 2 FROM events)"


def subject_edges(spark, sf_dir):
    """10, 86, 141, 162: edges of every event to earlier ones of its subjects within 2 days, 5 at most."""
    out = pairs.subject_time_edges(_candidates(table(spark, sf_dir, "events")), 2, 5)
    return out.select("left_article_id", "right_article_id", F.array_join("shared_codes", ",").alias("codes"), "subject_score", "gap")


SUBJECT_EDGES = f"""WITH {CANDIDATES},
p AS (SELECT l.c, l.i AS li, r.i AS ri, least(l.s, r.s) AS sc, r.t - l.t AS gap, l.s AS ls, l.t AS lt FROM e l JOIN e r ON l.c = r.c AND (l.t < r.t OR (l.t = r.t AND l.i < r.i)) AND r.t - l.t <= {2 * DAY}),
a AS (SELECT *, row_number() OVER (PARTITION BY c, ri ORDER BY ls DESC, lt, li) AS k FROM p),
b AS (SELECT ri, li, max(row(sc, -gap)) AS m FROM a WHERE k <= 5 GROUP BY ri, li),
d AS (SELECT *, row_number() OVER (PARTITION BY ri ORDER BY m DESC, li DESC) AS k FROM b)
SELECT p.li AS left_article_id, p.ri AS right_article_id, string_agg(DISTINCT p.c, ',' ORDER BY p.c) AS codes, max(p.sc) AS subject_score, min(p.gap) AS gap FROM p JOIN d ON p.li = d.li AND p.ri = d.ri AND d.k <= 5 GROUP BY 1, 2"""


def workload_estimate(spark, sf_dir):
    """134: pairs of all events, and of one user within 7 days."""
    return pairs.workload(table(spark, sf_dir, "events"), "user_id", "ts", 7, 20)


WORKLOAD_ESTIMATE = f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
p AS (SELECT rn - min(rn) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {7 * DAY} PRECEDING AND CURRENT ROW) AS n FROM e)
SELECT (SELECT count(*) FROM events) AS rows, (SELECT count(*) * (count(*) - 1) // 2 FROM events) AS all_pairs, (SELECT sum(n)::BIGINT FROM p) AS blocked_pairs, (SELECT count(*) * 20 FROM events) AS capacity"""


def _members(spark, sf_dir):
    """Documents in groups: of their text, and of their number modulo 97 for every third."""
    d = articles(spark, sf_dir)
    groups = F.concat_ws(",", F.concat(F.lit("t"), F.substring(F.md5("content"), 1, 12)), F.when(F.col("id") % 3 == 0, F.concat(F.lit("m"), (F.col("id") % 97).cast("string"))))
    return d.select("id", groups.alias("groups"), "title", "content", F.col("id").alias("source_row"), "ts", "source", "lang")


def grouped_members(spark, sf_dir):
    """69, 167, 168, 181: documents that are in one group alone."""
    return pairs.group_members(_members(spark, sf_dir)).select("id", "group")


GROUPED_MEMBERS = """WITH g AS (SELECT doc_id AS id, 't' || substr(md5(text), 1, 12) AS grp FROM documents UNION ALL SELECT doc_id, 'm' || doc_id % 97 FROM documents WHERE doc_id % 3 = 0)
SELECT id, min(grp) AS "group" FROM g GROUP BY id HAVING count(*) = 1"""


def _rows_order(left, right):
    """Two ids as texts, ordered as the SQL's `least(l, r) || '::' || greatest(l, r)`: there l and r are whole rows, written from their number on, with a comma after it."""
    a, b = F.col(left).cast("bigint"), F.col(right).cast("bigint")
    return F.concat(F.least(a, b).cast("string"), F.lit(","), F.greatest(a, b).cast("string"), F.lit(","))


def duplicate_pairs(spark, sf_dir):
    """65, 67, 88, 119: positive pairs within groups (5 at most) and as many hard negatives, with hashed ids."""
    base = articles(spark, sf_dir).select("id", F.concat(F.lit("g"), (F.col("id") % 211).cast("string")).alias("group"), F.concat("source", F.lit("-"), "lang").alias("subject"), F.md5("content").alias("print"), "ts")
    positive = pairs.positive_pairs(base, most=5)
    positive = positive.select(F.col("left").cast("string").alias("left"), F.col("right").cast("string").alias("right"), "group")
    negative = pairs.hard_negatives(base.withColumn("id", F.col("id").cast("string")), 1, 500, _rows_order)
    return pairs.labelled_pairs(positive, negative, "docs").withColumn("label", F.col("label").cast("bigint"))


DUPLICATE_PAIRS = f"""WITH {ARTICLES_SQL}, m AS (SELECT id, 'g' || id % 211 AS g, source || '-' || lang AS s, md5(content) AS p, epoch_us(ts) AS t FROM articles),
pos AS (SELECT l.id::VARCHAR AS l, r.id::VARCHAR AS r, l.g AS lg, r.g AS rg, row_number() OVER (PARTITION BY l.g ORDER BY sha256('42:' || least(l.id, r.id) || '::' || greatest(l.id, r.id)), least(l.id, r.id) || '::' || greatest(l.id, r.id)) AS k FROM m l JOIN m r ON l.g = r.g AND l.id < r.id),
neg AS (SELECT l.id::VARCHAR AS l, r.id::VARCHAR AS r, l.g AS lg, r.g AS rg, r.t - l.t AS gap FROM m l JOIN m r ON l.s = r.s AND (l.t < r.t OR (l.t = r.t AND l.id::VARCHAR < r.id::VARCHAR)) AND r.t - l.t <= {DAY} WHERE l.g <> r.g AND l.p <> r.p ORDER BY gap, least(l, r) || '::' || greatest(l, r) LIMIT 500),
a AS (SELECT 1 AS label, l, r, lg, rg FROM pos WHERE k <= 5 UNION ALL SELECT 0, l, r, lg, rg FROM neg)
SELECT 'PAIR-' || substr(sha256(concat_ws('|', 'docs', label::VARCHAR, least(l, r), greatest(l, r), CASE WHEN l <= r THEN lg ELSE rg END, CASE WHEN l <= r THEN rg ELSE lg END)), 1, 16) AS pair_id, label::BIGINT AS label, l AS "left", r AS "right" FROM a"""


def edge_recall(spark, sf_dir):
    """92: how many pairs of one type, props and user, and of those within 2 days, are edges: any two events of a common subject within 2 days.

    Edges between groups can't be a pair of the truth, so they aren't made.
    """
    e = table(spark, sf_dir, "events").dropna(subset=["event_id", "event_type", "props", "user_id"]).withColumn("group", F.to_json(F.array("event_type", "props", F.col("user_id").cast("string"))))
    truth = e.select("group", F.col("event_id").cast("string").alias("id"), "ts")
    found = pairs.earlier_pairs(_candidates(e, "group").withColumn("code", F.struct("group", "code")), "code", "article_id", "ts", 2)
    edges = found.select(F.col("left_article_id").cast("string").alias("left"), F.col("right_article_id").cast("string").alias("right"))
    return pairs.candidate_recall(truth, edges, 2)


EDGE_RECALL = f"""WITH {CANDIDATES},
t AS (SELECT l.event_id AS li, r.event_id AS ri, abs(epoch_us(l.ts) - epoch_us(r.ts)) <= {2 * DAY} AS ok FROM events l JOIN events r ON l.event_type = r.event_type AND l.props = r.props AND l.user_id = r.user_id AND l.event_id::VARCHAR < r.event_id::VARCHAR),
ed AS (SELECT DISTINCT li, ri FROM t JOIN e l ON l.i = li JOIN e r ON r.i = ri AND l.c = r.c AND abs(l.t - r.t) <= {2 * DAY})
SELECT count(*) AS positives, count(ed.li) AS found, count(*) FILTER (ok) AS eligible, count(*) FILTER (ok AND ed.li IS NOT NULL) AS eligible_found FROM t LEFT JOIN ed USING (li, ri)"""


def _definitions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("c"), (F.col("p_size") % 20).cast("string")).alias("subject_code"), F.col("p_brand").alias("subject_name"), F.col("p_type").alias("event_name")).distinct()


def definition_join(spark, sf_dir):
    """7, 89, 91: definitions of suppliers by code, else by name; how many each has."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("article_id"), F.concat(F.lit("c"), (F.col("s_suppkey") % 30).cast("string")).alias("code"), F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 1).cast("string")).alias("name"))
    return pairs.definitions_of(a, _definitions(spark, sf_dir)).groupBy("article_id").agg(F.count(F.lit(1)).alias("definitions"), F.min("event_name").alias("first_event"))


DEFINITION_JOIN = """WITH d AS (SELECT DISTINCT 'c' || p_size % 20 AS code, p_brand AS name, p_type AS event FROM part), a AS (SELECT s_suppkey AS article_id, 'c' || s_suppkey % 30 AS code, 'Brand#' || (s_nationkey + 1) AS name FROM supplier),
j AS (SELECT article_id, event FROM a JOIN d ON a.code = d.code UNION ALL SELECT article_id, event FROM a JOIN d ON a.name = d.name WHERE a.code NOT IN (SELECT code FROM d))
SELECT article_id, count(*) AS definitions, min(event) AS first_event FROM j GROUP BY 1"""


def alias_routes(spark, sf_dir):
    """55, 78, 79: the nations whose compact name stands in a customer's note."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    a = c.select(F.col("c_custkey").alias("article_id"), F.concat_ws(" ", "c_name", F.lower("n_name")).alias("title"), F.concat(F.lit("about "), "c_mktsegment", F.lit("; "), F.when(F.col("c_custkey") % 2 == 0, "see N.A.T.I.O.N 1 0").otherwise("")).alias("content"))
    s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    return pairs.alias_hits(a, s, least=4).select("article_id", F.array_join("hits", ",").alias("hits"))


ALIAS_ROUTES = """WITH t AS (SELECT c_custkey AS article_id, regexp_replace(lower(c_name || ' ' || n_name || ' about ' || c_mktsegment || '; ' || CASE WHEN c_custkey % 2 = 0 THEN 'see N.A.T.I.O.N 1 0' ELSE '' END), '[^0-9a-z]+', '', 'g') AS text FROM customer JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT article_id, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey::VARCHAR) AS hits FROM t JOIN nation ON contains(text, regexp_replace(lower(n_name), '[^0-9a-z]+', '', 'g')) WHERE length(regexp_replace(lower(n_name), '[^0-9a-z]+', '', 'g')) >= 4 GROUP BY 1)
SELECT article_id, coalesce(hits, '') AS hits FROM t LEFT JOIN h USING (article_id)"""


def ledger_versions(spark, sf_dir):
    """25, 93, 187, 210: the next version of every customer's row over a ledger of orders, the last line winning."""
    o = table(spark, sf_dir, "orders")
    from millrace.operators.learning import latest

    ledger = o.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("cluster_id"), (F.col("o_orderkey") % 7).alias("version"), F.col("o_orderkey").alias("created_at"), F.col("o_orderkey").alias("seq"))
    new = o.select(F.col("o_custkey").alias("cluster_id"), F.lit(-1).cast("bigint").alias("created_at")).distinct()
    return pairs.carried_versions(new, latest(ledger, "cluster_id", "version", "seq"))


LEDGER_VERSIONS = """WITH l AS (SELECT o_custkey AS cluster_id, max(row(o_orderkey % 7, o_orderkey)) AS m FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT DISTINCT o_custkey AS cluster_id, coalesce(m[2], -1)::BIGINT AS created_at, coalesce(m[1], 0)::BIGINT + 1 AS version FROM orders LEFT JOIN l ON o_custkey = cluster_id"""


def run_integrity(spark, sf_dir):
    """17, 83, 94, 138: what references what between orders, lines, customers and nations."""
    key = lambda df, c, n: df.select(F.col(c).cast("bigint").alias(n))
    o, l, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    return pairs.integrity(key(o, "o_orderkey", "article_id"), key(l, "l_orderkey", "article_id"), key(o, "o_custkey", "article_id"), key(o, "o_custkey", "cluster_id"), key(c, "c_custkey", "cluster_id"))


RUN_INTEGRITY = """SELECT 'article_twice' AS "check", (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n
UNION ALL SELECT 'prediction_twice', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'article_without_prediction', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
UNION ALL SELECT 'prediction_without_article', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'member_without_article', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'alert_without_gate', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))"""


def feedback_append(spark, sf_dir):
    """14-16, 95, 96: approved reviews of conversations as feedback, without those that are held already."""
    c = table(spark, sf_dir, "conversations").filter("turn = 0")
    queue = c.select(F.concat(F.lit("R"), F.col("conv_id").cast("string")).alias("review_id"), F.col("conv_id").cast("string").alias("article_id"), F.col("role").alias("baseline_event"), F.sha2(F.col("conv_id").cast("string"), 256).alias("provenance_hash"))
    reviews = queue.select("review_id", "provenance_hash", F.when(F.col("article_id").cast("int") % 2 == 0, "a").otherwise("b").alias("expected_event_type"), F.lit(" pat ").alias("reviewer"), (F.col("article_id").cast("int") % 3 != 0).alias("approved"), F.lit("").alias("note"))
    found = pairs.reviewed(queue, reviews, ["a", "b"])
    held = found.filter(F.col("article_id").cast("int") % 5 == 0)
    return pairs.only_new(found, held, "feedback_id").select("feedback_id", "article_id", "expected_event_type", "observed_event_type", "reviewer")


FEEDBACK_APPEND = """WITH c AS (SELECT conv_id, role, CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE 'b' END AS e FROM conversations WHERE turn = 0 AND conv_id % 3 <> 0 AND conv_id % 5 <> 0)
SELECT 'FB-' || substr(sha256(concat_ws('|', 'R' || conv_id, sha256(conv_id::VARCHAR), e, 'pat')), 1, 16) AS feedback_id, conv_id::VARCHAR AS article_id, e AS expected_event_type, role AS observed_event_type, 'pat' AS reviewer FROM c"""


def review_context(spark, sf_dir):
    """97: review items with the context of their article, 1,200 characters of it."""
    a = articles(spark, sf_dir).select(F.col("id").cast("string").alias("article_id"), "title", "content", "source", F.col("ts").alias("publish_time"))
    q = a.select(F.concat(F.lit("R"), "article_id").alias("review_id"), F.lit("p").alias("provenance_hash"), "article_id", F.lit("e").alias("baseline_event"), F.array().cast("array<string>").alias("candidate_events"), F.lit(0.5).alias("svc_margin"), F.lit("s").alias("route_status"))
    return pairs.review_packet(q, a.unionByName(a), 1200).select("review_id", "title", "source", "content_preview")


REVIEW_CONTEXT = f"WITH {ARTICLES_SQL} SELECT 'R' || id AS review_id, title, source, substring(content, 1, 1200) AS content_preview FROM articles"


def subject_enrichment(spark, sf_dir):
    """77, 98: news with the accepted or first candidate subject, and their subject key."""
    n = news(spark, sf_dir).select("article_id", F.col("trading_code").alias("code"), "entity", "user_id", "id")
    cand = F.array(F.struct(F.concat(F.lit("k"), (F.col("id") % 9).cast("string")).alias("subject_code"), F.concat(F.lit("名"), (F.col("id") % 9).cast("string")).alias("subject_name")))
    routes = n.filter("id % 3 <> 0").select("article_id", F.when(F.col("id") % 3 == 1, F.lit("acc")).alias("accepted_code"), F.when(F.col("id") % 3 == 1, F.lit("甲公司")).alias("accepted_name"), cand.alias("candidates"))
    out = pairs.enriched(n.drop("user_id", "id"), routes)
    return out.select("article_id", "code", "entity", F.array_join("trace", ",").alias("trace"), pairs.subject_key(F.lit("company"), F.lit(""), F.lit(""), F.col("code"), F.col("entity")).alias("subject"))


SUBJECT_ENRICHMENT = f"""WITH {NEWS_SQL}, x AS (SELECT article_id, CASE id % 3 WHEN 0 THEN trading_code WHEN 1 THEN 'acc' ELSE 'k' || id % 9 END AS code, CASE id % 3 WHEN 0 THEN entity WHEN 1 THEN '甲公司' ELSE '名' || id % 9 END AS entity, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'subject:accepted' ELSE 'subject:first_candidate' END AS trace FROM news)
SELECT *, code AS subject FROM x"""


def key_overlap(spark, sf_dir):
    """103, 164, 165: how many words the benchmark and the documents' whole texts share."""
    words = lambda df, c: df.select(F.explode(text.tokens(c)).alias("w"))
    return pairs.overlap(words(table(spark, sf_dir, "benchmark"), "text"), words(articles(spark, sf_dir), "content"), "w").drop("share")


KEY_OVERLAP = f"""WITH {ARTICLES_SQL}, a AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}]+'), lambda x: length(x) >= 2)) AS w FROM benchmark),
b AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(trim(regexp_replace(content, '\\s+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}]+'), lambda x: length(x) >= 2)) AS w FROM articles)
SELECT (SELECT count(*) FROM a) AS left_keys, (SELECT count(*) FROM b) AS right_keys, (SELECT count(*) FROM a JOIN b USING (w)) AS both"""


def _links(spark, sf_dir):
    """Events of one user and type within an hour, each with the next."""
    here = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts").withColumn("next", F.lead("event_id").over(here)).withColumn("next_ts", F.lead("ts").over(here))
    return e.filter(F.col("next").isNotNull() & (F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("next_ts")) <= 12 * 3_600_000_000)).select(F.col("event_id").alias("a"), F.col("next").alias("b"))


_RUNS = """e AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN gap <= 43200000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM e),
c AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type, run) AS root, count(*) OVER (PARTITION BY user_id, event_type, run) AS size FROM r)"""


def event_components(spark, sf_dir):
    """170: events linked to the next of their user and type within 12 hours, as components."""
    return components.components(_links(spark, sf_dir))


EVENT_COMPONENTS = f"WITH {_RUNS} SELECT event_id AS node, root AS component FROM c WHERE size > 1"


def component_quality(spark, sf_dir):
    """111, 174: integers of the cluster metrics of those components against users of the day."""
    e = table(spark, sf_dir, "events")
    nodes = e.select(F.col("event_id").alias("id"), F.concat_ws("-", F.col("user_id").cast("string"), F.dayofyear("ts").cast("string")).alias("truth"))
    roots = clustering.assigned(nodes, _links(spark, sf_dir))
    return metrics.cluster_counts(roots.select("id", "truth", F.col("root").alias("predicted"))).select(*(F.col(c).cast("bigint").alias(c) for c in ("rows", "both", "true_pairs", "groups", "split", "found_pairs", "clusters", "merged")))


COMPONENT_QUALITY = f"""WITH {_RUNS}, x AS (SELECT user_id || '-' || dayofyear(ts) AS t, root AS p FROM c), n AS (SELECT t, p, count(*) AS n FROM x GROUP BY ALL),
t AS (SELECT t, sum(n) AS n, count(*) AS k FROM n GROUP BY t), p AS (SELECT p, sum(n) AS n, count(*) AS k FROM n GROUP BY p)
SELECT (SELECT count(*) FROM x) AS rows, (SELECT sum(n * (n - 1) // 2)::BIGINT FROM n) AS both, (SELECT sum(n * (n - 1) // 2)::BIGINT FROM t) AS true_pairs, (SELECT count(*) FROM t) AS groups, (SELECT count(*) FROM t WHERE k > 1) AS split,
  (SELECT sum(n * (n - 1) // 2)::BIGINT FROM p) AS found_pairs, (SELECT count(*) FROM p) AS clusters, (SELECT count(*) FROM p WHERE k > 1) AS merged"""


def edge_clusters(spark, sf_dir):
    """173, 179, 231: decisions on candidate edges between vectors: same first candidate and cosine."""
    v = table(spark, sf_dir, "embeddings")
    vectors = v.select(F.col("vec_id").alias("id"), "embedding")
    recalls = v.select(F.col("vec_id").alias("id"), F.array(F.struct(F.col("label").cast("string").alias("subject_code"), (F.col("label") % 3).cast("string").alias("event_name"))).alias("candidates"))
    here = W.partitionBy("label").orderBy("vec_id")
    edges = v.select(F.col("vec_id").alias("left"), F.lead("vec_id").over(here).alias("right")).filter("right IS NOT NULL").unionByName(v.select(F.col("vec_id").alias("left"), (F.col("vec_id") + 1).alias("right")))
    return clustering.edge_decisions(edges, vectors, recalls, 0.2).select("left", "right", "same_event", "merged")


EDGE_CLUSTERS = """WITH e AS (SELECT vec_id AS l, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings UNION ALL SELECT vec_id, vec_id + 1 FROM embeddings)
SELECT l AS "left", r AS "right", a.label = b.label AS same_event, a.label = b.label AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2 AS merged FROM e JOIN embeddings a ON a.vec_id = l JOIN embeddings b ON b.vec_id = r"""


def top_pairs(spark, sf_dir):
    """139, 140: of the subject edges whose ends aren't at one time, and of at least a score, the 2 best of each left."""
    edges = pairs.subject_time_edges(_candidates(table(spark, sf_dir, "events")), 2, 5)
    found = edges.select(F.col("left_article_id").alias("left"), F.col("right_article_id").alias("right"), text.pair_key(F.col("left_article_id").cast("string"), F.col("right_article_id").cast("string")).alias("pair_id"), F.col("subject_score").alias("score"), F.when(F.col("gap") > 0, 1.0).alias("semantic"))
    return ranking.selected_pairs(found, 20, 2).select("left", "right", "score", F.col("rank").cast("bigint").alias("rank"))


TOP_PAIRS = f"""WITH p AS (SELECT left_article_id AS l, right_article_id AS r, subject_score AS score, least(left_article_id::VARCHAR, right_article_id::VARCHAR) || '::' || greatest(left_article_id::VARCHAR, right_article_id::VARCHAR) AS k FROM ({SUBJECT_EDGES}) WHERE gap > 0),
q AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, k) AS rank FROM p WHERE score >= 20) SELECT l AS "left", r AS "right", score, rank FROM q WHERE rank <= 2"""


def rule_clusters(spark, sf_dir):
    """59, 85, 171, 172, 177: rule decisions on all pairs of news that can merge, whatever their subject or time (the sequence ratio has no SQL)."""
    rows = news(spark, sf_dir).select("id", "title", F.substring("content", 1, 80).alias("evidence"), "entity", "event_type", F.col("publish_time").alias("ts"))
    return clustering.all_rule_decisions(rows).select("left", "right", "score", "merged", "method")


QUERIES = {f.__name__: f for f in (subject_edges, workload_estimate, grouped_members, duplicate_pairs, edge_recall, definition_join, alias_routes, ledger_versions, run_integrity, feedback_append, review_context, subject_enrichment, key_overlap, event_components, component_quality, edge_clusters, top_pairs, rule_clusters)}
ORACLE_SQL = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
