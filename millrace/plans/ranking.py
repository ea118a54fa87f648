"""Queries over aggregates, metrics, windows and splits (inventory 2.6, 2.7, 2.8, 2.12), with their SQL.

Doubles that two engines may add in different orders are compared as scaled integers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import metrics, ranking, splits
from millrace.plans.bindings import ARTICLES_SQL, NEWS_SQL, SCORES_SQL, articles, news, scores
from millrace.session import table


def scaled(c, places: int = 6):
    """A double as a whole number of 10 ** -places."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 10**places).cast("bigint")


def scaled_sql(c: str, places: int = 6) -> str:
    return f"round(({c}) * 1e{places})::BIGINT"


def segment_profile(spark, sf_dir):
    """99, 100, 103: counts, blanks, distinct and repeated values of documents by language."""
    a = articles(spark, sf_dir)
    return a.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.trim("content") == "").alias("blank"), F.count_distinct("content").alias("texts"), (F.count(F.lit(1)) - F.count_distinct("content")).alias("repeats"), F.min("ts").cast("string").alias("first"), F.max("ts").cast("string").alias("last"))


SEGMENT_PROFILE = f"WITH {ARTICLES_SQL} SELECT lang, count(*) AS rows, count(*) FILTER (trim(content) = '') AS blank, count(DISTINCT content) AS texts, count(*) - count(DISTINCT content) AS repeats, min(ts)::VARCHAR AS first, max(ts)::VARCHAR AS last FROM articles GROUP BY lang"


def top_sources(spark, sf_dir):
    """99, 163: the 20 most frequent sources."""
    return articles(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(20)


TOP_SOURCES = "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 20"


def length_percentiles(spark, sf_dir):
    """101, 102: mean, median, nearest-rank 95th percentile and maximum of text lengths, and sizes of groups of equal texts."""
    a = articles(spark, sf_dir)
    lengths = a.agg(scaled(F.avg("n_chars"), 3).alias("mean"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n_chars)").cast("bigint").alias("middle"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n_chars)").cast("bigint").alias("p95"), F.max("n_chars").alias("most"))
    groups = a.groupBy("content").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("repeated"), F.max("n").alias("largest"))
    return lengths.crossJoin(groups)  # one row each


LENGTH_PERCENTILES = f"SELECT a.*, b.* FROM (SELECT {scaled_sql('avg(n_chars)', 3)} AS mean, quantile_disc(n_chars, 0.5) AS middle, quantile_disc(n_chars, 0.95) AS p95, max(n_chars) AS most FROM documents) a, (SELECT count(*) AS groups, count(*) FILTER (n > 1) AS repeated, max(n) AS largest FROM (SELECT count(*) AS n FROM documents GROUP BY text)) b"


def class_report(spark, sf_dir):
    """112, 113, 124: per-class counts of order lines' flag (truth: status of the part's line) by priority."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 7).alias("truth"), (F.col("l_suppkey") % 7).alias("predicted"))
    return metrics.per_class(rows).select("label", "support", "tp", "fp", "fn", scaled("f1").alias("f1"))


CLASS_REPORT = f"""WITH r AS (SELECT l_partkey % 7 AS t, l_suppkey % 7 AS p FROM lineitem), l AS (SELECT t AS label FROM r UNION SELECT p FROM r),
c AS (SELECT label, (SELECT count(*) FROM r WHERE t = label) AS support, (SELECT count(*) FROM r WHERE t = label AND p = label) AS tp, (SELECT count(*) FROM r WHERE p = label) AS found FROM l)
SELECT label, support, tp, found - tp AS fp, support - tp AS fn, {scaled_sql('2 * tp / (support + found)')} AS f1 FROM c"""


def accuracy_report(spark, sf_dir):
    """112: accuracy and macro F1 of quality as a guess of toxicity's absence."""
    rows = table(spark, sf_dir, "labels").select(F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("predicted"))
    return metrics.classification(rows).select(scaled("accuracy").alias("accuracy"), scaled("macro_f1").alias("macro_f1"), F.col("rows").cast("bigint").alias("rows"))


ACCURACY_REPORT = f"""WITH r AS (SELECT quality AS t, 1 - toxic AS p FROM labels), l AS (SELECT t AS label FROM r UNION SELECT p FROM r),
f AS (SELECT 2 * (SELECT count(*) FROM r WHERE t = label AND p = label) / ((SELECT count(*) FROM r WHERE t = label) + (SELECT count(*) FROM r WHERE p = label)) AS f1 FROM l)
SELECT {scaled_sql('(SELECT count(*) FROM r WHERE t = p) / (SELECT count(*) FROM r)')} AS accuracy, {scaled_sql('(SELECT avg(f1) FROM f)')} AS macro_f1, (SELECT count(*) FROM r) AS rows"""


def split_coverage(spark, sf_dir):
    """113: how much of the last parts' brands the first ones have."""
    p = table(spark, sf_dir, "part").withColumn("label", F.concat_ws("|", "p_brand", "p_type", "p_size"))
    return metrics.closed_set_coverage(p.filter("p_partkey % 5 <> 0"), p.filter("p_partkey % 5 = 0"))


SPLIT_COVERAGE = "WITH p AS (SELECT p_partkey % 5 AS k, p_brand || '|' || p_type || '|' || p_size AS label FROM part), t AS (SELECT DISTINCT label FROM p WHERE k <> 0) SELECT count(*) AS rows, count(t.label) AS covered, count(DISTINCT CASE WHEN t.label IS NULL THEN p.label END) AS unseen_labels FROM p LEFT JOIN t USING (label) WHERE k = 0"


def flag_confusion(spark, sf_dir):
    """113, 121: the matrix of order lines' flags and statuses of their orders."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("truth"), F.col("l_linestatus").alias("predicted"))
    return metrics.confusion_matrix(rows, ["F", "O"])


FLAG_CONFUSION = "SELECT l_returnflag AS truth, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1"


def confusion_pairs(spark, sf_dir):
    """120-122: unordered pairs of part and supplier classes confused often."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 13).alias("truth"), (F.col("l_suppkey") % 13).alias("predicted"))
    return metrics.frequent_pairs(rows, 10).join(metrics.concentration(rows, 10))


CONFUSION_PAIRS = """WITH r AS (SELECT l_partkey % 13 AS t, l_suppkey % 13 AS p FROM lineitem WHERE l_partkey % 13 <> l_suppkey % 13), o AS (SELECT t, p, count(*) AS n FROM r GROUP BY ALL),
u AS (SELECT least(t, p) AS a, greatest(t, p) AS b, sum(n)::BIGINT AS n FROM o GROUP BY ALL HAVING sum(n) >= 10)
SELECT u.*, (SELECT sum(n)::BIGINT FROM o) AS errors, (SELECT count(*) FROM o) AS kinds, (SELECT sum(n)::BIGINT FROM (SELECT n FROM o ORDER BY n DESC, t, p LIMIT 10)) AS top_errors FROM u"""


def binary_counts(spark, sf_dir):
    """114, 157: counts at a threshold, and the best threshold of prices as a guess of the status."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    best = ranking.best_threshold(rows, "l_quantity", "y").select(F.col("threshold").alias("best_threshold"), F.col("tp").alias("best_tp"), F.col("fp").alias("best_fp"))
    return metrics.binary(rows, "l_quantity", "y", 20.0).select("tp", "fp", "tn", "fn").crossJoin(best)  # one row each


BINARY_COUNTS = """WITH r AS (SELECT l_quantity AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), d AS (SELECT DISTINCT s FROM r),
c AS (SELECT d.s, count(*) FILTER (r.s >= d.s AND y = 1) AS tp, count(*) FILTER (r.s >= d.s AND y = 0) AS fp, count(*) FILTER (r.s < d.s AND y = 1) AS fn, count(*) FILTER (r.s < d.s AND y = 0) AS tn FROM d, r GROUP BY d.s),
b AS (SELECT * FROM c ORDER BY 2 * tp / (2 * tp + fp + fn) DESC, tp / (tp + fp) DESC, (tp + tn) / (tp + fp + tn + fn) DESC, s DESC LIMIT 1)
SELECT count(*) FILTER (s >= 20 AND y = 1) AS tp, count(*) FILTER (s >= 20 AND y = 0) AS fp, count(*) FILTER (s < 20 AND y = 0) AS tn, count(*) FILTER (s < 20 AND y = 1) AS fn, (SELECT s FROM b) AS best_threshold, (SELECT tp FROM b) AS best_tp, (SELECT fp FROM b) AS best_fp FROM r"""


def _ranked(spark, sf_dir):
    s = scores(spark, sf_dir)
    return s.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "label"))), lambda x: x["label"]).alias("candidates"), F.min("flag").alias("flag"))


_RANKED = f"{SCORES_SQL}, ranked AS (SELECT row, list(label ORDER BY score DESC, label) AS cands, min(flag) AS flag FROM scores GROUP BY row)"


def retrieval_report(spark, sf_dir):
    """115, 117, 123: hits of a truth among the line numbers of an order by price."""
    rows = _ranked(spark, sf_dir).withColumn("expected", F.col("row") % 7 + 1)
    covered = rows.select(F.col("expected").alias("truth"), F.get("candidates", 0).alias("predicted"), F.slice("candidates", 1, 3).alias("candidates"))
    return metrics.retrieval(rows, 3).select("rows", "hit_1", "hit_k", scaled("mrr").alias("mrr")).crossJoin(metrics.candidate_coverage(covered))  # one row each


RETRIEVAL_REPORT = f"""WITH {_RANKED}, p AS (SELECT row % 7 + 1 AS e, cands, list_position(cands[:3], row % 7 + 1) AS pos FROM ranked)
SELECT count(*) AS rows, count(*) FILTER (pos = 1) AS hit_1, count(*) FILTER (pos > 0) AS hit_k, {scaled_sql('avg(CASE WHEN pos > 0 THEN 1 / pos ELSE 0 END)')} AS mrr, count(*) FILTER (cands[1] <> e) AS errors, count(*) FILTER (cands[1] <> e AND pos > 0) AS recoverable FROM p"""


def routing_report(spark, sf_dir):
    """116, 118: coverage and precision of hard routes made of orders' flags."""
    rows = _ranked(spark, sf_dir).select((F.col("row") % 7 + 1).alias("truth"), F.when(F.col("flag") == "A", F.get("candidates", 0)).alias("accepted"), "candidates", F.when(F.col("flag") == "A", "exact_alias").otherwise("candidate_only").alias("method"))
    return metrics.routing(rows, 3).join(metrics.route_summary(rows).drop("rows"))


ROUTING_REPORT = f"""WITH {_RANKED}, r AS (SELECT row % 7 + 1 AS t, CASE WHEN flag = 'A' THEN cands[1] END AS a, cands FROM ranked)
SELECT count(*) AS rows, count(a) AS routed, count(*) FILTER (a = t) AS routed_right, count(*) FILTER (cands[1] = t) AS hit_1, count(*) FILTER (a = t OR (a IS NULL AND list_contains(cands[:3], t))) AS hit_k, count(a) AS accepted, count(a) AS exact_alias, 0::BIGINT AS vector, count(*) FILTER (a IS NULL) AS candidate_only FROM r"""


def challenge_slices(spark, sf_dir):
    """127: accuracy counts on overlapping slices of documents."""
    a = articles(spark, sf_dir).select((F.col("id") % 3).alias("truth"), (F.col("n_chars") % 3).alias("predicted"), "lang", "n_chars", "id")
    return metrics.slices(a, {"all": F.lit(True), "rare_language": F.col("lang") == "es", "long_text": F.col("n_chars") >= 2000, "short_text": F.col("n_chars") < 500, "third": F.col("id") % 3 == 0})


CHALLENGE_SLICES = """WITH a AS (SELECT doc_id % 3 AS t, n_chars % 3 AS p, lang, n_chars, doc_id FROM documents), s AS (SELECT *, unnest([CASE WHEN true THEN 'all' END, CASE WHEN lang = 'es' THEN 'rare_language' END, CASE WHEN n_chars >= 2000 THEN 'long_text' END, CASE WHEN n_chars < 500 THEN 'short_text' END, CASE WHEN doc_id % 3 = 0 THEN 'third' END]) AS slice FROM a)
SELECT slice, count(*) AS rows, count(*) FILTER (t = p) AS right FROM s WHERE slice IS NOT NULL GROUP BY slice"""


def margin_report(spark, sf_dir):
    """128, 129, 144: errors below quantiles of the margin, and accuracy if the lowest margins were corrected."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("margin"), (F.col("o_orderkey") % 5).alias("truth"), (F.col("o_custkey") % 5).alias("predicted"))
    prof = metrics.margin_profile(rows.withColumn("is_error", F.col("truth") != F.col("predicted")), (0.1, 0.2, 0.3, 0.5)).select(F.lit("profile").alias("part"), "quantile", "rows", F.col("errors").alias("value"))
    return prof.unionByName(metrics.oracle_frontier(rows, "key", (0.1, 0.2, 0.3, 0.4, 0.5)).select(F.lit("frontier").alias("part"), "quantile", F.col("corrected").alias("rows"), F.col("right").alias("value")))


MARGIN_REPORT = """WITH r AS (SELECT o_orderkey AS k, o_totalprice AS m, o_orderkey % 5 <> o_custkey % 5 AS e FROM orders), q AS (SELECT unnest([0.1, 0.2, 0.3, 0.5]::DOUBLE[]) AS q), c AS (SELECT q, (SELECT quantile_cont(m, [0.1, 0.2, 0.3, 0.5])[CASE q WHEN 0.1 THEN 1 WHEN 0.2 THEN 2 WHEN 0.3 THEN 3 ELSE 4 END] FROM r) AS t FROM q),
p AS (SELECT *, row_number() OVER (ORDER BY m, k) AS pos, count(*) OVER () AS n FROM r), f AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS q)
SELECT 'profile' AS part, q AS quantile, count(*) FILTER (m <= t) AS rows, count(*) FILTER (m <= t AND e) AS value FROM c, r GROUP BY q
UNION ALL SELECT 'frontier', q, count(*) FILTER (pos <= floor(q * n)), count(*) FILTER (pos <= floor(q * n) OR NOT e) FROM f, p GROUP BY q"""


def bootstrap_report(spark, sf_dir):
    """130, 131: paired bootstrap of two predictions on labels (weights from hashes, so there is no SQL)."""
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("predicted"), F.lit(1).alias("other"))
    return metrics.interval(metrics.bootstrap(rows, "key", 200), "gain")


def seed_report(spark, sf_dir):
    """132: mean, deviation and range of a metric over seeds (suppliers' balances by nation)."""
    s = table(spark, sf_dir, "supplier").select(F.lit("one").alias("config"), F.col("s_suppkey").alias("seed"), F.col("s_acctbal").alias("metric"))
    return metrics.seed_summary(s, "metric").select("runs", scaled("mean", 2).alias("mean"), scaled("sd", 2).alias("sd"), "low", "high")


SEED_REPORT = f"SELECT count(*) AS runs, {scaled_sql('avg(s_acctbal)', 2)} AS mean, {scaled_sql('stddev_pop(s_acctbal)', 2)} AS sd, min(s_acctbal) AS low, max(s_acctbal) AS high FROM supplier"


def weight_report(spark, sf_dir):
    """133, 136, 137: class weights of documents' sources by two rules."""
    a = articles(spark, sf_dir)
    w = metrics.class_weights(a, "source", 0.5).select("source", "n", scaled("weight").alias("balanced"))
    return w.join(metrics.inverse_weights(a, "source").select("source", scaled("weight").alias("inverse")), "source")


WEIGHT_REPORT = f"""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS total, count(*) AS k FROM s), r AS (SELECT source, n, pow(total / (k * n), 0.5) AS a, pow(n::DOUBLE, -0.5) AS b FROM s, t)
SELECT source, n, {scaled_sql('a * (SELECT total FROM t) / (SELECT sum(a * n) FROM r)')} AS balanced, {scaled_sql('b / (SELECT avg(b) FROM r)')} AS inverse FROM r"""


def sampler_report(spark, sf_dir):
    """133: effective size of a sampler that favours rare event types."""
    return metrics.sampler(table(spark, sf_dir, "events"), "event_type", 0.5).select(F.col("rows").cast("bigint").alias("rows"), scaled("effective_size", 3).alias("effective_size"), scaled("unique_share").alias("unique_share"))


SAMPLER_REPORT = f"""WITH s AS (SELECT count(*) AS n FROM events GROUP BY event_type), w AS (SELECT n, pow(n::DOUBLE, -0.5) AS w FROM s), t AS (SELECT sum(n)::DOUBLE AS r, sum(n * w) AS m, sum(n * w * w) AS q FROM w)
SELECT (SELECT r::BIGINT FROM t) AS rows, {scaled_sql('(SELECT m * m / q FROM t)', 3)} AS effective_size, {scaled_sql('1 - sum(n * exp(r * 3 * ln(1 - w / m))) / any_value(r)')} AS unique_share FROM w, t"""


def coverage_grid(spark, sf_dir):
    """135: how often a truth is among the first k of one ranking or the first j of another, for a grid of both."""
    s = scores(spark, sf_dir)
    by = lambda c, n: s.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("s"), "label"))), lambda x: x["label"]).alias(n))
    both = by("score", "a").join(by("other", "b"), "row").withColumn("truth", F.col("row") % 7 + 1)
    grid = spark.createDataFrame([(i, j) for i in (1, 2, 3) for j in (0, 1, 2)], "k int, j int")
    return both.crossJoin(F.broadcast(grid)).groupBy("k", "j").agg(F.count_if(F.array_contains(F.array_union(F.expr("slice(a, 1, k)"), F.expr("slice(b, 1, j)")), F.col("truth"))).alias("hits"))  # nine cells


COVERAGE_GRID = f"""WITH {SCORES_SQL}, r AS (SELECT row, list(label ORDER BY score DESC, label) AS a, list(label ORDER BY other DESC, label) AS b FROM scores GROUP BY row)
SELECT k::INT AS k, j::INT AS j, count(*) FILTER (list_contains(a[:k] || CASE WHEN j > 0 THEN b[:j] ELSE [] END, row % 7 + 1)) AS hits FROM r, range(1, 4) x(k), range(0, 3) y(j) GROUP BY 1, 2"""


def score_margins(spark, sf_dir):
    """144, 145, 197: the best line of every order, its margin, and the label that a gate gives."""
    m = ranking.margins(scores(spark, sf_dir))
    return ranking.gated(m.withColumn("second", F.lit(0).cast("bigint")), "best", "second", "margin", 5000.0).select("row", "best", scaled("best_score", 2).alias("best_score"), scaled("margin", 2).alias("margin"), "label")


SCORE_MARGINS = f"""WITH {SCORES_SQL}, r AS (SELECT row, list(label ORDER BY score DESC, label) AS l, list(score ORDER BY score DESC, label) AS s FROM scores GROUP BY row)
SELECT row, l[1] AS best, {scaled_sql('s[1]', 2)} AS best_score, {scaled_sql('s[1] - s[2]', 2)} AS margin, CASE WHEN s[1] - s[2] <= 5000 THEN 0 ELSE l[1] END AS label FROM r"""


def rank_blend(spark, sf_dir):
    """142, 143, 146: two rankings of an order's lines blended."""
    s = scores(spark, sf_dir)
    a = ranking.rank_scores(s)
    b = ranking.rank_scores(s, score="other")
    return ranking.blended(a, b, 0.25).select("row", "label", scaled("score").alias("score"))


RANK_BLEND = f"""WITH {SCORES_SQL}, r AS (SELECT row, label, count(*) OVER (PARTITION BY row) - 1 AS m, row_number() OVER (PARTITION BY row ORDER BY score DESC, label) - 1 AS a, row_number() OVER (PARTITION BY row ORDER BY other DESC, label) - 1 AS b FROM scores)
SELECT row, label, {scaled_sql('0.75 * CASE WHEN m = 0 THEN 1 ELSE 1 - a / m END + 0.25 * CASE WHEN m = 0 THEN 1 ELSE 1 - b / m END')} AS score FROM r"""


def z_scores(spark, sf_dir):
    """146, 147: scores standardised within an order, and over each line number."""
    s = scores(spark, sf_dir)
    both = ranking.calibrated(s, ranking.row_z(s))
    return both.select("row", "label", scaled("z", 4).alias("z"), scaled("calibrated", 4).alias("calibrated"))


Z_SCORES = f"""WITH {SCORES_SQL} SELECT row, label, {scaled_sql('(score - avg(score) OVER (PARTITION BY row)) / greatest(stddev_pop(score) OVER (PARTITION BY row), 1e-6)', 4)} AS z, {scaled_sql('(score - avg(score) OVER (PARTITION BY label)) / greatest(stddev_pop(score) OVER (PARTITION BY label), 1e-6)', 4)} AS calibrated FROM scores"""


def balanced_picks(spark, sf_dir):
    """148-151: 100 events of low value in turns over types, all and those where two labels differ."""
    e = table(spark, sf_dir, "events").withColumn("second", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("view"))
    a = ranking.low_margins(e, "event_type", "value", "event_id", 100).select("event_id", F.lit("all").alias("pick"), F.col("turn").cast("bigint").alias("turn"))
    return a.unionByName(ranking.disagreements(e, "event_type", "second", "value", "event_id", 50).select("event_id", F.lit("differ").alias("pick"), F.col("turn").cast("bigint").alias("turn")))


BALANCED_PICKS = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS turn FROM events), d AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS turn FROM events WHERE event_id % 2 = 1 AND event_type <> 'view')
SELECT * FROM (SELECT event_id, 'all' AS pick, turn FROM e ORDER BY turn, event_type LIMIT 100) UNION ALL SELECT * FROM (SELECT event_id, 'differ', turn FROM d ORDER BY turn, event_type LIMIT 50)"""


def time_coverage(spark, sf_dir):
    """152, 153: 60 events spread evenly over types and time, and 40 by the types' errors (the quotas have no SQL)."""
    e = table(spark, sf_dir, "events")
    a = ranking.temporal_coverage(e, "event_type", "ts", "event_id", 60).select("event_id", "event_type", F.lit("spread").alias("pick"))
    return a.unionByName(ranking.risk_weighted(e, "event_type", "value", "event_id", {"error": 0.5, "view": 0.1, "click": 0.2}, 40).select("event_id", "event_type", F.lit("risk").alias("pick")))


def diverse_picks(spark, sf_dir):
    """154: of every label 5 vectors that are unlike one another (greedy, so there is no SQL)."""
    v = table(spark, sf_dir, "embeddings").withColumn("margin", (F.col("vec_id") % 10) / 10).withColumn("dup", F.when(F.col("vec_id") % 4 == 0, F.col("vec_id") % 12))
    return ranking.diverse(v, "label", "margin", "embedding", "vec_id", 5, group="dup")


def vote_majority(spark, sf_dir):
    """110, 155: the most frequent flag of every order's lines."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_returnflag").alias("label"))
    return ranking.majority(v)


VOTE_MAJORITY = "WITH c AS (SELECT l_orderkey AS row, l_returnflag AS label, count(*) AS votes FROM lineitem GROUP BY ALL) SELECT row, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY votes DESC, label) AS k FROM c) WHERE k = 1"


def margin_calibration(spark, sf_dir):
    """156: the smallest margin with enough precision and support."""
    o = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("m"), (F.col("l_returnflag") != "N").alias("hit"))
    return ranking.margin_threshold(o, "m", "hit", 0.5, 100)


MARGIN_CALIBRATION = """WITH g AS (SELECT l_quantity AS m, count(*) FILTER (l_returnflag <> 'N') AS h, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT m, sum(h) OVER (ORDER BY m DESC)::BIGINT AS hits, sum(n) OVER (ORDER BY m DESC)::BIGINT AS n FROM g), q AS (SELECT * FROM r WHERE hits >= 0.5 * n AND n >= 100)
SELECT min(m) AS threshold, max(n) AS support, arg_min(hits, m) AS hits FROM q"""


def capped_groups(spark, sf_dir):
    """158: groups of orders by customer taken in turns over priorities while they fit 2000 (sequential, so there is no SQL)."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("subject"), F.col("o_custkey").alias("group")).agg(F.count(F.lit(1)).alias("size"))
    return ranking.whole_groups(g, "subject", "group", "size", 2000)


def hard_cases(spark, sf_dir):
    """159, 160: hard examples among orders and the cases that an agent should see."""
    r = _ranked(spark, sf_dir)
    s = scores(spark, sf_dir).groupBy("row").agg(F.sort_array(F.collect_list(F.col("score") / 100000), asc=False).alias("event_scores"))
    rows = r.join(s, "row").select(F.col("row").alias("article_id"), F.when(F.col("flag") == "A", F.col("flag")).alias("accepted"), ((F.col("row") % 10) / 100).alias("subject_margin"), "event_scores")
    return ranking.hard_examples(rows, 0.05, 0.05, 300).select("article_id", F.array_join("reasons", ",").alias("reasons"), scaled("priority", 4).alias("priority"))


HARD_CASES = f"""WITH {_RANKED}, s AS (SELECT row, list(score / 100000 ORDER BY score DESC) AS s FROM scores GROUP BY row),
r AS (SELECT row, flag = 'A' AS acc, (row % 10) / 100 AS m, s[1] - s[2] AS g FROM ranked JOIN s USING (row)),
p AS (SELECT row AS article_id, concat_ws(',', CASE WHEN NOT acc THEN 'subject_rejected' END, CASE WHEN m < 0.05 THEN 'subject_low_margin' END, CASE WHEN g < 0.05 THEN 'event_low_margin' END) AS reasons,
  round((CASE WHEN NOT acc THEN 2 ELSE 0 END + CASE WHEN m < 0.05 THEN 0.05 - m ELSE 0 END + CASE WHEN g < 0.05 THEN 0.05 - g ELSE 0 END)::DOUBLE, 6) AS priority FROM r)
SELECT article_id, reasons, {scaled_sql('priority', 4)} AS priority FROM p WHERE reasons <> '' ORDER BY p.priority DESC, article_id LIMIT 300"""


def agent_selection(spark, sf_dir):
    """126, 160: cases for an agent, larger numbers first among equals."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderstatus") == "F", "exact_alias").when(F.col("o_orderstatus") == "O", "vector_high_confidence").otherwise("candidate_only").alias("method"), ((F.col("o_custkey") % 100) / 100).alias("confidence"), ((F.col("o_orderkey") % 50) / 100).alias("subject_margin"), (F.col("o_orderkey") % 3 == 0).alias("disagrees"))
    return ranking.agent_cases(rows, 200, 0.5, 0.1).select("idx", F.col("points").cast("bigint").alias("points"))


AGENT_SELECTION = """WITH r AS (SELECT o_orderkey AS idx, o_custkey % 100 AS c, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN o_custkey % 100 <= 50 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 50 <= 10 THEN 1 ELSE 0 END AS points FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT idx, points::BIGINT AS points FROM r WHERE points > 0 ORDER BY r.points DESC, c, idx DESC LIMIT 200"""


def review_queue(spark, sf_dir):
    """34, 161: review items of the fifth of orders with the lowest margins, in batches of two, two and one fifth of the queue."""
    o = ranking.lowest_percent(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", 20)
    rows = o.select(F.col("o_orderkey").cast("string").alias("article_id"), F.col("o_orderstatus").alias("baseline"), F.col("o_totalprice").alias("margin"), F.array("o_orderpriority").alias("candidates"), F.lit("candidate_only").alias("status"))
    n = rows.count()
    return ranking.batches(ranking.review_items(rows, "company"), ["svc_margin", "article_id"], [n * 2 // 5, n * 2 // 5, n - n * 2 // 5 * 2]).select("review_id", "article_id", scaled("priority").alias("priority"), F.col("batch").cast("bigint").alias("batch"))


REVIEW_QUEUE = f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS p, count(*) OVER () AS n FROM orders),
q AS (SELECT o_orderkey::VARCHAR AS a, o_orderstatus AS s, o_orderpriority AS c, row_number() OVER (ORDER BY o_totalprice, o_orderkey::VARCHAR) AS k, count(*) OVER () AS n FROM o WHERE p <= n * 20 // 100)
SELECT 'RV-' || substr(sha256(concat_ws('|', 'company', a, s, c, 'candidate_only', 'low_margin_top20pct')), 1, 16) AS review_id, a AS article_id, {scaled_sql('1 - (k - 1) / n')} AS priority, CASE WHEN k <= n * 2 // 5 THEN 1 WHEN k <= n * 2 // 5 * 2 THEN 2 ELSE 3 END::BIGINT AS batch FROM q"""


def holdout_sides(spark, sf_dir):
    """217-220, 226, 227: sides of every order under hash-based splits and its fold."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    a = splits.key_holdout(o, "o_custkey").withColumnRenamed("side", "customer_side")
    b = splits.stratified(a, "o_orderpriority", "o_orderkey", 0.5, 42).withColumnRenamed("side", "pair_side")
    c = splits.stratified_validation(b, "o_orderpriority", "o_orderkey", 0.2, 7).withColumnRenamed("side", "label_side")
    return splits.hash_folds(c, "o_custkey", 3).select("o_orderkey", "customer_side", "pair_side", "label_side", "fold")


HOLDOUT_SIDES = """WITH c AS (SELECT o_custkey, row_number() OVER (ORDER BY sha256('42:' || o_custkey), o_custkey) <= greatest(1, floor(count(*) OVER () * 0.2)) AS held FROM (SELECT DISTINCT o_custkey FROM orders)),
o AS (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('42:' || o_orderkey), o_orderkey) AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('7:' || o_orderkey), o_orderkey) AS j FROM orders)
SELECT o_orderkey, CASE WHEN held THEN 'holdout' ELSE 'train' END AS customer_side, CASE WHEN k <= round_even(n * 0.5, 0) THEN 'calibration' ELSE 'evaluation' END AS pair_side,
  CASE WHEN n >= 2 AND j <= greatest(1, least(round_even(n * 0.2, 0), n - 1)) THEN 'validation' ELSE 'train' END AS label_side, (('0x' || substr(sha256(o_custkey::VARCHAR), 1, 8))::BIGINT % 3)::INT AS fold FROM o JOIN c USING (o_custkey)"""


def duplicate_sides(spark, sf_dir):
    """219: sides of documents whose equal texts must stay together."""
    a = articles(spark, sf_dir).withColumn("g", F.when(F.col("id") % 2 == 0, F.md5("content")))
    return splits.duplicate_holdout(a, "g", "id").select("id", "side")


DUPLICATE_SIDES = """WITH a AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'dup:' || md5(text) ELSE 'article:' || doc_id END AS g FROM documents), g AS (SELECT g, row_number() OVER (ORDER BY sha256('42:' || g), g) <= greatest(1, floor(count(*) OVER () * 0.2)) AS held FROM (SELECT DISTINCT g FROM a))
SELECT id, CASE WHEN held THEN 'holdout' ELSE 'train' END AS side FROM a JOIN g USING (g)"""


def time_sides(spark, sf_dir):
    """162, 216, 224: the first 80 percent of events in time and the most recent quarter."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 97 != 0, F.col("ts")).alias("ts"))
    r = splits.recent(e, "ts", "event_id").select("event_id", F.lit(True).alias("recent"))
    return splits.time_split(e, "ts", "event_id").join(r, "event_id", "left").select("event_id", "side", F.coalesce("recent", F.lit(False)).alias("recent"))


TIME_SIDES = """WITH e AS (SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN ts END AS ts, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts NULLS LAST, event_id) <= floor(n * 0.8) THEN 'train' ELSE 'valid' END AS side, row_number() OVER (ORDER BY ts DESC NULLS LAST, event_id DESC) <= round_even(n * 0.25, 0) AS recent FROM e"""


def group_time_sides(spark, sf_dir):
    """221-223, 225: customers wholly in history, review or future orders; straddlers dropped."""
    o = table(spark, sf_dir, "orders").withColumn("g", F.concat("o_custkey", F.lit("-"), F.year("o_orderdate").cast("string")))
    three = splits.temporal_three_way(o, "g", "o_orderdate", "o_orderkey").select("o_orderkey", F.col("side").cast("bigint").alias("three"))
    two = splits.temporal_two_way(o, "g", "o_orderdate", "o_orderkey", 0.2).select("o_orderkey", F.col("side").cast("bigint").alias("two"))
    return three.join(two, "o_orderkey")


GROUP_TIME_SIDES = """WITH o AS (SELECT o_orderkey, o_custkey || '-' || year(o_orderdate) AS g, o_orderdate AS t FROM orders), c AS (SELECT list(t ORDER BY t, o_orderkey) AS l, count(*) AS n FROM o),
k AS (SELECT l[floor(n * (1 - 0.15 - 0.15))::INT + 1] AS a, l[floor(n * (1 - 0.15))::INT + 1] AS b, l[floor(n * (1 - 0.2))::INT + 1] AS d FROM c),
s AS (SELECT o.*, CASE WHEN t >= a THEN 1 ELSE 0 END + CASE WHEN t >= b THEN 1 ELSE 0 END AS s3, CASE WHEN t >= d THEN 1 ELSE 0 END AS s2 FROM o, k)
SELECT o_orderkey, CASE WHEN min(s3) OVER (PARTITION BY g) = max(s3) OVER (PARTITION BY g) THEN s3 ELSE -1 END::BIGINT AS three, CASE WHEN min(s2) OVER (PARTITION BY g) = max(s2) OVER (PARTITION BY g) THEN s2 ELSE -1 END::BIGINT AS two FROM s"""


def backtest_tranches(spark, sf_dir):
    """228: sizes and errors of rolling history and tranche windows of events."""
    e = table(spark, sf_dir, "events")
    out = None
    for i, (h, t) in enumerate(splits.tranches(e, "ts", "event_id", [0.4, 0.6, 0.8], 0.2)):
        rate = h.groupBy("event_type").agg(F.avg("value").alias("mean"))
        one = t.join(rate, "event_type").agg(F.lit(i).cast("bigint").alias("round"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value") > F.col("mean")).alias("above"))
        out = one if out is None else out.unionByName(one)
    return out


BACKTEST_TRANCHES = """WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS p, count(*) OVER () AS n FROM events), w AS (SELECT unnest([0.4, 0.6, 0.8]::DOUBLE[]) AS w, unnest([0, 1, 2]) AS i),
m AS (SELECT i, event_type, avg(value) AS mean FROM e, w WHERE p <= floor(n * w) GROUP BY ALL)
SELECT i::BIGINT AS round, count(*) AS rows, count(*) FILTER (value > mean) AS above FROM e JOIN w ON p > floor(n * w) AND p <= floor(n * (w + 0.2)) JOIN m USING (i, event_type) GROUP BY i"""


def news_profile(spark, sf_dir):
    """75, 99, 107, 109: missing parts and flags of news by source."""
    n = news(spark, sf_dir)
    return n.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("entity") == "").alias("no_entity"), F.count_if(F.col("publish_time").isNull()).alias("undated"), F.count("polarity_label").alias("labelled"), F.count_if(F.col("duplicate_flag") == "1").alias("duplicates"))


NEWS_PROFILE = f"WITH {NEWS_SQL} SELECT source, count(*) AS rows, count(*) FILTER (entity = '') AS no_entity, count(*) FILTER (publish_time IS NULL) AS undated, count(polarity_label) AS labelled, count(*) FILTER (duplicate_flag = '1') AS duplicates FROM news GROUP BY source"


_ALL = (
    segment_profile, top_sources, length_percentiles, class_report, accuracy_report, split_coverage, flag_confusion, confusion_pairs, binary_counts, retrieval_report, routing_report, challenge_slices, margin_report, bootstrap_report,
    seed_report, weight_report, sampler_report, coverage_grid, score_margins, rank_blend, z_scores, balanced_picks, time_coverage, diverse_picks, vote_majority, margin_calibration, capped_groups, hard_cases, agent_selection, review_queue,
    holdout_sides, duplicate_sides, time_sides, group_time_sides, backtest_tranches, news_profile,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
