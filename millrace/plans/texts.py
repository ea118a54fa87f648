"""Queries over scalar functions and rules (inventory 2.3, 2.4, parts of 2.10 and 2.11), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import lexicon as L
from millrace.functions import rules, similarity, text
from millrace.operators.pairs import like_pairs
from millrace.plans.bindings import ARTICLES_SQL, NEWS_SQL, articles, news
from millrace.session import cut, table

SP = r"[\s\x{3000}\x{a0}\x{85}\x{2028}\x{2029}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x0b\x1c-\x1f]+"


def clean_sql(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{SP}', ' ', 'g'))"


def any_sql(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def polarity_sql(label: str, hay: str) -> str:
    return (
        f"CASE WHEN {label} IN ('{L.POSITIVE}', '{L.NEGATIVE}', '{L.NEUTRAL}') THEN {label} WHEN lower({label}) IN ('{"', '".join(L.POSITIVE_NAMES)}') THEN '{L.POSITIVE}' "
        f"WHEN lower({label}) IN ('{"', '".join(L.NEGATIVE_NAMES)}') THEN '{L.NEGATIVE}' WHEN {any_sql(hay, L.NEGATIVE_WORDS)} THEN '{L.NEGATIVE}' WHEN {any_sql(hay, L.POSITIVE_WORDS)} THEN '{L.POSITIVE}' ELSE '{L.NEUTRAL}' END"
    )


def source_sql(c: str, value) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(c, words)} THEN {value(key, name, score)}" for key, name, score, words in L.SOURCE_KINDS)


def text_normalised(spark, sf_dir):
    """35, 36, 39, 44, 45, 46, 74: cleaned texts, names, keys and identifiers of news."""
    n = news(spark, sf_dir)
    return n.select(
        "id", text.clean("content").alias("cleaned"), text.is_blank("source").alias("no_source"), text.entity_name("entity").alias("entity_name"), text.compact("content").alias("match_key"),
        text.identifier(F.concat("trading_code", F.lit(".0")), 6).alias("code"), text.source_key("source", F.sha2("content", 256)).alias("source_key"),
    )


TEXT_NORMALISED = f"""WITH {NEWS_SQL} SELECT id, {clean_sql('content')} AS cleaned, trim(source) = '' AS no_source,
  regexp_replace(entity, '({'|'.join(L.LEGAL_FORMS)})$', '') AS entity_name, regexp_replace(lower({clean_sql('content')}), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g') AS match_key,
  CASE WHEN length(trading_code) < 6 THEN lpad(trading_code, 6, '0') ELSE trading_code END AS code,
  CASE WHEN regexp_replace(lower(source), '{SP}', '', 'g') <> '' THEN regexp_replace(lower(source), '{SP}', '', 'g') ELSE 'unknown-' || substr(sha256(content), 1, 12) END AS source_key FROM news"""


def news_rules(spark, sf_dir):
    """40, 42, 47-52: polarity, keyword event, evidence sentence, stance, source kind and severity of news."""
    n = news(spark, sf_dir)
    found = rules.keyword_event("title", "content")
    return n.select("id", *(c.alias(k) for k, c in found.items()), text.polarity("polarity_label", "content").alias("polarity"), rules.stance("content").alias("stance"), rules.source_type("source").alias("source_type"), rules.source_category("source").alias("category"), rules.source_authority("source").alias("authority")).withColumn("severity", rules.severity("event_type"))


_HAY = "title || ' ' || content"
_EVENT = "CASE " + " ".join(f"WHEN {any_sql('hay', words)} THEN '{k}'" for k, words in L.EVENT_WORDS.items()) + f" ELSE '{L.NO_EVENT}' END"
_TELLING = any_sql("s", (*L.NEGATIVE_WORDS, *L.POSITIVE_WORDS))
NEWS_RULES = f"""WITH {NEWS_SQL}, h AS (SELECT * EXCLUDE (event_type), {_HAY} AS hay FROM news), e AS (SELECT *, {_EVENT} AS event_type FROM h),
s AS (SELECT *, list_filter(list_transform(regexp_extract_all({clean_sql('content')}, '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$'), lambda x: trim(x)), lambda x: x <> '') AS sentences FROM e)
SELECT id, event_type, event_type <> '{L.NO_EVENT}' AS has_event, CASE WHEN event_type <> '{L.NO_EVENT}' THEN 0.62 ELSE 0.35 END::DOUBLE AS classifier_confidence, {polarity_sql("''", 'hay')} AS event_polarity,
  substring(coalesce(list_filter(sentences, lambda s: {_TELLING} OR contains(s, event_type))[1], sentences[1], title), 1, 80) AS evidence_sentence,
  {polarity_sql("coalesce(polarity_label, '')", 'content')} AS polarity, CASE WHEN {any_sql('content', L.REFUTE_WORDS)} THEN 'refutes' WHEN {any_sql('content', L.SUPPORT_WORDS)} THEN 'supports' ELSE 'neutral' END AS stance,
  {source_sql('source', lambda k, n, s: f"'{n}'")} ELSE '{L.UNKNOWN_SOURCE}' END AS source_type, CASE WHEN trim(source) = '' THEN 'missing' ELSE {source_sql('source', lambda k, n, s: f"'{k}'")} ELSE 'other' END END AS category,
  ({source_sql('source', lambda k, n, s: str(s))} ELSE {L.UNKNOWN_SCORE} END)::DOUBLE AS authority,
  (CASE {' '.join(f"WHEN contains(event_type, '{k}') THEN {v}" for k, v in L.SEVERITY.items())} ELSE {L.DEFAULT_SEVERITY} END)::DOUBLE AS severity FROM s"""


def text_shapes(spark, sf_dir):
    """41, 43, 53, 56, 70: model text, token and gram counts and sampled slices of documents, as hashes."""
    a = articles(spark, sf_dir)
    return a.select(
        "id", F.md5(text.model_text("title", F.lit(None), "lang", "source", "content", 200)).alias("model_text"), F.size(text.tokens("title")).cast("bigint").alias("n_tokens"), F.size(text.char_grams("title")).cast("bigint").alias("n_grams"),
        F.md5(text.sampled("content", "head", 50)).alias("head"), F.md5(text.sampled("content", "head_tail", 50)).alias("head_tail"), text.choose_two("n_chars").cast("bigint").alias("pairs"),
    )


TEXT_SHAPES = f"""WITH {ARTICLES_SQL}, c AS (SELECT *, regexp_replace(title, '{SP}', '', 'g') AS packed FROM articles)
SELECT id, md5(concat_ws(' ', nullif({clean_sql('title')}, ''), nullif({clean_sql('lang')}, ''), nullif({clean_sql('source')}, ''), nullif({clean_sql('substring(content, 1, 200)')}, ''))) AS model_text,
  len(list_distinct(list_filter(regexp_split_to_array({clean_sql('title')}, '[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}]+'), lambda x: length(x) >= 2)))::BIGINT AS n_tokens,
  CASE WHEN length(packed) < 2 THEN length(packed) ELSE len(list_distinct(list_transform(range(1, length(packed)), lambda i: substring(packed, i, 2)))) END::BIGINT AS n_grams,
  md5(substring(content, 1, 50)) AS head, md5(CASE WHEN length(content) <= 50 THEN content ELSE substring(content, 1, 25) || chr(10) || right(content, 25) END) AS head_tail, (n_chars * (n_chars - 1) // 2)::BIGINT AS pairs FROM c"""


def title_pairs(spark, sf_dir):
    """57, 58, 64: different titles of a language and source that have half of their words in common, with the sizes of their overlaps; a title stands for all its documents by the smallest id."""
    titles = articles(spark, sf_dir).groupBy("lang", "source", "title").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("members"))
    rows = cut(titles.select("id", "members", F.to_json(F.array("lang", "source")).alias("kind"), "title"))  # texts are read once
    found = like_pairs(rows.select("id", "members", "kind", text.packed("title").alias("packed"), text.tokens("title").alias("words")), 0.5).withColumn("grams", similarity.gram_overlap("l_packed", "r_packed"))
    pair = text.pair_key(F.col("l_id").cast("string"), F.col("r_id").cast("string"))
    alike = (F.col("grams.either") > 0) & (2 * F.col("grams.shared") >= F.col("grams.either"))
    return found.select(pair.alias("pair"), F.col("grams.shared").alias("shared_grams"), F.col("shared").alias("shared_tokens"), alike.alias("alike"), (F.col("l_members") * F.col("r_members")).alias("documents"))


TITLE_PAIRS = f"""WITH {ARTICLES_SQL}, c AS (SELECT lang, source, title, min(id) AS id, count(*) AS n, regexp_replace(title, '{SP}', '', 'g') AS p FROM articles GROUP BY ALL),
g AS (SELECT id, n, lang, source, CASE WHEN length(p) = 0 THEN []::VARCHAR[] WHEN length(p) < 2 THEN [p] ELSE list_distinct(list_transform(range(1, length(p)), lambda i: substring(p, i, 2))) END AS g,
  list_distinct(list_filter(regexp_split_to_array({clean_sql('title')}, '[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}]+'), lambda x: length(x) >= 2)) AS t FROM c)
SELECT least(l.id::VARCHAR, r.id::VARCHAR) || '::' || greatest(l.id::VARCHAR, r.id::VARCHAR) AS pair, len(list_intersect(l.g, r.g))::BIGINT AS shared_grams, len(list_intersect(l.t, r.t))::BIGINT AS shared_tokens,
  CASE WHEN len(l.g) = 0 OR len(r.g) = 0 THEN false ELSE len(list_intersect(l.g, r.g)) / (len(l.g) + len(r.g) - len(list_intersect(l.g, r.g))) >= 0.5 END AS alike, l.n * r.n AS documents
FROM g l JOIN g r ON l.lang IS NOT DISTINCT FROM r.lang AND l.source IS NOT DISTINCT FROM r.source AND l.id < r.id
WHERE len(l.t) > 0 AND len(r.t) > 0 AND 2 * len(list_intersect(l.t, r.t)) >= len(l.t) + len(r.t) - len(list_intersect(l.t, r.t))"""


def identities(spark, sf_dir):
    """65-69: fingerprints, hashed pair ids, hash ranks and split lists of documents."""
    a = articles(spark, sf_dir)
    i = F.col("id").cast("string")
    other = (F.col("id") * 7 % 1000).cast("string")
    return a.select(
        "id", text.fingerprint("title", "content").alias("print"), text.pair_hash("lang", F.lit(1), i, other, "source", "lang").alias("pair_id"), text.hash_rank(42, "id").alias("rank"),
        F.array_join(text.split_ids(F.concat(i, F.lit(", ,"), other, F.lit("，x"))), "|").alias("ids"),
    )


IDENTITIES = f"""WITH {ARTICLES_SQL}, p AS (SELECT *, id::VARCHAR AS i, (id * 7 % 1000)::VARCHAR AS o FROM articles)
SELECT id, sha256({clean_sql('title')} || chr(10) || {clean_sql('content')}) AS print,
  'PAIR-' || substr(sha256(concat_ws('|', lang, '1', least(i, o), greatest(i, o), CASE WHEN i <= o THEN source ELSE lang END, CASE WHEN i <= o THEN lang ELSE source END)), 1, 16) AS pair_id,
  sha256('42:' || i) AS rank, i || '|' || o || '|x' AS ids FROM p"""


def corpus_fingerprint(spark, sf_dir):
    """68: one fingerprint of the whole table that doesn't depend on the order of its rows."""
    p = articles(spark, sf_dir).select(F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 15), 16, 10).cast("bigint").alias("h"))
    return p.agg(F.bit_xor("h").alias("xor"), F.count(F.lit(1)).alias("rows"))


CORPUS_FINGERPRINT = "SELECT bit_xor(('0x' || substr(sha256(doc_id::VARCHAR), 1, 15))::BIGINT) AS xor, count(*) AS rows FROM documents"


def event_gaps(spark, sf_dir):
    """60-63: the gap of each event to its user's next, as closeness classes."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").withColumn("next", F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    micros = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("next"))
    return e.select("event_id", micros.alias("micros"), similarity.within_days("ts", "next", 1).alias("within_day"), (similarity.time_close("ts", "next", 7) >= 0.9).alias("close"), (similarity.time_closeness(similarity.day_gap("ts", "next")) >= 0.5).alias("near"))


EVENT_GAPS = """WITH e AS (SELECT event_id, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS micros FROM events)
SELECT event_id, micros, coalesce(micros <= 86400000000, false) AS within_day, CASE WHEN micros IS NULL THEN 0.5 ELSE 1 - least(micros / 1e6 / 86400, 7) / 7 END >= 0.9 AS close, micros IS NOT NULL AND 1 / (1 + greatest(0, round(micros / 1e6 / 86400, 4))) >= 0.5 AS near FROM e"""


def masked_subjects(spark, sf_dir):
    """54, 55: subject names in news texts replaced, longest first, runs collapsed."""
    n = news(spark, sf_dir).withColumn("aliases", F.transform(F.array_sort(F.transform(F.array_distinct(F.filter(F.array("title", F.substring("title", 1, 2), F.lit("公司")), lambda x: F.length(x) >= 2)), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"]))
    return n.select("id", text.masked(F.concat("title", "title", F.lit("与"), "content"), "aliases", "[S]").alias("masked"))


MASKED_SUBJECTS = f"""WITH {NEWS_SQL} SELECT id, regexp_replace(replace(replace(replace(title || title || '与' || content, title, '[S]'), CASE WHEN title = '其他' THEN title ELSE substring(title, 1, 2) END, '[S]'), '公司', '[S]'), '(\\[S\\]\\s*)+', '[S]', 'g') AS masked FROM news"""


def lists_and_json(spark, sf_dir):
    """71-73, 169: merged candidate lists, trigger terms, JSON in answers and dependency states of events."""
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    a, b = F.array(t, F.lit(" view ")), F.array(F.lit("click"), t, F.lit(""))
    raw = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    state = F.when(t == "error", "required_down").when(t == "view", "fallback").otherwise("healthy")
    d = text.dependency(F.concat(t, F.lit(":"), state))
    return e.select("event_id", F.array_join(text.merged_lists(a, b, limit=3), "|").alias("merged"), F.array_join(text.trigger_terms(F.array(t, F.lit("x"), F.lit(" ok "), t)), "|").alias("terms"), F.variant_get(text.json_action(raw), "$.k", "bigint").alias("k"), d["healthy"].alias("healthy"), d["fallback_available"].alias("fallback"))


LISTS_AND_JSON = """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN CASE event_type WHEN 'view' THEN 'view|click' ELSE 'click|view' END ELSE event_type || '|view|click' END AS merged,
  event_type || '|ok' AS terms, json_extract(props, '$.k')::BIGINT AS k, event_type NOT IN ('error', 'view') AS healthy, event_type = 'view' AS fallback FROM events"""


def parsed_times(spark, sf_dir):
    """37, 38: times from several written forms and from serial days."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    serial = F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")).cast("string")
    raw = F.when(k == 0, day).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).when(k == 2, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 3, serial).otherwise("soon")
    return o.select("o_orderkey", F.date_format(text.parse_sheet_time(raw), "yyyy-MM-dd").alias("sheet"), F.date_format(text.parse_time(F.when(k == 3, F.lit(None)).otherwise(raw)), "yyyy-MM-dd").alias("plain"))


PARSED_TIMES = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS sheet, CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS plain FROM orders"""


def page_sources(spark, sf_dir):
    """46, 47: the host of every page as its source, with the number of pages."""
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    return table(spark, sf_dir, "pages").groupBy(text.source_key(host, F.sha2("url", 256)).alias("source")).agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


PAGE_SOURCES = "SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS source, count(*) AS pages, min(page_id) AS first_page FROM pages GROUP BY 1"


def alert_matrix(spark, sf_dir):
    """188, 106: the alert level of every order line by its discount, tax and flag."""
    d = F.when(F.col("l_returnflag") == "A", L.POSITIVE).when(F.col("l_returnflag") == "R", L.NEGATIVE).otherwise(L.NEUTRAL)
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("c"), (F.col("l_linenumber") / 8).alias("s"), d.alias("d"))
    return lines.groupBy(rules.alert_level("c", "s", "d").alias("level"), "d").agg(F.count(F.lit(1)).alias("n"))


ALERT_MATRIX = f"""WITH x AS (SELECT l_quantity / 50 AS c, l_linenumber / 8 AS s, CASE l_returnflag WHEN 'A' THEN '{L.POSITIVE}' WHEN 'R' THEN '{L.NEGATIVE}' ELSE '{L.NEUTRAL}' END AS d FROM lineitem),
y AS (SELECT d, c >= 0.75 AS ch, c >= 0.45 AS cm, s >= 0.65 AS sh, s >= 0.35 AS sm FROM x)
SELECT CASE WHEN d = '{L.POSITIVE}' THEN CASE WHEN ch AND sh THEN '高价值机会' WHEN cm AND sm THEN '中价值机会' ELSE '机会观察' END
  WHEN d = '{L.NEUTRAL}' THEN CASE WHEN ch AND sh THEN '高关注' WHEN cm AND sm THEN '中关注' ELSE '常规披露' END
  WHEN ch AND sh THEN '高风险' WHEN NOT cm AND sh THEN '待核实重点关注' WHEN ch AND NOT sm THEN '常规披露' WHEN cm AND sm THEN '中风险' ELSE '观察' END AS level, d, count(*) AS n FROM y GROUP BY 1, 2"""


def runtime_plans(spark, sf_dir):
    """199-201: the control plan of a runtime snapshot made of every event."""
    e = table(spark, sf_dir, "events")
    i, t = F.col("event_id"), F.col("event_type")
    dep = F.array(F.struct(F.lit("model").alias("name"), (i % 19 != 0).alias("healthy"), F.lit(True).alias("required"), (i % 2 == 0).alias("fallback_available")))
    snap = e.select("event_id", (i * 37 % 900).alias("depth"), (i % 5).cast("int").alias("workers"), F.when(t == "error", (i % 7).cast("int")).otherwise(F.lit(0)).alias("failures"), (i % 17 != 0).alias("alive"), (i % 23 != 0).alias("valid"), dep.alias("deps"), (i % 3 == 0).cast("int").alias("requests"))
    out = rules.runtime_actions("depth", "workers", "failures", "alive", "valid", "deps", "requests")
    return snap.select("event_id", *(c.alias(k) for k, c in out.items())).select("event_id", "state", F.array_join(F.transform("actions", lambda a: a["action"]), ",").alias("actions"), F.aggregate("actions", F.lit(0), lambda s, a: s + F.coalesce(a["retry_after"], F.lit(0))).cast("bigint").alias("retry_after"), "unsafe_continue")


RUNTIME_PLANS = """WITH s AS (SELECT event_id, event_id * 37 % 900 AS depth, event_id % 5 AS workers, CASE WHEN event_type = 'error' THEN event_id % 7 ELSE 0 END AS f, event_id % 17 <> 0 AS alive, event_id % 23 <> 0 AS valid, event_id % 19 <> 0 AS healthy, event_id % 2 = 0 AS fb, event_id % 3 = 0 AS req FROM events),
p AS (SELECT *, (NOT healthy AND NOT fb) OR f >= 5 OR NOT valid AS stop, depth >= 500 AND workers < 4 AND f = 0 AS up FROM s),
a AS (SELECT *, list_filter([CASE WHEN NOT alive THEN 'restart' END, CASE WHEN NOT healthy AND fb THEN 'fallback' END, CASE WHEN f >= 3 THEN 'degrade' END, CASE WHEN req THEN 'collect_evidence' END, CASE WHEN f > 0 AND f < 3 AND alive THEN 'retry' END, CASE WHEN up THEN 'scale_up' END, CASE WHEN NOT up AND depth <= 50 AND workers > 1 THEN 'scale_down' END], lambda x: x IS NOT NULL) AS planned FROM p)
SELECT event_id, CASE WHEN stop THEN 'stopped' WHEN list_contains(planned, 'restart') OR list_contains(planned, 'fallback') OR list_contains(planned, 'degrade') THEN 'degraded' ELSE 'healthy' END AS state,
  CASE WHEN stop THEN 'stop' WHEN len(planned) = 0 THEN 'continue' ELSE array_to_string(planned, ',') END AS actions,
  CASE WHEN stop OR NOT (list_contains(planned, 'restart') OR list_contains(planned, 'retry')) THEN 0 ELSE [30, 120, 300][least(greatest(f, 1), 3)] END::BIGINT AS retry_after, false AS unsafe_continue FROM a"""


QUERIES = {f.__name__: f for f in (text_normalised, news_rules, text_shapes, title_pairs, identities, corpus_fingerprint, event_gaps, masked_subjects, lists_and_json, parsed_times, page_sources, alert_matrix, runtime_plans)}
ORACLE_SQL = {k: globals()[k.upper()] for k in QUERIES}
