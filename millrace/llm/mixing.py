"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The tree is domain, language, source. A token budget flows down it: a node's budget is
shared among its children by weight, a child never gets more than its subtree holds
(its tokens times the allowed epochs), and what it can't take is shared among its
siblings; only when all siblings are full does the rest go unspent to the ancestor's
own siblings, because the ancestor's capacity was the bound of its own share. What stands
below a weight of 0 can't be taken and counts in no ancestor's capacity.

A leaf's documents are read in epochs, each in the order of a seeded hash. It takes
whole epochs and then the longest prefix of the next one whose tokens fit the rest.
The prefix is found by radix: token sums by the hash's first byte tell the byte in
which the prefix ends, sums by the second byte narrow it, and only the documents of
that one part in 65,536 are put in order. No task so holds a leaf, however large.

All arithmetic is on integers, so it is exact: tokens of the corpus times the sum of
siblings' weights must stay below 2**63.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.session import attach, cut, small_enough, table

LEAF = ["domain", "lang", "source"]
#: Production parameters: weights (1 where none is given), the share of the corpus's tokens to take, epochs and seed.
DOMAIN_WEIGHTS = {"d0": 5, "d1": 3, "d2": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS: dict[str, int] = {}
BUDGET_SHARE = (3, 5)
EPOCHS = 2
SEED = "mix-1"


def default_domain() -> Column:
    """Sources are grouped by their trailing number modulo 3; others are of domain 'other'."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("d"), (F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) AS int)") % 3).cast("string")))


def weight_of(name: str, weights: Mapping[str, int]) -> Column:
    """The weight given for a child's name, else 1."""
    out = F.lit(1)
    for key, value in weights.items():
        out = F.when(F.col(name) == key, value).otherwise(out)
    return out.cast("bigint")


def share_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """children (parent columns, child, weight, capacity, budget of the parent) with column granted.

    Children are filled in the order of capacity per weight: one is full if its share of
    what is left reaches its capacity. All others share the rest by weight, rounded down.
    """
    children = children.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0)))
    fill = W.partitionBy(*parent).orderBy(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(0.0), child)
    here = W.partitionBy(*parent)
    before = F.sum("capacity").over(fill.rowsBetween(W.unboundedPreceding, -1))
    weight_left = F.sum("weight").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing))
    placed = children.withColumn("budget_left", F.col("budget") - F.coalesce(before, F.lit(0))).withColumn("weight_left", weight_left)
    placed = placed.withColumn("full", F.col("capacity") * F.col("weight_left") <= F.col("budget_left") * F.col("weight"))
    rest = placed.withColumn("rest", F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(here)).withColumn("rest_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(here))
    granted = F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("CASE WHEN rest_weight > 0 THEN (rest * weight) div rest_weight ELSE 0L END"))
    return rest.withColumn("granted", granted.cast("bigint")).drop("budget_left", "weight_left", "full", "rest", "rest_weight")


def allocate(leaves: DataFrame, share: tuple[int, int], epochs: int, domain_weights, lang_weights, source_weights) -> DataFrame:
    """leaves (domain, lang, source, tokens) with the granted tokens of each."""
    takes = lambda name: F.when(F.col("weight") > 0, F.col(name)).otherwise(F.lit(0))
    held = leaves.withColumn("weight", weight_of("source", source_weights)).withColumn("capacity", takes("tokens") * epochs)
    by_lang = held.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    by_lang = by_lang.withColumn("weight", weight_of("lang", lang_weights)).withColumn("capacity", takes("capacity"))
    domains = by_lang.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    domains = domains.withColumn("budget", F.expr(f"(sum(tokens) OVER () * {share[0]}) div {share[1]}")).withColumn("weight", weight_of("domain", domain_weights))
    domains = share_out(domains.withColumn("root", F.lit(0)), ["root"], "domain").select("domain", F.col("granted").alias("budget"))
    langs = by_lang.drop("tokens").join(domains, "domain")
    langs = share_out(langs, ["domain"], "lang").select("domain", "lang", F.col("granted").alias("budget"))
    sources = held.join(langs, ["domain", "lang"])
    return share_out(sources, ["domain", "lang"], "source").select(*LEAF, "tokens", "docs", "granted")


def _hash(seed: str, epoch: Column, key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def mix(docs: DataFrame, domain: Column | None = None, share=BUDGET_SHARE, epochs: int = EPOCHS, seed: str = SEED, domain_weights=DOMAIN_WEIGHTS, lang_weights=LANG_WEIGHTS, source_weights=SOURCE_WEIGHTS) -> DataFrame:
    """docs (doc_id, text, lang, source) -> doc_id, domain, lang, source, n_tokens, copies, leaf_granted, and x, a hash of the text.

    copies says how often the mix holds the document, 0 included. Tokens are runs other
    than white space. Null languages and sources form leaves named 'unknown'; a null
    text counts as empty and has no tokens: it comes with its epoch at no cost. Rows
    repeated with id and text are each read, next to each other. Equal hashes are
    ordered by doc_id.
    """
    domain = default_domain() if domain is None else domain
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(domain, F.lit("other")).alias("domain"), F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("source", F.lit("unknown")).alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n_tokens"), F.xxhash64(text).alias("x"))
    slim = cut(slim)
    total = slim.count()
    byte = lambda first: F.substring("h", first, 2)
    by_byte = slim.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("h", _hash(seed, F.col("epoch"), "doc_id"))
    sums = cut(by_byte.groupBy(*LEAF, "epoch", byte(1).alias("b1")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    leaves = allocate(sums.filter("epoch = 1").groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")), share, epochs, domain_weights, lang_weights, source_weights)
    # whole epochs, and the tokens that the epoch after them may still give
    leaves = leaves.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("granted div tokens")).otherwise(F.lit(0))).withColumn("rest", F.col("granted") - F.col("whole") * F.col("tokens")).withColumn("epoch", (F.col("whole") + 1).cast("int"))
    ordered = W.partitionBy(*LEAF, "epoch").orderBy("b1")
    running = sums.withColumn("through", F.sum("tokens").over(ordered)).withColumn("before", F.col("through") - F.col("tokens")).drop("tokens", "docs")
    edge = running.join(leaves.select(*LEAF, "epoch", "rest"), [*LEAF, "epoch"]).filter("before <= rest AND through > rest").groupBy(*LEAF).agg(F.min("b1").alias("b1"), F.min("before").alias("before"))
    leaves = cut(leaves.join(edge, LEAF, "left"))
    placed = attach(slim, leaves.withColumnRenamed("docs", "leaf_docs"), LEAF, "leaf_docs", total).withColumn("h", _hash(seed, F.col("epoch"), "doc_id"))
    placed = cut(placed.select("doc_id", "x", *LEAF, "n_tokens", F.col("granted").alias("leaf_granted"), "whole", "rest", "before", "h", F.when(F.col("whole") >= epochs, 1).when(F.col("b1").isNull(), -1).otherwise(F.when(byte(1) < F.col("b1"), -1).when(byte(1) == F.col("b1"), 0).otherwise(1)).alias("side")))
    # b1 is null where no byte's sums pass the rest: an epoch that fits whole, which only a leaf without tokens has
    inside = placed.filter("side = 0").withColumn("b2", byte(3))
    second = inside.groupBy(*LEAF, "b2").agg(F.sum("n_tokens").alias("tokens"))
    second = second.withColumn("before2", F.sum("tokens").over(W.partitionBy(*LEAF).orderBy("b2")) - F.col("tokens")).drop("tokens")
    inside = inside.join(second, [*LEAF, "b2"]).withColumn("through", F.sum("n_tokens").over(W.partitionBy(*LEAF, "b2").orderBy("h", "doc_id", "x").rowsBetween(W.unboundedPreceding, W.currentRow)))
    out = ["doc_id", *LEAF, "n_tokens", "leaf_granted", "x"]
    sure = placed.filter("side <> 0").select(*out, (F.col("whole") + F.when(F.col("side") < 0, 1).otherwise(0)).alias("copies"))
    close = inside.select(*out, (F.col("whole") + F.when(F.col("before") + F.col("before2") + F.col("through") <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    return sure.unionByName(close)


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """docs, all columns, each row as often as the mix holds it."""
    taken = mix(docs, **parameters).filter("copies > 0").groupBy(F.col("doc_id").alias("taken_id"), F.col("x").alias("taken_x")).agg(F.max("copies").alias("__copies"))
    taken = cut(taken)
    marked = docs.withColumn("__x", F.xxhash64(F.coalesce("text", F.lit(""))))
    both = marked.join(F.broadcast(taken) if small_enough(taken) else taken, F.col("doc_id").cast("bigint").eqNullSafe(F.col("taken_id")) & (F.col("__x") == F.col("taken_x")))
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_mixing(spark, sf_dir):
    """Every document and how often the production mix holds it."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "n_tokens", F.col("copies").cast("bigint").alias("copies"), "leaf_granted")


def _weights(name: str, weights: Mapping[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"


def _share(name: str, rows: str, parent: str, child: str) -> str:
    """SQL of share_out: rows has parent, child, weight, capacity and budget."""
    over = f"PARTITION BY {parent} ORDER BY capacity / weight, {child}"
    return f"""
{name}_a AS (SELECT *, budget - coalesce(sum(capacity) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bl,
             sum(weight) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM ({rows})),
{name}_b AS (SELECT *, capacity * wl <= bl * weight AS is_full FROM {name}_a),
{name}_c AS (SELECT *, budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER (PARTITION BY {parent}) AS r,
             sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS rw FROM {name}_b),
{name} AS (SELECT *, (CASE WHEN is_full THEN capacity ELSE (r * weight) // rw END)::BIGINT AS granted FROM {name}_c)"""


OP4_SQL = f"""
WITH slim AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other' ELSE 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::INT % 3)::VARCHAR END AS domain,
              coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM slim GROUP BY ALL),
{_share("ds", f"SELECT 0 AS root, domain, (sum(tokens) * {EPOCHS})::BIGINT AS capacity, ((sum(sum(tokens)) OVER () * {BUDGET_SHARE[0]}) // {BUDGET_SHARE[1]})::BIGINT AS budget, {_weights('domain', DOMAIN_WEIGHTS)} AS weight FROM leaf GROUP BY domain", "root", "domain")},
{_share("ls", f"SELECT domain, lang, (sum(tokens) * {EPOCHS})::BIGINT AS capacity, any_value(ds.granted) AS budget, {_weights('lang', LANG_WEIGHTS)} AS weight FROM leaf JOIN ds USING (domain) GROUP BY domain, lang", "domain", "lang")},
{_share("ss", f"SELECT domain, lang, source, tokens, (tokens * {EPOCHS})::BIGINT AS capacity, ls.granted AS budget, {_weights('source', SOURCE_WEIGHTS)} AS weight FROM leaf JOIN ls USING (domain, lang)", "domain, lang", "source")},
parts AS (SELECT domain, lang, source, granted, CASE WHEN tokens > 0 THEN granted // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN granted % tokens ELSE 0 END AS rest FROM ss),
ranked AS (SELECT slim.*, granted, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}|' || (whole + 1)::VARCHAR || '|' || coalesce(doc_id::VARCHAR, '')), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through
           FROM slim JOIN parts USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN through <= rest AND whole < {EPOCHS} THEN 1 ELSE 0 END)::BIGINT AS copies, granted AS leaf_granted FROM ranked
"""
