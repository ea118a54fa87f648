"""License scans by diagonal voting, in DataFrame operations only.

All rolling k-grams of words (k = 2) of every text are hashed and joined with the k-grams
of a fixed table of templates (a table whose size doesn't depend on the input, so it is
broadcast); the grams themselves are compared too, so a hash collision can't vote. A match
of text position i with template position j votes for the diagonal i - j. A diagonal's
votes are the set of template positions that it matches; neighbouring diagonals (words
inserted or lost) are merged, and a merged span is verified:

- it covers the share `covered` of its template's grams, and
- it holds every gram in which its template differs from a template of another label that
  would otherwise pass for it: a notice that names version 3 is never one of version 2,
  and CC BY-NC is never CC BY.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.session import documents, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases whose every exact place counts, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Notices that name public licenses, opening words and full short texts.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("gnu lesser general public license version 3", "lgpl-3.0"),
    ("gnu affero general public license version 3", "agpl-3.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("released under the mit license", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by nd 4 0", "cc-by-nd-4.0"),
    ("creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        "bsd-2-clause",
    ),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause"),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        "gpl-3.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 2 of the license or at your option any later version",
        "gpl-2.0",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
        "apache-2.0",
    ),
)
#: Words of a gram, and diagonals this near are one span.
K, NEAR = 2, 4
#: A template of more words is a full text.
FULL_TEXT = 40
#: Share of a template's grams that a span must cover for its label; phrases must be covered whole.
COVERED = 0.75


def grams_of(text: str, k: int = K) -> list[tuple[int, str]]:
    """The grams of a template that vote, with their positions: in a full text not those of short words alone, which all prose holds."""
    words = text.split()
    if len(words) < k:
        raise ValueError(f"a template has {k} words at least: {text}")
    grams = [(j, " ".join(words[j : j + k])) for j in range(len(words) - k + 1)]
    return [(j, g) for j, g in grams if len(words) <= FULL_TEXT or any(len(w) > 3 for w in g.split())]


def needed(templates, k: int = K, covered: float = COVERED) -> list[list[int]]:
    """For each template the positions of grams that a span must hold: those in which it differs from templates of other labels that share `covered` of its grams."""
    grams = [grams_of(text, k) for text, _ in templates]
    out = []
    for own, (_, label) in zip(grams, templates):
        places: set[int] = set()
        for other, (_, theirs) in zip(grams, templates):
            if theirs != label:
                known = {g for _, g in other}
                differing = [j for j, g in own if g not in known]
                if len(own) - len(differing) >= covered * len(own):
                    places |= set(differing)
        out.append(sorted(places))
    return out


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES, k: int = K, covered: float = COVERED) -> DataFrame:
    """(t, base, label, total, need, j, mark): a row per gram of each phrase (base) and template, and one that every text matches (t = -1)."""
    rows = [(-1, False, "", 1, [], 0, "")]
    for t, ((text, label), need) in enumerate(zip((*phrases, *templates), [[]] * len(phrases) + needed(templates, k, covered))):
        own = grams_of(text, k)
        rows += [(t, t < len(phrases), label, len(own), need, j, g) for j, g in own]
    return spark.createDataFrame(rows, "t int, base boolean, label string, total int, need array<int>, j int, mark string")


def rolling(words: str, k: int) -> Column:
    """All k consecutive words of an array column, joined by spaces."""
    if k == 2:  # without the first words of a text that has one word
        return F.zip_with(words, F.expr(f"slice({words}, 2, size({words}))"), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))), lambda i: F.array_join(F.slice(F.col(words), i + 1, F.lit(k)), " "))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, covered: float = COVERED, k: int = K) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, spans (array of start, end, label, base, coverage by start).

    start and end are word numbers, end exclusive. One row per distinct (doc_id, text):
    repeated rows are one document, an id with two texts gives two rows. A null text
    counts as empty; a text of less than k words has no spans. Templates may have any
    number of words from k on. Ties between templates keep every label.
    """
    known = template_grams(docs.sparkSession, phrases, templates, k, covered)
    marks = F.broadcast(known.select("t", "j", "mark", "base", F.xxhash64("mark").alias("h")))
    about = F.broadcast(known.groupBy("t").agg(*(F.first(c).alias(c) for c in ("label", "total", "need"))))
    words = documents(docs).select("doc_id", F.xxhash64("text").alias("x"), F.array_remove(F.split(F.translate("text", UPPER, LOWER), SEPARATORS), "").alias("words"))
    grams = words.select("doc_id", "x", F.size("words").cast("bigint").alias("n_words"), F.concat(F.array(F.lit("")), rolling("words", k)).alias("grams"))
    # the first element is the mark that every text matches, so word i is at place i + 1
    places = grams.select("doc_id", "x", "n_words", F.posexplode("grams").alias("i", "gram"))
    votes = places.join(marks, (F.xxhash64(F.col("gram")) == F.col("h")) & (F.col("gram") == F.col("mark")))
    votes = votes.select("doc_id", "x", "n_words", "t", "base", (F.col("i") - 1 - F.col("j")).alias("diagonal"), "j", "i")
    key = ["doc_id", "x", "n_words"]
    votes = votes.repartition("doc_id", "x")  # the one shuffle: all that follows is within a text
    lines = votes.groupBy(*key, "t", "base", "diagonal").agg(F.collect_set("j").alias("js"), (F.min("i") - 1).alias("first"), F.max("i").alias("last"))
    by_line = W.partitionBy(*key, "t").orderBy("diagonal")
    apart = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(by_line) > NEAR), 1).otherwise(0)
    merged = lines.withColumn("apart", apart).withColumn("span", F.sum("apart").over(by_line))
    spans = merged.groupBy(*key, "t", "base", "span").agg(F.array_distinct(F.flatten(F.collect_list("js"))).alias("js"), F.min("first").alias("start"), F.max("last").alias("last")).join(about, "t")
    coverage = F.size("js") / F.col("total")
    passes = (F.col("t") >= 0) & (coverage >= F.when(F.col("base"), 1.0).otherwise(covered)) & (F.size(F.array_except("need", "js")) == 0)
    kept = F.when(passes, F.struct(F.col("start").cast("bigint").alias("start"), (F.col("last") + k - 1).cast("bigint").alias("end"), "label", "base", coverage.alias("coverage")))
    return spans.groupBy(*key).agg(F.sort_array(F.collect_list(kept)).alias("spans")).select("doc_id", "n_words", "spans")


def op5_license_scan(spark, sf_dir):
    """Every document's license phrases and labels."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"), F.array_max(F.transform(base, lambda s: s["start"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


def _values() -> str:
    need = [[]] * len(PHRASES) + needed(TEMPLATES)
    return ", ".join(f"({t}, {str(t < len(PHRASES)).lower()}, '{label}', {len(grams_of(text))}, {[list(g) for g in zip(*grams_of(text))][0]}, {[g for _, g in grams_of(text)]}, {need[t]}::INT[])" for t, (text, label) in enumerate((*PHRASES, *TEMPLATES)))


OP5_SQL = f"""
WITH templates(t, base, label, total, places, pairs, need) AS (VALUES {_values()}),
marks AS (SELECT t, base, label, total, need, unnest(places) AS j, unnest(pairs) AS pair FROM templates),
texts AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
grams AS (SELECT doc_id, text, i - 1 AS i, w[i] || ' ' || w[i + 1] AS pair FROM words, unnest(range(1, len(w))) AS u(i)),
lines AS (SELECT doc_id, text, t, base, label, total, need, i - j AS diagonal, list(DISTINCT j) AS js, min(i) AS first
          FROM grams JOIN marks USING (pair) GROUP BY ALL),
apart AS (SELECT *, CASE WHEN base OR diagonal - lag(diagonal) OVER w > {NEAR} THEN 1 ELSE 0 END AS a FROM lines WINDOW w AS (PARTITION BY doc_id, text, t ORDER BY diagonal)),
merged AS (SELECT *, sum(a) OVER (PARTITION BY doc_id, text, t ORDER BY diagonal) AS span FROM apart),
spans AS (SELECT doc_id, text, t, base, label, total, need, span, list_distinct(flatten(list(js))) AS js, min(first) AS start FROM merged GROUP BY doc_id, text, t, base, label, total, need, span),
kept AS (SELECT *, len(js) / total AS coverage FROM spans WHERE len(js) / total >= CASE WHEN base THEN 1 ELSE {COVERED} END AND list_has_all(js, need))
SELECT words.doc_id, len(any_value(w))::BIGINT AS n_words, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
       coalesce(max(coverage), 0.0)::DOUBLE AS score
FROM words LEFT JOIN kept ON words.doc_id IS NOT DISTINCT FROM kept.doc_id AND words.text = kept.text GROUP BY words.doc_id, words.text
"""
