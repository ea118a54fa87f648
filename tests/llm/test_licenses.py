import re

import duckdb
from oracle import assert_same

from millrace.llm import licenses as lic

TEXTS = [
    "Licensed under CC BY-NC 4.0. Then CC  by, cc-by!", "This work is licensed under the GNU General Public License, version 3.", "all rights all rights reserved; ALL RIGHTS RESERVED", "cc by cc by cc by",
    "permission is hereby granted free of any charge to any person obtaining a copy of this software", "é all rights réserved", "general public", "", None, "x",
]


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df, {r["doc_id"]: r for r in lic.scan(df).collect()}


def test_base_places_equal_a_plain_search(spark):
    _, found = scanned(spark, TEXTS)
    for i, text in enumerate(TEXTS):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = sorted((k, label) for phrase, label in lic.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        assert sorted((s["start"], s["label"]) for s in found[i]["spans"] if s["base"]) == places and found[i]["n_words"] == len(words)


def test_neighbouring_diagonals_are_one_span(spark):
    _, found = scanned(spark, TEXTS)
    spans = [s for s in found[4]["spans"] if s["label"] == "mit"]
    assert len(spans) == 1 and spans[0]["start"] == 0 and spans[0]["end"] == 17 and 0.75 <= spans[0]["coverage"] < 1
    assert {s["label"] for s in found[0]["spans"]} >= {"cc-by", "cc-by-nc-4.0"}


def test_no_template_passes_for_another_license(spark):
    _, found = scanned(spark, [text for text, _ in lic.TEMPLATES])
    may = {"bsd-2-clause": {"bsd"}}  # the longer text begins with the general one
    for i, (_, label) in enumerate(lic.TEMPLATES):
        labels = {s["label"] for s in found[i]["spans"] if not s["base"]}
        assert label in labels and labels <= {label} | may.get(label, set()), (i, label, labels)


NOTICES = [
    ("Licensed under the GNU General Public License, version 3", {"gpl-3.0"}), ("licensed under the GNU General Public License version 2", {"gpl-2.0"}), ("Licensed under CC BY-NC 4.0", {"cc-by-nc-4.0"}),
    ("Licensed under CC BY-SA 4.0", {"cc-by-sa-4.0"}), ("Licensed under CC BY 4.0", {"cc-by-4.0"}), ("released under the terms of the MIT License", {"mit"}), ("licensed under the Apache License", set()),
    ("GNU Lesser General Public License, version 3", {"lgpl-3.0"}), ("the software is one of the works of the author and the copy of it in the archive", set()),
]


def test_notices_have_one_license(spark):
    _, found = scanned(spark, [t for t, _ in NOTICES])
    assert [{s["label"] for s in found[i]["spans"] if not s["base"]} for i in range(len(NOTICES))] == [labels for _, labels in NOTICES]


def test_full_texts_with_changed_words_and_other_gram_lengths(spark):
    text = " ".join("Acme" if w == "holder" else w for w in next(t for t, label in lic.TEMPLATES if label == "bsd-3-clause").split())
    full = max((t for t, label in lic.TEMPLATES if label == "mit"), key=len)
    df = spark.createDataFrame([(1, text), (2, "x y " + full.upper()), (3, "all rights reserved"), (4, "cc"), (5, None)], "doc_id long, text string")
    for k, phrases in ((2, lic.PHRASES), (3, lic.PHRASES[1:])):
        found = {r["doc_id"]: r["spans"] for r in lic.scan(df, phrases=phrases, k=k).collect()}
        assert {s["label"] for s in found[1]} == {"bsd-3-clause"} and {s["label"] for s in found[2]} == {"mit"} and [(s["start"], s["end"], s["label"]) for s in found[3]] == [(0, 3, "reserved")] and not found[4] and not found[5]
        assert max(s["end"] - s["start"] for s in found[2]) == len(full.split())


def test_sql_and_hard_rows(spark, hard_rows, no_rows):
    df, _ = scanned(spark, TEXTS * 3)
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t in enumerate(TEXTS * 3)])
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        df.write.parquet(f"{d}/documents.parquet")
        assert_same(lic.op5_license_scan(spark, d), c, lic.OP5_SQL)
    rows = lic.scan(hard_rows).collect()
    assert len(rows) == hard_rows.select("doc_id", lic.F.coalesce("text", lic.F.lit(""))).distinct().count() and all(not r["spans"] for r in rows)
    assert lic.scan(no_rows).count() == 0
