from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from millrace.llm import mixing, quality

SMALL = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    import re

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows, kept = {r["doc_id"]: r for r in docs.collect()}, None
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < len(cp.STAGES) - 1:
            assert out.columns == docs.columns
        ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        before = kept if kept is not None else Counter(rows)
        if name == "quality":
            model = quality.train(spark, SMALL, docs)
            assert ids == Counter(r["doc_id"] for r in quality.score(docs, model).filter("score >= 0.5").collect())
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
            good = [i for i, y in labels.items() if y == 1]
            assert sum(i in ids for i in good) >= 0.97 * len(good)
        elif name == "exact_dedup":
            best = {}
            for i in before:
                best[rows[i]["text"]] = max(i, best.get(rows[i]["text"], i))
            assert ids == Counter(best.values())
        elif name == "near_dedup":
            from test_near_dedup import expected

            assert ids == Counter(i for i, _, _, own in expected([(i, rows[i]["text"]) for i in before]) if own)
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
            assert ids == Counter({i: c for i, c in copies.items() if c})
            words = lambda i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i]["text"]))
            assert sum(words(i) * c for i, c in ids.items()) <= 0.6 * sum(words(i) for i in before)
        else:
            assert ids == before and out.filter("NOT exact").count() == 0
        docs, kept = out, ids


def test_run(spark):
    out = cp.run(spark, SMALL)
    assert out.columns == ["doc_id", "ids", "n_ids", "exact"] and out.count() > 0
    assert [n for n, _ in cp.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]


def test_stages_on_hard_and_no_rows(spark, hard_rows, no_rows):
    for docs in (hard_rows, no_rows):
        for name, stage in cp.STAGES[1:]:
            out = stage(spark, docs, SMALL)
            assert out.count() <= hard_rows.count() * 2
        assert cp.classify(spark, docs, SMALL).count() <= docs.count()
    assert cp.STAGES[0][1](spark, no_rows, SMALL).filter(F.lit(True)).count() == 0
