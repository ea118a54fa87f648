"""Classifiers as Spark ML pipelines over character n-grams and vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import IDF, IndexToString, Normalizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import lexicon as L
from millrace.functions.similarity import title_similarity
from millrace.operators.metrics import binary, class_weights
from millrace.operators.ranking import best_threshold
from millrace.operators.splits import stratified
from millrace.session import cut, dimension

#: Hashed features of the n-grams.
FEATURES = 1 << 15


#: Bytes of text whose n-grams are counted at once.
PIECE = 1 << 20


def _gram_counter(place: int, low: int, high: int, features: int, most: int):
    """A function of Arrow batches that puts in the place of the texts in a column the counts of their hashed n-grams, as sparse vectors at the end."""

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        def mixed(k):
            k = k * np.uint32(0xCC9E2D51)
            return ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)

        def turned(h):
            return ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)

        def murmur(words, start, length):
            """Of the bytes from start, all of one length: MurmurHash3 (32 bits, seed 42), as HashingTF has it."""
            h = np.full(len(start), 42, np.uint32)
            for i in range(0, length - 3, 4):
                h = turned(h ^ mixed(words[start + i]))
            if length % 4:
                h ^= mixed(words[start + length // 4 * 4] & np.uint32((1 << 8 * (length % 4)) - 1))
            h ^= np.uint32(length)
            h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            return (h ^ (h >> np.uint32(16))).view(np.int32)

        def grams(data):
            """(first byte, feature) of the n-grams in texts of words with single spaces around; between two texts there are two spaces, which no n-gram spans."""
            raw = np.frombuffer(data + bytes(4), np.uint8)
            wide = raw.astype(np.uint32)
            words = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
            words = np.concatenate([words, np.zeros(4 * high, np.uint32)])
            starts = np.append(np.flatnonzero((raw[: len(data)] & 0xC0) != 0x80), len(data))
            space = raw[starts[:-1]] == 32
            at, found = [], []
            for n in range(2, high + 1):
                count = len(space) - n + 1
                if count < 1:
                    break
                inside = np.zeros(count, bool)
                for i in range(1, n - 1):
                    inside |= space[i : i + count]
                both = space[:count] & space[n - 1 :]
                # a word that with its spaces is shorter than an n-gram stands for it as a whole
                repeats = [(~inside if n > 2 else ~both, 1 if n >= low else 0), (~inside & both if n > 2 else None, sum(n < k for k in range(low, high + 1)))]
                for chosen, times in repeats:
                    if chosen is None or not times:
                        continue
                    i = np.flatnonzero(chosen)
                    first, length = starts[i], starts[i + n] - starts[i]
                    for size in np.unique(length).tolist():
                        here = first[length == size]
                        hashed = np.mod(murmur(words, here, size), features)
                        at += [here] * times
                        found += [hashed] * times
            return (np.concatenate(at), np.concatenate(found)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def pieces(data):
            """A long text cut at spaces, which both sides keep."""
            while len(data) > most and (cut := data.find(b" ", most)) not in (-1, len(data) - 1):
                yield data[: cut + 1]
                data = data[cut:]
            yield data

        def vectors(texts):
            if len(texts) == 1:
                total = sum(np.bincount(grams(x)[1], minlength=features) for x in pieces(texts[0]))
                index = np.flatnonzero(total)
                counts, each = total[index], np.array([len(index)])
            else:
                ends = np.cumsum([len(x) for x in texts])
                at, feature = grams(b"".join(texts))
                keys, counts = np.unique(np.searchsorted(ends, at, side="right") * features + feature, return_counts=True)
                index, each = keys % features, np.bincount(keys // features, minlength=len(texts))
            offsets = pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (index.astype(np.int32), counts.astype(np.float64))]
            return pa.StructArray.from_arrays([pa.array(np.zeros(len(texts), np.int8)), pa.array(np.full(len(texts), features, np.int32)), *lists], ["type", "size", "indices", "values"])

        for batch in batches:
            texts, first, held = [], 0, 0
            columns = [c for i, c in enumerate(batch.columns) if i != place]
            names = [c for i, c in enumerate(batch.schema.names) if i != place]
            for i, text in enumerate(batch.column(place)):
                texts.append(text.as_py().encode("utf-8"))
                held += len(texts[-1])
                if held >= most or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in columns), vectors(texts)], [*names, "tf"])
                    texts, first, held = [], i + 1, 0

    return counted


def gram_counts(df: DataFrame, column: str, low: int = 2, high: int = 4) -> DataFrame:
    """df with `tf`: how often each hashed character n-gram is in the text, within words, each padded by a space on both sides."""
    said = F.trim(F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"(?U)\s+", " "))
    spaced = df.withColumn("__said", F.concat(F.lit(" "), said, F.lit(" ")))
    schema = T.StructType([*df.schema.fields, T.StructField("tf", VectorUDT())])
    return spaced.mapInArrow(_gram_counter(len(df.columns), low, high, FEATURES, PIECE), schema)


def classifier(algorithm: str):
    if algorithm == "logistic":
        return LogisticRegression(featuresCol="features", labelCol="index", weightCol="weight", maxIter=15, tol=1e-4, regParam=1e-3)
    if algorithm == "svc":
        return OneVsRest(classifier=LinearSVC(maxIter=20, regParam=1e-3), featuresCol="features", labelCol="index")
    if algorithm == "boosted":
        return OneVsRest(classifier=GBTClassifier(maxIter=5, maxDepth=3), featuresCol="features", labelCol="index")
    raise ValueError(f"no such algorithm: {algorithm}")


def text_model(train: DataFrame, column: str, label: str, algorithm: str = "logistic", domain: DataFrame | None = None):
    """A fitted model of hashed n-gram TF-IDF and a linear or boosted classifier; classes weigh the same.

    domain adds unlabelled texts to those that the IDF is learned from. With one class
    there is no model, and predicted() answers that class.
    """
    counted = lambda df: gram_counts(df, column)
    labelled = cut(counted(train.filter(F.col(label).isNotNull()).select(column, label)).select(label, "tf"))  # read several times
    kinds = labelled.select(label).distinct().limit(2).collect()
    if len(kinds) < 2:
        return {"stages": None, "constant": kinds[0][0] if kinds else None, "column": column}
    corpus = labelled.select("tf") if domain is None else labelled.select("tf").unionByName(counted(domain).select("tf"))
    weights = class_weights(labelled, label).select(label, "weight")
    prepared = labelled.join(dimension(weights), label)  # a row per label
    index = StringIndexer(inputCol=label, outputCol="index").fit(prepared)
    fitted = Pipeline(stages=[IDF(inputCol="tf", outputCol="idf").fit(corpus), Normalizer(inputCol="idf", outputCol="features"), index, classifier(algorithm)]).fit(prepared)
    idf, normal, _, last = fitted.stages
    return {"stages": (idf, normal, last), "constant": None, "column": column, "labels": list(index.labels)}


def predicted(fitted: dict, rows: DataFrame) -> DataFrame:
    """rows with `predicted` and `confidence` (the largest probability; null where the algorithm has none)."""
    if fitted["stages"] is None:
        return rows.withColumn("predicted", F.lit(fitted["constant"])).withColumn("confidence", F.lit(1.0))
    out = gram_counts(rows, fitted["column"])
    for stage in fitted["stages"]:
        out = stage.transform(out)
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=fitted["labels"]).transform(out)
    best = F.array_max(vector_to_array("probability")) if "probability" in named.columns else F.lit(None).cast("double")
    return named.withColumn("confidence", best).select(*rows.columns, "predicted", "confidence")


def event_predictions(rows: DataFrame) -> DataFrame:
    """predicted labels as events: those that mean no event aren't one."""
    return rows.withColumn("has_event", F.col("predicted").isNotNull() & ~F.col("predicted").isin(*L.NO_EVENT_LABELS)).withColumn("event_type", F.coalesce("predicted", F.lit(L.NO_EVENT)))


def linear_probe(train: DataFrame, rows: DataFrame, vector: str, label: str) -> DataFrame:
    """rows with `predicted`: balanced logistic regression on vectors."""
    weights = class_weights(train, label).select(label, "weight")
    as_vector = lambda df: df.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    index = StringIndexer(inputCol=label, outputCol="index").fit(train)
    model = LogisticRegression(featuresCol="features", labelCol="index", weightCol="weight", maxIter=50, regParam=1e-3).fit(index.transform(as_vector(train.join(dimension(weights), label))))
    return IndexToString(inputCol="prediction", outputCol="predicted", labels=list(index.labels)).transform(model.transform(as_vector(rows))).select(*rows.columns, "predicted")


def reranked(calibration: DataFrame, validation: DataFrame, external: DataFrame) -> tuple[float, DataFrame]:
    """A logistic model of a pair's title similarity, cosine and time closeness: the threshold chosen on validation, and external with `score`.

    Frames: (pair_id, left_title, right_title, cosine, closeness, label).
    """
    shaped = lambda df: VectorAssembler(inputCols=["title", "cosine", "closeness"], outputCol="features").transform(df.withColumn("title", title_similarity("left_title", "right_title")))
    model = LogisticRegression(featuresCol="features", labelCol="label", maxIter=300).fit(shaped(calibration))
    score = lambda df: model.transform(shaped(df)).withColumn("score", F.element_at(vector_to_array("probability"), 2)).select(*df.columns, "score")
    found = best_threshold(score(validation), "score", "label").first()
    return float(found["threshold"]), score(external)


def reranker_stability(train: DataFrame, external: DataFrame, cosine_threshold: float, seeds: list[int], ratio: float = 0.5, least_gain: float = 0.01) -> dict:
    """The reranker over several splits of train against a plain cosine threshold: F1, gains, thresholds and whether it is worth using.

    It is if the mean gain is large enough, no seed loses, and none is less precise.
    """
    base = binary(external, "cosine", "label", cosine_threshold).first()
    runs = []
    for seed in seeds:
        sides = cut(stratified(train, "label", "pair_id", ratio, seed))
        threshold, scored = reranked(sides.filter("side = 'calibration'").drop("side"), sides.filter("side = 'evaluation'").drop("side"), external)
        m = binary(scored, "score", "label", threshold).first()
        runs.append({"seed": seed, "threshold": threshold, "f1": m["f1"], "gain": m["f1"] - base["f1"], "precision": m["precision"]})
    gains = [r["gain"] for r in runs]
    worth = sum(gains) / len(gains) >= least_gain and min(gains) >= 0 and all(r["precision"] >= base["precision"] for r in runs)
    return {"runs": runs, "mean_f1": sum(r["f1"] for r in runs) / len(runs), "mean_gain": sum(gains) / len(gains), "min_gain": min(gains), "recommended": worth}


def log_count_ratio(rows: DataFrame, terms: str, label: str, smoothing: float = 1.0) -> DataFrame:
    """(term, ratio): the log ratio of a term's smoothed frequencies in rows of label 1 and 0."""
    each = rows.select(F.explode(F.array_distinct(terms)).alias("term"), F.col(label).alias("y")).groupBy("term").agg((F.sum(F.col("y").cast("bigint")) + smoothing).alias("p"), (F.sum(1 - F.col("y").cast("bigint")) + smoothing).alias("q"))
    total = each.agg(F.sum("p").alias("ps"), F.sum("q").alias("qs"))
    return each.crossJoin(total).select("term", F.log((F.col("p") / F.col("ps")) / (F.col("q") / F.col("qs"))).alias("ratio"))  # total is one row


def pseudo_policy(rows: DataFrame, policies: list[str], precision: float, support: int) -> DataFrame:
    """rows (margin, hit, one boolean column per policy): of each policy the smallest margin that is precise enough."""
    from millrace.operators.ranking import margin_threshold

    out = None
    for p in policies:
        one = margin_threshold(rows.filter(F.col(p)), "margin", "hit", precision, support).select(F.lit(p).alias("policy"), "*")
        out = one if out is None else out.unionByName(one)
    return out
