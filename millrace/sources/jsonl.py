"""JSON sources and sinks: validated JSON lines, event taxonomies, profiles, reports and ledgers."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions import text

#: Tables that are kept as JSON lines.
TABLES = {"edges": schemas.EDGE, "routes": schemas.ROUTE, "recalls": schemas.RECALL, "pairs": schemas.PAIR, "feedback": schemas.FEEDBACK, "review_queue": schemas.REVIEW_ITEM, "human_reviews": schemas.HUMAN_REVIEW, "skills": schemas.SKILL}


def read_lines(spark: SparkSession, path: str, kind: str, limit: int | None = None) -> DataFrame:
    """A JSON-lines table of a known kind; a line that doesn't fit its schema is an error. limit takes the first ones by place."""
    rows = spark.read.schema(TABLES[kind]).option("mode", "FAILFAST").json(path)
    return rows if limit is None else rows.limit(limit)


def read_metrics(path: str) -> dict[str, float]:
    """A flat document of names and numbers."""
    return {str(k): float(v) for k, v in json.loads(Path(path).read_text(encoding="utf-8")).items()}


def read_taxonomy(spark: SparkSession, company: str | None = None, industry: str | None = None) -> DataFrame:
    """Event definitions of companies and industries, a row each; blank event names are dropped."""
    event = "event_schema array<struct<event_name:string,description:string>>"
    parts = []
    if company:
        rows = spark.read.schema(f"company struct<trading_code:string,secu_abbr:string>, {event}").option("multiLine", True).json(company)
        parts.append(rows.select(F.lit("company").alias("scope"), text.identifier("company.trading_code", 6).alias("subject_code"), text.clean("company.secu_abbr").alias("subject_name"), F.explode("event_schema").alias("e")))
    if industry:
        rows = spark.read.schema(f"industry struct<inducode:string,induname:string>, {event}").option("multiLine", True).json(industry)
        parts.append(rows.select(F.lit("industry").alias("scope"), text.identifier("industry.inducode").alias("subject_code"), text.clean("industry.induname").alias("subject_name"), F.explode("event_schema").alias("e")))
    if not parts:
        return spark.createDataFrame([], schemas.EVENT_DEFINITION)
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("scope", "subject_code", "subject_name", text.clean("e.event_name").alias("event_name"), text.clean("e.description").alias("description")).filter("event_name <> ''")


def key_profile(documents: DataFrame, column: str) -> DataFrame:
    """How often each top-level key stands in a column of JSON texts, and its kinds of values."""
    parsed = documents.select(F.try_parse_json(column).alias("v")).filter("v IS NOT NULL")
    entries = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(F.schema_of_variant("value"))), ",").alias("kinds"))


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row, in as many files as df has partitions; nulls are kept out."""
    df.write.mode("overwrite").json(path)


def write_document(df: DataFrame, path: str) -> dict:
    """A one-row aggregate as a readable document on the driver; what was written."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a document is made of exactly one row")
    content = rows[0].asDict(recursive=True)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(content, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    return content


def append_rows(df: DataFrame, path: str, stamp: str | None = None) -> None:
    """Append to a ledger that never overwrites; with stamp, a column of that name tells when."""
    (df if stamp is None else df.withColumn(stamp, F.current_timestamp())).write.mode("append").parquet(path)


def write_run(folder: str, tables: dict[str, DataFrame], ledger: str | None = None) -> None:
    """All tables of a run under one folder; lifecycles get their next version from the ledger first, and are appended to it."""
    from millrace.operators.learning import latest
    from millrace.operators.pairs import carried_versions
    from millrace.session import cut

    for name, df in tables.items():
        if name == "lifecycles" and ledger is not None:
            spark = df.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
            known = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
            held = latest(spark.read.parquet(ledger), "cluster_id", "version", "ledger_recorded_at") if known else df.sparkSession.createDataFrame([], "cluster_id long, version int, created_at timestamp")
            df = cut(carried_versions(df, held))
            append_rows(df, ledger, "ledger_recorded_at")
        df.write.mode("overwrite").json(f"{folder}/{name}")


def export_skills(skills: DataFrame, folder: str) -> None:
    """A folder per active skill with its JSON."""
    skills.filter("status = 'active'").withColumn("skill", F.col("skill_id")).write.mode("overwrite").partitionBy("skill").json(folder)


def profile_report(title: str, facts: dict, tables: dict[str, Iterable[tuple]]) -> str:
    """Markdown of collected facts and small tables."""
    lines = [f"# {title}", "", *(f"- {k}: {v}" for k, v in facts.items())]
    for name, rows in tables.items():
        rows = [tuple(r) for r in rows]
        lines += ["", f"## {name}"]
        if rows:
            lines += ["| " + " | ".join(map(str, r)) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def evaluation_report(title: str, rows: DataFrame, labels: list) -> str:
    """Markdown of a split's classification: accuracy, per-class counts and the confusion matrix (as many rows as labels)."""
    from millrace.operators import metrics

    total = metrics.classification(rows).first().asDict()
    classes = [("label", "support", "tp", "fp", "fn"), *metrics.per_class(rows).orderBy("label").select("label", "support", "tp", "fp", "fn").collect()]
    matrix = metrics.confusion_matrix(rows, labels).orderBy("truth")
    return profile_report(title, total, {"classes": classes, "confusion": [matrix.columns, *matrix.collect()]})
