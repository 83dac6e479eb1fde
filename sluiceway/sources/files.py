"""Readers and writers: JSON lines with required keys, registries, limits, tables of words and vectors, traces."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "doc_id string, title string, body string, updated_at string, source_system string, tags array<string>"
QUESTIONS = (
    "id string, query string, expect_decision string, source_index int, swap string, trap string, attribute string, form string, kind string, note string, session_id string, seed_session_spent double"
)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines under an explicit schema; unknown keys are ignored. A malformed line or a missing required key
    fails the job when the line is read, naming the file and the line's text."""
    raw = spark.read.text(path).select(F.col("value"), F.input_file_name().alias("__file")).where(F.trim("value") != "")
    row = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    x = raw.select("value", "__file", F.from_json("value", schema + ", __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("r"))
    lacking = F.col("r.__bad").isNotNull()
    for k in required:
        lacking = lacking | F.get_json_object("value", f"$.{k}").isNull()
    fail = F.raise_error(F.concat(F.lit("unusable line in "), "__file", F.lit(": "), F.substring("value", 1, 200)))
    checked = x.withColumn("r", F.when(lacking, fail.cast(x.schema["r"].dataType)).otherwise(F.col("r")))
    return checked.select("r.*").drop("__bad")


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """Documents of all files, in one table."""
    return read_jsonl(spark, list(paths), DOCUMENTS, ("doc_id", "title", "body", "updated_at", "source_system"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, QUESTIONS, ("query", "expect_decision"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Planted tokens from one JSON file, an object with ``canaries`` or a bare list: ``token``, ``doc_id``; empty tokens are skipped."""
    text = "".join(r.value + "\n" for r in spark.read.text(path).collect())  # one small file
    data = json.loads(text)
    rows = data.get("canaries", []) if isinstance(data, dict) else data
    pairs = [(str(c["token"]), str(d)) for c in rows if c.get("token") for d in (c.get("doc_ids") or [""])]
    return spark.createDataFrame(pairs, "token string, doc_id string")


def read_limits(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """Per-source hours and the default from a YAML file of ``global_default_hours`` and ``sources``."""
    import yaml

    data = yaml.safe_load("\n".join(r.value for r in spark.read.text(path).collect()))
    if not isinstance(data, dict) or not isinstance(data.get("sources"), dict):
        raise ValueError(f"{path}: needs a mapping with sources")
    default = float(data.get("global_default_hours", 48))
    rows = [(str(k).strip().lower(), float(v)) for k, v in data["sources"].items()]
    if default < 0 or any(v < 0 for _, v in rows):
        raise ValueError(f"{path}: limits must not be negative")
    return spark.createDataFrame(rows, "source_system string, max_age_hours double"), default


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word v1 v2 ...`` lines as unit vectors: ``word``, ``vector``."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") > 2)
    v = F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda x: x.cast("double"))
    x = parts.select(F.element_at("p", 1).alias("word"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
    return x.select("word", F.transform("v", lambda e: F.when(norm > 0, e / norm).otherwise(e)).alias("vector"))


def write_table(df: DataFrame, path: str, *order: str) -> None:
    """A table of words, sorted within its files."""
    df.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def content_hash(df: DataFrame) -> str:
    """A digest of a table's rows in whatever order: the sum of row hashes, and their number."""
    r = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.sum("h").alias("s"), F.count("*").alias("n")).first()
    return hashlib.sha256(f"{r.s}:{r.n}".encode()).hexdigest()


def append_trace(results: DataFrame, path: str) -> None:
    """Appends results as JSON lines with the time of writing."""
    results.withColumn("ts", F.current_timestamp()).write.mode("append").json(path)
