"""Named queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm import chunking, contamination, overlap, packing, pii, residue, terms
from sluiceway.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- 1: the same question in two splits


def _questions(spark: SparkSession, base: str) -> DataFrame:
    columns = ("rec_id", "query", "split", "source")
    return table(spark, base, "case_scores").select(*columns).unionByName(table(spark, base, "eval_rows").select(*columns))


@query
def p1_found(spark: SparkSession, base: str) -> DataFrame:
    found = overlap.expand(*overlap.find_pairs(_questions(spark, base)))
    return found.select(F.least("train_rec", "other_rec").alias("rec_a"), F.greatest("train_rec", "other_rec").alias("rec_b"))


@query
def p1_coverage(spark: SparkSession, base: str) -> DataFrame:
    """Per record outside train that a train record covers to four fifths or more: its best coverage, and whether a train record asks the same."""
    pairs, members = overlap.find_overlaps(_questions(spark, base))
    best = pairs.groupBy(F.col("other_fid").alias("fid")).agg(F.max("coverage").alias("coverage"), F.max("same").alias("same"), F.count("*").alias("texts"))
    hits = members.where("split <> 'train'").join(best, "fid")
    return hits.groupBy(F.col("rec").alias("rec_id"), "split", "source").agg(F.round(F.max("coverage"), 6).alias("coverage"), F.max("same").alias("same"), F.max("texts").alias("train_texts"))


@query
def p1_report(spark: SparkSession, base: str) -> DataFrame:
    """Per split and source: its records, those that ask what a record in train asks, and how much of them is covered at best on average."""
    records = _questions(spark, base)
    pairs, members = overlap.find_pairs(records)
    best = pairs.groupBy(F.col("other_fid").alias("fid")).agg(F.max("coverage").alias("coverage"))
    hit = members.where("split <> 'train'").join(best, "fid").groupBy("rec", "split", "source").agg(F.max("coverage").alias("coverage"))
    hit = hit.groupBy("split", "source").agg(F.count("*").alias("overlapping"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))
    total = records.where("split <> 'train'").groupBy("split", "source").agg(F.count("*").alias("records"))
    hit = hit.select(F.col("split").alias("s"), F.col("source").alias("o"), "overlapping", "mean_coverage")
    return total.join(hit, (F.col("split") == F.col("s")) & F.col("source").eqNullSafe(F.col("o")), "left").select("split", "source", "records", F.coalesce("overlapping", F.lit(0)).alias("overlapping"), "mean_coverage")


# --- 2: cutting oversized texts


@query
def p2_found(spark: SparkSession, base: str) -> DataFrame:
    cut = chunking.split_oversized(table(spark, base, "ops_docs").select("row_id", "body"))
    kind = F.when(F.col("longest_run") > chunking.LIMIT, "solid").otherwise("spaced")
    return cut.where(F.size("pieces") > 1).select("row_id", kind.alias("kind"))


# white space as Unicode has it
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL["p2_found"] = f"SELECT row_id, CASE WHEN list_max(list_transform(regexp_split_to_array(body, '{_BLANK}'), lambda w: length(w))) > 1200 THEN 'solid' ELSE 'spaced' END AS kind FROM ops_docs WHERE length(body) > 1200"


@query
def p2_pieces(spark: SparkSession, base: str) -> DataFrame:
    """All pieces of all texts, oversized or not."""
    cut = chunking.split_oversized(table(spark, base, "ops_docs").select("row_id", "body"))
    return cut.select("row_id", F.inline("pieces"))


# --- 3: personal information

PERSONAL_FIELDS = (("ops_docs", "row_id", "body"), ("case_scores", "rec_id", "query"), ("case_scores", "rec_id", "reason"))


def _personal_model(spark: SparkSession, base: str) -> pii.Model:
    texts = [(table(spark, base, name), key, column) for name, key, column in PERSONAL_FIELDS]
    return pii.fit_on(texts, table(spark, base, "staff_roster"))


@query
def p3_found(spark: SparkSession, base: str) -> DataFrame:
    model = _personal_model(spark, base)
    out = None
    for name, key, column in PERSONAL_FIELDS:
        part = pii.tag(table(spark, base, name), key, column, model)
        part = part.select(F.lit(f"{name}.{column}").alias("field"), F.col(key).alias("rec_id"), "kind", "nth")
        out = part if out is None else out.unionByName(part)
    return out


@query
def p3_redacted(spark: SparkSession, base: str) -> DataFrame:
    """All texts of the three fields with placeholders for personal information."""
    model = _personal_model(spark, base)
    out = None
    for name, key, column in PERSONAL_FIELDS:
        part = pii.redact_column(table(spark, base, name).select(key, column), column, model)
        part = part.select(F.lit(f"{name}.{column}").alias("field"), F.col(key).alias("rec_id"), "redacted")
        out = part if out is None else out.unionByName(part)
    return out


# --- 4: term frequencies

TERM_FIELDS = (("ops_docs", "body"), ("case_scores", "query"))


def _terms(spark: SparkSession, base: str) -> DataFrame:
    parts = None
    for name, column in TERM_FIELDS:
        df = table(spark, base, name)
        marked = terms.mark_terms(terms.count_terms(df, column), df, column).withColumn("field", F.lit(f"{name}.{column}"))
        parts = marked if parts is None else parts.unionByName(marked)
    return parts


@query
def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return _terms(spark, base).where(F.col("mark").isNotNull()).select("field", "term", "mark")


@query
def p4_terms(spark: SparkSession, base: str) -> DataFrame:
    """Every term with its counts and mark."""
    return _terms(spark, base).select("field", "term", "occurrences", "records", "mark")


# --- 6: filling containers


@query
def p6_packed(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack(table(spark, base, "documents"), "doc_id", "text")


# --- 7: held-out items in the corpus


@query
def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return _leaks(spark, base).select("doc_id", "item_id")


@query
def p7_items(spark: SparkSession, base: str) -> DataFrame:
    """Per held-out item that leaked: how many documents hold it, and the longest run of its words."""
    return _leaks(spark, base).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("run_words").alias("longest_run"))


def _leaks(spark: SparkSession, base: str) -> DataFrame:
    return contamination.find_leaks(table(spark, base, "documents"), table(spark, base, "bench_items"))


# --- 8: template residue, filler, error pages and script notices


@query
def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return residue.find_residue(table(spark, base, "documents")).select("doc_id")


@query
def p8_kinds(spark: SparkSession, base: str) -> DataFrame:
    """The excluded documents with the kinds of evidence in each."""
    return residue.find_residue(table(spark, base, "documents")).select("doc_id", F.concat_ws(",", "kinds").alias("kinds"))


@query
def p8_corpus(spark: SparkSession, base: str) -> DataFrame:
    """The corpus without the excluded documents."""
    docs = table(spark, base, "documents")
    return docs.join(residue.find_residue(docs), "doc_id", "left_anti").select("doc_id", "source", "lang", "text")
