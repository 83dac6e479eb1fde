"""The corpus side: latest deliveries, chunks, postings and statistics.

All tables here are independent of the queries: built once, they serve any batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluiceway.functions import text as X


def latest_documents(docs: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("ingested_at", "row_id")) -> DataFrame:
    """The last delivery of each document: ``max_by`` over the whole row, so partial results are combined before the
    shuffle and a document delivered very often is no hot key. Rows without a key are dropped; ties fall to the last of ``order``."""
    row = F.struct(*docs.columns)
    return docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("__r")).select("__r.*")


def chunks(docs: DataFrame, key: str = "doc_id", title: str = "title", body: str = "body", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per paragraph: ``chunk_id`` (``<doc>::p<n>``), ``doc_id``, ``pos``, ``title``, ``text``; an empty body gives its title as one chunk."""
    parts = X.paragraphs(F.coalesce(body, F.lit("")))
    parts = F.when(F.size(parts) == 0, F.array(F.coalesce(F.nullif(F.trim(F.coalesce(body, F.lit(""))), F.lit("")), title, F.lit("")))).otherwise(parts)
    out = docs.select(F.col(key).alias("doc_id"), F.coalesce(title, F.lit("")).alias("title"), *extra, F.posexplode(parts).alias("pos", "text"))
    return out.withColumn("chunk_id", F.concat_ws("::p", "doc_id", F.col("pos").cast("string")))


def evidence_text() -> F.Column:
    return F.concat_ws(" ", "title", "text")


def tokenised(chunk_table: DataFrame) -> DataFrame:
    """``chunk_id``, ``toks``: the tokens of each chunk's title and text, the source of postings and statistics."""
    return chunk_table.select("chunk_id", X.tokens(X.normalize_text(evidence_text())).alias("toks"))


def postings(tokens: DataFrame, content_only: bool = False) -> DataFrame:
    """``chunk_id``, ``term``, ``tf``, ``dl``: how often each term is in each chunk, and the chunk's length in tokens.

    The length travels with the row, so ranking needs no join for it. Counts are combined
    before the shuffle; a chunk's terms all lie in one task, so each goes out once.
    """
    t = tokens.select("chunk_id", X.content_tokens(F.col("toks")).alias("toks")) if content_only else tokens
    return t.select("chunk_id", F.size("toks").alias("dl"), F.explode("toks").alias("term")).groupBy("chunk_id", "term", "dl").agg(F.count("*").alias("tf"))


def statistics(tokens: DataFrame) -> DataFrame:
    """One row: ``n`` chunks and ``avgdl``."""
    return tokens.select(F.size("toks").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def document_frequency(post: DataFrame) -> DataFrame:
    """``term``, ``df``: a plain sum over postings, which hold a term once per chunk."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def token_frequency(tokens: DataFrame, content_only: bool = False) -> DataFrame:
    """``document_frequency`` from the tokens themselves: a chunk's distinct terms are counted within tasks before the one shuffle."""
    toks = X.content_tokens(F.col("toks")) if content_only else F.col("toks")
    return tokens.select(F.explode(F.array_distinct(toks)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def content_only(freq: DataFrame) -> DataFrame:
    """The rows of ``freq`` that ``token_frequency`` gives with ``content_only``, as whether a word has content depends on nothing but itself."""
    return freq.where(F.size(X.content_tokens(F.array("term"))) > 0)


def idf(df: F.Column, n: F.Column) -> F.Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def with_idf(freq: DataFrame, stats: DataFrame) -> DataFrame:
    """``term``, ``df``, ``idf``; ``stats`` is one row."""
    return freq.join(F.broadcast(stats.select("n"))).select("term", "df", idf(F.col("df"), F.col("n")).alias("idf"))
