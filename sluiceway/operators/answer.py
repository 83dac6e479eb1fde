"""Extractive drafts: the sentences of the evidence that share most with the query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluiceway.functions import text as X

MIN_WORDS = 6


def draft(queries: DataFrame, evidence: DataFrame, k: int = 2) -> DataFrame:
    """``query_id``, ``draft``, ``cited``: up to ``k`` sentences of six words or more, then their documents in brackets.

    ``evidence``: ``query_id``, ``rank``, ``doc_id``, ``pos``, ``text``. Sentences go by the
    share of the query's distinct content words they hold, lead paragraphs first, then in
    order of evidence; one that comes again in other case counts once. Queries without such
    a sentence have no row.
    """
    content = lambda c: F.array_distinct(X.content_tokens(X.tokens(X.normalize_text(c))))
    q = queries.select("query_id", content(F.col("query")).alias("q"))
    s = evidence.select("query_id", "rank", "doc_id", "pos", F.posexplode(X.split_sentences(F.col("text"))).alias("n", "sentence"))
    s = s.where(F.size(F.split(F.trim("sentence"), r"\s+")) >= MIN_WORDS).join(q, "query_id")
    shared = F.size(F.array_intersect(content(F.col("sentence")), F.col("q")))
    s = s.where(shared > 0).withColumn("score", F.round(shared / F.size("q"), 6))
    order = [F.desc("score"), F.desc(F.col("pos") == 0), "rank", "n"]
    s = s.withColumn("again", F.row_number().over(Window.partitionBy("query_id", F.lower("sentence")).orderBy(*order))).where("again = 1")
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= k)
    best = s.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "sentence", "doc_id"))).alias("best"))
    cited = F.array_join(F.array_distinct(F.transform("best", lambda b: b["doc_id"])), ", ")
    said = F.array_join(F.transform("best", lambda b: b["sentence"]), " ")
    return best.select("query_id", F.concat(said, F.lit(" [sources: "), cited, F.lit("]")).alias("draft"), cited.alias("cited"))
