"""Whether evidence supports a query: terms, coverage, the key gate, what is missing.

A batch's terms meet the match forms of each (query, evidence) pair's chunk; support is
one grouped aggregate per pair. Match forms of chunks don't depend on the queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluiceway.functions import text as X
from sluiceway.operators import lexicon
from sluiceway.operators.corpus import idf
from sluiceway.session import broadcast_if_small

PLACES = 6


def _without_slips(t: DataFrame, freq: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Unknown terms that are slips of a word with content become that word (``slip``), slips of words without content go."""
    known = freq.select("term")
    synonym = t.select("term", F.explode(X.synonyms(F.col("term"))).alias("alt")).where("alt <> term").join(known.withColumnRenamed("term", "alt"), "alt", "left_semi")
    unknown = t.where(~X.is_identifier(F.col("term"))).select("term").distinct().join(known, "term", "left_anti").join(synonym, "term", "left_anti")
    best = lexicon.tied(lexicon.slips(unknown, vocabulary))
    fixed = best.select(F.col("word").alias("term"), F.forall("tied", lambda w: w.isin(*X.STOPWORDS, *X.FILLER_WORDS)).alias("empty"), F.when(F.size("tied") == 1, F.col("tied")[0]).alias("one"))
    fixed = fixed.join(known.select(F.col("term").alias("one"), F.col("term").alias("meant")), "one", "left").drop("one")
    t = t.join(broadcast_if_small(fixed), "term", "left").where(~F.coalesce("empty", F.lit(False)))
    t = t.select("query_id", "pos", F.coalesce("meant", "term").alias("term"), F.col("meant").isNotNull().alias("slip"))
    return t.groupBy("query_id", "term").agg(F.min(F.struct("pos", "slip")).alias("f")).select("query_id", "f.pos", "term", "f.slip")


def terms(queries: DataFrame, freq: DataFrame, stats: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``query_id``, ``pos``, ``term``, ``kind``, ``weight``, ``alts``: unique content words of each query in order.

    A word is an identifier, known to the corpus, a synonym of known words, or unknown;
    unknown words weigh ``ln(n+1)+1``, more than any known one. ``alts`` are the spellings
    that support it. With a ``vocabulary`` (``term``, ``df``) an unknown word that is a keyboard
    slip of just one word of the corpus is that word (kind ``typo``), and a slip of a word
    without content is none.
    """
    toks = X.content_tokens(X.tokens(X.normalize_text(F.col("query"))))
    t = queries.select("query_id", F.posexplode(F.array_distinct(toks)).alias("pos", "term"))
    t = t.withColumn("slip", F.lit(False)) if vocabulary is None else _without_slips(t, freq, vocabulary)
    t = t.withColumn("group", F.filter(X.synonyms(F.col("term")), lambda w: w != F.col("term")))
    known = freq.select("term", "df")
    t = t.join(known, "term", "left").join(F.broadcast(stats.select("n")))
    alt = t.select("query_id", "term", F.explode("group").alias("alt")).join(known.withColumnRenamed("term", "alt").withColumnRenamed("df", "alt_df"), "alt")
    alt = alt.groupBy("query_id", "term").agg(F.sort_array(F.collect_set("alt")).alias("known_alts"), F.min("alt_df").alias("alt_df"))
    t = t.join(broadcast_if_small(alt), ["query_id", "term"], "left")
    kind = F.when(F.col("slip"), "typo").when(X.is_identifier(F.col("term")), "identifier").when(F.col("df").isNotNull(), "known").when(F.col("known_alts").isNotNull(), "synonym").otherwise("unknown")
    oov = F.log(F.col("n") + 1.0) + 1.0
    weight = F.when(F.col("df").isNotNull(), idf(F.col("df"), F.col("n"))).when((kind == "synonym"), idf(F.col("alt_df"), F.col("n"))).otherwise(oov)
    forms = X.match_forms(F.array("term"))
    alts = F.when(kind == "identifier", F.array("term")).otherwise(F.array_distinct(F.concat(forms, F.coalesce("known_alts", F.array().cast("array<string>")))))
    return t.select("query_id", "pos", "term", kind.alias("kind"), F.round(weight, PLACES).alias("weight"), alts.alias("alts"))


def evidence_forms(tokens: DataFrame) -> DataFrame:
    """``chunk_id``, ``forms``: the spellings a chunk (``toks``) supports."""
    return tokens.select("chunk_id", X.match_forms(X.content_tokens(F.col("toks"))).alias("forms"))


def support(pairs: DataFrame, term_table: DataFrame, forms: DataFrame) -> DataFrame:
    """One row per (query, chunk) of ``pairs`` and term, with ``ok``, ``weight`` and ``key_rank`` (by weight, then position)."""
    ranked = term_table.withColumn("key_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "pos"))).withColumn("n_terms", F.count("*").over(Window.partitionBy("query_id")))
    found = pairs.select("query_id", "chunk_id").join(forms, "chunk_id").join(broadcast_if_small(ranked), "query_id")
    return found.select("query_id", "chunk_id", "pos", "term", "kind", "weight", "key_rank", "n_terms", F.arrays_overlap("alts", "forms").alias("ok"))


def coverage(sup: DataFrame) -> DataFrame:
    """``coverage`` (share of the weight supported), ``keys_ok`` (the heavier half all supported), ``nonkeys_ok``, ``missing`` (six at most, keys first)."""
    is_key = F.col("key_rank") <= F.ceil(F.col("n_terms") / 2)
    missing = F.transform(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("key_rank", "term")))), lambda s: s["term"])
    return sup.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.when(F.col("ok"), F.col("weight")).otherwise(0.0)) / F.sum("weight"), PLACES).alias("coverage"),
        F.every(~is_key | F.col("ok")).alias("keys_ok"),
        F.every(is_key | F.col("ok")).alias("nonkeys_ok"),
        F.concat_ws(",", F.slice(missing, 1, 6)).alias("missing"),
    )
