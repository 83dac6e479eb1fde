"""Perturbed questions for robustness runs: misspellings, politeness, word order, like words; and swapped words as a null control.

A perturbation is a function of the seed, its kind and the question alone, so it is the
same on whatever executor it is made.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.functions import text as X
from sluiceway.operators.lexicon import _AT, next_keys
from sluiceway.session import cut

KINDS = ("typo", "polite", "word_order", "synonym")
# Polite openings.
OPENINGS = ("Hi team, ", "Sorry to bother you, but ", "Quick question: ", "I was wondering, ", "Could someone help? ")


def _typo(rng: random.Random, words: list[str]) -> list[str]:
    at = [i for i, w in enumerate(words) if len(w) > 4 and w.isalpha()]
    if not at:
        return words
    i = rng.choice(at)
    w = words[i]
    k = rng.randrange(1, len(w) - 1)
    near = [c for c in _AT if next_keys(w[k].lower(), c)]
    words = list(words)
    words[i] = rng.choice([w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:], w[:k] + (rng.choice(near) if near else w[k]) + w[k + 1 :]])
    return words


def perturb(question: str, kind: str, seed: int = 42) -> str:
    """The question perturbed; unchanged where the kind has nothing to work on."""
    rng = random.Random(f"{seed}|{kind}|{question}")
    words = question.split()
    if kind == "typo":
        return " ".join(_typo(rng, words))
    if kind == "polite":
        return rng.choice(OPENINGS) + question[:1].lower() + question[1:] if question else question
    if kind == "word_order":
        for mark in (" for ", " of ", " in "):
            head, found, tail = question.rstrip("?").rpartition(mark)
            if found:
                return f"{mark.strip().capitalize()} {tail}, {head[:1].lower() + head[1:]}" + "?" * question.endswith("?")
        return question
    if kind == "synonym":
        groups = {w: [o for o in g if o != w] for g in X.SYNONYM_GROUPS for w in g if len(g) > 1}
        at = [i for i, w in enumerate(words) if w.lower().strip("?.,!") in groups]
        if at:
            i = rng.choice(at)
            plain = words[i].lower().strip("?.,!")
            words[i] = words[i].lower().replace(plain, rng.choice(groups[plain]))
        return " ".join(words)
    raise ValueError(f"unknown kind {kind}")


def perturbed(questions: DataFrame, seed: int = 42, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Each question in each kind that changes it: the columns of ``questions`` (with ``query``), ``kind``, ``original``."""

    def run(q: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else perturb(a, b, seed) for a, b in zip(q, k)], dtype=object)

    run.__annotations__ = {"q": pd.Series, "k": pd.Series, "return": pd.Series}
    x = questions.withColumnRenamed("query", "original").withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    x = x.withColumn("query", F.pandas_udf(run, "string")("original", "kind"))
    return x.where("query <> original")


def swapped_words(questions: DataFrame, vocabulary: DataFrame, per_word: int = 1, seed: int = 42) -> DataFrame:
    """The null control: ``query_id``, ``word``, ``other``, ``query`` with a content word replaced by an unrelated one.

    The other word is the one whose salted hash follows the hash of (question, word) in a
    numbered vocabulary, so that no question meets all words. An empty lane gives way to the
    next filled one, and a word that draws itself takes the next number of its lane, or of the
    next lane: only a vocabulary of that one word leaves it without a control."""
    from pyspark.sql.window import Window

    v = vocabulary.select("term").where(F.col("term").rlike("^[a-z]{4,}$")).distinct()
    numbered = v.withColumn("no", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("term"), F.lit(64))).orderBy("term")))
    numbered = cut(numbered.withColumn("lane", F.pmod(F.xxhash64("term"), F.lit(64))))
    sizes = numbered.groupBy("lane").agg(F.max("no").alias("size"))  # 64 rows at most
    w = questions.select("query_id", "query", F.explode(F.array_distinct(X.content_tokens(X.tokens(X.normalize_text(F.col("query")))))).alias("word")).where(F.col("word").rlike("^[a-z]{4,}$"))
    if numbered.isEmpty():
        return w.select("query_id", "word", F.col("word").alias("other"), "query").limit(0)
    w = w.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(per_word))))
    hop = sizes.crossJoin(questions.sparkSession.range(64).withColumnRenamed("id", "start"))
    hop = hop.groupBy("start").agg(F.min_by(F.struct("lane", "size"), F.pmod(F.col("lane") - F.col("start"), F.lit(64))).alias("l"), F.min_by("lane", F.pmod(F.col("lane") - F.col("start") - 1, F.lit(64))).alias("after"))
    after = hop.select(F.col("start").alias("lane"), "after")
    hop = hop.select("start", "l.lane", "l.size").join(after, "lane")
    w = w.withColumn("h", F.xxhash64(F.lit(seed), "query_id", "word", "draw")).withColumn("start", F.pmod("h", F.lit(64)))
    w = w.join(F.broadcast(hop), "start").withColumn("no", (F.pmod(F.shiftright("h", 8), F.col("size")) + 1).cast("int"))
    drawn = w.join(numbered, ["lane", "no"]).select("query_id", "query", "word", "lane", "no", "size", "after", "term")
    itself = drawn.where("term = word").drop("term").withColumn("no", F.when(F.col("size") > 1, F.col("no") % F.col("size") + 1).otherwise(1).cast("int")).withColumn("lane", F.when(F.col("size") > 1, F.col("lane")).otherwise(F.col("after")))
    out = drawn.where("term <> word").select("query_id", "query", "word", "term").unionByName(itself.join(numbered, ["lane", "no"]).where("term <> word").select("query_id", "query", "word", "term"))
    return out.select("query_id", "word", F.col("term").alias("other"), F.regexp_replace(F.lower("query"), F.concat(F.lit(r"\b"), "word", F.lit(r"\b")), F.col("term")).alias("query"))
