"""Readers of public lexicon formats, as native column expressions over text lines and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluiceway.functions import text as X

# Endings of inflected nouns and what stands for them in the base form.
NOUN_ENDINGS = (("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))
MAX_TITLE_WORDS, MAX_ANSWER_WORDS, MAX_ANSWERS = 12, 80, 2


def _data_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a lexicon file without the licence header, whose lines begin with two blanks."""
    return spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("  "))


def read_synsets(spark: SparkSession, path: str) -> DataFrame:
    """``data.noun`` lines: ``offset``, ``lemmas``, ``hypernyms`` (noun targets of ``@`` and ``@i``), ``gloss``."""
    x = _data_lines(spark, path).select(F.split(F.substring_index("value", " | ", 1), r"\s+").alias("f"), F.trim(F.regexp_extract("value", r" \| (.*)$", 1)).alias("gloss"))
    x = x.withColumn("words", F.conv(F.element_at("f", 4), 16, 10).cast("int"))
    at = lambda i: F.element_at(F.col("f"), i)
    lemmas = F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda i: F.lower(at(5 + 2 * i)))
    x = x.withColumn("n_ptr", at(5 + 2 * F.col("words")).cast("int"))
    ptr = F.when(F.col("n_ptr") > 0, F.sequence(F.lit(0), F.col("n_ptr") - 1)).otherwise(F.array().cast("array<int>"))
    first = 6 + 2 * F.col("words")
    targets = F.filter(F.transform(ptr, lambda i: F.struct(at(first + 4 * i).alias("sign"), at(first + 4 * i + 1).alias("to"), at(first + 4 * i + 2).alias("pos"))), lambda p: p["sign"].isin("@", "@i") & (p["pos"] == "n"))
    return x.select(at(1).alias("offset"), lemmas.alias("lemmas"), F.transform(targets, lambda p: p["to"]).alias("hypernyms"), "gloss")


def read_sense_index(spark: SparkSession, path: str) -> DataFrame:
    """``index.noun`` lines: ``lemma``, ``offsets`` in order of sense."""
    x = _data_lines(spark, path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    at = lambda i: F.element_at(F.col("f"), i)
    n, ptr = at(3).cast("int"), at(4).cast("int")
    return x.select(F.lower(at(1)).alias("lemma"), F.slice("f", 4 + ptr + 2 + 1, n).alias("offsets"))


def read_lemmas(spark: SparkSession, *paths: str) -> DataFrame:
    """Distinct plain words that begin the lines of index and exception files."""
    w = F.lower(F.element_at(F.split("value", " "), 1))
    return spark.read.text(list(paths)).where(~F.col("value").startswith(" ")).select(w.alias("lemma")).where(F.col("lemma").rlike("^[a-z]+$")).distinct()


def noun_bases(words: DataFrame, lemmas: DataFrame, word: str = "word") -> DataFrame:
    """``word``, ``base``, ``rule``: base forms that are lemmas, in order of the endings' table."""
    cands = [
        F.when(F.col(word).endswith(s) & (F.length(word) > len(s)), F.struct(F.lit(i).alias("rule"), F.concat(F.substring(word, F.lit(1), F.length(word) - len(s)), F.lit(r)).alias("base")))
        for i, (s, r) in enumerate(NOUN_ENDINGS)
    ]
    x = words.select(word, F.inline(F.array_compact(F.array(*cands)))).where((F.col("base") != F.col(word)) & (F.length("base") >= 3))
    x = x.join(lemmas.select(F.col("lemma").alias("base")).distinct(), "base", "left_semi")
    return x.groupBy(word, "base").agg(F.min("rule").alias("rule"))


def plain_words(c, limit: int):
    """The first ``limit`` distinct plain content words of a text, plurals folded."""
    toks = F.filter(X.content_tokens(X.tokens(X.normalize_text(c))), lambda t: t.rlike("^[a-z]+$"))
    return F.slice(F.array_distinct(F.transform(toks, X.fold_token)), 1, limit)


PAGE = "items array<struct<question_id:bigint,title:string,answers:array<struct<answer_id:bigint,score:bigint,is_accepted:boolean,body_markdown:string,content_license:string>>>>"


def read_answer_pairs(spark: SparkSession, path: str, site: str) -> DataFrame:
    """Question and answer pages: ``site``, ``qid``, ``aid``, ``license``, ``q`` and ``a`` (plain words).

    At most two answers of score one or more for each question, the accepted one first, then by score."""
    q = spark.read.schema(PAGE).option("multiLine", True).json(path).select(F.inline("items"))
    a = q.select("question_id", "title", F.inline("answers")).where("score >= 1")
    w = Window.partitionBy("question_id").orderBy(F.coalesce("is_accepted", F.lit(False)).desc(), F.desc("score"), "answer_id")
    a = a.withColumn("r", F.row_number().over(w)).where(F.col("r") <= MAX_ANSWERS)
    out = a.select(
        F.lit(site).alias("site"), F.col("question_id").alias("qid"), F.col("answer_id").alias("aid"), F.coalesce("content_license", F.lit("CC BY-SA")).alias("license"),
        plain_words(F.col("title"), MAX_TITLE_WORDS).alias("q"), plain_words(X.clean_markdown(F.col("body_markdown")), MAX_ANSWER_WORDS).alias("a"),
    )
    return out.where("size(q) > 0 and size(a) > 0")


def ranked_items(items: DataFrame, word: str, listed: str, most: int) -> DataFrame:
    """Words listed for a word by a service, with their rank in the full list: ``word``, ``like``, ``rank``."""
    x = items.select(F.col(word).alias("word"), F.posexplode(listed).alias("rank", "like"))
    return x.where((F.col("rank") < most) & F.col("like").rlike("^[a-z]{3,}$") & (F.col("like") != F.col("word"))).withColumn("rank", F.col("rank") + 1)
