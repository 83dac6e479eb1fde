"""Misspelt words against a corpus vocabulary, neighbour tables, entities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluiceway.functions import text as X
from sluiceway.session import broadcast_if_few, cut

_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_AT = {c: (x + y / 2, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}


def next_keys(a: str, b: str) -> bool:
    """Whether two letters are neighbours on a keyboard whose rows are set off by half a key."""
    if a == b or a not in _AT or b not in _AT:
        return False
    (xa, ya), (xb, yb) = _AT[a], _AT[b]
    return abs(ya - yb) <= 1 and abs(xa - xb) <= 1


_BESIDE = {a: "".join(b for b in _AT if next_keys(a, b)) for a in _AT}


def slips_of(word: str) -> set[str]:
    """All that ``word`` may become by one slip: two letters swapped, one dropped or doubled, a neighbouring key hit instead of it or beside it."""
    out = set()
    for i, c in enumerate(word):
        head, tail = word[:i], word[i + 1 :]
        out |= {head + tail, head + c + c + tail, head + tail[:1] + c + tail[1:]}
        for k in _BESIDE.get(c, ""):
            out |= {head + k + tail, head + k + c + tail, head + c + k + tail}
    return out - {word}


def keyboard_slip(seen: str, meant: str) -> bool:
    """Whether ``seen`` is one of the slips of ``meant``."""
    return seen in slips_of(meant)


def slips(unknown: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``word``, ``term``, ``df``, ``first``, ``last``: the words of ``vocabulary`` (term, df) a keyboard slip away, and whether they share the letters at the ends.

    Words of three letters or more stand for plain words of four or more; short ones keep
    first and last letter. The slips of each word of the vocabulary are made once, and what
    is unknown meets them by equality.
    """

    def all_of(words: pd.Series) -> pd.Series:
        return words.map(lambda w: sorted(slips_of(w)))

    all_of.__annotations__ = {"words": pd.Series, "return": pd.Series}
    w = unknown.select(F.col("term").alias("word")).distinct().where(F.col("word").rlike("^[a-z]{3,}$")).join(vocabulary.select(F.col("term").alias("word")), "word", "left_anti")
    v = vocabulary.where(F.col("term").rlike("^[a-z]{4,}$")).select("term", "df", F.explode(F.pandas_udf(all_of, "array<string>")("term")).alias("word"))
    pairs = v.join(broadcast_if_few(cut(w)), "word").select("word", "term", "df").distinct()
    same = lambda f: f(F.col("word")) == f(F.col("term"))
    first, last = same(lambda c: F.substring(c, 1, 1)), same(lambda c: F.substring(c, -1, 1))
    return pairs.where((F.length("word") >= 5) | (first & last)).select("word", "term", "df", first.alias("first"), last.alias("last"))


def tied(found: DataFrame) -> DataFrame:
    """``word``, ``tied``: the best of its ``slips``: those with the same first letter, then the same last, then the most frequent."""
    best = found.withColumn("r", F.rank().over(Window.partitionBy("word").orderBy(F.col("first").cast("int").desc(), F.col("last").cast("int").desc(), F.desc("df")))).where("r = 1")
    return best.groupBy("word").agg(F.sort_array(F.collect_set("term")).alias("tied"))


def correct(unknown: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``word``, ``meant``: the one best word of ``vocabulary`` (term, df) a keyboard slip away, if there is just one."""
    return tied(slips(unknown, vocabulary)).where(F.size("tied") == 1).select("word", F.col("tied")[0].alias("meant"))


def neighbours(pairs: DataFrame, word: str, score: str, least: float, k: int, ties: str) -> DataFrame:
    """The ``k`` best entries of each word whose score is at least ``least``."""
    w = Window.partitionBy(word).orderBy(F.desc(score), ties)
    return pairs.where(F.col(score) >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_resource(tables: DataFrame, word: str = "word") -> DataFrame:
    """Of several resources' entries (``priority``) those of the first that has any."""
    best = Window.partitionBy(word)
    return tables.withColumn("__p", F.min("priority").over(best)).where(F.col("priority") == F.col("__p")).drop("__p")


def tag_clusters(pairs: DataFrame) -> DataFrame:
    """``word``, ``like``, ``n_sites``: symmetric pairs with the number of sites that list them."""
    both = pairs.select("site", F.col("tag").alias("word"), F.col("synonym").alias("like")).union(pairs.select("site", F.col("synonym"), F.col("tag")))
    return both.where("word <> like").groupBy("word", "like").agg(F.countDistinct("site").alias("n_sites"))


def two_hops(edges: DataFrame) -> DataFrame:
    """Words within two steps of a graph (``src``, ``dst``, ``weight``): ``src``, ``dst``, ``hops``, ``weight`` (the best)."""
    one = edges.where("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    step = one.select(F.col("src").alias("mid"), F.col("dst"), F.col("weight").alias("w2"))
    two = one.select("src", F.col("dst").alias("mid"), F.col("weight").alias("w1")).join(step, "mid").where("src <> dst").groupBy("src", "dst").agg(F.max(F.col("w1") + F.col("w2")).alias("weight"))
    both = one.withColumn("hops", F.lit(1)).unionByName(two.withColumn("hops", F.lit(2)))
    return both.groupBy("src", "dst").agg(F.min(F.struct("hops", -F.col("weight"))).alias("b")).select("src", "dst", F.col("b.hops").alias("hops"), (-F.col("b.col2")).alias("weight"))


def entities(docs: DataFrame, key: str, text: str, suffixes: dict[str, str]) -> DataFrame:
    """Identifiers of the texts with their kind: ``name``, ``kind``, ``records``. The last part of the name tells the kind."""
    toks = F.array_distinct(X.tokens(X.normalize_text(F.col(text))))
    e = docs.select(key, F.explode(F.filter(toks, lambda t: t.contains("-"))).alias("name"))
    kinds = F.create_map(*[F.lit(x) for kv in suffixes.items() for x in kv])
    e = e.withColumn("kind", F.try_element_at(kinds, F.element_at(F.split("name", "-"), -1))).where("kind is not null")
    return e.groupBy("name", "kind").agg(F.count("*").alias("records"))
