"""Second looks at a query: rewriting to corpus words, support by translation, by passages, by sentence vectors; contact channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluiceway.functions import text as X
from sluiceway.operators import lexicon
from sluiceway.operators.retrieve import dot
from sluiceway.session import broadcast_if_small

# Nouns that name a channel of contact, and words that offer one as a contact.
CHANNELS = {
    "email": ("email", "emails", "e-mail", "e-mails", "mail", "mailbox", "mailboxes", "inbox", "inboxes", "mail-address"),
    "phone": ("phone", "phones", "telephone", "phone-number", "mobile", "cellphone"),
}
OFFERS = ("contact", "contacts", "oncall", "on-call", "pager", "notify", "notification", "notifications")


# What follows the wh-word of a question.
AUXILIARIES = ("is", "are", "was", "were", "do", "does", "did", "can", "could", "should", "would", "will")


def known_words(frequency: DataFrame) -> DataFrame:
    """``term``, ``df``: the words of the corpus, and those without content."""
    plain = frequency.sparkSession.createDataFrame([(w,) for w in (*X.STOPWORDS, *X.FILLER_WORDS)], "term string").distinct()
    return frequency.select("term", "df").unionByName(plain.join(frequency, "term", "left_anti").select("term", F.lit(0).cast("long").alias("df")))


def fix_interrogatives(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``query_id``, ``query`` normalised, with a misspelt wh-word before an auxiliary put right ("wat is")."""
    words = queries.select("query_id", F.posexplode(F.split(X.normalize_text(F.col("query")), " ")).alias("pos", "word")).where("word <> ''")
    words = words.withColumn("next", F.lead("word").over(Window.partitionBy("query_id").orderBy("pos")))
    asked = F.col("word").rlike("^[a-z]+$") & F.col("next").isin(*AUXILIARIES) & ~F.col("word").isin(*X.WH_WORDS)
    found = lexicon.slips(words.where(asked).select(F.col("word").alias("term")), vocabulary).where(F.col("term").isin(*X.WH_WORDS)).groupBy("word").agg(F.min("term").alias("meant"))
    x = words.join(broadcast_if_small(found), "word", "left").withColumn("word", F.when(asked, F.coalesce("meant", "word")).otherwise(F.col("word")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ")
    return queries.select("query_id").join(x.groupBy("query_id").agg(said.alias("query")), "query_id", "left")


def rewrite(queries: DataFrame, vocabulary: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """``query_id``, ``rewritten``: filler and slips of filler dropped; unknown words replaced by known synonyms, else by
    the word they are a slip of, else by neighbours (``word``, ``priority``, ``like``) of the first resource that has any, else kept.

    ``vocabulary``: ``term``, ``df``. Each step is a left join of the batch's distinct unknown words.
    """
    words = queries.select("query_id", F.posexplode(F.split(X.normalize_text(F.col("query")), " ")).alias("pos", "word")).where("word <> ''")
    words = words.where(~F.col("word").isin(*X.FILLER_WORDS))
    known = vocabulary.select(F.col("term").alias("word"))
    unknown = words.where(F.col("word").rlike("^[a-z]+$")).select("word").distinct().join(known, "word", "left_anti")
    syn = unknown.select("word", F.explode(X.synonyms(F.col("word"))).alias("like")).join(known.withColumnRenamed("word", "like"), "like", "left_semi").groupBy("word").agg(F.sort_array(F.collect_set("like")).alias("by_synonym"))
    filler = F.forall("tied", lambda w: w.isin(*X.FILLER_WORDS))
    fixed = lexicon.tied(lexicon.slips(unknown.withColumnRenamed("word", "term"), vocabulary)).select("word", F.when(filler, F.array().cast("array<string>")).when(F.size("tied") == 1, F.col("tied")).alias("by_slip"))
    out = unknown.join(syn, "word", "left").join(fixed, "word", "left")
    if neighbours is not None:
        near = lexicon.first_resource(neighbours.join(known.withColumnRenamed("word", "like"), "like", "left_semi")).groupBy("word").agg(F.sort_array(F.collect_set("like")).alias("by_neighbour"))
        out = out.join(near, "word", "left")
    else:
        out = out.withColumn("by_neighbour", F.lit(None).cast("array<string>"))
    table = out.select("word", F.coalesce("by_synonym", "by_slip", "by_neighbour").alias("to")).where("to is not null")
    x = words.join(broadcast_if_small(table), "word", "left").withColumn("to", F.coalesce("to", F.array("word")))
    said = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "to"))), lambda s: s["to"])), " ")
    done = x.groupBy("query_id").agg(said.alias("rewritten"))
    return queries.select("query_id").join(done, "query_id", "left").select("query_id", F.coalesce("rewritten", F.lit("")).alias("rewritten"))


def requested_channels(query: Column) -> Column:
    """The kinds of contact that a query names."""
    words = X.tokens(X.normalize_text(query))
    words = F.array_distinct(F.concat(words, F.flatten(F.transform(words, lambda w: F.split(w, "-")))))
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.split(F.lit(" ".join(n)), " ")), k) for k, n in CHANNELS.items()]))


def channel_authorizes(query: Column, draft: Column, found: Column) -> Column:
    """Whether contact data in a draft may be shown, masked: the query names a channel of a kind that is there, there is no
    secret, and each find stands in a sentence that offers it as a contact. ``found``: array of structs (kind, value)."""
    asked = F.exists(found, lambda h: F.array_contains(requested_channels(query), h["kind"]))
    secret = F.exists(found, lambda h: h["kind"].isin("aws_key", "slack_token"))
    sentences = F.split(F.regexp_replace(draft, r"([.!?])(\s+|$)", "$1\u0001"), "\u0001")
    offers = F.split(F.lit(" ".join(OFFERS)), " ")

    def offered(h: Column) -> Column:
        own = F.filter(sentences, lambda s: F.contains(s, h["value"]))
        return F.forall(own, lambda s: F.arrays_overlap(X.tokens(X.normalize_text(s)), offers))

    return (F.size(found) > 0) & asked & ~secret & F.forall(found, offered)


def translation_support(missing: DataFrame, evidence: DataFrame, lifts: DataFrame, least: float = 4.25, most_terms: int = 1) -> DataFrame:
    """Missing words of a query that a word of the evidence answers: ``query_id``, ``chunk_id``, ``term``, ``by``, ``lift``.

    ``missing``: ``query_id``, ``chunk_id``, ``term``; ``evidence``: ``chunk_id``, ``word``; ``lifts``: ``s`` (evidence
    word), ``t`` (question word), ``lift``. All missing words of a pair must be answered, and no more than ``most_terms``.
    """
    strong = lifts.where(F.col("lift") >= least)
    hit = missing.join(broadcast_if_small(strong), missing["term"] == strong["t"]).join(evidence.withColumnRenamed("word", "s"), ["chunk_id", "s"])
    best = hit.groupBy("query_id", "chunk_id", "term").agg(F.max(F.struct(F.col("lift"), F.col("s"))).alias("b"))
    need = missing.groupBy("query_id", "chunk_id").agg(F.countDistinct("term").alias("need"))
    have = best.groupBy("query_id", "chunk_id").agg(F.count("*").alias("have"))
    ok = need.join(have, ["query_id", "chunk_id"]).where((F.col("need") == F.col("have")) & (F.col("need") <= most_terms)).select("query_id", "chunk_id")
    return best.join(ok, ["query_id", "chunk_id"], "left_semi").select("query_id", "chunk_id", "term", F.col("b.s").alias("by"), F.col("b.lift").alias("lift"))


def sentence_support(queries: DataFrame, sentences: DataFrame, least: float = 0.45) -> DataFrame:
    """``query_id``, ``chunk_id``, ``cosine``, ``supports``: the best cosine of unit vectors of a query and of an evidence's sentences.

    ``queries``: ``query_id``, ``vector``; ``sentences``: ``query_id``, ``chunk_id``, ``vector`` of the pairs in question."""
    x = sentences.withColumnRenamed("vector", "sv").join(broadcast_if_small(queries), "query_id")
    best = x.groupBy("query_id", "chunk_id").agg(F.round(F.max(dot(F.col("sv"), F.col("vector"))), 6).alias("cosine"))
    return best.withColumn("supports", F.col("cosine") >= least)


FEATURES = ("lex", "soft", "weakest", "missing", "centroid", "jaccard", "hit_frac", "soft_ge_04", "soft_ge_06", "best_mean", "len_ratio")


def passage_features(pairs: DataFrame, vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """The eleven features of each pair of word lists: ``pair`` and ``FEATURES``.

    ``pairs``: ``pair``, ``q`` and ``p`` (arrays of words); ``vectors``: ``word``, ``vector`` (unit length); ``weights``:
    ``word``, ``weight``. A missing word is credited with its best cosine among the passage's words, words without a
    vector with nothing. Pairs without question words have no row.
    """
    none = F.array().cast("array<double>")
    p0 = pairs.select("pair", F.array_distinct("q").alias("q"), F.array_distinct("p").alias("p")).where("size(q) > 0")
    vec, wt = broadcast_if_small(vectors), broadcast_if_small(weights)
    side = lambda c: p0.select("pair", F.explode(c).alias("word")).join(vec, "word", "left").join(wt, "word", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(1e-6)), F.lit(1e-6)))
    q = side("q")
    p = side("p").where("vector is not null").select("pair", F.col("word").alias("pw"), F.col("vector").alias("pv"), F.col("weight").alias("pweight"))
    hits = q.join(p0.select("pair", "p"), "pair").withColumn("hit", F.array_contains("p", F.col("word"))).drop("p")
    sims = hits.where("not hit and vector is not null").join(p, "pair").groupBy("pair", "word").agg(F.max(dot(F.col("vector"), F.col("pv"))).alias("sim"))
    credit = F.when(F.col("hit"), 1.0).otherwise(F.greatest(F.coalesce("sim", F.lit(0.0)), F.lit(0.0)))
    c = hits.join(sims, ["pair", "word"], "left").withColumn("credit", credit)
    n = F.count("*")
    per = c.groupBy("pair").agg(
        (F.sum(F.when(F.col("hit"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("lex"),
        (F.sum(F.col("weight") * F.col("credit")) / F.sum("weight")).alias("soft"),
        F.coalesce(F.min(F.when(~F.col("hit"), F.col("credit"))), F.lit(1.0)).alias("weakest"),
        (F.count_if(~F.col("hit")) / n).alias("missing"),
        F.count_if("hit").alias("hits"),
        (F.count_if("hit") / n).alias("hit_frac"),
        (F.count_if(F.col("credit") >= 0.4) / n).alias("soft_ge_04"),
        (F.count_if(F.col("credit") >= 0.6) / n).alias("soft_ge_06"),
        F.avg("credit").alias("best_mean"),
    )
    mean = lambda df, v, w, out: df.where(F.col(v).isNotNull()).select("pair", F.posexplode(F.transform(v, lambda x: x * F.col(w))).alias("k", "x")).groupBy("pair", "k").agg(F.sum("x").alias(out))
    a, b = mean(q, "vector", "weight", "x"), mean(p, "pv", "pweight", "y")
    both = a.join(b, ["pair", "k"]).groupBy("pair").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    na = a.groupBy("pair").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("na"))
    nb = b.groupBy("pair").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("nb"))
    cent = both.join(na, "pair").join(nb, "pair").select("pair", F.when(F.col("na") * F.col("nb") > 0, F.col("xy") / (F.col("na") * F.col("nb"))).alias("centroid"))
    sizes = p0.select("pair", F.size("q").alias("nq"), F.size(F.coalesce("p", none.cast("array<string>"))).alias("np"), F.greatest(F.size(F.array_union("q", F.coalesce("p", none.cast("array<string>")))), F.lit(1)).alias("nu"))
    x = per.join(sizes, "pair").join(cent, "pair", "left")
    x = x.withColumn("jaccard", F.col("hits") / F.col("nu")).withColumn("len_ratio", F.tanh(F.log((1.0 + F.col("np")) / (1.0 + F.col("nq"))))).withColumn("centroid", F.coalesce("centroid", F.lit(0.0)))
    return x.select("pair", *[F.round(f, 6).alias(f) for f in FEATURES])
