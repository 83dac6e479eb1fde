"""Ranking a batch of queries against all chunks, as joins over (query, term, chunk).

A query's terms meet postings on the term, so only chunks that share a word are touched;
the (small) query side is broadcast when its size allows, and then postings aren't
shuffled at all and a term held by every chunk is no hot key. Scores are rounded to six
places before ranking and ties fall to the chunk id, which makes ranks reproducible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluiceway.config import EngineConfig
from sluiceway.functions import text as X
from sluiceway.operators.corpus import idf
from sluiceway.session import BROADCAST_LIMIT_BYTES, broadcast_if_few, broadcast_if_small, cut, plan_bytes

PLACES = 6


def query_terms(queries: DataFrame, content_only: bool = False) -> DataFrame:
    """``query_id``, ``term``, ``qtf``: terms of each query with their number."""
    toks = X.tokens(X.normalize_text(F.col("query")))
    if content_only:
        toks = X.content_tokens(toks)
    return queries.select("query_id", F.explode(toks).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25(queries: DataFrame, post: DataFrame, freq: DataFrame, stats: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """``query_id``, ``chunk_id``, ``bm25`` for all pairs that share a term; repeated query terms count as often."""
    q = query_terms(queries)
    q = broadcast_if_small(q.join(freq, "term"))
    k1, b = cfg.k1, cfg.b
    hit = post.join(q, "term").join(F.broadcast(stats))
    part = F.col("qtf") * idf(F.col("df"), F.col("n")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), PLACES).alias("bm25"))


def term_weights(freq: DataFrame, stats: DataFrame) -> DataFrame:
    """``term``, ``w``: the smoothed inverse document frequency."""
    w = F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    return freq.join(F.broadcast(stats.select("n"))).select("term", w.alias("w"))


def chunk_norms(post: DataFrame, freq: DataFrame, stats: DataFrame) -> DataFrame:
    """``chunk_id``, ``dn``: the length of each chunk's TF-IDF vector, whatever is asked.

    ``freq`` must be written already: it is sent to where the postings are if it is counted to be small enough, and then postings aren't
    shuffled by their skewed terms; beyond, the join is Spark's own."""
    d = post.join(broadcast_if_few(term_weights(freq, stats)), "term")
    return d.groupBy("chunk_id").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("w"), F.lit(2.0)))).alias("dn"))


def tfidf_cosine(queries: DataFrame, post: DataFrame, freq: DataFrame, stats: DataFrame, norms: DataFrame | None = None) -> DataFrame:
    """``query_id``, ``chunk_id``, ``cosine`` of smoothed TF-IDF vectors; terms that no chunk holds don't count.

    Of the postings only those of asked terms are joined. ``norms``: those of ``chunk_norms``, where they are at hand."""
    norms = chunk_norms(post, freq, stats) if norms is None else norms
    q = cut(query_terms(queries).join(term_weights(freq, stats), "term").select("query_id", "term", "w", (F.col("qtf") * F.col("w")).alias("qw")))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    hit = post.join(broadcast_if_few(q), "term")
    dots = hit.groupBy("query_id", "chunk_id").agg(F.sum(F.col("tf") * F.col("w") * F.col("qw")).alias("dot"))
    return dots.join(norms, "chunk_id").join(qn, "query_id").select("query_id", "chunk_id", F.round(F.col("dot") / (F.col("dn") * F.col("qn")), PLACES).alias("cosine"))


def top_k(scored: DataFrame, score: str, k: int, ties: str = "chunk_id") -> DataFrame:
    """The ``k`` best rows of each query with ``rank``. Spark keeps only ``k`` rows per task and query before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), ties)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hybrid(bm: DataFrame, cos: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """``score`` = BM25 + weight * cosine * max(best BM25 of the query, 1); both sides rank the same pairs."""
    both = bm.join(cos, ["query_id", "chunk_id"], "left").fillna(0.0, ["cosine"])
    best = F.greatest(F.max("bm25").over(Window.partitionBy("query_id")), F.lit(1.0))
    return both.withColumn("score", F.round(F.col("bm25") + cfg.dense_weight * F.col("cosine") * best, PLACES))


def floors(scored: DataFrame, shares_content: F.Column, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Drops what is under both floors, and what shares no content word unless its BM25 is half again as high."""
    weak = (F.col("bm25") < cfg.min_score) & (F.col("cosine") < cfg.min_cosine)
    return scored.where(~weak & (shares_content | (F.col("bm25") >= 1.5 * cfg.min_score)))


def candidates(queries: DataFrame, post: DataFrame, freq: DataFrame, stats: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Both scores of all pairs that can pass the floors: ``query_id``, ``chunk_id``, ``bm25``, ``cosine``, ``shares`` (a content
    word), ``light_bound``, ``best`` (the query's best BM25 of all chunks).

    A chunk without a content word of the query must reach the higher floor by stop words
    alone. The frequent ones can't: those whose greatest possible scores add up to less
    than that floor are light. So only chunks with a content word or another stop word are
    candidates; light words, held by most chunks, are looked up in a map of each candidate.
    The best BM25 of a query scales the cosine; where the candidates' best is under what light
    words could reach elsewhere, all chunks are scored for that query's best.
    """
    k1, b = cfg.k1, cfg.b
    floor = 1.5 * cfg.min_score
    content = query_terms(queries, content_only=True).select("query_id", "term", F.lit(True).alias("content"))
    q = query_terms(queries).join(content, ["query_id", "term"], "left").join(freq, "term").join(F.broadcast(stats.select("n")))
    q = q.withColumn("idf", idf(F.col("df"), F.col("n"))).withColumn("w", F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0)
    q = q.withColumn("bound", F.col("qtf") * F.col("idf") * (k1 + 1))
    reach = F.sum(F.when(F.col("content").isNull(), F.col("bound")).otherwise(0.0)).over(Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0))
    q = cut(q.withColumn("light", F.col("content").isNull() & (reach < floor * 0.999)).select("query_id", "term", "qtf", "idf", "w", "bound", "light", F.coalesce("content", F.lit(False)).alias("content")))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.pow(F.col("qtf") * F.col("w"), F.lit(2.0)))).alias("qn"), F.sum(F.when(F.col("light"), F.col("bound")).otherwise(0.0)).alias("light_bound"))
    lights = q.where("light").groupBy("query_id").agg(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("bw"), (F.col("qtf") * F.col("w") * F.col("w")).alias("cw"))).alias("lights"))
    sides = broadcast_if_small(qn.join(lights, "query_id", "left"))

    # what is known of a chunk whatever the query: its norm, and the light words that it holds
    weights = broadcast_if_few(term_weights(freq, stats).withColumnRenamed("w", "dw"))
    light_terms = q.where("light").select("term", F.lit(True).alias("is_light")).distinct()
    d = post.join(weights, "term").join(broadcast_if_small(light_terms), "term", "left")
    held = F.map_from_entries(F.collect_list(F.when(F.col("is_light"), F.struct("term", "tf"))))
    chunk_side = d.groupBy("chunk_id").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("dw"), F.lit(2.0)))).alias("dn"), F.first("dl").alias("dl"), held.alias("held"))

    saturated = lambda tf: tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hit = post.join(broadcast_if_small(q.where("not light")), "term").join(F.broadcast(stats.select("avgdl")))
    cand = hit.groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("qtf") * F.col("idf") * saturated(F.col("tf"))).alias("b0"), F.sum(F.col("tf") * F.col("qtf") * F.col("w") * F.col("w")).alias("d0"), F.max("content").alias("shares")
    )
    x = cand.join(chunk_side, "chunk_id").join(sides, "query_id").join(F.broadcast(stats.select("avgdl")))
    tf_of = lambda t: F.coalesce(F.try_element_at(F.col("held"), t["term"]), F.lit(0)).cast("double")
    add = lambda f: F.coalesce(F.aggregate("lights", F.lit(0.0), lambda s, t: s + f(t)), F.lit(0.0))
    x = x.withColumn("bm25", F.round(F.col("b0") + add(lambda t: t["bw"] * saturated(tf_of(t))), PLACES))
    x = x.withColumn("cosine", F.round((F.col("d0") + add(lambda t: t["cw"] * tf_of(t))) / (F.col("dn") * F.col("qn")), PLACES))
    x = x.select("query_id", "chunk_id", "bm25", "cosine", "shares", "light_bound")
    x = cut(x.withColumn("best", F.max("bm25").over(Window.partitionBy("query_id"))))  # also read by ``bm25_first``
    unsure = x.where((F.col("best") < F.col("light_bound")) & (F.col("light_bound") > 1.0)).select("query_id").distinct()
    if not unsure.isEmpty():
        full = bm25(queries.join(unsure, "query_id", "left_semi"), post, freq, stats, cfg).groupBy("query_id").agg(F.max("bm25").alias("true_best"))
        x = cut(x.join(full, "query_id", "left").withColumn("best", F.greatest("best", F.coalesce("true_best", F.lit(0.0)))).drop("true_best"))
    return x


def bm25_first(cand: DataFrame, queries: DataFrame, post: DataFrame, freq: DataFrame, stats: DataFrame, k: int, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """The ``k`` best chunks by BM25 alone. Candidates suffice for a query whose ``k``-th best is above what light words reach
    elsewhere; the others are scored in full."""
    top = top_k(cand.select("query_id", "chunk_id", "bm25", "light_bound"), "bm25", k)
    sure = top.groupBy("query_id").agg(F.count("*").alias("c"), F.min(F.col("bm25") - F.col("light_bound")).alias("gap")).where((F.col("c") == k) & (F.col("gap") > 0)).select("query_id")
    sure = cut(sure)
    rest = queries.join(sure, "query_id", "left_anti")
    full = top_k(bm25(rest, post, freq, stats, cfg), "bm25", k)
    return top.join(sure, "query_id", "left_semi").select("query_id", "chunk_id", "bm25", "rank").unionByName(full.select("query_id", "chunk_id", "bm25", "rank"))


def search(queries: DataFrame, post: DataFrame, freq: DataFrame, stats: DataFrame, cfg: EngineConfig = EngineConfig(), cand: DataFrame | None = None) -> DataFrame:
    """The hybrid ranking with floors: ``query_id``, ``chunk_id``, ``bm25``, ``cosine``, ``score``, ``rank``; the same rows as
    scoring every pair. ``cand``: the ``candidates``, where they are there already."""
    x = candidates(queries, post, freq, stats, cfg) if cand is None else cand
    x = x.withColumn("score", F.round(F.col("bm25") + cfg.dense_weight * F.col("cosine") * F.greatest("best", F.lit(1.0)), PLACES))
    return top_k(floors(x, F.col("shares"), cfg).select("query_id", "chunk_id", "bm25", "cosine", "score"), "score", cfg.top_k)


def title_grams(c: F.Column, low: int = 3, high: int = 5) -> F.Column:
    """Grams of ``low`` to ``high`` letters within each blank-padded word, with repeats; shorter words give themselves."""

    def grams(w: F.Column) -> F.Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        sizes = F.filter(F.array(*[F.lit(n) for n in range(low, high + 1)]), lambda n: (n <= F.length(p)) | (n == low))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substring(p, i, n))))

    words = F.filter(F.split(X.normalize_text(c), " "), lambda w: w != "")
    return F.flatten(F.transform(words, grams))


def title_cosine(queries: DataFrame, chunk_table: DataFrame) -> DataFrame:
    """Cosine of letter grams between queries and titles. Distinct titles are ranked once, whatever the number of their chunks.

    Exact grams are compared; there are no hash buckets and so no collisions."""
    vec = lambda df, key, col: df.select(key, F.explode(title_grams(F.col(col))).alias("g")).groupBy(key, "g").agg(F.count("*").alias("c"))
    titles = chunk_table.select("title").where("title <> ''").distinct()
    t, q = vec(titles.withColumn("key", F.col("title")), "title", "key"), vec(queries, "query_id", "query")
    norm = lambda v, key, n: v.groupBy(key).agg(F.sqrt(F.sum(F.col("c") * F.col("c")).cast("double")).alias(n))
    dots = t.withColumnRenamed("c", "tc").join(broadcast_if_small(q.withColumnRenamed("c", "qc")), "g").groupBy("query_id", "title").agg(F.sum(F.col("tc") * F.col("qc")).alias("dot"))
    out = dots.join(norm(t, "title", "tn"), "title").join(broadcast_if_small(norm(q, "query_id", "qn")), "query_id")
    return out.select("query_id", "title", F.round(F.col("dot") / (F.col("tn") * F.col("qn")), PLACES).alias("cosine"))


def dot(a: F.Column, b: F.Column) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def embedding_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Exact cosine of a bounded set of query vectors against all vectors: ``query_id``, ``key``, ``cosine``, ``rank``.

    The stated query set is sent to where the vectors are, in as many blocks as its size
    needs, each under the broadcast limit; norms are computed once per vector and block.
    """
    q = queries.select(F.col(key).alias("query_id"), F.col(vec).alias("q"), F.sqrt(dot(F.col(vec), F.col(vec))).alias("qn"))
    blocks = max(1, -(-plan_bytes(q) // BROADCAST_LIMIT_BYTES))
    d = vectors.select(key, F.col(vec).alias("v"), F.sqrt(dot(F.col(vec), F.col(vec))).alias("vn"))
    best = None
    for i in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        pairs = d.join(F.broadcast(part), F.col(key) != F.col("query_id"))
        scored = pairs.select("query_id", key, F.round(dot(F.col("v"), F.col("q")) / (F.col("vn") * F.col("qn")), PLACES).alias("cosine"))
        top = top_k(scored, "cosine", k, ties=key)
        best = top if best is None else best.unionByName(top)
    return best


def disagreement(first: DataFrame, second: DataFrame, queries: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Jaccard of the document sets (column ``docs``) of two rankers per query; two empty sets agree."""
    both = queries.select("query_id").join(first.select("query_id", F.col("docs").alias("a")), "query_id", "left").join(second.select("query_id", F.col("docs").alias("b")), "query_id", "left")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    union = F.size(F.array_union(a, b))
    j = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
    return both.select("query_id", a.alias("bm25_docs"), b.alias("dense_docs"), F.round(j, PLACES).alias("jaccard"), (j < threshold).alias("disagreed"))
