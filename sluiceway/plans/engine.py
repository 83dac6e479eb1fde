"""Answering a batch of questions from a corpus: ranking, gates and one decision per question, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluiceway.config import EngineConfig
from sluiceway.operators import answer, corpus, freshness, grounding, hazard, intent, policy, rescue, retrieve, scan
from sluiceway.operators.timestamps import normalise_timestamps
from sluiceway.session import broadcast_if_few, cut, stored

# Phrases that ask for a contact.
CONTACT_PHRASES = (
    "rotation contact email", "contact email", "rotation email", "oncall email", "on-call email", "pager email", "notify email", "email address", "phone number for rotation", "rotation contact phone",
)
#: A session's requests are summed in stretches of so many units of ``seq`` (seconds, where it is a time).
STRETCH = 10_000


@dataclass
class Corpus:
    """The query-independent tables."""

    chunks: DataFrame
    tokens: DataFrame
    frequency: DataFrame
    content_frequency: DataFrame
    stats: DataFrame
    forms: DataFrame


def build_corpus(docs: DataFrame, sources: DataFrame, cfg: EngineConfig = EngineConfig()) -> Corpus:
    """Chunks of the latest deliveries with ages and limits, tokens and statistics. ``docs``: the columns of ``ops_docs``.

    The tables are written once to the shared checkpoint folder: every gate of every batch
    reads them, and a lost executor loses none.
    """
    latest = corpus.latest_documents(docs.select("row_id", "doc_id", "title", "updated_at", "source_system", "body", "ingested_at"))
    timed = normalise_timestamps(latest, sources)
    timed = timed.withColumn("age_hours", freshness.age_hours(F.timestamp_micros("utc_us"), F.lit(cfg.now).cast("timestamp")))
    timed = freshness.with_limit(timed, sources, default=cfg.max_age_hours)
    ch = stored(corpus.chunks(timed, extra=("source_system", "age_hours", "max_age_hours")))
    toks = stored(corpus.tokenised(ch))
    return Corpus(ch, toks, cut(corpus.token_frequency(toks)), cut(corpus.token_frequency(toks, content_only=True)), cut(corpus.statistics(toks)), grounding.evidence_forms(toks))


def ask_batch(queries: DataFrame, c: Corpus, cfg: EngineConfig = EngineConfig(), sessions: bool = False, canaries: DataFrame | None = None, canary_pattern: str = r"CANARY-[A-Z0-9-]+", neighbours: DataFrame | None = None) -> DataFrame:
    """One row per query (``query_id``, ``query``; with ``sessions`` also ``session_id`` and ``seq``, a number or time):
    ``decision``, ``draft``, ``cited``, and the gate columns that led to it.

    Rankers, drafts and the contact gate read the query in words of the corpus, grounding reads it with slips put right,
    the other gates as it was asked. ``canaries``: a registry of planted ``token``s, which all have the form
    ``canary_pattern``; ``neighbours``: those of ``rescue.rewrite``."""
    vocabulary = cut(rescue.known_words(c.frequency))
    asked = cut(rescue.fix_interrogatives(queries, vocabulary))
    rewritten = cut(rescue.rewrite(asked, vocabulary, neighbours).withColumnRenamed("rewritten", "query"))
    lexical = cut(scan.top_bm25(rewritten, c.tokens, c.frequency, c.stats, cfg.disagreement_k, cfg))
    hits = cut(scan.search(rewritten, c.tokens, c.frequency, c.stats, cfg, lexical))
    hit_ids = cut(hits.select("chunk_id").distinct())
    held = lambda x: cut(x.join(broadcast_if_few(hit_ids), "chunk_id", "left_semi"))
    forms = held(c.forms)
    terms = cut(grounding.terms(asked, c.content_frequency, c.stats, vocabulary))
    cover = grounding.coverage(grounding.support(hits, terms, forms))
    meta = held(c.chunks.select("chunk_id", "doc_id", "pos", "title", "text", "age_hours", "max_age_hours"))
    h = freshness.check(hits.join(cover, ["query_id", "chunk_id"], "left").join(meta, "chunk_id"))
    h = cut(h.withColumn("supporting", F.coalesce((F.col("coverage") >= cfg.grounding) & F.col("keys_ok"), F.lit(False))))
    gates = h.groupBy("query_id").agg(
        F.count("*").alias("n_retrieved"),
        F.count_if("supporting").alias("n_supporting"),
        F.count_if(F.col("supporting") & F.col("fresh")).alias("n_fresh"),
        F.max("coverage").alias("best_support"),
        F.max_by("missing", F.struct(F.col("coverage"), -F.col("rank"))).alias("missing"),
    )
    fresh = h.where("supporting and fresh")
    # evidence of a query: the forms of all its fresh chunks together
    joined = fresh.select("query_id", "chunk_id").join(forms, "chunk_id").groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("forms"))).alias("forms")).withColumn("chunk_id", F.lit("all"))
    drafts = cut(answer.draft(rewritten, fresh, cfg.answer_sentences))
    whole = grounding.coverage(_support_all(joined, terms))
    own = drafts.select("query_id", F.regexp_replace("draft", r" \[sources: [^\]]*\]$", "").alias("query"))
    draft_terms = grounding.terms(own, c.content_frequency, c.stats)
    draft_cover = grounding.coverage(_support_all(joined, draft_terms)).select("query_id", F.col("coverage").alias("draft_coverage"))
    ok = (F.col("coverage") >= cfg.grounding) & F.col("keys_ok") & (F.lit(cfg.nonkey_rule == "off") | F.col("nonkeys_ok")) & (F.col("draft_coverage") >= cfg.draft_grounding)
    grounded = whole.join(draft_cover, "query_id").select("query_id", ok.alias("grounded"))

    lexical = c.chunks.select("chunk_id", "doc_id").join(broadcast_if_few(lexical), "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))
    titles = cut(scan.top_titles(rewritten, c.chunks, cfg.disagreement_k))
    first = c.chunks.join(broadcast_if_few(titles.select("title").distinct()), "title", "left_semi").groupBy("title").agg(F.min("doc_id").alias("doc_id"))
    dense = titles.join(first, "title").groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))
    differ = retrieve.disagreement(lexical, dense, queries, cfg.disagreement_jaccard).select("query_id", "jaccard", "disagreed")

    out = queries
    for part in (gates, grounded, differ, drafts, rewritten.withColumnRenamed("query", "rewritten")):
        out = out.join(part, "query_id", "left")
    out = out.withColumn("n_retrieved", F.coalesce("n_retrieved", F.lit(0)))
    out = out.withColumn("request_cost", policy.request_cost(F.col("n_retrieved")))
    if sessions:
        out = policy.budget(out, "session_id", ("seq",), "request_cost", cfg.session_budget, stretch=F.floor(F.col("seq").cast("double") / STRETCH))
    else:
        out = out.withColumn("over_budget", F.lit(False))
    out = out.withColumn("pii_action", F.when(F.col("draft").isNotNull(), hazard.action(F.col("draft"), F.col("rewritten"), CONTACT_PHRASES))).drop("rewritten")
    out = out.withColumn("__i", intent.intent(F.col("query")))
    proposed = F.col("__i.status") == "propose"
    out = out.withColumn("write_action", F.when(proposed, F.col("__i.action"))).withColumn("write_target", F.when(proposed, F.col("__i.target"))).withColumn("write_ambiguous", F.col("__i.status") == "ambiguous").drop("__i")
    if canaries is None:
        out = out.withColumn("canary_leaked", F.lit(False))
    else:
        leaked = hazard.canary_scan(out.where("draft is not null"), canaries, "query_id", "draft", "query", canary_pattern).groupBy("query_id").agg(F.max("leaked").alias("canary_leaked"))
        out = out.join(leaked, "query_id", "left")
    out = out.withColumn("decision", policy.decide(cfg))
    answered = F.col("decision") == "ANSWER"
    shown = F.when(answered, F.when(F.col("pii_action") == "redact", hazard.mask(F.col("draft"))).otherwise(F.col("draft")))
    return out.withColumn("draft", shown).withColumn("cited", F.when(answered, F.col("cited")))


def _support_all(joined: DataFrame, terms: DataFrame) -> DataFrame:
    """Support of terms by the union of forms of each query's evidence; both sides are keyed by the query."""
    w = Window.partitionBy("query_id")
    ranked = terms.withColumn("key_rank", F.row_number().over(w.orderBy(F.desc("weight"), "pos"))).withColumn("n_terms", F.count("*").over(w))
    return ranked.join(joined, "query_id").select("query_id", "chunk_id", "pos", "term", "kind", "weight", "key_rank", "n_terms", F.arrays_overlap("alts", "forms").alias("ok"))


def ask(spark: SparkSession, query: str, c: Corpus, cfg: EngineConfig = EngineConfig()) -> dict:
    """One question."""
    df = spark.createDataFrame([(1, query)], "query_id bigint, query string")
    return ask_batch(df, c, cfg).first().asDict()
