"""Models learned from the corpus: co-occurrence vectors, word translation, linear classifiers, null controls."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluiceway.functions import text as X
from sluiceway.session import BROADCAST_ROWS, cut

WINDOW = 4
ALPHA = 0.75


def cooccurrence(texts: DataFrame, text: str, window: int = WINDOW) -> DataFrame:
    """``a``, ``b``, ``weight``: words within ``window`` places of a sentence, weighted by one over the distance, both ways.

    Pairs are made within each sentence's array (at most ``window`` per word), never by a join on a word.
    """
    s = texts.select(F.explode(X.split_sentences(F.col(text))).alias("s")).select(X.content_tokens(X.tokens(X.normalize_text(F.col("s")))).alias("t")).where(F.size("t") > 1)
    at = s.select("t", F.posexplode("t").alias("i", "a"))
    ahead = at.select("a", F.posexplode(F.slice(F.col("t"), F.col("i") + 2, F.lit(window))).alias("d", "b"))
    one = ahead.select("a", "b", (1.0 / (F.col("d") + 1)).alias("w")).where("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w"))
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.groupBy("a", "b").agg(F.round(F.sum("w"), 6).alias("weight"))


def ppmi(pairs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``a``, ``b``, ``ppmi``: positive pointwise mutual information with smoothed contexts; pairs at or under zero are left out."""
    rows = pairs.groupBy("a").agg(F.sum("weight").alias("row"))
    cols = rows.select(F.col("a").alias("b"), F.pow("row", F.lit(alpha)).alias("ctx"))
    total = rows.agg(F.sum("row").alias("total")).join(cols.agg(F.sum("ctx").alias("ctx_total")))
    x = pairs.join(rows, "a").join(cols, "b").join(F.broadcast(total))
    value = F.log(F.col("weight") * F.col("total") / (F.col("row") * F.col("ctx") * F.col("total") / F.col("ctx_total")))
    return x.select("a", "b", F.round(value, 6).alias("ppmi")).where("ppmi > 0")


def word_vectors(cells: DataFrame, words: int = 6000, dims: int = 32) -> DataFrame:
    """``word``, ``vector``: SVD of the PPMI table of the ``words`` heaviest words (a documented bound), unit length, fixed signs.

    The table of bounded size is factored on the driver; vectors of all other words follow
    from their cells by projection, so every word gets one.
    """
    top = [r.a for r in cells.groupBy("a").agg(F.sum("ppmi").alias("s")).orderBy(F.desc("s"), "a").limit(words).collect()]
    spark = cells.sparkSession
    if not top:
        return spark.createDataFrame([], "word string, vector array<double>")
    index = {w: i for i, w in enumerate(top)}
    names = spark.createDataFrame([(w, i) for w, i in index.items()], "b string, j int")
    kept = cells.join(F.broadcast(names), "b")
    square = kept.join(F.broadcast(names.withColumnRenamed("b", "a").withColumnRenamed("j", "i")), "a").select("i", "j", "ppmi").toPandas()
    m = np.zeros((len(top), len(top)))
    m[square["i"], square["j"]] = square["ppmi"]
    _, s, vt = np.linalg.svd(m, full_matrices=False)
    d = min(dims, int((s > 1e-9).sum()) or 1)
    base = vt[:d].T / np.sqrt(np.maximum(s[:d], 1e-12))
    base *= np.where(base[np.abs(base).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    vecs = spark.createDataFrame([(j, base[j].tolist()) for j in range(len(top))], "j int, v array<double>")
    dims_of = kept.join(F.broadcast(vecs), "j").select("a", F.posexplode(F.transform("v", lambda x: x * F.col("ppmi"))).alias("k", "x")).groupBy("a", "k").agg(F.sum("x").alias("x"))
    arrays = dims_of.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    return arrays.select(F.col("a").alias("word"), F.transform("v", lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).alias("vector"))


#: Rows of some target words are handled together, so many entries (row, source word) or more at once.
BLOCK = 200_000


def _encoded(batches: Iterator[pa.RecordBatch], words: pa.Array) -> Iterator[pa.RecordBatch]:
    """Source words as sorted numbers, four bytes each, so that equal sets are equal bytes."""
    for b in batches:
        lists = b.column("s")
        length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        code = pc.index_in(lists.flatten(), words).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(length)), length)
        flat = code[np.lexsort((code, row))].astype(np.int32).tobytes()
        offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int32).tobytes())
        coded = pa.Array.from_buffers(pa.binary(), len(length), [None, offsets, pa.py_buffer(flat)])
        yield pa.RecordBatch.from_arrays([coded, b.column("n"), b.column("t")], names=["s", "n", "t"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``t`` as compressed blocks; all rows of a target word lie in one block."""

    def block(x: pa.Table) -> pa.RecordBatch:
        t = x["t"].combine_chunks().dictionary_encode()
        length = pc.binary_length(x["s"]).to_numpy().astype(np.int32) // 4
        codes = b"".join(x["s"].to_pylist())
        data = zlib.compress(b"".join([t.indices.to_numpy().astype(np.int32).tobytes(), length.tobytes(), x["n"].to_numpy().astype(np.float64).tobytes(), codes]), 1)
        return pa.RecordBatch.from_arrays([pa.array([t.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([len(length)], pa.int64()), pa.array([data], pa.binary())], names=["ts", "rows", "data"])

    held, entries = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        entries += pc.sum(pc.binary_length(b.column("s"))).as_py() // 4
        if entries >= BLOCK and held[0].column("t")[0] != b.column("t")[-1]:  # the last word may go on
            x = pa.Table.from_batches(held)
            stop = pc.index(x["t"], x["t"][-1]).as_py()
            yield block(x.slice(0, stop))
            held = x.slice(stop).to_batches()
            entries = sum(pc.sum(pc.binary_length(h.column("s"))).as_py() for h in held) // 4
    if held:
        yield block(pa.Table.from_batches(held))


def _rounds(ts: int, rows: int, data: bytes, sums: list[np.ndarray], n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of target and source of a block's distinct cells, and their expected counts after ``len(sums)`` rounds (before the first: 1)."""
    raw = zlib.decompress(data)
    t, length, n = np.frombuffer(raw, np.int32, rows), np.frombuffer(raw, np.int32, rows, 4 * rows), np.frombuffer(raw, np.float64, rows, 8 * rows)
    row = np.repeat(np.arange(rows), length)
    cell, of = np.unique(t[row].astype(np.int64) * n_words + np.frombuffer(raw, np.int32, offset=16 * rows), return_inverse=True)
    t, s = np.divmod(cell, n_words)
    c = np.ones(len(cell))
    for total in sums:
        p = (c / total[s])[of]
        z = np.bincount(row, p, minlength=rows)
        c = np.bincount(of, (n / np.where(z > 0, z, 1.0))[row] * p, minlength=len(cell))
    return t, s, c


def translation(pairs: DataFrame, source: str, target: str, rounds: int = 5, weight: str | None = None) -> DataFrame:
    """IBM Model 1 by expectation-maximisation: ``s``, ``t``, ``p`` = P(t | s), with an empty source word.

    ``pairs`` has word arrays ``source`` and ``target`` and, if named, a ``weight``: how many rows the pair stands for, each of
    which counts. What a target word shares out among source words doesn't depend on other target words but for the sums of each
    source word. So rows are shuffled once, by target word, with equal sets of source words summed up, and written as compressed
    blocks; a round reads them where they lie and gives a sum for each source word. No cell is written but the result's.
    The source words (up to ``BROADCAST_ROWS``) are sent to the tasks; beyond, each round is made of joins.
    """
    rows = (F.col(weight) if weight else F.lit(1)).cast("double")
    x = pairs.where(F.col(target).isNotNull()).select(F.array_union(F.col(source), F.array(F.lit(""))).alias("s"), rows.alias("n"), F.array_distinct(F.col(target)).alias("t")).where("s is not null and n > 0")
    found = cut(x.select(F.explode("s").alias("s")).distinct())
    if found.count() > BROADCAST_ROWS:
        return _translation_by_joins(x.select(F.monotonically_increasing_id().alias("pair"), "s", "t", "n"), rounds)
    words = found.toArrow()["s"].combine_chunks()
    words = words.take(pc.sort_indices(words)).cast(pa.string())
    n_words = max(len(words), 1)
    coded = x.mapInArrow(lambda batches: _encoded(batches, words), "s binary, n double, t array<string>").select("s", "n", F.explode("t").alias("t"))
    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = coded.repartition(parts, "t").groupBy("t", "s").agg(F.sum("n").alias("n")).sortWithinPartitions("t")
    blocks = cut(grouped.mapInArrow(_blocks, "ts array<string>, rows long, data binary"))

    sums: list[np.ndarray] = []

    def each(batches: Iterator[pa.RecordBatch], sums: list[np.ndarray]) -> Iterator[tuple]:
        for b in batches:
            for i in range(b.num_rows):
                ts = b.column("ts")[i].values
                yield ts, *_rounds(len(ts), b.column("rows")[i].as_py(), b.column("data")[i].as_py(), sums, n_words)

    for _ in range(rounds + 1):

        def add(batches: Iterator[pa.RecordBatch], sums: list[np.ndarray] = list(sums)) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n_words)
            for _, _, s, c in each(batches, sums):
                total += np.bincount(s, c, minlength=n_words)
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k])], names=["k", "c"])

        got = blocks.mapInArrow(add, "k long, c double").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
        total = np.ones(n_words)
        total[got["k"].to_numpy()] = got["c"].to_numpy()
        sums.append(total)

    def give(batches: Iterator[pa.RecordBatch], sums: list[np.ndarray] = sums) -> Iterator[pa.RecordBatch]:
        for ts, t, s, c in each(batches, sums[:-1]):
            out = pa.table({"s": words.take(pa.array(s)), "t": ts.take(pa.array(t)), "p": c / sums[-1][s]})
            yield from out.to_batches(max_chunksize=50_000)

    return blocks.mapInArrow(give, "s string, t string, p double")


def _translation_by_joins(pairs: DataFrame, rounds: int) -> DataFrame:
    """``translation`` for more source words than a task can be sent: each round is one join and two aggregates."""
    both = cut(pairs.select("pair", "t", "n", F.explode("s").alias("s")).select("pair", "s", "n", F.explode("t").alias("t")))
    table = both.select("s", "t").distinct().withColumn("p", F.lit(1.0) / F.count("*").over(Window.partitionBy("s")))
    for _ in range(rounds):
        e = both.join(table, ["s", "t"])
        z = e.groupBy("pair", "t").agg(F.sum("p").alias("z"))
        counts = e.join(z, ["pair", "t"]).groupBy("s", "t").agg(F.sum(F.col("n") * F.col("p") / F.col("z")).alias("c"))
        table = cut(counts.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("s"))).select("s", "t", "p"))
    return table


def lift(counts: DataFrame, alpha: float = 5.0) -> DataFrame:
    """``s``, ``t``, ``lift`` = ln(((c + alpha*bg) / (C + alpha)) / bg) of counts ``s``, ``t``, ``c``."""
    total = counts.groupBy("s").agg(F.sum("c").alias("C"))
    bg = counts.groupBy("t").agg(F.sum("c").alias("ct")).join(F.broadcast(counts.agg(F.sum("c").alias("all")))).select("t", (F.col("ct") / F.col("all")).alias("bg"))
    x = counts.join(total, "s").join(bg, "t")
    return x.select("s", "t", F.round(F.log((F.col("c") + alpha * F.col("bg")) / (F.col("C") + alpha) / F.col("bg")), 6).alias("lift"))


def fit_logistic(rows: DataFrame, features: list[str], label: str, penalty: float = 1.0, sample: int = 50_000, seed_key: str | None = None) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Standardised, class-balanced logistic regression on at most ``sample`` rows (those of the smallest hashes): weights, bias, means, deviations."""
    key = F.xxhash64(seed_key) if seed_key else F.xxhash64(*features, label)
    data = rows.where(F.col(label).isNotNull()).select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("int").alias("__y"), key.alias("__h")).orderBy("__h").limit(sample).toPandas()
    x, y = data[features].fillna(0.0).to_numpy(), data["__y"].to_numpy()
    mean, dev = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    x = (x - mean) / dev
    n1 = max(1, int(y.sum()))
    n0 = max(1, len(y) - n1)
    weight = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = np.append(x.T @ (weight * (p - y)) + penalty * w, (weight * (p - y)).sum())
        r = weight * p * (1 - p)
        xb = np.hstack([x, np.ones((len(x), 1))])
        h = xb.T @ (xb * r[:, None]) + np.diag(np.append(np.full(len(w), penalty), 1e-9))
        step = np.linalg.solve(h, g)
        w, b = w - step[:-1], b - step[-1]
        if np.abs(step).max() < 1e-8:
            break
    return w, float(b), mean, dev


def score_logistic(rows: DataFrame, features: list[str], model: tuple) -> DataFrame:
    """Adds ``probability``, as a column expression."""
    w, b, mean, dev = model
    z = F.lit(float(b))
    for f, a, m, d in zip(features, w, mean, dev):
        z = z + (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - float(m)) / float(d) * float(a)
    return rows.withColumn("probability", 1.0 / (1.0 + F.exp(-z)))


def auc(scored: DataFrame, label: str, score: str = "probability") -> DataFrame:
    """Area under the ROC curve, ties counting half, from counts of each distinct score: one row ``auc``."""
    c = scored.groupBy(score).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n"))
    # running negatives below each distinct score; distinct scores are few once rounded
    w = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return c.agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))


def rank_metrics(candidates: DataFrame, group: str, score: str, relevant: str) -> DataFrame:
    """P@1 and MRR with pessimistic ties: the rank of the relevant candidate counts all that score at least as high."""
    best = candidates.where(relevant).groupBy(group).agg(F.max(score).alias("__best"))
    rank = candidates.join(best, group).groupBy(group).agg(F.count_if(F.col(score) >= F.col("__best")).alias("rank"))
    return rank.agg(F.round(F.avg((F.col("rank") == 1).cast("int")), 6).alias("p_at_1"), F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"))


def null_percentile(real: DataFrame, controls: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Share of controls of each key that score lower than the real word: ``key``, ``percentile``."""
    r = real.select(key, F.col(score).alias("__real"))
    return controls.join(r, key).groupBy(key).agg(F.round(F.avg((F.col(score) < F.col("__real") - 1e-6).cast("int")), 6).alias("percentile"))
