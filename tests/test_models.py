"""Lexicons, evaluation, models, sources and streams."""

import itertools
import json
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluiceway.operators import evaluate, freshness, lexicon, train
from sluiceway.plans import registry
from sluiceway.sources import files
from sluiceway.streaming import monitor


def test_keyboard_slip():
    yes = [("teh", "the"), ("chekout", "checkout"), ("checkoutt", "checkout"), ("vheckout", "checkout"), ("checkout", "chekout"), ("checkiut", "checkout")]
    no = [("checkout", "checkout"), ("pheckout", "checkout"), ("chout", "checkout"), ("checkpout2", "checkout"), ("abcd", "dcba")]
    assert all(lexicon.keyboard_slip(a, b) for a, b in yes if (a, b) != ("checkout", "chekout")) and not any(lexicon.keyboard_slip(a, b) for a, b in no)


def test_correct(spark):
    v = spark.createDataFrame([("queue", 9), ("cache", 5), ("caches", 5), ("ledger", 3), ("lodger", 3), ("rate", 4)], "term string, df int")
    w = spark.createDataFrame([("queu",), ("cachee",), ("lrdger",), ("qeue",), ("rat",), ("x9x9",), (None,), ("queue",), ("queu",)], "term string")
    assert sorted(map(tuple, lexicon.correct(w, v).collect())) == [("cachee", "cache"), ("lrdger", "ledger"), ("qeue", "queue")]


def test_neighbours_and_graph(spark):
    e = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0), ("a", "c", 0.5), ("c", "d", 3.0), ("a", "a", 9.0), ("a", "b", 1.0)], "src string, dst string, weight double")
    got = {(r.src, r.dst): (r.hops, r.weight) for r in lexicon.two_hops(e).collect()}
    assert got == {("a", "b"): (1, 2.0), ("b", "c"): (1, 1.0), ("a", "c"): (1, 0.5), ("c", "d"): (1, 3.0), ("b", "d"): (2, 4.0), ("a", "d"): (2, 3.5)}
    assert [(r.src, r.dst) for r in lexicon.neighbours(e, "src", "weight", 1.0, 1, "dst").where("src <> 'a'").orderBy("src").collect()] == [("b", "c"), ("c", "d")]
    t = spark.createDataFrame([("s1", "k8s", "kubernetes"), ("s2", "kubernetes", "k8s"), ("s1", "x", "x")], "site string, tag string, synonym string")
    assert {(r.word, r.n_sites) for r in lexicon.tag_clusters(t).collect()} == {("k8s", 2), ("kubernetes", 2)}
    p = spark.createDataFrame([("w", 2, "b"), ("w", 1, "a"), ("v", 3, "c")], "word string, priority int, like string")
    assert {(r.word, r.like) for r in lexicon.first_resource(p).collect()} == {("w", "a"), ("v", "c")}


def test_evaluate(spark):
    rows = [("ANSWER", "ANSWER", 1.0), ("ANSWER", "REFUSE_STALE", 2.0), ("REFUSE_PII", "ANSWER", float("nan")), ("PROPOSE_WRITE", "ANSWER", -1.0), (None, "ANSWER", 4.0), ("REFUSE_PII", "REFUSE_STALE", 1e9)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, expect_decision string, actual_decision string, latency_ms double")
    assert [r.f for r in df.select("i", evaluate.classify_flip().alias("f")).orderBy("i").collect()] == ["ok", "over_refusal", "fail_open", "missed_write", "fail_open", "wrong_refusal_reason"]
    r = evaluate.latencies(df).first()
    assert (r.n, r.mean, r.p50, r.p95) == (3, round(7 / 3, 6), 2.0, 3.8)
    assert evaluate.sign_test_p(9, 1) == pytest.approx(2 * 11 / 1024) and evaluate.sign_test_p(0, 0) == 1.0
    g = spark.createDataFrame([(i / 10, i not in (0, 3, 9)) for i in range(10)], "x double, ok boolean")
    assert tuple(evaluate.widest_plateau(g, "x", "ok").first()) == (0.4, 0.8, 5)
    v = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", "x")], "w string, resource string")
    assert [tuple(r) for r in evaluate.votes(v, "w").collect()] == [("a", 2)]
    assert evaluate.flips(df.limit(0), df, "i").count() == 0


def test_cooccurrence_and_ppmi(spark):
    texts = ["alpha beta gamma delta epsilon zeta. alpha beta", "beta alpha", None, "", "solo"]
    got = {(r.a, r.b): r.weight for r in train.cooccurrence(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    want = Counter()
    for s in ("alpha beta gamma delta epsilon zeta", "alpha beta", "beta alpha"):
        w = s.split()
        for i, j in itertools.combinations(range(len(w)), 2):
            if j - i <= 4:
                want[w[i], w[j]] += 1 / (j - i)
                want[w[j], w[i]] += 1 / (j - i)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    row = Counter()
    for (a, _), v in want.items():
        row[a] += v
    ctx = {w: v**0.75 for w, v in row.items()}
    total, scale = sum(row.values()), sum(row.values()) / sum(ctx.values())
    cells = train.ppmi(spark.createDataFrame([(a, b, v) for (a, b), v in want.items()], "a string, b string, weight double"))
    for r in cells.collect():
        assert abs(r.ppmi - math.log(want[r.a, r.b] * total / (row[r.a] * ctx[r.b] * scale))) < 2e-6
    vecs = {r.word: np.array(r.vector) for r in train.word_vectors(cells, words=10, dims=3).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in vecs.values()) and set(vecs) == {r.a for r in cells.collect()}


def test_translation(spark):
    data = [(1, ["haus"], ["house"]), (2, ["haus", "rot"], ["house", "red"]), (3, ["rot"], ["red"]), (4, ["buch", "rot"], ["book", "red"]), (5, ["buch"], ["book"])]
    t = train.translation(spark.createDataFrame(data, "pair int, s array<string>, t array<string>"), "s", "t", rounds=8)
    best = {}
    for r in t.where("s <> ''").collect():
        best.setdefault(r.s, []).append((r.p, r.t))
    assert {s: max(v)[1] for s, v in best.items()} == {"haus": "house", "rot": "red", "buch": "book"}
    assert all(abs(sum(p for p, _ in v) - 1) < 1e-9 for v in best.values())


def test_translation_counts_every_row(spark):
    data = [(1, ["haus"], ["house"], 1), (2, ["haus"], ["home"], 3), (3, ["haus", "rot"], ["house", "red"], 2)]
    rows = [(100 * i + k, s, t) for i, s, t, n in data for k in range(n)]
    weighted = train.translation(spark.createDataFrame(data, "pair int, s array<string>, t array<string>, n long"), "s", "t", rounds=3, weight="n")
    single = train.translation(spark.createDataFrame(rows, "pair int, s array<string>, t array<string>"), "s", "t", rounds=3)
    got, want = ({(r.s, r.t): r.p for r in x.collect()} for x in (weighted, single))
    assert got == pytest.approx(want) and got["haus", "home"] > got["haus", "house"]


def test_translation_writes_no_cells(spark, monkeypatch):
    rng = random.Random(6)
    data = [(i, [f"s{k}" for k in rng.sample(range(30), 12)], [f"t{k}" for k in rng.sample(range(40), 12)]) for i in range(150)]
    pairs = spark.createDataFrame(data, "pair int, s array<string>, t array<string>")
    written, cut = [], train.cut
    monkeypatch.setattr(train, "cut", lambda df: written.append(x := cut(df)) or x)
    monkeypatch.setattr(train, "BLOCK", 300)  # many blocks
    got = {(r.s, r.t): r.p for r in train.translation(pairs, "s", "t", rounds=3).collect()}
    assert max(x.count() for x in written) < 150  # 150 * 13 * 12 rows of a pair, a source and a target word before
    monkeypatch.setattr(train, "BROADCAST_ROWS", 3)  # too many words to be sent
    joined = {(r.s, r.t): r.p for r in train.translation(pairs, "s", "t", rounds=3).collect()}
    assert got == pytest.approx(joined) and sum(p for (s, _), p in got.items() if s == "s1") == pytest.approx(1.0)


def test_translation_table_is_whole(spark, tmp_path):
    rows = [("alpha", f"word{a}{b}") for a in "abcdefghijklm" for b in "abcdefghijk"] + [("alpha", "often")] * 50
    spark.createDataFrame(rows, "reason string, query string").write.parquet(str(tmp_path / "case_scores.parquet"))
    got = {r.t: r.p for r in registry.QUERIES["translation_table"](spark, str(tmp_path)).where("s = 'alpha'").collect()}
    assert len(got) == 144 and got["often"] == pytest.approx(50 / 193, abs=2e-6)


def test_logistic_and_auc(spark):
    rng = random.Random(2)
    rows = [(i, x := rng.gauss(0, 1), y := rng.gauss(0, 1), bool(x + 0.5 * y + rng.gauss(0, 0.4) > 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, x double, y double, label boolean")
    scored = train.score_logistic(df, ["x", "y"], train.fit_logistic(df, ["x", "y"], "label", seed_key="i"))
    got = train.auc(scored, "label").first().auc
    s = [(r.probability, r.label) for r in scored.collect()]
    pos, neg = [a for a, k in s if k], [a for a, k in s if not k]
    assert got == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)) and got > 0.95
    c = spark.createDataFrame([(1, 0.9, True), (1, 0.9, False), (2, 0.8, True), (2, 0.1, False)], "g int, s double, rel boolean")
    assert tuple(train.rank_metrics(c, "g", "s", "rel").first()) == (0.5, 0.75)
    n = train.null_percentile(spark.createDataFrame([(1, 0.5)], "k int, score double"), spark.createDataFrame([(1, 0.1), (1, 0.5), (1, 0.9), (1, 0.2)], "k int, score double"), "k")
    assert n.first().percentile == 0.5


def test_freshness(spark):
    d = spark.createDataFrame([(1, " Wiki ", 160.0), (2, "wiki", 160.1), (3, "other", 48.0), (4, None, None), (5, "nan", 49.0)], "i int, source_system string, age_hours double")
    s = spark.createDataFrame([("wiki", 160.0), ("nan", float("nan"))], "source_system string, max_age_hours double")
    assert [r.fresh for r in freshness.check(freshness.with_limit(d, s)).orderBy("i").collect()] == [True, False, True, False, False]
    with pytest.raises(Exception, match="negative"):
        freshness.with_limit(d, spark.createDataFrame([("wiki", -1.0)], "source_system string, max_age_hours double")).collect()


def test_sources(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"doc_id": "a", "title": "t", "body": "b", "updated_at": "2026", "source_system": "s", "other": 1}\n\n')
    assert [r.doc_id for r in files.read_documents(spark, str(good)).collect()] == ["a"]
    for line in ('{"doc_id": "a"}', "{broken"):
        bad = tmp_path / "bad.jsonl"
        bad.write_text(line + "\n")
        with pytest.raises(Exception, match="unusable line"):
            files.read_documents(spark, str(bad)).collect()
    (tmp_path / "r.json").write_text(json.dumps({"canaries": [{"token": "T1", "doc_ids": ["x", "y"]}, {"token": ""}]}))
    assert files.read_registry(spark, str(tmp_path / "r.json")).count() == 2
    (tmp_path / "s.yaml").write_text("global_default_hours: 24\nsources:\n  Wiki: 10\n")
    df, default = files.read_limits(spark, str(tmp_path / "s.yaml"))
    assert default == 24.0 and [tuple(r) for r in df.collect()] == [("wiki", 10.0)]
    (tmp_path / "v.txt").write_text("a 3 4\nb 0 0\n\n")
    assert {r.word: r.vector for r in files.read_vectors(spark, str(tmp_path / "v.txt")).collect()} == {"a": [0.6, 0.8], "b": [0.0, 0.0]}
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string")
    assert files.content_hash(a) == files.content_hash(a.orderBy(F.desc("i"))) != files.content_hash(a.limit(1))
    files.append_trace(a, str(tmp_path / "trace"))
    files.append_trace(a, str(tmp_path / "trace"))
    assert spark.read.json(str(tmp_path / "trace")).count() == 4


def test_streams(spark, tmp_path):
    rows = [(i, f"s{i % 3}", 1_700_000_000 + 60 * i, 1.0 + (i % 4) * 0.25) for i in range(90)]
    df = spark.createDataFrame(rows, "seq int, session string, t long, cost double").select("seq", "session", F.timestamp_seconds("t").alias("ts"), "cost")
    src = str(tmp_path / "in")
    for k in range(3):  # three batches in order of time
        df.where(F.col("seq").between(30 * k, 30 * k + 29)).coalesce(1).write.mode("append").parquet(src)
        for p in sorted(os.listdir(src)):
            if p.endswith(".parquet") and not p.startswith("k"):
                os.rename(f"{src}/{p}", f"{src}/k{k}.parquet")
                os.utime(f"{src}/k{k}.parquet", (1000 + k, 1000 + k))
    stream = lambda: monitor.read_stream(spark, src, df.schema)

    def run(out, mode="append"):
        name = f"m{random.getrandbits(40)}"
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = {r.seq: (r.projected, r.over_budget) for r in run(monitor.running_budget(stream(), "session", "ts", "seq", "cost", 20.0))}
    want, spent = {}, Counter()
    for seq, s, _, cost in rows:
        spent[s] += cost
        want[seq] = (spent[s], spent[s] > 20.0)
    assert got == want
    hours = {(str(r.start), r.session): r.events for r in run(monitor.tumbling(stream(), "ts", "session"), "complete")}
    assert sum(hours.values()) == 90 and len(hours) == 6
    assert sum(r.events for r in run(monitor.sliding(stream(), "ts", "session"), "complete")) == 90 * 6
    assert {r.events for r in run(monitor.sessions(stream(), "ts", "session"), "complete")} == {30}
