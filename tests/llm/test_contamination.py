"""Leaks against brute force over all pairs and all alignments."""

import random

from sluiceway.llm import contamination as c


def brute(doc, item, min_run=15, of=10):
    """Longest run over every alignment, by trying every window."""
    a, b, best = c.words_of(doc or ""), c.words_of(item or ""), 0
    for d in range(-len(b), len(a)):
        for i in range(len(b)):
            if not 0 <= i + d < len(a) or a[i + d] != b[i]:
                continue
            missed = 0
            for j in range(i, len(b)):
                if not j + d < len(a):
                    break
                missed += a[j + d] != b[j]
                n = j - i + 1
                if a[j + d] == b[j] and n >= min_run and missed <= n // of:
                    best = max(best, n)
    return best


def test_words():
    assert c.words_of("> The <b>Quick</b> br­own\nＦＯＸ, ... (node-b10) | don’t") == ["the", "quick", "brown", "fox", "nodeb10", "dont"]
    assert c.words_of('{"a": "caf\\u00e9\\nx \\"y\\""}') == ["a", "cafe", "x", "y"]
    assert c.words_of("a &amp; b &lt; c") == ["a", "b", "c"]
    assert c.words_of("") == []


def test_signature_finds_short_in_long():
    """Six shared shingles survive in signatures of every size class."""
    rng = random.Random(1)
    import numpy as np

    for n in (20, 300, 5000, 60_000):
        lost = 0
        for _ in range(40):
            shared = np.array([rng.getrandbits(64) for _ in range(6)], np.uint64)
            doc = np.unique(np.concatenate([shared, np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)]))
            item = np.unique(np.concatenate([shared, np.array([rng.getrandbits(64) for _ in range(60)], np.uint64)]))
            cls = c.size_class(len(doc))
            lost += len(np.intersect1d(c.signature(doc, cls), c.signature(item, cls))) < c.MIN_SHARED
        assert lost == 0


def corpus(rng):
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randrange(14, 45)), "x") for i in range(30)]
    items += [(100, None, "x"), (101, "", "x"), (102, items[3][1], "x"), (5, items[5][1], "x")]
    docs = []
    for k in range(120):
        words = items[rng.randrange(30)][1].split()
        a = rng.randrange(0, max(1, len(words) - 12))
        part = words[a : a + rng.randrange(10, 40)]
        for _ in range(rng.randrange(0, 4)):
            part[rng.randrange(len(part))] = "quietly"
        docs.append((k, f"{text(rng.randrange(0, 400))} <i>{' '.join(part).upper()}</i>\n> {text(rng.randrange(0, 50))}", 1))
    docs += [(200, None, 1), (201, "", 1), (202, "w1 w2", 1), (7, docs[7][1], 1)]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus(random.Random(11))
    d = spark.createDataFrame(docs, "doc_id int, text string, item_id int")
    i = spark.createDataFrame(items, "item_id bigint, item_text string, text string")
    out = c.find_leaks(d, i)
    assert out.columns == ["doc_id", "item_id", "run_words"]
    got = {(r.doc_id, r.item_id): r.run_words for r in out.collect()}
    want = {(dk, ik): n for dk, dt, _ in docs for ik, it, _ in items if (n := brute(dt, it))}
    assert got == want and len(want) > 40
    assert c.find_leaks(d.limit(0), i).count() == 0 and c.find_leaks(d, i.limit(0)).count() == 0


def test_hot_document(spark):
    """A third of the rows repeat one leaking text; each row is found."""
    item = " ".join(f"word{i}" for i in range(30))
    docs = [(k, "before it " + item if k % 3 == 0 else f"other text number {k} " * 9) for k in range(300)]
    out = c.find_leaks(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(1, item)], "item_id int, item_text string"))
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 300, 3))


def test_both_ways_of_meeting(spark):
    """Few items are probed in the scan, many are joined by a shuffle: the same rows."""
    docs, items = corpus(random.Random(5))
    d, i = spark.createDataFrame(docs, "doc_id int, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, item_text string, text string")
    assert sorted(c.find_leaks(d, i).collect()) == sorted(c.find_leaks(d, i, broadcast_rows=0).collect())


def test_signature_is_smaller_than_the_text():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (100, 1000, 20_000, 100_000):
        d = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert len(c.signature(d, c.size_class(n))) <= 0.9 * n


def test_recall_against_exact_join():
    """Documents of all sizes that share six to thirty shingles with an item: how many meet it by minima, against all that share one."""
    import numpy as np

    rng = np.random.default_rng(4)
    met = {6: 0, 11: 0, 30: 0}
    for shared in met:
        for k in range(300):
            common = rng.integers(0, 1 << 64, shared, dtype=np.uint64)
            doc = np.unique(np.concatenate([common, rng.integers(0, 1 << 64, int(10 ** rng.uniform(1, 4.5)), dtype=np.uint64)]))
            item = np.unique(np.concatenate([common, rng.integers(0, 1 << 64, 56 - shared, dtype=np.uint64)]))
            cls = c.size_class(len(doc))
            met[shared] += len(np.intersect1d(c.signature(doc, cls), c.signature(item, cls))) >= c.MIN_SHARED
    assert met[6] >= 298 and met[11] == 300 and met[30] == 300


def test_long_item_and_repeats():
    """An item of 50,000 words, a document of its middle, and texts of one repeated word: memory stays in proportion."""
    import tracemalloc

    words = [f"w{i}" for i in range(50_000)]
    item, doc = c.word_hashes(" ".join(words)), c.word_hashes(" ".join(words[20_000:45_000]))
    same = c.word_hashes("a " * 3000)
    tracemalloc.start()
    assert c.longest_run(doc, item) == 25_000
    assert c.longest_run(same, same) == 3000
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert len(c.windows_of(item)) == 1666 and c.windows_of(item[:20])[0].size == 20
    for n in (59, 60, 61, 89, 90, 91, 200):  # each run of 15 words is in a window
        wins = [set(x.tolist()) for x in c.windows_of(item[:n])]
        assert all(any(set(item[a : a + 15].tolist()) <= w for w in wins) for a in range(n - 14))


def test_least_shared():
    assert c.least_shared() == 6 and c.least_shared(15, 5) == 1
