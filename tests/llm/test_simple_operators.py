"""Terms, pieces and containers against brute force."""

import random
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluiceway.llm import chunking, packing, terms


def brute_terms(text):
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    text = unicodedata.normalize("NFKC", text).lower()
    out, run = [], ""
    for c in text + " ":
        if unicodedata.category(c)[0] in "LN":
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


TEXTS = ["The cat, the CAT.", None, "", "  ", "Ca­t ｃａｔ ​x_y", "The cat, the CAT.", "naïve 3½ 中文 é", "a" * 50_000, "rare word"]


@pytest.mark.parametrize("flush", [1, 4, 10**6])
def test_terms(spark, flush):
    df = spark.createDataFrame([(t, 1, "x") for t in TEXTS], "body string, records int, term string").repartition(3)
    rows = terms.mark_terms(terms.count_terms(df, "body", flush_terms=flush), df, "body").collect()
    texts = [t for t in TEXTS if t is not None]
    occ, rec = Counter(w for t in texts for w in brute_terms(t)), Counter(w for t in texts for w in set(brute_terms(t)))
    assert {r.term: (r.occurrences, r.records) for r in rows} == {w: (occ[w], rec[w]) for w in occ}
    want = {w: "common" if rec[w] * 5 > len(texts) else "rare" if rec[w] == 1 else None for w in rec}
    assert {r.term: r.mark for r in rows} == want
    assert len(rows) == len(occ)


def test_terms_empty(spark):
    df = spark.createDataFrame([], "body string")
    assert terms.mark_terms(terms.count_terms(df, "body"), df, "body").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300))
def test_terms_of(text):
    assert terms.terms_of(text) == brute_terms(text)


def check_pieces(text, limit=60, overlap=12, slack=4):
    pieces = chunking.split_text(text, limit, overlap, slack)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(e - s <= limit for s, e, _ in pieces)
    for (s, e, _), (s2, e2, _) in zip(pieces, pieces[1:]):
        assert e2 > e and s2 >= s
        assert min(e, overlap) >= e - s2 >= min(e - s, overlap - slack)
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,\ń中", max_size=600))
def test_pieces(text):
    pieces = check_pieces(text)
    body = text[: pieces[0][1]] + "".join(text[p[1] : e] for p, (_, e, _) in zip(pieces, pieces[1:]))
    assert body == text


def test_pieces_boundaries():
    text = ("word " * 9 + "\n\n") * 6
    assert {b for *_, b in check_pieces(text, 120, 10, 4)} <= {"paragraph", "end"}
    assert all(b in ("forced", "end") for *_, b in check_pieces("x" * 500))
    assert check_pieces("x" * 60) == [(0, 60, "end")]
    assert len(check_pieces("y" * 61)) == 2


def test_split_oversized(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "z" * 1200, 5), (4, "z" * 1201, 5), (5, "word " * 400, 5), (5, "word " * 400, 5), (6, "\U0001f600" * 1300, 5)]
    out = chunking.split_oversized(spark.createDataFrame(rows, "row_id int, body string, pieces int"))
    got = [(r.row_id, r.n_chars, len(r.pieces), r.longest_run) for r in out.orderBy("row_id").collect()]
    assert got == [(1, None, 0, None), (2, 0, 1, None), (3, 1200, 1, None), (4, 1201, 2, 1201), (5, 2000, 2, 4), (5, 2000, 2, 4), (6, 1300, 2, 1300)]
    assert all(p.text == r.body[p.start : p.end] for r in out.collect() for p in r.pieces)
    assert chunking.split_oversized(spark.createDataFrame([], "row_id int, body string")).count() == 0
    with pytest.raises(ValueError):
        chunking.split_oversized(out, "body", 10, 10)


def brute_sum_of_squares(sizes, capacity):
    """Tries every choice and adds up all squares."""
    gaps, out = [], []
    for s in sizes:
        best = None
        for gap in sorted(set(g for g in gaps if g >= s)) + [None]:
            after = list(gaps)
            if gap is None:
                after.append(capacity - s)
            else:
                after[after.index(gap)] = gap - s
            squares = sum(n * n for g, n in Counter(after).items() if g)
            if best is None or squares < best[0]:
                best = (squares, after)
        gaps = best[1]
        out.append(sum(n * n for g, n in Counter(gaps).items() if g))
    return len(gaps), out[-1] if out else 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_pack_sizes(sizes):
    where = packing.pack_sizes(sizes, 12)
    fill = Counter()
    for b, s in zip(where, sizes):
        fill[b] += s
    assert all(0 < f <= 12 for f in fill.values())
    n, squares = brute_sum_of_squares(sizes, 12)
    assert len(fill) == n and sum(k * k for g, k in Counter(12 - f for f in fill.values()).items() if g) == squares


def test_pack(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "42", "café"]) for _ in range(rng.randrange(1, 90)))) for i in range(400)]
    texts += [(1000, None), (1001, ""), (1002, "long " * 5000), (1003, "q" * 30_000), (7, texts[7][1])]
    df = spark.createDataFrame([(k, t, "c", 1) for k, t in texts], "doc_id int, text string, container string, part int")
    out = packing.pack(df, "doc_id", "text", capacity=256, lane_items=100)
    rows = out.collect()
    size = {k: len(packing.encode(t, packing.TOKENIZER)) for k, t in texts if t}
    parts, bins = Counter(), {}
    for r in rows:
        parts[r.doc_id] += r.n_tokens
        bins.setdefault(r.container, []).append(r)
    assert parts == Counter({k: n * (2 if k == 7 else 1) for k, n in size.items()})
    for members in bins.values():
        members.sort(key=lambda r: r.position)
        total = sum(r.n_tokens for r in members)
        assert total <= 256 and all(r.filled == total and r.fill == total / 256 for r in members)
        assert [r.position for r in members] == list(range(len(members)))
        assert [r.offset for r in members] == [sum(x.n_tokens for x in members[:i]) for i in range(len(members))]
    assert all(r.part == 0 for r in rows if size[r.doc_id] <= 256)
    assert len(bins) <= 1.1 * sum(r.n_tokens for r in rows) / 256 + 1
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        packing.pack_sizes([300], 256)


def test_encode_whole_texts():
    """A run without blanks longer than any slice gets the tokenizer's own count."""
    import random

    from sluiceway.llm import packing

    rng = random.Random(1)
    for text in ("a" * 9000, "".join(rng.choice("abcdefgh") for _ in range(9000)), "word " * 3000):
        assert packing.encode(text, packing.TOKENIZER) == packing.tokenizer(packing.TOKENIZER).encode_ordinary(text)
