"""Personal information: inference against enumeration, and accuracy on sentences and names that the model wasn't fitted on."""

import itertools
import random

import numpy as np
import pytest

from sluiceway.llm import pii

GIVEN = ["Amara", "Björn", "Chidi", "Dario", "Elif", "Freya", "Grace", "Hanna", "Idris", "José", "Kofi", "Leila", "Mark", "Nadia", "Rose", "Will", "Zoë"]
STEMS = ["Bren", "Calder", "Ferro", "Gris", "Hadri", "Lomax", "Mersen", "Odal", "Quill", "Sende", "Tarro", "Volk", "Yorin", "Zand"]
TAILS = ["wick", "mann", "elli", "ström", "worth", "ovic", "dottir", "hurst"]
PROSE = [
    "The new cache writes its state every five seconds, so a crash loses little.", "Ask edge-care for the token if the console is locked.", "Nobody noticed a cold start until the queue graph went flat.",
    "Before the freeze all jobs of the sidecar moved to another lane.", "Keep the ledger in read mode while the ticket is open.", "What is the retry ceiling of walnut-store in the north?", "Two reviewers must sign.", "Status for the gulf: green.",
    "Rollback means setting the limit back and watching the broker for ten minutes.", "The review found a missing lease, and the fix went out.", "evidence is in date and covers every asked word", "Please drain the cache", "Compare the value with the other cell.",
]


@pytest.fixture(scope="module")
def model():
    families = [a + b for i, a in enumerate(STEMS) for b in TAILS[i % 2 :: 2]]
    return pii.fit([(g, f) for g, f in zip(itertools.cycle(GIVEN), families)], PROSE * 5)


def kinds(model, text):
    return [(k, text[a:b]) for k, a, b in pii.find_spans(model, text)]


@pytest.mark.parametrize(("text", "want"), [
    ("Contact: Maya Brenelli, +1 212 555 0151.", ["person", "phone"]),
    ("Escalate to Ms. van Odalworth if it fails.", ["person"]),
    ("ask Quillwick, Hanna.", ["person"]),
    ("reach dario griselli at 020 7946 0737", ["person", "phone"]),
    ("HADRIDOTTIR Elif (k.odal [at] mail [dot] example)", ["person", "email"]),
    ("next to D. Tarromann", ["person"]),
    ("mail it to ＡＮＴＯＮ＠mail.example", ["email"]),
    ("write to a.b+c@corp.example.", ["email"]),
    ("my SSN 912 44 6730 is on file", ["id_number"]),
    ("signed in with 902-35-7361.", ["id_number"]),
    ("posted to Flat 25/40 Copperhill Close last week", ["address"]),
    ("kept at 843 Bellwether Avenue,\nHarrowell 30311, ask Zoë Volkhurst", ["address", "person"]),
    ("listed Maya Brenelli, Unit 3/384 Larkmoor St, Personalausweis L14X82388.", ["person", "address", "id_number"]),
    ("listed at 12 Fennel Road, SSN 927 39 0571.", ["address", "id_number"]),
    ("call me on ４１５－５５５－０１９２", ["phone"]),
    ("Grace period for the rotation is 64 days.", []),
    ("Mark resolved only after the graph is flat.", []),
    ("Rose from 79 to 24 percent overnight.", []),
    ("Commit 415550343 is too short to be a hash.", []),
    ("Build 912-44-673 is the last known good one.", []),
    ("The image is registry.example/ledger@sha256:9f2c4111.", []),
    ("Lane 6 of the deploy train is closed.", []),
    ("Ask edge-care for the token.", []),
    ("", []),
])
def test_examples(model, text, want):
    assert [k for k, _ in kinds(model, text)] == want


def test_spans_and_redaction(model):
    text = "Ca­ll Dario GRISELLI, mailbox <d.griselli@mail.example>; naïve ＳＳＮ 912-44-6730."
    spans = pii.find_spans(model, text)
    assert [text[a:b] for _, a, b in spans] == ["Dario GRISELLI", "d.griselli@mail.example", "912-44-6730"]
    assert pii.redact(text, spans) == "Ca­ll [PERSON], mailbox <[EMAIL]>; naïve ＳＳＮ [ID_NUMBER]."


def test_held_out(model):
    """Names recombined from parts that no name of the roster joins, in sentences of another seed."""
    rng = random.Random(99)
    unseen = [a + b for i, a in enumerate(STEMS) for b in TAILS[1 - i % 2 :: 2]]
    right = wrong = missed = 0
    for _ in range(600):
        pieces = pii.made_sentence(rng, GIVEN, unseen, [f[:4] for f in unseen], [f[4:] for f in unseen])
        text, units, gold = pii._gold(pieces)
        want = {(k, a, b) for k, a, b in pii.spans_of(units, gold)}
        got = set(pii.find_spans(model, text))
        right += len(want & got)
        wrong += len(got - want)
        missed += len(want - got)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_skip_chain_is_exact_on_small_graphs(model):
    """Message passing finds the best labelling of short texts with repeated names, checked by trying all."""
    for text in ("Elif Volkwick met Volkwick", "ask Grisworth, Hanna or Grisworth", "call 9125550143 or 9125550143", "Mark Zandmann and mark zandmann"):
        units = pii.units_of(text)
        labels = pii.infer(model, units, rounds=30)
        may = [pii._may(u, model.names) for u in units]
        keep = pii._anchors(units, model.names)
        theta = [model.scores(units, i) for i in range(len(units))]

        def total(ls, units=units, keep=keep, theta=theta):
            s = sum(theta[i][k] for i, k in enumerate(ls) if keep[i])
            s += sum(model.pair[ls[i], ls[i + 1]] for i in range(len(ls) - 1) if keep[i] and keep[i + 1])
            last = {}
            for i, u in enumerate(units):
                if keep[i] and ((u.form == "word" and len(u.text) > 3 and (model.names.likeness(u.low) > 0.2 or u.low in model.names.given)) or u.form in pii.MAY_BE):
                    if u.low in last and last[u.low] != i - 1 and ls[i] == ls[last[u.low]] != pii.O:
                        s += model.skip
                    last[u.low] = i
            return s

        best = max(itertools.product(*(m if k else (pii.O,) for m, k in zip(may, keep))), key=total)
        assert np.isclose(total(labels), total(best))


def test_repeated_name_is_read_alike(model):
    """What is plain in one place decides where it isn't."""
    strong = model.__class__(model.names, model.unary, model.pair, skip=50.0)
    units = pii.units_of("Ring 9125550143 now. Commit 9125550143 failed.")
    weak = [k for u, k in zip(units, pii.infer(model.__class__(model.names, model.unary, model.pair, skip=0.0), units)) if u.form == "digits10"]
    tied = [k for u, k in zip(units, pii.infer(strong, units)) if u.form == "digits10"]
    assert weak[0] == pii.PHONE and tied == [pii.PHONE, pii.PHONE]


def test_operators(spark, model):
    rows = [(1, "Contact: Maya Brenelli, +1 212 555 0151, or Maya Brenelli.", 5), (2, None, 5), (3, "", 5), (4, "plain " * 20_000, 5), (1, "Mail a@b.example", 5)]
    df = spark.createDataFrame(rows, "rec_id int, body string, kind int")
    got = sorted((r.rec_id, r.kind, r.nth) for r in pii.tag(df, "rec_id", "body", model).collect())
    assert got == [(1, "email", 1), (1, "person", 1), (1, "person", 2), (1, "phone", 1)]
    red = {r.redacted for r in pii.redact_column(df, "body", model).collect()}
    assert red == {"Contact: [PERSON], [PHONE], or [PERSON].", None, "", "plain " * 20_000, "Mail [EMAIL]"}
    assert pii.tag(df.limit(0), "rec_id", "body", model).count() == 0


def test_fit_on_tables(spark):
    """Fitting doesn't depend on the order of rows; an empty roster and empty texts still give a model."""
    roster = spark.createDataFrame([(g, f + "mann") for g, f in zip(GIVEN, STEMS)], "given_name string, family_name string")
    texts = spark.createDataFrame(list(enumerate(PROSE)), "k int, body string")
    a = pii.fit_on([(texts, "k", "body")], roster)
    b = pii.fit_on([(texts.orderBy("body"), "k", "body")], roster.orderBy("family_name"))
    assert np.allclose(a.pair, b.pair) and a.unary.keys() == b.unary.keys()
    empty = pii.fit_on([(texts.limit(0), "k", "body")], roster.limit(0))
    assert kinds(empty, "Mail a@b.example now") == [("email", "a@b.example")]


def held_out():
    """(text, {(kind, start, end)}) of each sentence of the held-out file."""
    import pathlib
    import re

    for line in pathlib.Path(__file__).with_name("pii_heldout.txt").read_text(encoding="utf-8").splitlines():
        if not line.startswith("#"):
            text, want = "", set()
            for bit in re.split(r"(\[\[\w+\|.*?\]\])(?!\])", line):
                if m := re.fullmatch(r"\[\[(\w+)\|(.*)\]\]", bit):
                    want.add((m[1], len(text), len(text) + len(m[2])))
                    bit = m[2]
                text += bit
            yield text, want


def test_held_out_file(model):
    """Sentences on other matters than those of the test tables, with names that no roster holds."""
    right = wrong = missed = n = 0
    for text, want in held_out():
        got = set(pii.find_spans(model, text))
        n += 1
        right, wrong, missed = right + len(want & got), wrong + len(got - want), missed + len(want - got)
    assert n >= 200
    assert right / (right + wrong) >= 0.9 and right / (right + missed) >= 0.9, (right, wrong, missed)


def test_similar_words_are_tied(model):
    """A name one letter off, and a number without its country code, meet in skip edges."""
    units = pii.units_of("Elif Volkwick said no; the clerk wrote volkwik. Ring +1 912 555 0143, and 9125550143 later.")
    equal, near = pii.skip_edges(units, list(range(len(units))), model.names)
    text = lambda pairs: {(units[a].low, units[b].low) for a, b in pairs}
    assert not equal and text(near) == {("volkwick", "volkwik"), ("+1 912 555 0143", "9125550143")}


def test_frequent_words(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["Alpha beta beta", "alpha Beta", "ALPHA gamma", None, ""] * 2)], "k int, t string")
    counts, least = pii.frequent_words([(texts, "k", "t")], rows=3)
    assert least == 3 and counts == {"alpha": (6, 2), "beta": (4, 2)}
