"""Residue: evidence in single lines, and the counts against brute force."""

import random
from collections import defaultdict

import pytest

from sluiceway.llm import residue as r


def kind(line, text=None):
    closed = {x.casefold() for x in r._CLOSED.findall(text or line)}
    return next((k for x in r.lines_of(text or line) if (k := r.evidence_of(x, closed))), None)


@pytest.mark.parametrize(("line", "want"), [
    ("This page belongs to {{ team }} and covers it.", "placeholder"),
    ("Summary: ${owner}", "placeholder"),
    ("Owner: <your name>", "placeholder"),
    ("The window is TBD in north.", "placeholder"),
    ("Summary: %(component)s", "placeholder"),
    ("Dear [approver], hello", "placeholder"),
    ("Value (date to be filled in)", "placeholder"),
    ("Please enable JavaScript to run this app.", "script"),
    ("BITTE AKTIVIEREN SIE JAVASCRIPT, UM DIESE SEITE ZU SEHEN.", "script"),
    ("<html><body><h1>503 Service Unavailable</h1></body></html>", "error"),
    ("1. Something went wrong on our side.", "error"),
    ("Página no encontrada. Vuelva al inicio.", "error"),
    ("[12:01] ops: Too many requests.", "error"),
    ("null", "error"),
    ("Lorem ipsum dolor sit amet, consectetur adipiscing elit", "filler"),
    ("Sample text goes here.", "filler"),
    # reports, explanations and quotations
    ("The engine replaces `{{owner}}` at publish time.", None),
    ("We removed the lorem ipsum draft last week.", None),
    ("The message 'access denied' comes from an expired lease.", None),
    ("Clients saw a 502 page for 30 seconds, then recovered.", None),
    ("The TBD items were closed in the review.", None),
    ("A 404 on the probe path means the build lacks the handler.", None),
    ("The panel needs JavaScript modules compiled by the job; 4 were rebuilt.", None),
    ("This is <summary>short</summary> text.", None),
    ("See [the guide](http://x.example) at [12:30].", None),
    ('{"prompt": "so what", "label": 3}', None),
    ("", None),
])
def test_evidence(line, want):
    assert kind(line) == want


def test_lines():
    text = "<p>1. One. Two!</p>\r\n[09:30] team-a: Three  four\n* five\n\n"
    assert r.lines_of(text) == ["One.", "Two!", "Three four", "five"]
    assert r.normal_form("Job-a took 3.5 s on OPS-12") == r.normal_form("job-b took 44 s on ops-9")


def brute(rows, share, least, company):
    docs, n = defaultdict(list), defaultdict(int)
    for key, host, text in rows:
        n[host] += text is not None
        if text:
            docs[host].append((key, text))
    out = set()
    for host, members in docs.items():
        held = defaultdict(list)
        for key, text in members:
            lines = {r.normal_form(x) for x in r.lines_of(text)}
            for x in lines:
                held[x].append(len(lines))
        known = {x for x, c in held.items() if len(c) >= least and len(c) >= share * n[host] and sum(c) >= company * len(c)}
        for key, text in members:
            for x in r.lines_of(text):
                if r.evidence_of(x, set()) and r.normal_form(x) not in known:
                    out.add(key)
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    prose = [f"The {a} of {b} is fine and stays so." for a in ("queue", "lease", "cache") for b in ("alpha", "beta", "gamma", "delta")]
    rows = []
    for k in range(400):
        host = rng.choice(["wiki", "wiki", "chat", None])
        lines = rng.sample(prose, rng.randrange(1, 10))
        if rng.random() < 0.2:
            lines.append("Access denied.")  # amid prose: boilerplate where it recurs
        if rng.random() < 0.05:
            lines = ["Page not found."]
        if rng.random() < 0.03:
            lines.append(f"Summary: {{{{field{k}}}}}")
        rows.append((k, host, "\n".join(lines)))
    rows += [(900, "wiki", None), (901, "wiki", ""), (902, "x", "Not found. " * 3000), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id int, source string, text string, kind string").repartition(3)
    got = {x.doc_id for x in r.find_residue(df, share=0.05, rows=10, company=4).collect()}
    want = brute(rows, 0.05, 10, 4)
    assert got == want and 902 in want and len(want) > 20
    assert any("Access denied." in t and k not in want for k, _, t in rows if t)
    assert r.find_residue(df.limit(0)).count() == 0


def test_copies_do_not_vouch_for_each_other(spark):
    page = [f"Field {w}: {{{{{w}}}}}" for w in ("owner", "team", "queue", "lease", "cache", "zone")] + [f"The {w} of this page is set by its owner." for w in ("title", "scope", "level", "state")]
    prose = [f"The {a} of {b} stays as it is." for a in ("queue", "lease", "cache") for b in ("alpha", "beta", "gamma", "delta")]
    rows = [(k, "\n".join(page)) for k in range(30)]
    # the same page with other numbers, and with its placeholders only in part
    rows += [(100 + k, "\n".join([*page, f"Printed {k} times."])) for k in range(10)] + [(200 + k, "\n".join(page[k % 6 :])) for k in range(10)]
    # a line that recurs amid prose that differs is still boilerplate
    rows += [(300 + k, "\n".join([*prose[:k], *prose[k + 1 :], "Access denied."])) for k in range(12)]
    df = spark.createDataFrame([(k, "wiki", t) for k, t in rows], "doc_id int, source string, text string")
    assert {x.doc_id for x in r.find_residue(df).collect()} == {k for k, _ in rows if k < 300}


@pytest.mark.parametrize("line", [
    "404. That's an error.", "The requested URL was not found on this server.", "We're sorry, but something went wrong.", "Error 524: a timeout occurred", "Application error: a client-side exception has occurred",
    "Access to this page has been denied.", "Pagina non trovata", "Please turn JavaScript on and reload the page.", "Sed ut perspiciatis unde omnis iste natus error",
])
def test_common_residue(line):
    assert kind(line)


@pytest.mark.parametrize("line", ["cookies are required for baking day", "The flag is set by [section] in the ini", "Use ${HOME} as the base directory", "kubectl get pods -n {namespace}"])
def test_mentions(line):
    assert kind(line) is None


# written after the classifier was fitted, and not used to mend it
UNSEEN = {
    True: ["Error 503: backend fetch failed", "This webpage is not available", "The page you requested cannot be displayed", "Your account does not have access to this resource.", "An internal error has occurred, please try again later.", "Die angeforderte Seite konnte nicht gefunden werden.", "La página solicitada no está disponible", "Accès interdit", "You must enable cookies to use this site.", "JavaScript must be enabled to view this content.", "Enter your text here", "Quis autem vel eum iure reprehenderit qui in ea voluptate", "asdf qwer asdf", "Service unavailable. Try again later.", "Sorry, you are not authorized to access this page.", "Session timed out. Please sign in again."],
    False: ["The committee approved the budget for next year.", "Requests dropped by half after the fix.", "Add the new host to the list and restart the agent.", "The script failed twice on Tuesday because the disk was full.", "Wir haben den Fehler am Montag behoben.", "El equipo corrigió el error ayer.", "Browser sessions are kept for a week.", "Each page of the report has a title.", "We saw three timeouts during the test.", "The gateway pool was resized in May.", "Please read the notes before the meeting.", "The text of the policy was changed.", "Two sites share one uplink.", "Sign the visitor list at the door.", "Nous avons déplacé le service vers une autre cellule.", "The sample was taken at noon."],
}


def test_unseen_lines():
    right = sum(bool(kind(line)) == want for want, lines in UNSEEN.items() for line in lines)
    assert right >= 0.85 * sum(map(len, UNSEEN.values())), [line for want, lines in UNSEEN.items() for line in lines if bool(kind(line)) != want]
