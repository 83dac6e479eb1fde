"""Personal information in free text (problem 3).

Method: a skip-chain conditional random field. A text's units are its words and what has
the form of an address, a mail address or a number; each unit has a label. Potentials are
log-linear in the unit's features (form, cues around it, likeness to names) and tie
neighbours; distant units that are written alike, or nearly so, are tied by skip edges.
Labels are inferred by loopy max-product message passing over both kinds of edges, so that
a name or number read with certainty in one place is read likewise in the others; a
stretch without skip edges is solved exactly.

Weights are learned by an averaged structured perceptron from made-up sentences of everyday
office, travel and trade, in which names and numbers of all forms stand in contexts with
cues and in none, and from sentences of a bounded sample of the texts that hold nothing of
the kind. The weights of the two kinds of skip edges are learned in the same way from
made-up texts that name somebody or something again.

What is known of words and names is not sampled: all names of the roster and all words
frequent in all the texts (``frequent_words``) are looked up.

Scale: a count of words and one pass over the texts; no text is shuffled. Texts without a
unit that may be labelled are passed over.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "person")
LABELS = ("O", "TITLE", "GIVEN", "INITIAL", "PARTICLE", "FAMILY", "EMAIL", "PHONE", "ID", "ADDRESS")
O, TITLE, GIVEN, INITIAL, PARTICLE, FAMILY, EMAIL, PHONE, ID, ADDRESS = range(10)
KIND_OF = {EMAIL: "email", PHONE: "phone", ID: "id_number", ADDRESS: "address"}
#: Bounds of what the weights are fitted on: names of the roster, texts of a field whose sentences are drawn, sentences drawn of
#: them, made-up sentences, quiet ones beside these, made-up texts for the skip edges.
ROSTER_ROWS, SAMPLE_ROWS, SAMPLE_SENTENCES, SENTENCES, QUIET, REPEATS, EPOCHS, SEED = 5000, 1500, 4000, 4000, 2000, 150, 5, 11
#: A word is frequent if at least so many texts, and one in so many of them, hold it; so there are at most FREQUENT_OF times as many as a text has words.
FREQUENT_ROWS, FREQUENT_OF = 3, 20_000
#: Sweeps of message passing at most; it ends when no message moves any more, after these with the beliefs reached.
ROUNDS = 60

# Titles, name particles, and words that common given names share with ordinary prose.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir madam herr frau hr fr monsieur madame mme mlle m señor señora sr sra don doña".split())
PARTICLES = frozenset("van von de der den del della di da du la le ter zu bin ibn al el mac mc san dos das".split())
# Given and family names that are frequent in many countries and are no ordinary words of the languages read.
GIVEN_NAMES = frozenset(
    "adam ahmed aisha alejandro alessandro alice amina ana anders andrea andrew anh anita anna antonio arjun astrid ayşe beatriz benjamin boris brigitte camille carlos carmen caroline catherine charles charlotte chen chiara christopher claire daniel david deepak diego dmitri edward elena elizabeth emily emma erik eva fatima felix fernando francesca francisco françois fumiko gabriel george giovanni giulia greta hans haruto hassan helen henrik hiroshi hugo ibrahim igor ingrid irina isabella ivan jakub james jan jennifer jessica johan john jonas joseph juan julia jürgen kaito karen karl katarzyna kavita kenji kevin kwame lars laura lena li linda luca lucia luis magdalena mahmoud manuel marco margaret maria marie marta martin mary mateusz matthew mehmet mei michael miguel mohammed monika natalia nguyen nicolas nikolai noah olga oliver olivia omar oscar pablo patricia paul paulo pedro peter philip pierre piotr priya rachel rahul rajesh rebecca ricardo richard robert rosa ryan samuel sanjay sara sarah sebastian sergei simon sofia stefan stephen sunita susan svetlana tatiana teresa thomas tomasz valentina viktor vladimir wei william xavier yasmin yuki yusuf zhang".split()
)
FAMILY_NAMES = frozenset(
    "adeyemi ahmed ali almeida andersen anderson andersson anh bailey bauer becker bernard bianchi campbell carvalho castillo castro chen chowdhury clarke colombo costa davies davis diaz diallo dubois duarte eriksson evans fernandes fernandez ferrari ferreira fischer fontaine fournier gallagher garcia gomez gonzalez gonçalves gupta gutierrez hansen hernandez hoffmann horvat hughes hussain ibrahim ito ivanov iyer jackson jansen jensen johansson johnson jones kaminski kapoor khan kim kobayashi kovacs kowalczyk kowalski kumar lambert larsen laurent lefebvre lehmann li lin lindberg lopez martin martinez mbeki medina mehta mendoza meyer miller mitchell mohamed moreau moreno morales mukherjee müller murphy nakamura nguyen nielsen novak nowak okafor okonkwo oliveira olsen ortiz owusu papadopoulos patel pereira perez petersen peterson petrov phillips popescu popov raghunathan ramirez ramos rao reddy reyes ribeiro richter rinaldi rivera roberts robinson rodrigues rodriguez romano rossi ruiz russo sanchez santos sato schmidt schneider schröder schulz sharma shevchenko silva singh smirnov sokolov sousa stewart suzuki svensson takahashi tanaka taylor thompson torres tran turner varga vasquez virtanen wagner walker wang watanabe weber wei williams wilson wójcik wright yamamoto yilmaz zhang zhou zimmermann".split()
)

# --- units

_HYPHEN = "‐‑‒–—−"
_FOLDS = {ord(c): "-" for c in _HYPHEN} | {ord(c): "'" for c in "’‘ʼ`´"} | {0xA0: " ", 0x202F: " ", 0x2009: " "}


def fold(text: str) -> tuple[str, list[int] | None]:
    """The text with compatible characters made plain, and for each character its place in the text (None: the same)."""
    if text.isascii():
        return text, None
    out, at = [], []
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        while j < n and unicodedata.combining(text[j]):
            j += 1
        c = text[i:j]
        if not (j == i + 1 and (c.isascii() or c.isalpha() and ord(c) < 0x250)):
            c = "" if unicodedata.category(c[0]) == "Cf" else unicodedata.normalize("NFKC", c).translate(_FOLDS)
        for x in c:
            out.append(x)
            at.append(i)
        i = j
    at.append(n)
    return "".join(out), at


_STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Court|Ct|Drive|Dr|Way|Place|Pl|Square|Sq|Terrace|Crescent|Boulevard|Blvd|Highway|Hwy|Parade|Mews|Row|Grove|Gardens)"
_PROPER = r"[A-ZÀ-ÞŞ][\w'\-]*"
#: What may follow an address in a list is no town.
_NO_TOWN = r"(?!(?i:ssn|social|passport|tax|national|identity|id|driv\w+|licen[cs]e|personalausweis|nino|dni|phone|tel|mobile|call|ring|e-?mail|mrs?|ms|mx|dr|prof|herr|frau)\b)"
_TOWN = rf"(?:,\s+{_NO_TOWN}{_PROPER}(?:[ \-]{_PROPER})?(?:,?\s+(?:[A-Z]{{2}}\s+)?\d{{4,6}}(?:-\d{{4}})?)?|,\s+\d{{4,6}}\s+{_PROPER}(?:[ \-]{_PROPER})?)"
_UNIT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Ste|Room|Floor)\.?\s+\d{1,5}[A-Z]?\s*(?:[,/]\s*|\s+))"
_ADDRESS = (
    rf"{_UNIT}?\d{{1,5}}[A-Z]?\s+(?:{_PROPER}\s+){{1,3}}(?i:{_STREET})\b\.?(?:\s+(?:NW|NE|SW|SE|N|S|E|W)\b\.?)?{_TOWN}?"
    rf"|(?i:p\.?\s?o\.?\s*box|post office box|postfach|apartado|boîte postale)\s+\d{{1,7}}{_TOWN}?"
    rf"|\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?i:rue|avenue|boulevard|place|chemin|allée|impasse|quai)\s+(?:(?i:de la|de l'|des|du|de|d')\s*)?{_PROPER}(?:[ \-]{_PROPER})?{_TOWN}?"
    rf"|(?i:calle|avenida|avda|plaza|paseo|camino|via|viale|piazza)\.?\s+(?:(?i:de la|del|de los|de)\s+)?{_PROPER}(?:\s+{_PROPER})?,?\s+\d{{1,4}}{_TOWN}?"
    rf"|(?:{_PROPER}(?:[ \-]{_PROPER})?[ \-])?[A-ZÀ-Þ][\w'\-]*(?i:weg|straße|strasse|str\.|gasse|platz|allee|ufer|damm|ring)\s+\d{{1,4}}\s?[a-z]?\b{_TOWN}?"
)
_DOMAIN = r"[A-Za-z0-9À-ɏ][\w\-]*"
_EMAIL = (
    rf"[A-Za-z0-9À-ɏ][\w.+\-%']*\s?(?:@|\(at\)|\[at\]|\{{at\}}|<at>|\(@\))\s?{_DOMAIN}(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\{{dot\}})\s?|\sdot\s){_DOMAIN})+"
    rf"|(?:\[at\]|(?<![\w.]))?[A-Za-z0-9À-ɏ][\w.+\-]*\s*(?:\[\s?at\s?\]|\(\s?at\s?\)|\bat\b)\s*{_DOMAIN}(?:\s*(?:\[\s?dot\s?\]|\(\s?dot\s?\)|\bdot\b)\s*{_DOMAIN})+"
)
_EXT = r"(?:\s*(?:,\s*)?(?:ext\.?|extension|x|Durchwahl|DW|poste)\s*\d{1,6})?"
_FORMS = (
    ("email", rf"(?i:{_EMAIL})"),
    ("url", r"(?:https?|ftp)://\S+"),
    ("blob", r"(?<![\w+/])[A-Za-z0-9+/_\-]{48,}={0,2}"),
    ("address", _ADDRESS),
    ("ssn", r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"),
    ("ssn_blank", r"(?<![\w\-])\d{3} \d{2} \d{4}(?![\w\-])"),
    ("licence", r"(?<![\w\-])[A-Z]{1,2}\d{2,4}-\d{3,5}-\d{3,5}(?![\w\-])"),
    ("national", r"(?<![\w\-])\d{6}[-+]\d{4}(?![\w\-])"),
    ("tax", r"(?<![\w\-])\d{2} \d{3} \d{3} \d{3}(?![\w\-])"),
    ("nino", r"(?<![\w\-])[A-Z]{2} \d{2} \d{2} \d{2} [A-D](?![\w\-])"),
    ("dotted", r"(?<![\w\-.])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w\-])"),
    ("fours", r"(?<![\w\-.+] )(?<![\w\-.+])\d{4} \d{4} \d{4}(?! ?\d)(?![\w\-])"),
    ("phone_plus", rf"(?<![\w])(?:\+|00[1-9])\d{{0,3}}(?:[ .\-]?(?:\(\d{{1,5}}\)|\d{{1,5}})){{2,6}}(?![\w]){_EXT}"),
    ("phone_area", rf"(?<![\w\-])\(\d{{2,5}}\)[ \-.]?\d{{3,4}}[ \-.]?\d{{3,4}}(?![\w]){_EXT}"),
    ("phone_lead", rf"(?<![\w\-.])00\d[ .\-]\d{{2,4}}[ .\-]\d{{3,4}}[ .\-]\d{{3,4}}(?![\w]){_EXT}"),
    ("phone_group", rf"(?<![\w\-.])(?:1[ .\-])?\d{{3}}([ .\-])\d{{3}}\g<-1>\d{{4}}(?![\w\-]){_EXT}"),
    ("phone_local", rf"(?<![\w\-.])(?:0\d{{4}} \d{{6}}|0\d{{2,4}}[ \-/]\d{{3,4}}(?:[ \-]\d{{3,4}})?)(?![\w\-]){_EXT}"),
    ("threes", r"(?<![\w\-.])\d{3} \d{3} \d{3}(?! ?\d)(?![\w\-])"),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])"),
    ("alnum_id", r"(?<![\w\-])(?=[A-Z0-9]*[A-Z])(?=(?:[A-Z]*\d){4})[A-Z0-9]{7,12}(?![\w\-])"),
    ("digits10", rf"(?<![\w\-.])\d{{10}}(?![\w\-]){_EXT}"),
    ("digits9", r"(?<![\w\-.])\d{9}(?![\w\-])"),
    ("digits8", r"(?<![\w\-.])(?:\d{8}|\d{11,12})(?![\w\-])"),
    ("dashed", r"(?<![\w\-.])\d+(?:-\d+){1,4}(?![\w\-])"),
    ("word", r"(?<![\w'])(?i:mrs?|ms|mx|dr|prof|hr|fr|sra?|[^\W\d_])\.(?=\s?[^\W\d_])|[^\W\d_]+(?:[-'][^\W\d_]+)*"),
    ("stop", r"[.!?]+(?=\s|$)|\n\s*\n|[|;:]"),
    ("mark", r"[,()<>\"]"),
)
#: Forms that may be personal, with the label each may take.
MAY_BE = {
    "email": EMAIL, "address": ADDRESS, "ssn": ID, "ssn_blank": ID, "licence": ID, "national": ID, "tax": ID, "nino": ID, "dotted": ID, "fours": ID, "threes": ID, "alnum_id": ID, "digits9": ID, "digits8": ID,
    "phone_plus": PHONE, "phone_area": PHONE, "phone_lead": PHONE, "phone_group": PHONE, "phone_local": PHONE, "digits10": PHONE,
}
#: Forms that are hardly ever anything else: no sentence with one of them is quiet.
SURE = frozenset(("email", "address", "ssn", "licence", "nino", "phone_plus", "phone_area", "phone_lead", "phone_group", "phone_local"))


@lru_cache(maxsize=1)
def _scanner():
    """One alternation of all forms; backreferences count groups within the whole."""
    parts, groups = [], 0
    for name, rx in _FORMS:
        own = re.compile(rx.replace(r"\g<-1>", r"(?:x)")).groups
        parts.append(f"(?P<{name}>" + rx.replace(r"\g<-1>", rf"\{groups + 2}") + ")")
        groups += 1 + own
    return re.compile("|".join(parts))


@dataclass
class Unit:
    form: str
    text: str
    start: int
    end: int
    low: str = ""


def units_of(folded: str) -> list[Unit]:
    out = []
    for m in _scanner().finditer(folded):
        out.append(Unit(m.lastgroup, m[0], *m.span(), m[0].lower()))
    return out


# --- likeness of words to names


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def _pieces(word: str) -> list[str]:
    w = "^" + word + "$"
    return [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]


@dataclass
class Names:
    """Given names, family names, a naive-Bayes likeness to family names by pieces of words, words common in lower case, and all frequent words."""

    given: frozenset[str]
    family: frozenset[str]
    weights: dict[str, float]
    common: frozenset[str]
    frequent: frozenset[str] = frozenset()
    cache: dict[str, float] = field(default_factory=dict)

    def likeness(self, word: str) -> float:
        if (s := self.cache.get(word)) is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            s = self.cache[word] = min(map(self._part, word.removeprefix("o'").split("-")))
        return s

    def _part(self, word: str) -> float:
        p = _plain(word.split("'")[-1])
        return -9.0 if len(p) < 4 or word in self.common else sum(self.weights.get(x, 0.0) for x in _pieces(p)) / (len(p) + 1)


def count_words(texts: list[str]) -> dict[str, tuple[int, int]]:
    """Of each word of four letters or more: how many texts hold it, and how many hold it in lower case."""
    seen: dict[str, list[int]] = {}
    for t in texts:
        for w in set(re.findall(r"[^\W\d_]{4,}", t)):
            n = seen.setdefault(w.lower(), [0, 0])
            n[0] += 1
            n[1] += w.islower()
    return {w: (a, b) for w, (a, b) in seen.items()}


def learn_names(roster: list[tuple[str | None, str | None]], counts: dict[str, tuple[int, int]], least: int = FREQUENT_ROWS) -> Names:
    """``counts``: those of ``count_words``, over all texts; what fewer than ``least`` texts hold says nothing."""
    given = {w.lower() for g, _ in roster for w in re.findall(r"[^\W\d_]+", g or "") if len(w) > 1}
    family = {w for _, f in roster for w in re.findall(r"[^\W\d_']+", (f or "").lower()) if len(w) > 2 and w not in PARTICLES}
    rostered = {_plain(w) for w in family} or {_plain(w) for w in FAMILY_NAMES}
    common = {w for w, (_, low) in counts.items() if low >= least and w not in family and w not in given}
    given |= GIVEN_NAMES - common
    family |= FAMILY_NAMES - common
    given |= {_plain(w) for w in given}
    family |= {_plain(w) for w in family}
    words = set(counts) - family
    pos, neg = defaultdict(int), defaultdict(int)
    for target, source in ((pos, rostered), (neg, {_plain(w) for w in words})):
        for w in source:
            for x in set(_pieces(w)):
                target[x] += 1
    n_pos, n_neg = len(rostered) + 1, len(words) + 1
    weights = {x: float(np.log((pos[x] + 0.3) / n_pos) - np.log((neg[x] + 0.3) / n_neg)) for x in {*pos, *neg}}
    return Names(frozenset(given), frozenset(family), weights, frozenset(common), frozenset(w for w, (n, _) in counts.items() if n >= least))


# --- features


def _shape(u: Unit) -> str:
    t = u.text
    return "I" if len(t.rstrip(".")) == 1 and t[0].isupper() else "U" if t.isupper() else "C" if t[:1].isupper() else "l"


_CUE_WORDS = 4


def features(units: list[Unit], i: int, names: Names) -> list[str]:
    u = units[i]
    before = [x for x in units[max(0, i - 6) : i]]
    cues = [x.low for x in before if x.form == "word"][-_CUE_WORDS:]
    prev = before[-1] if before else None
    nxt = units[i + 1] if i + 1 < len(units) else None
    f = ["b", "f:" + u.form]
    if u.form in MAY_BE:
        cue = " ".join(cues[-2:]) if cues else "^"
        f += [f"{u.form}|{cues[-1] if cues else '^'}", "c|" + (cues[-1] if cues else "^"), "cc|" + cue]
        f += [f"{MAY_BE[u.form]}~{c}" for c in cues]
        if prev is not None and prev.form == "mark":
            f.append(f"{u.form}|m{prev.text}")
        if nxt is not None:
            f.append("n|" + (nxt.low if nxt.form == "word" else nxt.form))
        return f
    if u.form != "word":
        return f
    s = _shape(u)
    f.append("s:" + s)
    low = u.low
    core = low.removesuffix("'s")
    if core.rstrip(".") in TITLES:
        f.append("title" + s)
    if low in PARTICLES:
        f.append("particle" + s)
    g = core in names.given or _plain(core) in names.given
    if g:
        f += ["given", "given" + s]
    k = _is_family(core, names)
    if _introduced(units, i, names):
        f.append("introduced")
    if core in names.frequent:
        f.append("frequent" + s)
    like = names.likeness(core)
    b = "hi" if like > 0.9 else "mid" if like > 0.35 else "lo" if like > 0 else "no"
    f += ["like:" + b, f"like:{b}{s}"]
    if k:
        f += ["family", "family" + s]
    if core in names.common:
        f.append("common")
    f.append("p|" + (prev.low if prev is not None and prev.form == "word" else prev.form if prev is not None else "^"))
    f.append("n|" + (nxt.low if nxt is not None and nxt.form == "word" else nxt.text if nxt is not None and nxt.form == "mark" else nxt.form if nxt is not None else "$"))
    for d, x in (("-", prev), ("+", nxt)):
        if x is not None and x.form == "word":
            f.append(f"{d}shape:{_shape(x)}{s}")
            l2 = names.likeness(x.low)
            if l2 > 0.9 or x.low in names.family:
                f.append(d + "like")
            if x.low in names.given:
                f.append(d + "given")
    return f


def _is_family(low: str, names: Names) -> bool:
    return any(p in names.family for p in (low, *low.replace("'", "-").split("-")))


def _introduced(units: list[Unit], i: int, names: Names) -> bool:
    """Whether a capital word that is like no known name stands where a family name does: behind a title or an initial, or, if it
    is no frequent word, next to a known given name."""
    u = units[i]
    low = u.low.removesuffix("'s")
    if u.form != "word" or not u.text[:1].isupper() or len(low) < 2 or low.endswith(".") or low in names.common or low in names.given:
        return False
    prev = units[i - 1] if i and u.start - units[i - 1].end <= 2 else None
    if prev is None or prev.form != "word":
        return False
    p = prev.low
    if p.rstrip(".") in TITLES and p.rstrip(".") not in PARTICLES and prev.text[:1].isupper() and p != "don":
        return True
    if len(p.rstrip(".")) == 1 and p.endswith(".") and prev.text[:1].isupper():
        return True
    return low not in names.frequent and prev.text[:1].isupper() and (p in names.given or p in PARTICLES)


def _may(u: Unit, names: Names, introduced: bool = False) -> tuple[int, ...]:
    """The labels that a unit may take."""
    if u.form in MAY_BE:
        return (O, MAY_BE[u.form])
    if u.form != "word":
        return (O,)
    out = [O]
    low = u.low.removesuffix("'s")
    if low in PARTICLES:
        return (O, PARTICLE)
    if low.rstrip(".") in TITLES:
        out.append(TITLE)
    if len(low.rstrip(".")) == 1:
        out.append(INITIAL)
    elif not low.endswith("."):
        if low in names.given or _plain(low) in names.given or u.text[:1].isupper():
            out.append(GIVEN)
        if introduced or names.likeness(low) > 0 or _is_family(low, names):
            out.append(FAMILY)
    return tuple(out)


def _anchors(units: list[Unit], names: Names) -> list[bool]:
    """Units that may begin or hold something personal; names need a likely family name beside them."""
    n = len(units)
    keep = [False] * n
    for i, u in enumerate(units):
        if u.form in MAY_BE:
            keep[i] = True
        elif u.form == "word":
            low = u.low.removesuffix("'s")
            if names.likeness(low) > 0.2 or _is_family(low, names) or _introduced(units, i, names):
                for j in range(max(0, i - 4), min(n, i + 5)):
                    keep[j] = True
    return keep


# --- inference


@dataclass
class Model:
    names: Names
    unary: dict[str, np.ndarray]
    pair: np.ndarray
    skip: float
    similar: float = 0.0

    def scores(self, units: list[Unit], i: int) -> np.ndarray:
        s = np.full(len(LABELS), -1e9)
        may = list(_may(units[i], self.names, _introduced(units, i, self.names)))
        total = np.zeros(len(LABELS))
        if len(may) > 1:
            for x in features(units, i, self.names):
                if (w := self.unary.get(x)) is not None:
                    total += w
        s[may] = total[may]
        return s


def skip_edges(units: list[Unit], nodes: list[int], names: Names) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs of distant ``nodes`` (by their place) that are written alike, and of such that are written nearly so: names of six
    letters or more one letter apart, parts of a double name, numbers with the same last seven digits."""
    equal, near = [], []
    last: dict[str, int] = {}
    loose: dict[str, int] = {}
    for a, i in enumerate(nodes):
        u = units[i]
        if u.form == "word":
            if len(u.text) <= 3 or not (names.likeness(u.low) > 0.2 or u.low in names.given or _is_family(u.low.removesuffix("'s"), names)):
                continue
            key = _plain(u.low.removesuffix("'s"))
            kin = [key[:j] + key[j + 1 :] for j in range(len(key))] if len(key) >= 6 else []
            kin += [key, *(p for p in key.split("-") if len(p) > 3)]
        elif u.form in MAY_BE and u.form != "address":
            key = re.sub(r"\D", "", u.text) or u.low
            kin = ["#" + key[-7:]] if key.isdigit() and len(key) >= 7 else []
        else:
            continue
        if key in last:
            if nodes[last[key]] != i - 1:
                equal.append((last[key], a))
        else:
            known = {loose[x] for x in kin if x in loose and nodes[loose[x]] < i - 1}
            near += [(b, a) for b in sorted(known)]
        last[key] = a
        for x in kin:
            loose[x] = a
    return equal, near


def _agreement(weight: float) -> np.ndarray:
    out = np.eye(len(LABELS)) * weight
    out[O, O] = 0.0
    return out


def infer(model: Model, units: list[Unit], rounds: int = ROUNDS) -> list[int]:
    """Labels by loopy max-product message passing along neighbours and skip edges; stretches without skip edges exactly."""
    keep = _anchors(units, model.names)
    nodes = [i for i, k in enumerate(keep) if k]
    labels = [O] * len(units)
    if not nodes:
        return labels
    theta = np.array([model.scores(units, i) for i in nodes])
    equal, near = skip_edges(units, nodes, model.names)
    runs = [[0]]
    for a in range(1, len(nodes)):
        if nodes[a] == nodes[a - 1] + 1:
            runs[-1].append(a)
        else:
            runs.append([a])
    tied = {x for pair in equal + near for x in pair}
    loopy: list[int] = []
    for run in runs:
        if tied.isdisjoint(run):
            for a, k in zip(run, _viterbi(theta[run], model.pair)):
                labels[nodes[a]] = k
        else:
            loopy += run
    if loopy:
        edges = [(a, a + 1, model.pair) for a in loopy if a + 1 < len(nodes) and nodes[a + 1] == nodes[a] + 1]
        edges += [(a, b, _agreement(model.skip)) for a, b in equal] + [(a, b, _agreement(model.similar)) for a, b in near]
        for a, k in _pass_messages(theta, loopy, edges, rounds).items():
            labels[nodes[a]] = k
    return labels


def _pass_messages(theta: np.ndarray, nodes: list[int], edges: list[tuple[int, int, np.ndarray]], rounds: int) -> dict[int, int]:
    """Loopy max-product: damped sweeps forth and back until no message moves."""
    n = theta.shape[1]
    msg = np.zeros((len(edges), 2, n))  # to the second end, to the first end
    around: dict[int, list[tuple[int, int, np.ndarray]]] = {a: [] for a in nodes}
    for e, (a, b, m) in enumerate(edges):
        around[a].append((e, 1, m))
        around[b].append((e, 0, m.T))
    for _ in range(rounds):
        moved = 0.0
        for order in (nodes, nodes[::-1]):
            for a in order:
                belief = theta[a] + sum(msg[e, side] for e, side, _ in around[a])
                for e, side, m in around[a]:
                    new = np.max((belief - msg[e, side])[:, None] + m, axis=0)
                    new = np.maximum(new - new.max(), -1e6)
                    new = 0.7 * new + 0.3 * msg[e, 1 - side]
                    moved = max(moved, float(np.abs(new - msg[e, 1 - side]).max()))
                    msg[e, 1 - side] = new
        if moved < 1e-3:
            break
    return {a: int(np.argmax(theta[a] + sum(msg[e, side] for e, side, _ in around[a]))) for a in nodes}


def spans_of(units: list[Unit], labels: list[int]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in reading order; a person needs a family name and a given name, an initial or a title."""
    out: list[tuple[str, int, int]] = []
    part: list[tuple[int, Unit]] = []

    def close() -> None:
        has = {k for k, _ in part}
        while part and part[-1][0] in (PARTICLE, TITLE):
            part.pop()
        if part and FAMILY in has and has & {GIVEN, INITIAL, TITLE}:
            out.append(("person", part[0][1].start, part[-1][1].end))
        part.clear()

    comma = False
    for u, k in zip(units, labels):
        if k in KIND_OF:
            close()
            out.append((KIND_OF[k], u.start, u.end))
            comma = False
        elif k == O:
            if u.form == "mark" and u.text == "," and part and {x for x, _ in part} <= {FAMILY, PARTICLE}:
                comma = True
                continue
            close()
            comma = False
        else:
            far = part and u.start - part[-1][1].end > (4 if comma else 3)
            has = {x for x, _ in part}
            again = k in (GIVEN, TITLE) and FAMILY in has and has & {GIVEN, TITLE, INITIAL} or k == FAMILY and FAMILY in has and has & {GIVEN, TITLE, INITIAL}
            if comma and k not in (GIVEN, INITIAL, TITLE) or far or again:
                close()
            comma = False
            part.append((k, u))
    close()
    return out


def find_spans(model: Model, text: str) -> list[tuple[str, int, int]]:
    folded, at = fold(text)
    units = units_of(folded)
    if not units:
        return []
    spans = spans_of(units, infer(model, units))
    return spans if at is None else [(k, at[a], at[b - 1] + 1 if b <= a else _end(at, b)) for k, a, b in spans]


def _end(at: list[int], b: int) -> int:
    """The end in the text of what ends before folded place ``b``."""
    return at[b] if at[b] != at[b - 1] else at[b - 1] + 1


PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        out += [text[last:a], PLACEHOLDER[kind]]
        last = b
    return "".join([*out, text[last:]])


# --- fitting

# Made-up contexts: {p} person, {e} mail, {t} phone, {i} identity number with its name, {a} address, {g} a given name that is none,
# {n}, {N} something counted, {m} a thing with a name in capitals, {w} an invented word in lower case, {d..} as many digits.
_CONTEXTS = (
    "The lease was signed by {p} yesterday.", "My landlord, {p}, lives at {a}.", "Dinner with {p} and {p} at eight?", "Send the parcel to {p}, {a}.", "You can reach our dentist at {t}.", "Fax it to {t} before noon.",
    "{p} will host the workshop.", "Dear {p}, thank you for the flowers.", "Kind regards, {p}", "The invoice goes to {e}, not to me.", "Reply to {e} or ring {t}.", "Her mobile is {t}.", "His new e-mail is {e}", "Text me at {t}",
    "For tickets dial {t}.", "Home address: {a}", "They moved to {a} in spring.", "The plumber ({p}) came late.", "The visa form asks for the {i}.", "His {i} had a typo.", "I lost a wallet with my {i} in it.", "Applicant: {p}, {i}",
    "{p} / {t} / {e}", "Guardian: {p}", "Emergency contact {p}, {t}", "According to {p} the museum is closed.", "We elected {p} as treasurer.", "The bill of {p} is unpaid.", "This recipe is by {p}.", "Have you met {p} from accounting?",
    "The keynote is given by {p} on Friday.", "Interview with {p}, the new coach", "Forwarded by {p} to {e}", "Is {p} back from holiday?", "Ask {p} for the key.", "Tell {p} that the car is ready", "Give {p} a call on {t}", "Call {t}", "or {t}", "on {t}?", "Tel: {t}", "Phone {t}",
    "{t} is the number of the clinic.", "Deliver to {a}", "at {a}.", "{a}", "The shop at {a} opens at nine.", "{p} <{e}>", "{e}", "cc {e}", "mailto {e}", "from {e},", "{p}", "{p}, {t}", "{p} ({e})", "my {i}", "{i}.", "with {i},", "Please check {i} and {i}.",
    "{p} wrote: see you soon", "by {p}", "with {p}.", "to {p}, who agreed", "from {p}?", "via {p}", "owner {p}", "contact {p}", "signed {p}", "names {p}", "for {p},", "next to {p}", "The nurse {p} took the call.", "Nurse and patient: {p}; {p}", "Witness: {p}, born in {d4}.",
    "Mr and Mrs said {p} had left.", "The register listed {p}, {a}, {i}.", "listed {p}, {a}, {i}", "it lists {p}, {a}", "The card held {t} beside {p}.", "{t} next to {p}", "it held {t}", "contact {p} <{e}>", "reached {p} at {t}", "My {i} is expired.", "Her {i} is wrong, isn't it?", "the {i} is valid until May", "{t} is busy.", "{t} is my number", "{i} was refused", "{a} is far away.", "{e} is full.", "The note held {t}.", "the page lists {t}", "The message contained {t} and {i}.", "She left {t} on the machine", "He gave {t} as a contact.", "reach {p} at {t}", "reach {t}", "Reach us on {t} or {t}.", "Reach {p} on {t}.", "over the phone: {t}", "by phone ({t})",
    "the phone ({t})", "The keys are with {p} at {a}.", "We stay at {a}, bring {p}.", "Pick it up at {a}, then ring {p}.", "kept in {a}", "Stored: {a}, see {p}", "{p} of {a}", "Return the books to {a} by May.", "near {a}, behind the church", "it holds {t}", "the letter held {i}", "holding {t} with {p}", "and {p} too", "{p} asked twice.", "{p} and {p} are away.", "A letter for {p} came back.", "what {p} wanted was a refund", "he gave {t} and {i}", "shown: {a}; {t}", "on file: {i}", "text: {t}, {e}",
)
_PLAIN_CONTEXTS = (
    "{N} {d9} is closed.", "{N} {d10} was paid.", "{N} {d8} arrived with {d2} boxes.", "{n} {d10}", "{n} {d9} and {n} {d10} differ.", "{N} {d8} to {d8}.", "{N} {d3}-{d2}-{d3} failed.", "{N} {d4}-{d4} is free.", "see {n} {d9} for more", "the {n} {d10} began", "at {n} {d9}",
    "{N} {d4} {d4} {d4} is full.", "{N} {d3} {d3} {d3} is open.", "The {n} stands at {d10}.", "The {n} grew from {d8} to {d9}.", "{N} A{d8} is blue.", "{N} {d1}.{d2}.{d1} is out.", "We sold {d3} of {d4}.", "The count is {d9}", "the total of {d10} bytes", "{d10} rows were read", "{d9} views in a week",
    "It took {d3} ms on {d4} machines.", "Address {d3}.0.{d2}.{d1} answered.", "{g} period ends in {d2} days.", "{g} my words.", "{g} by {d2} percent", "{g} twice if it rains.", "{g} is a flower.", "{g}, what is the time?", "Ask {g} about it.", "{g} only after lunch.", "We toured {m} last {m}.", "The {m} report is late.",
    "{m} opens at {d2}:{d2}.", "I read {m} twice.", "The band is named {m}.", "{m} won the cup.", "Meet at {m}.", "the {m} team moved to {m}", "{m} is a code name.", "{N} {w} was slow.", "the {n} {w} runs", "{N} {w} gave up {d2} times.", "{w} is on.", "switch {w} off", "the {w} {n}", "{w} {w} is a word", "in {w}.", "We call it {w}.", "Passport control is slow.", "The phone is new.", "Call it a day.", "A street lamp broke.", "Mail comes at ten.", "Identity is a hard question.",
    "Dr Pepper is a drink.", "Dear all, lunch is at {d2}:{d2}.", "Mr and Mrs of the year", "Miss a turn.", "A. and B. are options.", "Plan B. Start again.", "Vitamin C. Take two.", "How Much Does The {m} Cost In The North?", "Show The Price Of The Small Box", "What Is The Limit Of The {N}?", "Is It Safe To Move The {N}?",
)
_COUNTED = tuple(
    "invoice order ticket case build commit offset counter job batch row account session request version port serial shipment receipt page chapter timestamp epoch error claim checksum hash key flag module lane sequence retry run record entry item part model room gate flight bus train meter lot block index cluster node shard event message reference tracking booking article batch position revision transaction balance sum total size count score level"
    .split()
)
_MADE_THINGS = ("Silver Lake", "Northern Line", "Golden Gate", "Spring Fair", "Old Harbour", "Red River", "Monday Club", "Winter Games", "Blue Note", "Grand Hotel", "Central Park", "Green Week", "Town Hall", "High Season", "Black Friday", "Quiet Hour", "Summer School", "Open Day", "Iron Bridge", "Night Market")
_SYLLABLES = ("ra", "gu", "na", "than", "ko", "wal", "czyk", "o", "kon", "kwo", "ni", "shi", "mu", "ra", "ta", "na", "ka", "ber", "lin", "sen", "ved", "ska", "vic", "mar", "ti", "nez", "dra", "gos", "el", "ba", "ri", "phan", "thu", "jor", "gen", "bak", "her", "zhou", "aki", "fe", "mi", "yo", "sof", "lund", "dahl", "ström", "ferr", "ucci", "esc", "ut", "iou")
_TOWNS = ("Norwood", "Eastbrook", "Milldale", "Ravensburg", "Luzerne", "Highmoor", "Castlebar", "Oakfield")
_ROADS = ("Maple", "Station", "Harbour", "Church", "Old Mill", "Victoria", "Birchwood", "Kingsgate")
_ID_NAMES = ("SSN", "social security no.", "social security number", "passport", "passport no.", "passport number", "tax ID", "tax number", "national ID", "identity card", "driving licence", "driver's license", "licence no.", "Personalausweis", "ID card no.", "NINO", "DNI", "CPF", "Aadhaar", "SIN", "Steuernummer", "personnummer")


def _fill_digits(rng: random.Random, pattern: str) -> str:
    return "".join(rng.choice("0123456789") if c == "9" else rng.choice("ABCDEFGHKLMXYZ") if c == "A" else c for c in pattern)


def _made_person(rng: random.Random, given: list[str], family: list[str], stems: list[str], tails: list[str]) -> list[tuple[str, int]]:
    """Words of a person's name with their labels."""
    r = rng.random()
    f = rng.choice(family) if r < 0.45 else (rng.choice(stems) + rng.choice(tails)).capitalize() if r < 0.85 else "".join(rng.choice(_SYLLABLES) for _ in range(rng.randrange(2, 4))).capitalize()
    if rng.random() < 0.1:
        f += "-" + rng.choice(family)
    elif rng.random() < 0.08:
        f = "O'" + f
    g = rng.choice(given) if rng.random() < 0.75 else "".join(rng.choice(_SYLLABLES) for _ in range(2)).capitalize()
    style = rng.random()
    part = [(rng.choice(("van", "de", "von")), PARTICLE)] if rng.random() < 0.06 else []
    if style < 0.42:
        out = [(g, GIVEN), *part, (f, FAMILY)]
    elif style < 0.56:
        out = [(g, GIVEN), (rng.choice("ABCDEHJKLMNPRSTW") + ".", INITIAL), *part, (f, FAMILY)]
    elif style < 0.68:
        out = [(g[0] + ".", INITIAL), *part, (f, FAMILY)]
    elif style < 0.82:
        out = [(rng.choice(("Mr", "Ms.", "Mrs", "Dr.", "Mx", "Mr.", "Prof.", "Herr", "Frau")), TITLE), *part, (f, FAMILY)]
    elif style < 0.92:
        out = [*part, (f + ",", FAMILY), (g, GIVEN)]
    else:
        out = [(f.upper(), FAMILY), (g, GIVEN)]
    r = rng.random()
    if r < 0.1:
        out = [(w.lower(), k) for w, k in out]
    elif r < 0.2:
        out = [(w.upper() if k == FAMILY else w, k) for w, k in out]
    return out


def made_sentence(rng: random.Random, given: list[str], family: list[str], stems: list[str], tails: list[str]) -> list[tuple[str, int | None]]:
    """A sentence as pieces with labels; None where the words are of no kind."""
    phones = ("+1 999 555 9999", "+1-999-555-9999", "(999) 999-9999", "999-999-9999", "999.999.9999", "9999999999", "+44 20 9999 9999", "020 9999 9999", "+61 2 9999 9999", "+49 30 99999 999", "001 999 999 9999", "+33 1 99 99 99 99", "999-999-9999 ext. 99", "999 999 9999")
    ids = ("999-99-9999", "999 99 9999", "999999999", "A9999999", "AA999999", "99 999 999 999", "999999-9999", "A999-9999-9999", "A99A99999", "99999999", "AA 99 99 99 C", "999.999.999-99", "9999 9999 9999", "999 999 999")
    out: list[tuple[str, int | None]] = []
    plain = rng.random() < 0.35
    for bit in re.split(r"(\{\w+\})", rng.choice(_PLAIN_CONTEXTS if plain else _CONTEXTS)):
        if bit == "{p}":
            out += [(w + " ", k) for w, k in _made_person(rng, given, family, stems, tails)]
            out[-1] = (out[-1][0].rstrip(), out[-1][1])
        elif bit == "{e}":
            dom = rng.choice(("mail.example", "corp.example.net", "ops-desk.test"))
            local = rng.choice((rng.choice(given).lower(), rng.choice(family).lower() + "9", "team-lead", "a.b+c"))
            out.append((f"{local}@{dom}" if rng.random() < 0.75 else f"{local} [at] {dom.replace('.', ' [dot] ')}", EMAIL))
        elif bit == "{t}":
            out.append((_fill_digits(rng, rng.choice(phones)), PHONE))
        elif bit == "{i}":
            bare = rng.random() < 0.15
            out += [(("" if bare else rng.choice(_ID_NAMES) + " "), None), (_fill_digits(rng, ids[0] if bare else rng.choice(ids)), ID)]
        elif bit == "{a}":
            road, town = rng.choice(_ROADS), rng.choice(_TOWNS)
            n = str(rng.randrange(1, 900))
            kind = rng.choice((f"{n} {road} Street, {town}", f"Flat {n}, {n} {road} Road", f"P.O. Box {n}, {town}", f"{n} {road} Ave, {town} 12345", f"Calle {road.split()[-1]} {n}, {town}", f"{n} rue des {road.split()[-1]}s, 75001 {town}", f"{road.split()[-1]}weg {n}, 80331 {town}"))
            out.append((kind, ADDRESS))
        elif bit == "{g}":
            out.append((rng.choice(given), None))
        elif bit == "{n}":
            out.append((rng.choice(_COUNTED), None))
        elif bit == "{N}":
            out.append((rng.choice(_COUNTED).capitalize(), None))
        elif bit == "{w}":
            out.append((((rng.choice(stems) + rng.choice(tails)).lower() if rng.random() < 0.4 else "".join(rng.choice(_SYLLABLES) for _ in range(rng.randrange(2, 5)))), None))
        elif bit == "{m}":
            out.append((rng.choice(_MADE_THINGS), None))
        elif bit.startswith("{d"):
            out.append(("".join(rng.choice("0123456789") for _ in range(int(bit[2:-1]))), None))
        elif bit:
            out.append((bit, None))
    return out


def _gold(pieces: list[tuple[str, int | None]]) -> tuple[str, list[Unit], list[int]]:
    text, spans = "", []
    for s, k in pieces:
        if k is not None:
            spans.append((len(text), len(text) + len(s.rstrip()), k))
        text += s
    units = units_of(fold(text)[0])
    labels = []
    for u in units:
        k = next((k for a, b, k in spans if a <= u.start < b), O)
        if k in KIND_OF:
            k = k if MAY_BE.get(u.form) == k else O
        elif u.form != "word":
            k = O
        labels.append(k)
    return text, units, labels


def _viterbi(theta: np.ndarray, pair: np.ndarray) -> list[int]:
    score, back = theta[0], []
    for t in theta[1:]:
        all_ = score[:, None] + pair
        back.append(all_.argmax(axis=0))
        score = all_.max(axis=0) + t
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _made_text(rng: random.Random, *names: list[str]) -> list[tuple[str, int | None]]:
    """Two to four sentences, some plain, in which somebody or a number comes again, by the last name, in capitals or without its cue."""
    pieces: list[tuple[str, int | None]] = []
    for _ in range(rng.randrange(2, 4)):
        pieces += [*made_sentence(rng, *names), (" ", None)]
    marked = [(s, k) for s, k in pieces if k in (FAMILY, PHONE, ID, EMAIL)]
    if marked:
        s, k = rng.choice(marked)
        s = s.strip(" ,")
        if k == FAMILY:
            first = rng.choice(names[0])
            at = rng.randrange(1, max(2, len(s) - 1))
            forms = (s, s.upper(), s.lower(), s[:at] + s[at + 1 :] if len(s) > 6 and s.isalpha() else s)
            again = [(rng.choice(("Later ", "Then ", "So ", "again, ", "(")), None), (first + " ", GIVEN), (rng.choice(forms), FAMILY), (rng.choice((" came.", " said so.", "", ")")), None)]
        else:
            bare = re.sub(r"\D", "", s) if k == PHONE and rng.random() < 0.5 else s
            again = [(rng.choice(("It was ", "again ", "see ", "", "(")), None), (bare, k), (rng.choice((" as above.", "", " too.", ")")), None)]
        pieces += again
    return pieces


def _prepare(units: list[Unit], gold: list[int], names: Names, rng: random.Random) -> tuple[list[list[str]], np.ndarray, list[int]]:
    """Features, allowed labels and labels; some numbers and addresses lose their cues, so that their form alone is judged as well."""
    feats, mask = [], np.full((len(units), len(LABELS)), -1e9)
    for i, u in enumerate(units):
        may = _may(u, names, _introduced(units, i, names))
        feats.append(features(units, i, names) if len(may) > 1 else [])
        if u.form in MAY_BE and rng.random() < 0.3:
            feats[-1] = feats[-1][:2]
        mask[i, list(may)] = 0.0
        mask[i, gold[i]] = 0.0
    return feats, mask, gold


def _learn_skips(model: Model, texts: list[tuple[list[Unit], list[int]]], scale: float, epochs: int = 2) -> tuple[float, float]:
    """The averaged perceptron for the two skip weights, the others fixed: each moves by how many of its edges agree in the right
    labelling, less how many do in the one found."""
    weights, sums, seen = np.zeros(2), np.zeros(2), 0
    ready = []
    for units, gold in texts:
        nodes = [i for i, k in enumerate(_anchors(units, model.names)) if k]
        edges = skip_edges(units, nodes, model.names)
        if edges[0] or edges[1]:
            ready.append((units, gold, nodes, edges))
    for _ in range(epochs):
        for units, gold, nodes, edges in ready:
            got = infer(Model(model.names, model.unary, model.pair, *weights), units, rounds=15)
            for k in (0, 1):
                agree = lambda ls: sum(ls[nodes[a]] == ls[nodes[b]] != O for a, b in edges[k])  # noqa: B023, E731
                weights[k] = max(0.0, weights[k] + scale * (agree(gold) - agree(got)))
            sums += weights
            seen += 1
    skip, similar = (sums / seen if seen else weights).tolist()
    return skip, similar


def fit(
    roster: list[tuple[str | None, str | None]], background: list[str], sentences: int = SENTENCES, epochs: int = EPOCHS, seed: int = SEED,
    counts: dict[str, tuple[int, int]] | None = None, least: int = FREQUENT_ROWS, more_names: list[tuple[str | None, str | None]] = (),
) -> Model:
    """The model from names of the roster and sentences of the texts; the same for the same input, in whatever order it comes.

    ``counts``: of the words of all texts (those of ``background`` if not given); ``more_names``: of the roster, to look up only."""
    rng = random.Random(seed)
    roster, background = sorted(set(roster), key=str), sorted(set(background))
    names = learn_names([*roster, *more_names], count_words(background) if counts is None else counts, least)
    given = sorted({g for g, _ in roster if g}) or ["Alex", "Maria"]
    family = sorted({f for _, f in roster if f and "-" not in f and "'" not in f}) or ["Miller", "Rossi"]
    cut_at = [(f[:i], f[i:]) for f in family for i in (len(f) // 2, len(f) // 2 + 1) if len(f) > 5] or [("Mil", "ler")]
    stems, tails = [a for a, _ in cut_at], [b.lower() for _, b in cut_at]
    # beside those of the roster, names that it doesn't hold
    given = given + sorted(g.capitalize() for g in GIVEN_NAMES)[:: max(1, len(GIVEN_NAMES) // (1 + len(given) // 2))]
    family = family + sorted(f.capitalize() for f in FAMILY_NAMES)[:: max(1, len(FAMILY_NAMES) // (1 + len(family) // 2))]
    data = [_gold(made_sentence(rng, given, family, stems, tails))[1:] for _ in range(sentences)]
    quiet = []
    known = names.given | names.family
    for t in background:
        folded = fold(t)[0]
        for s in re.split(r"(?<=[.!?])\s+|\n+", folded):
            low = s.lower()
            if "@" in s or re.search(r"\d{4}|\(?\d{3}\W", s) or any(w in known or w in TITLES for w in re.findall(r"[^\W\d_]+", low)):
                continue
            quiet.append(s)
    rng.shuffle(quiet)
    taken = 0
    for s in quiet:
        units = units_of(s)
        if not units or any(u.form in SURE for u in units):
            continue
        data.append((units, [O] * len(units)))
        taken += 1
        if taken >= QUIET * sentences // SENTENCES:
            break

    n = len(LABELS)
    unary: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
    pair = np.zeros((n, n))
    sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
    pair_sum = np.zeros((n, n))
    step = 1
    prepared = [_prepare(units, gold, names, rng) for units, gold in data]
    for _ in range(epochs):
        rng.shuffle(prepared)
        for feats, mask, gold in prepared:
            theta = mask + 1.0  # with a margin: every other label gets a head start
            theta[np.arange(len(gold)), gold] -= 1.0
            for i, fs in enumerate(feats):
                for x in fs:
                    if x in unary:
                        theta[i] += unary[x]
            got = _viterbi(theta, pair)
            if got != gold:
                for i, (g, w) in enumerate(zip(gold, got)):
                    if g != w:
                        for x in feats[i]:
                            unary[x][g] += 1
                            unary[x][w] -= 1
                            sums[x][g] += step
                            sums[x][w] -= step
                    if i:
                        pg, pw = (gold[i - 1], g), (got[i - 1], w)
                        if pg != pw:
                            pair[pg] += 1
                            pair[pw] -= 1
                            pair_sum[pg] += step
                            pair_sum[pw] -= step
            step += 1
    mean = {x: w - sums[x] / step for x, w in unary.items()}
    scale = float(np.mean([np.abs(w).max() for w in mean.values()])) if mean else 1.0
    model = Model(names, mean, pair - pair_sum / step, 0.0)
    repeats = [_gold(_made_text(rng, given, family, stems, tails))[1:] for _ in range(REPEATS)]
    model.skip, model.similar = _learn_skips(model, repeats, scale / 10)
    return model


def frequent_words(texts: list[tuple[DataFrame, str, str]], rows: int = FREQUENT_ROWS, one_of: int = FREQUENT_OF) -> tuple[dict[str, tuple[int, int]], int]:
    """(``count_words`` of all texts, of the words that enough of them hold; how many that is)."""
    words = None
    for df, _, column in texts:
        part = df.where(F.col(column).isNotNull()).select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(r"(\p{L}{4,})"), 1))).alias("w"))
        words = part if words is None else words.unionByName(part)
    least = max(rows, -(-sum(df.where(F.col(column).isNotNull()).count() for df, _, column in texts) // one_of))
    cased = words.groupBy("w").agg(F.count("*").alias("n"))
    low = F.lower("w")
    counts = cased.groupBy(low.alias("word")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("w") == low, F.col("n")).otherwise(0)).alias("low")).where(F.col("n") >= least)
    return {r.word: (r.n, r.low) for r in counts.toLocalIterator()}, least


def fit_on(texts: list[tuple[DataFrame, str, str]], roster: DataFrame, sample_rows: int = SAMPLE_ROWS, roster_rows: int = ROSTER_ROWS) -> Model:
    """Fits on at most ``roster_rows`` names and ``SAMPLE_SENTENCES`` sentences of ``sample_rows`` texts of each (table, key, column), those
    with the smallest hashes. All names of the roster and all frequent words are looked up."""
    import pyarrow as pa

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [s for t in batch.column(0).to_pylist() for s in re.split(r"(?<=[.!?])\s+|\n+", t) if s.strip()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["s"])

    people = [(r.given_name, r.family_name) for r in roster.select("given_name", "family_name").distinct().orderBy(F.xxhash64("given_name", "family_name"), "given_name", "family_name").toLocalIterator()]
    background = []
    for df, key, column in texts:
        rows = df.where(F.length(column) > 0).select(F.col(column).alias("t"), F.xxhash64(key).alias("h")).orderBy("h", "t").limit(sample_rows).select("t")
        drawn = rows.mapInArrow(sentences, "s string").distinct().orderBy(F.xxhash64("s"), "s").limit(SAMPLE_SENTENCES).collect()
        background += [r.s for r in drawn]
    counts, least = frequent_words(texts)
    return fit(people[:roster_rows], background, counts=counts, least=least, more_names=people[roster_rows:])


# --- operators


def tag(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """One row per occurrence: ``key``, ``kind``, ``nth`` (per row and kind, in reading order), ``start``, ``end`` (code points).

    Null and empty texts hold none; rows that repeat are tagged each; an empty table gives
    no rows; other columns are not read.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not s:
                    continue
                nth: dict[str, int] = defaultdict(int)
                for kind, a, b in find_spans(model, s):
                    nth[kind] += 1
                    for c, v in zip(cols, (k, kind, nth[kind], a, b)):
                        c.append(v)
            types = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "kind", "nth", "start", "end"])

    out = df.select(key, text).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, kind string, nth bigint, start int, end int")
    return out.withColumnRenamed("key", key)


def redact_column(df: DataFrame, text: str, model: Model, out: str = "redacted") -> DataFrame:
    """``df`` with ``out``: the text with a typed placeholder for each occurrence; null stays null."""
    import pandas as pd

    def run(batches):
        for s in batches:
            yield pd.Series([None if x is None else redact(x, find_spans(model, x)) for x in s], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "string")(F.col(text)))
