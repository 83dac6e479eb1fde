"""Whether a message asks for a change: its mood, the action, the target, and how sure that is.

Two tables decide. ``MOODS`` lists, in the order in which they are tried, the cue of each mood
and the part of a clause where it must stand; ``NAMING`` lists what names an action at a clause's
head. The clause that decides is the first that instructs and names an action, else the
first that instructs, else the first. The tables are evaluated as column expressions
(``intent``); ``read_intent`` evaluates them on one message without a session.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluiceway.functions import text as X

# Actions with the verbs that name them.
ACTIONS = {
    "restart_service": "restart relaunch respawn",
    "scale_service": "scale autoscale",
    "rollback_deploy": "rollback revert undo",
    "deploy_release": "deploy redeploy release ship promote",
    "page_oncall": "page escalate alert notify",
    "toggle_flag": "enable disable toggle flip",
    "rotate_secret": "rotate regenerate renew reissue",
    "patch_config": "patch update change edit tune adjust",
    "clear_cache": "clear invalidate",
}
# Verbs of two words, verbs of quantity, and what those and the cache verbs act on.
PHRASES = {"scale up": "scale_service", "scale out": "scale_service", "scale in": "scale_service", "roll back": "rollback_deploy", "switch on": "toggle_flag", "switch off": "toggle_flag"}
QUANTITY_VERBS = "increase decrease raise lower reduce bump"
REPLICA_NOUNS = "replicas replica pods pod instances instance"
CACHE_NOUNS = "cache caches"
# Who may be paged.
RECIPIENTS = "oncall on-call on-duty pager primary secondary lead sre commander duty-manager"
# Verbs of changes that no action covers, verbs of reading, and nouns before which a verb is none.
UNSUPPORTED = "delete remove destroy kill terminate stop drop wipe erase truncate uninstall shutdown rename migrate drain pause suspend resume cordon evict revoke grant approve merge execute"
READS = "show display check describe explain inspect find summarize summarise look tell give fetch print review compare monitor watch investigate verify confirm read search lookup remind clarify document outline walk"
NOMINAL = "policy procedure process runbook playbook notes note history log logs window schedule calendar cadence status plan checklist docs documentation rotation date reason budget train"
# Words of politeness, negation, condition, and those that open statements.
POLITE = "please kindly pls plz just now so ok okay hey hi hello team folks quick one also then immediately asap urgently go ahead and actually right away"
NEGATIONS = "dont don never not no nobody avoid"
CONDITIONS = "if unless once whenever after before until when"
SUBJECTS = "we i they he she it you someone everyone this that there"
COPULAS = "is are was were has have had seems looks keeps"
AUXILIARIES = "is are was were do does did can could should would will has have had am may must shall"

LEAST = 0.65
_END = r"(?: |$)"


def _any(words: str) -> str:
    return "(?:" + "|".join(words.replace("-", r"\-").split()) + ")"


_REQUEST = r"(?:(?:can|could|would|will) (?:you|u)|(?:i|we) (?:need|want|would)(?: [^ ]+)? you(?: to)?|let us|lets|let)"
_OPENER = rf"^(?:(?:{_any(POLITE)}|do not|{_any(NEGATIONS)}|{_REQUEST}){_END})*"
#: (mood, part of the clause, cue), tried in this order; what has none of them is an imperative. Parts: the clause, its opener
#: (politeness, negation, request), its head (from the first word after the opener).
MOODS = (
    ("conditional", "clause", rf"^{_any(CONDITIONS)}{_END}"),
    ("informational", "head", rf"^{_any(AUXILIARIES + ' ' + READS + ' ' + ' '.join(X.WH_WORDS))}{_END}"),
    ("declarative", "head", rf"^(?:{_any(SUBJECTS)}{_END}|[^ ]+ (?:{_any(COPULAS)}|{_any(NOMINAL)}){_END}|[^ ]*-)"),
    ("negated", "opener", rf"(?:^| )(?:do not|{_any(NEGATIONS)}) "),
    ("request", "opener", rf"(?:^| ){_REQUEST} "),
)
#: (action, how sure, what names it at the head), tried in this order.
NAMING = (
    *((action, 1.0, rf"^{phrase}{_END}") for phrase, action in PHRASES.items()),
    *((action, 1.0, rf"^{_any(verbs)}{_END}" + (rf"(?:.* )?{_any(CACHE_NOUNS)}{_END}" if action == "clear_cache" else "")) for action, verbs in ACTIONS.items()),
    ("scale_service", 0.9, rf"^{_any(QUANTITY_VERBS)} (?:.* )?{_any(REPLICA_NOUNS)}{_END}"),
    ("patch_config", 0.9, rf"^{_any(QUANTITY_VERBS)}{_END}"),
)
_NO_COVER = rf"^{_any(UNSUPPORTED)}{_END}"
_LATER_CONDITION = rf" {_any(CONDITIONS)}(?: [^ ]+){{2}}"
#: A message that asks how or whether asks for no change, whatever its clauses say.
_WH, _MODAL = _any(" ".join(X.WH_WORDS)), _any("can could should may must do did would am are")
ASKS = (
    rf"(?:^| ){_WH}(?: [^ ]+){{0,2}} (?:{_any(AUXILIARIES)}|to){_END}", rf"(?:^| ){_MODAL} (?:i|we){_END}", rf"(?:^| )is it (?:safe|ok|okay|possible|allowed|necessary){_END}",
    rf"(?:^| )(?:procedure|process|instructions|runbook|playbook) (?:to|for){_END}", rf"(?:^| )(?:explain|describe){_END}",
)
_ASKS = "|".join(ASKS)
_CLAUSES = r"(?i)[,;:!?\n]+|\s+-\s+|\s+but\s+"
_NAME = r"[\-_.]"
_TO_WHOM = rf"^{_any(RECIPIENTS)}$"


def _decide(clauses: list[dict], asks: bool) -> dict:
    """The verdict of a message on its clauses."""
    active = [c for c in clauses if c["mood"] in ("imperative", "request")]
    named = [c for c in active if c["action"]]
    first = (named or active or clauses or [None])[0]
    if first is None:
        return {"mood": "empty", "action": None, "target": None, "confidence": 0.0, "status": "none"}
    if active and asks or not named:
        unclear = not asks and any(c["uncovered"] for c in active)
        return {"mood": "informational" if active and asks else first["mood"], "action": None, "target": None, "confidence": 0.0, "status": "ambiguous" if unclear else "none"}
    sure = first["confidence"] >= LEAST and not first["later"] and not any(c["mood"] == "conditional" for c in clauses)
    return {"mood": first["mood"], "action": first["action"], "target": first["target"], "confidence": first["confidence"], "status": "propose" if sure else "ambiguous"}


def read_intent(text: str | None) -> dict:
    """``mood``, ``action``, ``target``, ``confidence`` and ``status`` (propose, ambiguous, none) of one message."""
    clauses = []
    for raw in re.split(_CLAUSES, text or ""):
        part = {"clause": X.normalize_python(raw)}
        part["opener"] = re.match(_OPENER, part["clause"])[0]
        part["head"] = part["clause"][len(part["opener"]) :]
        if not part["head"]:
            continue
        mood = next((m for m, where, cue in MOODS if re.search(cue, part[where])), "imperative")
        action, sure = next(((a, s) for a, s, cue in NAMING if re.search(cue, part["head"])), (None, 0.0))
        words = part["head"].split(" ")[1:]
        names = [w for w in words if re.search(_NAME, w) and not re.search(_TO_WHOM, w)]
        whom = [w for w in words if re.search(_TO_WHOM, w)] if action == "page_oncall" else []
        known = 0.9 if whom else 0.85 if names else 0.0
        clauses.append({
            "mood": mood, "action": action, "target": (whom or names or [None])[0], "confidence": round(sure * (0.9 if mood == "request" else 1.0) * known, 3),
            "uncovered": bool(re.search(_NO_COVER, part["head"])), "later": bool(re.search(_LATER_CONDITION, part["head"])),
        })
    return _decide(clauses, bool(re.search(_ASKS, X.normalize_python(text or ""))))


INTENT = "mood string, action string, target string, confidence double, status string"


def _first_of(rows, part, otherwise: Column) -> Column:
    out = otherwise
    for value, where, cue in reversed(rows):
        out = F.when(part(where).rlike(cue), F.lit(value)).otherwise(out)
    return out


def _clause(raw: Column) -> Column:
    clause = X.normalize_text(raw)
    opener = F.regexp_extract(clause, f"({_OPENER})", 1)
    return F.struct(clause.alias("clause"), opener.alias("opener"), F.substring(clause, F.length(opener) + 1, F.length(clause)).alias("head"))


def _verdict(c: Column) -> Column:
    mood = _first_of(MOODS, lambda where: c[where], F.lit("imperative"))
    action = _first_of([(a, "head", cue) for a, _, cue in NAMING], lambda where: c[where], F.lit(None).cast("string"))
    sure = _first_of([(s, "head", cue) for _, s, cue in NAMING], lambda where: c[where], F.lit(0.0))
    words = F.slice(F.split(c["head"], " "), 2, 1_000_000)
    names = F.filter(words, lambda w: w.rlike(_NAME) & ~w.rlike(_TO_WHOM))
    whom = F.when(action == "page_oncall", F.filter(words, lambda w: w.rlike(_TO_WHOM))).otherwise(F.array().cast("array<string>"))
    known = F.when(F.size(whom) > 0, 0.9).when(F.size(names) > 0, 0.85).otherwise(0.0)
    return F.struct(
        mood.alias("mood"), action.alias("action"), F.coalesce(F.get(whom, F.lit(0)), F.get(names, F.lit(0))).alias("target"),
        F.round(sure * F.when(mood == "request", 0.9).otherwise(1.0) * known, 3).alias("confidence"), c["head"].rlike(_NO_COVER).alias("uncovered"), c["head"].rlike(_LATER_CONDITION).alias("later"),
    )


def intent(c: Column) -> Column:
    """A struct of ``INTENT`` for each message; null and blank messages are of mood ``empty`` and status ``none``."""
    text = F.coalesce(c, F.lit(""))
    parts = F.filter(F.transform(F.split(text, _CLAUSES), _clause), lambda p: p["head"] != "")
    clauses = F.transform(parts, _verdict)
    asks = X.normalize_text(text).rlike(_ASKS)

    def decide(all_: Column) -> Column:
        active = F.filter(all_, lambda x: x["mood"].isin("imperative", "request"))
        named = F.filter(active, lambda x: x["action"].isNotNull())
        first = F.coalesce(F.get(named, F.lit(0)), F.get(active, F.lit(0)), F.get(all_, F.lit(0)))
        stands = (F.size(named) > 0) & ~asks
        unclear = ~asks & F.exists(active, lambda x: x["uncovered"])
        sure = (first["confidence"] >= LEAST) & ~first["later"] & ~F.exists(all_, lambda x: x["mood"] == "conditional")
        mood = F.when(F.size(all_) == 0, "empty").when((F.size(active) > 0) & asks, "informational").otherwise(first["mood"])
        status = F.when(stands, F.when(sure, "propose").otherwise("ambiguous")).when(unclear, "ambiguous").otherwise("none")
        return F.struct(mood.alias("mood"), F.when(stands, first["action"]).alias("action"), F.when(stands, first["target"]).alias("target"), F.when(stands, first["confidence"]).otherwise(0.0).alias("confidence"), status.alias("status"))

    # the clauses are made once and then judged, instead of anew for each field
    return F.get(F.transform(F.array(clauses), decide), F.lit(0))
