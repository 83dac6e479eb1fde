"""Mixed timestamp spellings to one UTC instant.

All spellings are compiled into ONE regex alternation with named groups. A single
``regexp_replace`` rewrites a matching text to its components, separated by a control
character, so each text is scanned once; the calendar is then checked and the instant
assembled with integer day arithmetic, all in whole-stage code generation. There is no
Python in the plan and no shuffle: the only join is with the small table of sources.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.session import broadcast_if_small

# English month names and the offsets in minutes of common zone abbreviations.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60,
    "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "ist": 330, "sgt": 480, "hkt": 480, "jst": 540, "kst": 540,
    "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

#: Components in the order in which the rewritten text holds them.
FIELDS = ("y", "mo", "name", "d", "a", "b", "c", "h", "mi", "s", "f", "ap", "off", "abbr", "iana", "epoch", "frac")
SEP = "\u001f"

_CLOCK = r"{h:\d{1,2}}:{mi:\d{2}}(?::{s:\d{2}}(?:[.,]{f:\d{1,9}})?)?(?:\s*{ap:[ap]\.?m\.?}(?![a-z]))?"
_ZONE = (
    r"(?:\s*(?:(?:utc|gmt)?{off:[+-]\d{1,2}(?::?\d{2})?}(?:\s*\[[a-z0-9_+\-/]+\])?"
    r"|\[?{iana:[a-z]+(?:/[a-z0-9_+\-]+)+}\]?|\[?{abbr:[a-z]{1,5}}\]?))?"
)
_TIME = rf"(?:(?:[t\s]|,\s*|\s+at\s+)\s*{_CLOCK})?{_ZONE}"
#: One row per family of spellings; ``{name:regex}`` becomes a named group.
FORMATS = (
    rf"{{y:\d{{4}}}}-{{mo:\d{{1,2}}}}-{{d:\d{{1,2}}}}{_TIME}",
    rf"{{y:\d{{4}}}}/{{mo:\d{{1,2}}}}/{{d:\d{{1,2}}}}{_TIME}",
    rf"{{y:\d{{4}}}}\.{{mo:\d{{1,2}}}}\.{{d:\d{{1,2}}}}{_TIME}",
    rf"{{y:\d{{4}}}}{{mo:\d{{2}}}}{{d:\d{{2}}}}t{{h:\d{{2}}}}{{mi:\d{{2}}}}(?:{{s:\d{{2}}}}(?:[.,]{{f:\d{{1,9}}}})?)?{_ZONE}",
    rf"{{y:\d{{4}}}}{{mo:\d{{2}}}}{{d:\d{{2}}}}[t\s]\s*{_CLOCK}{_ZONE}",
    rf"{{a:\d{{1,2}}}}([./\-]){{b:\d{{1,2}}}}\k<@>{{c:\d{{4}}|\d{{2}}}}{_TIME}",
    rf"(?:[a-z]{{2,9}}\.?,?\s+)?{{d:\d{{1,2}}}}(?:st|nd|rd|th|\.)?[\s\-]+{{name:[a-z]{{3,9}}}}\.?,?[\s\-]+{{y:\d{{4}}}}{_TIME}",
    rf"(?:[a-z]{{2,9}}\.?,?\s+)?{{name:[a-z]{{3,9}}}}\.?\s+{{d:\d{{1,2}}}}(?:st|nd|rd|th)?,?\s+{{y:\d{{4}}}}{_TIME}",
    r"{epoch:[+-]?\d{1,17}}(?:\.{frac:\d{1,9}})?",
)


@lru_cache(maxsize=1)
def alternation() -> tuple[str, str]:
    """The regex of all spellings, and the replacement text that lists their components."""
    import re

    used: dict[str, list[str]] = {f: [] for f in FIELDS}
    branches = []
    for i, spec in enumerate(FORMATS):

        def group(m: re.Match, i: int = i) -> str:
            name = f"{m[1]}{i}"
            if name not in used[m[1]]:
                used[m[1]].append(name)
            return f"(?<{name}>"

        out, depth, k = [], [], 0
        while k < len(spec):
            m = re.compile(r"\{([a-z]+):").match(spec, k)
            if m and m[1] in FIELDS:
                out.append(group(m))
                depth.append("g")
                k = m.end()
            elif spec[k] == "{":
                depth.append("q")
                out.append("{")
                k += 1
            elif spec[k] == "}":
                out.append(")" if depth.pop() == "g" else "}")
                k += 1
            else:
                out.append(spec[k])
                k += 1
        branches.append("".join(out).replace(r"([./\-])", rf"(?<sep{i}>[./\-])").replace(r"\k<@>", rf"\k<sep{i}>"))
    regex = r"(?is)^[\s\p{Z}]*(?:" + "|".join(branches) + r")[\s\p{Z}]*$"
    template = SEP + SEP.join("".join("${" + n + "}" for n in used[f]) for f in FIELDS)
    return regex, template


@lru_cache(maxsize=1)
def _known_zones() -> tuple[str, ...]:
    from zoneinfo import available_timezones

    return tuple(sorted(z for z in available_timezones() if z not in ("Factory", "localtime", "posixrules")))


def zone_names(spark: SparkSession) -> list[str]:
    """The IANA names that the JVM knows, so that a misspelt one can't fail the job (a bounded list of some 600)."""
    try:
        return sorted(str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    except Exception:  # a remote session has no JVM handle
        return list(_known_zones())


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar, by integer arithmetic."""
    y2 = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y2 / 400)
    yoe = y2 - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("bigint")


def days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def parse_components(text: Column) -> Column:
    """The array of components of ``text``, or null when no spelling matches."""
    regex, template = alternation()
    rewritten = F.regexp_replace(text, F.lit(regex), F.lit(template))
    return F.when(rewritten.startswith(SEP), F.split(F.substring(rewritten, 2, 1 << 30), SEP))


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, past which a later filter is not pushed: it would copy their expressions into itself."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def normalise_timestamps(
    df: DataFrame, sources: DataFrame, text: str = "updated_at", source: str = "source_system", out: str = "utc_us"
) -> DataFrame:
    """Adds ``out`` (bigint microseconds since 1970, UTC) and ``{out}_how`` to ``df``.

    ``sources`` has ``source_system``, ``home_zone``, ``date_order``; names are matched
    without regard to case and outer white space, repeated names count once (the smallest
    row). ``{out}_how`` tells what fixed the zone: ``offset``, ``zone``, ``home``,
    ``epoch``; or why there is no instant: ``null``, ``unreadable``, ``not_a_date``,
    ``no_source``, ``unknown_zone``.

    Null, blank and unreadable texts give a null instant; rows are never dropped or
    repeated; columns of ``df`` keep their values, and helper columns can't clash as they
    live in one struct with a reserved name. An empty ``sources`` leaves only stated zones.
    """
    spark = df.sparkSession
    norm = lambda c: F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    known = (
        sources.select(norm(F.col("source_system")).alias("__src"), F.struct("home_zone", "date_order").alias("__home"))
        .where(F.col("__src").isNotNull())
        .groupBy("__src")
        .agg(F.min("__home").alias("__home"))
    )
    zones = zone_names(spark)
    x = _fixed(df, __p=parse_components(F.col(text)), __key=norm(F.col(source)))
    x = x.join(broadcast_if_small(known), x["__key"] == known["__src"], "left")

    part = {f: F.get(F.col("__p"), F.lit(i)) for i, f in enumerate(FIELDS)}
    num = lambda f: F.expr(f"try_cast(nullif(get(__p, {FIELDS.index(f)}), '') as bigint)")
    order = F.upper(F.trim(F.col("__home.date_order")))
    a, b, c = num("a"), num("b"), num("c")
    numeric = a.isNotNull()
    pick = lambda at: F.element_at(F.array(a, b, c), F.instr(order, at).cast("int"))
    good = order.isin("YMD", "DMY", "MDY")
    century = lambda v: F.when(v < 100, v + 2000).otherwise(v)
    month_no = F.coalesce(*[F.when(F.lower(F.substring(part["name"], 1, 3)) == m, F.lit(i)) for i, m in enumerate(MONTHS, 1)])
    y = F.when(numeric, F.when(good, century(pick("Y")))).otherwise(num("y"))
    mo = F.when(numeric, F.when(good, pick("M"))).when(part["name"] != "", month_no).otherwise(num("mo"))
    d = F.when(numeric, F.when(good, pick("D"))).otherwise(num("d"))
    ap = F.lower(F.substring(part["ap"], 1, 1))
    h0 = F.coalesce(num("h"), F.lit(0))
    h = F.when(ap == "p", h0 % 12 + 12).when(ap == "a", h0 % 12).otherwise(h0)
    mi, s = F.coalesce(num("mi"), F.lit(0)), F.coalesce(num("s"), F.lit(0))
    micro = F.rpad(F.substring(part["f"], 1, 6), 6, "0").cast("bigint")
    x = _fixed(x, __t=F.struct(y.alias("y"), mo.alias("mo"), d.alias("d"), h0.alias("h0"), h.alias("h"), mi.alias("mi"), s.alias("s"), F.coalesce(micro, F.lit(0)).alias("us"), ap.alias("ap")))
    t = {k: F.col(f"__t.{k}") for k in ("y", "mo", "d", "h0", "h", "mi", "s", "us", "ap")}
    real = (
        t["y"].between(1, 9999) & t["mo"].between(1, 12) & (t["d"] >= 1) & (t["d"] <= days_in_month(t["y"], t["mo"]))
        & (t["h"] <= 23) & (t["mi"] <= 59) & (t["s"] <= 59) & (~F.coalesce(t["ap"].isin("a", "p"), F.lit(False)) | t["h0"].between(1, 12))
    )
    local_us = ((days_from_civil(t["y"], t["mo"], t["d"]) * 86400 + t["h"] * 3600 + t["mi"] * 60 + t["s"]) * 1_000_000 + t["us"]).cast("bigint")

    off = part["off"]
    digits = F.regexp_replace(F.substring(off, 2, 9), ":", "")
    oh = F.when(F.length(digits) <= 2, digits).otherwise(F.expr("left(regexp_replace(substring(get(__p, 12), 2, 9), ':', ''), length(regexp_replace(substring(get(__p, 12), 2, 9), ':', '')) - 2)")).cast("int")
    om = F.when(F.length(digits) <= 2, F.lit("0")).otherwise(F.expr("right(get(__p, 12), 2)")).cast("int")
    sign = F.when(F.substring(off, 1, 1) == "-", -1).otherwise(1)
    off_ok = (oh <= 18) & (om <= 59)
    offset_min = F.when(off_ok, sign * (oh * 60 + om))
    abbr = F.lower(part["abbr"])
    table = F.create_map(*[F.lit(v) for kv in ZONE_MINUTES.items() for v in kv])
    abbr_min = F.try_element_at(table, abbr)
    named = ", ".join(f"'{z}'" for z in zones)
    known_zone = lambda z: F.when(F.expr(f"{z} in ({named})"), F.expr(z))
    iana = known_zone(f"get(__p, {FIELDS.index('iana')})")
    home = known_zone("trim(__home.home_zone)")
    at_zone = lambda z: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col("__local")), z))

    digits_n = F.length(F.regexp_replace(part["epoch"], r"[+-]", ""))
    ep = num("epoch")
    frac = F.coalesce(F.rpad(F.substring(F.nullif(part["frac"], F.lit("")), 1, 6), 6, "0").cast("bigint"), F.lit(0))
    epoch_us = (
        F.when(digits_n <= 11, ep * 1_000_000 + F.when(part["epoch"].startswith("-"), -frac).otherwise(frac))
        .when(digits_n <= 14, ep * 1000 + F.floor(frac / 1000))
        .when(digits_n <= 17, ep)
    )

    x = _fixed(x, __real=F.coalesce(real, F.lit(False)))
    x = x.withColumn("__local", F.when(F.col("__real"), local_us))
    has = lambda f: part[f] != ""
    zone = F.coalesce(F.when(has("iana"), iana), F.when(~has("iana"), home))
    x = x.withColumn("__zone", F.when(F.col("__real") & ~has("off") & ~has("abbr"), zone))
    how = (
        F.when(F.col(text).isNull(), "null")
        .when(F.col("__p").isNull(), "unreadable")
        .when(has("epoch"), "epoch")
        .when(numeric & F.col("__src").isNull(), "no_source")
        .when(~F.col("__real"), "not_a_date")
        .when(has("off"), F.when(off_ok, "offset").otherwise("not_a_date"))
        .when(has("abbr"), F.when(abbr_min.isNotNull(), "offset").otherwise("unknown_zone"))
        .when(has("iana"), F.when(iana.isNotNull(), "zone").otherwise("unknown_zone"))
        .when(home.isNotNull(), "home")
        .otherwise("no_source")
    )
    x = _fixed(x, __how=how)
    value = (
        F.when(F.col("__how") == "epoch", epoch_us)
        .when(F.col("__how") == "offset", F.col("__local") - F.when(has("off"), offset_min).otherwise(abbr_min).cast("bigint") * 60_000_000)
        .when(F.col("__how").isin("zone", "home"), at_zone(F.col("__zone")))
    )
    x = _fixed(x, __us=value.cast("bigint"))
    return x.select(*[k for k in df.columns if k not in (out, f"{out}_how")], F.col("__us").alias(out), F.col("__how").alias(f"{out}_how"))
