"""The timestamp operator against instants worked out with the standard library's zone rules."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluiceway.operators.timestamps import normalise_timestamps

SOURCES = [("wiki", "Europe/Berlin", "DMY"), ("runbook", "America/New_York", "MDY"), ("metrics", "UTC", "YMD"), (None, "UTC", "YMD")]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(SOURCES, "source_system string, home_zone string, date_order string")


def run(spark, sources, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id int, updated_at string, source_system string")
    out = normalise_timestamps(df, sources)
    return [(r.utc_us, r.utc_us_how) for r in out.orderBy("row_id").collect()]


def us(*a, zone=timezone.utc, micro=0):
    t = datetime(*a, tzinfo=zone)
    if isinstance(zone, ZoneInfo):
        t = t.astimezone(timezone.utc)
    return (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1) + micro


def test_spellings(spark, sources):
    berlin, york = ZoneInfo("Europe/Berlin"), ZoneInfo("America/New_York")
    cases = [
        ("2026-09-07T18:30:09Z", "wiki", us(2026, 9, 7, 18, 30, 9)),
        (" 2026-09-10T08:00:09+02:00 ", None, us(2026, 9, 10, 6, 0, 9)),
        ("2026-09-12T14:50:28", " WIKI ", us(2026, 9, 12, 14, 50, 28, zone=berlin)),
        ("Mon, 18 May 2026 07:38:50 +0000", "x", us(2026, 5, 18, 7, 38, 50)),
        ("20260724T084208Z", None, us(2026, 7, 24, 8, 42, 8)),
        ("2026-08-28T14:54:52.327860Z", None, us(2026, 8, 28, 14, 54, 52, micro=327860)),
        ("2026-08-15T16:35:21.040576999Z", None, us(2026, 8, 15, 16, 35, 21, micro=40576)),
        ("1780877937", None, 1780877937 * 10**6),
        ("1788052937564", None, 1788052937564 * 10**3),
        ("1787636037532381", None, 1787636037532381),
        ("26 Jun 2026, 00:38", "runbook", us(2026, 6, 26, 0, 38, zone=york)),
        ("2026-08-16 18:44:14,969 -0700", "wiki", us(2026, 8, 17, 1, 44, 14, micro=969000)),
        ("2026/09/03 02:58", "metrics", us(2026, 9, 3, 2, 58)),
        ("17.7.26 21:09:36", "wiki", us(2026, 7, 17, 21, 9, 36, zone=berlin)),
        ("9/6/26 05:24:48", "runbook", us(2026, 9, 6, 5, 24, 48, zone=york)),
        ("08/05/2026 12:18 PM", "runbook", us(2026, 8, 5, 12, 18, zone=york)),
        ("03/08/2026 12:56 AM", "wiki", us(2026, 8, 3, 0, 56, zone=berlin)),
        ("2026-08-23 02:37:37 CEST", None, us(2026, 8, 23, 0, 37, 37)),
        ("2026-08-08 02:51:29 America/New_York", "wiki", us(2026, 8, 8, 2, 51, 29, zone=york)),
        ("2026-09-11T05:40:32[Europe/Berlin]", None, us(2026, 9, 11, 5, 40, 32, zone=berlin)),
        ("2026-08-26T16:16:27[UTC]", "runbook", us(2026, 8, 26, 16, 16, 27)),
        ("16 Jul 2026 10:59:11 IST", "wiki", us(2026, 7, 16, 5, 29, 11)),
        ("2026-07-13T08:10+02:00", None, us(2026, 7, 13, 6, 10)),
        ("20260419 15:28:41", "metrics", us(2026, 4, 19, 15, 28, 41)),
        ("2026-02-28", "metrics", us(2026, 2, 28)),
    ]
    got = run(spark, sources, [c[:2] for c in cases])
    assert [(c[0], g[0]) for c, g in zip(cases, got)] == [(c[0], c[2]) for c in cases]


def test_no_instant(spark, sources):
    bad = [None, "", "   ", "pending", "0000-00-00", "2026-02-30 07:18:00", "2025-02-29T00:00:00Z", "2026-09-02T25:61:00Z", "2026-13-18T21:54:15Z", "13:30"]
    assert all(v is None for v, _ in run(spark, sources, [(b, "wiki") for b in bad]))
    assert run(spark, sources, [("2026-09-12T14:50:28", "legacy")]) == [(None, "no_source")]
    assert run(spark, sources, [("1/2/26 10:00:00 UTC", None)]) == [(None, "no_source")]
    assert run(spark, sources, [("2026-08-08 02:51:29 Mars/Base", "wiki")]) == [(None, "unknown_zone")]
    assert run(spark, sources, [("2026-08-08 02:51:29 +99:00", "wiki")]) == [(None, "not_a_date")]


def test_clock_changes(spark, sources):
    # in the hour that happens twice the earlier instant counts; in the hour that is skipped the clock moves on
    assert run(spark, sources, [("2025-10-26 02:30:00", "wiki")])[0][0] == us(2025, 10, 26, 0, 30)
    assert run(spark, sources, [("2025-03-30 02:12:00", "wiki")])[0][0] == us(2025, 3, 30, 1, 12)
    assert run(spark, sources, [("2025-11-02T00:31:07[America/New_York]", None)])[0][0] == us(2025, 11, 2, 4, 31, 7)


def test_shape(spark, sources):
    """Extra and clashing columns, repeated and empty input, repeated sources, no sources."""
    df = spark.createDataFrame([("2026-09-12T14:50:28", "wiki", "keep", 7)] * 3, "updated_at string, source_system string, home_zone string, utc_us int")
    twice = sources.union(sources)
    out = normalise_timestamps(df, twice)
    assert out.columns == ["updated_at", "source_system", "home_zone", "utc_us", "utc_us_how"]
    assert [(r.home_zone, r.utc_us_how) for r in out.collect()] == [("keep", "home")] * 3
    assert normalise_timestamps(df.limit(0), sources).count() == 0
    assert {r.utc_us_how for r in normalise_timestamps(df, sources.limit(0)).collect()} == {"no_source"}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.datetimes(datetime(1990, 1, 1), datetime(2035, 1, 1)), min_size=30, max_size=60))
def test_against_brute_force(spark, sources, times):
    def wall(t, zone):  # the standard library keeps the skipped wall time, so normalise through the offset before the change
        z = ZoneInfo(zone)
        a = t.replace(tzinfo=z, fold=0)
        return (t - a.utcoffset() - datetime(1970, 1, 1)) // timedelta(microseconds=1)

    rows, want = [], []
    for i, t in enumerate(times):
        src, zone = (("wiki", "Europe/Berlin"), ("runbook", "America/New_York"))[i % 2]
        rows.append((t.isoformat(sep="T ".strip()[0] if i % 3 else " "), src))
        want.append(wall(t, zone))
    assert [v for v, _ in run(spark, sources, rows)] == want
