"""Windows with money-weighted returns and reported figures, on rows that are easy to work out."""

import datetime as dt

import pytest

from ledgerloom.operators import income, overview

DAILY = "account_id int, on date, value double, index double, index_as_at date, income double, fees double, status string"


def _day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def _daily(spark, values):
    """One row a day; valued on the given days, carried between."""
    rows, at = [], None
    for n in range(max(values) + 1):
        at = n if n in values else at
        rows.append((1, _day(n), None if at is None else values[at], None if at is None else values[at] / 10, None if at is None else _day(at), float(n), 0.0, "ACTUAL" if at == n else "ESTIMATED"))
    return spark.createDataFrame(rows, DAILY)


def test_windows_anchor_refuse_and_share_flows(spark):
    daily = _daily(spark, {0: 1000.0, 88: 1100.0, 180: 1300.0, 366: 1430.0})
    flows = spark.createDataFrame([(1, _day(90), 50.0), (1, _day(90), 50.0), (1, _day(300), 10.0)], "account_id int, date date, amount double")
    got = {r.label: r for r in overview.window_performance(daily, flows, overview.standard_windows(daily)).collect()}
    assert len(got) == 11 and {got["3Y"].reason, got["10Y"].reason} == {"begins before the first day"}
    assert got["1D"].reason == "both ends are one valuation" and got["1M"].reason == "valuations lie too far apart" and got["1D"].opening is None
    year = got["1Y"]
    assert (year.measured_from, year.opening, year.closing, year.flow, year.gain) == (_day(0), 1000, 1430, 110, 320) and year.twrr == pytest.approx(0.43)
    worth = lambda rate: -1000 - 100 * (1 + rate) ** (-90 / 365) - 10 * (1 + rate) ** (-300 / 365) + 1430 * (1 + rate) ** (-366 / 365)
    assert worth(year.xirr) == pytest.approx(0, abs=1e-4) and year.total_return == pytest.approx(320 / (1000 + 100 * 276 / 366 + 10 * 66 / 366))
    half = got["6M"]
    assert half.measured_from == _day(180) and half.flow == 10 and half.status == "ACTUAL"
    early = overview.window_performance(daily, flows.limit(0), overview.standard_windows(daily, _day(100)))
    assert {r.label: r.status for r in early.collect()}["3M"] == "ESTIMATED" and overview.standard_windows(daily, _day(900)).count() == 0
    assert overview.window_performance(daily.limit(0), flows, overview.standard_windows(daily.limit(0))).count() == 0


def test_range_falls_back_on_what_has_a_value(spark):
    daily = _daily(spark, {40: 100.0, 80: 110.0})
    flows = spark.createDataFrame([], "account_id int, date date, amount double")
    (mid,) = overview.range_overview(daily, flows, _day(60), _day(79)).collect()
    assert (mid.measured_from, mid.opening, mid.closing) == (_day(60), 100, 100)
    (early,) = overview.range_overview(daily, flows, _day(5), _day(60)).collect()
    assert early.measured_from == _day(40) and early.twrr == 0
    (none,) = overview.range_overview(daily, flows, _day(500), _day(600)).collect()
    assert none.status == "UNAVAILABLE" and none.closing is None


def test_reported_figures(spark):
    said = spark.createDataFrame([(1, _day(0), 100.0, 10.0, 5.0), (1, _day(1), None, None, None), (2, _day(0), 7.0, 1.0, None)], "account_id int, on date, value double, cash double, accrued double")
    done = spark.createDataFrame([(1, _day(0), 95.0, 10.04), (1, _day(1), 90.0, 9.0), (1, _day(2), 90.0, 9.0)], "account_id int, on date, value double, cash double")
    units = spark.createDataFrame([(1, _day(0), "A", 5.0), (1, _day(0), "B", 1.0)], "account_id int, on date, security_id string, units double")
    held = spark.createDataFrame([(1, _day(0), "A", 5.0), (1, _day(0), "C", 2.0), (1, _day(2), "A", 5.0)], "account_id int, on date, security_id string, units double")
    checks = income.reported_reconciliation(said, units, done, held)
    got = {(r.account_id, r.on, r.what, r.security_id): (r.difference, r.status) for r in checks.collect()}
    assert got == {
        (1, _day(0), "value", None): (0, "PASS"), (1, _day(0), "cash", None): (0.04, "PASS"), (1, _day(1), "value", None): (None, "SKIP"), (2, _day(0), "value", None): (None, "SKIP"), (2, _day(0), "cash", None): (None, "SKIP"),
        (1, _day(0), "units", "A"): (0, "PASS"), (1, _day(0), "units", "B"): (-1, "FAIL"), (1, _day(0), "units", "C"): (2, "FAIL"),
    }
    assert {r.account_id: (r.total, r.passed, r.failed, r.skipped) for r in income.reconciliation_counts(checks).collect()}[1] == (6, 3, 2, 1)
