import datetime as dt

import duckdb
import pytest

import __spark_entry__ as e
from ledgerloom.operators import analytics, history, measures

SF = "/root/testdata/sf0.001"
QUERIES = ["event_milestones", "index_milestones", "availability", "best_worst_spans", "allocation_by_class", "concentration_with_cash", "risk_adjusted", "average_capital", "turnover_total", "benchmark_flags", "issue_summary"]


def _day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def _key(row):
    return [repr(x) for x in row]


@pytest.mark.parametrize("name", QUERIES)
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in ["part", "orders", "lineitem", "events"]:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(e.oracle_sql()[name])
    columns = sorted(want.columns)
    got = e.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    mine = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=_key)
    theirs = sorted(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall(), key=_key)
    assert mine == theirs and mine


def test_event_milestones_settle_ties_by_id(spark):
    trades = spark.createDataFrame([(1, _day(3), "t1", "SELL", 5.0, 0.0), (1, _day(5), "t3", "BUY", 9.0, 1.0), (1, _day(5), "t2", "BUY", 7.0, 1.0)], "account_id int, trade_date date, event_id string, type string, gross double, fees double")
    cash = [(1, _day(0), 1, "DEPOSIT", 50.0), (1, _day(9), 2, "DEPOSIT", 50.0), (1, _day(2), 3, "WITHDRAWAL", -8.0), (1, _day(1), 4, "WITHDRAWAL", -8.0), (1, _day(4), 5, "INTEREST", 99.0), (1, _day(4), 6, "DISTRIBUTION", 3.0), (2, _day(4), 7, "FEE", -3.0)]
    got = measures.event_milestones(trades, spark.createDataFrame(cash, "account_id int, trade_date date, event_id long, type string, amount double"))
    assert {(r.account_id, r.milestone, r.on, r.value) for r in got.collect()} == {(1, "first buy", _day(5), 8.0), (1, "largest deposit", _day(9), 50.0), (1, "largest withdrawal", _day(2), -8.0), (1, "largest income", _day(4), 3.0)}


def test_index_milestones_skip_what_does_not_move(spark):
    rows = [("a", _day(0), 0.0), ("a", _day(1), 100.0), ("a", _day(2), 110.0), ("a", _day(3), None), ("a", _day(4), 110.0), ("a", _day(5), 121.0), ("b", _day(0), 5.0), ("b", _day(1), 5.0)]
    got = {r.milestone: (r.account_id, r.on, r.value) for r in measures.index_milestones(spark.createDataFrame(rows, "account_id string, period_end date, index double")).collect()}
    assert got == {kind: ("a", _day(2), pytest.approx(10)) for kind in ("largest gain", "largest loss")}  # two equal steps: the first is both


def test_availability_of_an_account_known_by_one_table_only(spark):
    events = spark.createDataFrame([(1, "SELL")], "account_id int, type string")
    held = spark.createDataFrame([(2,)], "account_id int")
    days = spark.createDataFrame([(3, _day(7 * k), True, k != 1) for k in range(3)], "account_id int, on date, actual boolean, measured boolean")
    got = {(r.account_id, r.capability): (r.available, r.reason) for r in measures.availability(events, held, days, risk_free=0.01).collect()}
    assert len(got) == 3 * 29
    assert got[1, "realised_gains"] == (True, None) and got[1, "xirr"] == (False, "no transactions or no valuation") and got[2, "holdings"] == (True, None)
    assert got[2, "portfolio_value"] == (False, "no history") and got[3, "twrr"] == (True, None) and got[3, "drawdown"] == (True, None)
    assert got[3, "weekly_returns"] == (False, "no valuations within 10 days") and got[3, "monthly_returns"] == (True, None)
    assert got[1, "sharpe_ratio"] == (True, None) and got[1, "beta"] == (False, "no benchmark") and not got[3, "sector_allocation"][0]


def test_best_day_needs_days_close_by(spark):
    rows = [("a", dt.date(2023, 12, 30), 90.0), ("a", dt.date(2024, 1, 1), 99.0), ("a", dt.date(2024, 1, 31), 105.0), ("b", dt.date(2024, 1, 1), 100.0), ("b", dt.date(2024, 1, 31), 90.0), ("c", dt.date(2024, 1, 1), 1.0)]
    got = {(r.account_id, r.span): r for r in measures.best_worst_spans(spark.createDataFrame(rows, "account_id string, on date, index double")).collect()}
    day, month = got["a", "day"], got["a", "month"]
    assert (day.best, day.best_return, day.reason) == (dt.date(2024, 1, 1), pytest.approx(0.1), None)
    assert (month.best, month.best_return, month.worst_return) == (dt.date(2024, 1, 31), pytest.approx(105 / 90 - 1), 0.0)
    assert got["b", "day"].best is None and got["b", "day"].reason == "valuations lie too far apart" and got["b", "year"].worst_return == pytest.approx(-0.1)
    assert got["c", "day"].best is None and got["c", "month"].best_return == 0.0


def test_cash_counts_in_the_whole(spark):
    state = spark.createDataFrame([(1, "A", 2, 60.0), (1, "B", 1, 20.0), (1, "C", 0, 0.0), (2, "A", 1, 5.0), (3, "A", 1, None)], "account_id int, security_id string, units int, value double")
    cash = spark.createDataFrame([(1, 20.0), (4, 7.0)], "account_id int, cash double")
    classes = spark.createDataFrame([("A", "shares")], "security_id string, asset_class string")
    one = {(r.account_id, r.security_id): r.weight for r in measures.allocation_with_cash(state, cash).collect()}
    assert one == {(1, "A"): 0.6, (1, "B"): 0.2, (2, "A"): 1.0, (3, "A"): None}
    by = {(r.account_id, r.asset_class): r.weight for r in measures.allocation_with_cash(state, cash, classes).collect()}
    assert by == {(1, "shares"): 0.6, (1, "unknown"): 0.2, (1, "cash"): 0.2, (2, "shares"): 1.0, (3, "shares"): None, (4, "cash"): 1.0}
    top = {r.account_id: r for r in analytics.concentration(measures.allocation_with_cash(state, cash)).collect()}
    assert top[1].largest == 0.6 and top[1].hhi == pytest.approx(0.4)


def test_ratios_need_a_rate_and_two_negative_returns(spark):
    rows = [("a", x) for x in (0.1, -0.05, 0.2, -0.02, 0.1, 0.0)] + [("b", x) for x in (0.1, 0.2, 0.1, -0.1, 0.3, 0.1)] + [("c", None)]
    returns = spark.createDataFrame(rows, "account_id string, r double")
    got = {r.account_id: r for r in measures.risk_adjusted(returns, 0.03).collect()}
    year = (1.1 * 0.95 * 1.2 * 0.98 * 1.1) ** (4 / 6) - 1
    assert got["a"].sortino == pytest.approx((year - 0.03) / (2 * 0.03 / 2**0.5)) and got["a"].sharpe_reason is None
    assert got["b"].sortino is None and got["b"].sortino_reason == "under 2 negative returns" and got["b"].sharpe > 0
    assert got["c"].sharpe_reason == "under 6 returns"
    assert {(r.sharpe, r.sortino, r.sharpe_reason, r.sortino_reason) for r in measures.risk_adjusted(returns, None).collect()} == {(None, None, "no risk-free rate", "no risk-free rate")}


def test_capital_turnover_and_issues(spark):
    capital = spark.createDataFrame([(1, 10.0), (1, -4.0), (1, 20.0), (2, 0.0)], "account_id int, capital double")
    assert {r.account_id: (r.average_capital, r.periods) for r in measures.average_capital(capital).collect()} == {1: (15.0, 2), 2: (None, 0)}
    with pytest.raises(ValueError):
        history.turnover(capital, capital, "greater")
    issues = spark.createDataFrame([("ERROR", "X", "d1"), ("WARNING", "Y", "d1"), ("INFO", "Z", "d2"), ("WARNING", "Y", None)], "severity string, code string, document_id string")
    got = {(r.severity, r.code): (r.issues, r.documents_to_review) for r in measures.issue_summary(issues).collect()}
    assert got[None, None] == (4, 1) and got["WARNING", "Y"] == (2, 1) and got["INFO", "Z"] == (1, 0)
