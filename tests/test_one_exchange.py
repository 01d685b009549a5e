"""Jobs over two sources whose rows meet in one exchange and are joined to nothing afterwards."""

import random
from datetime import date
from decimal import Decimal as D

import __spark_entry__ as e
from ledgerloom.operators import checks, matching, reconcile


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_trades_travel_with_the_fee_that_charged_them(spark):
    got = e.queries()["attach_brokerage"](spark, "/root/testdata/sf0.001")
    assert joins(got) == 0  # before: trades and their tables read three times, joined to what was found
    trades = spark.createDataFrame([("x", 1, "BUY", "A", date(2020, 1, 1), D(5), 7), (None, 2, "BUY", "A", date(2020, 1, 1), D(5), 8), ("x", 3, None, "A", date(2020, 1, 1), D(5), 9), ("x", 4, "BUY", "A", None, D(5), 1), ("x", 5, "BUY", "A", date(2020, 1, 1), None, 2), ("x", 6, "BUY", "A", date(2020, 1, 1), D(0), None)], "account_id string, event_id long, type string, security_id string, on date, brokerage decimal(18,2), more int")
    fees = spark.createDataFrame([("x", "f", date(2020, 1, 3), D(-5), "buy a"), ("x", None, None, None, None)], "account_id string, fee_id string, on date, amount decimal(18,2), description string")
    rows = reconcile.attach_brokerage(trades, fees)
    assert {(r.event_id, r.account_id, r.more, r.fee_id, r.days) for r in rows.collect()} == {(1, "x", 7, "f", 2), (2, None, 8, None, None), (3, "x", 9, None, None), (4, "x", 1, None, None), (5, "x", 2, None, None), (6, "x", None, None, None)}
    assert reconcile.attach_brokerage(trades.limit(0), fees).count() == 0


def test_settlements_are_checked_as_they_stream(spark):
    got = e.queries()["check_settlement"](spark, "/root/testdata/sf0.001")
    assert joins(got) == 1  # of ends of stretches; before, trades were read four times and joined to their pairs twice
    r = random.Random(4)
    day = lambda: r.choice([date(2020, 1, 1 + r.randrange(9)), date(2020, 1, 1 + r.randrange(9)), None])
    trades = spark.createDataFrame([(r.choice([1, 2, None]), f"t{i}", day(), r.choice(["SELL", "BUY"]), r.choice([D(r.randrange(9)) / 100, None]), D(0)) for i in range(200)], "account_id int, event_id string, trade_date date, type string, gross decimal(18,2), fees decimal(18,2)")
    moved = spark.createDataFrame([(r.choice([1, 2]), f"m{i}", day(), D(r.randrange(-9, 9)) / 100) for i in range(60)], "account_id int, event_id string, trade_date date, amount decimal(18,2)")
    pairs = matching.pair_settlements(trades, moved)
    rows = matching.settled(trades, moved)
    found = {p.trade_id: p.days_to_cash for p in pairs.collect()}
    assert found and sorted((t.event_id, t.days_to_cash) for t in rows.collect() if t.days_to_cash is not None) == sorted(found.items())
    assert sorted(t.event_id for t in rows.collect()) == sorted(f"t{i}" for i in range(200))
    issues = {x.event_id: (x.account_id, x.code, x.severity) for x in checks.settlement_issues(rows).collect()}
    assert issues == {t.event_id: (t.account_id, *(("SETTLEMENT_DATE_MISMATCH", "ERROR") if t.event_id in found else ("SETTLEMENT_PENDING", "INFO"))) for t in trades.collect() if found.get(t.event_id) != 0}
    assert {x.event_id: (x.account_id, x.code, x.severity) for x in checks.check_settlement(trades, pairs).collect()} == issues


def test_trades_of_two_sources_leave_the_stream_with_their_pair(spark):
    got = e.queries()["reconcile_trades"](spark, "/root/testdata/sf0.001")
    assert joins(got) == 2  # of accounts and the dates they cover; before, six reads of the trades and two joins of all rows
    r = random.Random(6)
    shape = "account_id int, event_id {0}, type string, security_id string, on date, amount decimal(18,2), units double"
    rows = lambda p: [(r.choice([1, 1, 2, None]), p + i, r.choice(["BUY", None]), r.choice(["A", "A", "B"]), r.choice([date(2020, 1, 1 + r.randrange(28)), None, date(2020, 1, 1 + r.randrange(28))]), r.choice([D(r.randrange(100, 106)) / 100, None]), r.choice([1.0, -1.0, 1.4, None, float("nan")])) for i in range(300)]
    own, other = spark.createDataFrame(rows(0), shape.format("int")), spark.createDataFrame(rows(1000), shape.format("long"))
    for days in (7, 2):
        want = [tuple(x) for x in reconcile.reconciled(own, other, reconcile.trade_pairs(own, other, days)).collect()]
        out = [tuple(x) for x in reconcile.reconciled_trades(own, other, days).collect()]
        assert sorted(out, key=repr) == sorted(want, key=repr) and len({x[4] for x in out}) == 7
    assert reconcile.reconciled_trades(own.limit(0), other.limit(0)).count() == 0
