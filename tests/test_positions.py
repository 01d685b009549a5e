"""One pass over the trades: positions by day, states of several dates, and sums that cancel."""

import random
from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import attribution, checks, ledger, measures
from ledgerloom.plans.quarters import quarterly_returns
from ledgerloom.sources import statements

TRADES = "account_id int, security_id string, trade_date date, type string, units decimal(18,2), gross decimal(18,2), fees decimal(18,2), event_id string"


def _random(spark, n=400):
    r = random.Random(11)
    rows = [(r.choice([1, 2, None]), r.choice(["A", "B"]), date(2020, 1, 1) + timedelta(r.randrange(90)), r.choice(["BUY", "BUY", "SELL", "TRANSFER"]), D(r.randrange(0, 9000)) / 100, D(r.randrange(100, 90000)) / 100, D(r.randrange(0, 500)) / 100, f"e{i}") for i in range(n)]
    return spark.createDataFrame(rows, TRADES).repartition(3)


def test_what_cancels_leaves_nothing_to_divide_by(spark):
    shape = "account_id int, security_id string, type string, amount decimal(18,2), fees decimal(18,2)"
    rows = [(1, None, k, D(x), D(0)) for k, x in (("DEPOSIT", "0.10"), ("DEPOSIT", "0.20"), ("WITHDRAWAL", "-0.30"), ("DIVIDEND", "7.00"))]
    none = spark.createDataFrame([], "account_id int, value double, unrealised double, realised double")
    parts = attribution.growth_decomposition(none, none, spark.createDataFrame(rows, shape).coalesce(1))
    assert parts.first().external == 0.0  # as doubles they sum to 5.6e-17
    got = attribution.efficiency_metrics(parts, none.select("account_id", "value")).first()
    assert (got.income_on_contributions, got.gain_on_contributions, got.income_share) == (None, None, 1.0)


def test_costs_take_one_exchange_and_one_sort(spark):
    plan = ledger.average_cost(_random(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("hashpartitioning") == 1 and "Window" not in plan


def test_positions_by_day_are_the_last_and_sums_of_average_cost(spark):
    tr = _random(spark)
    each = ledger.average_cost(tr).join(tr.select("event_id", "units", "gross"), "event_id")
    flow = F.when(F.col("type") == "BUY", F.col("gross").cast("double")).when(F.col("type") == "SELL", -F.col("gross").cast("double") * F.try_divide("sold", F.col("units").cast("double"))).otherwise(0.0)
    order = F.struct("trade_date", F.when(F.col("type") == "TRANSFER", 0).when(F.col("type") == "BUY", 1).otherwise(2), "event_id")
    want = each.groupBy("account_id", "security_id", "trade_date").agg(F.max_by("held", order).alias("held"), F.max_by("cost", order).alias("cost"), F.sum("gain").alias("gain"), F.sum(flow).alias("flow"))
    key = lambda r: (r.account_id or 0, r.security_id, r.trade_date)
    got, want = (sorted(d.collect(), key=key) for d in (ledger.daily_positions(tr), want))
    assert [key(r) for r in got] == [key(r) for r in want]
    assert all(tuple(a)[3:] == pytest.approx(tuple(b)[3:], abs=1e-6) for a, b in zip(got, want, strict=True))


def test_states_of_several_dates_are_those_of_each(spark):
    tr = _random(spark)
    prices = spark.createDataFrame([("A", date(2020, 1, 20), 3.5)], "security_id string, price_date date, price double")
    dates = ["2020-01-02", "2020-03-01", "2020-02-01"]
    got = ledger.portfolio_states(tr, prices, dates)
    for on in dates:
        want = {tuple(r) for r in ledger.portfolio_state(tr.where(F.col("trade_date") <= on), prices, on).collect()}
        assert {tuple(r) for r in got.where(F.col("on") == on).drop("on").collect()} == want and want


def test_quarters_read_the_trades_once_for_days_and_once_for_prices(spark):
    tr = _random(spark).where("account_id IS NOT NULL")
    prices = tr.groupBy("security_id", F.last_day("trade_date").alias("price_date")).agg(F.max(F.col("gross").cast("double")).alias("price"))
    got = quarterly_returns(tr, prices)
    assert "AttributeReference" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "LocalRelation" not in plan and "ExternalRDD" not in plan and plan.count("LogicalRDD") >= 3  # all branches read what was checkpointed
    days = ledger.daily_positions(tr).collect()
    for r in got.collect():
        assert r.flow == pytest.approx(sum(d.flow for d in days if d.account_id == r.account_id and r.period_start < d.trade_date <= r.period_end), abs=1e-6)


def test_issues_are_counted_without_a_row_for_each_level(spark):
    r = random.Random(3)
    rows = [(r.choice(["ERROR", "WARNING", "INFO", None]), r.choice(["A", "B", None]), r.choice(["d1", "d2", "d3", None])) for _ in range(60)]
    got = measures.issue_summary(spark.createDataFrame(rows, "severity string, code string, document_id string").repartition(3))
    assert "distinct" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = []
    levels = [lambda x: (x[0], x[1]), lambda x: (x[0], None), lambda x: (None, None)]
    for level in levels:
        for k in {level(x) for x in rows}:
            own = [x for x in rows if level(x) == k]
            want.append((*k, len(own), len({x[2] for x in own if x[2] and x[0] in ("ERROR", "WARNING")})))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_a_day_is_judged_once_for_all_its_events(spark):
    day = lambda n: date(2020, 1, 1) + timedelta(n)
    events = [(a, 10 * i, day(i % 30)) for i, a in enumerate([1, 2, None] * 200)] + [(1, 7, None)]
    periods = [(1, day(3), day(9)), (1, day(5), day(6)), (None, day(20), day(22)), (1, None, day(29))]
    e, p = spark.createDataFrame(events, "account_id int, event_id int, trade_date date"), spark.createDataFrame(periods, "account_id int, period_start date, period_end date")
    want = {(a, str(i), d) for a, i, d in events if d and any(q[0] == a and q[1] for q in periods) and not any(q[0] == a and q[1] and q[1] <= d <= q[2] for q in periods)}
    got = checks.outside_periods(e, p)
    assert {tuple(x)[:3] for x in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Window"):]  # days lie in the windows, not events


def test_sections_take_one_window_for_all_starts_and_one_for_all_stops(spark):
    text = ["Portfolio valuation as at", "h", "Cash account transaction details", "c", "Investment transaction details", "t", "Notes: end", "x"]
    lines = spark.createDataFrame([(d, 1, i, t) for d in (1, None) for i, t in enumerate(text)], "document_id int, page int, line_no int, text string")
    got = statements.tag_sections(lines)
    assert {(r.document_id, r.text): r.sections for r in got.where("size(sections) > 0").collect()} == {(d, t): [s] for d in (1, None) for t, s in (("h", "holdings"), ("c", "cash"), ("t", "trades"))}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2
