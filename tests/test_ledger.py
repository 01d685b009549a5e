import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as t
from ledgerloom.operators import ledger, matching, performance, quality

TRADES = "account_id int, security_id string, trade_date date, type string, units decimal(18,2), gross decimal(18,2), fees decimal(18,2), event_id string"


def _trades(spark, rows):
    from decimal import Decimal as D

    return spark.createDataFrame([(a, s, dt.date(2020, 1, 1) + dt.timedelta(d), k, D(u), D(g), D(f), f"e{i:04d}") for i, (a, s, d, k, u, g, f) in enumerate(rows)], TRADES)


def test_average_cost_values(spark):
    got = {r.event_id: r for r in ledger.average_cost(_trades(spark, [(1, "A", 0, "BUY", 100, 8000, 0), (1, "A", 1, "SELL", 40, 4400, 0), (2, "A", 0, "BUY", 10, 1000, 0), (2, "A", 1, "SELL", 25, 2500, 0)])).collect()}
    assert (got["e0001"].allocated, got["e0001"].gain, got["e0001"].cost) == (3200, 1200, 4800)
    assert (got["e0003"].held, got["e0003"].allocated, got["e0003"].cost) == (0, 1000, 0)


def test_fifo_values(spark):
    got = ledger.fifo_matches(_trades(spark, [(1, "A", 0, "BUY", 100, 8000, 0), (1, "A", 1, "BUY", 100, 10000, 0), (1, "A", 2, "SELL", 120, 13200, 0)])).groupBy((F.col("sell_id").isNull()).alias("open")).agg(F.sum("cost").alias("c"), F.sum("units").alias("u")).collect()
    assert {r.open: (r.c, float(r.u)) for r in got} == {False: (10000, 120), True: (8000, 80)}


@pytest.mark.parametrize("seed", range(3))
def test_against_a_plain_fold(spark, seed):
    rng, rows = random.Random(seed), []
    for day in range(60):
        rows.append((rng.randrange(2), rng.choice("AB"), day, rng.choice(["BUY", "BUY", "SELL"]), rng.randint(1, 50), rng.randint(100, 5000), rng.randint(0, 9)))
    want, fifo, state = {}, {}, {}
    for i, (a, s, _, kind, u, g, f) in enumerate(rows):
        units, cost, lots = state.get((a, s), (0, 0.0, []))
        if kind == "BUY":
            units, cost, lots = units + u, cost + g + f, [*lots, [u, (g + f) / u]]
            want[f"e{i:04d}"] = (units, cost, 0.0)
        else:
            sold = min(u, units)
            taken = cost * sold / units if units else 0.0
            left, spent = sold, 0.0
            while left:
                n = min(left, lots[0][0])
                spent, left, lots[0][0] = spent + n * lots[0][1], left - n, lots[0][0] - n
                lots = lots if lots[0][0] else lots[1:]
            units, cost = units - sold, cost - taken if units > sold else 0.0
            want[f"e{i:04d}"] = (units, cost, taken)
            if sold:
                fifo[f"e{i:04d}"] = spent
        state[a, s] = (units, cost, lots)
    df = _trades(spark, rows).repartition(3)
    got = {r.event_id: (r.held, r.cost, r.allocated) for r in ledger.average_cost(df).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    sells = {r.sell_id: r.c for r in ledger.fifo_matches(df).where("sell_id IS NOT NULL").groupBy("sell_id").agg(F.sum("cost").alias("c")).collect()}
    assert sells == pytest.approx(fifo)


def test_returns(spark):
    d = dt.date
    periods = spark.createDataFrame([(1, d(2024, 1, 1), d(2024, 1, 11), 100.0, 120.0), (2, d(2024, 1, 1), d(2024, 1, 11), 100.0, 220.0), (3, d(2024, 1, 1), d(2024, 1, 11), 0.0, 0.0)], "account_id int, period_start date, period_end date, begin_value double, end_value double")
    flows = spark.createDataFrame([(2, d(2024, 1, 6), 100.0)], "account_id int, date date, amount double")
    got = {r.account_id: r.r for r in performance.modified_dietz(periods, flows).collect()}
    assert got[1] == pytest.approx(0.2) and got[2] == pytest.approx(20 / 150) and got[3] is None
    cash = spark.createDataFrame([(1, d(2024, 1, 1), -1000.0), (1, d(2024, 12, 31), 1100.0), (2, d(2024, 1, 1), 5.0)], "account_id int, date date, amount double")
    rates = {r.account_id: r.xirr for r in performance.xirr(cash, "account_id").collect()}
    assert rates[1] == pytest.approx(0.1, abs=1e-3) and rates[2] is None


def test_drawdowns(spark):
    def run(series, floor=0.05):
        rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(series)]
        return performance.drawdown_episodes(spark.createDataFrame(rows, "account_id int, period_end date, index double"), floor).orderBy("peak").collect()

    (one,) = run([100, 110, 120, 110, 100, 90, 100, 115, 125])
    assert (one.peak.day, one.trough.day, one.recovery.day, one.recovery_days) == (3, 6, 9, 3) and one.depth == pytest.approx(-0.25)
    assert run([100, 120, 80, 85])[0].recovery is None and run([100, 99, 98, 100, 101]) == []
    assert len(run([100, 98, 100], 0.01)) == 1 and run([100, 120, 120, 120, 90, 130])[0].peak.day == 2


def test_text(spark):
    row = spark.range(1).select(t.parse_decimal(F.lit("$ 1,234.50")).cast("double").alias("a"), t.parse_decimal(F.lit("--5")).cast("double").alias("b"), t.parse_decimal(F.lit("-")).alias("c"), t.parse_date(F.lit("5-Jan-2024")).alias("d"), t.normalise_code(F.lit("vas.ax")).alias("e"), t.redact(F.lit("id 123456 on 05-Jan-2024")).alias("f")).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (1234.5, -5.0, None, dt.date(2024, 1, 5), "VAS", "id ###### on 05-Jan-2024")


def test_settlement_uses_each_transfer_once(spark):
    tr = _trades(spark, [(1, "A", 0, "BUY", 1, 100, 0), (1, "B", 1, "BUY", 1, 100, 0)])
    cash = spark.createDataFrame([(1, "c1", dt.date(2020, 1, 3), -100.0)], "account_id int, event_id string, trade_date date, amount double")
    (pair,) = matching.pair_settlements(tr, cash).collect()
    assert (pair.trade_id, pair.transfer_id, pair.days_to_cash) == ("e0000", "c1", 2)


def test_upsert_and_empty(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert {r.k: r.v for r in quality.upsert(a, a.where("k = 2").withColumn("v", F.lit("z")), "k").collect()} == {1: "x", 2: "z"}
    assert ledger.average_cost(_trades(spark, [])).count() == 0
