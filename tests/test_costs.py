"""Costs and as-of prices against plain folds."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ledger

TRADES = "account_id int, security_id string, trade_date date, type string, units decimal(18,2), gross decimal(18,2), fees decimal(18,2), event_id string"
DAY = dt.date(2020, 1, 1)


def trades(spark, rows):
    return spark.createDataFrame([(1, "A", DAY + dt.timedelta(d), k, D(u), None if g is None else D(g), None if g is None else D(0), f"e{i:06d}") for i, (d, k, u, g) in enumerate(rows)], TRADES)


def lots(df):
    return sorted((r.buy_id, r.sell_id or "open", float(r.units), r.cost) for r in ledger.fifo_matches(df).collect())


def test_lots_of_corporate_actions_before_between_and_after_buys(spark):
    after = trades(spark, [(0, "BUY", 100, 1000), (1, "CORPORATE_ACTION", 100, None), (2, "SELL", 150, 900)])
    assert lots(after) == [("e000000", "e000002", 100.0, 1000.0), ("e000001", "e000002", 50.0, 0.0), ("e000001", "open", 50.0, 0.0)]
    before = trades(spark, [(0, "CORPORATE_ACTION", 50, None), (1, "BUY", 100, 1000), (2, "SELL", 100, 900)])
    assert lots(before) == [("e000000", "e000002", 50.0, 0.0), ("e000001", "e000002", 50.0, 500.0), ("e000001", "open", 50.0, 500.0)]
    between = trades(spark, [(0, "BUY", 10, 100), (1, "CORPORATE_ACTION", 10, None), (1, "BUY", 10, 300), (2, "SELL", 25, 900)])
    got = lots(between)
    assert sum(u for *_, u, _ in got) == 30 and sum(c for _, s, _, c in got if s != "open") in (250.0, 400.0)


def test_cost_of_many_trades_of_one_position(spark):
    """A hundred thousand trades that turn the position over thousands of times, with actions and returns to nothing."""
    rng, rows, held = random.Random(9), [], D(0)
    for i in range(100_000):
        kind = rng.choices(["BUY", "SELL", "CORPORATE_ACTION"], [10, 9, 0.05])[0]
        units = D(rng.randint(1, 90_000)) / 100
        if kind == "SELL":
            units = held if rng.random() < 0.0002 else min(units, held)
        rows.append((i // 100, kind, max(units, D("0.01")), D(rng.randint(1, 10**7)) / 100 if kind != "CORPORATE_ACTION" else None))
        held = max(D(0), held - rows[-1][2]) if kind == "SELL" else held + rows[-1][2]
    df = trades(spark, rows).withColumn("trade_date", F.lit(DAY))
    kinds = {k: i for i, k in enumerate(sorted({r[1] for r in rows}, key=lambda k: spark.range(1).select(ledger.type_order(F.lit(k))).first()[0]))}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], kinds[rows[i][1]], i))
    df = df.withColumn("trade_date", F.date_add(F.lit(DAY), (F.substring("event_id", 2, 6).cast("int") / 100).cast("int")))
    got = {r.event_id: r for r in ledger.average_cost(df).collect()}
    units, cost, worst = D(0), 0.0, 0.0
    for i in order:
        _, kind, u, g = rows[i]
        if kind == "SELL":
            sold = min(u, units)
            taken = cost * float(sold) / float(units) if units else 0.0
            units, cost = units - sold, cost - taken if units > sold else 0.0
        else:
            taken, units, cost = 0.0, units + u, cost + (float(g) if kind == "BUY" else 0.0)
        r = got[f"e{i:06d}"]
        assert r.held == float(units)
        worst = max(worst, abs(r.cost - cost) / max(cost, 1.0), abs(r.allocated - taken) / max(taken, 1.0))
    assert worst < 1e-9


def test_asof_prices_of_a_hot_security(spark):
    """All points ask for one security; ties, days before any price, null days and securities, two prices of a day."""
    rng = random.Random(3)
    points = [(i, rng.choice(["A"] * 9 + ["B", None]), rng.choice([None, *range(-5, 60)])) for i in range(2_000)]
    prices = [("A", d, float(p)) for d, p in [(0, 5), (0, 7), (3, 8), (30, None), (31, 9)] if p] + [("B", 10, 1.0)]
    day = lambda d: None if d is None else DAY + dt.timedelta(d)
    got = ledger.asof_prices(spark.createDataFrame([(i, s, day(d)) for i, s, d in points], "id int, security_id string, on date"), spark.createDataFrame([(s, day(d), p) for s, d, p in prices] + [("A", day(30), None)], "security_id string, price_date date, price double"))
    want = {}
    for i, s, d in points:
        best = max(((x, p) for q, x, p in prices if q == s and d is not None and x <= d), default=(None, None))
        want[i] = (best[1], "UNAVAILABLE" if best[1] is None else "QUOTED" if best[0] == d else "CARRIED_FORWARD")
    rows = got.collect()
    assert len(rows) == len(points) and {r.id: (r.price, r.quality) for r in rows} == want
    windows = [n for n in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Window" in n]
    assert windows and got.where("price IS NULL").count() == sum(1 for p, _ in want.values() if p is None)
