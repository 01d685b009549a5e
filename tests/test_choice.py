"""One-to-one choices against plain walks."""

import datetime as dt
import random
import time

import pytest

from ledgerloom.operators import matching

DAY = dt.date(2020, 1, 1)
TRADES = "account_id int, event_id string, trade_date date, type string, gross decimal(18,2), fees decimal(18,2)"
CASH = "account_id int, event_id string, trade_date date, amount decimal(18,2)"


def walk(rows, order, preference):
    """rows: (left, right, {column: value}); left rows in order take their best free right row."""
    taken, used, out = set(), set(), []
    for a, b, v in sorted(rows, key=lambda r: (*[r[2][c] for c in order], r[0], *[r[2][c] for c in preference], r[1])):
        if a not in taken and b not in used:
            taken.add(a), used.add(b), out.append((a, b))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_rounds_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    own = [(f"a{i:03d}", rng.randrange(12), rng.randrange(4)) for i in range(120)] + [(f"a9{i:02d}", 5, 2) for i in range(25)]
    other = [(f"b{i:03d}", rng.randrange(12), rng.randrange(4)) for i in range(110)] + [(f"b9{i:02d}", 5, 2) for i in range(30)]
    rows = [(a, b, {"k": 1, "on1": d, "c1": c, "on2": e, "c2": f, "off": abs(c - f), "days": abs(d - e)}) for a, d, c in own for b, e, f in other if abs(d - e) <= 2 and abs(c - f) <= 1]
    df = spark.createDataFrame([(a, b, *v.values()) for a, b, v in rows], "l string, r string, k int, on1 int, c1 int, on2 int, c2 int, off int, days int")
    got = matching.greedy_one_to_one(df, "l", "r", ["on1"], ["off", "days"], ["k", "on1", "c1"])
    assert sorted((r.l, r.r) for r in got.collect()) == walk(rows, ["on1"], ["off", "days"])
    assert matching.greedy_one_to_one(df.limit(0), "l", "r", ["on1"], ["off"], ["k"]).count() == 0


@pytest.mark.parametrize("amounts", [1, 2, 3, 40])
def test_settlements_equal_a_walk(spark, amounts):
    """Blocks of one and two amounts go by running maxima, wider ones as a stream."""
    rng = random.Random(amounts)
    trades = [(i % 3, f"t{i:03d}", rng.randrange(60), rng.randrange(amounts)) for i in range(240)]
    cash = [(i % 3, f"m{i:03d}", rng.randrange(70), rng.randrange(amounts)) for i in range(200)]
    rows = [(t, m, {"on": d, "days": e - d}) for a, t, d, c in trades for b, m, e, f in cash if a == b and e >= d and abs(c - f) <= 1]
    got = matching.pair_settlements(
        spark.createDataFrame([(a, t, DAY + dt.timedelta(d), "SELL", (10_000 + c) / 100, 0.0) for a, t, d, c in trades], TRADES.replace("decimal(18,2)", "double")), spark.createDataFrame([(a, m, DAY + dt.timedelta(d), (10_000 + c) / 100) for a, m, d, c in cash], CASH.replace("decimal(18,2)", "double"))
    ).collect()
    assert sorted((r.trade_id, r.transfer_id) for r in got) == walk(rows, ["on"], ["days"])
    assert all((r.settled - r.traded).days == r.days_to_cash >= 0 for r in got)


@pytest.mark.parametrize("amounts", [1, 3])
def test_twenty_thousand_equal_amounts_of_one_account(spark, amounts):
    t = spark.range(20_000).selectExpr("1 AS account_id", "concat('t', lpad(id, 6, '0')) AS event_id", "date_add(DATE '2020-01-01', int(id / 100)) AS trade_date", "'BUY' AS type", f"CAST(100 + (id % {amounts}) / 100 AS decimal(18,2)) AS gross", "CAST(0 AS decimal(18,2)) AS fees")
    m = spark.range(20_000).selectExpr("1 AS account_id", "concat('m', lpad(id, 6, '0')) AS event_id", "date_add(DATE '2020-01-03', int(id / 100)) AS trade_date", f"CAST(-100 - (id % {amounts}) / 100 AS decimal(18,2)) AS amount")
    began = time.time()
    got = matching.pair_settlements(t, m)
    assert got.count() == 20_000 and got.select("transfer_id").distinct().count() == 20_000 and time.time() - began < 30
