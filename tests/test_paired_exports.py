"""Exports that pair in one exchange give what joins give."""

import random
from datetime import date
from decimal import Decimal as D

import pytest
from test_candidates import CASH, TRADES, _rows

import __spark_entry__ as e
from ledgerloom.operators import candidates


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


@pytest.fixture
def small(spark, monkeypatch):
    """Short stretches of amounts and short batches, so that many pairs lie across their ends."""
    monkeypatch.setattr(candidates, "_STRETCH", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_exports_pair_in_one_exchange_as_by_joins(spark, small):
    assert joins(e.queries()["matched_exports"](spark, "/root/testdata/sf0.001")) == 0  # before: 16, since the trades were read again for each use
    r = random.Random(8)
    more = lambda rows, at: [(*x[:at], None if x[at] is None else x[at] + D(r.choice([0, 0, 0, 1, 2, 7, 8, 9, 15, 16])) / 100, *x[at + 1 :]) for x in rows]
    trades, cash = _rows(5, 300)
    trades, cash = more(trades, 7), more([(*c[:6], abs(c[6]), c[7]) for c in cash], 6)
    trades += [(None, 900, "BUY", "A", "x", date(2020, 1, 1), D(1), D(10), D(1), D(0)), *[(9, 20_000 + i, "BUY", None, "x", date(2020, 1, 1), D(1), D(10), D(1), D(0)) for i in range(100)]]
    cash += [(None, 901, "TRADE_BUY_CASH", "A", "x", date(2020, 1, 1), D(10), None), (9, 902, "TRADE_BUY_CASH", "B", "X ", date(2020, 1, 2), D(-10), None)]
    own, other = spark.createDataFrame(trades, TRADES), spark.createDataFrame(cash, CASH)
    seen = set()
    for cents, days in ((1, 5), (3, 2), (0, 0)):
        want, got = candidates.match_exports(own, other, cents, days), candidates.pair_exports(own, other, cents, days)
        assert got.select(want.columns).dtypes == want.dtypes
        rows = [tuple(x) for x in got.select(want.columns).collect()]
        assert sorted(rows, key=repr) == sorted(map(tuple, want.collect()), key=repr)
        seen |= {x[1] for x in rows}
    assert len(seen) == 6 and candidates.pair_exports(own.limit(0), other.limit(0)).count() == 0


def test_candidates_come_with_their_pair(spark, small):
    assert joins(e.queries()["candidate_trades"](spark, "/root/testdata/sf0.001")) == 0  # before: 52, since the trades were read again for each use
    trades, cash = _rows(6, 300)
    cash += [(t[0], 30_000 + t[1], "TRADE_BROKERAGE_CASH", None, f"fee {t[2]} {(t[4] or '').strip()}", t[5], D(-9), None) for t in trades[::2]]
    own, other = spark.createDataFrame(trades, TRADES), spark.createDataFrame(cash, CASH)
    for want, got in zip(candidates.trade_candidates(candidates.match_exports(own, other), own, other), candidates.paired_candidates(own, other), strict=True):
        assert got.dtypes == want.dtypes
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect()))) and want.count() > 0
