import datetime as dt
import decimal
import random

import duckdb
import pytest

import __spark_entry__ as e
from ledgerloom import catalog, catalog_checks, catalog_reconcile, catalog_statements, catalog_windows
from ledgerloom.functions.text import TYPE_ORDER, type_order
from ledgerloom.operators import checks, performance, reconcile
from ledgerloom.streaming import staging
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = ["lineitem", "orders", "part", "events", "nation", "documents"]
OWN = {"rebuild_boundary", "extended_index", "quarterly_returns_query", "drawdown_analytics", "settlement_pairs", "xirr", "average_cost", "asof_prices", "redact_documents"}
NAMES = sorted(OWN | {n for m in (catalog_checks, catalog_reconcile, catalog_statements, catalog_windows) for n in catalog.QUERIES if getattr(m, n, None) is catalog.QUERIES[n]})


def _day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def _cells(rows):
    return sorted(tuple(("" if v is None or v != v else f"{float(v) + 0.0:.5g}" if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool) else str(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = e.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({e.oracle_sql()[name]})").fetchall()
    assert _cells(got.select(*[F.col(f"`{c}`") for c in names]).collect()) == _cells(want)


def test_type_order(spark):
    rows = spark.createDataFrame([(t,) for t in ["OTHER", "FEE", "TAX", "SELL", "BUY", "CORPORATE_ACTION", "?"]], "t string")
    assert [r.t for r in rows.orderBy(type_order(F.col("t"))).collect()] == ["CORPORATE_ACTION", "BUY", "SELL", "TAX", "FEE", "OTHER", "?"]
    assert len(set(TYPE_ORDER)) == 12


def test_outside_periods_brute_force(spark):
    rng = random.Random(2)
    periods = [(a, s, s + rng.randrange(30)) for a in (1, 2) for s in (rng.randrange(200) for _ in range(5))] + [(1, 5, None)]
    events = [(rng.choice([1, 2, 3]), str(i), rng.randrange(230)) for i in range(200)]
    p = spark.createDataFrame([(a, _day(s), None if z is None else _day(z)) for a, s, z in periods], "account_id int, period_start date, period_end date")
    ev = spark.createDataFrame([(a, i, _day(d)) for a, i, d in events] + [(1, "none", None)], "account_id int, event_id string, trade_date date")
    want = {i for a, i, d in events if a != 3 and not any(b == a and z is not None and s <= d <= z for b, s, z in periods)}
    assert {r.event_id for r in checks.outside_periods(ev, p).collect()} == want


def test_reconciliation_brute_force(spark):
    rng = random.Random(5)
    side = lambda k: [(rng.choice([1, 2]), f"{k}{i}", rng.choice(["FEE", "DEPOSIT"]), rng.choice([None, "A", "B"]), rng.randrange(40), rng.randrange(1000, 1006)) for i in range(60)]
    a, b = side("a"), side("b")
    used, want = set(), {}
    for acc, i, kind, s, d, c in sorted(a, key=lambda r: (r[4], r[1])):
        near = [(int(s is not None and y[3] is not None and s != y[3]), abs(d - y[4]), y[1]) for y in b if y[0] == acc and y[2] == kind and abs(y[5] - c) <= 1 and abs(y[4] - d) <= 7 and y[1] not in used]
        if near:
            want[i] = min(near)[2]
            used.add(want[i])
    frame = lambda rows: spark.createDataFrame([(acc, i, k, s, _day(d), float(c)) for acc, i, k, s, d, c in rows], "account_id int, event_id string, type string, security_id string, on date, amount double").withColumn("amount", (F.col("amount") / 100).cast("decimal(18,2)"))
    own, other = frame(a), frame(b)
    pairs = reconcile.cash_pairs(own, other)
    assert {r.id1: r.id2 for r in pairs.collect()} == want
    got = reconcile.reconciled(own, other, pairs).collect()
    assert len(got) == len(a) + len(b) - len(want) and {r.id1 for r in got if r.id1} == {r[1] for r in a} and all(r.resolved == (r.status in reconcile.RESOLVED) for r in got)
    assert reconcile.reconciled(own.limit(0), other.limit(0), reconcile.cash_pairs(own.limit(0), other.limit(0))).count() == 0


def test_extended_index_equals_a_rebuild(spark):
    rng = random.Random(4)
    returns = spark.createDataFrame([(a, _day(30 * k), rng.choice([None, rng.uniform(-0.3, 0.3)])) for a in (1, 2) for k in range(20)], "account_id int, period_end date, r double")
    whole = performance.return_index(returns)
    stored = whole.where(F.col("period_end") <= F.lit(_day(200)))
    later = performance.extended_index(stored, returns.where(F.col("period_end") > F.lit(_day(200))))
    key = lambda d: sorted((r.account_id, r.period_end, round(r["index"], 9), round(r["high"], 9), round(r["drawdown"], 9)) for r in d.collect())
    assert key(stored.unionByName(later)) == key(whole)


def test_stream_of_events(spark, tmp_path):
    schema = "event_id string, slot string, trade_date date"
    put = lambda rows, k: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    run = lambda: staging.stream_events(spark, str(tmp_path / "in/*"), spark.createDataFrame([], schema).schema, str(tmp_path / "store"), str(tmp_path / "checkpoint"))
    put([("a", "s1", _day(5)), ("b", "s2", _day(6)), ("a", "s1", _day(5))], 1)
    run()
    put([("a", "s1", _day(5)), ("c", "s2", _day(1)), ("d", "s3", _day(0))], 2)
    run()
    run()
    store = spark.read.parquet(str(tmp_path / "store"))
    assert sorted((r.event_id, r.status) for r in store.collect()) == [("a", "ADDED"), ("b", "ADDED"), ("c", "SOURCE_CHANGED"), ("d", "ADDED")]
    assert sorted(r.event_id for r in staging.current(store).collect()) == ["a", "c", "d"]
