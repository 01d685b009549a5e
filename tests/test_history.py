import datetime as dt

import duckdb
import pytest

import __spark_entry__ as e
from ledgerloom.operators import history
from ledgerloom.operators.periods import standard_periods
from ledgerloom.sources import exports

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


def _day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def test_rolling_return(spark):
    index = spark.createDataFrame([("a", _day(d), float(v)) for d, v in ((0, 100), (10, 110), (25, 121), (30, 132))], "account_id string, period_end date, index double")
    got = {r.period_end: (r.rolling_return, r.estimated) for r in history.rolling_return(index, 15).collect()}
    assert got[_day(0)] == (None, None) and got[_day(10)] == (None, None)
    assert got[_day(25)] == (pytest.approx(0.1), False)
    assert got[_day(30)] == (pytest.approx(132 / 121 - 1), True)


def test_high_water_keeps_the_first_day(spark):
    daily = spark.createDataFrame([(1, _day(d), v) for d, v in enumerate([-5, 10, 10, 4])], "account_id int, trade_date date, cash int").selectExpr("account_id", "trade_date", "CAST(cash AS decimal(18,2)) AS cash")
    got = [(r.high, r.reached, r.days_since, r.drawdown) for r in history.high_water_history(daily).orderBy("trade_date").collect()]
    assert [float(x[0]) for x in got] == [0, 10, 10, 10]
    assert got[3][1:] == (_day(1), 2, pytest.approx(-0.6)) and got[0][3] is None


def test_standard_periods_snap_and_refuse(spark):
    index = spark.createDataFrame([("a", _day(d), v) for d, v in ((0, 100.0), (88, 110.0), (180, 121.0))], "account_id string, period_end date, index double")
    got = {r.label: r for r in standard_periods(index).collect()}
    assert (got["3M"].measured_from, got["3M"].twrr) == (_day(88), pytest.approx(0.1))
    assert got["INCEPTION"].twrr == pytest.approx(0.21) and got["1Y"].status == "UNAVAILABLE"
    assert got["1D"].reason == "both ends are one valuation"


def test_reversals(spark):
    rows = [(1, "a", _day(0), 50), (1, "b", _day(3), 50), (1, "c", _day(5), -50), (1, "d", _day(90), -50), (2, "x", _day(1), -50)]
    got = history.reversal_pairs(spark.createDataFrame(rows, "account_id int, event_id string, trade_date date, amount int")).collect()
    assert [(r.event_id, r.reverses, r.days) for r in got] == [("c", "b", 2)]


def test_exports(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Account number," + ",".join(exports.INVESTMENT_COLUMNS) + "\n123456,X,ab.ax,ETF,05-Jan-2024,Buy Trade,$10.00,3,30.00,\n123456,X,AB,ETF,05-Jan-2024,Buy,10,-3,30,9\n")
    raw = exports.read_export(spark, str(tmp_path / "in.csv"), exports.INVESTMENT_COLUMNS)
    assert "Account number" not in raw.columns
    good, bad = exports.split_quarantine(exports.parse_investment(raw))
    assert [(r.product_id, float(r.canonical_brokerage), r.warned) for r in good.collect()] == [("AB", 0.0, False)]
    assert [r.reason_code for r in bad.collect()] == ["SIGN_MISMATCH"]
    with pytest.raises(ValueError, match="Total"):
        exports.read_export(spark, str(tmp_path / "in.csv"), exports.CASH_COLUMNS)
    rows = spark.createDataFrame([(1, _day(0), "fine"), (2, _day(400), "fine")], "n int, trade_date date, note string")
    exports.write_history(rows, str(tmp_path / "h"))
    stored = lambda: sorted((r.n, r.note) for r in spark.read.parquet(str(tmp_path / "h")).collect())
    more = spark.createDataFrame([(3, _day(100), "new"), (4, _day(120), "new"), (5, _day(50), "before")], "n int, trade_date date, note string")
    exports.write_history(more, str(tmp_path / "h"), from_date=str(_day(100)))
    assert stored() == [(1, "fine"), (3, "new"), (4, "new")]  # of the year the rows before stay, the year after has none any more
    exports.write_history(rows, str(tmp_path / "h"))
    assert stored() == [(1, "fine"), (2, "fine")]
    exports.export_dataset(rows, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="digits"):
        exports.export_dataset(rows.selectExpr("n", "'id 1234567' AS note"), str(tmp_path / "no"))


def _cells(rows):
    return sorted(tuple(("" if v is None or v != v else f"{float(v):.5g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(e.catalog_history.NAMES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = e.queries()[name](spark, SF)
    want = con.sql(e.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    want = want.project(", ".join(f'"{c}"' for c in order)).fetchall()
    assert _cells(got.select(*order).collect()) == _cells(want)
