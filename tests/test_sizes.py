"""What large tables need: jobs without pairs or long rows in between, and the same results as a plain walk."""

import random
from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

import __spark_entry__ as e
from ledgerloom.functions import text
from ledgerloom.operators import candidates, matching, reconcile
from ledgerloom.sources import exports


def test_trades_match_without_a_join_and_as_in_a_walk(spark):
    r = random.Random(3)
    shape = "account_id int, security_id string, type string, trade_date date, gross decimal(18,2), event_id string"
    rows = lambda p: [(r.choice([1, 2, None]), "A", r.choice(["BUY", "SELL"]), r.choice([date(2020, 1, 1 + r.randrange(28)), None, date(2020, 3, 1 + r.randrange(28)), date(2021, 3, 1 + r.randrange(28))]), r.choice([D(r.randrange(100, 112)) / 100, D("9999999999999999.98"), None]), f"{p}{i}") for i in range(150)]
    one, other, seen = rows("a"), rows("b"), set()
    other = other[:60] + [(*a[:4], D(20 * i) if a[4] else None, f"c{i}") for i, a in enumerate(one[:90])]
    other += [(*b[:5], f"d{i}") for i, b in enumerate(other[60:80])]
    one = [(*a[:4], D(20 * i) if a[4] else None, a[5]) if i < 90 and i % 3 else a for i, a in enumerate(one)]
    for cents, days in ((1, 5), (0, 3), (2, 1)):
        fits = lambda a, b: None not in a and None not in b and a[:3] == b[:3] and abs(a[4] - b[4]) * 100 <= cents and abs((a[3] - b[3]).days) <= days  # noqa: B023, E731
        theirs, mine = {a[5]: [b for b in other if fits(a, b)] for a in one}, {b[5]: sum(fits(a, b) for a in one) for b in other}
        want = {(None, "UNMATCHED_CASH", b, None) for b, n in mine.items() if not n}
        for a in one:
            c = theirs[a[5]]
            if len(c) != 1 or mine[c[0][5]] > 1:
                want.add((a[5], "AMBIGUOUS" if c else "UNMATCHED_INVESTMENT", None, None))
            else:
                want.add((a[5], "MATCH" if c[0][3:5] == a[3:5] else "MATCH_WITH_MINOR_DIFFERENCE", c[0][5], (c[0][3] - a[3]).days))
        got = matching.match_trades(spark.createDataFrame(one, shape), spark.createDataFrame(other, shape), cents, days)
        assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        seen |= {w[1] for w in want}
    assert len(seen) == 5


def test_trades_of_two_sources_pair_without_pairs_of_candidates(spark):
    r = random.Random(5)
    shape = "account_id int, event_id {0}, type string, security_id string, on date, amount decimal(18,2), units double"
    rows = lambda p: [(r.choice([1, 1, 2, None]), p + i, "BUY", r.choice(["A", "A", "B"]), r.choice([date(2020, 1, 1 + r.randrange(28)), None, date(2020, 1, 1 + r.randrange(28))]), r.choice([D(r.randrange(100, 106)) / 100, D(7), None]), r.choice([1.0, -1.0, 1.4, 1.5, 2.0, None, float("nan")])) for i in range(120)]
    own, other = rows(0), rows(1000)
    own += [(3, 500 + i, "BUY", "C", date(2020, 1, 5), D(5), 9.0) for i in range(3000)]  # a crowd of equal rows makes no 9,000,000 pairs
    other += [(3, 5000 + i, "BUY", "C", date(2020, 1, 6 + i % 2), D(5), 9.0) for i in range(2990)]
    for days in (7, 2):
        want, used = set(), set()
        for a in sorted((a for a in own if a[0] in (1, 2) and a[4]), key=lambda a: (a[4], a[1])):
            fits = [b for b in other if b[0] == a[0] and b[3] == a[3] and b[1] not in used and b[4] and a[6] and b[6] and abs((a[4] - b[4]).days) <= days and abs(abs(a[6]) - abs(b[6])) < 0.5]
            if fits:
                best = min(fits, key=lambda b: (abs((a[4] - b[4]).days), -1 if None in (a[5], b[5]) else abs(a[5] - b[5]), b[1]))  # noqa: B023
                used.add(best[1])
                want.add((a[1], best[1]))
        got = reconcile.trade_pairs(spark.createDataFrame(own, shape.format("int")).repartition(3), spark.createDataFrame(other, shape.format("long")), days)
        pairs = [(p.id1, p.id2) for p in got.collect()]
        assert {p for p in pairs if p[0] < 500} == want and len(pairs) == len(want) + 2990
        assert {p for p in pairs if p[0] >= 500} == set(zip(range(500, 3490), sorted(range(5000, 7990), key=lambda i: (i % 2, i)), strict=True))
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_brokerage_is_attached_by_one_stream(spark):
    r = random.Random(7)
    day = lambda: r.choice([date(2020, 1, 1 + r.randrange(28)), date(2020, 1, 1 + r.randrange(28)), None])
    trades = [(r.choice([1, 2, None]), i, r.choice(["BUY", "SELL"]), r.choice(["A", "AB", None]), day(), r.choice([D(5), D(6), D(0), None])) for i in range(150)]
    fees = [(r.choice([1, 2]), f"f{i}", day(), r.choice([D(-5), D(6), None]), r.choice(["fee buy ab", "Fee SELL A", "buy a", "other", None])) for i in range(90)]
    trades += [(3, 500 + i, "BUY", "A", date(2020, 1, 5), D(5)) for i in range(3000)]
    fees += [(3, f"g{i:04d}", date(2020, 1, 7), D(5), "buy a") for i in range(2990)]
    want, used = {}, set()
    for t in sorted((t for t in trades if t[0] in (1, 2) and t[3] and t[4] and t[5]), key=lambda t: (t[4], t[1])):
        fits = [f for f in fees if f[0] == t[0] and f[1] not in used and f[2] and f[3] and f[4] and abs(f[3]) == t[5] and 0 <= (f[2] - t[4]).days <= 7 and t[2].lower() in f[4].lower() and t[3].lower() in f[4].lower()]
        if fits:
            best = min(fits, key=lambda f: (f[2], f[1]))
            used.add(best[1])
            want[t[1]] = (best[1], (best[2] - t[4]).days)
    best = reconcile.attach_brokerage(spark.createDataFrame(trades, "account_id int, event_id int, type string, security_id string, on date, brokerage decimal(18,2)").repartition(3), spark.createDataFrame(fees, "account_id int, fee_id string, on date, amount decimal(18,2), description string"))
    got = {g.event_id: (g.fee_id, g.days) for g in best.collect()}
    assert len(got) == len(trades) and want
    assert all(got[t[1]] == (want.get(t[1], (None, None)) if t[1] < 500 else (f"g{t[1] - 500:04d}", 2) if t[1] < 3490 else (None, None)) for t in trades)
    assert "MapInArrow" in best._jdf.queryExecution().optimizedPlan().toString()


def test_settlements_stream_where_they_lie_and_blocks_cross_stretches(spark):
    at = matching._STRETCH
    amounts = [at - 2, at - 1, at, at + 1, 2 * at - 1, 2 * at, 3 * at, 3 * at + 2, -at, -at - 1, -1, 0, *range(4 * at - 3, 5 * at + 3, 1)]
    t = spark.createDataFrame([(c,) for c in amounts], "c long").selectExpr("1 AS account_id", "concat('t', c) AS event_id", "DATE '2020-01-01' AS trade_date", "'SELL' AS type", "CAST(c / 100 AS decimal(18,2)) AS gross", "CAST(0 AS decimal(18,2)) AS fees")
    m = t.selectExpr("account_id", "concat('m', event_id) AS event_id", "date_add(trade_date, 1) AS trade_date", "gross AS amount")
    got = matching.pair_settlements(t, m).collect()
    assert len(got) == len(amounts) == len({p.trade_id for p in got}) == len({p.transfer_id for p in got})
    assert all(abs(int(p.trade_id[1:]) - int(p.transfer_id[2:])) <= 1 and p.days_to_cash == 1 for p in got)
    # by the amounts that adjoin, whatever stretches they lie in
    assert {p.block for p in got} == {at - 2, 2 * at - 1, 3 * at, 3 * at + 2, -at - 1, -1, 4 * at - 3}
    ranged = spark.range(10).selectExpr("1 AS account_id", "concat('t', id) AS event_id", "DATE '2020-01-01' AS trade_date", "'SELL' AS type", "CAST(id AS decimal(18,2)) AS gross", "CAST(0 AS decimal(18,2)) AS fees")
    plan = matching.pair_settlements(ranged, ranged.selectExpr("account_id", "event_id", "trade_date", "gross AS amount"))
    assert "RDD" not in plan._jdf.queryExecution().optimizedPlan().toString() and plan.count() == 10  # nothing is written in between


def test_exports_meet_once_for_each_side_of_the_result(spark):
    """Pairs are made twice, for trades and for lost legs; amounts and days at the ends of cells meet."""
    day = lambda d: date.fromordinal(date(2020, 1, 1).toordinal() + d)
    # each account has one trade; its leg lies at the edge of what it may reach, or just past it
    places = [(100 * k + c, d, off, late) for k, c in enumerate(range(90)) for d in (k,) for off, late in ((1, 5), (-1, -5), (2, 0), (0, 6), (0, -6))]
    trades = [(i, i, "BUY", "A", "one", day(d), D(1), D(1000 + c) / 100) for i, (c, d, _, _) in enumerate(places)]
    cash = [(i, 10_000 + i, "TRADE_BUY_CASH", None, "One", day(d + late), -D(1000 + c + off) / 100, D(1)) for i, (c, d, off, late) in enumerate(places)]
    got = candidates.match_exports(
        spark.createDataFrame(trades, "account_id int, row_id int, side string, product_id string, security_name string, trade_date date, canonical_units decimal(18,2), gross_value decimal(18,2)"),
        spark.createDataFrame(cash, "account_id int, row_id int, cash_class string, product_id string, product_name string, date date, signed_total decimal(18,2), units decimal(18,2)"),
    )
    found = {r.trade_row: r.cash_row for r in got.collect() if r.trade_row is not None}
    assert found == {i: 10_000 + i if abs(off) <= 1 and abs(late) <= 5 else None for i, (_, _, off, late) in enumerate(places)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 4  # each side: pairs, and what they tell its rows


def test_parsing_of_exports_stays_within_what_the_jvm_compiles(spark):
    """HotSpot interprets methods of over 8,000 bytes, however often they run."""
    size = lambda df: max(g.apply(i)._3().maxMethodCodeSize() for g in [df._jdf.queryExecution().debug().codegenToSeq()] for i in range(g.size()))
    raw = spark.createDataFrame([("x",) * 9], ", ".join(f"`{c}` string" for c in exports.INVESTMENT_COLUMNS))
    assert 0 < size(exports.parse_investment(raw)) < 8000
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # otherwise code is generated stage by stage as it runs
    try:
        assert 0 < size(e.queries()["parse_investment"](spark, "/root/testdata/sf0.001")) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_odd_cells_parse_as_by_one_layout_after_the_other(spark):
    dates = {"05-Jan-2024": "2024-01-05", " 5-jan-24 ": "2024-01-05", "30 June 2026": "2026-06-30", "30 Jun 2026": "2026-06-30", "5 May 2024": "2024-05-05", "2024-01-05": "2024-01-05", "+12024-01-05": "+12024-01-05"}
    dates |= dict.fromkeys(["", "-", "not yet settled", "30-Feb-2024", "5-Jan-202", "5-January-2024", "5-Jan 2024", "5 Jan 24", "2024-1-5", "5-Jan-202020-01-05", "5-Jan-20245 Jan 2024", "05-Jan-2024\n"])
    numbers = {"$ 1,234.50": "1234.50", "--5": "-5.00", "-$-5": "-5.00", " - - 5": "-5.00", "\t7\n": "7.00", "-$5": "-5.00", "1e3": "1000.00", "+2": "2.00", "\u0665": "5.00", ".5": "0.50"}
    numbers |= dict.fromkeys(["", " ", "-", "--", ".", "---5", "5--", "n/a", "x5", "1e30", "e"])
    codes = {"vas.ax": "VAS", "A.AX.AX": "A", "A.ax.nz": "A", "B.ASX\n": "B", "C.AX-1": "CAX1", ".AX": None, "": None, " d-e.xasx ": "DE"}
    for cells, parsed in ((dates, text.parse_date(F.col("c"))), (numbers, text.parse_decimal(F.col("c"), "decimal(18,2)")), (codes, text.normalise_code(F.col("c")))):
        rows = spark.createDataFrame([(c,) for c in cells] + [(None,)], "c string")
        assert {r.c: r.p for r in rows.select("c", parsed.cast("string").alias("p")).collect()} == cells | {None: None}
