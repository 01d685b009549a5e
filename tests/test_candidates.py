"""Candidates of two exports: matching against a walk, stable ids, fees, cash classes, securities."""

import random
from datetime import date
from decimal import Decimal as D

from ledgerloom.operators import candidates

TRADES = "account_id int, row_id int, side string, product_id string, security_name string, trade_date date, canonical_units decimal(18,2), gross_value decimal(18,2), unit_price decimal(18,2), canonical_brokerage decimal(18,2)"
CASH = "account_id int, row_id int, cash_class string, product_id string, product_name string, date date, signed_total decimal(18,2), units decimal(18,2)"


def _rows(seed, n):
    r = random.Random(seed)
    day = lambda: date(2020, 1, 1 + r.randrange(25))
    money = lambda: D(r.choice([1000, 1001, 1002, 5000])) / 100
    trades = [(r.randrange(6), i, r.choice(["BUY", "SELL"]), r.choice(["A", "B", None]), r.choice(["One", " one ", "Two", None]), r.choice([day(), day(), day(), None]), D(r.randrange(1, 3)), r.choice([money(), money(), money(), None]), D(1), D(r.choice([0, 9]))) for i in range(n)]
    cash = [(r.randrange(6), 10_000 + i, r.choice(["TRADE_BUY_CASH", "TRADE_SELL_CASH", "DEPOSIT"]), r.choice(["A", "B", None]), r.choice(["one", "TWO", None]), r.choice([day(), day(), day(), None]), r.choice([-1, 1]) * money(), r.choice([None, D(1), D(-2)])) for i in range(n)]
    return trades + [(t[0], t[1] + 5_000, *t[2:]) for t in trades[:10]], cash


def _walk(trades, cash):
    name = lambda s: (s or "").strip().lower()
    def fits(t, c):
        if t[0] != c[0] or c[2] != candidates.LEG[t[2]] or t[5] is None or c[5] is None or t[7] is None:
            return False
        same = t[3] == c[3] if t[3] and c[3] else name(t[4]) == name(c[4])
        return same and abs(abs(c[6]) - t[7]) <= D("0.01") and abs((c[5] - t[5]).days) <= 5

    legs = {t[1]: [c for c in cash if fits(t, c)] for t in trades}
    claims = {c[1]: sum(c in own for own in legs.values()) for c in cash}
    out = {}
    for t in trades:
        own = legs[t[1]]
        if len(own) != 1 or claims[own[0][1]] > 1:
            out[t[1]] = ("AMBIGUOUS" if own else "UNMATCHED_INVESTMENT", None, len(own))
            continue
        c = own[0]
        odd = c[7] is not None and abs(c[7]) != t[6]
        out[t[1]] = ("QUANTITY_MISMATCH" if odd else "MATCH" if abs(c[6]) == t[7] and c[5] == t[5] else "MATCH_WITH_MINOR_DIFFERENCE", c[1], 1)
    return out, {c[1] for c in cash if c[2] != "DEPOSIT" and not claims[c[1]]}


def test_matching_against_a_walk_and_ids_of_shuffled_rows(spark):
    seen = set()
    for seed in (1, 2):
        trades, cash = _rows(seed, 90)
        out, lost = _walk(trades, cash)
        ids = []
        for order in (1, 2):
            random.Random(order).shuffle(trades)
            random.Random(order).shuffle(cash)
            got = candidates.match_exports(spark.createDataFrame(trades, TRADES).repartition(3), spark.createDataFrame(cash, CASH).repartition(order)).collect()
            assert {r.trade_row: (r.status, r.cash_row, r.candidates) for r in got if r.trade_row is not None} == out
            assert {r.cash_row for r in got if r.trade_row is None} == lost and len(got) == len(out) + len(lost)
            ids.append({(r.trade_row, r.cash_row): r.match_id for r in got})
        own = [i for (t, _), i in ids[0].items() if t is not None]
        assert ids[0] == ids[1] and len(set(own)) == len(own)
        seen |= {s for s, _, _ in out.values()}
    assert seen == {"MATCH", "MATCH_WITH_MINOR_DIFFERENCE", "QUANTITY_MISMATCH", "AMBIGUOUS", "UNMATCHED_INVESTMENT"}


def test_a_crowd_of_equal_rows_makes_no_pairs(spark):
    from pyspark.sql import functions as F

    n, on = spark.range(30_000), F.lit(date(2020, 1, 1))
    t = n.select(F.lit(1).alias("account_id"), F.col("id").alias("row_id"), F.lit("BUY").alias("side"), F.lit("A").alias("product_id"), F.lit("a").alias("security_name"), on.alias("trade_date"), F.lit(D(1)).alias("canonical_units"), F.lit(D(9)).alias("gross_value"))
    c = n.select(F.lit(1).alias("account_id"), F.col("id").alias("row_id"), F.lit("TRADE_BUY_CASH").alias("cash_class"), F.lit("A").alias("product_id"), F.lit("a").alias("product_name"), on.alias("date"), F.lit(D(-9)).alias("signed_total"), F.lit(D(1)).alias("units"))
    assert [tuple(r) for r in candidates.match_exports(t, c).groupBy("status", "candidates").count().collect()] == [("AMBIGUOUS", 30_000, 30_000)]


def test_trades_and_fees(spark):
    day = lambda d: date(2020, 1, d)
    trades = spark.createDataFrame([(1, 1, "BUY", "A", "Alpha", day(1), D(10), D(100), D(10), D(9)), (1, 2, "SELL", "A", "Alpha", day(8), D(10), D(120), D(12), D(9)), (1, 3, "BUY", "B", "Beta", day(9), D(1), D(50), D(50), D(0)), (1, 4, "BUY", "B", "Beta", day(9), D(1), D(70), D(70), D(5))], TRADES)
    cash = spark.createDataFrame([(1, 11, "TRADE_BUY_CASH", "A", "", day(2), D(-100), None), (1, 12, "TRADE_SELL_CASH", "A", "", day(8), D(120), D(-10)), (1, 13, "TRADE_BUY_CASH", None, "beta", day(9), D(-50), D(1)), (1, 14, "TRADE_BROKERAGE_CASH", None, "Transaction fee for Alpha Buy", day(3), D(-9), None), (1, 15, "TRADE_BROKERAGE_CASH", None, "Transaction fee for Alpha Sell", day(20), D(-9), None)], CASH)
    one, two = candidates.trade_candidates(candidates.match_exports(trades, cash), trades, cash)
    got = {r.trade_row: (r.cash_row, r.net_amount, r.cash_effect, r.brokerage_fee_id is not None) for r in one.collect()}
    assert got == {1: (11, D(109), D(-100), True), 2: (12, D(-111), D(120), True), 3: (13, D(50), D(-50), False)}
    fees = {r.row_id: (r.effective_date, r.signed_amount) for r in two.collect()}
    assert fees == {14: (day(3), D(-9)), None: (day(8), D(-9))}
    assert {r.brokerage_fee_id for r in one.collect() if r.brokerage_fee_id} == {r.canonical_id for r in two.collect()}
    known = spark.createDataFrame([], "security_id string, product_id string, name string, priority int, type string")
    (rest,) = candidates.cash_candidates(cash, known, two).collect()
    assert (rest.row_id, rest.type, rest.classification_status, rest.source_semantic) == (15, "FEE", "NEEDS_RECONCILIATION", "UNMATCHED_TRADE_BROKERAGE")
    counts = {(r.meaning, r.n, r.unresolved) for r in candidates.candidate_counts(one, candidates.cash_candidates(cash, known, two)).collect()}
    assert counts == {("BUY", 2, 0), ("SELL", 1, 0), ("UNMATCHED_TRADE_BROKERAGE", 1, 1)}


def test_equal_cash_rows_have_ids_of_their_own_in_any_order(spark):
    rows = [(1, i, "INTEREST", None, "Interest 12", date(2020, 1, 1), D(1), None) for i in range(4)] + [(2, 9, "DISTRIBUTION_INCOME", "A", "", date(2020, 1, 1), D(1), None), (2, 10, "DISTRIBUTION_INCOME", None, "none", date(2020, 1, 1), D(1), None)]
    known = spark.createDataFrame([("S", "A", "a", 1, "SHARE")], "security_id string, product_id string, name string, priority int, type string")
    a, b = (candidates.cash_candidates(spark.createDataFrame(r, CASH), known).collect() for r in (rows, rows[::-1]))
    assert {r.row_id: r.canonical_id for r in a} == {r.row_id: r.canonical_id for r in b} and len({r.canonical_id for r in a}) == 6
    assert {r.row_id: (r.type, r.security_id, r.classification_status) for r in a if r.account_id == 2} == {9: ("DIVIDEND", "S", "CLASSIFIED"), 10: ("DISTRIBUTION", None, "UNRESOLVED_SECURITY")}


def test_securities_take_the_first_heading_that_corrects_a_share(spark):
    rows = [("d", 1, "abc.AX", "Some name", None), ("d", 2, "ABC", "Some fund", None), ("d", 3, "ABC", "Later", "etf"), ("d", 4, "ABC", "Last", "managed_fund"), ("d", 1, "XYZ", "A fund", None), ("d", 2, "XYZ", "x", "etf"), ("d", 1, "...", "none", "etf"), ("d", 1, None, None, None), ("e", 1, "ABC", None, "australian_share")]
    got = candidates.build_securities(spark.createDataFrame(rows, "document_id string, at int, code string, name string, asset_class string")).collect()
    assert {(r.document_id, r.code, r.name, r.type) for r in got} == {("d", "ABC", "Some name", "ETF"), ("d", "XYZ", "A fund", "MANAGED_FUND"), ("e", "ABC", None, "SHARE")}
