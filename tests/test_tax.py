"""Tax reports: tables, totals, years, and dividends matched to incomes."""

from datetime import date
from decimal import Decimal as D

import pytest

from ledgerloom.operators import tax
from ledgerloom.sources import tax_reports

TEXT = """Annual Tax Report
1 July 2019 to 30 June 2020
Total gross income 1,234.50 13Q
Net capital gain1 $77.10
Total fees
12.00
Total fees 99.00
3-Jan-2020 4-Jan-2020 ABC Before the table 1.00 2.00 3.00 4.00
Australian dividend income and tax information
Ex date Payment date
3-Jan-2020 14-Feb-2020 XYZ Some Holding 3 Ltd $10.00 -20.50 8.79 30.50
3-Jan-2020 14-Feb-2020 xyz no code 10.00 20.50 8.79 30.50
3-Jan-2020 14-Feb-2020 XYZ three amounts 20.50 8.79 30.50
Total Australian dividend income 30.50
4-Jan-2020 5-Jan-2020 ABC After it 1.00 2.00 3.00 4.00
Australian trust distribution income and tax information
VAS Some Fund 1.00 2.00 3.00 4.00 5.00
VGS 1,000.00 2.00 3.00 4.00 5.00
VAS Some Fund again 9.00 2.00 3.00 4.00 5.00
Total Australian trust distributions 1.00 2.00 3.00 4.00 5.00""".split("\n")


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(d, 1 + i // 8, i % 8, t) for d, own in (("a", TEXT), ("b", [t for t in TEXT if " to " not in t]), ("c", ["nothing"])) for i, t in enumerate(own)]
    return spark.createDataFrame(rows, "document_id string, page int, line_no int, text string").repartition(3)


def test_totals_and_years(lines):
    got = {r.document_id: r for r in tax_reports.tax_summaries(lines).collect()}
    a = got["a"]
    assert (a.financial_year, a.period_start, a.period_end) == (2020, date(2019, 7, 1), date(2020, 6, 30))
    assert (a.gross_income, a.net_capital_gain, a.total_fees, a.withholding_tax) == (D("1234.5"), D("77.1"), D("12"), None)
    assert got["b"].gross_income == D("1234.5") and got["b"].financial_year is None and got["b"].tax_summary_id is None
    assert sorted(r.document_id for r in tax_reports.report_issues(tax_reports.tax_summaries(lines)).collect()) == ["b", "c"]


def test_rows_of_the_tables(lines):
    (got,) = tax_reports.extract_dividends(lines).collect()
    assert (got.document_id, got.financial_year, got.code, got.ex_date, got.payment_date) == ("a", 2020, "XYZ", date(2020, 1, 3), date(2020, 2, 14))
    assert [got.unfranked_amount, got.franked_amount, got.franking_credit, got.total_income] == [D("10"), D("-20.5"), D("8.79"), D("30.5")]
    trusts = {r.code: (r.document_id, r.franked_amount, r.other_deductions) for r in tax_reports.extract_distributions(lines).collect()}
    assert trusts == {"VAS": ("a", D("9"), D("5")), "VGS": ("a", D("1000"), D("5"))}


def _walk(income, details, days=7):
    """Brute force: outcome and income of each detail, then what each income ends up with."""
    out, gets = {}, {}
    for account, id_, code, day, ex, franked, unfranked, credit in sorted(details, key=lambda d: d[1]):
        cash = (franked or 0) + (unfranked or 0)
        hits = [i for a, i, c, p, amount in income if day and p and code and amount is not None and (a, c) == (account, code) and abs(amount - cash) <= D("0.005") and abs((p - day).days) <= days]
        out[id_] = ("NO_PAYMENT_DATE" if day is None else "NO_MATCH" if not hits else "AMBIGUOUS" if len(hits) > 1 else "MATCHED", hits[0] if day and len(hits) == 1 else None)
        if out[id_][1] is not None:
            gets[hits[0]] = (credit, ex)
    return out, gets


def test_details_against_a_walk(spark):
    import random

    r = random.Random(7)
    day = lambda: date(2020, 1, 1 + r.randrange(28))
    income = [(r.randrange(2), i, r.choice(["A", "B", None]), r.choice([day(), day(), None]), r.choice([None, D("-1.00"), D("1.00"), D("1.01"), D("10.50"), D(r.randrange(300)) / 100])) for i in range(150)]
    details = [(r.randrange(2), i, r.choice(["A", "B", None]), r.choice([day(), day(), day(), None]), day(), r.choice([None, D("-1.00"), D("1.00"), D("1.005"), D("10.50"), D(r.randrange(300)) / 100]), r.choice([None, D("0")]), D(i)) for i in range(200)]
    details += [(*d[:1], d[1] + 1000, *d[2:]) for d in details[:40]]  # said twice
    left = spark.createDataFrame(income, "account_id int, income_id int, code string, payment_date date, amount decimal(18,2)").repartition(4)
    right = spark.createDataFrame(details, "account_id int, detail_id int, code string, payment_date date, ex_date date, franked_amount decimal(18,3), unfranked_amount decimal(18,3), franking_credit decimal(18,2)").repartition(4)
    out, gets = _walk(income, details)
    matched = tax.match_details(left, right)
    assert {x.detail_id: (x.outcome, x.income_id) for x in matched.collect()} == out and len({v[0] for v in out.values()}) == 4
    rows = tax.enrich_income(left, matched).collect()
    assert len(rows) == 150 and {x.income_id: (x.franking_credit, x.ex_date) for x in rows if x.ex_date} == gets


def test_one_code_paid_all_the_time(spark):
    """40,000 equal incomes and as many equal details of one code: settled without their pairs."""
    from pyspark.sql import functions as F

    n = spark.range(40_000).select(F.lit(1).alias("account_id"), F.col("id").alias("income_id"), F.lit("A").alias("code"), F.lit(date(2020, 1, 1)).alias("payment_date"), F.lit(D("1.00")).alias("amount"))
    d = n.select("account_id", F.col("income_id").alias("detail_id"), "code", "payment_date", F.col("amount").alias("franked_amount"), F.lit(None).cast("decimal(18,2)").alias("unfranked_amount"))
    assert tax.match_details(n, d).groupBy("outcome").count().collect() == [("AMBIGUOUS", 40_000)]


def test_securities_and_years(spark):
    s = spark.createDataFrame([("1", "VAS", "Own name", "ETF", "AUD")], "security_id string, code string, name string, type string, currency string")
    t = spark.createDataFrame([("VAS",), ("NEW",), ("NEW",), (None,)], "code string")
    assert sorted((r.code, r.name, r.type) for r in tax.ensure_securities(s, t).collect()) == [("NEW", "NEW", "ETF"), ("VAS", "Own name", "ETF")]
    y = spark.createDataFrame([("a", "d1", 2020, date(2020, 6, 29), 1), ("a", "d2", 2020, date(2020, 6, 30), 2), ("a", "d3", None, None, 3)], "account_id string, document_id string, financial_year int, period_end date, withholding_tax int")
    from pyspark.sql import functions as F

    y = y.withColumns({c: F.lit(None).cast("int") for c in tax.FIGURES if c not in y.columns})
    assert [(r.financial_year, r.tax_withheld) for r in tax.tax_analytics(y).collect()] == [(2020, 2)]
