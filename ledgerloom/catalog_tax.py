"""Registered queries of tax reports: the given tables are written as report lines and read back; SQL reads the tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.catalog import _d, query
from ledgerloom.catalog_statements import _LETTERS
from ledgerloom.operators import tax
from ledgerloom.sources import tax_reports
from ledgerloom.sources import testdata as td

# dividends of half dollars under two codes, so that some fall together; reports lack some, and write days up to eight too late
_CODE = "CASE WHEN event_id % 3 = 0 THEN 'ABC' ELSE 'XYZ' END"
_HALVES = "(floor(amount / 20) * 10 + 0.5)::DECIMAL(18,2)"
_DIVIDENDS = f""", inc AS (SELECT account_id, event_id AS income_id, {_CODE} AS code, trade_date AS payment_date, {_HALVES} AS amount FROM ca WHERE type = 'DIVIDEND'),
    det AS (SELECT account_id, income_id, code, payment_date + (income_id % 9)::INTEGER AS paid, payment_date - 10 AS ex, round(amount * 0.6, 2)::DECIMAL(18,2) AS franked, (amount - round(amount * 0.6, 2))::DECIMAL(18,2) AS unfranked, round(amount * 0.25, 2)::DECIMAL(18,2) AS credit, 2024 AS y FROM inc WHERE income_id % 5 <> 0)"""


def _incomes(spark, sf):
    ca = td.cash_events(spark, sf).where("type = 'DIVIDEND'")
    return ca.select("account_id", F.col("event_id").alias("income_id"), F.expr(_CODE).alias("code"), F.col("trade_date").alias("payment_date"), (F.floor(F.col("amount") / 20) * 10 + F.lit("0.5").cast("decimal(2,1)")).cast("decimal(18,2)").alias("amount"))


def _money(c):
    return F.format_number(c, 2)


def _report(rows, heads: dict[int, str]):
    """``rows`` (document_id, k, text) and lines at fixed places k in each document, numbered."""
    fixed = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(text).alias("text")) for k, text in heads.items()]))
    every = rows.select("document_id").distinct().select("document_id", fixed.alias("x")).select("document_id", "x.k", "x.text")
    line = F.row_number().over(W.partitionBy("document_id").orderBy("k", "text"))
    return rows.select("document_id", "k", "text").unionByName(every).select("document_id", F.lit(1).alias("page"), line.alias("line_no"), "text")


_END = 2**40


def _dividend_lines(spark, sf):
    inc = _incomes(spark, sf).where("income_id % 5 <> 0")
    franked = F.round(F.col("amount") * F.lit("0.6").cast("decimal(2,1)"), 2)
    day = lambda d: F.date_format(d, "d-MMM-yyyy")
    text = F.concat_ws(" ", day(F.date_sub("payment_date", 10)), day(F.date_add("payment_date", (F.col("income_id") % 9).cast("int"))), "code", F.lit("Some Holding Ltd"), _money(F.col("amount") - franked), _money(franked), _money(F.round(F.col("amount") * F.lit("0.25").cast("decimal(3,2)"), 2)), _money("amount"))
    rows = inc.select(F.col("account_id").alias("document_id"), F.col("income_id").cast("long").alias("k"), text.alias("text"))
    return _report(rows, {-3: "Annual Tax Report for 1 July 2023 to 30 June 2024", -2: "1-Jul-2023 2-Jul-2023 ABC Too early 1.00 1.00 1.00 2.00", -1: "Australian dividend income and tax information", _END: "Total Australian dividend income 1.00", _END + 1: "1-Jul-2023 2-Jul-2023 ABC Too late 1.00 1.00 1.00 2.00"})


@query(f"{_DIVIDENDS} SELECT account_id AS document_id, y AS financial_year, code, ex AS ex_date, paid AS payment_date, unfranked::DOUBLE AS unfranked_amount, franked::DOUBLE AS franked_amount, credit::DOUBLE AS franking_credit, (franked + unfranked)::DOUBLE AS total_income FROM det")
def tax_dividends(spark, sf):
    """Dividends as rows of tax reports, with like rows outside the table."""
    return _d(tax_reports.extract_dividends(_dividend_lines(spark, sf)).drop("page", "line_no"))


_MATCHED = f"""{_DIVIDENDS}, mt AS (SELECT det.account_id, det.income_id AS detail_id, det.code, paid, ex, credit, count(inc.income_id) AS n, CASE WHEN count(inc.income_id) = 1 THEN min(inc.income_id) END AS income_id
    FROM det LEFT JOIN inc ON inc.account_id = det.account_id AND inc.code = det.code AND inc.amount = franked + unfranked AND abs(inc.payment_date - paid) <= 7 GROUP BY ALL)"""


def _matched(spark, sf):
    got = tax_reports.extract_dividends(_dividend_lines(spark, sf))
    return tax.match_details(_incomes(spark, sf), got.withColumnsRenamed({"document_id": "account_id", "line_no": "detail_id"}))


@query(f"{_MATCHED} SELECT account_id, code, paid AS payment_date, ex AS ex_date, income_id, CASE WHEN n = 0 THEN 'NO_MATCH' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS outcome FROM mt")
def tax_detail_outcomes(spark, sf):
    """Dividends of reports against recorded incomes: unique ones, several that fit, none."""
    return _matched(spark, sf).select("account_id", "code", "payment_date", "ex_date", "income_id", "outcome")


@query(f"{_MATCHED}, la AS (SELECT income_id, arg_max(credit, detail_id) AS credit, arg_max(ex, detail_id) AS ex FROM mt WHERE n = 1 GROUP BY ALL) SELECT inc.account_id, inc.income_id, code, payment_date, amount::DOUBLE AS amount, credit::DOUBLE AS franking_credit, ex AS ex_date FROM inc LEFT JOIN la ON la.income_id = inc.income_id")
def enriched_income(spark, sf):
    """Recorded incomes with franking credits and ex dates of their dividends."""
    return _d(tax.enrich_income(_incomes(spark, sf), _matched(spark, sf)))


@query(f"SELECT account_id AS document_id, 2024 AS financial_year, code, left(sha256('SEC|' || code), 16) AS security_id, sum(gross)::DOUBLE AS franked_amount, -sum(fees)::DOUBLE + 0.0 AS unfranked_amount, max(gross)::DOUBLE AS franking_credit, sum(units)::DOUBLE AS interest_income, min(fees)::DOUBLE AS other_deductions FROM (SELECT *, {_LETTERS} AS code FROM tr) GROUP BY ALL")
def tax_distributions(spark, sf):
    """What accounts traded in a security, as a year's distributions."""
    own = td.trades(spark, sf).withColumn("code", F.expr(_LETTERS)).groupBy("account_id", "code").agg(F.sum("gross").alias("a"), F.sum("fees").alias("b"), F.max("gross").alias("c"), F.sum("units").alias("d"), F.min("fees").alias("e"))
    text = F.concat_ws(" ", "code", F.lit("Some Fund"), _money("a"), _money(-F.col("b")), F.concat(F.lit("$"), _money("c")), _money("d"), _money("e"))
    rows = own.select(F.col("account_id").alias("document_id"), F.lit(0).cast("long").alias("k"), text.alias("text"))
    lines = _report(rows, {-3: "Annual Tax Report for 1 July 2023 to 30 June 2024", -1: "Australian trust distribution income and tax information", _END: "Total Australian trust distributions 1.00", _END + 1: "ABC Too late 1.00 1.00 1.00 1.00 2.00"})
    return _d(tax_reports.extract_distributions(lines).drop("page", "security_tax_id"))


# reports of some accounts have no period, others lack losses, and all write one total on the next line
_OF_TYPE = {"gross_income": "type = 'DIVIDEND'", "dividend_franking_credits": "type = 'INTEREST'", "trust_franking_credits": "type = 'DISTRIBUTION'", "total_tax_offsets": "type = 'DEPOSIT'", "withholding_tax": "type = 'FEE'", "net_capital_gain": "type = 'WITHDRAWAL'", "capital_losses_carried_forward": "TRUE"}
_YEARS = f""", sy AS (SELECT account_id, CASE WHEN account_id % 2 = 0 THEN 2024 ELSE 2023 END AS financial_year, {", ".join(f"sum(CASE WHEN {w} THEN amount ELSE 0 END) AS {c}" for c, w in _OF_TYPE.items())} FROM ca GROUP BY ALL)"""


def _summaries(spark, sf):
    ca = td.cash_events(spark, sf)
    sums = ca.groupBy("account_id").agg(*[F.sum(F.when(F.expr(w), F.col("amount")).otherwise(0)).cast("decimal(18,2)").alias(c) for c, w in _OF_TYPE.items()])
    said = lambda c: F.concat(F.lit(tax_reports.TOTALS[c].removesuffix(r"\d?") + ("1" if c == "net_capital_gain" else "")), F.lit("\n" if c == "total_tax_offsets" else " "), _money(c))
    period = F.when(F.col("account_id") % 7 != 0, F.when(F.col("account_id") % 2 == 0, "1 July 2023 to 30 June 2024").otherwise("1 January 2023 to 30 June 2023"))
    texts = [period, F.lit("Notes to the totals")] + [F.when(F.col("account_id") % 3 != 0, said(c)) if c == "capital_losses_carried_forward" else said(c) for c in _OF_TYPE]
    lines = sums.select(F.col("account_id").alias("document_id"), F.posexplode(F.split(F.concat_ws("\n", *texts), "\n")).alias("line_no", "text")).withColumn("page", F.lit(1))
    return tax_reports.tax_summaries(lines)


@query(f"{_YEARS} SELECT account_id, financial_year, withholding_tax::DOUBLE AS tax_withheld, dividend_franking_credits::DOUBLE AS dividend_franking_credits, trust_franking_credits::DOUBLE AS trust_franking_credits, total_tax_offsets::DOUBLE AS total_tax_offsets, net_capital_gain::DOUBLE AS net_capital_gain, NULL::DOUBLE AS discounted_capital_gains, CASE WHEN account_id % 3 <> 0 THEN capital_losses_carried_forward::DOUBLE END AS capital_losses_carried_forward FROM sy WHERE account_id % 7 <> 0")
def tax_analytics(spark, sf):
    """Reported totals by account and year."""
    return _d(tax.tax_analytics(_summaries(spark, sf).withColumn("account_id", F.col("document_id"))))


@query("SELECT DISTINCT account_id AS document_id, 'TAX_REPORT_NO_PERIOD' AS code, 'WARNING' AS severity FROM ca WHERE account_id % 7 = 0")
def tax_report_issues(spark, sf):
    return tax_reports.report_issues(_summaries(spark, sf))
