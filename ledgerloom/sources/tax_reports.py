"""Rows of annual tax reports: years, dividends, trust distributions and totals, out of (document_id, page, line_no, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import financial_year, make_id, normalise_code, parse_date, parse_decimal
from ledgerloom.sources.statements import DATE_LONG, NUMBER, _in_order, _of, _part, tag_sections

#: Where the two tables begin and end, and how amounts, rows and the period are written.
SECTIONS = {
    "dividends": ("Australian dividend income and tax information", ["Total Australian dividend income"]),
    "distributions": ("Australian trust distribution income and tax information", ["Total Australian trust distributions"]),
}
MONEY = r"\$?-?[\d,]+\.\d{2}"
_DIVIDEND = rf"^({DATE_LONG})\s+({DATE_LONG})\s+([A-Z]{{2,5}})\s+(.+?)\s+({MONEY})\s+({MONEY})\s+({MONEY})\s+({MONEY})\s*$"
_DISTRIBUTION = rf"^([A-Z]{{2,5}})\s+(.*?)\s*({MONEY})\s+({MONEY})\s+({MONEY})\s+({MONEY})\s+({MONEY})\s*$"
_PERIOD = r"(\d{1,2} \w+ \d{4})\s+to\s+(\d{1,2} \w+ \d{4})"
#: Totals and the words before them.
TOTALS = {
    "gross_income": "Total gross income",
    "net_income_received": "Total net income received",
    "dividend_franking_credits": "Australian dividend franking credits",
    "trust_franking_credits": "Trust franking credits",
    "foreign_income_tax_offsets": "Trust foreign income tax offsets",
    "total_tax_offsets": "Total tax offsets",
    "withholding_tax": "Total withholding tax",
    "total_fees": "Total fees",
    "gross_capital_gains": "Total current year capital gains",
    "net_capital_gain": r"Net capital gain\d?",
    "discounted_capital_gains": "Discounted capital gains",
    "cgt_concession": "CGT concession",
    "capital_losses_carried_forward": "Net capital losses carried forward",
}


def _first(pattern: str, k: int):
    """What the first line that has ``pattern``, alone or running on into the next, holds in group k."""
    return F.min_by(_part(pattern, k, "__two"), F.when(F.col("__two").rlike(pattern), F.struct("page", "line_no")))


def tax_summaries(lines: DataFrame, totals: dict[str, str] = TOTALS) -> DataFrame:
    """One row for each report: (document_id, tax_summary_id, financial_year, period_start, period_end) and its totals, null where it has none.

    A total is the first number that stands right after its words, on their line or alone on the next. The year is the
    one in which the period ends; a report without a period has a null year (see :func:`report_issues`).
    """
    own = lines.withColumn("__two", F.concat_ws("\n", "text", F.lead("text").over(_in_order())))
    found = {name: parse_decimal(_first(rf"{words}\s+({NUMBER})", 1)).alias(name) for name, words in totals.items()}
    got = own.groupBy("document_id").agg(parse_date(_first(_PERIOD, 1)).alias("period_start"), parse_date(_first(_PERIOD, 2)).alias("period_end"), *found.values())
    got = got.withColumn("financial_year", financial_year(F.col("period_end")))
    return got.select("document_id", F.when(F.col("financial_year").isNotNull(), make_id("TAX", F.col("document_id"), F.col("financial_year"))).alias("tax_summary_id"), "financial_year", "period_start", "period_end", *found)


def report_issues(summaries: DataFrame) -> DataFrame:
    """A warning for each report without a period: nothing of it counts."""
    return summaries.where("financial_year IS NULL").select("document_id", F.lit("TAX_REPORT_NO_PERIOD").alias("code"), F.lit("WARNING").alias("severity"))


def _rows(lines: DataFrame, section: str, pattern: str) -> DataFrame:
    """Rows of a table, with their report's financial year; those of reports without a period are left out."""
    years = tax_summaries(lines, {}).where("financial_year IS NOT NULL").select("document_id", "financial_year")
    return _of(tag_sections(lines, SECTIONS), section).where(F.col("text").rlike(pattern)).join(years, "document_id")


def extract_dividends(lines: DataFrame) -> DataFrame:
    """Dividends by payment, the only place that has ex dates: (document_id, page, line_no, financial_year, code, ex_date, payment_date, unfranked_amount, franked_amount, franking_credit, total_income)."""
    n = lambda k: parse_decimal(_part(_DIVIDEND, k), "decimal(18,2)")
    return _rows(lines, "dividends", _DIVIDEND).select(
        "document_id", "page", "line_no", "financial_year", normalise_code(_part(_DIVIDEND, 3)).alias("code"), parse_date(_part(_DIVIDEND, 1)).alias("ex_date"), parse_date(_part(_DIVIDEND, 2)).alias("payment_date"),
        n(5).alias("unfranked_amount"), n(6).alias("franked_amount"), n(7).alias("franking_credit"), n(8).alias("total_income"),
    )


def extract_distributions(lines: DataFrame) -> DataFrame:
    """Trust distributions, a year's total of a security without dates: (document_id, page, financial_year, security_tax_id, security_id, code, franked_amount, unfranked_amount, franking_credit, interest_income, other_deductions).

    A security that a report lists twice counts with its last row.
    """
    n = lambda k: parse_decimal(_part(_DISTRIBUTION, k), "decimal(18,2)")
    code = normalise_code(_part(_DISTRIBUTION, 1))
    own = _rows(lines, "distributions", _DISTRIBUTION).withColumn("code", code).withColumn("__last", F.row_number().over(W.partitionBy("document_id", "code").orderBy(F.desc("page"), F.desc("line_no")))).where("__last = 1")
    return own.select(
        "document_id", "page", "financial_year", make_id("STX", F.col("document_id"), F.col("financial_year"), F.col("code")).alias("security_tax_id"), make_id("SEC", F.col("code")).alias("security_id"), "code",
        n(3).alias("franked_amount"), n(4).alias("unfranked_amount"), n(5).alias("franking_credit"), n(6).alias("interest_income"), n(7).alias("other_deductions"),
    )
