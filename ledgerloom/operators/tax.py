"""Tax detail: dividends of reports matched to recorded incomes, securities that reports name, figures by year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import make_id

#: Figures of a year that tax_analytics reports, by their names in summaries.
FIGURES = {"withholding_tax": "tax_withheld", "dividend_franking_credits": None, "trust_franking_credits": None, "total_tax_offsets": None, "net_capital_gain": None, "discounted_capital_gains": None, "capital_losses_carried_forward": None}


def match_details(income: DataFrame, details: DataFrame, days: int = 7) -> DataFrame:
    """``details`` (account_id, detail_id, code, payment_date, franked_amount, unfranked_amount, ...) with ``income_id`` and ``outcome``.

    A candidate among ``income`` (account_id, income_id, code, payment_date, amount) has the code, the franked and
    unfranked amount together within half a cent, and a day within ``days``. One candidate is MATCHED; more are AMBIGUOUS,
    none is NO_MATCH, also for a null code; a null day is NO_PAYMENT_DATE, null amounts count as 0. Equal incomes of one day are counted before the join, and equal details
    ask once, so a code paid all the time makes at most a few rows a day, not all pairs.
    """
    span = lambda d, shift: F.floor((F.unix_date(d) + shift) / (2 * days + 1))  # noqa: E731  a window of days meets two spans at most
    cents = lambda c: F.floor(F.col(c) * 100).cast("long")
    key = ["account_id", "code", "payment_date", "cash"]
    asked = details.withColumn("cash", F.coalesce("franked_amount", F.lit(0)) + F.coalesce("unfranked_amount", F.lit(0)))
    ask = asked.where("payment_date IS NOT NULL").select(*key).distinct()
    ask = ask.withColumn("c", F.explode(F.sequence(cents("cash") - 1, cents("cash") + 1))).withColumn("span", F.explode(F.array_distinct(F.array(span("payment_date", -days), span("payment_date", days)))))
    paid = income.groupBy("account_id", "code", F.col("payment_date").alias("paid"), "amount").agg(F.count("*").alias("n"), F.min("income_id").alias("income_id"))
    paid = paid.withColumn("c", cents("amount")).withColumn("span", span("paid", 0))
    met = ask.join(paid, ["account_id", "code", "c", "span"]).where((F.abs(F.datediff("paid", "payment_date")) <= days) & (F.abs(F.col("amount") - F.col("cash")) <= F.lit("0.005").cast("decimal(4,3)")))
    found = met.groupBy(*key).agg(F.sum("n").alias("__n"), F.min("income_id").alias("income_id"))
    outcome = F.when(F.col("payment_date").isNull(), "NO_PAYMENT_DATE").when(F.col("__n").isNull(), "NO_MATCH").when(F.col("__n") > 1, "AMBIGUOUS").otherwise("MATCHED")
    got = asked.join(found, key, "left").withColumn("outcome", outcome)
    return got.withColumn("income_id", F.when(F.col("outcome") == "MATCHED", F.col("income_id"))).drop("cash", "__n")


def enrich_income(income: DataFrame, matched: DataFrame) -> DataFrame:
    """``income`` with franking_credit and ex_date of its detail in ``matched`` (the last one by detail_id); others keep what they have, or null."""
    new = matched.where("outcome = 'MATCHED'").groupBy("income_id").agg(F.max_by(F.struct("franking_credit", "ex_date"), "detail_id").alias("__detail"))
    own = income.join(new, "income_id", "left")
    for c in ("franking_credit", "ex_date"):
        own = own.withColumn(c, F.when(F.col("__detail").isNotNull(), F.col(f"__detail.{c}")).otherwise(F.col(c) if c in income.columns else None))
    return own.drop("__detail")


def ensure_securities(securities: DataFrame, distributions: DataFrame) -> DataFrame:
    """``securities`` (security_id, code, name, type, currency) and those that only tax reports name, as funds under their code."""
    code = F.col("code")
    new = distributions.select(code).where("code IS NOT NULL").distinct().join(securities.select("code"), "code", "left_anti")
    return securities.unionByName(new.select(make_id("SEC", code).alias("security_id"), "code", code.alias("name"), F.lit("ETF").alias("type"), F.lit("AUD").alias("currency")), allowMissingColumns=True)


def tax_analytics(summaries: DataFrame) -> DataFrame:
    """By (account_id, financial_year) the reported figures, nothing calculated; of several reports of a year the one that ends last, then the last document."""
    last = W.partitionBy("account_id", "financial_year").orderBy(F.desc("period_end"), F.desc("document_id"))
    own = summaries.where("financial_year IS NOT NULL").withColumn("__k", F.row_number().over(last)).where("__k = 1")
    return own.select("account_id", "financial_year", *[F.col(c).alias(name or c) for c, name in FIGURES.items()])
