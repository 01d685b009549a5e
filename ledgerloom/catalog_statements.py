"""Registered queries of statement extraction: the given tables are written as statement lines and read back; SQL reads the tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.catalog import _DAILY, _d, query
from ledgerloom.operators import ledger
from ledgerloom.sources import statements
from ledgerloom.sources import testdata as td

_LETTERS = "'BR' || translate(substr(security_id, 7), '0123456789', 'ABCDEFGHIJ')"


def _lines(rows, kind: str):
    """Lines (document_id, k, text, part) between their section's heads; k orders them."""
    head = {"trades": "Your investment transaction details", "cash": "Your cash account transaction details", "holdings": "Your portfolio valuation as at 30 June 2000"}[kind]
    ends = rows.select("document_id").distinct().select("document_id", F.explode(F.array(F.struct(F.lit("Quarterly Statement for the period 1-Jan-2000 to 30-Jun-2000").alias("text"), F.lit(-3).alias("k")), F.struct(F.lit("Account number: 1").alias("text"), F.lit(-2).alias("k")), F.struct(F.lit(head).alias("text"), F.lit(-1).alias("k")), F.struct(F.lit("Notes: the end").alias("text"), F.lit(2**30).alias("k")))).alias("x"))
    both = rows.select("document_id", "k", F.explode("texts").alias("text")).unionByName(ends.select("document_id", F.col("x.k").cast("long").alias("k"), "x.text"))
    line = F.row_number().over(W.partitionBy("document_id").orderBy("k", F.col("text").startswith("(")))
    return statements.tag_sections(statements.strip_identity(both.select("document_id", F.lit(1).alias("page"), line.alias("line_no"), "text"), "Quarterly Statement"))


def _money(c):
    return F.format_number(F.col(c).cast("decimal(18,2)"), 2)


@query(f"SELECT account_id AS document_id, trade_date, CASE WHEN units % 5 <> 0 THEN trade_date + 2 END::DATE AS settlement_date, {_LETTERS} AS code, units::DOUBLE AS units, fees::DOUBLE AS fee, gross::DOUBLE AS value FROM tr")
def statement_trades(spark, sf):
    """Trades as statement rows: some not settled yet, some with their code on the next line."""
    tr = td.trades(spark, sf).withColumn("code", F.expr(_LETTERS))
    day = lambda d: F.date_format(d, "d-MMM-yyyy")
    settled = F.when(F.col("units") % 5 != 0, day(F.date_add("trade_date", 2))).otherwise("Not yet settled")
    own = F.concat(F.lit("("), "code", F.lit(")"))
    wraps = F.col("units") % 3 == 0
    text = F.concat_ws(" ", day("trade_date"), settled, F.lit("Some product"), F.when(~wraps, own), _money("units"), F.lit("1.00"), _money("fees"), F.lit("AUD"), _money("gross"))
    rows = tr.select(F.col("account_id").alias("document_id"), F.row_number().over(W.partitionBy("account_id").orderBy("trade_date", "event_id")).cast("long").alias("k"), F.when(wraps, F.array(text, own)).otherwise(F.array(text)).alias("texts"))
    return _d(statements.extract_trades(_lines(rows, "trades")).select("document_id", "trade_date", "settlement_date", "code", "units", "fee", "value"))


_CASH_ROWS = f"""{_DAILY}, cr AS (SELECT account_id AS document_id, trade_date AS d, cash, cash - lag(cash) OVER (PARTITION BY account_id ORDER BY trade_date) AS moved FROM da)"""


def _cash_lines(spark, sf):
    daily = ledger.daily_cash(td.cash_events(spark, sf))
    w = W.partitionBy("account_id").orderBy("trade_date")
    moved = daily.withColumn("size", F.abs(F.coalesce(F.col("cash") - F.lag("cash").over(w), F.col("cash"))))
    kind = F.when(F.day("trade_date") % 2 == 0, "DIV: ABC.AX @ AUD 0.25").otherwise("Cash Account Interest")
    text = F.concat_ws(" ", F.date_format("trade_date", "d-MMM-yyyy"), kind, _money("size"), _money("cash"))
    rows = moved.select(F.col("account_id").alias("document_id"), F.row_number().over(w).cast("long").alias("k"), F.array(text).alias("texts"))
    return _lines(rows, "cash")


@query(f", {_CASH_ROWS} SELECT document_id, d AS \"on\", CASE WHEN day(d) % 2 = 0 THEN 'DIV: ABC.AX @ AUD 0.25' ELSE 'Cash Account Interest' END AS description, moved::DOUBLE + 0.0 AS amount, cash::DOUBLE AS balance FROM cr")
def statement_cash(spark, sf):
    """Daily balances as cash rows, whose direction is in the balance alone."""
    got = statements.extract_cash(_cash_lines(spark, sf))
    return _d(got.select("document_id", "on", "description", "amount", "balance"))


@query(f", {_CASH_ROWS} SELECT document_id, d AS \"on\", 'ABC' AS code, 'AUD' AS currency, 0.25::DOUBLE AS rate, moved::DOUBLE + 0.0 AS amount FROM cr WHERE day(d) % 2 = 0")
def statement_income(spark, sf):
    return _d(statements.extract_income(statements.extract_cash(_cash_lines(spark, sf))))


@query(f"SELECT account_id AS document_id, {_LETTERS} AS code, CASE WHEN security_id < 'Brand#3' THEN 'etf' ELSE 'managed_fund' END AS asset_class, sum(units)::DOUBLE AS units, sum(gross)::DOUBLE AS value FROM tr GROUP BY ALL")
def statement_holdings(spark, sf):
    """What accounts ever traded, as holdings under two headings."""
    own = td.trades(spark, sf).groupBy("account_id", "security_id").agg(F.sum("units").alias("units"), F.sum("gross").alias("gross")).withColumn("code", F.expr(_LETTERS))
    text = F.concat_ws(" ", "code", F.lit("Some fund"), _money("units"), F.lit("1.00"), F.lit("30-Jun-00"), _money("gross"))
    first = F.col("security_id") < "Brand#3"
    w = W.partitionBy("account_id", first).orderBy("security_id")
    k = F.row_number().over(w)
    head = F.when(first, "Exchange traded funds").otherwise("Managed funds")
    rows = own.select(F.col("account_id").alias("document_id"), (F.when(first, 0).otherwise(1000) + 2 * k).cast("long").alias("k"), F.array(text).alias("texts"))
    heads = own.select(F.col("account_id").alias("document_id"), F.when(first, 1).otherwise(1001).cast("long").alias("k"), F.array(head).alias("texts")).distinct()
    return _d(statements.extract_holdings(_lines(rows.unionByName(heads), "holdings")).select("document_id", "code", "asset_class", "units", "value"))


@query(f", {_DAILY} SELECT account_id AS document_id, 'QUARTERLY' AS kind, DATE '2000-01-01' AS period_start, DATE '2000-06-30' AS period_end, arg_min(cash, trade_date)::DOUBLE AS opening_value, arg_max(cash, trade_date)::DOUBLE AS closing_value, arg_max(cumulative_contributions, trade_date)::DOUBLE AS deposits FROM da GROUP BY ALL")
def statement_summaries(spark, sf):
    """Kind, period and figures of each account's summary."""
    own = ledger.daily_cash(td.cash_events(spark, sf)).groupBy("account_id").agg(F.min_by("cash", "trade_date").alias("a"), F.max_by("cash", "trade_date").alias("z"), F.max_by("cumulative_contributions", "trade_date").alias("d"))
    texts = F.array(F.concat(F.lit("Portfolio opening value as at 1 January 2000 "), _money("a")), F.concat(F.lit("Portfolio closing value as at 30 June 2000 "), _money("z")), F.concat(F.lit("Deposits into the account "), _money("d")))
    lines = _lines(own.select(F.col("account_id").alias("document_id"), F.lit(1).cast("long").alias("k"), texts.alias("texts")), "cash")
    got = statements.classify_documents(lines).join(statements.extract_summary(lines), "document_id")
    return _d(got.select("document_id", "kind", "period_start", "period_end", "opening_value", "closing_value", "deposits"))
