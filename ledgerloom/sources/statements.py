"""Rows of statement text: sections, holdings, trades, cash, summaries and kinds of documents, out of (document_id, page, line_no, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalise_code, parse_date, parse_decimal, redact_inline

#: How statements write numbers and dates.
NUMBER, DATE_LONG, DATE_SHORT = r"-?\$?-?[\d,]+\.\d+", r"\d{1,2}-[A-Za-z]{3}-\d{4}", r"\d{1,2}-[A-Za-z]{3}-\d{2}"
#: Where sections begin and end (phrases, without case), and headings of asset classes in the holdings; statements of other providers have their own.
SECTIONS = {
    "holdings": ("portfolio valuation as at", ["cash account transaction details"]),
    "cash": ("cash account transaction details", ["investment transaction details", "notes:"]),
    "trades": ("investment transaction details", ["notes:"]),
}
HEADINGS = {"Exchange traded funds": "etf", "Australian shares": "australian_share", "Managed funds": "managed_fund", "Cash account": "cash"}
KINDS = {"Annual Tax Report": "TAX_REPORT", "Performance Report": "PERFORMANCE", "Annual Statement": "ANNUAL", "Quarterly Statement": "QUARTERLY"}
SUMMARY = {"opening_value": rf"opening value as at .+?\s({NUMBER})\s*$", "closing_value": rf"closing value as at .+?\s({NUMBER})\s*$", "deposits": rf"(?i)^\s*deposits into\b.*?\s({NUMBER})\s*$", "withdrawals": rf"(?i)^\s*withdrawals from\b.*?\s({NUMBER})\s*$", "transfers_in": rf"(?i)assets transferred in\s+({NUMBER})", "transfers_out": rf"(?i)assets transferred out\s+({NUMBER})", "change_in_value": rf"(?i)change in investment value\s+({NUMBER})", "withholding_tax": rf"(?i)withholding tax\s+({NUMBER})", "reported_return": rf"(?i)return after withholding tax and fees\s+({NUMBER})", "income": rf"Income from your investments\s+({NUMBER})", "fees": rf"fees and costs\s+({NUMBER})"}
IDENTITY = r"(?i)^\s*(Investor name|Account number|Tax file number status|BSB)\s*:"
SELF_CONTAINED = r"(?i)^(DIV\s*:|Buy transaction of|Sell transaction of|Account Fee|Cash Account Interest|Opening balance|Closing balance|Failed Direct Debit)"

#: How rows of holdings, trades and cash are laid out.
_HOLDING = rf"^([A-Z]{{2,5}})\s+(.*?)\s*({NUMBER})\s+({NUMBER})\s+({DATE_SHORT})\s+({NUMBER})\s*$"
_TRADE = rf"^({DATE_LONG})\s+({DATE_LONG}|Not yet settled)\s+(.*?)({NUMBER})\s+({NUMBER})\s+({NUMBER})\s+([A-Z]{{3}})\s+({NUMBER})\s*$"
_CODE = r"\(([A-Z]{2,5})\)"
_CASH, _BALANCE = rf"^({DATE_LONG})\s+(.*?)\s*({NUMBER})\s+({NUMBER})\s*$", rf"^({DATE_LONG})\s+(.*?)\s*({NUMBER})\s*$"


def _in_order() -> W:
    return W.partitionBy("document_id").orderBy("page", "line_no")


def strip_identity(lines: DataFrame, title: str) -> DataFrame:
    """Lines without labelled identities, and on page 1 without what stands above the title (all of it where there is none)."""
    first = F.min(F.when((F.col("page") == 1) & F.col("text").contains(title), F.col("line_no"))).over(W.partitionBy("document_id"))
    own = lines.withColumn("__title", F.coalesce(first, F.lit(0)))
    return own.where(~F.col("text").rlike(IDENTITY) & ((F.col("page") != 1) | (F.col("line_no") >= F.col("__title")))).drop("__title")


def tag_sections(lines: DataFrame, sections: dict[str, tuple[str, list[str]]] = SECTIONS) -> DataFrame:
    """``lines`` with ``sections``: the names of those that hold a line; each runs from its first heading to the first stop after it, both left out."""
    at, low, doc = F.struct("page", "line_no"), F.lower("text"), W.partitionBy("document_id")
    # all starts in one window, then all stops: a document lies in two windows, however many sections there are
    out = lines.withColumns({f"__{name}_a": F.min(F.when(low.contains(start.lower()), at)).over(doc) for name, (start, _) in sections.items()})
    stop = lambda stops: F.exists(F.array(*[F.lit(s.lower()) for s in stops]), lambda s: low.contains(s))
    out = out.withColumns({f"__{name}_z": F.min(F.when(stop(stops) & (at > F.col(f"__{name}_a")), at)).over(doc) for name, (_, stops) in sections.items()})
    names = [F.when((at > F.col(f"__{name}_a")) & F.coalesce(at < F.col(f"__{name}_z"), F.lit(True)), name) for name in sections]
    return out.withColumn("sections", F.array_compact(F.array(*names))).drop(*[f"__{n}_{x}" for n in sections for x in "az"])


def _of(lines: DataFrame, section: str) -> DataFrame:
    return lines.where(F.array_contains("sections", section))


def _part(pattern: str, k: int, text: str = "text") -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def extract_holdings(lines: DataFrame, headings: dict[str, str] = HEADINGS) -> DataFrame:
    """Holdings under asset-class headings: (document_id, page, code, name, asset_class, units, price, price_date, value); totals and cash are none."""
    heading = F.when(F.col("text").rlike(_HOLDING), None)
    for phrase, kind in headings.items():  # a provider's name may stand before a heading
        heading = heading.when(F.col("text").rlike(rf"(?i)^\s*(\w+\s+)?{phrase}\b"), kind)
    own = _of(lines, "holdings").withColumn("asset_class", F.last(heading, ignorenulls=True).over(_in_order().rowsBetween(W.unboundedPreceding, 0)))
    rows = own.where(F.col("text").rlike(_HOLDING) & ~F.col("text").startswith("Total") & (F.col("asset_class") != "cash"))
    number = lambda k: parse_decimal(_part(_HOLDING, k))
    return rows.select("document_id", "page", _part(_HOLDING, 1).alias("code"), F.trim(F.regexp_extract("text", _HOLDING, 2)).alias("name"), "asset_class", number(3).alias("units"), number(4).alias("price"), parse_date(_part(_HOLDING, 5)).alias("price_date"), number(6).alias("value"))


def extract_trades(lines: DataFrame) -> DataFrame:
    """Trades (document_id, page, trade_date, settlement_date, code, units, price, fee, currency, value); a code may stand on the line after, or else before."""
    w = _in_order()
    own = _of(lines, "trades").withColumns({"__next": F.lead("text").over(w), "__last": F.lag("text").over(w)}).where(F.col("text").rlike(_TRADE))
    code = F.coalesce(_part(_CODE, 1), _part(_CODE, 1, "__next"), _part(_CODE, 1, "__last"))
    number = lambda k: parse_decimal(_part(_TRADE, k))
    return own.select("document_id", "page", "line_no", parse_date(_part(_TRADE, 1)).alias("trade_date"), parse_date(_part(_TRADE, 2)).alias("settlement_date"), code.alias("code"), number(4).alias("units"), number(5).alias("price"), number(6).alias("fee"), _part(_TRADE, 7).alias("currency"), number(8).alias("value"))


def extract_cash(lines: DataFrame) -> DataFrame:
    """Cash rows (document_id, page, line_no, on, description, amount, balance): an amount's sign is which way the balance moved from the row before.

    A description that isn't complete in itself takes the neighbouring lines that are no rows or table heads. Without a
    row before, or with a balance alone, the amount is null.
    """
    w = _in_order()
    row, head = F.col("text").rlike(rf"^{DATE_LONG}\s"), F.col("text").rlike("(?i)Effective date|Transaction description|Debits")
    wrapped = F.when(~row & ~head, F.col("text"))
    own = _of(lines, "cash").withColumns({"__last": F.lag(wrapped).over(w), "__next": F.lead(wrapped).over(w)}).where(F.col("text").rlike(_BALANCE))
    two = F.col("text").rlike(_CASH)
    said = F.trim(F.when(two, F.regexp_extract("text", _CASH, 2)).otherwise(F.regexp_extract("text", _BALANCE, 2)))
    whole = F.when(said.rlike(SELF_CONTAINED), said).otherwise(F.trim(F.concat_ws(" ", "__last", F.nullif(said, F.lit("")), "__next")))
    balance = F.when(two, parse_decimal(_part(_CASH, 4))).otherwise(parse_decimal(_part(_BALANCE, 3)))
    got = own.select("document_id", "page", "line_no", parse_date(_part(_BALANCE, 1)).alias("on"), redact_inline(whole).alias("description"), F.when(two, parse_decimal(_part(_CASH, 3))).alias("size"), balance.alias("balance")).where("balance IS NOT NULL")
    before = F.lag("balance").over(w)
    return got.withColumn("amount", F.when(before.isNotNull(), F.when(F.col("balance") > before, F.col("size")).otherwise(-F.col("size")))).drop("size")


def extract_income(cash: DataFrame) -> DataFrame:
    """Income rows of extract_cash, ``DIV: CODE @ CUR rate``: (document_id, on, code, currency, rate, amount)."""
    line = r"(?i)^\s*DIV\s*:\s*([A-Z0-9.]+)\s*(?:@\s*([A-Z]{3})\s*([\d.]+))?"
    own = cash.where(F.col("description").rlike(line))
    part = lambda k: _part(line, k, "description")
    return own.select("document_id", "on", normalise_code(part(1)).alias("code"), part(2).alias("currency"), parse_decimal(part(3)).alias("rate"), "amount")


def extract_summary(lines: DataFrame, fields: dict[str, str] = SUMMARY) -> DataFrame:
    """One row for each document with its summary figures, the first line that has one; null where none does."""
    first = lambda p: F.min_by(_part(p, 1), F.when(F.col("text").rlike(p), F.struct("page", "line_no")))
    return lines.groupBy("document_id").agg(*[parse_decimal(first(p)).alias(name) for name, p in fields.items()])


def classify_documents(lines: DataFrame, kinds: dict[str, str] = KINDS) -> DataFrame:
    """Kind of each document, by the first of ``kinds`` that it mentions, and its period; OTHER and nulls without."""
    period = rf"for the period ({DATE_LONG}) to ({DATE_LONG})"
    found = F.coalesce(*[F.max(F.when(F.col("text").contains(phrase), kind)) for phrase, kind in kinds.items()], F.lit("OTHER"))
    at = lambda k: F.min_by(_part(period, k), F.when(F.col("text").rlike(period), F.struct("page", "line_no")))
    return lines.groupBy("document_id").agg(found.alias("kind"), parse_date(at(1)).alias("period_start"), parse_date(at(2)).alias("period_end"))
