"""Consistency checks of statements, holdings and trades; each returns one row for each issue, with its code and severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Money and units may be off by so much; no date before the first is real.
TOLERANCE, EARLIEST = 0.05, "1990-01-01"


def _issue(df: DataFrame, code: str | Column, severity: str | Column, *keep: str | Column) -> DataFrame:
    return df.select(*keep, F.lit(code).alias("code"), F.lit(severity).alias("severity"))


def check_period_identity(periods: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Periods (account_id, period_end, opening, closing, then amounts) whose parts don't lead from opening to closing.

    closing = opening + deposits + withdrawals + transfers_in - transfers_out + change + income - tax - fees; amounts
    that are null or have no column count as 0. A period without opening or closing is incomplete, not wrong.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in periods.columns else F.lit(0)
    computed = F.col("opening") + part("deposits") + part("withdrawals") + part("transfers_in") - part("transfers_out") + part("change") + part("income") - part("tax") - part("fees")
    own = periods.select("account_id", "period_end", computed.cast("double").alias("computed"), F.col("closing").cast("double").alias("closing"), F.col("opening").isNull().alias("no_opening"))
    missing = F.col("no_opening") | F.col("closing").isNull()
    gaps = own.where(missing).select("account_id", "period_end", F.lit(None).cast("double").alias("drift"))
    off = own.where(~missing).withColumn("drift", F.col("computed") - F.col("closing")).where(F.abs("drift") > tolerance)
    return _issue(gaps, "PERIOD_SUMMARY_INCOMPLETE", "WARNING", "account_id", "period_end", "drift").unionByName(_issue(off, "PERIOD_IDENTITY_DRIFT", "ERROR", "account_id", "period_end", "drift"))


def unit_continuity(trades: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each reported snapshot (account_id, security_id, reporting_date, units) with the units before it, those traded since and those expected.

    Trades (trade_date, units, signed) and snapshots are laid into one order of dates, trades of a day first, so what is
    traded between two snapshots is a difference of running sums; nothing is joined by range.
    """
    both = trades.select("account_id", "security_id", F.col("trade_date").alias("on"), F.col("units").alias("traded"), F.lit(None).cast("decimal(28,2)").alias("units"), F.lit(0).alias("kind"))
    both = both.unionByName(snapshots.select("account_id", "security_id", F.col("reporting_date").alias("on"), F.lit(0).cast("decimal(28,2)").alias("traded"), F.col("units").cast("decimal(28,2)").alias("units"), F.lit(1).alias("kind")))
    by = W.partitionBy("account_id", "security_id").orderBy("on", "kind")
    total = both.withColumn("total", F.sum("traded").over(by.rowsBetween(W.unboundedPreceding, 0))).where("kind = 1")
    before, so_far = F.coalesce(F.lag("units").over(by), F.lit(0)), F.coalesce(F.lag("total").over(by), F.lit(0))
    own = total.select("account_id", "security_id", F.col("on").alias("reporting_date"), "units", before.alias("before"), (F.col("total") - so_far).alias("traded"))
    return own.withColumn("expected", F.col("before") + F.col("traded"))


def check_unit_continuity(trades: DataFrame, snapshots: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Snapshots that drift from the one before plus what was traded between."""
    off = unit_continuity(trades, snapshots).where(F.abs(F.col("expected") - F.col("units")) > tolerance)
    return _issue(off, "UNIT_CONTINUITY_DRIFT", "WARNING", "account_id", "security_id", "reporting_date", F.col("expected").cast("double").alias("expected"), F.col("units").cast("double").alias("units"))


def duplicate_periods(periods: DataFrame) -> DataFrame:
    """Period ends that an account reports more than once."""
    n = periods.where("period_end IS NOT NULL").groupBy("account_id", "period_end").agg(F.count("*").alias("times")).where("times > 1")
    return _issue(n, "DUPLICATE_PERIOD", "WARNING", "account_id", "period_end", "times")


def check_dates(dated: DataFrame, id_col: str, date_col: str, latest: Column | None = None, earliest: str = EARLIEST) -> DataFrame:
    """Rows dated before ``earliest`` or after ``latest`` (today)."""
    day = F.col(date_col)
    off = dated.where((day > (F.current_date() if latest is None else latest)) | (day < F.lit(earliest).cast("date")))
    return _issue(off, "IMPOSSIBLE_DATE", "ERROR", F.col(id_col).alias("event_id"), day.alias("on"))


def outside_periods(events: DataFrame, periods: DataFrame) -> DataFrame:
    """Events (account_id, event_id, trade_date) that no period (account_id, period_start, period_end) holds.

    A date lies in a period just if the latest end among periods that began by then isn't before it: a running maximum
    over an account's dates, of which there are few, however many events a date has. Accounts without periods have no
    issues; periods without a start or an end don't count.
    """
    spans = periods.where("period_start IS NOT NULL AND period_end IS NOT NULL").groupBy("account_id", F.col("period_start").alias("on")).agg(F.max("period_end").alias("until")).withColumn("asked", F.lit(False))
    dated = events.where("trade_date IS NOT NULL")
    days = spans.unionByName(dated.select("account_id", F.col("trade_date").alias("on"), F.lit(None).cast("date").alias("until"), F.lit(True).alias("asked")))
    days = days.groupBy("account_id", "on").agg(F.max("until").alias("until"), F.max("asked").alias("asked"))
    account = W.partitionBy("account_id").orderBy("on")
    known = days.withColumn("latest", F.max("until").over(account.rowsBetween(W.unboundedPreceding, 0))).withColumn("periods", F.max("until").over(account.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    off = known.where("asked AND periods IS NOT NULL AND (latest IS NULL OR latest < on)").select(F.col("account_id").alias("__a"), F.col("on").alias("__on"))
    found = dated.join(off, F.col("account_id").eqNullSafe(F.col("__a")) & (F.col("trade_date") == F.col("__on")), "left_semi")
    return _issue(found, "TRANSACTION_OUTSIDE_PERIOD", "WARNING", "account_id", F.col("event_id").cast("string").alias("event_id"), F.col("trade_date").alias("on"))


def check_missing_security(events: DataFrame) -> DataFrame:
    """Trades and income that name no security."""
    off = events.where(F.col("security_id").isNull() & F.col("type").isin("BUY", "SELL", "DIVIDEND", "DISTRIBUTION"))
    return _issue(off, "MISSING_SECURITY", "WARNING", "account_id", "event_id", "type")


def check_tax_totals(reported: DataFrame, details: DataFrame, tolerance: float = TOLERANCE, code: str = "TAX_DIVIDEND_FRANKING_DRIFT") -> DataFrame:
    """Reported totals (account_id, financial_year, total) that details (account_id, financial_year, amount) don't add up to; no details are 0."""
    sums = details.groupBy("account_id", "financial_year").agg(F.sum("amount").alias("computed"))
    own = reported.where("total IS NOT NULL").join(sums, ["account_id", "financial_year"], "left").withColumn("computed", F.coalesce("computed", F.lit(0)).cast("double"))
    off = own.where(F.abs(F.col("computed") - F.col("total").cast("double")) > tolerance)
    return _issue(off, code, "WARNING", "account_id", "financial_year", "computed", F.col("total").cast("double").alias("total"))


def check_settlement(trades: DataFrame, pairs: DataFrame) -> DataFrame:
    """Trades without a settlement (pending), and those whose money moved on another day than the trade (``pairs`` of pair_settlements)."""
    found = pairs.select(F.col("trade_id").alias("event_id"), "days_to_cash")
    return settlement_issues(trades.select("account_id", "event_id").join(found, "event_id", "left"))


def settlement_issues(settled: DataFrame) -> DataFrame:
    """As check_settlement, of trades (account_id, event_id, days_to_cash) as matching.settled gives them, in one pass."""
    off, pending = settled.where("days_to_cash IS NULL OR days_to_cash <> 0"), F.col("days_to_cash").isNull()
    pick = lambda yes, no: F.when(pending, yes).otherwise(no)
    return _issue(off, pick("SETTLEMENT_PENDING", "SETTLEMENT_DATE_MISMATCH"), pick("INFO", "ERROR"), "account_id", "event_id", "days_to_cash")


def duplicate_ids(rows: DataFrame, id_col: str = "event_id", kind_col: str = "type") -> DataFrame:
    """By kind, how many rows repeat an id seen before."""
    return rows.groupBy(kind_col).agg(F.count("*").alias("n_rows"), (F.count("*") - F.countDistinct(id_col)).alias("duplicates"))
