"""Returns, indices, drawdowns, period summaries and risk figures over daily or periodic series, per account."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerloom.functions.text import bucket_end

def _by_period():
    return W.partitionBy("account_id").orderBy("period_end")


def _to_here():
    return _by_period().rowsBetween(W.unboundedPreceding, 0)


def modified_dietz(periods: DataFrame, flows: DataFrame, with_capital: bool = False) -> DataFrame:
    """``periods`` (account_id, period_start, period_end, begin_value, end_value) with flow and return ``r``.

    Flows (account_id, date, amount) count in (start, end], weighted by the share of days left. A flow finds its period
    by an as-of step on period ends, not a range join. Null where the weighted capital isn't positive. ``with_capital``
    keeps that capital as a column.
    """
    ends = periods.select("account_id", F.col("period_end").alias("date"), F.struct("period_start", "period_end").alias("p"), F.lit(None).cast("double").alias("amount"))
    both = ends.unionByName(flows.select("account_id", "date", F.lit(None).cast("struct<period_start:date,period_end:date>").alias("p"), F.col("amount").cast("double").alias("amount")))
    # backwards, so that the frame grows: one that shrinks would be worked out anew for each row
    w = W.partitionBy("account_id").orderBy(F.desc("date"), F.col("p").isNotNull().desc()).rowsBetween(W.unboundedPreceding, 0)
    own = both.withColumn("p", F.last("p", ignorenulls=True).over(w)).where("amount IS NOT NULL AND p IS NOT NULL AND date > p.period_start")
    days = F.datediff("p.period_end", "p.period_start")
    weight = F.when(days == 0, 1.0).otherwise(F.datediff("p.period_end", "date") / days)
    sums = own.groupBy("account_id", F.col("p.period_end").alias("period_end")).agg(F.sum("amount").alias("flow"), F.sum(F.col("amount") * weight).alias("weighted"))
    got = periods.join(sums, ["account_id", "period_end"], "left").fillna(0.0, ["flow", "weighted"])
    capital = F.col("begin_value") + F.col("weighted")
    got = got.withColumn("r", F.when(capital > 0, (F.col("end_value") - F.col("begin_value") - F.col("flow")) / capital))
    return (got.withColumn("capital", capital) if with_capital else got).drop("weighted")


def return_index(returns: DataFrame, base: float = 100.0) -> DataFrame:
    """Index base * product(1 + r) over measurable periods, carried over others; high-water mark and drawdown."""
    index = returns.withColumn("index", base * F.product(F.coalesce(1 + F.col("r"), F.lit(1.0))).over(_to_here()))
    return index.withColumn("high", F.greatest(F.lit(base), F.max("index").over(_to_here()))).withColumn("drawdown", F.col("index") / F.col("high") - 1)


def extended_index(stored: DataFrame, returns: DataFrame) -> DataFrame:
    """Index, high-water mark and drawdown of ``returns`` that follow what is ``stored``, as a rebuild of all would give them.

    Each account's last stored row is the seed of the running product and maximum; accounts that aren't stored start at 100.
    """
    seed = stored.groupBy("account_id").agg(F.max_by(F.struct("index", "high"), "period_end").alias("s"))
    own = return_index(returns).join(seed, "account_id", "left")
    index = F.col("index") * F.coalesce(F.col("s.index") / 100.0, F.lit(1.0))
    own = own.withColumn("index", index)
    high = F.greatest(F.coalesce(F.col("s.high"), F.lit(100.0)), F.max("index").over(_to_here()))
    return own.withColumn("high", high).withColumn("drawdown", F.col("index") / F.col("high") - 1).drop("s")


def drawdown_episodes(index: DataFrame, floor: float = 0.05) -> DataFrame:
    """Peak, trough, recovery of every fall of ``floor`` or more of ``index`` (account_id, period_end, index).

    A touch is a point at or above all earlier ones; each stretch from a touch to the next is one segment, which counts
    if its lowest point is deep enough. The peak keeps its first date while the level is only equalled.
    """
    own = index.where("index IS NOT NULL").select("account_id", "period_end", "index")
    before = F.max("index").over(_by_period().rowsBetween(W.unboundedPreceding, -1))
    own = own.withColumn("top", before).withColumn("touch", F.col("top").isNull() | (F.col("index") >= F.col("top")))
    own = own.withColumn("segment", F.sum(F.col("touch").cast("int")).over(_to_here()))
    segments = own.groupBy("account_id", "segment").agg(
        F.min(F.when(F.col("touch"), F.struct("period_end", "index", "top"))).alias("t"), F.min(F.when(~F.col("touch"), F.struct("index", "period_end"))).alias("low")
    )
    w = W.partitionBy("account_id").orderBy("segment")
    deep = F.coalesce(1 - F.col("low.index") / F.col("t.index") >= floor, F.lit(False))
    segments = segments.withColumn("deep", deep)
    anchor = F.col("t.top").isNull() | (F.col("t.index") > F.col("t.top")) | F.coalesce(F.lag("deep").over(w), F.lit(False))
    segments = segments.withColumn("peak", F.last(F.when(anchor, F.col("t.period_end")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("recovery", F.lead("t.period_end").over(w))
    return segments.where("deep").select("account_id", "peak", F.col("low.period_end").alias("trough"), "recovery", (F.col("low.index") / F.col("t.index") - 1).alias("depth"), F.datediff("recovery", "low.period_end").alias("recovery_days"))


def period_summaries(daily: DataFrame, granularity: str) -> DataFrame:
    """Opening, closing and differences of cumulative columns for each bucket of a daily cash series."""
    last = daily.groupBy("account_id", bucket_end(F.col("trade_date"), granularity).alias("period_end")).agg(F.max_by(F.struct("cash", "cumulative_contributions", "cumulative_withdrawals", "cumulative_income", "cumulative_fees"), "trade_date").alias("c"))
    change = {"cumulative_contributions": "contributions", "cumulative_withdrawals": "withdrawals", "cumulative_income": "income", "cumulative_fees": "fees"}
    before = F.lag("c").over(_by_period())
    return last.select("account_id", "period_end", F.coalesce(before["cash"], F.lit(0)).cast("decimal(18,2)").alias("opening"), F.col("c.cash").alias("closing"), *[(F.col(f"c.{k}") - F.coalesce(before[k], F.lit(0))).cast("decimal(18,2)").alias(v) for k, v in change.items()])


def rolling_volatility(returns: DataFrame, n: int = 8, per_year: int = 4) -> DataFrame:
    """Deviation of the last ``n`` returns times the root of periods a year; full windows only."""
    w = _by_period().rowsBetween(-(n - 1), 0)
    return returns.where("r IS NOT NULL").withColumn("volatility", F.when(F.count("r").over(w) == n, F.stddev_samp("r").over(w) * per_year**0.5)).where("volatility IS NOT NULL").select("account_id", "period_end", "volatility")


def risk_summary(returns: DataFrame, least: int = 6, per_year: int = 4) -> DataFrame:
    """Volatility, annualised return, Sharpe and Sortino ratios (no risk-free rate); null under ``least`` returns."""
    own = returns.where("r IS NOT NULL").groupBy("account_id").agg(F.count("r").alias("observations"), F.stddev_samp("r").alias("s"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("d"), F.product(1 + F.col("r")).alias("p"))
    enough = F.col("observations") >= least
    year = F.when(enough & (F.col("p") > 0), F.pow("p", per_year / F.col("observations")) - 1)
    confidence = F.when(F.col("observations") >= 4 * least, "HIGH").when(F.col("observations") >= 2 * least, "MEDIUM").when(enough, "LOW").otherwise("NONE")
    return own.select("account_id", "observations", F.when(enough, F.col("s") * per_year**0.5).alias("volatility"), year.alias("annualised"), F.try_divide(year, F.col("s") * per_year**0.5).alias("sharpe"), F.try_divide(year, F.col("d") * per_year**0.5).alias("sortino"), confidence.alias("confidence"))


@F.pandas_udf(DoubleType())
def _xirr(days: pd.Series, amounts: pd.Series) -> pd.Series:
    """Bisection of all rows at once on [-0.9999, 10], rounded to 10 places; null without a change of sign."""
    n = np.array([len(d) for d in days])
    if not len(n) or not n.sum():
        return pd.Series([None] * len(n), dtype=float)
    years = np.concatenate(days.to_list()).astype(float) / 365
    cash, of = np.concatenate(amounts.to_list()).astype(float), np.repeat(np.arange(len(n)), n)

    def worth(rate: np.ndarray) -> np.ndarray:
        return np.bincount(of, cash * (1 + rate[of]) ** -years, len(n))

    low, high = np.full(len(n), -0.9999), np.full(len(n), 10.0)
    at_low, done, answer = worth(low), np.zeros(len(n), bool), np.full(len(n), np.nan)
    solvable = np.sign(at_low) * np.sign(worth(high)) < 0
    for _ in range(200):
        mid = (low + high) / 2
        v = worth(mid)
        near = ~done & (np.abs(v) < 1e-9)
        answer[near], done = mid[near], done | near
        up = np.sign(v) == np.sign(at_low)
        low, high = np.where(up & ~done, mid, low), np.where(~up & ~done, mid, high)
    answer = np.where(done, answer, (low + high) / 2)
    return pd.Series(np.where(solvable, np.round(answer, 10), np.nan)).where(solvable, None)


def rate_of(flows: Column) -> Column:
    """Money-weighted yearly rate of an array of (date, amount) in order of dates; null without two signs."""
    first = flows[0]["date"]
    amounts = F.transform(flows, lambda x: x["amount"])
    both = (F.array_min(amounts) < 0) & (F.array_max(amounts) > 0)
    return F.when(both, _xirr(F.transform(flows, lambda x: F.datediff(x["date"], first)), amounts))


def xirr(flows: DataFrame, *keys: str) -> DataFrame:
    """Money-weighted yearly rate of dated amounts (date, amount) by keys; null without two signs."""
    day = flows.groupBy(*keys, "date").agg(F.sum(F.col("amount").cast("double")).alias("amount"))
    got = day.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "amount"))).alias("f"))
    return got.select(*keys, rate_of(F.col("f")).alias("xirr"))
