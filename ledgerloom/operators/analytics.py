"""Allocation, concentration, trading activity, gains, income, attribution and coverage figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators.ledger import INCOME
from ledgerloom.functions.text import bucket_end, financial_year


def allocation(state: DataFrame) -> DataFrame:
    """Weight of each held security in its account's value; null where the account's value is null or 0."""
    total = F.sum("value").over(W.partitionBy("account_id"))
    return state.where("units <> 0").select("account_id", "security_id", "value", F.when(total != 0, F.col("value") / total).alias("weight"))


def concentration(weights: DataFrame) -> DataFrame:
    """Largest, five and ten largest weights, the Herfindahl index and the number of holdings."""
    w = W.partitionBy("account_id").orderBy(F.desc("weight"), "security_id")
    own = weights.withColumn("k", F.row_number().over(w))
    top = lambda n: F.sum(F.when(F.col("k") <= n, F.col("weight")))
    return own.groupBy("account_id").agg(top(1).alias("largest"), top(5).alias("top5"), top(10).alias("top10"), F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.count("*").alias("holdings"))


def trading_activity(trades: DataFrame, granularity: str = "year") -> DataFrame:
    """Buy and sell counts and values, average and largest trade by account and bucket."""
    buy, sell = F.col("type") == "BUY", F.col("type") == "SELL"
    return trades.groupBy("account_id", bucket_end(F.col("trade_date"), granularity).alias("period_end")).agg(
        F.count_if(buy).alias("buys"), F.count_if(sell).alias("sells"), F.coalesce(F.sum(F.when(buy, F.col("gross"))), F.lit(0)).cast("decimal(18,2)").alias("bought"), F.coalesce(F.sum(F.when(sell, F.col("gross"))), F.lit(0)).cast("decimal(18,2)").alias("sold"),
        F.avg(F.col("gross").cast("double")).alias("average"), F.max("gross").alias("largest"),
    )


def most_traded(trades: DataFrame) -> DataFrame:
    """Each account's security with most trades; ties to the smaller name."""
    n = trades.groupBy("account_id", "security_id").agg(F.count("*").alias("n_trades"))
    w = W.partitionBy("account_id").orderBy(F.desc("n_trades"), "security_id")
    return n.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def realised_gains(disposals: DataFrame) -> DataFrame:
    """Gains, losses and net of dated sells by account and financial year (July to June)."""
    return disposals.groupBy("account_id", financial_year(F.col("trade_date")).alias("financial_year")).agg(F.sum(F.greatest("gain", F.lit(0.0))).alias("gains"), F.sum(F.least("gain", F.lit(0.0))).alias("losses"), F.sum("gain").alias("net"), F.count("*").alias("sells"))


def income_history(cash: DataFrame, granularity: str = "month", *keys: str) -> DataFrame:
    """Income by kind, bucket and ``keys`` (such as a security); franking credits, tax withheld and what is left, where ``cash`` has such columns."""
    own = cash.where(F.col("type").isin(*INCOME)).groupBy("account_id", *keys, bucket_end(F.col("trade_date"), granularity).alias("period_end"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(18,2)")
    extra = [c for c in ("franking", "withheld") if c in cash.columns]
    got = own.agg(*[total(F.when(F.col("type") == k, F.col("amount"))).alias(k.lower()) for k in INCOME], F.sum("amount").alias("gross"), *[total(c).alias(c) for c in extra])
    return got.withColumn("net", (F.col("gross") - F.col("withheld")).cast("decimal(18,2)")) if "withheld" in extra else got


def attribution(state: DataFrame, fees: DataFrame) -> DataFrame:
    """Tree of profit by account: capital by security, fees, and totals (rolled up)."""
    leaves = state.select("account_id", F.lit("capital").alias("node"), F.col("security_id").alias("leaf"), (F.col("realised") + F.coalesce("unrealised", F.lit(0.0))).alias("value")).unionByName(fees.select("account_id", F.lit("fees").alias("node"), F.lit("fees").alias("leaf"), F.col("value")))
    return leaves.rollup("account_id", "node", "leaf").agg(F.sum("value").alias("value")).where("account_id IS NOT NULL")


def best_worst(returns: DataFrame) -> DataFrame:
    """Best and worst period of each account; the earliest wins ties."""
    own = returns.where("r IS NOT NULL").groupBy("account_id")
    return own.agg(F.max_by("period_end", F.struct("r", -F.unix_date("period_end"))).alias("best"), F.max("r").alias("best_return"), F.min_by("period_end", F.struct("r", F.unix_date("period_end"))).alias("worst"), F.min("r").alias("worst_return"))


def finest_gap(dated: DataFrame, date: str = "trade_date") -> DataFrame:
    """Least days between an account's distinct dates; null with one date."""
    w = W.partitionBy("account_id").orderBy(date)
    return dated.select("account_id", date).distinct().withColumn("g", F.datediff(date, F.lag(date).over(w))).groupBy("account_id").agg(F.min("g").alias("finest_gap"), F.count("*").alias("dates"))


def milestones(daily: DataFrame, thresholds: list[int]) -> DataFrame:
    """First day on which the cash balance reaches each threshold, and its all-time high (the latest day on ties)."""
    crossed = daily.withColumn("t", F.explode(F.array(*map(F.lit, thresholds)))).where("cash >= t").groupBy("account_id", F.concat(F.lit("reached "), "t").alias("milestone")).agg(F.min("trade_date").alias("on"))
    high = daily.groupBy("account_id").agg(F.max_by("trade_date", F.struct("cash", "trade_date")).alias("on")).select("account_id", F.lit("all-time high").alias("milestone"), "on")
    return crossed.unionByName(high)


def trailing_income(cash: DataFrame, daily: DataFrame, days: int = 360, value: str = "cash", ends: str | None = None) -> DataFrame:
    """Income of the last ``days`` days over the mean of what was valued in that span: for every day, or at the ends of buckets.

    The yield is null where nothing was valued or the mean isn't positive, ESTIMATED where some day of the span wasn't.
    """
    income = cash.where(F.col("type").isin(*INCOME)).groupBy("account_id", "trade_date").agg(F.sum("amount").alias("i"))
    n = F.unix_date("trade_date")
    w = W.partitionBy("account_id").orderBy(n)
    span = w.rangeBetween(-days, 0)
    got = daily.join(income, ["account_id", "trade_date"], "left").select(
        "account_id", "trade_date", F.coalesce(F.sum("i").over(w.rangeBetween(-(days - 1), 0)), F.lit(0)).cast("decimal(18,2)").alias("income"), F.avg(F.col(value).cast("double")).over(span).alias(f"average_{value}"),
        (F.count(value).over(span) == F.count("*").over(span)).alias("all"),
    )
    mean = F.col(f"average_{value}")
    got = got.withColumn("yield", F.when(mean > 0, F.col("income").cast("double") / mean)).withColumn("quality", F.when(mean.isNull() | (mean <= 0), "UNAVAILABLE").when(F.col("all"), "ACTUAL").otherwise("ESTIMATED")).drop("all")
    return got if ends is None else got.where(F.col("trade_date") == bucket_end(F.col("trade_date"), ends))
