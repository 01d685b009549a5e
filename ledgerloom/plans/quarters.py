"""Quarterly returns of trade accounts: valuations at quarter ends and trades as flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import bucket_end
from ledgerloom.operators.ledger import daily_positions
from ledgerloom.operators.performance import modified_dietz
from ledgerloom.sources.shared import checkpointed


def quarterly_returns(trades: DataFrame, prices: DataFrame, with_capital: bool = False) -> DataFrame:
    """(account_id, period_start, period_end, begin_value, end_value, flow, r): buys flow in, effective sells out.

    Units and prices are both carried forward over a calendar of quarter ends by windows, never joined by range. The
    trades are read once for positions by day and once for quarters' prices; what is left of both is checkpointed, since
    several branches need it.
    """
    days = checkpointed(daily_positions(trades))  # no more rows than positions have days
    end = bucket_end(F.col("trade_date"), "quarter")
    last = days.groupBy("account_id", "security_id", end.alias("period_end")).agg(F.max_by("held", "trade_date").alias("held"))
    span = days.agg(F.min(end).alias("a"), F.max(end).alias("b")).select(F.explode(F.expr("sequence(trunc(a, 'quarter'), trunc(b, 'quarter'), interval 3 month)")).alias("q")).select(bucket_end(F.col("q"), "quarter").alias("period_end"))
    grid = last.select("account_id", "security_id").distinct().join(F.broadcast(span))  # a calendar, some rows a year
    w = W.partitionBy("account_id", "security_id").orderBy("period_end").rowsBetween(W.unboundedPreceding, 0)
    units = grid.join(last, ["account_id", "security_id", "period_end"], "left").withColumn("held", F.coalesce(F.last("held", ignorenulls=True).over(w), F.lit(0.0)))
    own = checkpointed(prices.groupBy("security_id", bucket_end(F.col("price_date"), "quarter").alias("period_end")).agg(F.max_by("price", "price_date").alias("price")))
    wp = W.partitionBy("security_id").orderBy("period_end").rowsBetween(W.unboundedPreceding, 0)
    price = own.select("security_id").distinct().join(F.broadcast(span)).join(own, ["security_id", "period_end"], "left").withColumn("price", F.last("price", ignorenulls=True).over(wp))
    value = units.join(price, ["security_id", "period_end"]).groupBy("account_id", "period_end").agg(F.sum(F.when(F.col("held") != 0, F.col("held") * F.col("price")).otherwise(0.0)).alias("end_value"))
    wa = W.partitionBy("account_id").orderBy("period_end")
    periods = value.withColumn("begin_value", F.coalesce(F.lag("end_value").over(wa), F.lit(0.0))).withColumn("period_start", F.date_sub(F.trunc("period_end", "quarter"), 1))
    return modified_dietz(periods, days.groupBy("account_id", F.col("trade_date").alias("date")).agg(F.sum("flow").alias("amount")), with_capital)
