"""Returns over standard windows that end at each account's last valuation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days of the standard windows; null for the two that begin at a date of their own.
STANDARD_DAYS = {"1D": 1, "1W": 7, "1M": 30, "3M": 91, "6M": 182, "YTD": None, "1Y": 365, "3Y": 1095, "5Y": 1826, "10Y": 3652, "INCEPTION": None}


def standard_periods(index: DataFrame) -> DataFrame:
    """One row for each account and standard window of ``index`` (account_id, period_end, index), its real valuations.

    A window begins at the valuation nearest its own start, if that lies within max(7, days / 10) of it, else at the next
    later one. It is UNAVAILABLE, with a reason, where it begins before the account's first valuation, where both ends
    are one valuation, or where what can be measured is longer than asked by more than that tolerance.
    """
    own = index.where("index IS NOT NULL")
    span = own.groupBy("account_id").agg(F.min("period_end").alias("first"), F.max("period_end").alias("end"), F.max_by("index", "period_end").alias("closing"))
    windows = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(d).cast("int").alias("days")) for k, d in STANDARD_DAYS.items()])
    asked = span.withColumn("w", F.explode(windows)).select("account_id", "first", "end", "closing", "w.*")
    start = F.when(F.col("label") == "INCEPTION", F.col("first")).when(F.col("label") == "YTD", F.greatest(F.trunc("end", "year"), "first")).otherwise(F.date_sub("end", F.col("days")))
    asked = asked.withColumn("start", start).withColumn("days", F.greatest(F.datediff("end", "start"), F.lit(1))).withColumn("tolerance", F.greatest(F.lit(7), F.floor(F.col("days") / 10).cast("int")))
    off = F.abs(F.datediff("period_end", "start"))
    keys = ["account_id", "label", "first", "end", "closing", "start", "days", "tolerance"]
    met = asked.join(own, "account_id").groupBy(*keys).agg(
        F.min(F.struct(off.alias("off"), F.col("period_end").alias("at"), F.col("index").alias("level"))).alias("near"),
        F.min(F.when(F.col("period_end") >= F.col("start"), F.struct(F.lit(0).alias("off"), F.col("period_end").alias("at"), F.col("index").alias("level")))).alias("next"),
    )
    met = met.withColumn("s", F.when((F.col("label") != "INCEPTION") & (F.col("near.off") <= F.col("tolerance")), F.col("near")).otherwise(F.col("next")))
    reason = (
        F.when(F.col("start") < F.col("first"), "begins before the first valuation")
        .when(F.col("s.at") == F.col("end"), "both ends are one valuation")
        .when(F.datediff("end", "s.at") > F.col("days") + F.col("tolerance"), "valuations lie too far apart")
    )
    met = met.withColumn("reason", reason)
    usable = F.col("reason").isNull()
    return met.select("account_id", "label", F.col("end").alias("as_at"), F.when(usable, F.col("s.at")).alias("measured_from"), F.when(usable, F.try_divide("closing", F.col("s.level")) - 1).alias("twrr"), F.when(usable, "ACTUAL").otherwise("UNAVAILABLE").alias("status"), "reason")
