"""Valuations, allocation and performance of whole histories and of calendar or chosen windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import bucket_end, type_order
from ledgerloom.operators.ledger import asof_prices, running_units

#: Fixed value: valuations under which a time-weighted return counts as limited.
LEAST_VALUATIONS = 12


def valuation_history(trades: DataFrame, prices: DataFrame, granularity: str = "month") -> DataFrame:
    """Each security's units, price, quality and value at the end of every bucket in which its account traded, from its first trade on.

    Units are carried forward over the account's bucket ends by a window, prices by asof_prices. A position without
    units is worth 0, one without a price null.
    """
    end = bucket_end(F.col("trade_date"), granularity)
    last = running_units(trades).groupBy("account_id", "security_id", end.alias("on")).agg(F.max_by("held", F.struct("trade_date", type_order(F.col("type")), "event_id")).alias("held"))
    dates = last.select("account_id", "on").distinct()
    first = last.groupBy("account_id", "security_id").agg(F.min("on").alias("first"))
    grid = dates.join(first, "account_id").where(F.col("on") >= F.col("first")).drop("first")
    w = W.partitionBy("account_id", "security_id").orderBy("on").rowsBetween(W.unboundedPreceding, 0)
    units = grid.join(last, ["account_id", "security_id", "on"], "left").select("account_id", "security_id", "on", F.last("held", ignorenulls=True).over(w).alias("units"))
    at = asof_prices(units, prices)
    value = F.when(F.col("units") == 0, 0.0).otherwise(F.col("units").cast("double") * F.col("price"))
    return at.select("account_id", "security_id", "on", "units", "price", F.when(F.col("units") == 0, "NOT_HELD").otherwise(F.col("quality")).alias("quality"), value.alias("value"))


def valuation_totals(history: DataFrame) -> DataFrame:
    """An account's value at each date, null where a held security has no price, its securities and the weakest quality."""
    rank = F.when(F.col("quality") == "UNAVAILABLE", 3).when(F.col("quality") == "CARRIED_FORWARD", 2).when(F.col("quality") == "QUOTED", 1).otherwise(0)
    own = history.groupBy("account_id", "on").agg(F.sum("value").alias("sum"), F.count_if(F.col("value").isNull()).alias("unpriced"), F.count_if(F.col("units") != 0).alias("securities"), F.max(rank).alias("rank"))
    quality = F.when(F.col("rank") == 3, "UNAVAILABLE").when(F.col("rank") == 2, "CARRIED_FORWARD").when(F.col("rank") == 1, "QUOTED").otherwise("NOT_HELD")
    return own.select("account_id", "on", F.when(F.col("unpriced") == 0, F.col("sum")).alias("value"), "securities", quality.alias("quality"))


def allocation_history(history: DataFrame, by: str = "security_id") -> DataFrame:
    """Weights of each date by ``by``; null where the account's value is null or 0."""
    own = history.where("units <> 0").groupBy("account_id", "on", by).agg(F.sum("value").alias("value"))
    total = F.sum("value").over(W.partitionBy("account_id", "on"))
    return own.withColumn("weight", F.when(total != 0, F.col("value") / total))


def weight_maps(weights: DataFrame, by: str = "security_id") -> DataFrame:
    """One row a date, with a map of its weights."""
    return weights.where("weight IS NOT NULL").groupBy("account_id", "on").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "weight")))).alias("weights"))


def concentration_history(weights: DataFrame, by: str = "security_id") -> DataFrame:
    """Largest, five largest weights and the Herfindahl index of each date."""
    w = W.partitionBy("account_id", "on").orderBy(F.desc("weight"), by)
    own = weights.withColumn("k", F.row_number().over(w))
    return own.groupBy("account_id", "on").agg(F.max("weight").alias("largest"), F.sum(F.when(F.col("k") <= 5, F.col("weight"))).alias("top5"), F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.count("*").alias("holdings"))


def _chained(r: Column) -> Column:
    return F.when(F.count(r) > 0, F.product(1 + r) - 1)


def performance_window(returns: DataFrame, start: str, end: str) -> DataFrame:
    """Performance over (start, end] of periodic returns: opening and closing value, flow, gain, chained and yearly return.

    A window without whole periods has no row; a yearly return needs a positive growth and days.
    """
    own = returns.where((F.col("period_start") >= F.lit(start)) & (F.col("period_end") <= F.lit(end)))
    got = own.groupBy("account_id").agg(
        F.min("period_start").alias("start"), F.max("period_end").alias("end"), F.min_by("begin_value", "period_end").alias("opening"), F.max_by("end_value", "period_end").alias("closing"), F.sum("flow").alias("flow"),
        F.count("r").alias("measured"), F.count("*").alias("periods"), _chained(F.col("r")).alias("twrr"),
    )
    days = F.datediff("end", "start")
    year = F.when((days > 0) & (1 + F.col("twrr") > 0), F.pow(1 + F.col("twrr"), 365 / days) - 1)
    return got.withColumn("gain", F.col("closing") - F.col("opening") - F.col("flow")).withColumn("annualised", year)


def calendar_performance(returns: DataFrame, granularity: str = "year") -> DataFrame:
    """As performance_window for every calendar bucket, with the gain over the mean of both ends."""
    own = returns.groupBy("account_id", bucket_end(F.col("period_end"), granularity).alias("bucket")).agg(
        F.min_by("begin_value", "period_end").alias("opening"), F.max_by("end_value", "period_end").alias("closing"), F.sum("flow").alias("flow"), F.count("r").alias("measured"), _chained(F.col("r")).alias("twrr")
    )
    gain, mean = F.col("closing") - F.col("opening") - F.col("flow"), (F.col("opening") + F.col("closing")) / 2
    return own.withColumn("gain", gain).withColumn("gain_on_mean", F.when(mean > 0, gain / mean))


def twrr_quality(returns: DataFrame, least: int = LEAST_VALUATIONS) -> DataFrame:
    """How many periods an account has, how many could be measured, and whether that is enough."""
    own = returns.groupBy("account_id").agg(F.count("*").alias("periods"), F.count("r").alias("measured"))
    return own.withColumn("quality", F.when(F.col("measured") == 0, "NONE").when(F.col("measured") < least, "LIMITED").otherwise("FULL"))


def valuation_dates(reported: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Distinct (account_id, on) of reports, and of events where they are given."""
    return (reported if events is None else reported.union(events)).where("on IS NOT NULL").distinct()


def with_adjustments(ledger: DataFrame, corrections: DataFrame) -> DataFrame:
    """The ledger and correction events, which are marked."""
    return ledger.withColumn("is_adjustment", F.lit(False)).unionByName(corrections.withColumn("is_adjustment", F.lit(True)))


def holdings_history(history: DataFrame, security: str, start: str, end: str) -> DataFrame:
    """Stored rows of one security from ``start`` to ``end``; days that aren't stored have none."""
    return history.where((F.col("security_id") == F.lit(security)) & F.col("on").between(F.lit(start), F.lit(end)))


def source_counts(dates: DataFrame, sources: DataFrame) -> DataFrame:
    """For each (account_id, on), how many distinct documents (account_id, on, document_id) report it."""
    return dates.join(sources, ["account_id", "on"], "left").groupBy("account_id", "on").agg(F.countDistinct("document_id").alias("sources"))


def flow_events(daily: DataFrame, flows: DataFrame) -> DataFrame:
    """``daily`` (account_id, trade_date) with the day's external flows (type, amount), an empty list on others."""
    each = flows.groupBy("account_id", "trade_date").agg(F.sort_array(F.collect_list(F.struct("type", "amount"))).alias("flows"))
    return daily.join(each, ["account_id", "trade_date"], "left").withColumn("flows", F.coalesce("flows", F.array().cast(each.schema["flows"].dataType)))


def milestone_context(milestones: DataFrame, daily: DataFrame) -> DataFrame:
    """``milestones`` (account_id, milestone, on) with what the account held on that day."""
    return milestones.join(daily.withColumnRenamed("trade_date", "on"), ["account_id", "on"], "left")


def capabilities(events: DataFrame, returns: DataFrame, valuations: DataFrame) -> DataFrame:
    """Which figures an account's data allow, one row each with the reason where they don't."""
    own = events.groupBy("account_id").agg(F.count("*").alias("events"), F.count_if(F.col("type") == "SELL").alias("sells"), F.count_if(F.col("type").isin("DIVIDEND", "DISTRIBUTION", "INTEREST")).alias("incomes"), F.count_if(F.col("type").isin("DEPOSIT", "WITHDRAWAL")).alias("flows"))
    w = W.partitionBy("account_id").orderBy("on")
    gaps = valuations.select("account_id", "on").distinct().withColumn("g", F.datediff("on", F.lag("on").over(w))).groupBy("account_id").agg(F.count("*").alias("valuations"), F.min("g").alias("gap"))
    both = own.join(returns.groupBy("account_id").agg(F.count("r").alias("returns")), "account_id", "full").join(gaps, "account_id", "full").fillna(0, ["events", "sells", "incomes", "flows", "returns", "valuations"])
    needs = [
        ("cash_flow", F.col("flows") > 0, "no deposits or withdrawals"), ("realised_gains", F.col("sells") > 0, "no sells"), ("income", F.col("incomes") > 0, "no income"), ("returns", F.col("returns") > 0, "no measurable period"),
        ("volatility", F.col("returns") >= 6, "under 6 returns"), ("rolling_volatility", F.col("returns") >= 8, "under 8 returns"), ("drawdown", F.col("valuations") >= 2, "under 2 valuations"), ("best_day", F.coalesce(F.col("gap") <= 3, F.lit(False)), "valuations lie too far apart"),
    ]
    rows = F.array(*[F.struct(F.lit(name).alias("capability"), on.alias("available"), F.when(~on, why).alias("reason")) for name, on, why in needs])
    return both.select("account_id", F.inline(rows))


def content_hash(rows: DataFrame, file: Column, number: Column) -> DataFrame:
    """Identity of a file: the hash of its rows in order, each written as its sorted ``name=value`` cells; nulls are empty."""
    cells = F.array_sort(F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns]))
    line = F.sha2(F.array_join(cells, "\n"), 256)
    each = rows.select(file.alias("file"), F.struct(number.alias("k"), line.alias("h")).alias("r"))
    return each.groupBy("file").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["h"]), "\n"), 256).alias("content_hash"))


def income_daily(income: DataFrame, interest: DataFrame, securities: DataFrame) -> DataFrame:
    """Income of securities, typed by what the security is, and interest, by day (account_id, trade_date, kind, amount)."""
    kind = F.when(F.col("security_type").isin("ETF", "MANAGED_FUND"), "DISTRIBUTION").otherwise("DIVIDEND")
    own = income.join(securities.select("security_id", "security_type").dropDuplicates(["security_id"]), "security_id", "left").select("account_id", "trade_date", kind.alias("kind"), "amount")
    both = own.unionByName(interest.select("account_id", "trade_date", F.lit("INTEREST").alias("kind"), "amount"))
    return both.groupBy("account_id", "trade_date", "kind").agg(F.sum("amount").alias("amount"))
