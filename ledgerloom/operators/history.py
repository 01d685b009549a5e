"""Growth, high-water marks, rolling figures, benchmarks, coverage and record history, per account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import bucket_end

#: Worst last: the quality of a total is that of its weakest part.
QUALITIES = ["NOT_HELD", "QUOTED", "CARRIED_FORWARD", "UNAVAILABLE"]


def _by_date(date: str = "trade_date"):
    return W.partitionBy("account_id").orderBy(date)


def growth_series(daily: DataFrame) -> DataFrame:
    """Value, net contributions and gain of each day, with their changes since the day before (null on the first)."""
    net = (F.col("cumulative_contributions") + F.col("cumulative_withdrawals")).cast("decimal(18,2)")
    own = daily.select("account_id", "trade_date", F.col("cash").alias("value"), net.alias("net"), (F.col("cash") - net).cast("decimal(18,2)").alias("gain"))
    change = lambda c: (F.col(c) - F.lag(c).over(_by_date())).cast("decimal(18,2)")
    return own.withColumns({"net_change": change("net"), "gain_change": change("gain")})


def growth_summary(daily: DataFrame) -> DataFrame:
    """Contributed, withdrawn, net, current value and gain; gain for each net dollar where net is positive."""
    last = daily.groupBy("account_id").agg(F.max_by(F.struct("cash", "cumulative_contributions", "cumulative_withdrawals"), "trade_date").alias("s"))
    net = F.col("s.cumulative_contributions") + F.col("s.cumulative_withdrawals")
    gain = F.col("s.cash") - net
    return last.select("account_id", F.col("s.cumulative_contributions").alias("contributed"), F.col("s.cumulative_withdrawals").alias("withdrawn"), net.cast("decimal(18,2)").alias("net"), F.col("s.cash").alias("value"), gain.cast("decimal(18,2)").alias("gain"), F.when(net > 0, gain.cast("double") / net.cast("double")).alias("gain_per_dollar"))


def contribution_history(daily: DataFrame, granularity: str) -> DataFrame:
    """Cumulative contributions and withdrawals at the close of each bucket, and their change over the bucket."""
    last = daily.groupBy("account_id", bucket_end(F.col("trade_date"), granularity).alias("period_end")).agg(F.max_by(F.struct("cumulative_contributions", "cumulative_withdrawals"), "trade_date").alias("s"))
    before = F.lag("s").over(_by_date("period_end"))
    change = lambda c: (F.col(f"s.{c}") - F.coalesce(before[c], F.lit(0))).cast("decimal(18,2)")
    return last.select("account_id", "period_end", F.col("s.cumulative_contributions").alias("contributed"), F.col("s.cumulative_withdrawals").alias("withdrawn"), change("cumulative_contributions").alias("contributions"), change("cumulative_withdrawals").alias("withdrawals"))


def resample(daily: DataFrame, granularity: str, date: str = "trade_date") -> DataFrame:
    """The last row of each bucket, whole."""
    last = daily.groupBy("account_id", bucket_end(F.col(date), granularity).alias("period_end")).agg(F.max_by(F.struct(*[c for c in daily.columns if c != "account_id"]), date).alias("s"))
    return last.select("account_id", "period_end", "s.*")


def high_water_history(daily: DataFrame) -> DataFrame:
    """Highest value so far (from 0, null values skipped), the first day it was reached, days since, and the fall from it."""
    high = F.max_by(F.struct("cash", "trade_date"), F.struct("cash", -F.datediff("trade_date", F.lit("1970-01-01").cast("date")))).over(_by_date().rowsBetween(W.unboundedPreceding, 0))
    own = daily.withColumn("h", high)
    level = F.greatest(F.col("h.cash"), F.lit(0)).cast("decimal(18,2)")
    return own.select("account_id", "trade_date", F.col("cash").alias("value"), level.alias("high"), F.col("h.trade_date").alias("reached"), F.datediff("trade_date", "h.trade_date").alias("days_since"), F.when(level > 0, F.col("cash").cast("double") / level.cast("double") - 1).alias("drawdown"))


def high_water_status(daily: DataFrame) -> DataFrame:
    """The last row of each account's high-water history."""
    own = high_water_history(daily)
    return own.groupBy("account_id").agg(F.max_by(F.struct(*own.columns[1:]), "trade_date").alias("s")).select("account_id", "s.*")


def rolling_return(index: DataFrame, days: int) -> DataFrame:
    """Change of ``index`` (account_id, period_end, index) since ``days`` before: from that day or the next one that has a level.

    ``estimated`` tells the second case; null where the window begins before the series. One sort, no join.
    """
    day = F.datediff("period_end", F.lit("1970-01-01").cast("date"))
    own = index.where("index IS NOT NULL").withColumn("d", day)
    w = W.partitionBy("account_id").orderBy("d")
    start = F.first(F.struct("d", "index")).over(w.rangeBetween(-days, 0))
    whole = F.col("d") - days >= F.first("d").over(w.rowsBetween(W.unboundedPreceding, 0))
    own = own.withColumn("s", F.when(whole, start))
    return own.select("account_id", "period_end", F.try_divide("index", F.col("s.index")).alias("ratio"), (F.col("s.d") > F.col("d") - days).alias("estimated")).withColumn("ratio", F.col("ratio") - 1).withColumnRenamed("ratio", "rolling_return")


def income_growth(history: DataFrame, value: str = "gross") -> DataFrame:
    """Relative change against the bucket before; null where that isn't positive."""
    before = F.lag(value).over(_by_date("period_end"))
    return history.select("account_id", "period_end", value, F.when(before > 0, F.col(value).cast("double") / before.cast("double") - 1).alias("growth"))


def chained(returns: DataFrame) -> DataFrame:
    """Product of all measurable returns less 1 (null if there are none), and the same by year of 365 days.

    The yearly rate is null unless days and 1 + r are positive.
    """
    got = returns.groupBy("account_id").agg((F.product(1 + F.col("r")) - 1).alias("chained"), F.count("r").alias("observations"), F.datediff(F.max("period_end"), F.min("period_start")).alias("days"))
    return got.withColumn("annualised", F.when((F.col("days") > 0) & (F.col("chained") > -1), F.pow(1 + F.col("chained"), 365 / F.col("days")) - 1))


def level_returns(levels: DataFrame) -> DataFrame:
    """(account_id, period_start, period_end, r) of successive levels (account_id, period_end, index)."""
    w = _by_date("period_end")
    return levels.select("account_id", F.lag("period_end").over(w).alias("period_start"), "period_end", (F.try_divide("index", F.lag("index").over(w)) - 1).alias("r"))


def benchmark_returns(returns: DataFrame, levels: DataFrame) -> DataFrame:
    """``returns`` with the benchmark's return ``b`` over the same period, from levels (date, level) on exactly both ends.

    Nothing is carried: a period with an end that has no level has none. Pairs are aligned by period end.
    """
    one = levels.select(F.col("date").alias("period_start"), F.col("level").alias("__l0"))
    two = levels.select(F.col("date").alias("period_end"), F.col("level").alias("__l1"))
    return returns.join(one, "period_start", "left").join(two, "period_end", "left").withColumn("b", F.try_divide("__l1", "__l0") - 1).drop("__l0", "__l1")


def benchmark_risk(paired: DataFrame, least: int = 6) -> DataFrame:
    """Beta and correlation over periods with both returns; null under ``least`` of them."""
    both = paired.where("r IS NOT NULL AND b IS NOT NULL").groupBy("account_id").agg(F.count("*").alias("observations"), F.covar_samp("r", "b").alias("c"), F.var_samp("b").alias("v"), F.corr("r", "b").alias("k"))
    enough = F.col("observations") >= least
    return both.select("account_id", "observations", F.when(enough & (F.col("v") > 0), F.col("c") / F.col("v")).alias("beta"), F.when(enough, F.col("k")).alias("correlation"))


def benchmark_comparison(paired: DataFrame, methodology: str | None = None) -> DataFrame:
    """Chained return of account and benchmark over all their measurable periods, the difference, and how many have both.

    With a ``methodology`` of the benchmark also a status, and whether it's a price return, against which an account's
    total return looks better than it is.
    """
    got = paired.groupBy("account_id").agg((F.product(1 + F.col("r")) - 1).alias("portfolio"), (F.product(1 + F.col("b")) - 1).alias("benchmark"), F.count_if(F.col("r").isNotNull() & F.col("b").isNotNull()).alias("covered"), F.count("*").alias("periods"))
    got = got.withColumn("relative", F.col("portfolio") - F.col("benchmark"))
    if methodology is None:
        return got
    status = F.when(F.col("relative").isNull(), "UNAVAILABLE").otherwise("OK")
    return got.withColumn("status", status).withColumn("mismatch", (F.col("status") == "OK") & F.lit(methodology == "price_return"))


def turnover(activity: DataFrame, daily: DataFrame, method: str = "lesser") -> DataFrame:
    """The ``lesser`` of all bought and sold, or the ``total`` of both, over the mean daily value; null where that isn't positive."""
    if method not in ("lesser", "total"):
        raise ValueError(f"no turnover by {method}")
    mean = daily.groupBy("account_id").agg(F.sum("cash").alias("s"), F.count("cash").alias("n"))
    own = activity.groupBy("account_id").agg(F.sum("bought").alias("bought"), F.sum("sold").alias("sold")).join(mean, "account_id")
    value = F.col("s").cast("double") / F.col("n")
    traded = F.least("bought", "sold") if method == "lesser" else F.col("bought") + F.col("sold")
    return own.select("account_id", F.when(value > 0, traded.cast("double") / value).alias("turnover"))


def fees_by_year(cash: DataFrame, trades: DataFrame) -> DataFrame:
    """Account fees (signed sum, then its size) and brokerage by account and year."""
    one = cash.where("type = 'FEE'").select("account_id", F.year("trade_date").alias("year"), F.col("amount").alias("a"), F.lit(0).cast("decimal(18,2)").alias("b"))
    two = trades.select("account_id", F.year("trade_date").alias("year"), F.lit(0).cast("decimal(18,2)").alias("a"), F.col("fees").alias("b"))
    return one.unionByName(two).groupBy("account_id", "year").agg(F.abs(F.sum("a")).alias("account_fees"), F.sum("b").alias("brokerage"))


def unrealised_gains(state: DataFrame) -> DataFrame:
    """Value, cost, gain and gain per cost of held securities; null without a price or a cost."""
    return state.where("units <> 0").select("account_id", "security_id", "value", "cost", "unrealised", F.when(F.col("cost") != 0, F.col("unrealised") / F.col("cost")).alias("pct"))


def allocation_drift(weights: DataFrame, targets: DataFrame) -> DataFrame:
    """Weight less target of each security; null where a security has no target. Targets are one row for a security."""
    return weights.join(targets.select("security_id", "target"), "security_id", "left").select("account_id", "security_id", "weight", "target", (F.col("weight") - F.col("target")).alias("drift"))


def weakest_quality(priced: DataFrame, *keys: str) -> DataFrame:
    """The worst quality by keys."""
    rank = F.array_position(F.array(*map(F.lit, QUALITIES)), F.col("quality"))
    return priced.groupBy(*keys).agg(F.element_at(F.array(*map(F.lit, QUALITIES)), F.max(rank).cast("int")).alias("quality"))


def data_coverage(priced: DataFrame) -> DataFrame:
    """Points by quality, distinct price dates and the first and last point of each account."""
    counts = [F.count_if(F.col("quality") == q).alias(q.lower()) for q in QUALITIES[1:]]
    return priced.groupBy("account_id").agg(*counts, F.countDistinct("price_date").alias("price_dates"), F.min("on").alias("first_on"), F.max("on").alias("last_on"))


def reversal_pairs(events: DataFrame, days: int = 30, sign: int = 1) -> DataFrame:
    """Each negative event with the latest earlier positive one of the same size, at most ``days`` before.

    With ``sign`` -1 it is each positive event (a fee that is given back) with the latest negative one. One earlier event
    may be taken by several. A window over (account, size) finds it, so equal sizes make no pairs.
    """
    w = W.partitionBy("account_id", F.abs("amount")).orderBy("trade_date", "event_id").rowsBetween(W.unboundedPreceding, -1)
    prior = F.last(F.when(F.col("amount") * sign > 0, F.struct("event_id", "trade_date")), ignorenulls=True).over(w)
    got = events.withColumn("p", prior).where(F.col("amount") * sign < 0).withColumn("gap", F.datediff("trade_date", "p.trade_date")).where(F.col("gap") <= days)
    return got.select("account_id", "event_id", F.col("p.event_id").alias("reverses"), F.col("gap").alias("days"))


def activity(events: DataFrame, k: int = 200) -> DataFrame:
    """The newest ``k`` events of each account, ties by id."""
    w = W.partitionBy("account_id").orderBy(F.desc("trade_date"), "event_id")
    return events.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def slice_by_period(series: DataFrame, months: int, date: str = "trade_date") -> DataFrame:
    """Rows of the last ``months`` calendar months, counted from each account's own last date."""
    own = series.withColumn("__to", F.max(date).over(W.partitionBy("account_id")))
    return own.where(F.col(date) >= F.add_months("__to", -months)).drop("__to")


def cash_bridge(cash: DataFrame, closing: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Sum of all events against the reported closing (account_id, closing): residual and PASS, FAIL or SKIP (nothing reported)."""
    own = cash.groupBy("account_id").agg(F.sum("amount").alias("computed")).join(closing.select("account_id", "closing"), "account_id", "left")
    gap = (F.col("computed") - F.col("closing")).cast("decimal(18,2)")
    return own.select("account_id", "computed", "closing", gap.alias("residual"), F.when(gap.isNull(), "SKIP").when(F.abs(gap) <= tolerance, "PASS").otherwise("FAIL").alias("status"))


def expand_trades(trades: DataFrame) -> DataFrame:
    """Two rows for a trade: itself, and the transfer of its net amount (buys out, sells in)."""
    net = F.when(F.col("type") == "SELL", F.col("gross") - F.col("fees")).otherwise(-(F.col("gross") + F.col("fees"))).cast("decimal(18,2)")
    none = F.lit(None)
    two = F.array(
        F.struct(F.col("type").alias("type"), F.col("security_id").alias("security_id"), F.col("units").alias("units"), none.cast("decimal(18,2)").alias("amount")),
        F.struct(F.lit("TRANSFER").alias("type"), none.cast("string").alias("security_id"), none.cast("decimal(18,2)").alias("units"), net.alias("amount")),
    )
    return trades.select("account_id", "event_id", "trade_date", F.explode(two).alias("e")).select("account_id", "event_id", "trade_date", "e.*")


def assign_ordinals(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Number, from 0, of a row among those with equal keys."""
    return rows.withColumn("ordinal", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def canonical_source(sources: DataFrame) -> DataFrame:
    """The earliest document (null dates last, then its id) of each record, and how many show it."""
    w = W.partitionBy("record_id").orderBy(F.asc_nulls_last("period_end"), "document_id")
    n = sources.groupBy("record_id").agg(F.countDistinct("document_id").alias("documents"))
    return sources.withColumn("k", F.row_number().over(w)).where("k = 1").select("record_id", "document_id", "period_end").join(n, "record_id")


def missing_quarters(dates: DataFrame, *keys: str, date: str = "trade_date") -> DataFrame:
    """Quarter ends between the first and last date of each account (and of further keys) without any."""
    by, end = ["account_id", *keys], bucket_end(F.col(date), "quarter")
    own = dates.select(*by, end.alias("period_end")).distinct()
    span = own.groupBy(*by).agg(F.min("period_end").alias("a"), F.max("period_end").alias("b")).select(*by, F.explode(F.expr("sequence(trunc(a, 'quarter'), trunc(b, 'quarter'), interval 3 month)")).alias("q"))
    return span.select(*by, bucket_end(F.col("q"), "quarter").alias("period_end")).join(own, [*by, "period_end"], "left_anti")


def issues_by_code(*checks: DataFrame) -> DataFrame:
    """Issue counts by code over the outputs of several checks."""
    one, *rest = [c.select("code") for c in checks]
    for c in rest:
        one = one.unionByName(c)
    return one.groupBy("code").agg(F.count("*").alias("issues"))


def check_totals(parts: DataFrame, reported: DataFrame, key: str, tolerance: Column | float = 0.05) -> DataFrame:
    """Sums of ``parts`` (key, amount) that differ from what is reported (key, total) by more than ``tolerance``."""
    own = parts.groupBy(key).agg(F.sum("amount").alias("computed")).join(reported.select(key, "total"), key)
    return own.where(F.abs(F.col("computed") - F.col("total")) > tolerance).select(key, "computed", "total", F.lit("TOTAL_MISMATCH").alias("code"))


def drawdown_analytics(episodes: DataFrame) -> DataFrame:
    """Worst and average depth, count, longest time under water (peak to recovery) and fastest recovery (trough to recovery)."""
    return episodes.groupBy("account_id").agg(F.min("depth").alias("worst"), F.avg("depth").alias("average"), F.count("*").alias("episodes"), F.max(F.datediff("recovery", "peak")).alias("longest_days"), F.min("recovery_days").alias("fastest_days"))
