"""Milestones of events and levels, what an account's data allow, extremes by span, weights with cash, risk against a rate, issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import bucket_end
from ledgerloom.operators.analytics import finest_gap

#: Days between an account's closest valuations up to which returns of a day, week or month may be shown.
DAY_GAP, WEEK_GAP, MONTH_GAP = 3, 10, 35


def _named(kinds: dict[str, Column]) -> Column:
    """Rows (milestone, on, value) of those structs (on, value) that aren't null."""
    rows = F.array(*[F.when(m.isNotNull(), F.struct(F.lit(k).alias("milestone"), m["on"].alias("on"), m["value"].alias("value"))) for k, m in kinds.items()])
    return F.inline(F.array_compact(rows))


def event_milestones(trades: DataFrame, cash: DataFrame) -> DataFrame:
    """First buy (what it cost), largest deposit, withdrawal and payment of a dividend or distribution of each account.

    Of equal deposits and payments the last by event_id counts, of equal withdrawals the first. A kind that an account
    doesn't have gives no row.
    """
    point = lambda amount: F.struct(F.col("trade_date").alias("on"), amount.cast("double").alias("value"))
    bought = trades.where("type = 'BUY'").groupBy("account_id").agg(F.min_by(point(F.col("gross") + F.col("fees")), F.struct("trade_date", "event_id")).alias("m"))
    rank = lambda *kinds: F.when(F.col("type").isin(*kinds), F.struct("amount", "event_id"))
    paid = point(F.col("amount"))
    largest = cash.groupBy("account_id").agg(F.max_by(paid, rank("DEPOSIT")).alias("deposit"), F.min_by(paid, rank("WITHDRAWAL")).alias("withdrawal"), F.max_by(paid, rank("DIVIDEND", "DISTRIBUTION")).alias("income"))
    of_cash = largest.select("account_id", _named({"largest deposit": F.col("deposit"), "largest withdrawal": F.col("withdrawal"), "largest income": F.col("income")}))
    return bought.select("account_id", F.lit("first buy").alias("milestone"), "m.on", "m.value").unionByName(of_cash)


def index_milestones(levels: DataFrame) -> DataFrame:
    """Largest step up and down of ``levels`` (account_id, period_end, index), in percent, over the interval that ends on ``on``.

    Steps that don't move, or start at nothing, don't count; the earliest of equal ones does. An account with one step has
    it as both.
    """
    w = W.partitionBy("account_id").orderBy("period_end")
    steps = levels.where("index IS NOT NULL").withColumn("before", F.lag("index").over(w)).where("before > 0 AND index <> before")
    change = F.col("index") / F.col("before") - 1
    step, day = F.struct(F.col("period_end").alias("on"), (100 * change).alias("value")), F.unix_date("period_end")
    got = steps.groupBy("account_id").agg(F.max_by(step, F.struct(change, -day)).alias("up"), F.min_by(step, F.struct(change, day)).alias("down"))
    return got.select("account_id", _named({"largest gain": F.col("up"), "largest loss": F.col("down")}))


def availability(events: DataFrame, holdings: DataFrame, valuations: DataFrame, benchmarks: bool = False, risk_free: float | None = None, least: int = 6) -> DataFrame:
    """All figures, one row for each account and figure: whether its data allow it, and why not.

    events: (account_id, type). holdings: a row for each security held. valuations: (account_id, on, actual, measured), a
    row for each day of its history: whether the value was really quoted, and whether the return index was measured then.
    An account is one that any of the three knows. Figures by sector, region or currency are never available: no source
    says what a security is.
    """
    own = events.groupBy("account_id").agg(F.count("*").alias("events"), F.count_if(F.col("type") == "SELL").alias("sells"), F.count_if(F.col("type").isin("DIVIDEND", "DISTRIBUTION", "INTEREST")).alias("incomes"))
    held = holdings.groupBy("account_id").agg(F.count("*").alias("held"))
    days = valuations.groupBy("account_id").agg(F.count("*").alias("days"), F.count_if("actual").alias("actual"))
    gaps = finest_gap(valuations.where("measured"), "on").withColumnRenamed("dates", "measured")
    every = reduce(lambda a, b: a.join(b, "account_id", "full"), [own, held, days, gaps]).fillna(0, ["events", "sells", "incomes", "held", "days", "actual", "measured"])
    n = F.col
    within = lambda d: F.coalesce(n("finest_gap") <= d, F.lit(False))
    fixed = lambda on: F.lit(on)
    needs = {
        "no history": (n("days") > 0, ["portfolio_value", "historical_value", "capital_gains"]),
        "no holdings": (n("held") > 0, ["holdings", "unrealised_gains", "allocation"]),
        "no transactions": (n("events") > 0, ["contributions", "withdrawals"]),
        "no income": (n("incomes") > 0, ["income", "income_yield", "income_growth"]),
        "no sells": (n("sells") > 0, ["realised_gains"]),
        "under 2 valuations": (n("actual") >= 2, ["twrr"]),
        "no transactions or no valuation": ((n("events") > 0) & (n("actual") >= 1), ["xirr"]),
        f"no valuations within {DAY_GAP} days": (within(DAY_GAP), ["daily_returns"]),
        f"no valuations within {WEEK_GAP} days": (within(WEEK_GAP), ["weekly_returns"]),
        f"no valuations within {MONTH_GAP} days": (within(MONTH_GAP), ["monthly_returns"]),
        "under 2 measured dates": (n("measured") >= 2, ["quarterly_returns", "drawdown"]),
        f"under {least} measured dates": (n("measured") >= least, ["volatility"]),
        "under 8 measured dates": (n("measured") >= 8, ["rolling_metrics"]),
        "no risk-free rate": (fixed(risk_free is not None), ["sharpe_ratio", "sortino_ratio"]),
        "no benchmark": (fixed(benchmarks), ["beta", "correlation", "benchmark_comparison"]),
        "no classification of securities": (fixed(False), ["sector_allocation", "geographic_allocation", "currency_allocation"]),
    }
    rows = [F.struct(F.lit(name).alias("capability"), on.alias("available"), F.when(~on, why).alias("reason")) for why, (on, names) in needs.items() for name in names]
    return every.select("account_id", F.inline(F.array(*rows)))


def best_worst_spans(levels: DataFrame) -> DataFrame:
    """Best and worst day, month and year of ``levels`` (account_id, on, index), flows aside; the earliest wins ties.

    A day's return is the step from the level before; days are given only where some two levels lie within DAY_GAP, else a
    reason. Months and years run from the last level before them (the first from its own first level) to their own last.
    """
    own = levels.where("index IS NOT NULL")
    w = W.partitionBy("account_id").orderBy("on")
    near = finest_gap(own, "on").select("account_id", (F.col("finest_gap") <= DAY_GAP).alias("near"))
    steps = own.select("account_id", F.lit("day").alias("span"), F.col("on").alias("period_end"), (F.try_divide("index", F.lag("index").over(w)) - 1).alias("r"))
    for span in ("month", "year"):
        ends = own.groupBy("account_id", bucket_end(F.col("on"), span).alias("period_end")).agg(F.max_by("index", "on").alias("close"), F.min_by("index", "on").alias("open"))
        before = F.coalesce(F.lag("close").over(W.partitionBy("account_id").orderBy("period_end")), F.col("open"))
        steps = steps.unionByName(ends.select("account_id", F.lit(span).alias("span"), "period_end", (F.try_divide("close", before) - 1).alias("r")))
    day = F.unix_date("period_end")
    some = F.col("r").isNotNull()  # a struct with a null in it is no null
    got = steps.groupBy("account_id", "span").agg(F.max_by("period_end", F.when(some, F.struct("r", -day))).alias("best"), F.max("r").alias("best_return"), F.min_by("period_end", F.when(some, F.struct("r", day))).alias("worst"), F.min("r").alias("worst_return"))
    far = (F.col("span") == "day") & ~F.coalesce("near", F.lit(False))
    shown = [F.when(~far, F.col(c)).alias(c) for c in got.columns[2:]]
    return got.join(near, "account_id").select("account_id", "span", *shown, F.when(far, "valuations lie too far apart").alias("reason"))


def allocation_with_cash(state: DataFrame, cash: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Weights in an account's whole value, with ``cash`` (account_id, cash; one row each, none: 0) in it.

    By security, where cash has no row of its own; with ``classes`` (security_id, asset_class; one row each, others are
    unknown) by asset class, where cash is the class cash. Null where a held security has no value, or the whole is 0.
    """
    held = state.where("units <> 0").select("account_id", "security_id", F.col("value").cast("double").alias("value"))
    each, part = held, "security_id"
    if classes is not None:
        part = "asset_class"
        known = held.join(classes.select("security_id", "asset_class"), "security_id", "left").withColumn("asset_class", F.coalesce("asset_class", F.lit("unknown")))
        each = known.select("account_id", part, "value").unionByName(cash.select("account_id", F.lit("cash").alias(part), F.col("cash").cast("double").alias("value")))
    each = each.groupBy("account_id", part).agg(F.when(F.count("value") == F.count("*"), F.sum("value")).alias("value"))
    worth = each.groupBy("account_id").agg(F.when(F.count("value") == F.count("*"), F.sum("value")).alias("total"))
    if classes is None:  # cash counts in the whole, though it has no row
        worth = worth.join(cash.select("account_id", "cash"), "account_id", "left").select("account_id", (F.col("total") + F.coalesce(F.col("cash").cast("double"), F.lit(0.0))).alias("total"))
    return each.join(worth, "account_id").select("account_id", part, "value", F.when(F.col("total") != 0, F.col("value") / F.col("total")).alias("weight"))


def risk_adjusted(returns: DataFrame, risk_free: float | None, least: int = 6, per_year: int = 4) -> DataFrame:
    """Yearly return over ``risk_free`` by volatility and by the deviation of negative returns; null, with a reason, where it can't be said.

    Without a rate neither ratio is given: none is assumed. Sharpe needs ``least`` returns that differ, Sortino two negative
    ones that differ; both a growth above 0.
    """
    r = F.col("r")
    own = returns.groupBy("account_id").agg(F.count(r).alias("observations"), F.count_if(r < 0).alias("negatives"), F.stddev_samp(r).alias("s"), F.stddev_samp(F.when(r < 0, r)).alias("d"), F.product(1 + r).alias("p"))
    year = F.when(F.col("p") > 0, F.pow("p", per_year / F.col("observations")) - 1)
    over = (lambda spread: F.lit(None).cast("double")) if risk_free is None else (lambda spread: F.when(spread > 0, (year - risk_free) / (spread * per_year**0.5)))
    common = F.when(F.lit(risk_free is None), "no risk-free rate")
    sharpe_why = common.when(F.col("observations") < least, f"under {least} returns").when(year.isNull(), "no growth to a year").when(~(F.col("s") > 0), "no deviation")
    sortino_why = common.when(F.col("negatives") < 2, "under 2 negative returns").when(year.isNull(), "no growth to a year").when(~(F.col("d") > 0), "no deviation")
    return own.select(
        "account_id", "observations", "negatives", F.when(sharpe_why.isNull(), over(F.col("s"))).alias("sharpe"), sharpe_why.alias("sharpe_reason"), F.when(sortino_why.isNull(), over(F.col("d"))).alias("sortino"), sortino_why.alias("sortino_reason")
    )


def average_capital(returns: DataFrame) -> DataFrame:
    """Mean of the positive weighted capitals of an account's periods (null without any), and how many those are."""
    capital = F.when(F.col("capital") > 0, F.col("capital"))
    return returns.groupBy("account_id").agg(F.avg(capital).alias("average_capital"), F.count(capital).alias("periods"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Issues (severity, code, document_id) by severity, by code within it and in all (nulls), with the documents to review.

    To review are those with an ERROR or WARNING; issues without a document count, but name none. A document's kinds of
    issue come together, and it counts once by code, by severity and in all: no row is written for each level.
    """
    review = F.coalesce(F.col("severity").isin("ERROR", "WARNING"), F.lit(False)) & F.col("document_id").isNotNull()
    each = issues.groupBy("severity", "code", "document_id").agg(F.count("*").alias("n")).withColumn("r", review.cast("int"))
    w = W.partitionBy("document_id").orderBy(F.desc("r"), "severity", "code")
    own = each.select("severity", "code", "n", "r", F.row_number().over(w).alias("k"), F.lag("severity").over(w).alias("last"))
    of_severity, of_all = F.when(F.col("last") == F.col("severity"), 0).otherwise(F.col("r")), F.when(F.col("k") == 1, F.col("r")).otherwise(0)
    docs = F.when(F.grouping("severity") == 1, F.sum("of_all")).when(F.grouping("code") == 1, F.sum("of_severity")).otherwise(F.sum("r"))
    return own.select("severity", "code", "n", "r", of_severity.alias("of_severity"), of_all.alias("of_all")).rollup("severity", "code").agg(F.sum("n").alias("issues"), docs.alias("documents_to_review"))
