"""Attribution of growth to securities, income and costs over a window, and its reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _sum(what: Column, on: Column) -> Column:
    """Decimals are summed as such: what cancels to nothing is 0 in any order of rows, and no rest that a ratio is taken over."""
    return F.coalesce(F.sum(F.when(on, what)).cast("double"), F.lit(0.0))


def _total(state: DataFrame, prefix: str) -> DataFrame:
    return state.groupBy("account_id").agg(F.sum("value").alias(f"{prefix}_value"), F.sum(F.coalesce("unrealised", F.lit(0.0))).alias(f"{prefix}_unrealised"), F.sum("realised").alias(f"{prefix}_realised"))


def growth_decomposition(begin: DataFrame, finish: DataFrame, events: DataFrame) -> DataFrame:
    """By account, what changed between two states: capital gains, income by kind, fees, taxes, external flows.

    ``events`` (account_id, type, amount, fees) are those of (start, end]. Fees are the magnitude of the signed sum of fee
    rows, so a reversal cancels its charge, less the brokerage that trades carry, which cost bases hold already.
    """
    kinds = F.col("type")
    sums = events.groupBy("account_id").agg(
        _sum(F.col("amount"), kinds == "DIVIDEND").alias("dividends"), _sum(F.col("amount"), kinds == "DISTRIBUTION").alias("distributions"), _sum(F.col("amount"), kinds == "INTEREST").alias("interest"),
        F.abs(_sum(F.col("amount"), kinds == "TAX")).alias("taxes"), _sum(F.col("amount"), kinds.isin("OTHER", "CORPORATE_ACTION")).alias("other"), _sum(F.col("amount"), kinds.isin("DEPOSIT", "WITHDRAWAL")).alias("external"),
        F.abs(_sum(F.col("amount"), kinds == "FEE")).alias("all_fees"), _sum(F.abs("fees"), kinds.isin("BUY", "SELL")).alias("trade_costs"),
    )
    both = _total(finish, "end").join(_total(begin, "begin"), "account_id", "full").join(sums, "account_id", "full").fillna(0.0)
    gains = F.col("end_unrealised") - F.col("begin_unrealised") + F.col("end_realised") - F.col("begin_realised")
    return both.select("account_id", gains.alias("capital_gains"), "dividends", "distributions", "interest", (F.col("all_fees") - F.col("trade_costs")).alias("fees"), "trade_costs", "taxes", "other", "external")


def average_capital(begin: DataFrame, finish: DataFrame, flows: DataFrame, start: str, end: str) -> DataFrame:
    """By account, opening value plus day-weighted external flows (date, amount) of (start, end]; the mean of both ends where that isn't positive."""
    days = F.datediff(F.lit(end), F.lit(start))
    weight = F.when(days == 0, 1.0).otherwise(F.datediff(F.lit(end), "date") / days)
    flow = flows.where((F.col("date") > F.lit(start)) & (F.col("date") <= F.lit(end))).groupBy("account_id").agg(F.sum(F.col("amount").cast("double") * weight).alias("weighted"))
    both = _total(finish, "end").join(_total(begin, "begin"), "account_id", "full").join(flow, "account_id", "left").fillna(0.0)
    capital = F.col("begin_value") + F.col("weighted")
    return both.select("account_id", F.when(capital > 0, capital).otherwise((F.col("begin_value") + F.col("end_value")) / 2).alias("average_capital"))


def security_attribution(begin: DataFrame, finish: DataFrame, events: DataFrame, capital: DataFrame) -> DataFrame:
    """Each security held at either end: its gain over what was at risk in it, its weight and its share of the account's return.

    Gain is closing less opening value, less purchases, plus sales; its own return is over the opening value and half of
    the net purchases, and null where that isn't positive.
    """
    key = ["account_id", "security_id"]
    pick = lambda s, p: s.select(*key, F.col("value").alias(f"{p}_value"), F.col("realised").alias(f"{p}_realised"), F.coalesce("unrealised", F.lit(0.0)).alias(f"{p}_unrealised"))
    kinds = F.col("type")
    flows = events.groupBy(*key).agg(_sum(F.col("amount"), kinds == "BUY").alias("purchases"), _sum(F.abs("amount"), kinds == "SELL").alias("sales"), _sum(F.col("amount"), kinds.isin("DIVIDEND", "DISTRIBUTION")).alias("income"))
    both = pick(begin, "begin").join(pick(finish, "end"), key, "full").join(flows, key, "left").fillna(0.0).join(capital, "account_id", "left")
    gain = F.col("end_value") - F.col("begin_value") - F.col("purchases") + F.col("sales")
    at_risk = F.col("begin_value") + F.col("purchases") / 2 - F.col("sales") / 2
    profit = F.col("end_realised") - F.col("begin_realised") + F.col("end_unrealised") - F.col("begin_unrealised") + F.col("income")
    share = lambda x: F.when(F.col("average_capital") > 0, x / F.col("average_capital"))
    return both.select(*key, F.col("begin_value").alias("opening_value"), F.col("end_value").alias("closing_value"), gain.alias("capital_gain"), "income", F.when(at_risk > 0, (gain + F.col("income")) / at_risk).alias("total_return"), share((F.col("begin_value") + F.col("end_value")) / 2).alias("weight"), share(profit).alias("contribution"))


def profit_attribution(state: DataFrame, income: DataFrame, cash: DataFrame, capital: DataFrame) -> DataFrame:
    """Profit of each security (realised, unrealised, income) and of cash (interest less fees), ranked within the account.

    ``income`` has (account_id, security_id, income), ``cash`` (account_id, interest, fees), ``capital`` average_capital.
    """
    key = ["account_id", "security_id"]
    own = state.select(*key, (F.col("realised") + F.coalesce("unrealised", F.lit(0.0))).alias("gain")).join(income, key, "left")
    rows = own.select("account_id", F.col("security_id").alias("code"), (F.col("gain") + F.coalesce("income", F.lit(0.0))).alias("profit"))
    rows = rows.unionByName(cash.select("account_id", F.lit("Cash").alias("code"), (F.col("interest") - F.col("fees")).alias("profit"))).join(capital, "account_id", "left")
    by = W.partitionBy("account_id").orderBy(F.desc("profit"), "code")
    return rows.select("account_id", "code", "profit", F.when(F.col("average_capital") > 0, F.col("profit") / F.col("average_capital")).alias("share"), F.row_number().over(by).alias("rank"))


def return_decomposition(parts: DataFrame, capital: DataFrame) -> DataFrame:
    """growth_decomposition over average capital: capital, income and fee returns and their sum; null where nothing was at risk."""
    own = parts.join(capital, "account_id", "left")
    income = F.col("dividends") + F.col("distributions") + F.col("interest")
    share = lambda x: F.when(F.col("average_capital") > 0, x / F.col("average_capital"))
    return own.select("account_id", share(F.col("capital_gains")).alias("capital_return"), share(income).alias("income_return"), share(F.col("fees")).alias("fee_drag"), share(F.col("capital_gains") + income - F.col("fees")).alias("total_return"))


def reconciled(checks: DataFrame, attributed: str, actual: str, tolerance: float) -> DataFrame:
    """``checks`` with residual and status: PASS within the tolerance, FAIL beyond, LIMITED where either side is unknown."""
    residual = F.col(attributed) - F.col(actual)
    return checks.withColumn("residual", residual).withColumn("status", F.when(residual.isNull(), "LIMITED").when(F.abs(residual) <= tolerance, "PASS").otherwise("FAIL"))


def gains_by_security(disposals: DataFrame) -> DataFrame:
    """Units, proceeds, cost and gain of each security's sells, best first."""
    own = disposals.groupBy("account_id", "security_id").agg(F.sum("sold").alias("units"), F.sum(F.col("gain") + F.col("allocated")).alias("proceeds"), F.sum("allocated").alias("cost"), F.sum("gain").alias("gain"))
    return own.withColumn("rank", F.row_number().over(W.partitionBy("account_id").orderBy(F.desc("gain"), "security_id")))


def gain_attribution(state: DataFrame, income: DataFrame) -> DataFrame:
    """By account, the parts of its gain that don't overlap: unrealised, realised and income (account_id, income)."""
    own = state.groupBy("account_id").agg(F.sum(F.coalesce("unrealised", F.lit(0.0))).alias("unrealised"), F.sum("realised").alias("realised"))
    return own.join(income, "account_id", "full").fillna(0.0).withColumn("total", F.col("unrealised") + F.col("realised") + F.col("income"))


def fees_by_security(trades: DataFrame) -> DataFrame:
    """Brokerage, what was traded and their ratio, of each security."""
    own = trades.groupBy("account_id", "security_id").agg(F.sum("fees").alias("brokerage"), F.sum("gross").alias("traded"), F.count("*").alias("trades"))
    return own.withColumn("rate", F.try_divide(F.col("brokerage").cast("double"), F.col("traded").cast("double")))


def fee_summary(trades: DataFrame, fees: DataFrame, values: DataFrame) -> DataFrame:
    """By account, brokerage, account fees (account_id, amount: signed) and their ratio to the mean value (account_id, value)."""
    own = trades.groupBy("account_id").agg(F.sum("fees").cast("double").alias("brokerage"))
    account = fees.groupBy("account_id").agg(F.abs(F.sum("amount")).cast("double").alias("account_fees"))
    mean = values.groupBy("account_id").agg(F.avg("value").alias("mean_value"))
    both = own.join(account, "account_id", "full").fillna(0.0).join(mean, "account_id", "left")
    return both.withColumn("ratio", F.when(F.col("mean_value") > 0, (F.col("brokerage") + F.col("account_fees")) / F.col("mean_value")))


def efficiency_metrics(parts: DataFrame, values: DataFrame) -> DataFrame:
    """growth_decomposition over net contributions and mean value: income, gain and fee ratios, and income's share of the gain; null over nothing."""
    mean = values.groupBy("account_id").agg(F.avg("value").alias("mean_value"))
    income = F.col("dividends") + F.col("distributions") + F.col("interest")
    gain = F.col("capital_gains") + income - F.col("fees") - F.col("taxes")
    over = lambda x, y: F.when(y > 0, x / y)
    own = parts.join(mean, "account_id", "left")
    return own.select("account_id", over(income, F.col("external")).alias("income_on_contributions"), over(gain, F.col("external")).alias("gain_on_contributions"), over(F.col("fees"), F.col("mean_value")).alias("fees_on_value"), over(income, gain).alias("income_share"))


def income_by_class(income: DataFrame, classes: DataFrame, bucket: Column) -> DataFrame:
    """Income (account_id, security_id, trade_date, amount) by bucket and asset class (security_id, asset_class); unknown where it isn't given."""
    own = income.join(classes.select("security_id", "asset_class").dropDuplicates(["security_id"]), "security_id", "left")
    return own.groupBy("account_id", bucket.alias("period_end"), F.coalesce("asset_class", F.lit("unknown")).alias("asset_class")).agg(F.sum("amount").alias("income"))


def income_yield(income: DataFrame, values: DataFrame, *keys: str) -> DataFrame:
    """Income over the mean of the values that are known (keys, value), and how many of its days they are: ACTUAL if all, else ESTIMATED."""
    own = income.groupBy(*keys).agg(F.sum("amount").cast("double").alias("income"))
    mean = values.groupBy(*keys).agg(F.avg("value").alias("mean_value"), F.count("value").alias("known"), F.count("*").alias("days"))
    both = own.join(mean, [*keys], "full").fillna(0.0, ["income"])
    return both.select(*keys, "income", "mean_value", F.when(F.col("mean_value") > 0, F.col("income") / F.col("mean_value")).alias("yield"), F.when(F.col("known") == F.col("days"), "ACTUAL").otherwise("ESTIMATED").alias("quality"))
