"""Income of an account with its tax figures, and reported figures held against calculated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how far a reported figure may lie from the calculated one.
TOLERANCE = 0.05


def income_summary(income: DataFrame, interest: DataFrame, trust_tax: DataFrame) -> DataFrame:
    """By account: gross, net and grossed-up income, tax withheld, franking credits of dividends and of trusts.

    ``income`` (account_id, amount, franking, withheld) are payments; ``interest`` (account_id, amount); ``trust_tax``
    (account_id, franking) yearly credits of trust distributions. Credits are no cash: they are in the grossed-up income
    alone. Each is summed on its own, so the three meet as one row an account.
    """
    parts = [
        income.groupBy("account_id").agg(F.sum("amount").alias("paid"), F.sum("withheld").alias("withheld"), F.sum("franking").alias("dividend_franking")),
        interest.groupBy("account_id").agg(F.sum("amount").alias("interest")),
        trust_tax.groupBy("account_id").agg(F.sum("franking").alias("trust_franking")),
    ]
    names = ["paid", "withheld", "dividend_franking", "interest", "trust_franking"]
    met = parts[0].join(parts[1], "account_id", "full").join(parts[2], "account_id", "full").select("account_id", *[F.coalesce(c, F.lit(0)).cast("decimal(28,2)").alias(c) for c in names])
    gross, franking = F.col("paid") + F.col("interest"), F.col("dividend_franking") + F.col("trust_franking")
    return met.select("account_id", gross.alias("gross"), "interest", "withheld", (gross - F.col("withheld")).alias("net"), "dividend_franking", "trust_franking", franking.alias("franking"), (gross + franking).alias("grossed_up"), (franking > 0).alias("franking_available"))


def reported_reconciliation(reported: DataFrame, reported_units: DataFrame, states: DataFrame, state_units: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Checks (account_id, on, what, security_id, reported, calculated, difference, status) of every reported day.

    ``reported`` (account_id, on, value, cash, accrued) against ``states`` (account_id, on, value, cash): the calculated
    value takes on income that is accrued but not yet paid. Cash is checked where it is reported. ``reported_units``
    against ``state_units`` (account_id, on, security_id, units), for securities of either side; one that a side lacks
    has no units there. PASS within ``tolerance``, SKIP where a figure is null. Both sides are unpivoted to one figure a
    row and meet in one grouping; of a day reported twice the highest figures count.
    """
    days = reported.select("account_id", "on").distinct()
    number = lambda c: F.col(c).cast("double")
    both = lambda value, cash, more: F.explode(F.array(F.struct(F.lit("value").alias("what"), value.alias("x"), more.alias("more")), F.struct(F.lit("cash").alias("what"), cash.alias("x"), F.lit(0.0).alias("more"))))
    units = lambda d, x: d.join(days, ["account_id", "on"], "left_semi").groupBy("account_id", "on", F.lit("units").alias("what"), "security_id").agg(F.sum(number("units")).alias(x))
    none, keys = F.lit(None).cast("string").alias("security_id"), ["account_id", "on", "what", "security_id"]
    said = reported.select("account_id", "on", both(number("value"), number("cash"), F.coalesce(number("accrued"), F.lit(0.0))).alias("r")).where("r.what = 'value' OR r.x IS NOT NULL")
    said = said.select("account_id", "on", "r.what", none, F.col("r.x").alias("reported"), F.col("r.more").alias("more")).unionByName(units(reported_units, "reported").withColumn("more", F.lit(0.0)))
    done = states.select("account_id", "on", both(number("value"), number("cash"), F.lit(0.0)).alias("r")).select("account_id", "on", "r.what", none, F.col("r.x").alias("calculated")).join(days, ["account_id", "on"], "left_semi")
    done = done.unionByName(units(state_units, "calculated"))
    both_sides = said.withColumn("asked", F.lit(True)).unionByName(done.withColumn("asked", F.lit(False)), allowMissingColumns=True)
    met = both_sides.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("reported", "calculated", "more", "asked")])
    met = met.where("asked OR what = 'units'")
    of_units = F.col("what") == "units"
    reported_, calculated = (F.when(of_units, F.coalesce(c, F.lit(0.0))).otherwise(F.col(c)) for c in ("reported", "calculated"))
    met = met.select(*keys, reported_.alias("reported"), (calculated + F.coalesce("more", F.lit(0.0))).alias("calculated")).withColumn("difference", F.round(F.col("calculated") - F.col("reported"), 6))
    status = F.when(F.col("difference").isNull(), "SKIP").when(F.abs("difference") <= tolerance, "PASS").otherwise("FAIL")
    return met.withColumn("status", status)


def reconciliation_counts(checks: DataFrame) -> DataFrame:
    """Checks by account: how many, and how many of each status."""
    return checks.groupBy("account_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("PASS", "passed"), ("FAIL", "failed"), ("SKIP", "skipped"))])
