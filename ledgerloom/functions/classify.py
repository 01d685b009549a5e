"""Column functions that classify cash rows, trades, incomes and securities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of cash descriptions, the first that is found gives the type.
CASH_RULES = [
    (r"\b(opening|closing) balance\b", "OTHER"),
    (r"transaction fee|account fee|brokerage|admin\s*charge|adminchargebyvalue", "FEE"),
    (r"withholding tax|tax withheld", "TAX"),
    (r"^\s*DIV\s*:", "DISTRIBUTION"),
    (r"\bdistribution\b", "DISTRIBUTION"),
    (r"\bdividend\b", "DIVIDEND"),
    (r"\binterest\b", "INTEREST"),
    (r"failed direct debit|dishonour", "DEPOSIT"),
    (r"\bwithdrawal\b|\bpayment to\b", "WITHDRAWAL"),
    (r"\bdeposit\b|\bcontribution\b|\bfunds received\b", "DEPOSIT"),
    (r"\b(sell|buy) transaction of\b", "TRANSFER"),
    (r"\btransfer\b", "TRANSFER"),
    (r"\bsplit\b|\bconsolidation\b|\bcorporate action\b", "CORPORATE_ACTION"),
]
#: Security types of statement headings, and asset classes of security types.
HEADING_TYPES = {"etf": "ETF", "australian_share": "SHARE", "managed_fund": "MANAGED_FUND", "cash": "CASH"}
CLASS_OF_TYPE = {"SHARE": "australian_equities", "CASH": "cash"}


def classify_cash(description: Column) -> Column:
    """Event type of a cash row's description; OTHER where no rule fits, null for null."""
    kind = F.when(description.isNull(), None)
    for pattern, name in CASH_RULES:
        kind = kind.when(description.rlike(f"(?i){pattern}"), name)
    return kind.otherwise("OTHER")


def is_balance_marker(description: Column) -> Column:
    """Whether a row only states an opening or closing balance."""
    return F.coalesce(description.rlike(f"(?i){CASH_RULES[0][0]}"), F.lit(False))


def classify_trade(units: Column, description: Column) -> Column:
    """BUY or SELL by the sign of units, else by words of the description, else OTHER."""
    words = F.lower(F.coalesce(description, F.lit("")))
    return F.when(units < 0, "SELL").when(units > 0, "BUY").when(words.rlike("sold|sell"), "SELL").when(words.rlike("bought|buy"), "BUY").otherwise("OTHER")


def security_type(heading: Column, name: Column) -> Column:
    """Type by statement heading, else by the name, else SHARE."""
    known = F.when(F.lit(False), None)
    for h, kind in HEADING_TYPES.items():
        known = known.when(heading == h, kind)
    words = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(known, F.when(words.contains("etf"), "ETF").when(words.contains("fund"), "MANAGED_FUND").otherwise("SHARE"))


def income_type_for(kind: Column) -> Column:
    """Funds distribute, companies pay dividends."""
    return F.when(kind.isin("ETF", "MANAGED_FUND"), "DISTRIBUTION").otherwise("DIVIDEND")


def strip_deposit_source(description: Column, kind: Column) -> Column:
    """A deposit's description without its trailing clause of where it came from."""
    return F.when(kind == "DEPOSIT", F.trim(F.regexp_replace(description, r"(?s)\s+-\s+.+$", ""))).otherwise(description)


def classify_asset(securities: DataFrame, classes: DataFrame) -> DataFrame:
    """``securities`` (code, type, ...) with asset_class: by code from ``classes`` (code, asset_class), else by type, else unknown."""
    own = classes.select("code", F.col("asset_class").alias("__class")).dropDuplicates(["code"])
    by_type = F.when(F.lit(False), None)
    for kind, name in CLASS_OF_TYPE.items():
        by_type = by_type.when(F.col("type") == kind, name)
    return securities.join(own, "code", "left").withColumn("asset_class", F.coalesce("__class", by_type, F.lit("unknown"))).drop("__class")
