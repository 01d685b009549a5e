"""Canonical ledgers: transactions as stored, with the code of their security."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_codes(transactions: DataFrame, securities: DataFrame) -> DataFrame:
    """``transactions`` with the code and name of their security (security_id, code, name; one row each), null where there is none.

    Rows without a security, such as those of cash, and of one that isn't known stay; columns called code or name give way.
    """
    kept = [c for c in transactions.columns if c not in ("code", "name")]
    return transactions.select(kept).join(securities.select("security_id", "code", "name"), "security_id", "left").select(*kept, "code", "name")


def read_ledger(spark: SparkSession, transactions: str, securities: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The stored ledger at the Parquet paths ``transactions`` and ``securities``, of trade dates after ``since`` up to ``until``.

    Dates are compared in the scan, so that files and row groups outside them aren't read.
    """
    own = spark.read.parquet(transactions)
    if since is not None:
        own = own.where(F.col("trade_date") > F.lit(since).cast("date"))
    if until is not None:
        own = own.where(F.col("trade_date") <= F.lit(until).cast("date"))
    return with_codes(own, spark.read.parquet(securities))
