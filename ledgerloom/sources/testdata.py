"""Ledger views of the given tables: trades from lineitem, cash events from events, prices from trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.shared import stored

TRADES_SQL = """
    SELECT (o_custkey % 50)::INTEGER AS account_id, p_brand AS security_id, l_shipdate::DATE AS trade_date,
           CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS type, l_quantity::DECIMAL(18,2) AS units, l_extendedprice::DECIMAL(18,2) AS gross,
           round(l_extendedprice::DECIMAL(18,2) * l_tax::DECIMAL(4,2), 2)::DECIMAL(18,2) AS fees,
           concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT, round(l_extendedprice * 100)::BIGINT, l_returnflag) AS event_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""
CASH_SQL = """
    SELECT user_id AS account_id, ts::DATE AS trade_date, event_id,
           CASE event_type WHEN 'purchase' THEN 'DEPOSIT' WHEN 'click' THEN 'WITHDRAWAL' WHEN 'view' THEN CASE WHEN event_id % 4 = 0 THEN 'DISTRIBUTION' ELSE 'DIVIDEND' END WHEN 'signup' THEN 'INTEREST' ELSE 'FEE' END AS type,
           (CASE WHEN event_type IN ('click', 'error') THEN -1 ELSE 1 END * value::DECIMAL(18,2))::DECIMAL(18,2) AS amount
    FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey")).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey"))
    gross = F.col("l_extendedprice").cast("decimal(18,2)")
    return own.select(
        (F.col("o_custkey") % 50).cast("int").alias("account_id"), F.col("p_brand").alias("security_id"), F.to_date("l_shipdate").alias("trade_date"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("type"),
        F.col("l_quantity").cast("decimal(18,2)").alias("units"), gross.alias("gross"), F.round(gross * F.col("l_tax").cast("decimal(4,2)"), 2).cast("decimal(18,2)").alias("fees"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long"), "l_returnflag").alias("event_id"),
    )


def stored_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades in a table of their own, for queries that read them several times."""
    return stored(trades(spark, sf_dir))


def cash_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "DEPOSIT").when(F.col("event_type") == "click", "WITHDRAWAL").when((F.col("event_type") == "view") & (F.col("event_id") % 4 == 0), "DISTRIBUTION").when(F.col("event_type") == "view", "DIVIDEND").when(F.col("event_type") == "signup", "INTEREST").otherwise("FEE")
    sign = F.when(F.col("event_type").isin("click", "error"), -1).otherwise(1)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("account_id"), F.to_date("ts").alias("trade_date"), "event_id", kind.alias("type"), (sign * F.col("value").cast("decimal(18,2)")).cast("decimal(18,2)").alias("amount"))


def prices(trades: DataFrame) -> DataFrame:
    """Month-end prices of the last trade of each security and month: (security_id, price_date, price)."""
    last = trades.groupBy("security_id", F.last_day("trade_date").alias("price_date")).agg(F.max_by(F.struct("gross", "units"), F.struct("trade_date", "event_id")).alias("t"))
    # halves of the last place, which rounding errors would settle either way, go up
    return last.select("security_id", "price_date", F.round(F.col("t.gross").cast("double") / F.col("t.units").cast("double") + 1e-8, 6).alias("price"))
