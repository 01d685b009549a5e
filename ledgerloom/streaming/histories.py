"""Histories that a stream of events extends: state by account, late rows replayed from their day."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators.ledger import EXTERNAL

#: A day's figures: cents of cash and of its highest value so far, return index and its highest value so far.
_FIGURES = "cash bigint, high bigint, index double, index_high double"
_STATE = "days array<int>, net array<bigint>, external array<bigint>, cash array<bigint>, high array<bigint>, index array<double>, index_high array<double>"


def _daily(events: DataFrame) -> DataFrame:
    cents = F.round(F.col("amount") * 100).cast("long")
    return events.where("account_id IS NOT NULL AND trade_date IS NOT NULL AND amount IS NOT NULL").select(F.col("account_id").cast("long").alias("account_id"), F.unix_date("trade_date").alias("day"), cents.alias("net"), F.when(F.col("type").isin(*EXTERNAL), cents).otherwise(F.lit(0).cast("long")).alias("external"))


def cash_history(events: DataFrame) -> DataFrame:
    """(account_id, on, cash, high, index, index_high) of every day with events, built from all of them at once.

    The index starts at 100 and grows by what a day adds to the cash before it, money put in or taken out aside; it stands
    still while there is none. Rows with a null account, day or amount take no part.
    """
    days = _daily(events).groupBy("account_id", "day").agg(F.sum("net").alias("net"), F.sum("external").alias("external"))
    w = W.partitionBy("account_id").orderBy("day")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    own = days.withColumn("cash", F.sum("net").over(upto)).withColumn("before", F.col("cash") - F.col("net"))
    own = own.withColumn("growth", F.when(F.col("before") > 0, 1 + (F.col("net") - F.col("external")) / F.col("before")).otherwise(1.0))
    own = own.withColumn("index", 100 * F.product("growth").over(upto)).withColumn("high", F.greatest(F.lit(0), F.max("cash").over(upto))).withColumn("index_high", F.greatest(F.lit(100.0), F.max("index").over(upto)))
    return own.select("account_id", F.date_from_unix_date("day").alias("on"), "cash", "high", "index", "index_high")


def _extended(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Adds an account's arrived events to its days and replays the days from the first of them on, out of what the day before it carries."""
    kinds = (np.int64,) * 5 + (float,) * 2
    days, net, external, cash, high, index, index_high = (np.array(x, k) for x, k in zip(state.get if state.exists else ([],) * 7, kinds, strict=True))
    new = pd.concat(list(batches)).groupby("day")[["net", "external"]].sum()
    at = int(np.searchsorted(days, new.index.min()))
    late = pd.DataFrame({"net": net[at:], "external": external[at:]}, index=days[at:]).add(new, fill_value=0).sort_index().astype(np.int64)
    now = (int(cash[at - 1]), int(high[at - 1]), float(index[at - 1]), float(index_high[at - 1])) if at else (0, 0, 100.0, 100.0)
    rows = []
    for n, x in zip(late["net"].tolist(), late["external"].tolist(), strict=True):
        level = now[2] * (1 + (n - x) / now[0]) if now[0] > 0 else now[2]
        now = (now[0] + n, max(now[1], now[0] + n), level, max(now[3], level))
        rows.append(now)
    done = list(zip(*rows, strict=True))
    old = (cash, high, index, index_high)
    state.update((*([*a[:at].tolist(), *b.tolist()] for a, b in zip((days, net, external), (late.index.to_numpy(), late["net"].to_numpy(), late["external"].to_numpy()), strict=True)), *([*a[:at].tolist(), *b] for a, b in zip(old, done, strict=True))))
    yield pd.DataFrame({"account_id": key[0], "day": late.index.to_numpy(), **dict(zip(("cash", "high", "index", "index_high"), done, strict=True))})


def stream_history(spark: SparkSession, events: DataFrame, store: str, checkpoint: str) -> None:
    """Extend the history in ``store`` by all events of the stream that have arrived; late ones are never dropped.

    The state of an account are its days with their sums and figures. A batch reads the state of its own accounts alone,
    replays each from its first changed day, and writes the replayed rows to a partition of its own number, which is
    replaced if the batch runs again. ``latest`` tells which rows count: it equals cash_history of all events so far.
    """
    out = _daily(events).groupBy("account_id").applyInPandasWithState(_extended, f"account_id bigint, day int, {_FIGURES}", _STATE, "update", GroupStateTimeout.NoTimeout)

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{store}/batch={number}")

    out.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(store: DataFrame) -> DataFrame:
    """Of a store of stream_history the rows that count: of each account's day those of the latest batch that replayed it."""
    own = store.groupBy("account_id", "day").agg(F.max_by(F.struct("cash", "high", "index", "index_high"), "batch").alias("x"))
    return own.select("account_id", F.date_from_unix_date("day").alias("on"), "x.*")
