"""Returns over overlapping windows of a daily series: time-weighted, money-weighted and Dietz, from anchors that were valued."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import bucket_end
from ledgerloom.operators.performance import rate_of
from ledgerloom.operators.periods import STANDARD_DAYS

#: What a window needs of a day.
_DAY = ["on", "value", "index", "index_as_at", "income", "fees", "status"]


def standard_windows(daily: DataFrame, as_at=None) -> DataFrame:
    """(account_id, label, start, as_at) of the standard windows up to ``as_at``, or each account's last day."""
    own = daily.groupBy("account_id").agg(F.min("on").alias("first"), F.max("on").alias("last"))
    windows = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(d).cast("int").alias("days")) for k, d in STANDARD_DAYS.items()]))
    end = F.col("last") if as_at is None else F.lit(as_at).cast("date")
    own = own.withColumn("as_at", end).where("as_at BETWEEN first AND last").select("account_id", "first", "as_at", windows.alias("w"))
    start = F.when(F.col("w.label") == "INCEPTION", F.col("first")).when(F.col("w.label") == "YTD", F.greatest(F.trunc("as_at", "year"), "first")).otherwise(F.date_sub("as_at", F.col("w.days")))
    return own.select("account_id", F.col("w.label").alias("label"), start.alias("start"), "as_at")


def _around(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """``windows`` with the days that may anchor them, found in one order of days and ends: nothing is joined by range.

    first: the account's first day; priced: its first day with an index; at: the day asked for or the next; before, after:
    the nearest valued ones (index_as_at is the day itself); worth, worth_next: the last on or before the start, and the
    next, that have a value; end: the last day up to as_at.
    """
    row = F.struct(*_DAY)
    days = daily.select("account_id", F.col("on").alias("__t"), row.alias("__d"))
    ends = windows.select("account_id", "label", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(True).alias("opens")), F.struct(F.col("as_at").alias("t"), F.lit(False).alias("opens")))).alias("__w"), "start", "as_at").select("account_id", F.col("__w.t").alias("__t"), F.struct("label", "start", "as_at", "__w.opens").alias("__a"))
    both = days.unionByName(ends, allowMissingColumns=True)
    here = F.col("__a").isNotNull().cast("int")
    up = W.partitionBy("account_id").orderBy("__t", here).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("account_id").orderBy(F.desc("__t"), here).rowsBetween(W.unboundedPreceding, 0)
    day = F.col("__d")
    valued, worth = F.when(day["index_as_at"] == day["on"], day), F.when(day["value"].isNotNull(), day)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    first = lambda c: F.first(c, ignorenulls=True).over(W.partitionBy("account_id").orderBy("__t", here).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    found = both.select("account_id", "__a", last(valued, up).alias("before"), last(worth, up).alias("worth"), last(day, up).alias("end"), last(valued, down).alias("after"), last(worth, down).alias("worth_next"), last(day, down).alias("at"), first(day["on"]).alias("first"), first(F.when(day["index"].isNotNull(), day)).alias("priced"))
    found = found.where("__a IS NOT NULL").select("account_id", "__a.*", *found.columns[2:])
    opens = lambda c: F.max(F.when(F.col("opens"), F.col(c))).alias(c)
    return found.groupBy("account_id", "label", "start", "as_at").agg(*[opens(c) for c in ("before", "after", "at", "first", "priced", "worth", "worth_next")], F.max(F.when(~F.col("opens"), F.col("end"))).alias("end"))


def _nearest() -> tuple[Column, Column, Column]:
    """The valued day nearest to the start (the earlier of two), the days asked for, and how far off an anchor may lie."""
    asked = F.greatest(F.datediff("as_at", "start"), F.lit(1))
    off = lambda c: F.abs(F.datediff(F.col(f"{c}.on"), "start"))
    near = F.when(F.col("after").isNull() | (off("before") <= off("after")), F.col("before")).otherwise(F.col("after"))
    tolerance = F.greatest(F.lit(7), F.floor(asked / 10).cast("int"))
    return F.when(F.abs(F.datediff(near["on"], "start")) <= tolerance, near), asked, tolerance


def _measured(windows: DataFrame, flows: DataFrame) -> DataFrame:
    """``windows`` (account_id, opening day ``s``, closing day ``e``, ``to``) with flow, gain and returns over (s.on, to].

    The opening value is money put in on the day ``opened``.
    An account's flows are summed by day and listed once, with prefix sums; a window takes its slice of that list, so a
    flow may belong to any number of windows. Money-weighted rates are solved for many windows at once.
    """
    by_day = flows.groupBy("account_id", "date").agg(F.sum(F.col("amount").cast("double")).alias("amount"))
    listed = by_day.groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("date", "amount"))).alias("__f"))
    own = windows.join(listed, "account_id", "left")
    inside = F.filter(F.coalesce("__f", F.array().cast("array<struct<date:date,amount:double>>")), lambda x: (x["date"] > F.col("s.on")) & (x["date"] <= F.col("to")))
    own = own.withColumn("__f", inside).withColumn("__days", F.datediff("to", "s.on"))
    total = lambda f: F.aggregate("__f", F.lit(0.0), lambda a, x: a + f(x))
    share = lambda x: F.when(F.col("__days") == 0, 1.0).otherwise(F.datediff(F.col("to"), x["date"]) / F.col("__days"))
    own = own.withColumn("flow", total(lambda x: x["amount"])).withColumn("__capital", F.col("s.value") + total(lambda x: x["amount"] * share(x)))
    own = own.withColumns({"opening": F.col("s.value"), "closing": F.col("e.value"), "income": F.col("e.income") - F.col("s.income"), "fees": F.col("e.fees") - F.col("s.fees")})
    own = own.withColumn("gain", F.col("closing") - F.col("opening") - F.col("flow"))
    over = lambda c: F.when(F.col("__capital") > 0, c / F.col("__capital"))
    own = own.withColumns({"total_return": over(F.col("gain")), "capital_return": over(F.col("gain") - F.col("income") + F.col("fees")), "income_return": over(F.col("income"))})
    own = own.withColumn("twrr", F.when((F.col("s.index") != 0) & (F.col("e.index") != 0), F.col("e.index") / F.col("s.index") - 1))
    point = lambda on, amount: F.struct(on.alias("date"), amount.cast("double").alias("amount"))
    paid = F.concat(F.when(F.col("opening") != 0, F.array(point(F.col("opened"), -F.col("opening")))).otherwise(F.array().cast("array<struct<date:date,amount:double>>")), F.transform("__f", lambda x: point(x["date"], -x["amount"])), F.array(point(F.col("to"), F.col("closing"))))
    return own.withColumn("xirr", F.when(F.col("opening").isNotNull() & F.col("closing").isNotNull(), rate_of(paid))).drop("__f", "__days", "__capital")


_FIGURES = ["opening", "closing", "flow", "gain", "income", "fees", "total_return", "capital_return", "income_return", "twrr", "xirr"]


def window_performance(daily: DataFrame, flows: DataFrame, windows: DataFrame) -> DataFrame:
    """Returns over ``windows`` (account_id, label, start, as_at) of ``daily``, where they can be measured, else why not.

    Daily rows are (account_id, on, value, index, index_as_at, income, fees, status); value and index may be null, income
    and fees are cumulative, index_as_at is the day of the valuation an index comes from. Flows are (account_id, date,
    amount), money in positive. A window opens at the valued day nearest its start, if that lies within max(7, a tenth of
    its days), else at the first day on or after its start; INCEPTION at the first day with an index. It is ESTIMATED
    where the valuations behind its ends are of other days than the ends.
    """
    near, asked, tolerance = _nearest()
    inception = F.col("label") == "INCEPTION"
    own = _around(daily, windows).withColumn("s", F.when(inception, F.coalesce("priced", "at")).otherwise(F.coalesce(near, F.col("at")))).withColumnRenamed("end", "e")
    own = own.withColumn("from", F.coalesce("s.index_as_at", "s.on")).withColumn("until", F.coalesce("e.index_as_at", "as_at"))
    reason = (
        F.when(F.col("start") < F.col("first"), "begins before the first day")
        .when(F.col("e").isNull() | (F.col("e.on") != F.col("as_at")), "no day at its end")
        .when(F.col("from") == F.col("until"), "both ends are one valuation")
        .when(F.datediff("until", "from") > asked + tolerance, "valuations lie too far apart")
        .when(F.col("s.value").isNull() | F.col("e.value").isNull(), "no value at an end")
    )
    got = _measured(own.withColumn("reason", reason).withColumns({"to": F.col("as_at"), "opened": F.col("s.on")}), flows)
    usable = F.col("reason").isNull()
    exact = (F.col("from") == F.col("s.on")) & (F.col("until") == F.col("as_at"))
    status = F.when(~usable, "UNAVAILABLE").when(exact, F.col("e.status")).otherwise("ESTIMATED")
    return got.select("account_id", "label", "as_at", F.when(usable, F.col("s.on")).alias("measured_from"), *[F.when(usable, F.col(c)).alias(c) for c in _FIGURES], status.alias("status"), "reason")


def range_overview(daily: DataFrame, flows: DataFrame, start, end) -> DataFrame:
    """As window_performance for one range that the caller chooses, which always has a row.

    It opens at the valued day nearest its start, else the last day up to it that has a value, else the first after it;
    it closes at the last day within the range. Without days in the range its figures are null.
    """
    windows = daily.select("account_id").distinct().select("account_id", F.lit("CUSTOM").alias("label"), F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("as_at"))
    near, _, _ = _nearest()
    own = _around(daily, windows).withColumn("s", F.coalesce(near, F.col("worth"), F.col("worth_next"))).withColumn("e", F.when(F.col("end.on") >= F.col("start"), F.col("end"))).drop("end")
    got = _measured(own.withColumns({"to": F.col("as_at"), "opened": F.col("s.on")}), flows)
    return got.select("account_id", F.col("s.on").alias("measured_from"), *[F.when(F.col("e").isNotNull(), F.col(c)).alias(c) for c in _FIGURES], F.coalesce("e.status", F.lit("UNAVAILABLE")).alias("status"))


def bucket_returns(daily: DataFrame, flows: DataFrame, granularity: str) -> DataFrame:
    """Time- and money-weighted returns of every calendar bucket of ``daily``: it opens with the last day before the bucket.

    The first bucket opens at nothing, at the index of its own first day. A bucket without a value at an end has no
    money-weighted return, one without an index no time-weighted one.
    """
    row, day = F.struct(*_DAY), bucket_end(F.col("on"), granularity)
    own = daily.groupBy("account_id", day.alias("period_end")).agg(F.min_by(row, "on").alias("first"), F.max_by(row, "on").alias("e"))
    w = W.partitionBy("account_id").orderBy("period_end")
    own = own.withColumn("before", F.lag("e").over(w))
    none = {"on": F.date_sub("first.on", 1), "value": F.lit(0.0), "index": F.col("first.index"), "index_as_at": F.col("first.index_as_at"), "income": F.lit(0.0), "fees": F.lit(0.0), "status": F.lit(None).cast("string")}
    kinds = {f.name: f.dataType for f in own.schema["e"].dataType}
    own = own.withColumn("prior", F.coalesce("before", F.struct(*[none[c].cast(kinds[c]).alias(c) for c in _DAY])))
    # flows count from the bucket's first day on, and what was there before it counts from that day
    own = own.withColumn("s", F.struct(F.date_sub("first.on", 1).alias("on"), *[F.col(f"prior.{c}").alias(c) for c in _DAY[1:]])).withColumns({"to": F.col("e.on"), "opened": F.col("first.on")})
    return _measured(own, flows).select("account_id", "period_end", *_FIGURES)
