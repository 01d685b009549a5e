"""Cash, positions, cost basis, as-of prices and portfolio states, per account."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import type_order

EXTERNAL, INCOME = ("DEPOSIT", "WITHDRAWAL"), ("DIVIDEND", "DISTRIBUTION", "INTEREST")


def sum_of(*types: str, amount: str = "amount") -> Column:
    return F.coalesce(F.sum(F.when(F.col("type").isin(*types), F.col(amount))), F.lit(0).cast("decimal(18,2)"))


def cash_flows(cash: DataFrame, *keys: str) -> DataFrame:
    """Deposits, withdrawals (negative), income, fees, net and external net by keys."""
    return cash.groupBy(*keys).agg(sum_of("DEPOSIT").alias("deposits"), sum_of("WITHDRAWAL").alias("withdrawals"), sum_of(*INCOME).alias("income"), sum_of("FEE").alias("fees"), F.sum("amount").alias("net"), sum_of(*EXTERNAL).alias("external_net"))


def ledger_slice(ledger: DataFrame, after=None, to=None, types: tuple[str, ...] | None = None, security: str | None = None) -> DataFrame:
    """Events of the half-open interval (after, to], of given types and one security."""
    for on, what in ((after, F.col("trade_date") > F.lit(after)), (to, F.col("trade_date") <= F.lit(to)), (types, F.col("type").isin(*(types or ()))), (security, F.col("security_id") == F.lit(security))):
        ledger = ledger if on is None else ledger.where(what)
    return ledger


def opening_cash(periods: DataFrame) -> DataFrame:
    """(account_id, opening_cash) of each account's earliest statement period with a start and an opening balance; 0 without one."""
    known = F.col("period_start").isNotNull() & F.col("opening_cash").isNotNull()
    return periods.groupBy("account_id").agg(F.coalesce(F.min(F.when(known, F.struct("period_start", "opening_cash")))["opening_cash"], F.lit(0)).cast("decimal(18,2)").alias("opening_cash"))


def daily_cash(cash: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """Dense calendar of each account from its first to its last event, with running balance and cumulative flows.

    Balances start at what ``opening`` (opening_cash) has for the account, else at 0.

    Events are summed by day first, so a large account's window runs over days, not over events.
    """
    days = cash_flows(cash, "account_id", "trade_date")
    span = cash.groupBy("account_id").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).select("account_id", F.explode(F.sequence("a", "b")).alias("trade_date"))
    w = W.partitionBy("account_id").orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    names = {"net": "cash", "deposits": "cumulative_contributions", "withdrawals": "cumulative_withdrawals", "income": "cumulative_income", "fees": "cumulative_fees"}
    own = span.join(days, ["account_id", "trade_date"], "left").select("account_id", "trade_date", *[F.coalesce(F.sum(c).over(w), F.lit(0)).cast("decimal(18,2)").alias(n) for c, n in names.items()])
    if opening is None:
        return own
    first = opening.select("account_id", F.col("opening_cash").alias("__first"))
    return own.join(first, "account_id", "left").withColumn("cash", (F.col("cash") + F.coalesce("__first", F.lit(0))).cast("decimal(18,2)")).drop("__first")


def _by_position(*more: str):
    return W.partitionBy("account_id", "security_id", *more).orderBy("trade_date", "__o", "event_id")


def _placed(trades: DataFrame) -> DataFrame:
    """With the place of each event's type within its day, worked out once for all sorts."""
    return trades.withColumn("__o", type_order(F.col("type")))


def _running(trades: DataFrame) -> DataFrame:
    w = _by_position()
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    signed = F.when(F.col("type") == "SELL", -F.col("units")).otherwise(F.col("units"))
    s = _placed(trades).withColumn("__s", F.sum(signed).over(so_far))
    held = s.withColumn("held", (F.col("__s") - F.least(F.lit(0).cast("decimal(28,2)"), F.min("__s").over(so_far))).cast("decimal(28,2)"))
    held = held.withColumn("before", F.coalesce(F.lag("held").over(w), F.lit(0)).cast("decimal(28,2)"))
    sold = F.when(F.col("type") == "SELL", F.col("before") - F.col("held")).otherwise(F.lit(0)).cast("decimal(28,2)")
    return held.withColumn("sold", sold).withColumn("excess", F.when(F.col("type") == "SELL", F.col("units") - F.col("sold")).otherwise(F.lit(0)).cast("decimal(28,2)")).drop("__s")


def running_units(trades: DataFrame) -> DataFrame:
    """Units held after each trade; a sell takes at most what is held, the rest is ``excess``.

    With S the prefix sum of signed units, holdings clamped at zero are S - min(0, lowest S so far).
    """
    return _running(trades).drop("__o", "before")


def fifo_matches(trades: DataFrame) -> DataFrame:
    """Overlaps of first-in-first-out parcels and sells: (account, security, buy event, sell event, units, cost).

    All that adds units (buys, and other events such as corporate actions, which cost nothing) covers one axis of
    cumulative units, effective sells another, both in the order of running_units. All ends are cut points; between two
    cut points the parcel and the sell are those whose intervals end next. Nothing is joined by range. Open lots have no
    sell.
    """
    run = _running(trades).withColumn("sells", F.col("type") == "SELL").withColumn("moved", F.when(F.col("sells"), F.col("sold")).otherwise(F.col("units")).cast("decimal(28,2)")).where("moved > 0")
    side = _by_position("sells").rowsBetween(W.unboundedPreceding, 0)
    cuts = run.withColumn("cut", F.sum("moved").over(side).cast("decimal(28,2)"))
    # backwards: what ends next is the last one met, and the frame only grows
    back = W.partitionBy("account_id", "security_id").orderBy(F.desc("cut"), F.desc("sells"))
    rest = back.rowsBetween(W.unboundedPreceding, 0)
    paid = F.when(F.col("type") == "BUY", F.col("gross") + F.col("fees")).otherwise(0).cast("double")
    lot = F.last(F.when(~F.col("sells"), F.struct("event_id", paid.alias("paid"), "units")), ignorenulls=True).over(rest)
    sell = F.last(F.when(F.col("sells"), F.struct("event_id")), ignorenulls=True).over(rest)
    each = cuts.select("account_id", "security_id", lot.alias("lot"), sell.alias("sell"), (F.col("cut") - F.coalesce(F.lead("cut").over(back), F.lit(0))).cast("decimal(28,2)").alias("units")).where("units > 0 AND lot IS NOT NULL")
    cost = F.col("units").cast("double") * F.col("lot.paid") / F.col("lot.units").cast("double")
    return each.select("account_id", "security_id", F.col("lot.event_id").alias("buy_id"), F.col("sell.event_id").alias("sell_id"), "units", cost.alias("cost"))


def _laid(trades: DataFrame, *more: str) -> DataFrame:
    """Events in order of position and place, in one exchange and one sort: units in hundredths, what a buy costs, what a sell brings, gross."""
    net = lambda x: x.cast("double")
    own = _placed(trades).select(
        "account_id", "security_id", "trade_date", "__o", "event_id", "type", (F.coalesce(F.col("units").cast("decimal(28,2)"), F.lit(0)) * 100).cast("long").alias("units"),
        net(F.col("gross") + F.col("fees")).alias("paid"), net(F.col("gross") - F.col("fees")).alias("net"), net(F.col("gross")).alias("gross"),
    )
    keys = ["account_id", "security_id"]
    return own.repartition(*keys).sortWithinPartitions(*keys, "trade_date", "__o", "event_id").select(*keys, "trade_date", "type", "units", "paid", "net", "gross", *more)


def _step(held: int, cost: float, kind: str, units: int, paid: float | None) -> tuple[int, float, int, float]:
    """Units (in hundredths) held after an event and their cost, what a sell took of them and what that had cost."""
    if kind != "SELL":
        after = max(0, held + units)
        return after, (cost + (paid or 0.0) if kind == "BUY" else cost) if after else 0.0, 0, 0.0
    after = max(0, held - units)
    sold = held - after
    taken = cost * (sold / 100) / (held / 100) if sold > 0 else 0.0
    return after, cost - taken if after else 0.0, sold, taken


def _each_cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, held, cost = None, 0, 0.0
    for batch in batches:
        rows = []
        for *key, _, kind, units, paid, net, _, _ in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if key != group:
                group, held, cost = key, 0, 0.0
            held, cost, sold, taken = _step(held, cost, kind, units, paid)
            rows.append((held / 100, cost, taken, 0.0 if kind != "SELL" else None if net is None else net - taken, sold / 100))
        figures = [pa.array(x, pa.float64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.float64())] * 5
        same = ["account_id", "security_id", "event_id", "trade_date", "type"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in same] + figures, [*same, "held", "cost", "allocated", "gain", "sold"])


def _each_day(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, held, cost, gain, flow = None, 0, 0.0, 0.0, 0.0
    names = ["account_id", "security_id", "trade_date", "held", "cost", "gain", "flow"]
    kinds = None

    def batch_of(days: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in days], k) for i, k in enumerate(kinds)], names)

    for batch in batches:
        kinds, days = [batch.schema.field(c).type for c in names[:3]] + [pa.float64()] * 4, []
        for *at, kind, units, paid, net, gross in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if at != place:
                if place is not None:
                    days.append((*place, held / 100, cost, gain, flow))
                    if at[:2] != place[:2]:
                        held, cost = 0, 0.0
                place, gain, flow = at, 0.0, 0.0
            held, cost, sold, taken = _step(held, cost, kind, units, paid)
            if kind == "SELL":
                gain += 0.0 if net is None else net - taken
                flow -= (gross or 0.0) * (sold / units) if units else 0.0
            elif kind == "BUY":
                flow += gross or 0.0
        yield batch_of(days)
    if place is not None:
        yield batch_of([(*place, held / 100, cost, gain, flow)])


def average_cost(trades: DataFrame) -> DataFrame:
    """Each trade with units and pooled cost after it, allocated cost and gain of sells (fees are cost of buys, taken off sells).

    A sell takes its share of the pooled cost, no units no cost; units that come by other events than buys cost nothing.
    A sell with nothing held has no cost and its gain is its whole net proceeds. Figures are doubles.

    Positions lie in one exchange and one sort and stream through a step from trade to trade; nothing of a position is held
    but its units and cost.
    """
    kinds = dict(trades.dtypes)
    return _laid(trades, "event_id").mapInArrow(_each_cost, ", ".join(f"{c} {kinds[c]}" for c in ("account_id", "security_id", "event_id", "trade_date", "type")) + ", held double, cost double, allocated double, gain double, sold double")


def daily_positions(trades: DataFrame) -> DataFrame:
    """Each day on which a position traded: units and cost after it, the day's gain, and its flow (buys less sells of what was held), by average_cost's step.

    As many rows as positions have trading days, however many trades a day has.
    """
    kinds = dict(trades.dtypes)
    return _laid(trades).mapInArrow(_each_day, ", ".join(f"{c} {kinds[c]}" for c in ("account_id", "security_id", "trade_date")) + ", held double, cost double, gain double, flow double")


def asof_prices(points: DataFrame, prices: DataFrame) -> DataFrame:
    """``points`` (security_id, on, ...) with the last price on or before ``on`` and its quality; never a later one.

    Only the distinct days asked for and the priced days of a security are laid into one order, in which the last price
    is carried forward: as many rows as days, however many points or accounts ask. Points then meet their security and
    day by an equi-join, which spreads a security over its days. Points without a security or day have no price; of
    several prices of one day the highest counts.
    """
    known = prices.where("price IS NOT NULL").groupBy("security_id", F.col("price_date").alias("on")).agg(F.max("price").alias("__price"))
    asked = points.select("security_id", "on").where("security_id IS NOT NULL AND on IS NOT NULL").distinct()
    days = known.withColumn("__q", F.struct(F.col("on").alias("price_date"), F.col("__price").alias("price"))).select("security_id", "on", "__q", F.lit(False).alias("__asked")).unionByName(asked.withColumn("__asked", F.lit(True)), allowMissingColumns=True)
    days = days.groupBy("security_id", "on").agg(F.max("__q").alias("__q"), F.max("__asked").alias("__asked"))
    w = W.partitionBy("security_id").orderBy("on").rowsBetween(W.unboundedPreceding, 0)
    carried = days.withColumn("__q", F.last("__q", ignorenulls=True).over(w)).where("__asked").select("security_id", "on", "__q")
    got = points.join(carried, ["security_id", "on"], "left").select(*points.columns, "__q.*")
    quality = F.when(F.col("price").isNull(), "UNAVAILABLE").when(F.col("price_date") == F.col("on"), "QUOTED").otherwise("CARRIED_FORWARD")
    return got.withColumn("quality", quality)


def portfolio_states(trades: DataFrame, prices: DataFrame, dates: list) -> DataFrame:
    """Units, average cost, realised gain, value and unrealised gain of every account and security on each of ``dates`` (``on``), by one pass over the trades."""
    days = daily_positions(trades.where(F.col("trade_date") <= F.greatest(*[F.lit(d).cast("date") for d in [*dates, dates[0]]])))
    upto = lambda d, what: F.when(F.col("trade_date") <= F.lit(d).cast("date"), what)
    each = [F.struct(F.lit(d).cast("date").alias("on"), F.max_by(F.struct("held", "cost"), upto(d, F.col("trade_date"))).alias("s"), F.sum(upto(d, F.col("gain"))).alias("realised")) for d in dates]
    done = days.groupBy("account_id", "security_id").agg(F.array(*each).alias("each")).select("account_id", "security_id", F.inline("each")).where("s IS NOT NULL")
    at = asof_prices(done.select("account_id", "security_id", F.col("s.held").alias("units"), F.col("s.cost").alias("cost"), "realised", "on"), prices)
    value = F.when(F.col("units") == 0, 0.0).otherwise(F.col("units") * F.col("price"))
    return at.select("account_id", "security_id", "on", "units", "cost", "realised", "price", F.when(F.col("units") == 0, "NOT_HELD").otherwise(F.col("quality")).alias("quality"), value.alias("value"), (value - F.col("cost")).alias("unrealised"))


def portfolio_state(trades: DataFrame, prices: DataFrame, on) -> DataFrame:
    """portfolio_states of one date."""
    return portfolio_states(trades, prices, [on]).drop("on")
