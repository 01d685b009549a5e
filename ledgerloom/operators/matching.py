"""Pairing of records that two sources report: candidates by equal keys and cents, ambiguity as a status, one-to-one assignment."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.sources.shared import checkpointed

#: Fixed value: cents of an account that lie in one place while settlements are paired.
_STRETCH = 1 << 16


def match_trades(one: DataFrame, other: DataFrame, cents: int = 1, days: int = 5) -> DataFrame:
    """Status of every row of both sides (account_id, security_id, type, trade_date, gross, event_id).

    Candidates agree in account, security and type, within ``cents`` and ``days``. A row with several candidates, or
    whose candidate has several, is AMBIGUOUS; row order decides nothing.

    Nothing is joined. Both sides lie in one exchange by account, security and type; a row's candidates are the other
    side's rows in frames around its own place on one axis of amounts and days, a frame for each cent.
    """
    keys = ["account_id", "security_id", "type"]
    side = lambda d, own, ids: d.select(*keys, F.unix_date("trade_date").cast("long").alias("d"), F.round(F.col("gross") * 100).cast("long").alias("c"), F.lit(own).alias("side"), *ids)
    nothing = lambda d: F.lit(None).cast(d.schema["event_id"].dataType)
    both = side(one, 1, [F.col("event_id").alias("id1"), nothing(other).alias("id2")]).unionByName(side(other, 2, [nothing(one).alias("id1"), F.col("event_id").alias("id2")]))
    both = both.withColumn("known", ~F.greatest(*[F.col(c).isNull() for c in (*keys, "d", "c")]))
    # amounts of a group become steps, of which more than ``cents`` between two shrink to one too many; days lie within a step
    wide = 1 << 24
    step = F.when(F.col("known"), F.least(F.col("c") - F.lag("c", 1).over(W.partitionBy(*keys, "known").orderBy("c", "d")), F.lit(cents + 1)))
    both = both.withColumn("step", F.coalesce(step, F.lit(0))).withColumn("x", F.sum("step").over(W.partitionBy(*keys, "known").orderBy("c", "d").rowsBetween(W.unboundedPreceding, 0)) * wide + F.coalesce("d", F.lit(0)))
    frames = [W.partitionBy(*keys, "known").orderBy("x").rangeBetween(k * wide - days, k * wide + days) for k in range(-cents, cents + 1)]
    most = lambda what: F.array_max(F.array(*[F.max(what).over(f) for f in frames]))  # noqa: E731  the greatest of what isn't null
    total = lambda what: sum((F.coalesce(F.sum(what).over(f), F.lit(0)) for f in frames[1:]), F.coalesce(F.sum(what).over(frames[0]), F.lit(0)))
    both = both.withColumn("n", F.when(F.col("known"), F.when(F.col("side") == 1, total((F.col("side") == 2).cast("long"))).otherwise(total((F.col("side") == 1).cast("long")))).otherwise(0))
    theirs = lambda c: F.when(F.col("side") == 2, F.col(c))
    both = both.withColumns({"claims": most(theirs("n")), "mate": most(theirs("id2")), "d2": most(theirs("d")), "c2": most(theirs("c"))})
    lone = (F.col("n") == 1) & (F.col("claims") == 1)
    status = (
        F.when(F.col("side") == 2, "UNMATCHED_CASH").when(F.col("n") == 0, "UNMATCHED_INVESTMENT").when(~lone, "AMBIGUOUS")
        .when((F.col("c") != F.col("c2")) | (F.col("d") != F.col("d2")), "MATCH_WITH_MINOR_DIFFERENCE").otherwise("MATCH")
    )
    mine = (F.col("side") == 1) & lone
    return both.where("side = 1 OR n = 0").select("id1", status.alias("status"), F.when(F.col("side") == 2, F.col("id2")).when(mine, F.col("mate")).alias("id2"), F.when(mine, F.col("d2") - F.col("d")).cast("int").alias("days"))


def greedy_one_to_one(pairs: DataFrame, left: str, right: str, order: list[str], preference: list[str], alike: list[str]) -> DataFrame:
    """Left rows, in ``order`` and then by id, take their best free right row by ``preference`` and then by id.

    Done for all rows at once, in rounds of proposals, each in a checkpoint: every left row proposes to its best right row;
    a right row keeps the first of those that propose, and is struck off the lists of all that come after. Since right
    rows rank left ones alike, what is left in the end is what a walk gives. Rows that say the same would queue up for
    one right row after the other. So of left rows that agree in ``alike`` (columns that decide their candidates and how
    they prefer them) the i-th passes over the first i - 1 of their common list, which those before it take or refuse: a
    crowd of equal rows is settled, and moves on, in one round. No group is gathered in one task's memory.
    """
    names, place = pairs.columns, F.struct(*order, left)
    crowd, own = W.partitionBy(*alike), W.partitionBy(*alike, left)
    now = pairs
    while True:
        rows = now.withColumn("__at", F.dense_rank().over(crowd.orderBy(*preference, right))).withColumn("__i", F.dense_rank().over(crowd.orderBy(*order, left))).where("__at >= __i")
        rows = rows.withColumn("__asks", F.col("__at") == F.min("__at").over(own))
        rows = rows.withColumn("__kept", F.min(F.when(F.col("__asks"), place)).over(W.partitionBy(right))).where(F.col("__kept").isNull() | (place <= F.col("__kept")) | F.col("__asks"))
        rows = checkpointed(rows.select(*names, "__asks", (F.col("__asks") & (place > F.col("__kept"))).alias("__refused")))
        if rows.where("__refused").isEmpty():
            return rows.where("__asks").select(*names)
        now = rows.where("NOT __refused").select(*names)


def pair_settlements(trades: DataFrame, transfers: DataFrame) -> DataFrame:
    """Each trade with the nearest later transfer of its net amount (within a cent), each transfer used once.

    Trades choose in order of day and id. All transfers rank trades alike and trades rank transfers alike, so it is the
    same to let each transfer, in order, take the first trade that still waits; no pairs of candidates are made. Amounts
    of an account are cut into blocks where sorted ones lie over a cent apart, named by their least amount. Blocks stream
    by day, with queues of what waits.

    Rows go through one exchange, by account and stretch of ``_STRETCH`` cents, and stream where they lie. Only blocks that
    reach an end of their stretch go through a second one, which brings together those that adjoin.

    Rows with a null day or amount, and transfers before a trade, pair with nothing.
    """
    return _settled(trades, transfers).where("transfer_id IS NOT NULL")


def settled(trades: DataFrame, transfers: DataFrame) -> DataFrame:
    """Every trade (account_id, event_id, days_to_cash) as :func:`pair_settlements` pairs it, null days where it has no transfer. Nothing is joined."""
    own = _settled(trades, transfers).select("account_id", F.col("trade_id").alias("event_id"), "days_to_cash")
    known = F.col("account_id").isNotNull() & F.col("trade_date").isNotNull() & _net_cents().isNotNull()
    return own.unionByName(trades.where(~known).select("account_id", "event_id", F.lit(None).cast("int").alias("days_to_cash")))


def _net_cents() -> Column:
    net = F.when(F.col("type") == "SELL", F.col("gross") - F.col("fees")).otherwise(-(F.col("gross") + F.col("fees")))
    return F.round(net * 100).cast("long")


def _settled(trades: DataFrame, transfers: DataFrame) -> DataFrame:
    """Every trade that has an account, a day and an amount, with its transfer or nulls."""
    row = lambda cents, side: ["account_id", F.col("event_id").cast("string").alias("id"), F.col("trade_date").alias("day"), cents.alias("c"), F.lit(side).alias("side")]
    both = trades.select(*row(_net_cents(), 1)).unionByName(transfers.select(*row(F.round(F.col("amount") * 100).cast("long"), 2))).where("account_id IS NOT NULL AND day IS NOT NULL AND c IS NOT NULL")
    place = ["account_id", "stretch"]
    both = both.withColumn("stretch", F.floor(F.col("c") / F.lit(_STRETCH))).repartition(*place)
    w = W.partitionBy(*place).orderBy("c")
    both = both.withColumn("new", F.coalesce((F.col("c") - F.lag("c").over(w) > 1).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(w)).drop("new")
    run = W.partitionBy(*place, "run")
    both = both.withColumns({"block": F.min("c").over(run), "last": F.max("c").over(run)})
    loose = (F.pmod("block", F.lit(_STRETCH)) == 0) | (F.pmod("last", F.lit(_STRETCH)) == _STRETCH - 1)

    ends, w = both.where(loose).select("account_id", "block", "last").distinct(), W.partitionBy("account_id").orderBy("block")
    ends = ends.withColumn("new", F.coalesce((F.col("block") - F.lag("last").over(w) > 1).cast("int"), F.lit(0))).withColumn("chain", F.sum("new").over(w))
    ends = ends.select("account_id", "block", F.min("block").over(W.partitionBy("account_id", "chain")).alias("least"))
    ordered = lambda d: d.sortWithinPartitions("account_id", "block", "day", "side", "id").select("account_id", "block", "id", "day", "c", "side")
    firm = ordered(both.where(~loose))
    chained = ordered(both.where(loose).join(ends, ["account_id", "block"]).withColumn("block", F.col("least")).repartition("account_id", "block"))
    shape = f"account_id {dict(both.dtypes)['account_id']}, block long, trade_id string, traded date, transfer_id string, settled date"
    ids = {"trade_id": trades.schema["event_id"].dataType, "transfer_id": transfers.schema["event_id"].dataType}
    out = firm.mapInArrow(_first_waiting, shape).unionByName(chained.mapInArrow(_first_waiting, shape)).withColumn("days_to_cash", F.datediff("settled", "traded"))
    return out.select("account_id", "block", *[F.col(c).cast(k).alias(c) for c, k in ids.items()], "traded", "settled", "days_to_cash")


def _first_waiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams blocks by day; a transfer takes the trade that has waited longest among those within a cent. Only what waits is held; with its block, it leaves alone."""
    names = ["account_id", "block", "trade_id", "traded", "transfer_id", "settled"]
    block, waiting, n, kinds = (None, None), {}, 0, None

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for k, x in zip(kinds, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True)], names)  # noqa: B023

    for batch in batches:
        kinds = [batch.schema.field("account_id").type, pa.int64(), pa.string(), pa.date32(), pa.string(), pa.date32()]
        out = []
        for account, number, id_, day, c, side in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (account, number) != block:
                out += [(*block, own, since, None, None) for rows in waiting.values() for _, own, since in rows]
                block, waiting, n = (account, number), {}, 0
            if side == 1:
                waiting.setdefault(c, deque()).append((n, id_, day))
                n += 1
            elif heads := [(waiting[k][0], k) for k in (c - 1, c, c + 1) if waiting.get(k)]:
                _, k = min(heads)
                _, own, since = waiting[k].popleft()
                if not waiting[k]:
                    del waiting[k]
                out.append((*block, own, since, id_, day))
        yield told(out)
    if kinds:
        yield told([(*block, own, since, None, None) for rows in waiting.values() for _, own, since in rows])
