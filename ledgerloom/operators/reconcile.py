"""Reconciliation of two sources of one account's events, authority by class, and the promotion of what is settled."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from functools import partial
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerloom.functions.text import make_id
from ledgerloom.operators.matching import greedy_one_to_one

#: Days and cents that two reports of one event may lie apart, and units those of one trade may.
DAYS, CENTS, UNITS = 7, 1, 0.5

RESOLVED = ("MATCH", "MATCH_WITH_MINOR_DIFFERENCE", "TIMING_DIFFERENCE", "SOURCE_COVERAGE_DIFFERENCE")


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def _spans(day: Column, days: int) -> tuple[Column, Column]:
    """Spans of days that a window around a day meets (two at most), and the span of a day."""
    of = lambda shift: F.floor((F.unix_date(day) + shift) / (2 * days + 1))
    return F.explode(F.array_distinct(F.array(of(-days), of(days)))), of(0)


def cash_pairs(own: DataFrame, other: DataFrame, days: int = DAYS, cents: int = CENTS) -> DataFrame:
    """One-to-one pairs (account_id, type, id1, id2) of cash events (account_id, event_id, type, security_id, on, amount).

    Same type, amounts within ``cents``, dates within ``days``; first those of one security or of none, then any, then
    the nearest date. Events of ``own`` choose in order of date and id.
    """
    keys = ["account_id", "type"]
    a, b = own.withColumn("c", _cents("amount")), other.withColumn("c", _cents("amount"))
    wide, at = _spans(F.col("on"), days)
    left = a.select(*keys, F.col("c").alias("c1"), F.col("event_id").alias("id1"), F.col("on").alias("on1"), F.col("security_id").alias("s1"), F.explode(F.sequence(F.col("c") - cents, F.col("c") + cents)).alias("c"), "on").withColumn("span", wide).drop("on")
    right = b.select(*keys, "c", F.col("event_id").alias("id2"), F.col("on").alias("on2"), F.col("security_id").alias("s2"), at.alias("span"))
    pairs = left.join(right, [*keys, "c", "span"]).withColumn("days", F.abs(F.datediff("on1", "on2"))).where(F.col("days") <= days)
    tier = (~F.coalesce(F.col("s1") == F.col("s2"), F.lit(True))).cast("int")
    pairs = pairs.select(*keys, "id1", "id2", "on1", "s1", "c1", tier.alias("tier"), "days")
    return greedy_one_to_one(pairs, "id1", "id2", ["on1"], ["tier", "days"], [*keys, "on1", "s1", "c1"]).select(*keys, "id1", "id2")


def trade_pairs(own: DataFrame, other: DataFrame, days: int = DAYS, units: float = UNITS) -> DataFrame:
    """One-to-one pairs (account_id, type, id1, id2) of trades (account_id, event_id, type, security_id, on, amount, units): nearest date, then nearest amount.

    Trades of ``own`` choose in order of date and id, of equal ones the smaller id.
    """
    return _both_sides(own, other, days, units).where("id1 IS NOT NULL AND id2 IS NOT NULL").select("account_id", "type", "id1", "id2")


def reconciled_trades(own: DataFrame, other: DataFrame, days: int = DAYS, units: float = UNITS) -> DataFrame:
    """As :func:`reconciled` with the pairs of :func:`trade_pairs`, but rows go through one exchange and none is joined to its pair. Ids are not null."""
    return _judged(_both_sides(own, other, days, units), _covered(own, other))


def _both_sides(own: DataFrame, other: DataFrame, days: int, units: float) -> DataFrame:
    """Every trade of both sides, alone or with its pair: (account_id, type, id1, id2, on1, on2, c1, c2, u1, u2).

    No pairs of candidates are made: both sides lie in one exchange by account, type and security and stream by day, and
    only what lies within ``days`` is held. Rows without key, date or units stay where they are.
    """
    keys = ["account_id", "type", "security_id"]
    side = lambda d, n, at, ids: d.select(*keys, at.alias("at"), F.lit(n).alias("side"), F.unix_date("on").alias("day"), F.abs("units").alias("u"), _cents("amount").alias("c"), *ids)
    id_, nothing = F.col("event_id"), lambda d: F.lit(None).cast(d.schema["event_id"].dataType)
    day = F.unix_date("on")
    # an own trade comes when all that it may take has come
    both = side(other, 0, day, [nothing(own).alias("id1"), id_.alias("id2")]).unionByName(side(own, 1, day + days, [id_.alias("id1"), nothing(other).alias("id2")]))
    apart = F.greatest(*[F.col(c).isNull() for c in (*keys, "at", "u")])
    met = both.where(~apart).repartition(*keys).sortWithinPartitions(*keys, "at", "side", "id1")
    kinds = dict(both.dtypes)
    shape = ", ".join(f"{c} {kinds[k]}" for c, k in (("account_id", "account_id"), ("type", "type"), ("id1", "id1"), ("id2", "id2"), ("day1", "day"), ("day2", "day"), ("c1", "c"), ("c2", "c"), ("u1", "u"), ("u2", "u")))
    mine = lambda n, c: F.when(F.col("side") == n, F.col(c))
    alone = both.where(apart).select("account_id", "type", "id1", "id2", *[mine(n, c).alias(f"{c}{k}") for c in ("day", "c", "u") for n, k in ((1, 1), (0, 2))])
    out = met.mapInArrow(partial(_nearest_free, days=days, units=units), shape).unionByName(alone)
    on = lambda c: F.date_from_unix_date(c)
    return out.select("account_id", "type", "id1", "id2", on("day1").alias("on1"), on("day2").alias("on2"), "c1", "c2", "u1", "u2")


def _nearest_free(batches: Iterator[pa.RecordBatch], days: int, units: float) -> Iterator[pa.RecordBatch]:
    """Streams groups by day; each own trade takes the free other one of the nearest day, then amount (a null amount first), then id.

    An own trade leaves at once, with what it takes; what nothing took leaves when it lies too far back, or with its group.
    """
    names, kinds = ["account_id", "type", "id1", "id2", "day1", "day2", "c1", "c2", "u1", "u2"], None
    group, free = (None, None), {}  # by day, by bucket of units, by units: (amount known, amount, id), sorted

    def left(days_: list[int]) -> list[tuple]:
        return [(*group[:2], None, id_, None, d, None, c if known else None, None, v) for d in days_ for same in free.pop(d).values() for v, rows in same.items() for known, c, id_ in rows]  # noqa: B023

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kinds[n]) for n, x in zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True)], names)  # noqa: B023

    for batch in batches:
        kinds = {n: batch.schema.field(n if n[-1] not in "12" or n.startswith("id") else n[:-1]).type for n in names}
        out = []
        for *key, _, side, day, u, c, id1, id2 in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if key != group:
                out += left(list(free))
                group, free = key, {}
            if u != u:
                out.append((*key[:2], id1, id2, *((day, None, c, None, u, None) if side else (None, day, None, c, None, u))))
                continue
            place = int(u // units)
            if side == 0:
                insort(free.setdefault(day, {}).setdefault(place, {}).setdefault(u, []), (c is not None, c or 0, id2))
                continue
            if free and next(iter(free)) < day - days:
                out += left([d for d in takewhile(lambda d: d < day - days, free)])  # noqa: B023
            for off in range(days + 1):
                best = min((x for d in {day - off, day + off} if d in free for k in (place - 1, place, place + 1) for v, rows in free[d].get(k, {}).items() if abs(u - v) < units for x in [_nearest(rows, c, (d, k, v))]), default=None)
                if best is not None:
                    _, id_, (d, k, v), n = best
                    known, took, _ = free[d][k][v].pop(n)
                    if not free[d][k][v]:
                        del free[d][k][v]
                    out.append((*key[:2], id1, id_, day, d, c, took if known else None, u, v))
                    break
            else:
                out.append((*key[:2], id1, None, day, None, c, None, u, None))
        yield told(out)
    if kinds:
        yield told(left(list(free)))


def _nearest(rows: list, c: int | None, where: tuple) -> tuple:
    """(distance, id, where, index) of the row of the nearest amount; an unknown distance, -1, is the nearest."""
    if c is None:
        n = min(range(len(rows)), key=lambda n: rows[n][2])
        return -1, rows[n][2], where, n
    if not rows[0][0]:
        return -1, rows[0][2], where, 0
    n = bisect_left(rows, (True, c))
    ends = [n] if n < len(rows) else []
    if n:
        ends.append(bisect_left(rows, (True, rows[n - 1][1])))
    return min((abs(rows[m][1] - c), rows[m][2], where, m) for m in ends)


def reconciled(own: DataFrame, other: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every event of both sides: (account_id, type, id1, id2, status, authority, resolved).

    Paired: MATCH, QUANTITY_MISMATCH (units differ), MATCH_WITH_MINOR_DIFFERENCE (amounts differ) or TIMING_DIFFERENCE.
    Alone: SOURCE_COVERAGE_DIFFERENCE where the date lies outside what the other source covers for the account, else
    OWN_ONLY or OTHER_ONLY, which wait for a decision.
    """
    units = lambda d: F.col("units") if "units" in d.columns else F.lit(None).cast("double")
    keys = ["account_id", "type"]
    a = own.select(*keys, F.col("event_id").alias("id1"), F.col("on").alias("on1"), _cents("amount").alias("c1"), units(own).alias("u1"))
    b = other.select(*keys, F.col("event_id").alias("id2"), F.col("on").alias("on2"), _cents("amount").alias("c2"), units(other).alias("u2"))
    # what an own event is paired with travels with it, so both sides meet once
    rows = a.join(pairs.select(*keys, "id1", F.col("id2").alias("mate")), [*keys, "id1"], "left").withColumnsRenamed({c: f"own_{c}" for c in keys})
    rows = rows.join(b, (F.col("own_account_id") == F.col("account_id")) & (F.col("own_type") == F.col("type")) & (F.col("mate") == F.col("id2")), "full")
    rows = rows.select(*[F.coalesce(f"own_{c}", c).alias(c) for c in keys], "id1", "id2", "on1", "on2", "c1", "c2", "u1", "u2")
    return _judged(rows, _covered(own, other))


def _covered(own: DataFrame, other: DataFrame) -> DataFrame:
    """First and last date of both sources by account."""
    spans = lambda d, n: d.groupBy("account_id").agg(F.min("on").alias(f"a{n}"), F.max("on").alias(f"z{n}"))
    return spans(own, 1).join(spans(other, 2), "account_id", "full")


def _judged(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Status of each row, paired or alone, of both sides."""
    rows = rows.join(spans, "account_id", "left")
    outside = lambda on, side: F.coalesce((F.col(on) < F.col(f"a{side}")) | (F.col(on) > F.col(f"z{side}")), F.lit(True))
    paired = F.col("id1").isNotNull() & F.col("id2").isNotNull()
    far = F.when(F.col("id2").isNull(), outside("on1", 2)).otherwise(outside("on2", 1))
    same = F.when(F.abs(F.abs("u1") - F.abs("u2")) > 0.0001, "QUANTITY_MISMATCH").when(F.col("c1") != F.col("c2"), "MATCH_WITH_MINOR_DIFFERENCE").when(F.col("on1") != F.col("on2"), "TIMING_DIFFERENCE").otherwise("MATCH")
    rows = rows.withColumn("status", F.when(paired, same).when(far, "SOURCE_COVERAGE_DIFFERENCE").when(F.col("id2").isNull(), "OWN_ONLY").otherwise("OTHER_ONLY"))
    resolved = F.col("status").isin(*RESOLVED)
    authority = F.when(~resolved, "UNRESOLVED").when(F.col("id1").isNull(), "OTHER_ONLY_SUPPORTED").otherwise("OWN_PREFERRED")
    return rows.select("account_id", "type", "id1", "id2", "status", authority.alias("authority"), resolved.alias("resolved"))


def match_summary(results: DataFrame) -> DataFrame:
    """Counts of statuses by account, and whether an id stands in several results."""
    return results.groupBy("account_id", "status").agg(F.count("*").alias("n"), (F.count("id1") == F.countDistinct("id1")).alias("one_to_one"))


def authority_policy(results: DataFrame) -> DataFrame:
    """By account and class, the source that counts: UNRESOLVED as soon as one result is; how many are; and whether the account is ready."""
    by = results.groupBy("account_id", "type").agg(F.count_if(~F.col("resolved")).alias("unresolved"))
    ready = F.max("unresolved").over(W.partitionBy("account_id")) == 0
    return by.withColumn("authority", F.when(F.col("unresolved") > 0, "UNRESOLVED").otherwise("OWN_PREFERRED")).withColumn("promotion_ready", ready)


def canonical_ids(events: DataFrame) -> DataFrame:
    """``events`` (account_id, event_id, type, security_id, on, amount) with a fingerprint of what they say, the ordinal of equal ones (by id) and the id of both."""
    print_ = make_id("EVENT", F.col("account_id"), F.col("type"), F.coalesce("security_id", F.lit("")), F.col("on"), F.col("amount").cast("decimal(18,2)"), length=20)
    own = events.withColumn("fingerprint", print_).withColumn("ordinal", F.row_number().over(W.partitionBy("fingerprint").orderBy("event_id")) - 1)
    return own.withColumn("canonical_id", make_id("CANONICAL", F.col("fingerprint"), F.col("ordinal"), length=20))


def promotion_plan(results: DataFrame, policy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(superseded ids of the other source, ids of the own source that take their place), of accounts that are ready; others keep what they have."""
    ready = policy.where("promotion_ready").select("account_id").distinct()
    own = results.join(ready, "account_id", "left_semi")
    return own.where("id1 IS NOT NULL AND id2 IS NOT NULL").select(F.col("id2").alias("event_id")), own.where("id1 IS NOT NULL").select(F.col("id1").alias("event_id"))


def apply_promotion(stored: DataFrame, arriving: DataFrame, superseded: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` without superseded events and with the new ones."""
    return stored.join(superseded, "event_id", "left_anti").unionByName(arriving.join(new, "event_id", "left_semi").select(stored.columns))


def unknown_codes(new: DataFrame, securities: DataFrame) -> DataFrame:
    """Codes of ``new`` (security_id is a code) that ``securities`` (security_id, code) don't know, and how many rows have them."""
    return new.where("security_id IS NOT NULL").groupBy(F.col("security_id").alias("code")).agg(F.count("*").alias("n_rows")).join(securities.select("code"), "code", "left_anti")


def with_stored_ids(new: DataFrame, securities: DataFrame) -> DataFrame:
    """``new``, whose security_id is a code, with the id that ``securities`` (security_id, code) store for it.

    Rows without a code stay without; of several securities with a code the smallest id counts. An unknown code fails the
    job: nothing that is promoted may name a security that isn't stored.
    """
    ids = securities.where("code IS NOT NULL").groupBy(F.col("code").alias("__code")).agg(F.min("security_id").alias("__id"))
    code = F.col("security_id")
    known = F.when(code.isNull(), F.lit(None).cast(ids.schema["__id"].dataType)).when(F.col("__id").isNotNull(), F.col("__id")).otherwise(F.raise_error(F.concat(F.lit("unknown security "), code.cast("string"))))
    return new.join(ids, code == F.col("__code"), "left").withColumn("security_id", known).select(new.columns)


def resolve_security(rows: DataFrame, securities: DataFrame) -> DataFrame:
    """``rows`` (product_id, product_name) with security_id from ``securities`` (security_id, product_id, name, priority).

    By product id where there is one (an unknown one stays null), else by the exact name without case and outer blanks;
    of several, the one with the least priority, then the smallest id.
    """
    best = lambda key: F.min_by("security_id", F.struct("priority", "security_id")).alias(key)
    by_id = securities.where("product_id IS NOT NULL").groupBy("product_id").agg(best("__by_id"))
    by_name = securities.where("name IS NOT NULL").groupBy(F.lower(F.trim("name")).alias("__name")).agg(best("__by_name"))
    own = rows.withColumn("__name", F.lower(F.trim("product_name"))).join(by_id, "product_id", "left").join(by_name, "__name", "left")
    return own.withColumn("security_id", F.when(F.col("product_id").isNotNull(), F.col("__by_id")).otherwise(F.col("__by_name"))).drop("__name", "__by_id", "__by_name")


def attach_brokerage(trades: DataFrame, fees: DataFrame, days: int = 7) -> DataFrame:
    """Trades (account_id, event_id, type, security_id, on, brokerage) with the fee row (account_id, fee_id, on, amount, description) that charged it.

    The fee's amount is the brokerage, it follows within ``days``, and its description names the side and the security;
    the earliest counts, each row once. Trades without one have a null fee_id.

    Trades choose in order of date and id. No pairs of candidates are made: both sides lie in one exchange by account and
    amount and stream by day, and only fee rows within ``days`` are held. Trades travel whole, so nothing is joined
    afterwards; those without brokerage, account, date or names stay where they are.
    """
    nothing = lambda kind: F.lit(None).cast(kind)
    names, ids = [c for c in trades.columns if c != "event_id"], fees.schema["fee_id"].dataType
    asks = (F.col("brokerage") > 0) & F.col("account_id").isNotNull() & F.col("on").isNotNull() & F.col("type").isNotNull() & F.col("security_id").isNotNull()
    asks = F.coalesce(asks & _cents("brokerage").isNotNull(), F.lit(False))
    asked = trades.where(asks).select("account_id", _cents("brokerage").alias("c"), F.lit(1).alias("side"), F.struct(*trades.columns).alias("row"), nothing(ids).alias("fee_id"), nothing("date").alias("on"), nothing("string").alias("description"))
    charged = fees.select("account_id", F.abs(_cents("amount")).alias("c"), F.lit(0).alias("side"), nothing(asked.schema["row"].dataType).alias("row"), "fee_id", "on", "description").dropna(subset=["account_id", "c", "on", "description"])
    both = charged.unionByName(asked).repartition("account_id", "c")
    day = F.unix_date(F.coalesce("on", "row.on"))
    both = both.select("account_id", "c", (day + F.col("side") * days).alias("at"), "side", day.alias("day"), "row", "fee_id", F.lower(F.coalesce("description", "row.type")).alias("said"), F.lower("row.security_id").alias("security"))
    both = both.sortWithinPartitions("account_id", "c", "at", "side", "row.event_id", "fee_id")
    best = both.mapInArrow(partial(_first_named, days=days), StructType([both.schema["row"], both.schema["fee_id"], StructField("days", IntegerType())]))
    out = ["event_id", *names, "fee_id", "days"]
    best = best.select("row.*", "fee_id", "days").select(*out)
    return best.unionByName(trades.where(~asks).withColumns({"fee_id": nothing(ids), "days": nothing("int")}).select(*out))


def _first_named(batches: Iterator[pa.RecordBatch], days: int) -> Iterator[pa.RecordBatch]:
    """Streams accounts' amounts by day; each trade takes the first free fee row of its days whose words name its side and its security."""
    group, free, many = None, {}, 1_000  # by words: (day, id), in order
    for batch in batches:
        asked, taken, after = [], [], []
        own = batch.select(["account_id", "c", "side", "day", "fee_id", "said", "security"])
        for i, (account, c, side, day, fee, said, security) in enumerate(zip(*(x.to_pylist() for x in own.columns), strict=True)):
            if (account, c) != group:
                group, free, many = (account, c), {}, 1_000
            if side == 0:
                rows = free.setdefault(said, deque())
                rows.append((day, fee))
                while rows[0][0] < day - days:
                    rows.popleft()
                if len(free) > many:
                    free = {w: rows for w, rows in free.items() if rows[-1][0] >= day - days}
                    many = 2 * len(free) + 1_000
                continue
            late = []
            for words in [w for w in free if said in w and security in w]:
                rows = free[words]
                while rows and rows[0][0] < day:  # trades come by day: what this one is too late for, later ones are
                    rows.popleft()
                if rows:
                    late.append((rows[0], words))
                else:
                    del free[words]
            asked.append(i)
            (on, fee), words = min(late, default=((None, None), None))
            if late:
                free[words].popleft()
            taken.append(fee)
            after.append(on - day if late else None)
        yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(asked, pa.int64())), pa.array(taken, batch.schema.field("fee_id").type), pa.array(after, pa.int32())], ["row", "fee_id", "days"])
