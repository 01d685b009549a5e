"""Canonical candidates of two exports: trades matched to their cash legs with reasons and stable ids, brokerage fees, typed cash rows, securities."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ledgerloom.functions.classify import income_type_for, security_type
from ledgerloom.functions.text import make_id, normalise_code, slug
from ledgerloom.operators.reconcile import attach_brokerage, resolve_security

#: Cash classes of the two sides of trades.
LEG = {"BUY": "TRADE_BUY_CASH", "SELL": "TRADE_SELL_CASH"}
MATCHED = ("MATCH", "MATCH_WITH_MINOR_DIFFERENCE")
#: Fixed value: cents of an account that lie in one place while exports are paired.
_STRETCH = 1 << 16


def _name(c: str) -> Column:
    return F.coalesce(F.lower(F.trim(c)), F.lit(""))


def _cents(c: Column) -> Column:
    return F.round(F.abs(c) * 100).cast("long")


def _ordinal(*key: str) -> Column:
    """Place of a row among those that say the same, from 0, by their id."""
    return F.row_number().over(W.partitionBy(*key).orderBy("row_id")) - 1


def match_exports(trades: DataFrame, cash: DataFrame, cents: int = 1, days: int = 5) -> DataFrame:
    """One row for each trade, and for each cash leg that no trade could mean.

    ``trades``: (account_id, row_id, side, product_id, security_name, trade_date, canonical_units, gross_value). ``cash``:
    (account_id, row_id, cash_class, product_id, product_name, date, signed_total, units). Result: (match_id, status,
    account_id, side, security_id, trade_row, cash_row, trade_date, cash_date, date_delta, value_delta, quantity_delta,
    candidates, reasons).

    A leg fits a trade of its account and side within ``cents`` and ``days``, if the product ids agree or, where one is
    missing, the names (without case and outer blanks). A trade with several fitting legs, or whose leg fits several
    trades, is AMBIGUOUS, and row order decides nothing. A lone pair is a MATCH, with a minor difference of value or day,
    or a QUANTITY_MISMATCH. Rows that say the same are counted before the join: a crowd of them makes one pair.

    Ids come from what rows say and the ordinal among equal trades, so reordered exports have the same ids; unmatched
    cash has no ordinal. Rows with a null day or amount fit nothing. The ordinals of a crowd of equal trades are counted
    by one task, as a sort that spills.
    """
    # cells of amounts and days, some times as wide as what a trade may reach: it meets one, seldom two of each
    cell = lambda at, reach, shift: F.floor((at + shift) / (reach + 1))
    met_by = lambda at, reach, by: F.explode(F.array_distinct(F.array(cell(at, reach, -by), cell(at, reach, by))))
    cents_wide, days_wide = 8 * cents + 7, 4 * days + 3
    said = ["account_id", "side", "pid", "name", "trade_date", "gross_value"]
    own = trades.select("account_id", "row_id", "side", F.col("product_id").alias("pid"), _name("security_name").alias("name"), "trade_date", "canonical_units", "gross_value")
    legs = cash.where(F.col("cash_class").isin(*LEG.values())).select("account_id", "row_id", F.when(F.col("cash_class") == LEG["BUY"], "BUY").otherwise("SELL").alias("side"), "cash_class", F.col("product_id").alias("qid"), _name("product_name").alias("called"), "date", "signed_total", "units")
    left = own.groupBy(*said).agg(F.count("*").alias("n1"), F.min("row_id").alias("trade_row"), F.min("canonical_units").alias("asked"))
    right = legs.groupBy("account_id", "side", "qid", "called", "date", "signed_total").agg(F.count("*").alias("n2"), F.min(F.struct("row_id", "units")).alias("leg"))

    keys = lambda id_, name: F.explode(F.array_compact(F.array(F.concat(F.lit("id|"), id_), F.concat(F.lit("name|"), name))))
    l = left.withColumn("key", keys(F.col("pid"), F.col("name"))).withColumn("c1", _cents(F.col("gross_value"))).withColumn("c", met_by(F.col("c1"), cents_wide, cents)).withColumn("span", met_by(F.unix_date("trade_date"), days_wide, days))  # noqa: E741
    r = right.withColumn("key", keys(F.col("qid"), F.col("called"))).withColumn("c2", _cents(F.col("signed_total"))).withColumn("c", cell(F.col("c2"), cents_wide, 0)).withColumn("span", cell(F.unix_date("date"), days_wide, 0))
    by_name = F.col("key").startswith("name|")
    met = l.join(r, ["account_id", "side", "key", "c", "span"]).where((F.abs(F.col("c1") - F.col("c2")) <= cents) & (F.abs(F.datediff("date", "trade_date")) <= days) & (~by_name | F.col("pid").isNull() | F.col("qid").isNull()))
    mine = [F.col(c).eqNullSafe(F.col(f"x_{c}")) for c in said]

    pairs = met
    # counts of both ends by what rows say, in one pass over the pairs; a lone pair has one row at each end
    met = met.withColumn("claims", F.sum("n1").over(W.partitionBy("account_id", "side", "qid", "called", "date", "signed_total")))
    found = met.groupBy(*said).agg(F.sum("n2").alias("candidates"), F.min(F.struct("leg", "qid", "called", "date", "signed_total", "claims")).alias("best"))
    found = found.withColumn("claims", F.when((F.col("candidates") == 1) & (F.col("best.claims") == 1), F.lit(1)))

    rows = own.withColumn("ordinal", F.row_number().over(W.partitionBy("account_id", "side", "pid", "trade_date", "canonical_units", "gross_value").orderBy("row_id")) - 1)
    rows = rows.join(found.select(*[F.col(c).alias(f"x_{c}") for c in said], "candidates", "best", "claims"), mine, "left")
    lone = F.col("claims").isNotNull()
    leg = lambda c: F.when(lone, F.col(c))
    rows = rows.withColumns({"lone": lone, "cash_row": leg("best.leg.row_id"), "cash_date": leg("best.date"), "total": leg("best.signed_total"), "moved": leg("best.leg.units"), "qid": leg("best.qid")})
    first = rows.select(*[c.alias(n) for n, c in _of_trade().items()])

    meant = pairs.select(*[F.col(c).alias(f"y_{c}") for c in ("account_id", "side", "qid", "called", "date", "signed_total")]).distinct()
    rest = legs.join(meant, [F.col(c).eqNullSafe(F.col(f"y_{c}")) for c in ("account_id", "side", "qid", "called", "date", "signed_total")], "left_anti")
    second = rest.withColumnsRenamed({"date": "cash_date", "signed_total": "total", "row_id": "cash_row"}).select(*[c.alias(n) for n, c in _of_lost_leg().items()])
    return first.unionByName(second, allowMissingColumns=True)


def _of_trade() -> dict[str, Column]:
    """What match_exports says of a trade (account_id, side, pid, row_id, trade_date, canonical_units, gross_value, ordinal, candidates) and, if ``lone``, its leg (cash_row, cash_date, total, moved, qid)."""
    lone = F.col("lone")
    day, value, quantity = F.datediff("cash_date", "trade_date"), F.abs("total") - F.col("gross_value"), F.abs("moved") - F.col("canonical_units")
    status = (
        F.when(F.col("candidates").isNull(), "UNMATCHED_INVESTMENT").when(~lone, "AMBIGUOUS").when(quantity != 0, "QUANTITY_MISMATCH")
        .when((value != 0) | (day != 0), "MATCH_WITH_MINOR_DIFFERENCE").otherwise("MATCH")
    )
    why = F.array_compact(F.array(
        F.when(F.col("pid") == F.col("qid"), "product_id_exact").otherwise("security_name_confirmed"), F.when(value == 0, "gross_value_exact").otherwise("gross_value_within_tolerance"),
        F.when(day == 0, "same_day").otherwise(F.concat(F.lit("cash_date_delta_"), day, F.lit("d"))),
        F.when(quantity == 0, "quantity_exact").when(quantity != 0, "quantity_mismatch"), F.lit("brokerage_excluded_from_match_amount"),
    ))
    reasons = F.when(F.col("candidates").isNull(), F.array(F.lit("no_cash_row_matched_side_security_value_date"))).when(~lone, F.array(F.concat("candidates", F.lit("_equally_plausible_cash_rows")), F.lit("not_resolved_by_row_order"))).otherwise(why)
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    id_ = make_id("TRADEMATCH", F.col("account_id"), F.col("side"), F.col("pid"), F.col("trade_date"), F.col("canonical_units"), F.col("gross_value"), dash("cash_date"), dash("total"), F.col("ordinal"))
    own = {n: F.col(c) for n, c in {"account_id": "account_id", "side": "side", "security_id": "pid", "trade_row": "row_id", "cash_row": "cash_row", "trade_date": "trade_date", "cash_date": "cash_date"}.items()}
    return {"match_id": id_, "status": status, **own, "date_delta": day, "value_delta": value, "quantity_delta": quantity, "candidates": F.coalesce("candidates", F.lit(0)), "reasons": reasons}


def _of_lost_leg() -> dict[str, Column]:
    """What match_exports says of a leg (account_id, side, cash_class, qid, cash_row, cash_date, total) that no trade could mean."""
    lost = make_id("UNMATCHEDCASH", F.col("account_id"), F.col("cash_class"), F.col("qid"), F.col("cash_date"), F.col("total"))
    own = {n: F.col(c) for n, c in {"account_id": "account_id", "side": "side", "security_id": "qid", "cash_row": "cash_row", "cash_date": "cash_date"}.items()}
    return {"match_id": lost, "status": F.lit("UNMATCHED_CASH"), **own, "candidates": F.lit(0).cast("long"), "reasons": F.array(F.lit("no_investment_row_matched"))}


def pair_exports(trades: DataFrame, cash: DataFrame, cents: int = 1, days: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of :func:`match_exports`, and columns canonical_units, gross_value, cash_effect (of the leg) and ``keep`` of trades, in one exchange without joins.

    Both sides lie by account, side and stretch of ``_STRETCH`` cents and stream by amount; rows near an end of a stretch
    lie in both, one of them as a neighbour only. Only what lies within four times ``cents`` is held. What fits a row is
    counted as a range of sorted rows, so no pairs are made and a crowd of equal rows costs no more than others.
    """
    wide, ids = max(_STRETCH, 8 * cents), {d: d.schema["row_id"].dataType for d in (trades, cash)}
    no = lambda kind: F.lit(None).cast(kind)
    own = trades.select("account_id", "side", F.lit(1).alias("kind"), F.col("product_id").alias("pid"), _name("security_name").alias("name"), F.col("trade_date").alias("on"), F.col("canonical_units").alias("units"), F.col("gross_value").alias("amount"), F.col("row_id").alias("trade_row"), no(ids[cash]).alias("leg_row"), *keep)
    legs = cash.where(F.col("cash_class").isin(*LEG.values())).select("account_id", F.when(F.col("cash_class") == LEG["BUY"], "BUY").otherwise("SELL").alias("side"), F.lit(0).alias("kind"), F.col("product_id").alias("pid"), _name("product_name").alias("name"), F.col("date").alias("on"), "units", F.col("signed_total").alias("amount"), no(ids[trades]).alias("trade_row"), F.col("row_id").alias("leg_row"), *[no(trades.schema[c].dataType).alias(c) for c in keep])
    both = own.unionByName(legs).withColumn("c", _cents(F.col("amount")))
    at = lambda shift: F.floor((F.col("c") + shift) / wide)
    place = ["account_id", "side", "stretch"]
    both = both.withColumn("stretch", F.explode(F.array_distinct(F.array(at(-2 * cents), at(0), at(2 * cents))))).repartition(*place)
    same = W.partitionBy(*place, "kind", "pid", "on", "units", "amount").orderBy("trade_row")
    both = both.withColumns({"ordinal": F.row_number().over(same) - 1, "day": F.unix_date("on"), "here": F.coalesce(F.col("stretch") == at(0), F.lit(True))}).sortWithinPartitions(*place, "c")
    through = ["kind", "account_id", "side", "pid", "on", "units", "amount", "trade_row", "leg_row", "ordinal", *keep]
    leg = {"cash_row": "leg_row", "cash_date": "on", "total": "amount", "moved": "units", "qid": "pid"}
    shape = StructType([*[both.schema[c] for c in through], StructField("candidates", LongType()), StructField("lone", BooleanType()), *[StructField(n, both.schema[c].dataType) for n, c in leg.items()]])
    got = both.mapInArrow(partial(_counted, through=through, leg=leg, cents=cents, days=days, wide=wide), shape)

    is_trade, back = F.col("kind") == 1, {"canonical_units": ("units", trades), "gross_value": ("amount", trades)}
    # of a leg, what a trade's leg is called; units and amounts as they came, since both sides' lay in one column
    mine = {n: F.when(is_trade, F.col(n)).otherwise(F.col(c)) for n, c in leg.items()}
    types = {"total": cash.schema["signed_total"].dataType, "moved": cash.schema["units"].dataType}
    got = got.withColumns({n: c.cast(types[n]) if n in types else c for n, c in mine.items()} | {n: F.col(c).cast(d.schema[n].dataType) for n, (c, d) in back.items()})
    got = got.withColumns({"row_id": F.col("trade_row"), "trade_date": F.when(is_trade, F.col("on")), "cash_class": F.when(F.col("side") == "BUY", LEG["BUY"]).otherwise(LEG["SELL"])})
    lost = _of_lost_leg()
    said = [(F.when(is_trade, c).otherwise(lost[n]) if n in lost else F.when(is_trade, c)).alias(n) for n, c in _of_trade().items()]
    return got.select(*said, *[F.when(is_trade, F.col(c)).alias(c) for c in back], F.col("total").alias("cash_effect"), *keep)


def _within(place: np.ndarray, day: np.ndarray, key: np.ndarray, mine: np.ndarray, theirs: np.ndarray, cents: int, days: int, n: np.ndarray, mate: np.ndarray) -> None:
    """Adds to ``n`` how many of ``theirs`` have the key of each of ``mine`` within ``cents`` and ``days``, and sets one of them as its ``mate``."""
    if not len(mine) or not len(theirs):
        return
    keys, first = int(key.max()) + 1, int(day.min())
    span = int(day.max()) - first + 2 * days + 1
    both = place * keys + key
    known, of = np.unique(both[theirs], return_inverse=True)
    code = of * span + (day[theirs] - first + days)
    order = np.argsort(code, kind="stable")
    code = code[order]
    for off in range(-cents, cents + 1):
        want = both[mine] + off * keys
        at = np.minimum(np.searchsorted(known, want), len(known) - 1)
        hit = np.flatnonzero(known[at] == want)
        low = at[hit] * span + (day[mine[hit]] - first)
        start, end = np.searchsorted(code, low), np.searchsorted(code, low + 2 * days, "right")
        n[mine[hit]] += end - start
        some = end > start
        mate[mine[hit[some]]] = theirs[order[start[some]]]


def _counted(batches: Iterator[pa.RecordBatch], through: list[str], leg: dict[str, str], cents: int, days: int, wide: int) -> Iterator[pa.RecordBatch]:
    """Streams groups by amount: trades with how many legs fit them, and the leg if it fits no other; legs that fit nothing."""
    held, done, waiting = None, np.empty(0, bool), []

    def step(table: pa.Table, done: np.ndarray, end: bool) -> tuple[pa.Table, np.ndarray, pa.Table]:
        codes = lambda c: table.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        numbers = lambda c: table.column(c).fill_null(0).to_numpy().astype(np.int64)
        there = lambda c: table.column(c).is_valid().to_numpy()
        group = np.cumsum(np.any([np.diff(codes(c), prepend=0) != 0 for c in ("account_id", "side", "stretch")], axis=0))
        c, day, trade = numbers("c"), numbers("day"), numbers("kind") == 1
        known = there("account_id") & there("side") & there("c") & there("day")
        ready = np.ones(len(c), bool) if end else ~known | (group < group[-1]) | (c + 2 * cents < c[-1])
        place = (group - group[0]) * (wide + 6 * cents + 2) + c - numbers("stretch") * wide + 3 * cents
        name, product, named = codes("name").astype(np.int64), codes("pid").astype(np.int64), there("pid")
        day = np.where(known, day, day[known].min() if known.any() else 0)
        n, mate = np.zeros(len(c), np.int64), np.full(len(c), -1)
        rows = lambda on: np.flatnonzero(known & on)
        for key, a, b in ((product, trade & named, ~trade & named), (name, trade & ~named, ~trade), (name, trade & named, ~trade & ~named)):
            for mine, theirs in ((a, b), (b, a)):
                _within(place, day, key, rows(mine), rows(theirs), cents, days, n, mate)
        lone = trade & (n == 1) & (n[mate] == 1)
        out = np.flatnonzero(ready & ~done & table.column("here").to_numpy() & (trade | (n == 0)))
        taken = pa.array(mate[out], mask=~lone[out])
        columns = {x: table.column(x).take(out) for x in through} | {"candidates": pa.array(n[out], mask=n[out] == 0), "lone": pa.array(lone[out])} | {x: table.column(y).take(taken) for x, y in leg.items()}
        keep = ~ready | ((group == group[-1]) & known & (c >= c[-1] - 4 * cents))
        return table.filter(keep), ready[keep], pa.table(columns)

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) > len(done):  # what is held is looked at again when it has doubled
            rows = pa.Table.from_batches(waiting)
            held, done, out = step(rows if held is None else pa.concat_tables([held, rows]), np.append(done, np.zeros(len(rows), bool)), False)
            waiting = []
            yield from out.to_batches()
    if waiting:
        rows = pa.Table.from_batches(waiting)
        held, done = rows if held is None else pa.concat_tables([held, rows]), np.append(done, np.zeros(len(rows), bool))
    if held is not None and len(held):
        yield from step(held, done, True)[2].to_batches()


def trade_candidates(matches: DataFrame, trades: DataFrame, cash: DataFrame, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(trade candidates, brokerage fees) of trades that match: one candidate for a trade and its leg, one fee where it has brokerage.

    ``trades`` and ``cash`` as in :func:`match_exports`, trades also with (unit_price, canonical_brokerage). A buy's net
    amount is gross and brokerage, a sale's minus what is left of gross. A fee is dated by the cash row that charged it,
    whose description names side and security (see ``attach_brokerage``), else by the trade; ``fee_row`` names the row.
    """
    t = matches.where(F.col("status").isin(*MATCHED)).select("match_id", F.col("trade_row").alias("row_id"), "cash_row", "cash_date").join(trades, "row_id")
    legs = cash.select(F.col("row_id").alias("cash_row"), F.col("signed_total").alias("cash_effect"))
    return _candidates(t.join(legs, "cash_row"), cash, days)


def paired_candidates(trades: DataFrame, cash: DataFrame, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """:func:`trade_candidates` of :func:`pair_exports`: what a candidate needs comes with its pair, so that neither export is joined."""
    pairs = pair_exports(trades, cash, keep=("security_name", "unit_price", "canonical_brokerage"))
    return _candidates(pairs.where(F.col("status").isin(*MATCHED)).withColumnsRenamed({"trade_row": "row_id", "security_id": "product_id"}), cash, days)


def _candidates(t: DataFrame, cash: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """Candidates and fees of trades with their match_id, cash_row, cash_date and cash_effect."""
    t = t.withColumn("fingerprint", make_id("CSVTRADE", *[F.col(c) for c in ("account_id", "side", "product_id", "trade_date", "canonical_units", "unit_price", "gross_value")], length=20))
    t = t.withColumn("canonical_id", make_id("CANONICAL", F.col("fingerprint"), _ordinal("fingerprint"), length=20))
    paid = F.col("canonical_brokerage")
    charged = cash.where("cash_class = 'TRADE_BROKERAGE_CASH'").select("account_id", F.col("row_id").alias("fee_id"), F.col("date").alias("on"), F.col("signed_total").alias("amount"), F.col("product_name").alias("description"))
    others = ["match_id", "product_id", "cash_row", "cash_date", "cash_effect", "canonical_units", "gross_value", "unit_price", "canonical_id"]
    asks = t.select("account_id", F.col("row_id").alias("event_id"), F.col("side").alias("type"), _name("security_name").alias("security_id"), F.col("trade_date").alias("on"), paid.alias("brokerage"), *others)
    t = attach_brokerage(asks, charged, days).withColumnsRenamed({"event_id": "row_id", "type": "side", "on": "trade_date", "brokerage": "canonical_brokerage", "fee_id": "fee_row"})
    when = F.when(F.col("fee_row").isNotNull(), F.date_add("trade_date", F.col("days"))).otherwise(F.col("trade_date"))
    fee = F.when(paid > 0, make_id("CANONICAL", make_id("CSVFEE", F.col("account_id"), F.lit("BROKERAGE"), F.col("canonical_id"), when, paid, length=20), F.lit(0), length=20))
    net = F.when(F.col("side") == "BUY", F.col("gross_value") + paid).otherwise(-(F.col("gross_value") - paid))
    t = t.withColumns({"brokerage_fee_id": fee, "net_amount": net, "charged_on": when})
    one = t.select("account_id", "canonical_id", F.col("side").alias("type"), F.col("product_id").alias("security_id"), "trade_date", F.col("cash_date").alias("cash_effective_date"), "canonical_units", F.col("unit_price").alias("price"), F.col("gross_value").alias("gross_amount"), "cash_effect", "canonical_brokerage", "net_amount", F.lit("CLASSIFIED").alias("classification_status"), "match_id", F.col("row_id").alias("trade_row"), "cash_row", "brokerage_fee_id")
    note = F.when(F.col("fee_row").isNotNull(), "brokerage cash row matched to trade").otherwise("no cash brokerage row matched, dated on trade date")
    two = t.where(paid > 0).select(
        "account_id", F.col("brokerage_fee_id").alias("canonical_id"), F.lit("FEE").alias("type"), F.col("product_id").alias("security_id"), F.lit(None).cast("string").alias("security_type"), F.col("charged_on").alias("effective_date"), (-paid).alias("signed_amount"), F.lit("Trade brokerage").alias("description"),
        F.lit("TRADE_BROKERAGE").alias("classification_method"), F.lit("CLASSIFIED").alias("classification_status"), F.lit("TRADE_BROKERAGE").alias("source_semantic"), F.col("fee_row").alias("row_id"), note.alias("note"),
    )
    return one, two


def cash_candidates(cash: DataFrame, securities: DataFrame, fees: DataFrame | None = None) -> DataFrame:
    """Typed candidates of cash rows that are no legs of trades, and of no brokerage that ``fees`` has charged already.

    ``securities``: (security_id, product_id, name, priority, type). Distributions take type and security from it; one
    that isn't known is UNRESOLVED_SECURITY and stays a distribution. Negative deposits take funding back, so they stay
    deposits; positive admin fees and brokerage without a trade need reconciliation. Signs are as exported.
    """
    own = cash.where(~F.col("cash_class").isin(*LEG.values()))
    if fees is not None:
        own = own.join(fees.where("row_id IS NOT NULL").select("row_id"), "row_id", "left_anti")
    kinds = securities.groupBy("security_id").agg(F.min_by("type", "priority").alias("security_type"))
    cls, up = F.col("cash_class"), F.col("signed_total") > 0
    income = cls == "DISTRIBUTION_INCOME"
    own = resolve_security(own, securities).withColumn("security_id", F.when(income, F.col("security_id"))).join(kinds, "security_id", "left")
    known = F.col("security_id").isNotNull()
    own = own.withColumns({
        "type": F.when(income & known, income_type_for(F.col("security_type"))).when(income, "DISTRIBUTION").when(cls.isin("ADMIN_FEE", "FEE_REVERSAL", "TRADE_BROKERAGE_CASH"), "FEE").otherwise(cls),
        "classification_method": F.when(income, "SECURITY_TYPE_NORMALIZATION").when(cls == "FEE_REVERSAL", "FEE_REVERSAL").when(cls == "TRADE_BROKERAGE_CASH", "TRADE_BROKERAGE").otherwise("DIRECT_TYPE_MAP"),
        "classification_status": F.when(income & ~known, "UNRESOLVED_SECURITY").when((cls == "TRADE_BROKERAGE_CASH") | ((cls == "ADMIN_FEE") & up), "NEEDS_RECONCILIATION").otherwise("CLASSIFIED"),
        "source_semantic": F.when((cls == "DEPOSIT") & (F.col("signed_total") < 0), "DEPOSIT_REVERSAL").when((cls == "ADMIN_FEE") & up, "POSITIVE_ADMIN_FEE").when(cls.isin("ADMIN_FEE", "FEE_REVERSAL"), cls).when(cls == "TRADE_BROKERAGE_CASH", "UNMATCHED_TRADE_BROKERAGE"),
    })
    own = own.withColumn("fingerprint", make_id("CSVCASH", F.col("account_id"), cls, F.col("date"), F.col("signed_total"), F.col("security_id"), slug(F.coalesce("product_name", F.lit(""))), length=20))
    return own.select("account_id", make_id("CANONICAL", F.col("fingerprint"), _ordinal("fingerprint"), length=20).alias("canonical_id"), "type", "security_id", "security_type", F.col("date").alias("effective_date"), F.col("signed_total").alias("signed_amount"), F.col("product_name").alias("description"), "classification_method", "classification_status", "source_semantic", "row_id")


def candidate_counts(trades: DataFrame, cash: DataFrame) -> DataFrame:
    """By account and meaning (the source's where it has one, else the type): how many candidates, and how many aren't classified."""
    both = trades.select("account_id", F.col("type").alias("meaning"), "classification_status").unionByName(cash.select("account_id", F.coalesce("source_semantic", "type").alias("meaning"), "classification_status"))
    return both.groupBy("account_id", "meaning").agg(F.count("*").alias("n"), F.count_if(F.col("classification_status") != "CLASSIFIED").alias("unresolved"))


def build_securities(mentions: DataFrame, by: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Securities of statements, out of mentions (*by*, at, code, name, asset_class), ``at`` ordering them: (*by*, security_id, code, name, type).

    The name is the first mention's, and so is the type, unless that is SHARE: then the first later mention under a
    heading that says otherwise decides. Codes of which nothing is left are dropped.
    """
    own = mentions.withColumn("code", normalise_code(F.col("code"))).where("code IS NOT NULL")
    first = F.col("at") == F.min("at").over(W.partitionBy(*by, "code"))
    own = own.withColumn("kind", security_type(F.col("asset_class"), F.col("name"))).withColumn("__says", (F.col("kind") != "SHARE") & (first | F.col("asset_class").isNotNull()))
    got = own.groupBy(*by, "code").agg(F.min_by("name", "at").alias("name"), F.coalesce(F.min_by("kind", F.when(F.col("__says"), F.col("at"))), F.lit("SHARE")).alias("type"))
    return got.select(*by, make_id("SEC", F.col("code")).alias("security_id"), "code", "name", "type")
