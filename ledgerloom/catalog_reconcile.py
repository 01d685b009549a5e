"""Registered queries of reconciliation and promotion, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog import _TWO, _d, _two_sources, query
from ledgerloom.operators import reconcile
from ledgerloom.sources import testdata as td


def _chosen(block: str, prefer: str) -> str:
    """Steps of one-to-one choice over cd (block columns, id1, on1, id2 and what is preferred): og has (id1, id2)."""
    same = " AND ".join(f"st.{c} = g.{c}" for c in block.split(", "))
    named = ", ".join(f"st.{c}" for c in block.split(", "))
    return f"""st AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY {block} ORDER BY on1, id1) AS n FROM cd),
    g({block}, n, used, id1, best) AS (SELECT DISTINCT {block}, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR FROM st
        UNION ALL SELECT {block}, n, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, id1, best FROM (
            SELECT {named}, st.n, g.used, st.id1, arg_min(st.id2, ({prefer}, st.id2)) FILTER (NOT list_contains(g.used, st.id2)) AS best FROM g JOIN st ON {same} AND st.n = g.n + 1 GROUP BY ALL)),
    og AS (SELECT id1, best AS id2 FROM g WHERE best IS NOT NULL)"""


_RESULTS = """rs AS (SELECT a.account_id, a.type, og.id1, og.id2, CASE WHEN abs(a.u - b.u) > 0.0001 THEN 'QUANTITY_MISMATCH' WHEN a.c <> b.c THEN 'MATCH_WITH_MINOR_DIFFERENCE' WHEN a.d <> b.d THEN 'TIMING_DIFFERENCE' ELSE 'MATCH' END AS status FROM og JOIN a ON a.id = og.id1 JOIN b ON b.id = og.id2
    UNION ALL SELECT a.account_id, a.type, a.id, NULL, CASE WHEN lo IS NULL OR a.d < lo OR a.d > hi THEN 'SOURCE_COVERAGE_DIFFERENCE' ELSE 'OWN_ONLY' END FROM a LEFT JOIN (SELECT account_id, min(d) AS lo, max(d) AS hi FROM b GROUP BY ALL) s ON s.account_id = a.account_id WHERE a.id NOT IN (SELECT id1 FROM og)
    UNION ALL SELECT b.account_id, b.type, NULL, b.id, CASE WHEN lo IS NULL OR b.d < lo OR b.d > hi THEN 'SOURCE_COVERAGE_DIFFERENCE' ELSE 'OTHER_ONLY' END FROM b LEFT JOIN (SELECT account_id, min(d) AS lo, max(d) AS hi FROM a GROUP BY ALL) s ON s.account_id = b.account_id WHERE b.id NOT IN (SELECT id2 FROM og)),
    re AS (SELECT *, status IN ('MATCH', 'MATCH_WITH_MINOR_DIFFERENCE', 'TIMING_DIFFERENCE', 'SOURCE_COVERAGE_DIFFERENCE') AS resolved,
           CASE WHEN status IN ('OWN_ONLY', 'OTHER_ONLY', 'QUANTITY_MISMATCH') THEN 'UNRESOLVED' WHEN status = 'SOURCE_COVERAGE_DIFFERENCE' AND id1 IS NULL THEN 'OTHER_ONLY_SUPPORTED' ELSE 'OWN_PREFERRED' END AS authority FROM rs)"""

# the other source lacks some rows of most accounts, has some days or a cent apart, and starts later
_GONE = "k % 7 = 0 AND account_id % 4 <> 1"
_CASH = f""", e AS (SELECT account_id, event_id::VARCHAR AS id, type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'S' || event_id % 3 END AS s, trade_date AS d, (amount * 100)::BIGINT AS c, event_id AS k, NULL::DOUBLE AS u FROM ca),
    a AS (SELECT * FROM e WHERE d >= (SELECT min(d) + 2 FROM e) OR account_id % 2 = 0),
    b AS (SELECT account_id, 'x' || id AS id, type, CASE WHEN k % 11 = 0 THEN 'S9' ELSE s END AS s, (d + CASE k % 7 WHEN 1 THEN 2 WHEN 2 THEN 9 ELSE 0 END)::DATE AS d, c + CASE WHEN k % 7 = 3 THEN 1 ELSE 0 END AS c, u FROM e WHERE NOT ({_GONE}) AND d >= (SELECT min(d) + 4 FROM e)),
    gp AS (SELECT *, c - lag(c) OVER (PARTITION BY account_id, type ORDER BY c) > 1 AS gap FROM (SELECT account_id, type, c FROM a UNION SELECT account_id, type, c FROM b)),
    bl AS (SELECT account_id, type, c, coalesce(sum(gap::INTEGER) OVER (PARTITION BY account_id, type ORDER BY c), 0) AS block FROM gp),
    cd AS MATERIALIZED (SELECT a.account_id, a.type, block, a.id AS id1, a.d AS on1, b.id AS id2, CASE WHEN a.s <> b.s THEN 1 ELSE 0 END AS tier, abs(a.d - b.d) AS days FROM a JOIN bl ON bl.account_id = a.account_id AND bl.type = a.type AND bl.c = a.c
           JOIN b ON b.account_id = a.account_id AND b.type = a.type AND b.c IN (a.c - 1, a.c, a.c + 1) AND abs(a.d - b.d) <= 7),
    {_chosen("account_id, type, block", "st.tier, st.days")}, {_RESULTS}"""


def _cash(spark, sf):
    ca = td.cash_events(spark, sf)
    k = F.col("event_id")
    e = ca.select("account_id", k.cast("string").alias("event_id"), "type", F.when(k % 5 != 0, F.concat(F.lit("S"), k % 3)).alias("security_id"), F.col("trade_date").alias("on"), "amount", k.alias("k"))
    first = ca.agg(F.min("trade_date")).first()[0]
    own = e.where((F.col("on") >= F.date_add(F.lit(first), 2)) | (F.col("account_id") % 2 == 0)).drop("k")
    k = F.col("k")
    other = e.where((F.col("on") >= F.date_add(F.lit(first), 4)) & ~F.expr(_GONE)).select(
        "account_id", F.concat(F.lit("x"), "event_id").alias("event_id"), "type", F.when(k % 11 == 0, "S9").otherwise(F.col("security_id")).alias("security_id"), F.date_add("on", F.when(k % 7 == 1, 2).when(k % 7 == 2, 9).otherwise(0)).alias("on"),
        (F.col("amount") + F.when(k % 7 == 3, F.lit("0.01").cast("decimal(3,2)")).otherwise(0)).cast("decimal(18,2)").alias("amount"),
    )
    return own, other


def _cash_results(spark, sf):
    own, other = _cash(spark, sf)
    return reconcile.reconciled(own, other, reconcile.cash_pairs(own, other))


@query(f"{_CASH} SELECT account_id, type, id1, id2, status, authority, resolved FROM re")
def reconcile_cash(spark, sf):
    return _cash_results(spark, sf)


_TRADES = f""", a AS (SELECT account_id, event_id AS id, type, security_id AS s, trade_date AS d, (gross * 100)::BIGINT AS c, units::DOUBLE AS u FROM tr),
    b AS (SELECT account_id, 'x' || event_id AS id, type, security_id AS s, (trade_date + CASE z WHEN 1 THEN 2 WHEN 2 THEN 9 ELSE 0 END)::DATE AS d, (gross * 100)::BIGINT + CASE WHEN z = 3 THEN 1 ELSE 0 END AS c, units::DOUBLE + CASE WHEN units % 10 = 4 THEN 0.25 ELSE 0 END AS u FROM ({_TWO}) WHERE z <> 0),
    gp AS (SELECT *, d - lag(d) OVER (PARTITION BY account_id, type, s ORDER BY d) > 7 AS gap FROM (SELECT account_id, type, s, d FROM a UNION SELECT account_id, type, s, d FROM b)),
    bl AS (SELECT account_id, type, s, d, coalesce(sum(gap::INTEGER) OVER (PARTITION BY account_id, type, s ORDER BY d), 0) AS block FROM gp),
    cd AS MATERIALIZED (SELECT a.account_id, a.type, a.s, block, a.id AS id1, a.d AS on1, b.id AS id2, abs(a.d - b.d) AS days, abs(a.c - b.c) AS off FROM a JOIN bl ON bl.account_id = a.account_id AND bl.type = a.type AND bl.s = a.s AND bl.d = a.d
           JOIN b ON b.account_id = a.account_id AND b.type = a.type AND b.s = a.s AND abs(a.d - b.d) <= 7 AND abs(a.u - b.u) < 0.5),
    {_chosen("account_id, type, s, block", "st.days, st.off")}, {_RESULTS}"""


@query(f"{_TRADES} SELECT account_id, type, id1, id2, status, authority, resolved FROM re")
def reconcile_trades(spark, sf):
    one, other = _two_sources(spark, sf, stored=True)
    shape = lambda d, units: d.select("account_id", "event_id", "type", "security_id", F.col("trade_date").alias("on"), F.col("gross").alias("amount"), units.alias("units"))
    a, b = shape(one, F.col("units").cast("double")), shape(other, F.col("units").cast("double") + F.when(F.col("units") % 10 == 4, 0.25).otherwise(0.0))
    return reconcile.reconciled_trades(a, b)


@query(f"{_CASH} SELECT account_id, status, count(*) AS n, count(id1) = count(DISTINCT id1) AS one_to_one FROM re GROUP BY ALL")
def match_summary(spark, sf):
    return reconcile.match_summary(_cash_results(spark, sf))


_POLICY = f"{_CASH}, po AS (SELECT *, max(unresolved) OVER (PARTITION BY account_id) = 0 AS promotion_ready FROM (SELECT account_id, type, count(*) FILTER (NOT resolved) AS unresolved FROM re GROUP BY ALL))"


@query(f"{_POLICY} SELECT account_id, type, unresolved, CASE WHEN unresolved > 0 THEN 'UNRESOLVED' ELSE 'OWN_PREFERRED' END AS authority, promotion_ready FROM po")
def authority_policy(spark, sf):
    return reconcile.authority_policy(_cash_results(spark, sf))


@query(f"""{_POLICY}, ok AS (SELECT DISTINCT account_id FROM po WHERE promotion_ready) SELECT account_id, id AS event_id, type, (c / 100.0)::DOUBLE AS amount FROM b WHERE id NOT IN (SELECT id2 FROM re WHERE id1 IS NOT NULL AND id2 IS NOT NULL AND account_id IN (SELECT account_id FROM ok))
    UNION ALL SELECT account_id, id, type, (c / 100.0)::DOUBLE FROM a WHERE account_id IN (SELECT account_id FROM ok)""")
def promotion(spark, sf):
    """The other source's ledger after accounts that are ready were promoted."""
    own, other = _cash(spark, sf)
    results = _cash_results(spark, sf)
    superseded, new = reconcile.promotion_plan(results, reconcile.authority_policy(results))
    return _d(reconcile.apply_promotion(other, own, superseded, new).select("account_id", "event_id", "type", "amount"))


@query("SELECT event_id, left(sha256('EVENT|' || account_id || '|' || type || '||' || trade_date || '|' || amount::DECIMAL(18,2)), 20) AS fingerprint, (row_number() OVER (PARTITION BY account_id, type, trade_date, amount ORDER BY event_id) - 1)::INTEGER AS ordinal, left(sha256('CANONICAL|' || left(sha256('EVENT|' || account_id || '|' || type || '||' || trade_date || '|' || amount::DECIMAL(18,2)), 20) || '|' || (row_number() OVER (PARTITION BY account_id, type, trade_date, amount ORDER BY event_id) - 1)), 20) AS canonical_id FROM ca")
def canonical_ids(spark, sf):
    own = td.cash_events(spark, sf).withColumnRenamed("trade_date", "on").withColumn("security_id", F.lit(None).cast("string"))
    return reconcile.canonical_ids(own).select("event_id", "fingerprint", "ordinal", "canonical_id")


@query("""SELECT event_id, CASE WHEN k = 0 THEN security_id WHEN k = 1 THEN NULL WHEN security_id = 'Brand#1' THEN NULL ELSE security_id END AS security_id FROM (SELECT event_id, security_id, units::BIGINT % 3 AS k FROM tr)""")
def resolve_security(spark, sf):
    """Trades that name their security by product id, by an unknown one, or by name; one brand's name isn't known."""
    tr = td.trades(spark, sf)
    k = F.col("units").cast("long") % 3
    rows = tr.select("event_id", F.when(k == 0, F.concat(F.lit("P-"), "security_id")).when(k == 1, "P-none").alias("product_id"), F.concat(F.lit(" "), F.upper("security_id"), F.lit(" ")).alias("product_name"))
    brands = tr.select("security_id").distinct()
    known = brands.select("security_id", F.concat(F.lit("P-"), "security_id").alias("product_id"), F.when(F.col("security_id") != "Brand#1", F.col("security_id")).alias("name"), F.lit(1).alias("priority"))
    later = known.withColumns({"security_id": F.lit("Z"), "priority": F.lit(2)})
    return reconcile.resolve_security(rows, known.unionByName(later)).select("event_id", "security_id")


@query(""", f AS (SELECT account_id, type, security_id, trade_date AS d, (fees * 100)::BIGINT AS c, event_id FROM tr WHERE fees > 0), cd AS MATERIALIZED (SELECT t.account_id, t.c, t.event_id AS id1, t.d AS on1, 'fee-' || f.event_id AS id2, (f.d + 3 - t.d) AS days FROM f t JOIN f ON f.account_id = t.account_id AND f.c = t.c AND f.type = t.type AND contains(lower(f.type || ' transaction fee for ' || f.security_id), lower(t.security_id)) AND f.d + 3 - t.d BETWEEN 0 AND 7 AND day(f.d) % 4 <> 0), """
    + _chosen("account_id, c", "st.days") + " SELECT tr.event_id, og.id2 AS fee_id, cd.days::INTEGER AS days FROM tr LEFT JOIN og ON og.id1 = tr.event_id LEFT JOIN cd ON cd.id1 = og.id1 AND cd.id2 = og.id2")
def attach_brokerage(spark, sf):
    """Each trade's fees as a cash row three days later, but for some days of the month."""
    tr = td.stored_trades(spark, sf)
    fees = tr.where((F.col("fees") > 0) & (F.day("trade_date") % 4 != 0)).select("account_id", F.concat(F.lit("fee-"), "event_id").alias("fee_id"), F.date_add("trade_date", 3).alias("on"), (-F.col("fees")).alias("amount"), F.concat("type", F.lit(" transaction fee for "), "security_id").alias("description"))
    return reconcile.attach_brokerage(tr.select("account_id", "event_id", "type", "security_id", F.col("trade_date").alias("on"), F.col("fees").alias("brokerage")), fees).select("event_id", "fee_id", "days")
