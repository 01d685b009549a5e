"""Registered queries of canonical candidates, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog import _d, query
from ledgerloom.operators import candidates
from ledgerloom.sources import testdata as td

# legs go missing, come late or a cent off, have other units, no product id, another name or another product, or come twice
_EXPORTS = """, tt AS (SELECT account_id, event_id AS row_id, type AS side, CASE WHEN units % 4 <> 0 THEN security_id END AS pid, lower(security_id) AS name, trade_date AS d, units, gross, fees, units::BIGINT % 10 AS z FROM tr),
    cc AS (SELECT account_id, 'c' || n || row_id AS row_id, CASE WHEN side = 'BUY' THEN 'TRADE_BUY_CASH' ELSE 'TRADE_SELL_CASH' END AS cls, side, CASE WHEN z = 7 THEN 'OTHER' WHEN z <> 5 THEN 'B' || substr(name, 2) END AS qid, CASE WHEN z = 6 THEN 'another name' ELSE name END AS called,
           (d + CASE z WHEN 1 THEN 2 WHEN 2 THEN 9 ELSE 0 END)::DATE AS d, (CASE WHEN side = 'BUY' THEN -1 ELSE 1 END * (gross + CASE WHEN z = 3 THEN 0.01 ELSE 0 END))::DECIMAL(18,2) AS total, CASE WHEN z = 9 THEN NULL ELSE units + CASE WHEN z = 4 THEN 0.25 ELSE 0 END END AS u
           FROM tt JOIN (VALUES (1), (2)) v(n) ON n = 1 OR z = 8 WHERE z <> 0),
    cd AS MATERIALIZED (SELECT t.row_id AS r1, c.row_id AS r2 FROM tt t JOIN cc c ON c.account_id = t.account_id AND c.side = t.side AND CASE WHEN pid IS NOT NULL AND qid IS NOT NULL THEN pid = qid ELSE name = called END AND abs(abs(total) - gross) <= 0.01 AND abs(c.d - t.d) <= 5),
    n1 AS (SELECT r1, count(*) AS n, min(r2) AS r2 FROM cd GROUP BY ALL), n2 AS (SELECT r2, count(*) AS m FROM cd GROUP BY ALL),
    mm AS (SELECT t.account_id, t.side, pid, name, qid, t.row_id AS trade_row, c.row_id AS cash_row, t.d AS td, c.d AS cdate, n, t.units, t.gross, t.fees, total, c.d - t.d AS dd, abs(total) - t.gross AS vd, abs(u) - t.units AS qd, n IS NOT NULL AND c.row_id IS NULL AS contested FROM tt t LEFT JOIN n1 ON r1 = t.row_id LEFT JOIN n2 ON n2.r2 = n1.r2 LEFT JOIN cc c ON c.row_id = n1.r2 AND n = 1 AND m = 1),
    st AS (SELECT *, CASE WHEN n IS NULL THEN 'UNMATCHED_INVESTMENT' WHEN contested THEN 'AMBIGUOUS' WHEN qd <> 0 THEN 'QUANTITY_MISMATCH' WHEN vd <> 0 OR dd <> 0 THEN 'MATCH_WITH_MINOR_DIFFERENCE' ELSE 'MATCH' END AS status FROM mm)"""


def _exports(spark, sf):
    tr = td.stored_trades(spark, sf)
    z, name = F.col("units").cast("long") % 10, F.lower("security_id")
    trades = tr.select("account_id", F.col("event_id").alias("row_id"), F.col("type").alias("side"), F.when(F.col("units") % 4 != 0, F.col("security_id")).alias("product_id"), F.concat(F.lit(" "), F.upper("security_id")).alias("security_name"), "trade_date", F.col("units").alias("canonical_units"), (F.col("gross") / F.col("units")).cast("decimal(18,6)").alias("unit_price"), F.col("gross").alias("gross_value"), F.col("fees").alias("canonical_brokerage"))
    off = F.when(z == 3, F.lit("0.01").cast("decimal(3,2)")).otherwise(0)
    legs = tr.where(z != 0).withColumn("n", F.explode(F.when(z == 8, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select(
        "account_id", F.concat(F.lit("c"), "n", "event_id").alias("row_id"), F.when(F.col("type") == "BUY", "TRADE_BUY_CASH").otherwise("TRADE_SELL_CASH").alias("cash_class"), F.when(z == 7, "OTHER").when(z != 5, F.col("security_id")).alias("product_id"), F.when(z == 6, "another name").otherwise(name).alias("product_name"),
        F.date_add("trade_date", F.when(z == 1, 2).when(z == 2, 9).otherwise(0)).alias("date"), (F.when(F.col("type") == "BUY", -1).otherwise(1) * (F.col("gross") + off)).cast("decimal(18,2)").alias("signed_total"), F.when(z != 9, (F.col("units") + F.when(z == 4, F.lit("0.25").cast("decimal(3,2)")).otherwise(0)).cast("decimal(18,2)")).alias("units"),
    )
    charged = tr.where((F.col("fees") > 0) & (F.day("trade_date") % 4 != 0)).select("account_id", F.concat(F.lit("f"), "event_id").alias("row_id"), F.lit("TRADE_BROKERAGE_CASH").alias("cash_class"), F.lit(None).cast("string").alias("product_id"), F.concat(F.lit("Transaction fee for "), "security_id", F.lit(" "), F.initcap("type")).alias("product_name"), F.date_add("trade_date", 3).alias("date"), (-F.col("fees")).cast("decimal(18,2)").alias("signed_total"), F.lit(None).cast("decimal(18,2)").alias("units"))
    return trades, legs.unionByName(charged)


@query(f"""{_EXPORTS} SELECT account_id, status, side, pid AS security_id, trade_row, cash_row, td AS trade_date, cdate AS cash_date, dd::INTEGER AS date_delta, vd::DOUBLE AS value_delta, qd::DOUBLE AS quantity_delta, coalesce(n, 0) AS candidates,
    CASE WHEN n IS NULL THEN 'no_cash_row_matched_side_security_value_date' WHEN contested THEN n || '_equally_plausible_cash_rows,not_resolved_by_row_order' ELSE concat_ws(',', CASE WHEN pid = qid THEN 'product_id_exact' ELSE 'security_name_confirmed' END, CASE WHEN vd = 0 THEN 'gross_value_exact' ELSE 'gross_value_within_tolerance' END,
        CASE WHEN dd = 0 THEN 'same_day' ELSE 'cash_date_delta_' || dd || 'd' END, CASE WHEN qd = 0 THEN 'quantity_exact' WHEN qd <> 0 THEN 'quantity_mismatch' END, 'brokerage_excluded_from_match_amount') END AS reasons FROM st
    UNION ALL SELECT account_id, 'UNMATCHED_CASH', side, qid, NULL, row_id, NULL, d, NULL, NULL, NULL, 0, 'no_investment_row_matched' FROM cc WHERE row_id NOT IN (SELECT r2 FROM cd)""")
def matched_exports(spark, sf):
    """Trades of one export against cash legs of the other, with reasons and deltas."""
    return _d(candidates.pair_exports(*_exports(spark, sf)).drop("match_id", "canonical_units", "gross_value", "cash_effect").withColumn("reasons", F.array_join("reasons", ",")))


@query(f"{_EXPORTS} SELECT account_id, side AS type, pid AS security_id, td AS trade_date, cdate AS cash_effective_date, units::DOUBLE AS canonical_units, gross::DOUBLE AS gross_amount, total::DOUBLE AS cash_effect, fees::DOUBLE AS canonical_brokerage, CASE WHEN side = 'BUY' THEN gross + fees ELSE fees - gross END::DOUBLE AS net_amount, trade_row, cash_row, fees > 0 AS has_fee FROM st WHERE status IN ('MATCH', 'MATCH_WITH_MINOR_DIFFERENCE')")
def candidate_trades(spark, sf):
    """One candidate for each trade that has its leg."""
    trades, cash = _exports(spark, sf)
    one, _ = candidates.paired_candidates(trades, cash)
    return _d(one.withColumn("has_fee", F.col("brokerage_fee_id").isNotNull()).drop("canonical_id", "match_id", "brokerage_fee_id", "price", "classification_status"))


# cash rows of all classes; one product isn't known
_CASHED = """, cs AS (SELECT account_id, event_id AS row_id, trade_date AS d, CASE WHEN type IN ('DIVIDEND', 'DISTRIBUTION') THEN 'DISTRIBUTION_INCOME' WHEN type <> 'FEE' THEN type WHEN event_id % 7 = 1 THEN 'FEE_REVERSAL' WHEN event_id % 7 = 2 THEN 'TRADE_BROKERAGE_CASH' ELSE 'ADMIN_FEE' END AS cls,
    CASE WHEN event_id % 7 = 0 OR type = 'FEE' AND event_id % 7 = 1 THEN -amount ELSE amount END AS total, event_id % 5 AS p FROM ca)"""


@query(f"""{_CASHED} SELECT account_id, row_id, d AS effective_date, total::DOUBLE AS signed_amount, CASE WHEN cls = 'DISTRIBUTION_INCOME' THEN CASE WHEN p < 2 THEN 'DIVIDEND' ELSE 'DISTRIBUTION' END WHEN cls IN ('ADMIN_FEE', 'FEE_REVERSAL', 'TRADE_BROKERAGE_CASH') THEN 'FEE' ELSE cls END AS type,
    CASE WHEN cls = 'DISTRIBUTION_INCOME' AND p < 4 THEN 'S' || p END AS security_id, CASE WHEN cls = 'DISTRIBUTION_INCOME' AND p < 4 THEN CASE p WHEN 2 THEN 'ETF' WHEN 3 THEN 'MANAGED_FUND' ELSE 'SHARE' END END AS security_type,
    CASE WHEN cls = 'DISTRIBUTION_INCOME' THEN 'SECURITY_TYPE_NORMALIZATION' WHEN cls = 'FEE_REVERSAL' THEN 'FEE_REVERSAL' WHEN cls = 'TRADE_BROKERAGE_CASH' THEN 'TRADE_BROKERAGE' ELSE 'DIRECT_TYPE_MAP' END AS classification_method,
    CASE WHEN cls = 'DISTRIBUTION_INCOME' AND p = 4 THEN 'UNRESOLVED_SECURITY' WHEN cls = 'TRADE_BROKERAGE_CASH' OR cls = 'ADMIN_FEE' AND total > 0 THEN 'NEEDS_RECONCILIATION' ELSE 'CLASSIFIED' END AS classification_status,
    CASE WHEN cls = 'DEPOSIT' AND total < 0 THEN 'DEPOSIT_REVERSAL' WHEN cls = 'ADMIN_FEE' AND total > 0 THEN 'POSITIVE_ADMIN_FEE' WHEN cls IN ('ADMIN_FEE', 'FEE_REVERSAL') THEN cls WHEN cls = 'TRADE_BROKERAGE_CASH' THEN 'UNMATCHED_TRADE_BROKERAGE' END AS source_semantic FROM cs""")
def candidate_cash(spark, sf):
    """Cash rows of all classes as typed candidates."""
    ca, k = td.cash_events(spark, sf), F.col("event_id") % 7
    cls = F.when(F.col("type").isin("DIVIDEND", "DISTRIBUTION"), "DISTRIBUTION_INCOME").when(F.col("type") != "FEE", F.col("type")).when(k == 1, "FEE_REVERSAL").when(k == 2, "TRADE_BROKERAGE_CASH").otherwise("ADMIN_FEE")
    total = F.when((k == 0) | ((F.col("type") == "FEE") & (k == 1)), -F.col("amount")).otherwise(F.col("amount")).cast("decimal(18,2)")
    cash = ca.select("account_id", F.col("event_id").alias("row_id"), cls.alias("cash_class"), F.lit(None).cast("string").alias("product_id"), F.concat(F.lit("Product "), F.col("event_id") % 5).alias("product_name"), F.col("trade_date").alias("date"), total.alias("signed_total"))
    p = F.col("event_id") % 5
    known = ca.select(p.alias("p")).distinct().where("p < 4").select(F.concat(F.lit("S"), "p").alias("security_id"), F.lit(None).cast("string").alias("product_id"), F.concat(F.lit("product "), "p").alias("name"), F.lit(1).alias("priority"), F.when(F.col("p") == 2, "ETF").when(F.col("p") == 3, "MANAGED_FUND").otherwise("SHARE").alias("type"))
    return _d(candidates.cash_candidates(cash, known).drop("canonical_id", "description"))


_MENTION = "CASE WHEN units % 3 = 0 THEN 'etf' WHEN units % 7 = 0 THEN 'australian_share' END"


@query(f"""SELECT account_id AS document_id, left(sha256('SEC|' || code), 16) AS security_id, code, arg_min(name, k) AS name, coalesce(arg_min(kind, k) FILTER (kind <> 'SHARE' AND (k = f OR cls IS NOT NULL)), 'SHARE') AS type FROM (
    SELECT *, min(k) OVER (PARTITION BY account_id, code) AS f, CASE cls WHEN 'etf' THEN 'ETF' WHEN 'australian_share' THEN 'SHARE' ELSE CASE WHEN name LIKE '%fund%' THEN 'MANAGED_FUND' ELSE 'SHARE' END END AS kind FROM (
        SELECT account_id, upper(regexp_replace(security_id, '[^A-Za-z0-9]', '', 'g')) AS code, trade_date || event_id AS k, 'Some ' || CASE WHEN units % 5 = 0 THEN 'fund' ELSE 'name' END AS name, {_MENTION} AS cls FROM tr)) GROUP BY account_id, code""")
def statement_securities(spark, sf):
    """Securities that accounts' rows mention, some under headings that correct the first type."""
    tr = td.trades(spark, sf)
    rows = tr.select(F.col("account_id").alias("document_id"), F.concat(F.col("security_id"), F.lit(".AX")).alias("code"), F.concat("trade_date", "event_id").alias("at"), F.concat(F.lit("Some "), F.when(F.col("units") % 5 == 0, "fund").otherwise("name")).alias("name"), F.expr(_MENTION).alias("asset_class"))
    return candidates.build_securities(rows)
