"""Registered queries of valuation histories and of performance over windows, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog import _DAILY, _PRICES, _RETURNS, _UNITS, _d, _returns, query
from ledgerloom.operators import analytics, ledger, windows
from ledgerloom.sources import testdata as td

_R = lambda x, places=3: f"(round(0.0000123 + ({x})::DOUBLE, {places}) + 0.0::DOUBLE)"

_HISTORY = f"""{_UNITS}, {_PRICES}, lm AS (SELECT account_id, security_id, last_day(trade_date) AS "on", arg_max(held, (trade_date, type, event_id)) AS held FROM h GROUP BY ALL),
    gr AS (SELECT d.account_id, f.security_id, d."on" FROM (SELECT DISTINCT account_id, "on" FROM lm) d JOIN (SELECT account_id, security_id, min("on") AS first FROM lm GROUP BY ALL) f ON f.account_id = d.account_id AND d."on" >= f.first),
    un AS (SELECT gr.account_id, gr.security_id, gr."on", last_value(held IGNORE NULLS) OVER (PARTITION BY gr.account_id, gr.security_id ORDER BY gr."on") AS units FROM gr LEFT JOIN lm ON lm.account_id = gr.account_id AND lm.security_id = gr.security_id AND lm."on" = gr."on"),
    hs AS (SELECT account_id, un.security_id, "on", units, price, CASE WHEN units = 0 THEN 'NOT_HELD' WHEN price IS NULL THEN 'UNAVAILABLE' WHEN price_date = "on" THEN 'QUOTED' ELSE 'CARRIED_FORWARD' END AS quality, CASE WHEN units = 0 THEN 0 ELSE units::DOUBLE * price END AS value
           FROM un ASOF LEFT JOIN pr ON pr.security_id = un.security_id AND un."on" >= pr.price_date)"""


def _history(spark, sf):
    tr = td.trades(spark, sf)
    return windows.valuation_history(tr, td.prices(tr), "month")


@query(f", {_HISTORY} SELECT account_id, security_id, \"on\", units::DOUBLE AS units, {_R('price')} AS price, quality, {_R('value')} AS value FROM hs")
def valuation_history(spark, sf):
    return _history(spark, sf).select("account_id", "security_id", "on", F.col("units").cast("double").alias("units"), F.round(F.col("price") + 0.0000123, 3).alias("price"), "quality", F.round(F.col("value") + 0.0000123, 3).alias("value"))


@query(f""", {_HISTORY} SELECT account_id, "on", {_R('CASE WHEN count(*) FILTER (value IS NULL) = 0 THEN sum(value) END', 2)} AS value, count(*) FILTER (units <> 0) AS securities,
    CASE max(CASE quality WHEN 'UNAVAILABLE' THEN 3 WHEN 'CARRIED_FORWARD' THEN 2 WHEN 'QUOTED' THEN 1 ELSE 0 END) WHEN 3 THEN 'UNAVAILABLE' WHEN 2 THEN 'CARRIED_FORWARD' WHEN 1 THEN 'QUOTED' ELSE 'NOT_HELD' END AS quality FROM hs GROUP BY ALL""")
def valuation_totals(spark, sf):
    return _d(windows.valuation_totals(_history(spark, sf)), 2, 0.0000123)


_WEIGHTS = f"{_HISTORY}, wt AS (SELECT account_id, \"on\", security_id, value, CASE WHEN sum(value) OVER (PARTITION BY account_id, \"on\") <> 0 THEN value / sum(value) OVER (PARTITION BY account_id, \"on\") END AS weight FROM hs WHERE units <> 0)"


@query(f", {_WEIGHTS} SELECT account_id, \"on\", security_id, {_R('value')} AS value, {_R('weight', 4)} AS weight FROM wt")
def allocation_history(spark, sf):
    got = windows.allocation_history(_history(spark, sf))
    return got.select("account_id", "on", "security_id", F.round(F.col("value") + 0.0000123, 3).alias("value"), F.round(F.col("weight") + 0.0000123, 4).alias("weight"))


@query(f", {_WEIGHTS} SELECT account_id, \"on\", cardinality(map_from_entries(list((security_id, weight))))::INTEGER AS holdings, {_R('list_sum(list(weight))', 4)} AS total FROM wt WHERE weight IS NOT NULL GROUP BY ALL")
def weight_maps(spark, sf):
    maps = windows.weight_maps(windows.allocation_history(_history(spark, sf)))
    return maps.select("account_id", "on", F.size("weights").alias("holdings"), F.round(F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, x: a + x) + 0.0000123, 4).alias("total"))


@query(f", {_WEIGHTS}, k AS (SELECT *, row_number() OVER (PARTITION BY account_id, \"on\" ORDER BY weight DESC, security_id) AS k FROM wt) SELECT account_id, \"on\", {_R('max(weight)', 4)} AS largest, {_R('sum(weight) FILTER (k <= 5)', 4)} AS top5, {_R('sum(weight * weight)', 4)} AS hhi, count(*) AS holdings FROM k GROUP BY ALL")
def concentration_history(spark, sf):
    return _d(windows.concentration_history(windows.allocation_history(_history(spark, sf))), 4, 0.0000123)


@query(f""", {_RETURNS}, w AS (SELECT account_id, min(period_start) AS start, max(period_end) AS "end", arg_min(begin_value, period_end) AS opening, arg_max(end_value, period_end) AS closing, sum(flow) AS flow, count(r) AS measured, count(*) AS periods, product(1 + r) - 1 AS twrr FROM qr WHERE period_start >= DATE '1994-12-31' AND period_end <= DATE '1999-06-30' GROUP BY ALL)
    SELECT account_id, start, "end", {_R('opening')} AS opening, {_R('closing')} AS closing, {_R('flow')} AS flow, measured, periods, {_R('twrr')} AS twrr, {_R('closing - opening - flow')} AS gain, {_R('CASE WHEN 1 + twrr > 0 THEN pow(1 + twrr, 365.0 / ("end" - start)) - 1 END')} AS annualised FROM w""")
def performance_window(spark, sf):
    return _d(windows.performance_window(_returns(spark, sf), "1994-12-31", "1999-06-30"), 3, 0.0000123)


@query(f""", {_RETURNS}, w AS (SELECT account_id, make_date(year(period_end), 12, 31) AS bucket, arg_min(begin_value, period_end) AS opening, arg_max(end_value, period_end) AS closing, sum(flow) AS flow, count(r) AS measured, CASE WHEN count(r) > 0 THEN product(1 + r) - 1 END AS twrr FROM qr GROUP BY ALL)
    SELECT account_id, bucket, {_R('opening')} AS opening, {_R('closing')} AS closing, {_R('flow')} AS flow, measured, {_R('twrr')} AS twrr, {_R('closing - opening - flow')} AS gain, {_R('CASE WHEN opening + closing > 0 THEN 2 * (closing - opening - flow) / (opening + closing) END')} AS gain_on_mean FROM w""")
def calendar_performance(spark, sf):
    return _d(windows.calendar_performance(_returns(spark, sf), "year"), 3, 0.0000123)


@query(f", {_RETURNS} SELECT account_id, count(*) AS periods, count(r) AS measured, CASE WHEN count(r) = 0 THEN 'NONE' WHEN count(r) < 12 THEN 'LIMITED' ELSE 'FULL' END AS quality FROM qr GROUP BY ALL")
def twrr_quality(spark, sf):
    return windows.twrr_quality(_returns(spark, sf))


@query("SELECT account_id, trade_date AS \"on\" FROM tr UNION SELECT account_id, last_day(trade_date) FROM tr")
def valuation_dates(spark, sf):
    tr = td.trades(spark, sf)
    return windows.valuation_dates(tr.select("account_id", F.last_day("trade_date").alias("on")), tr.select("account_id", F.col("trade_date").alias("on")))


@query("SELECT account_id, sum(amount)::DOUBLE AS amount, sum(n)::BIGINT AS events, sum(adjusted)::BIGINT AS adjustments FROM (SELECT account_id, amount, 1 AS n, 0 AS adjusted FROM ca UNION ALL SELECT account_id, -amount, 1, 1 FROM ca WHERE type = 'FEE') GROUP BY ALL")
def with_adjustments(spark, sf):
    """Cash ledgers in which every fee is reversed."""
    cash = td.cash_events(spark, sf).select("account_id", "type", "amount")
    both = windows.with_adjustments(cash, cash.where("type = 'FEE'").withColumn("amount", (-F.col("amount")).cast("decimal(18,2)")))
    return _d(both.groupBy("account_id").agg(F.sum("amount").alias("amount"), F.count("*").alias("events"), F.count_if("is_adjustment").alias("adjustments")))


@query(f", {_HISTORY} SELECT account_id, \"on\", units::DOUBLE AS units, {_R('value')} AS value FROM hs WHERE security_id = 'Brand#3' AND \"on\" BETWEEN DATE '1996-01-31' AND DATE '1997-12-31'")
def holdings_history(spark, sf):
    return _d(windows.holdings_history(_history(spark, sf), "Brand#3", "1996-01-31", "1997-12-31").select("account_id", "on", "units", F.round(F.col("value") + 0.0000123, 3).alias("value")))


@query("SELECT account_id, last_day(trade_date) AS \"on\", count(DISTINCT CASE WHEN type = 'SELL' THEN security_id END) AS sources FROM tr GROUP BY ALL")
def source_counts(spark, sf):
    """Months in which an account traded, and how many securities' sells report them."""
    tr = td.trades(spark, sf).select("account_id", F.last_day("trade_date").alias("on"), F.col("security_id").alias("document_id"), "type")
    return windows.source_counts(tr.select("account_id", "on").distinct(), tr.where("type = 'SELL'").drop("type"))


@query(f", {_DAILY}, f AS (SELECT account_id, trade_date, count(*) AS n, sum(amount)::DOUBLE AS total FROM ca WHERE type IN ('DEPOSIT', 'WITHDRAWAL') GROUP BY ALL) SELECT da.account_id, da.trade_date, coalesce(n, 0)::INTEGER AS n_flows, coalesce(total, 0) AS total FROM da LEFT JOIN f ON f.account_id = da.account_id AND f.trade_date = da.trade_date")
def flow_events(spark, sf):
    cash = td.cash_events(spark, sf)
    got = windows.flow_events(ledger.daily_cash(cash), cash.where("type IN ('DEPOSIT', 'WITHDRAWAL')"))
    return got.select("account_id", "trade_date", F.size("flows").alias("n_flows"), F.round(F.aggregate("flows", F.lit(0.0), lambda a, x: a + x["amount"].cast("double")), 6).alias("total"))


@query(f", {_DAILY}, m AS (SELECT account_id, 'reached ' || t AS milestone, min(trade_date) AS \"on\" FROM da, (VALUES (100), (500), (1000)) v(t) WHERE cash >= t GROUP BY ALL UNION ALL SELECT account_id, 'all-time high', arg_max(trade_date, (cash, trade_date)) FROM da GROUP BY ALL) SELECT m.account_id, milestone, \"on\", cash::DOUBLE AS cash, cumulative_income::DOUBLE AS cumulative_income FROM m LEFT JOIN da ON da.account_id = m.account_id AND da.trade_date = m.\"on\"")
def milestone_context(spark, sf):
    daily = ledger.daily_cash(td.cash_events(spark, sf))
    return _d(windows.milestone_context(analytics.milestones(daily, [100, 500, 1000]), daily).select("account_id", "milestone", "on", "cash", "cumulative_income"))


@query(f""", {_RETURNS}, e AS (SELECT account_id, count(*) FILTER (type = 'SELL') AS sells, count(*) FILTER (type IN ('DIVIDEND', 'DISTRIBUTION', 'INTEREST')) AS incomes, count(*) FILTER (type IN ('DEPOSIT', 'WITHDRAWAL')) AS flows FROM (SELECT account_id, type FROM tr UNION ALL SELECT account_id, type FROM ca) GROUP BY ALL),
    n AS (SELECT account_id, count(r) AS returns FROM qr GROUP BY ALL), v AS (SELECT account_id, count(*) AS valuations, min(g) AS gap FROM (SELECT account_id, d - lag(d) OVER (PARTITION BY account_id ORDER BY d) AS g FROM (SELECT DISTINCT account_id, last_day(trade_date) AS d FROM tr)) GROUP BY ALL),
    x AS (SELECT coalesce(e.account_id, n.account_id, v.account_id) AS account_id, coalesce(sells, 0) AS sells, coalesce(incomes, 0) AS incomes, coalesce(flows, 0) AS flows, coalesce(returns, 0) AS returns, coalesce(valuations, 0) AS valuations, gap FROM e FULL JOIN n ON n.account_id = e.account_id FULL JOIN v ON v.account_id = coalesce(e.account_id, n.account_id)),
    c AS (SELECT account_id, unnest([('cash_flow', flows > 0, 'no deposits or withdrawals'), ('realised_gains', sells > 0, 'no sells'), ('income', incomes > 0, 'no income'), ('returns', returns > 0, 'no measurable period'), ('volatility', returns >= 6, 'under 6 returns'), ('rolling_volatility', returns >= 8, 'under 8 returns'), ('drawdown', valuations >= 2, 'under 2 valuations'), ('best_day', coalesce(gap <= 3, false), 'valuations lie too far apart')]) AS t FROM x)
    SELECT account_id, t[1] AS capability, t[2] AS available, CASE WHEN NOT t[2] THEN t[3] END AS reason FROM c""")
def capabilities(spark, sf):
    tr = td.trades(spark, sf)
    events = tr.select("account_id", "type").unionByName(td.cash_events(spark, sf).select("account_id", "type"))
    return windows.capabilities(events, _returns(spark, sf), tr.select("account_id", F.last_day("trade_date").alias("on")))


@query("""SELECT n_regionkey AS file, sha256(string_agg(h, chr(10) ORDER BY n_nationkey)) AS content_hash FROM (SELECT n_regionkey, n_nationkey, sha256('n_name=' || n_name || chr(10) || 'n_nationkey=' || n_nationkey || chr(10) || 'n_regionkey=' || n_regionkey) AS h FROM nation) GROUP BY ALL""")
def content_hash(spark, sf):
    return windows.content_hash(td.table(spark, sf, "nation").select("n_name", "n_nationkey", "n_regionkey"), F.col("n_regionkey"), F.col("n_nationkey"))


@query("SELECT account_id, trade_date, CASE WHEN type = 'INTEREST' THEN 'INTEREST' WHEN event_id % 3 = 0 THEN 'DISTRIBUTION' ELSE 'DIVIDEND' END AS kind, sum(amount)::DOUBLE AS amount FROM ca WHERE type IN ('DIVIDEND', 'DISTRIBUTION', 'INTEREST') GROUP BY ALL")
def income_daily(spark, sf):
    cash = td.cash_events(spark, sf)
    income = cash.where("type IN ('DIVIDEND', 'DISTRIBUTION')").withColumn("security_id", F.concat(F.lit("S"), F.col("event_id") % 3))
    return _d(windows.income_daily(income, cash.where("type = 'INTEREST'"), spark.createDataFrame([("S0", "ETF"), ("S1", "SHARE")], "security_id string, security_type string")))
