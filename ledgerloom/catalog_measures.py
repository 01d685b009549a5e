"""Registered queries of milestones, availability, spans, weights with cash, rates, capital and issues, and the same in DuckDB's SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import catalog_checks
from ledgerloom.catalog import _DAILY, _PRICES, _RETURNS, _STATE, ORACLE, _d, _returns, query
from ledgerloom.catalog_history import _PAIRED, _daily, _paired, _state
from ledgerloom.operators import analytics, history, ledger, measures
from ledgerloom.plans.quarters import quarterly_returns
from ledgerloom.sources import testdata as td

_R = lambda x, places=6: f"round(({x})::DOUBLE, {places}) + 0.0::DOUBLE"


@query("""SELECT account_id, 'first buy' AS milestone, trade_date AS "on", (gross + fees)::DOUBLE AS value FROM tr WHERE type = 'BUY' QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY trade_date, event_id) = 1
    UNION ALL (SELECT account_id, 'largest deposit', trade_date, amount::DOUBLE FROM ca WHERE type = 'DEPOSIT' QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY amount DESC, event_id DESC) = 1)
    UNION ALL (SELECT account_id, 'largest withdrawal', trade_date, amount::DOUBLE FROM ca WHERE type = 'WITHDRAWAL' QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY amount, event_id) = 1)
    UNION ALL (SELECT account_id, 'largest income', trade_date, amount::DOUBLE FROM ca WHERE type IN ('DIVIDEND', 'DISTRIBUTION') QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY amount DESC, event_id DESC) = 1)""")
def event_milestones(spark, sf):
    return measures.event_milestones(td.trades(spark, sf), td.cash_events(spark, sf))


_STEPS = f"{_PRICES}, sx AS (SELECT security_id AS account_id, price_date AS d, price AS index, lag(price) OVER (PARTITION BY security_id ORDER BY price_date) AS before FROM pr), sy AS (SELECT *, index / before - 1 AS c FROM sx WHERE before > 0 AND index <> before)"


@query(f""", {_STEPS} SELECT account_id, 'largest gain' AS milestone, d AS "on", {_R('100 * c')} AS value FROM (SELECT * FROM sy QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY c DESC, d) = 1)
    UNION ALL SELECT account_id, 'largest loss', d, {_R('100 * c')} FROM (SELECT * FROM sy QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY c, d) = 1)""")
def index_milestones(spark, sf):
    """Each security's prices, seen as an account's index."""
    levels = td.prices(td.trades(spark, sf)).select(F.col("security_id").alias("account_id"), F.col("price_date").alias("period_end"), F.col("price").alias("index"))
    return _d(measures.index_milestones(levels))


#: Capability flags of availability() in SQL: (condition, reason, figures).
_FLAGS = [
    ("days > 0", "no history", ["portfolio_value", "historical_value", "capital_gains"]), ("held > 0", "no holdings", ["holdings", "unrealised_gains", "allocation"]), ("events > 0", "no transactions", ["contributions", "withdrawals"]),
    ("incomes > 0", "no income", ["income", "income_yield", "income_growth"]), ("sells > 0", "no sells", ["realised_gains"]), ("actual >= 2", "under 2 valuations", ["twrr"]), ("events > 0 AND actual >= 1", "no transactions or no valuation", ["xirr"]),
    ("gap <= 3", "no valuations within 3 days", ["daily_returns"]), ("gap <= 10", "no valuations within 10 days", ["weekly_returns"]), ("gap <= 35", "no valuations within 35 days", ["monthly_returns"]), ("measured >= 2", "under 2 measured dates", ["quarterly_returns", "drawdown"]),
    ("measured >= 6", "under 6 measured dates", ["volatility"]), ("measured >= 8", "under 8 measured dates", ["rolling_metrics"]), ("false", "no risk-free rate", ["sharpe_ratio", "sortino_ratio"]), ("true", "no benchmark", ["beta", "correlation", "benchmark_comparison"]),
    ("false", "no classification of securities", ["sector_allocation", "geographic_allocation", "currency_allocation"]),
]
_ROWS = ", ".join(f"('{name}', coalesce({on}, false), '{why}')" for on, why, names in _FLAGS for name in names)


@query(f""", {_RETURNS}, ev AS (SELECT account_id, count(*) AS events, count(*) FILTER (type = 'SELL') AS sells, count(*) FILTER (type IN ('DIVIDEND', 'DISTRIBUTION', 'INTEREST')) AS incomes FROM (SELECT account_id, type FROM tr WHERE account_id % 7 <> 1 UNION ALL SELECT account_id, type FROM ca WHERE account_id % 3 <> 0) GROUP BY ALL),
    ho AS (SELECT account_id, count(*) AS held FROM (SELECT account_id, security_id, arg_max(held, (trade_date, type, event_id)) AS held FROM h WHERE account_id % 5 <> 0 GROUP BY ALL) WHERE held <> 0 GROUP BY ALL),
    vd AS (SELECT account_id, period_end AS d, begin_value > 0 AS actual, r IS NOT NULL AND period_end < make_date(1993 + account_id % 6, 1, 1) AS measured FROM qr UNION ALL SELECT account_id, period_end + 2, false, r IS NOT NULL AND account_id % 4 = 1 FROM qr),
    va2 AS (SELECT account_id, count(*) AS days, count(*) FILTER (actual) AS actual FROM vd GROUP BY ALL),
    ga AS (SELECT account_id, min(g) AS gap, count(*) AS measured FROM (SELECT account_id, d - lag(d) OVER (PARTITION BY account_id ORDER BY d) AS g FROM (SELECT DISTINCT account_id, d FROM vd WHERE measured)) GROUP BY ALL),
    x AS (SELECT id AS account_id, coalesce(events, 0) AS events, coalesce(sells, 0) AS sells, coalesce(incomes, 0) AS incomes, coalesce(held, 0) AS held, coalesce(days, 0) AS days, coalesce(actual, 0) AS actual, coalesce(measured, 0) AS measured, gap
          FROM (SELECT account_id AS id FROM ev UNION SELECT account_id FROM ho UNION SELECT account_id FROM va2) LEFT JOIN ev ON ev.account_id = id LEFT JOIN ho ON ho.account_id = id LEFT JOIN va2 ON va2.account_id = id LEFT JOIN ga ON ga.account_id = id),
    c AS (SELECT account_id, unnest([{_ROWS}]) AS t FROM x) SELECT account_id, t[1] AS capability, t[2] AS available, CASE WHEN NOT t[2] THEN t[3] END AS reason FROM c""")
def availability(spark, sf):
    """Accounts of which some have no trades, no cash, no holdings, few measured quarters, or measured days close by."""
    tr, one = td.trades(spark, sf), F.col("account_id")
    events = tr.where(one % 7 != 1).select("account_id", "type").unionByName(td.cash_events(spark, sf).where(one % 3 != 0).select("account_id", "type"))
    held = ledger.running_units(tr.where(one % 5 != 0)).groupBy("account_id", "security_id").agg(F.max_by("held", F.struct("trade_date", "type", "event_id")).alias("held")).where("held <> 0")
    returns = _returns(spark, sf)
    whole = returns.select("account_id", F.col("period_end").alias("on"), (F.col("begin_value") > 0).alias("actual"), (F.col("r").isNotNull() & (F.col("period_end") < F.make_date(1993 + one % 6, F.lit(1), F.lit(1)))).alias("measured"))
    later = returns.select("account_id", F.date_add("period_end", 2).alias("on"), F.lit(False).alias("actual"), (F.col("r").isNotNull() & (one % 4 == 1)).alias("measured"))
    return measures.availability(events, held, whole.unionByName(later), benchmarks=True)


_SPANS = """, lv AS (SELECT security_id AS account_id, CASE WHEN security_id LIKE 'Brand#1%' THEN last_day(trade_date) ELSE trade_date END AS d, round(arg_max(gross, (trade_date, event_id))::DOUBLE / arg_max(units, (trade_date, event_id))::DOUBLE + 0.00000001, 6) AS index FROM tr GROUP BY ALL),
    nr AS (SELECT account_id, coalesce(min(g) <= 3, false) AS near FROM (SELECT account_id, d - lag(d) OVER (PARTITION BY account_id ORDER BY d) AS g FROM lv) GROUP BY ALL),
    be AS (SELECT account_id, 'month' AS span, last_day(d) AS e, arg_max(index, d) AS c, arg_min(index, d) AS o FROM lv GROUP BY ALL UNION ALL SELECT account_id, 'year', make_date(year(d), 12, 31), arg_max(index, d), arg_min(index, d) FROM lv GROUP BY ALL),
    rs AS (SELECT account_id, 'day' AS span, d AS e, index / lag(index) OVER (PARTITION BY account_id ORDER BY d) - 1 AS r FROM lv UNION ALL SELECT account_id, span, e, c / coalesce(lag(c) OVER (PARTITION BY account_id, span ORDER BY e), o) - 1 FROM be),
    bw AS (SELECT account_id, span, arg_max(e, (r, -(e - DATE '1970-01-01'))) AS best, max(r) AS best_return, arg_min(e, (r, e)) AS worst, min(r) AS worst_return FROM rs WHERE r IS NOT NULL GROUP BY ALL)"""


@query(f"""{_SPANS} SELECT bw.account_id, span, CASE WHEN ok THEN best END AS best, CASE WHEN ok THEN {_R('best_return')} END AS best_return, CASE WHEN ok THEN worst END AS worst, CASE WHEN ok THEN {_R('worst_return')} END AS worst_return, CASE WHEN NOT ok THEN 'valuations lie too far apart' END AS reason
    FROM (SELECT bw.*, near OR span <> 'day' AS ok FROM bw JOIN nr ON nr.account_id = bw.account_id) bw""")
def best_worst_spans(spark, sf):
    """Each security's prices seen as an account's index: by day, those of brands 1x by month."""
    tr = td.trades(spark, sf)
    day = F.when(F.col("security_id").startswith("Brand#1"), F.last_day("trade_date")).otherwise(F.col("trade_date"))
    last = tr.groupBy(F.col("security_id").alias("account_id"), day.alias("on")).agg(F.max_by(F.struct("gross", "units"), F.struct("trade_date", "event_id")).alias("t"))
    return _d(measures.best_worst_spans(last.select("account_id", "on", F.round(F.col("t.gross").cast("double") / F.col("t.units").cast("double") + 1e-8, 6).alias("index"))))


def _last_cash(spark, sf):
    return td.cash_events(spark, sf).groupBy("account_id").agg((1000 * F.sum("amount")).alias("cash"))


_WITH_CASH = f"{_STATE}, lc AS (SELECT account_id, 1000 * sum(amount)::DOUBLE AS cash FROM ca GROUP BY ALL), hd AS (SELECT account_id, security_id, value FROM st WHERE units <> 0)"
_SEC = f"{_WITH_CASH}, tt AS (SELECT hd.account_id, CASE WHEN count(value) = count(*) THEN sum(value) + coalesce(any_value(cash), 0) END AS total FROM hd LEFT JOIN lc ON lc.account_id = hd.account_id GROUP BY ALL), wc AS (SELECT hd.account_id, security_id, value, CASE WHEN total <> 0 THEN value / total END AS weight FROM hd JOIN tt ON tt.account_id = hd.account_id)"


@query(f""", {_WITH_CASH}, cl AS (SELECT account_id, CASE WHEN security_id LIKE 'Brand#5%' THEN 'unknown' ELSE 'class ' || substr(security_id, 7, 1) END AS asset_class, value FROM hd UNION ALL SELECT account_id, 'cash', cash FROM lc),
    cs AS (SELECT account_id, asset_class, CASE WHEN count(value) = count(*) THEN sum(value) END AS value FROM cl GROUP BY ALL), ct AS (SELECT account_id, CASE WHEN count(value) = count(*) THEN sum(value) END AS total FROM cs GROUP BY ALL)
    SELECT cs.account_id, asset_class, round(0.0000123 + value, 3) AS value, round(0.0000123 + CASE WHEN total <> 0 THEN value / total END, 6) AS weight FROM cs JOIN ct ON ct.account_id = cs.account_id""")
def allocation_by_class(spark, sf):
    """Weights by asset class, a thousand times each account's cash among them."""
    classes = td.table(spark, sf, "part").where("p_brand NOT LIKE 'Brand#5%'").select(F.col("p_brand").alias("security_id"), F.concat(F.lit("class "), F.substring("p_brand", 7, 1)).alias("asset_class")).distinct()
    got = measures.allocation_with_cash(_state(spark, sf), _last_cash(spark, sf), classes)
    return got.select("account_id", "asset_class", F.round(F.col("value") + 0.0000123, 3).alias("value"), F.round(F.col("weight") + 0.0000123, 6).alias("weight"))


@query(f", {_SEC}, r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY weight DESC, security_id) AS k FROM wc) SELECT account_id, round(sum(weight) FILTER (k <= 1), 6) AS largest, round(sum(weight) FILTER (k <= 5), 6) AS top5, round(sum(weight) FILTER (k <= 10), 6) AS top10, round(sum(weight * weight), 6) AS hhi, count(*) AS holdings FROM r GROUP BY ALL")
def concentration_with_cash(spark, sf):
    return _d(analytics.concentration(measures.allocation_with_cash(_state(spark, sf), _last_cash(spark, sf))))


@query(f""", {_RETURNS}, a AS (SELECT account_id, count(r) AS observations, count(*) FILTER (r < 0) AS negatives, stddev_samp(r) AS s, stddev_samp(r) FILTER (r < 0) AS d, product(1 + r) AS p FROM qr WHERE period_end <= DATE '1993-12-31' + (account_id % 5) * 366 GROUP BY ALL),
    b AS (SELECT *, CASE WHEN p > 0 THEN pow(p, 4.0 / observations) - 1 END AS y FROM a), c AS (SELECT *, CASE WHEN observations < 6 THEN 'under 6 returns' WHEN y IS NULL THEN 'no growth to a year' WHEN NOT s > 0 THEN 'no deviation' END AS w1, CASE WHEN negatives < 2 THEN 'under 2 negative returns' WHEN y IS NULL THEN 'no growth to a year' WHEN NOT d > 0 THEN 'no deviation' END AS w2 FROM b)
    SELECT account_id, observations, negatives, round(0.0000123 + CASE WHEN w1 IS NULL THEN (y - 0.03) / (2 * s) END, 5) AS sharpe, w1 AS sharpe_reason, round(0.0000123 + CASE WHEN w2 IS NULL THEN (y - 0.03) / (2 * d) END, 5) AS sortino, w2 AS sortino_reason FROM c""")
def risk_adjusted(spark, sf):
    """Against a yearly 3 %, over histories of different lengths."""
    own = _returns(spark, sf).where("period_end <= date_add(DATE '1993-12-31', (account_id % 5) * 366)")
    return _d(measures.risk_adjusted(own, 0.03), 5, 0.0000123)


@query(f", {_RETURNS}, k AS (SELECT account_id, CASE WHEN begin_value + weighted > 0 THEN begin_value + weighted END AS capital FROM (SELECT va.account_id, coalesce(lag(end_value) OVER (PARTITION BY va.account_id ORDER BY va.period_end), 0) AS begin_value, coalesce(weighted, 0) AS weighted FROM va LEFT JOIN fs ON fs.account_id = va.account_id AND fs.period_end = va.period_end)) SELECT account_id, round(0.0000123 + avg(capital), 3) AS average_capital, count(capital) AS periods FROM k GROUP BY ALL")
def average_capital(spark, sf):
    tr = td.trades(spark, sf)
    return _d(measures.average_capital(quarterly_returns(tr, td.prices(tr), with_capital=True)), 3, 0.0000123)


@query(f""", {_DAILY}, t AS (SELECT account_id, sum(gross) AS g FROM tr GROUP BY ALL), m AS (SELECT account_id, sum(cash)::DOUBLE / count(cash) AS v FROM da GROUP BY ALL)
    SELECT t.account_id, CASE WHEN v > 0 THEN round(g::DOUBLE / v, 4) END AS turnover FROM t JOIN m ON t.account_id = m.account_id""")
def turnover_total(spark, sf):
    return _d(history.turnover(analytics.trading_activity(td.trades(spark, sf)), _daily(spark, sf), "total"), 4)


@query(f", {_PAIRED}, g AS (SELECT account_id, product(1 + r) - 1 AS p, product(1 + b) - 1 AS q, count(*) FILTER (r IS NOT NULL AND b IS NOT NULL) AS covered, count(*) AS periods FROM pa GROUP BY account_id) SELECT account_id, {_R('p')} AS portfolio, {_R('q')} AS benchmark, covered, periods, {_R('p - q')} AS relative, CASE WHEN p - q IS NULL THEN 'UNAVAILABLE' ELSE 'OK' END AS status, p - q IS NOT NULL AS mismatch FROM g")
def benchmark_flags(spark, sf):
    """Against the mean price of all securities, which is a price return."""
    return _d(history.benchmark_comparison(_paired(spark, sf), "price_return"))


_CHECKS = [catalog_checks.check_dates, catalog_checks.check_missing_security, catalog_checks.outside_periods]
_ISSUES = " UNION ALL ".join(f"SELECT severity, code, event_id FROM ({ORACLE[check.__name__]})" for check in _CHECKS)


@query(f", iu AS ({_ISSUES}) SELECT severity, code, count(*) AS issues, count(DISTINCT CASE WHEN severity IN ('ERROR', 'WARNING') THEN event_id END) AS documents_to_review FROM iu GROUP BY ROLLUP (severity, code)")
def issue_summary(spark, sf):
    """Issues of three checks; an event stands for a document."""
    frames = [check(spark, sf).select("severity", "code", F.col("event_id").alias("document_id")) for check in _CHECKS]
    return measures.issue_summary(reduce(DataFrame.unionByName, frames))
