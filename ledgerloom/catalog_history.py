"""More registered queries: growth, high water, rolling figures, benchmarks, coverage, exports; and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog import _ALLOC, _DAILY, _PRICES, _STATE, _UNITS, ON, QUERIES, _d, query
from ledgerloom.operators import analytics, history, ledger, quality
from ledgerloom.operators.periods import STANDARD_DAYS, standard_periods as windows_of
from ledgerloom.sources import exports
from ledgerloom.sources import testdata as td

_BEFORE = set(QUERIES)


def _daily(spark, sf):
    return ledger.daily_cash(td.cash_events(spark, sf))


def _levels(spark, sf):
    """Each security's prices, seen as an account's index."""
    return td.prices(td.trades(spark, sf)).select(F.col("security_id").alias("account_id"), F.col("price_date").alias("period_end"), F.col("price").alias("index"))


@query(f""", {_DAILY}, g AS (SELECT account_id, trade_date, cash AS value, cumulative_contributions + cumulative_withdrawals AS net, cash - (cumulative_contributions + cumulative_withdrawals) AS gain FROM da)
    SELECT account_id, trade_date, value::DOUBLE AS value, net::DOUBLE AS net, gain::DOUBLE AS gain, (net - lag(net) OVER w)::DOUBLE AS net_change, (gain - lag(gain) OVER w)::DOUBLE AS gain_change FROM g WINDOW w AS (PARTITION BY account_id ORDER BY trade_date)""")
def growth_series(spark, sf):
    return _d(history.growth_series(_daily(spark, sf)))


@query(f""", {_DAILY}, l AS (SELECT account_id, arg_max(cash, trade_date) AS v, arg_max(cumulative_contributions, trade_date) AS c, arg_max(cumulative_withdrawals, trade_date) AS x FROM da GROUP BY ALL)
    SELECT account_id, c::DOUBLE AS contributed, x::DOUBLE AS withdrawn, (c + x)::DOUBLE AS net, v::DOUBLE AS value, (v - c - x)::DOUBLE AS gain, CASE WHEN c + x > 0 THEN round((v - c - x)::DOUBLE / (c + x)::DOUBLE, 6) END AS gain_per_dollar FROM l""")
def growth_summary(spark, sf):
    return _d(history.growth_summary(_daily(spark, sf)))


@query(f""", {_DAILY}, l AS (SELECT account_id, (date_trunc('week', trade_date) + INTERVAL 6 DAY)::DATE AS period_end, arg_max(cumulative_contributions, trade_date) AS c, arg_max(cumulative_withdrawals, trade_date) AS x FROM da GROUP BY ALL)
    SELECT account_id, period_end, c::DOUBLE AS contributed, x::DOUBLE AS withdrawn, (c - coalesce(lag(c) OVER w, 0))::DOUBLE AS contributions, (x - coalesce(lag(x) OVER w, 0))::DOUBLE AS withdrawals FROM l WINDOW w AS (PARTITION BY account_id ORDER BY period_end)""")
def contribution_history(spark, sf):
    return _d(history.contribution_history(_daily(spark, sf), "week"))


@query(f", {_DAILY} SELECT account_id, period_end, trade_date, cash::DOUBLE AS cash FROM (SELECT *, (date_trunc('week', trade_date) + INTERVAL 6 DAY)::DATE AS period_end FROM da) QUALIFY row_number() OVER (PARTITION BY account_id, period_end ORDER BY trade_date DESC) = 1")
def resample(spark, sf):
    return _d(history.resample(_daily(spark, sf), "week").select("account_id", "period_end", "trade_date", "cash"))


_HIGH = f"""{_DAILY}, h1 AS (SELECT *, max(cash) OVER (PARTITION BY account_id ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM da),
    h2 AS (SELECT *, greatest(cash, coalesce(p, cash), 0) AS m, max(CASE WHEN p IS NULL OR cash > p THEN trade_date END) OVER (PARTITION BY account_id ORDER BY trade_date) AS reached FROM h1),
    hw AS (SELECT account_id, trade_date, cash::DOUBLE AS value, m::DOUBLE AS high, reached, (trade_date - reached)::INTEGER AS days_since, CASE WHEN m > 0 THEN round(cash::DOUBLE / m::DOUBLE - 1, 6) END AS drawdown FROM h2)"""


@query(f", {_HIGH} SELECT * FROM hw")
def high_water_history(spark, sf):
    return _d(history.high_water_history(_daily(spark, sf)))


@query(f", {_HIGH} SELECT * FROM hw QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY trade_date DESC) = 1")
def high_water_status(spark, sf):
    return _d(history.high_water_status(_daily(spark, sf)))


@query(f""", {_PRICES}, x AS (SELECT security_id AS account_id, price_date AS period_end, price, first_value(price) OVER w AS p0, first_value(price_date) OVER w AS d0, min(price_date) OVER (PARTITION BY security_id) AS f FROM pr
    WINDOW w AS (PARTITION BY security_id ORDER BY price_date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW))
    SELECT account_id, period_end, CASE WHEN period_end - 365 >= f THEN round(price / p0 - 1, 6) END AS rolling_return, CASE WHEN period_end - 365 >= f THEN d0 > period_end - 365 END AS estimated FROM x""")
def rolling_return(spark, sf):
    return _d(history.rolling_return(_levels(spark, sf), 365))


@query("""SELECT account_id, period_end, gross::DOUBLE AS gross, CASE WHEN lag(gross) OVER w > 0 THEN round(gross::DOUBLE / (lag(gross) OVER w)::DOUBLE - 1, 6) END AS growth
    FROM (SELECT account_id, (date_trunc('week', trade_date) + INTERVAL 6 DAY)::DATE AS period_end, sum(amount) AS gross FROM ca WHERE type IN ('DIVIDEND', 'DISTRIBUTION', 'INTEREST') GROUP BY ALL) WINDOW w AS (PARTITION BY account_id ORDER BY period_end)""")
def income_growth(spark, sf):
    return _d(history.income_growth(analytics.income_history(td.cash_events(spark, sf), "week")))


_RETURNS = f"{_PRICES}, re AS (SELECT security_id AS account_id, lag(price_date) OVER w AS period_start, price_date AS period_end, price / lag(price) OVER w - 1 AS r FROM pr WINDOW w AS (PARTITION BY security_id ORDER BY price_date))"
_PAIRED = f"""{_RETURNS}, bl AS (SELECT price_date AS date, avg(price) AS level FROM pr WHERE month(price_date) <> 6 GROUP BY ALL),
    pa AS (SELECT re.*, b1.level / b0.level - 1 AS b FROM re LEFT JOIN bl b0 ON period_start = b0.date LEFT JOIN bl b1 ON period_end = b1.date)"""


@query(f", {_RETURNS}, c AS (SELECT account_id, product(1 + r) - 1 AS chained, count(r) AS observations, max(period_end) - min(period_start) AS days FROM re GROUP BY ALL) SELECT account_id, round(chained, 6) AS chained, observations, days::INTEGER AS days, CASE WHEN days > 0 AND chained > -1 THEN round(pow(1 + chained, 365.0 / days) - 1, 6) END AS annualised FROM c")
def chained_returns(spark, sf):
    return _d(history.chained(history.level_returns(_levels(spark, sf))))


def _paired(spark, sf):
    """Returns of each security against the mean price of all, which has no level in June."""
    own = _levels(spark, sf)
    mean = own.where(F.month("period_end") != 6).groupBy(F.col("period_end").alias("date")).agg(F.avg("index").alias("level"))
    return history.benchmark_returns(history.level_returns(own), mean)


@query(f", {_PAIRED} SELECT account_id, count(*) AS observations, CASE WHEN count(*) >= 6 AND var_samp(b) > 0 THEN round(covar_samp(r, b) / var_samp(b), 6) END AS beta, CASE WHEN count(*) >= 6 THEN round(corr(r, b), 6) END AS correlation FROM pa WHERE r IS NOT NULL AND b IS NOT NULL GROUP BY account_id")
def benchmark_risk(spark, sf):
    return _d(history.benchmark_risk(_paired(spark, sf)))


@query(f", {_PAIRED} SELECT account_id, round(product(1 + r) - 1, 6) AS portfolio, round(product(1 + b) - 1, 6) AS benchmark, count(*) FILTER (r IS NOT NULL AND b IS NOT NULL) AS covered, count(*) AS periods, round(product(1 + r) - product(1 + b), 6) AS relative FROM pa GROUP BY account_id")
def benchmark_comparison(spark, sf):
    return _d(history.benchmark_comparison(_paired(spark, sf)))


@query(f""", {_DAILY}, t AS (SELECT account_id, coalesce(sum(gross) FILTER (type = 'BUY'), 0) AS b, coalesce(sum(gross) FILTER (type = 'SELL'), 0) AS s FROM tr GROUP BY ALL), m AS (SELECT account_id, sum(cash)::DOUBLE / count(cash) AS v FROM da GROUP BY ALL)
    SELECT t.account_id, CASE WHEN v > 0 THEN round(least(b, s)::DOUBLE / v, 4) END AS turnover FROM t JOIN m ON t.account_id = m.account_id""")
def turnover(spark, sf):
    return _d(history.turnover(analytics.trading_activity(td.trades(spark, sf)), _daily(spark, sf)), 4)


@query("SELECT account_id, year, abs(sum(a))::DOUBLE AS account_fees, sum(b)::DOUBLE AS brokerage FROM (SELECT account_id, year(trade_date)::INTEGER AS year, amount AS a, 0::DECIMAL(18,2) AS b FROM ca WHERE type = 'FEE' UNION ALL SELECT account_id, year(trade_date)::INTEGER, 0, fees FROM tr) GROUP BY ALL")
def fees_by_year(spark, sf):
    return _d(history.fees_by_year(td.cash_events(spark, sf), td.trades(spark, sf)))


def _state(spark, sf):
    tr = td.trades(spark, sf)
    return ledger.portfolio_state(tr, td.prices(tr), ON)


@query(f", {_STATE} SELECT account_id, security_id, round(0.0000123 + value, 3) AS value, round(0.0000123 + cost, 3) AS cost, round(0.0000123 + value - cost, 3) AS unrealised, CASE WHEN cost <> 0 THEN round(0.0000123 + (value - cost) / cost, 3) END AS pct FROM st WHERE units <> 0")
def unrealised_gains(spark, sf):
    return _d(history.unrealised_gains(_state(spark, sf)), 3, 0.0000123)


@query(f", {_ALLOC} SELECT account_id, security_id, round(weight, 6) AS weight, t.target, round(weight - t.target, 6) AS drift FROM al LEFT JOIN (SELECT DISTINCT p_brand, 0.04::DOUBLE AS target FROM part WHERE p_brand LIKE 'Brand#1%') t ON security_id = p_brand")
def allocation_drift(spark, sf):
    targets = td.table(spark, sf, "part").where("p_brand LIKE 'Brand#1%'").select(F.col("p_brand").alias("security_id"), F.lit(0.04).alias("target")).distinct()
    return _d(history.allocation_drift(analytics.allocation(_state(spark, sf)), targets))


_PRICED = f"""{_PRICES}, p AS (SELECT account_id, security_id, trade_date AS "on" FROM tr), q AS (SELECT account_id, "on", pr.price_date, CASE WHEN pr.price IS NULL THEN 'UNAVAILABLE' WHEN pr.price_date = "on" THEN 'QUOTED' ELSE 'CARRIED_FORWARD' END AS quality FROM p ASOF LEFT JOIN pr ON p.security_id = pr.security_id AND p."on" >= pr.price_date)"""


def _priced(spark, sf):
    tr = td.trades(spark, sf)
    return ledger.asof_prices(tr.select("account_id", "security_id", F.col("trade_date").alias("on")), td.prices(tr))


@query(f", {_PRICED} SELECT account_id, CASE max(CASE quality WHEN 'UNAVAILABLE' THEN 3 WHEN 'CARRIED_FORWARD' THEN 2 ELSE 1 END) WHEN 3 THEN 'UNAVAILABLE' WHEN 2 THEN 'CARRIED_FORWARD' ELSE 'QUOTED' END AS quality FROM q GROUP BY account_id")
def weakest_quality(spark, sf):
    return history.weakest_quality(_priced(spark, sf), "account_id")


@query(f""", {_PRICED} SELECT account_id, count(*) FILTER (quality = 'QUOTED') AS quoted, count(*) FILTER (quality = 'CARRIED_FORWARD') AS carried_forward, count(*) FILTER (quality = 'UNAVAILABLE') AS unavailable, count(DISTINCT price_date) AS price_dates, min("on") AS first_on, max("on") AS last_on FROM q GROUP BY account_id""")
def data_coverage(spark, sf):
    return history.data_coverage(_priced(spark, sf))


_REVERSED = """SELECT account_id, event_id, reverses, (trade_date - d)::INTEGER AS days FROM (
    SELECT *, last_value(CASE WHEN {0} > 0 THEN event_id END IGNORE NULLS) OVER x AS reverses, last_value(CASE WHEN {0} > 0 THEN trade_date END IGNORE NULLS) OVER x AS d FROM ({1})
    WINDOW x AS (PARTITION BY account_id, abs(amount) ORDER BY trade_date, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE {0} < 0 AND trade_date - d <= {2}"""


@query(_REVERSED.format("amount", "SELECT account_id, event_id, trade_date, trunc(amount)::BIGINT AS amount FROM ca", 30))
def reversal_pairs(spark, sf):
    """Of whole units, since no two amounts of these tables are equal to the cent."""
    return history.reversal_pairs(td.cash_events(spark, sf).withColumn("amount", F.col("amount").cast("long")))


@query(_REVERSED.format("-amount", "SELECT account_id % 10 AS account_id, event_id, trade_date, CASE WHEN type = 'FEE' THEN amount ELSE -amount END AS amount FROM ca WHERE type IN ('FEE', 'WITHDRAWAL')", 60))
def fee_reversals(spark, sf):
    """Fees, and withdrawals in the place of fees given back, to the cent."""
    cash = td.cash_events(spark, sf).where("type IN ('FEE', 'WITHDRAWAL')").withColumns({"amount": F.when(F.col("type") == "FEE", F.col("amount")).otherwise(-F.col("amount")), "account_id": F.col("account_id") % 10})
    return history.reversal_pairs(cash, 60, -1)


@query("SELECT account_id, event_id, trade_date, row_number() OVER (PARTITION BY account_id ORDER BY trade_date DESC, event_id)::INTEGER AS position FROM tr QUALIFY position <= 200")
def activity(spark, sf):
    return history.activity(td.trades(spark, sf)).select("account_id", "event_id", "trade_date", "position")


@query("SELECT account_id, event_id, trade_date FROM (SELECT *, max(trade_date) OVER (PARTITION BY account_id) AS z FROM tr) WHERE trade_date >= z - INTERVAL 3 MONTH")
def slice_by_period(spark, sf):
    return history.slice_by_period(td.trades(spark, sf), 3).select("account_id", "event_id", "trade_date")


@query(f""", {_DAILY}, l AS (SELECT account_id, (arg_max(cash, trade_date) + CASE WHEN account_id % 5 = 0 THEN 1 ELSE 0 END)::DECIMAL(18,2) AS closing FROM da WHERE account_id % 3 <> 0 GROUP BY account_id), s AS (SELECT account_id, sum(amount) AS computed FROM ca GROUP BY ALL)
    SELECT s.account_id, computed::DOUBLE AS computed, closing::DOUBLE AS closing, (computed - closing)::DOUBLE AS residual, CASE WHEN closing IS NULL THEN 'SKIP' WHEN abs(computed - closing) <= 0.05 THEN 'PASS' ELSE 'FAIL' END AS status FROM s LEFT JOIN l ON s.account_id = l.account_id""")
def cash_bridge(spark, sf):
    closing = _daily(spark, sf).where("account_id % 3 <> 0").groupBy("account_id").agg(F.max_by("cash", "trade_date").alias("closing"))
    return _d(history.cash_bridge(td.cash_events(spark, sf), closing.withColumn("closing", (F.col("closing") + F.when(F.col("account_id") % 5 == 0, 1).otherwise(0)).cast("decimal(18,2)"))))


@query("""SELECT account_id, event_id, trade_date, type, security_id, units::DOUBLE AS units, NULL::DOUBLE AS amount FROM tr
    UNION ALL SELECT account_id, event_id, trade_date, 'TRANSFER', NULL, NULL, (CASE WHEN type = 'SELL' THEN gross - fees ELSE -(gross + fees) END)::DOUBLE FROM tr""")
def expand_trades(spark, sf):
    return _d(history.expand_trades(td.trades(spark, sf)))


@query("SELECT event_id, (row_number() OVER (PARTITION BY account_id, security_id, trade_date, type ORDER BY event_id) - 1)::INTEGER AS ordinal FROM tr")
def assign_ordinals(spark, sf):
    return history.assign_ordinals(td.trades(spark, sf), ["account_id", "security_id", "trade_date", "type"], ["event_id"]).select("event_id", "ordinal")


@query("""SELECT record_id, document_id, period_end, documents FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY period_end NULLS LAST, document_id) AS k
    FROM (SELECT l_partkey AS record_id, o_orderkey AS document_id, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate::DATE END AS period_end FROM lineitem JOIN orders ON l_orderkey = o_orderkey))
    JOIN (SELECT l_partkey AS record_id, count(DISTINCT l_orderkey) AS documents FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) USING (record_id) WHERE k = 1""")
def canonical_source(spark, sf):
    orders = td.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.to_date("o_orderdate")).alias("period_end"))
    shown = td.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(orders, F.expr("l_orderkey = o_orderkey"))
    return history.canonical_source(shown.select(F.col("l_partkey").alias("record_id"), F.col("o_orderkey").alias("document_id"), "period_end"))


@query("""SELECT account_id, security_id, last_day(q::DATE + INTERVAL 2 MONTH) AS period_end FROM (SELECT account_id, security_id, unnest(generate_series(date_trunc('quarter', min(trade_date)), date_trunc('quarter', max(trade_date)), INTERVAL 3 MONTH)) AS q FROM tr GROUP BY account_id, security_id) s
    WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.account_id = s.account_id AND tr.security_id = s.security_id AND date_trunc('quarter', trade_date) = q)""")
def missing_quarters(spark, sf):
    return history.missing_quarters(td.trades(spark, sf), "security_id")


_TOTALS = "SELECT o_orderkey AS order_id, sum(l_extendedprice::DECIMAL(18,2)) AS computed, any_value(o_totalprice::DECIMAL(18,2)) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING abs(computed - total) > 0.05"


def _totals(spark, sf):
    parts = td.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    return history.check_totals(parts, td.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("total")), "order_id")


@query(f"SELECT order_id, computed::DOUBLE AS computed, total::DOUBLE AS total, 'TOTAL_MISMATCH' AS code FROM ({_TOTALS})")
def check_totals(spark, sf):
    return _d(_totals(spark, sf))


@query(f", {_UNITS}, i AS (SELECT 'OVERSOLD' AS code FROM h WHERE type = 'SELL' AND units > sold UNION ALL SELECT 'TOTAL_MISMATCH' FROM ({_TOTALS})) SELECT code, count(*) AS issues FROM i GROUP BY code")
def issues_by_code(spark, sf):
    return history.issues_by_code(quality.check_oversold(ledger.running_units(td.trades(spark, sf))), _totals(spark, sf))


_DAYS = ", ".join(f"('{k}', {'NULL' if d is None else d})" for k, d in STANDARD_DAYS.items())


@query(f""", {_PRICES}, sp AS (SELECT security_id, min(price_date) AS f, max(price_date) AS e, arg_max(price, price_date) AS c FROM pr GROUP BY ALL),
    a0 AS (SELECT sp.*, label, CASE label WHEN 'INCEPTION' THEN f WHEN 'YTD' THEN greatest(date_trunc('year', e)::DATE, f) ELSE e - n END AS s FROM sp, (VALUES {_DAYS}) v(label, n)),
    a1 AS (SELECT *, greatest(e - s, 1) AS d, greatest(7, greatest(e - s, 1) // 10) AS t FROM a0),
    m AS (SELECT a1.security_id, label, f, e, c, s, d, t, arg_min({{'d': price_date, 'p': price}}, abs(price_date - s) * 100000 + (price_date - DATE '1970-01-01')) AS near, min(abs(price_date - s)) AS off, arg_min({{'d': price_date, 'p': price}}, price_date) FILTER (price_date >= s) AS nxt FROM a1 JOIN pr ON a1.security_id = pr.security_id GROUP BY ALL),
    k AS (SELECT *, CASE WHEN label <> 'INCEPTION' AND off <= t THEN near ELSE nxt END AS b FROM m),
    r AS (SELECT *, CASE WHEN s < f THEN 'begins before the first valuation' WHEN b.d = e THEN 'both ends are one valuation' WHEN e - b.d > d + t THEN 'valuations lie too far apart' END AS reason FROM k)
    SELECT security_id AS account_id, label, e AS as_at, CASE WHEN reason IS NULL THEN b.d END AS measured_from, CASE WHEN reason IS NULL THEN round(c / b.p - 1, 6) END AS twrr, CASE WHEN reason IS NULL THEN 'ACTUAL' ELSE 'UNAVAILABLE' END AS status, reason FROM r""")
def standard_periods(spark, sf):
    return _d(windows_of(_levels(spark, sf)))


@query(r"SELECT document_id, page, line_no, line FROM (SELECT doc_id AS document_id, 1 AS page, (i - 1)::INTEGER AS line_no, trim(p[i]) AS line FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))) WHERE line <> ''")
def page_lines(spark, sf):
    return exports.page_lines(td.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text"))


@query("""SELECT event_id, CASE WHEN units % 13 = 0 THEN 'UNKNOWN_TRADE_TYPE' WHEN account_id % 11 = 0 THEN 'BAD_TRADE_DATE' WHEN units % 17 = 0 THEN 'BAD_NUMERIC' WHEN units % 19 = 0 THEN 'ZERO_QUANTITY' WHEN units % 23 = 0 THEN 'SIGN_MISMATCH' WHEN units % 7 <> 0 AND units % 5 = 0 THEN 'BAD_BROKERAGE' END AS reason_code,
    CASE WHEN units % 7 = 0 THEN 'SOURCE_BLANK_INTERPRETED_AS_ZERO' ELSE 'SOURCE_VALUE' END AS brokerage_source_status, units % 17 <> 0 AND (account_id % 4 = 0 OR units % 19 = 0) AS warned, CASE WHEN account_id % 11 <> 0 THEN trade_date END AS trade_date, upper(replace(security_id, '#', '')) AS product_id, (CASE WHEN units % 7 = 0 THEN 0 WHEN units % 5 = 0 THEN NULL ELSE fees END)::DOUBLE AS canonical_brokerage FROM tr""")
def parse_investment(spark, sf):
    """The trades written as an export, with some cells spoilt."""
    u, a = F.col("units").cast("int"), F.col("account_id")
    sign = F.when((F.col("type") == "SELL") != (u % 23 == 0), "-").otherwise("")
    raw = td.trades(spark, sf).select(
        "event_id", F.col("security_id").alias("Investment"), F.concat("security_id", F.lit(".AX")).alias("Product ID"), F.lit("ETF").alias("Product Type"), F.when(a % 11 == 0, "-").otherwise(F.date_format("trade_date", "dd-MMM-yyyy")).alias("Trade Date"),
        F.when(u % 13 == 0, "Swap").when(F.col("type") == "SELL", "Sell trade").otherwise("Buy Trade").alias("Type"), F.round(F.col("gross").cast("double") / F.col("units").cast("double"), 6).cast("decimal(18,6)").cast("string").alias("Unit Price"),
        F.when(u % 17 == 0, "n/a").when(u % 19 == 0, "0").otherwise(F.concat(sign, F.col("units").cast("string"))).alias("Quantity"), F.concat(F.lit("$"), F.format_number(F.col("gross") + F.when(a % 4 == 0, 1000).otherwise(0), 2)).alias("Value"),
        F.when(u % 7 == 0, "").when(u % 5 == 0, "x?").otherwise(F.col("fees").cast("string")).alias("Brokerage"),
    )
    return _d(exports.parse_investment(raw).select("event_id", "reason_code", "brokerage_source_status", "warned", "trade_date", "product_id", "canonical_brokerage"))


@query("""SELECT event_id, c AS cash_class, CASE WHEN c IS NULL THEN 'UNKNOWN_CASH_TYPE' WHEN event_id % 31 = 0 THEN 'BAD_DATE' WHEN event_id % 37 = 0 THEN 'BAD_TOTAL' END AS reason_code, event_id % 37 <> 0 AND coalesce(CASE WHEN c IN ('DEPOSIT', 'DISTRIBUTION_INCOME', 'FEE_REVERSAL') THEN amount < 0 WHEN c IN ('WITHDRAWAL', 'ADMIN_FEE', 'TRADE_BROKERAGE_CASH') THEN amount > 0 END, false) AS warned, CASE WHEN event_id % 37 <> 0 THEN amount::DOUBLE END AS signed_total
    FROM (SELECT event_id, amount, CASE WHEN event_id % 29 = 0 THEN NULL WHEN type IN ('DIVIDEND', 'DISTRIBUTION') THEN 'DISTRIBUTION_INCOME' WHEN type <> 'FEE' THEN type WHEN event_id % 3 = 0 THEN 'FEE_REVERSAL' WHEN event_id % 3 = 1 THEN 'TRADE_BROKERAGE_CASH' ELSE 'ADMIN_FEE' END AS c FROM ca)""")
def parse_cash(spark, sf):
    """The cash events written as an export, with some cells spoilt."""
    e = F.col("event_id")
    kind = F.when(e % 29 == 0, "Bonus").when(F.col("type") == "DIVIDEND", "Distribution").when(F.col("type") == "FEE", "Fees and Charges").otherwise(F.initcap("type"))
    name = F.when(e % 3 == 0, "Reversal: fee").when(e % 3 == 1, "ETF Transaction fee for units").otherwise("OngoingAdminChargeByValue")
    raw = td.cash_events(spark, sf).select(
        e, F.when(e % 31 == 0, "soon").otherwise(F.date_format("trade_date", "yyyy-MM-dd")).alias("Date"), kind.alias("Type"), F.lit("Cash").alias("Product Type"), name.alias("Product Name"), F.lit("").alias("Product ID"), F.lit("").alias("Units"),
        F.when(e % 37 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.col("amount").cast("string"))).alias("Total"),
    )
    return _d(exports.parse_cash(raw).select("event_id", "cash_class", "reason_code", "warned", "signed_total"))


NAMES = set(QUERIES) - _BEFORE
