"""Registered queries of checks, classification, attribution and yields, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog import _AVG, _DAILY, _PAIRED, _PAIRS, _PRICES, _QE, _UNITS, _d, _two_sources, query
from ledgerloom.functions import classify
from ledgerloom.functions.text import bucket_end, financial_year
from ledgerloom.operators import attribution, checks, ledger, matching, performance
from ledgerloom.sources import testdata as td
from ledgerloom.sources.shared import checkpointed

START, END, SHIFT = "1995-06-30", "1998-06-30", 9_800


def _round(x: str, places: int = 3) -> str:
    return f"(round(0.0000123 + ({x})::DOUBLE, {places}) + 0.0::DOUBLE)"


_WEEKS = f"""{_DAILY}, l AS (SELECT account_id, (date_trunc('week', trade_date) + INTERVAL 6 DAY)::DATE AS period_end, arg_max(cash, trade_date) AS closing, arg_max(cumulative_contributions, trade_date) AS a, arg_max(cumulative_withdrawals, trade_date) AS b, arg_max(cumulative_income, trade_date) AS c, arg_max(cumulative_fees, trade_date) AS d FROM da GROUP BY ALL),
    ps AS (SELECT account_id, period_end, coalesce(lag(closing) OVER w, 0) AS opening, closing, a - coalesce(lag(a) OVER w, 0) AS deposits, b - coalesce(lag(b) OVER w, 0) AS withdrawals, c - coalesce(lag(c) OVER w, 0) AS income, d - coalesce(lag(d) OVER w, 0) AS fees FROM l WINDOW w AS (PARTITION BY account_id ORDER BY period_end))"""


@query(f""", {_WEEKS} SELECT account_id, period_end, NULL::DOUBLE AS drift, 'PERIOD_SUMMARY_INCOMPLETE' AS code, 'WARNING' AS severity FROM ps WHERE account_id % 11 = 4
    UNION ALL SELECT account_id, period_end, round(drift, 6), 'PERIOD_IDENTITY_DRIFT', 'ERROR' FROM (SELECT *, (opening + deposits + withdrawals + income + fees - closing - CASE WHEN account_id % 3 = 0 THEN 0.10 ELSE 0 END)::DOUBLE AS drift FROM ps WHERE account_id % 11 <> 4) WHERE abs(drift) > 0.05""")
def check_period_identity(spark, sf):
    weeks = performance.period_summaries(ledger.daily_cash(td.cash_events(spark, sf)), "week").withColumnRenamed("contributions", "deposits")
    weeks = weeks.withColumns({"fees": -F.col("fees"), "closing": F.col("closing") + F.when(F.col("account_id") % 3 == 0, F.lit("0.10").cast("decimal(18,2)")).otherwise(0), "opening": F.when(F.col("account_id") % 11 != 4, F.col("opening"))})
    return _d(checks.check_period_identity(weeks))


_CONTINUITY = f"""{_UNITS}, sn AS (SELECT account_id, security_id, {_QE.format("trade_date")} AS reporting_date, arg_max(held, (trade_date, type, event_id)) AS units, sum(CASE WHEN type = 'SELL' THEN -h.units ELSE h.units END) AS traded FROM h GROUP BY ALL),
    uc AS (SELECT account_id, security_id, reporting_date, units, coalesce(lag(units) OVER w, 0) AS before, traded FROM sn WINDOW w AS (PARTITION BY account_id, security_id ORDER BY reporting_date))"""


def _snapshots(spark, sf):
    held = ledger.running_units(td.trades(spark, sf))
    last = held.groupBy("account_id", "security_id", bucket_end(F.col("trade_date"), "quarter").alias("reporting_date")).agg(F.max_by("held", F.struct("trade_date", "type", "event_id")).alias("units"))
    return held.withColumn("units", F.when(F.col("type") == "SELL", -F.col("units")).otherwise(F.col("units"))), last


@query(f", {_CONTINUITY} SELECT account_id, security_id, reporting_date, units::DOUBLE AS units, before::DOUBLE AS before, traded::DOUBLE AS traded, (before + traded)::DOUBLE AS expected FROM uc")
def unit_continuity(spark, sf):
    return _d(checks.unit_continuity(*_snapshots(spark, sf)))


@query(f", {_CONTINUITY} SELECT account_id, security_id, reporting_date, (before + traded)::DOUBLE AS expected, units::DOUBLE AS units, 'UNIT_CONTINUITY_DRIFT' AS code, 'WARNING' AS severity FROM uc WHERE abs(before + traded - units) > 0.05")
def check_unit_continuity(spark, sf):
    return checks.check_unit_continuity(*_snapshots(spark, sf))


@query(f"SELECT account_id, {_QE.format('trade_date')} AS period_end, count(*) AS times, 'DUPLICATE_PERIOD' AS code, 'WARNING' AS severity FROM (SELECT DISTINCT account_id, {_QE.format('trade_date')} AS trade_date, type FROM tr) GROUP BY ALL HAVING count(*) > 1")
def duplicate_periods(spark, sf):
    """One statement for each side that an account traded in a quarter."""
    return checks.duplicate_periods(td.trades(spark, sf).select("account_id", bucket_end(F.col("trade_date"), "quarter").alias("period_end"), "type").distinct())


@query("SELECT event_id, trade_date AS \"on\", 'IMPOSSIBLE_DATE' AS code, 'ERROR' AS severity FROM tr WHERE trade_date > DATE '2001-06-30' OR trade_date < DATE '1992-06-01'")
def check_dates(spark, sf):
    return checks.check_dates(td.trades(spark, sf), "event_id", "trade_date", F.lit("2001-06-30").cast("date"), "1992-06-01")


@query("SELECT account_id, event_id, trade_date AS \"on\", 'TRANSACTION_OUTSIDE_PERIOD' AS code, 'WARNING' AS severity FROM tr WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT account_id, date_trunc('quarter', trade_date)::DATE AS a, (date_trunc('quarter', trade_date) + INTERVAL 40 DAY)::DATE AS b FROM tr WHERE quarter(trade_date) <> 3) p WHERE p.account_id = tr.account_id AND tr.trade_date BETWEEN a AND b)")
def outside_periods(spark, sf):
    """Trades against periods of the first 41 days of every quarter but the third."""
    tr = td.trades(spark, sf)
    start = F.trunc("trade_date", "quarter")
    return checks.outside_periods(tr, tr.where(F.quarter("trade_date") != 3).select("account_id", start.alias("period_start"), F.date_add(start, 40).alias("period_end")).distinct())


@query("SELECT account_id, event_id, type, 'MISSING_SECURITY' AS code, 'WARNING' AS severity FROM tr WHERE security_id = 'Brand#1'")
def check_missing_security(spark, sf):
    return checks.check_missing_security(td.trades(spark, sf).withColumn("security_id", F.nullif("security_id", F.lit("Brand#1"))))


@query("""SELECT account_id, financial_year, computed, total, 'TAX_DIVIDEND_FRANKING_DRIFT' AS code, 'WARNING' AS severity FROM (SELECT account_id, (year(trade_date) + CASE WHEN month(trade_date) > 6 THEN 1 ELSE 0 END)::INTEGER AS financial_year,
    sum(CASE WHEN type = 'DIVIDEND' THEN amount ELSE 0 END)::DOUBLE AS computed, sum(CASE WHEN type IN ('DIVIDEND', 'DISTRIBUTION', 'INTEREST') THEN amount ELSE 0 END)::DOUBLE AS total FROM ca GROUP BY ALL) WHERE abs(computed - total) > 0.05""")
def check_tax_totals(spark, sf):
    """Dividends against reports that count interest among them."""
    cash = td.cash_events(spark, sf).withColumn("financial_year", financial_year(F.col("trade_date")))
    reported = cash.groupBy("account_id", "financial_year").agg(F.coalesce(F.sum(F.when(F.col("type").isin("DIVIDEND", "DISTRIBUTION", "INTEREST"), F.col("amount"))), F.lit(0)).alias("total"))
    return _d(checks.check_tax_totals(reported, cash.where("type = 'DIVIDEND'")))


@query(f"""{_PAIRS}, ok AS ({_PAIRED}) SELECT tr.account_id, event_id, days_to_cash, CASE WHEN days_to_cash IS NULL THEN 'SETTLEMENT_PENDING' ELSE 'SETTLEMENT_DATE_MISMATCH' END AS code, CASE WHEN days_to_cash IS NULL THEN 'INFO' ELSE 'ERROR' END AS severity
    FROM tr LEFT JOIN ok ON ok.trade_id = tr.event_id WHERE days_to_cash IS NULL OR days_to_cash <> 0""")
def check_settlement(spark, sf):
    one, other = _two_sources(spark, sf, stored=True)
    net = F.when(F.col("type") == "SELL", F.col("gross") - F.col("fees")).otherwise(-(F.col("gross") + F.col("fees")))
    return checks.settlement_issues(matching.settled(one, other.select("account_id", "event_id", "trade_date", net.alias("amount"))))


@query("SELECT type, count(*) AS n_rows, count(*) - count(DISTINCT account_id || '|' || trade_date) AS duplicates FROM ca GROUP BY ALL")
def duplicate_ids(spark, sf):
    return checks.duplicate_ids(td.cash_events(spark, sf).withColumn("slot", F.concat_ws("|", "account_id", "trade_date")), "slot")


_SAID = "CASE event_type WHEN 'purchase' THEN 'Direct Entry Deposit - bank ' || event_id WHEN 'click' THEN 'Payment to account ' || event_id WHEN 'view' THEN 'DIV : CODE @ AUD 0.5' WHEN 'signup' THEN 'Cash Account Interest' ELSE 'Closing Balance' END"
_RULED = "CASE " + " ".join(f"WHEN regexp_matches(said, '(?i){p}') THEN '{k}'" for p, k in classify.CASH_RULES) + " ELSE 'OTHER' END"


@query(f"""SELECT event_id, type, marker, CASE WHEN type = 'DEPOSIT' THEN 'Direct Entry Deposit' ELSE said END AS shown, CASE WHEN value > 50 THEN 'BUY' WHEN type = 'DEPOSIT' THEN 'OTHER' ELSE 'SELL' END AS side, security_type, CASE WHEN security_type = 'SHARE' THEN 'DIVIDEND' ELSE 'DISTRIBUTION' END AS income_type
    FROM (SELECT event_id, value, said, {_RULED} AS type, regexp_matches(said, '(?i)balance') AS marker, CASE WHEN user_id % 4 = 0 THEN 'MANAGED_FUND' WHEN user_id % 4 = 1 THEN 'ETF' WHEN user_id % 4 = 2 THEN 'MANAGED_FUND' ELSE 'SHARE' END AS security_type FROM (SELECT *, {_SAID} AS said FROM events))""")
def classify_events(spark, sf):
    """Event descriptions, made of the event kinds, classified in every way that the library knows."""
    ev = td.table(spark, sf, "events").withColumn("said", F.expr(_SAID))
    kind = classify.classify_cash(F.col("said"))
    group = F.col("user_id") % 4
    security = classify.security_type(F.when(group == 0, "managed_fund"), F.when(group == 1, "World ETF fund").when(group == 2, "Some Fund").otherwise("Company"))
    words = F.when(kind == "DEPOSIT", F.col("said")).otherwise("sold")
    return ev.select("event_id", kind.alias("type"), classify.is_balance_marker(F.col("said")).alias("marker"), classify.strip_deposit_source(F.col("said"), kind).alias("shown"), classify.classify_trade(F.when(F.col("value") > 50, 1), words).alias("side"), security.alias("security_type"), classify.income_type_for(security).alias("income_type"))


@query("SELECT code, n, CASE WHEN code IN ('Brand#1', 'Brand#2') THEN 'bonds' WHEN n % 2 = 0 THEN 'australian_equities' ELSE 'unknown' END AS asset_class FROM (SELECT security_id AS code, count(*) AS n FROM tr GROUP BY ALL)")
def classify_asset(spark, sf):
    own = td.trades(spark, sf).groupBy(F.col("security_id").alias("code")).agg(F.count("*").alias("n")).withColumn("type", F.when(F.col("n") % 2 == 0, "SHARE").otherwise("ETF"))
    return classify.classify_asset(own, spark.createDataFrame([("Brand#1", "bonds"), ("Brand#2", "bonds")], "code string, asset_class string")).drop("type")


def _state_sql(name: str, on: str) -> str:
    return f"""{name}0 AS (SELECT account_id, security_id, arg_max(held, k) AS units, arg_max(cost, k) AS cost, sum(gain) AS realised, DATE '{on}' AS d FROM av WHERE trade_date <= DATE '{on}' GROUP BY ALL),
    {name} AS (SELECT account_id, {name}0.security_id, realised, coalesce(CASE WHEN units = 0 THEN 0 ELSE units::DOUBLE * price END, 0) AS value, coalesce(CASE WHEN units = 0 THEN 0 ELSE units::DOUBLE * price END - cost, 0) AS unrealised FROM {name}0 ASOF LEFT JOIN pr ON {name}0.security_id = pr.security_id AND d >= pr.price_date)"""


_WINDOW = f"""{_AVG}, {_PRICES}, {_state_sql("sa", START)}, {_state_sql("sb", END)},
    ev AS (SELECT account_id, NULL::VARCHAR AS security_id, type, amount::DOUBLE AS amount, 0::DOUBLE AS fees, (trade_date - {SHIFT})::DATE AS d FROM ca WHERE (trade_date - {SHIFT})::DATE > DATE '{START}' AND (trade_date - {SHIFT})::DATE <= DATE '{END}'
           UNION ALL SELECT account_id, security_id, type, CASE WHEN type = 'BUY' THEN gross + fees ELSE -(gross - fees) END::DOUBLE, fees::DOUBLE, trade_date FROM tr WHERE trade_date > DATE '{START}' AND trade_date <= DATE '{END}'),
    ta AS (SELECT account_id, sum(value) AS v, sum(unrealised) AS u, sum(realised) AS r FROM sa GROUP BY ALL), tb AS (SELECT account_id, sum(value) AS v, sum(unrealised) AS u, sum(realised) AS r FROM sb GROUP BY ALL),
    te AS (SELECT account_id, coalesce(sum(amount) FILTER (type = 'DIVIDEND'), 0) AS dividends, coalesce(sum(amount) FILTER (type = 'DISTRIBUTION'), 0) AS distributions, coalesce(sum(amount) FILTER (type = 'INTEREST'), 0) AS interest, coalesce(sum(amount) FILTER (type IN ('DEPOSIT', 'WITHDRAWAL')), 0) AS external, abs(coalesce(sum(amount) FILTER (type = 'FEE'), 0)) AS all_fees, coalesce(sum(fees) FILTER (type IN ('BUY', 'SELL')), 0) AS trade_costs,
           coalesce(sum(amount * (DATE '{END}' - d) / (DATE '{END}' - DATE '{START}')) FILTER (type IN ('DEPOSIT', 'WITHDRAWAL')), 0) AS weighted FROM ev GROUP BY ALL),
    gd AS (SELECT coalesce(tb.account_id, ta.account_id, te.account_id) AS account_id, coalesce(tb.u, 0) - coalesce(ta.u, 0) + coalesce(tb.r, 0) - coalesce(ta.r, 0) AS capital_gains, coalesce(dividends, 0) AS dividends, coalesce(distributions, 0) AS distributions, coalesce(interest, 0) AS interest, coalesce(all_fees - trade_costs, 0) AS fees, coalesce(trade_costs, 0) AS trade_costs, coalesce(external, 0) AS external
           FROM tb FULL JOIN ta ON ta.account_id = tb.account_id FULL JOIN te ON te.account_id = coalesce(tb.account_id, ta.account_id)),
    ac AS (SELECT coalesce(tb.account_id, ta.account_id) AS account_id, CASE WHEN coalesce(ta.v, 0) + coalesce(weighted, 0) > 0 THEN coalesce(ta.v, 0) + coalesce(weighted, 0) ELSE (coalesce(ta.v, 0) + coalesce(tb.v, 0)) / 2 END AS average_capital
           FROM tb FULL JOIN ta ON ta.account_id = tb.account_id LEFT JOIN te ON te.account_id = coalesce(tb.account_id, ta.account_id))"""


def _window(spark, sf):
    """States at both ends, events between, and average capital."""
    tr = td.trades(spark, sf)
    prices = td.prices(tr)
    states = checkpointed(ledger.portfolio_states(tr, prices, [START, END]).fillna(0.0, ["value", "unrealised"]))  # a row for each position and end
    begin, finish = (states.where(F.col("on") == F.lit(on)).drop("on") for on in (START, END))
    cash = td.cash_events(spark, sf).withColumn("trade_date", F.date_sub("trade_date", SHIFT)).withColumns({"security_id": F.lit(None).cast("string"), "fees": F.lit(0).cast("decimal(18,2)")})
    net = F.when(F.col("type") == "BUY", F.col("gross") + F.col("fees")).otherwise(-(F.col("gross") - F.col("fees"))).cast("decimal(18,2)")
    names = ["account_id", "security_id", "type", "amount", "fees", "trade_date"]
    events = ledger.ledger_slice(cash.select(names).unionByName(tr.withColumn("amount", net).select(names)), START, END)
    flows = events.where(F.col("type").isin("DEPOSIT", "WITHDRAWAL")).select("account_id", F.col("trade_date").alias("date"), "amount")
    return begin, finish, events, attribution.average_capital(begin, finish, flows, START, END)


@query(f", {_WINDOW} SELECT account_id, {_round('capital_gains')} AS capital_gains, {_round('dividends')} AS dividends, {_round('distributions')} AS distributions, {_round('interest')} AS interest, {_round('fees')} AS fees, {_round('trade_costs')} AS trade_costs, {_round('0')} AS taxes, {_round('0')} AS other, {_round('external')} AS external FROM gd")
def growth_decomposition(spark, sf):
    begin, finish, events, _ = _window(spark, sf)
    return _d(attribution.growth_decomposition(begin, finish, events), 3, 0.0000123)


@query(f""", {_WINDOW}, fl AS (SELECT account_id, security_id, coalesce(sum(amount) FILTER (type = 'BUY'), 0) AS purchases, coalesce(sum(abs(amount)) FILTER (type = 'SELL'), 0) AS sales FROM ev GROUP BY ALL),
    xs AS (SELECT coalesce(sb.account_id, sa.account_id) AS account_id, coalesce(sb.security_id, sa.security_id) AS security_id, coalesce(sa.value, 0) AS a, coalesce(sb.value, 0) AS b, coalesce(purchases, 0) AS p, coalesce(sales, 0) AS s,
           coalesce(sb.realised, 0) - coalesce(sa.realised, 0) + coalesce(sb.unrealised, 0) - coalesce(sa.unrealised, 0) AS profit FROM sb FULL JOIN sa ON sa.account_id = sb.account_id AND sa.security_id = sb.security_id
           LEFT JOIN fl ON fl.account_id = coalesce(sb.account_id, sa.account_id) AND fl.security_id = coalesce(sb.security_id, sa.security_id))
    SELECT xs.account_id, security_id, {_round('a')} AS opening_value, {_round('b')} AS closing_value, {_round('b - a - p + s')} AS capital_gain, {_round('0')} AS income, {_round('CASE WHEN a + p / 2 - s / 2 > 0 THEN (b - a - p + s) / (a + p / 2 - s / 2) END')} AS total_return,
           {_round('CASE WHEN average_capital > 0 THEN (a + b) / 2 / average_capital END')} AS weight, {_round('CASE WHEN average_capital > 0 THEN profit / average_capital END')} AS contribution FROM xs LEFT JOIN ac ON ac.account_id = xs.account_id""")
def security_attribution(spark, sf):
    return _d(attribution.security_attribution(*_window(spark, sf)), 3, 0.0000123)


@query(f""", {_WINDOW}, pa AS (SELECT account_id, security_id AS code, realised + unrealised AS profit FROM sb UNION ALL SELECT account_id, 'Cash', interest - fees FROM gd WHERE account_id IN (SELECT account_id FROM te)),
    ra AS (SELECT pa.account_id, code, profit, CASE WHEN average_capital > 0 THEN profit / average_capital END AS share, row_number() OVER (PARTITION BY pa.account_id ORDER BY profit DESC, code) AS rank FROM pa LEFT JOIN ac ON ac.account_id = pa.account_id)
    SELECT account_id, code, {_round('profit')} AS profit, {_round('share')} AS share, rank::INTEGER AS rank FROM ra""")
def profit_attribution(spark, sf):
    begin, finish, events, capital = _window(spark, sf)
    cash = attribution.growth_decomposition(begin, finish, events).join(events.select("account_id").distinct(), "account_id", "left_semi").select("account_id", "interest", "fees")
    income = events.where(F.col("type").isin("DIVIDEND", "DISTRIBUTION") & F.col("security_id").isNotNull()).groupBy("account_id", "security_id").agg(F.sum("amount").cast("double").alias("income"))
    return _d(attribution.profit_attribution(finish, income, cash, capital), 3, 0.0000123)


@query(f", {_WINDOW} SELECT gd.account_id, {_round('CASE WHEN average_capital > 0 THEN capital_gains / average_capital END', 4)} AS capital_return, {_round('CASE WHEN average_capital > 0 THEN (dividends + distributions + interest) / average_capital END', 4)} AS income_return, {_round('CASE WHEN average_capital > 0 THEN fees / average_capital END', 4)} AS fee_drag, {_round('CASE WHEN average_capital > 0 THEN (capital_gains + dividends + distributions + interest - fees) / average_capital END', 4)} AS total_return FROM gd LEFT JOIN ac ON ac.account_id = gd.account_id")
def return_decomposition(spark, sf):
    begin, finish, events, capital = _window(spark, sf)
    return _d(attribution.return_decomposition(attribution.growth_decomposition(begin, finish, events), capital), 4, 0.0000123)


@query(f""", {_WINDOW}, bs AS (SELECT coalesce(tb.account_id, ta.account_id) AS account_id, coalesce(tb.v, 0) - coalesce(ta.v, 0) - coalesce(p, 0) AS actual FROM tb FULL JOIN ta ON ta.account_id = tb.account_id
        LEFT JOIN (SELECT account_id, sum(amount) AS p FROM ev WHERE type IN ('BUY', 'SELL') GROUP BY ALL) q ON q.account_id = coalesce(tb.account_id, ta.account_id))
    SELECT gd.account_id, {_round('capital_gains', 2)} AS attributed, {_round('actual', 2)} AS actual, {_round('capital_gains - actual', 2)} AS residual, CASE WHEN actual IS NULL THEN 'LIMITED' WHEN abs(capital_gains - actual) <= 50000 THEN 'PASS' ELSE 'FAIL' END AS status FROM gd LEFT JOIN bs ON bs.account_id = gd.account_id""")
def reconcile_growth(spark, sf):
    """Capital gains from cost bases against the change in value less net purchases: sells of units that weren't held part them."""
    begin, finish, events, _ = _window(spark, sf)
    net = events.where(F.col("type").isin("BUY", "SELL")).groupBy("account_id").agg(F.sum("amount").cast("double").alias("net"))
    ends = finish.groupBy("account_id").agg(F.sum("value").alias("b")).join(begin.groupBy("account_id").agg(F.sum("value").alias("a")), "account_id", "full").join(net, "account_id", "left").fillna(0.0)
    own = attribution.growth_decomposition(begin, finish, events).select("account_id", F.col("capital_gains").alias("attributed")).join(ends.select("account_id", (F.col("b") - F.col("a") - F.col("net")).alias("actual")), "account_id", "left")
    return _d(attribution.reconciled(own, "attributed", "actual", 50_000), 2, 0.0000123)


@query(f", {_AVG}, g AS (SELECT account_id, security_id, sum(sold)::DOUBLE AS units, sum(gain + allocated) AS proceeds, sum(allocated) AS cost, sum(gain) AS gain FROM (SELECT av.*, h.sold FROM av JOIN h ON h.event_id = av.event_id WHERE av.type = 'SELL') GROUP BY ALL) SELECT account_id, security_id, {_round('units')} AS units, {_round('proceeds')} AS proceeds, {_round('cost')} AS cost, {_round('gain')} AS gain, (row_number() OVER (PARTITION BY account_id ORDER BY gain DESC, security_id))::INTEGER AS rank FROM g")
def gains_by_security(spark, sf):
    return _d(attribution.gains_by_security(ledger.average_cost(td.trades(spark, sf)).where("type = 'SELL'")), 3, 0.0000123)


@query(f", {_WINDOW}, x AS (SELECT coalesce(tb.account_id, i.account_id) AS account_id, coalesce(u, 0) AS u, coalesce(r, 0) AS r, coalesce(income, 0) AS income FROM tb FULL JOIN (SELECT account_id, sum(amount) AS income FROM ev WHERE type IN ('DIVIDEND', 'DISTRIBUTION', 'INTEREST') GROUP BY ALL) i ON i.account_id = tb.account_id) SELECT account_id, {_round('u')} AS unrealised, {_round('r')} AS realised, {_round('income')} AS income, {_round('u + r + income')} AS total FROM x")
def gain_attribution(spark, sf):
    _, finish, events, _ = _window(spark, sf)
    income = events.where(F.col("type").isin("DIVIDEND", "DISTRIBUTION", "INTEREST")).groupBy("account_id").agg(F.sum("amount").cast("double").alias("income"))
    return _d(attribution.gain_attribution(finish, income), 3, 0.0000123)


@query("SELECT account_id, security_id, sum(fees)::DOUBLE AS brokerage, sum(gross)::DOUBLE AS traded, count(*) AS trades, round(sum(fees)::DOUBLE / sum(gross)::DOUBLE, 6) AS rate FROM tr GROUP BY ALL")
def fees_by_security(spark, sf):
    return _d(attribution.fees_by_security(td.trades(spark, sf)))


_VALUES = f"{_WINDOW}, vs AS (SELECT account_id, v AS value FROM ta UNION ALL SELECT account_id, v FROM tb), mv AS (SELECT account_id, avg(value) AS mean_value FROM vs GROUP BY ALL)"


def _values(begin, finish):
    total = lambda s: s.groupBy("account_id").agg(F.sum("value").alias("value"))
    return total(begin).unionByName(total(finish))


@query(f""", {_VALUES}, b AS (SELECT account_id, sum(fees) AS brokerage FROM ev WHERE type IN ('BUY', 'SELL') GROUP BY ALL), f AS (SELECT account_id, abs(sum(amount)) AS account_fees FROM ev WHERE type = 'FEE' GROUP BY ALL),
    x AS (SELECT coalesce(b.account_id, f.account_id) AS account_id, coalesce(brokerage, 0) AS brokerage, coalesce(account_fees, 0) AS account_fees FROM b FULL JOIN f ON f.account_id = b.account_id)
    SELECT x.account_id, {_round('brokerage')} AS brokerage, {_round('account_fees')} AS account_fees, {_round('mean_value')} AS mean_value, {_round('CASE WHEN mean_value > 0 THEN (brokerage + account_fees) / mean_value END', 5)} AS ratio FROM x LEFT JOIN mv ON mv.account_id = x.account_id""")
def fee_summary(spark, sf):
    begin, finish, events, _ = _window(spark, sf)
    got = attribution.fee_summary(events.where(F.col("type").isin("BUY", "SELL")), events.where("type = 'FEE'"), _values(begin, finish))
    return got.select("account_id", *[F.round(F.col(c) + 0.0000123, 5 if c == "ratio" else 3).alias(c) for c in ("brokerage", "account_fees", "mean_value", "ratio")])


@query(f""", {_VALUES}, x AS (SELECT gd.*, mean_value, dividends + distributions + interest AS income, capital_gains + dividends + distributions + interest - fees AS gain FROM gd LEFT JOIN mv ON mv.account_id = gd.account_id)
    SELECT account_id, {_round('CASE WHEN external > 0 THEN income / external END')} AS income_on_contributions, {_round('CASE WHEN external > 0 THEN gain / external END', 2)} AS gain_on_contributions, {_round('CASE WHEN mean_value > 0 THEN fees / mean_value END', 5)} AS fees_on_value, {_round('CASE WHEN gain > 0 THEN income / gain END')} AS income_share FROM x""")
def efficiency_metrics(spark, sf):
    begin, finish, events, _ = _window(spark, sf)
    got = attribution.efficiency_metrics(attribution.growth_decomposition(begin, finish, events), _values(begin, finish))
    return got.select("account_id", *[F.round(F.col(c) + 0.0000123, k).alias(c) for c, k in (("income_on_contributions", 3), ("gain_on_contributions", 2), ("fees_on_value", 5), ("income_share", 3))])


@query("SELECT account_id, (date_trunc('week', trade_date) + INTERVAL 6 DAY)::DATE AS period_end, CASE WHEN type = 'DIVIDEND' THEN 'australian_equities' ELSE 'unknown' END AS asset_class, sum(amount)::DOUBLE AS income FROM ca WHERE type IN ('DIVIDEND', 'DISTRIBUTION', 'INTEREST') GROUP BY ALL")
def income_by_class(spark, sf):
    """Income whose kind stands for its security: dividends have a class, interest has none."""
    income = td.cash_events(spark, sf).where(F.col("type").isin("DIVIDEND", "DISTRIBUTION", "INTEREST")).withColumnRenamed("type", "security_id")
    return _d(attribution.income_by_class(income, spark.createDataFrame([("DIVIDEND", "australian_equities")], "security_id string, asset_class string"), bucket_end(F.col("trade_date"), "week")))


@query(f""", {_DAILY}, v AS (SELECT account_id, avg(value) AS mean_value, count(value) AS known, count(*) AS days FROM (SELECT account_id, CASE WHEN cash > 0 THEN cash::DOUBLE END AS value FROM da) GROUP BY ALL),
    i AS (SELECT account_id, sum(amount)::DOUBLE AS income FROM ca WHERE type IN ('DIVIDEND', 'DISTRIBUTION', 'INTEREST') GROUP BY ALL)
    SELECT v.account_id, {_round('coalesce(income, 0)')} AS income, {_round('mean_value')} AS mean_value, {_round('CASE WHEN mean_value > 0 THEN coalesce(income, 0) / mean_value END')} AS yield, CASE WHEN known = days THEN 'ACTUAL' ELSE 'ESTIMATED' END AS quality FROM v LEFT JOIN i ON i.account_id = v.account_id""")
def income_yield(spark, sf):
    cash = td.cash_events(spark, sf)
    values = ledger.daily_cash(cash).select("account_id", F.when(F.col("cash") > 0, F.col("cash").cast("double")).alias("value"))
    return _d(attribution.income_yield(cash.where(F.col("type").isin("DIVIDEND", "DISTRIBUTION", "INTEREST")), values, "account_id"), 3, 0.0000123)
