"""Registered queries of the ledger library over the given tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as t
from ledgerloom.operators import analytics, history, ledger, matching, performance, quality
from ledgerloom.plans.quarters import quarterly_returns
from ledgerloom.sources import testdata as td
from ledgerloom.streaming import staging

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ON = "2000-06-30"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"WITH RECURSIVE tr AS ({td.TRADES_SQL}), ca AS ({td.CASH_SQL}) {sql}"
        return f

    return keep


def _d(df: DataFrame, places: int = 6, shift: float = 0.0) -> DataFrame:
    """Decimals as doubles, doubles rounded; ``shift`` moves halves of a place, which rounding errors would settle, off the border."""
    return df.select(*[F.round(F.col(c).cast("double") + shift, places).alias(c) if k.startswith(("decimal", "double")) else F.col(c) for c, k in df.dtypes])


_FLOWS = "sum(CASE WHEN type = 'DEPOSIT' THEN amount ELSE 0 END) AS deposits, sum(CASE WHEN type = 'WITHDRAWAL' THEN amount ELSE 0 END) AS withdrawals, sum(CASE WHEN type IN ('DIVIDEND', 'DISTRIBUTION', 'INTEREST') THEN amount ELSE 0 END) AS income, sum(CASE WHEN type = 'FEE' THEN amount ELSE 0 END) AS fees, sum(amount) AS net"


@query(f"SELECT account_id, deposits::DOUBLE AS deposits, withdrawals::DOUBLE AS withdrawals, income::DOUBLE AS income, fees::DOUBLE AS fees, net::DOUBLE AS net, (deposits + withdrawals)::DOUBLE AS external_net FROM (SELECT account_id, {_FLOWS} FROM ca WHERE trade_date > DATE '2024-01-05' AND trade_date <= DATE '2024-01-25' GROUP BY account_id)")
def cash_flows(spark, sf):
    return _d(ledger.cash_flows(ledger.ledger_slice(td.cash_events(spark, sf), "2024-01-05", "2024-01-25"), "account_id"))


_DAILY = f"""sp AS (SELECT account_id, unnest(generate_series(min(trade_date), max(trade_date), INTERVAL 1 DAY))::DATE AS trade_date FROM ca GROUP BY account_id),
    dy AS (SELECT account_id, trade_date, {_FLOWS} FROM ca GROUP BY ALL),
    da AS (SELECT sp.account_id, sp.trade_date, coalesce(sum(net) OVER w, 0)::DECIMAL(18,2) AS cash, coalesce(sum(deposits) OVER w, 0)::DECIMAL(18,2) AS cumulative_contributions, coalesce(sum(withdrawals) OVER w, 0)::DECIMAL(18,2) AS cumulative_withdrawals,
           coalesce(sum(income) OVER w, 0)::DECIMAL(18,2) AS cumulative_income, coalesce(sum(fees) OVER w, 0)::DECIMAL(18,2) AS cumulative_fees
           FROM sp LEFT JOIN dy USING (account_id, trade_date) WINDOW w AS (PARTITION BY sp.account_id ORDER BY sp.trade_date))"""


@query(f", {_DAILY} SELECT account_id, trade_date, cash::DOUBLE AS cash, cumulative_contributions::DOUBLE AS cumulative_contributions, cumulative_withdrawals::DOUBLE AS cumulative_withdrawals, cumulative_income::DOUBLE AS cumulative_income, cumulative_fees::DOUBLE AS cumulative_fees FROM da")
def daily_cash(spark, sf):
    return _d(ledger.daily_cash(td.cash_events(spark, sf)))


@query(f""", {_DAILY}, l AS (SELECT account_id, (date_trunc('week', trade_date) + INTERVAL 6 DAY)::DATE AS period_end, arg_max(cash, trade_date) AS closing, arg_max(cumulative_contributions, trade_date) AS a, arg_max(cumulative_withdrawals, trade_date) AS b, arg_max(cumulative_income, trade_date) AS c, arg_max(cumulative_fees, trade_date) AS d FROM da GROUP BY ALL)
    SELECT account_id, period_end, coalesce(lag(closing) OVER w, 0)::DOUBLE AS opening, closing::DOUBLE AS closing, (a - coalesce(lag(a) OVER w, 0))::DOUBLE AS contributions, (b - coalesce(lag(b) OVER w, 0))::DOUBLE AS withdrawals, (c - coalesce(lag(c) OVER w, 0))::DOUBLE AS income, (d - coalesce(lag(d) OVER w, 0))::DOUBLE AS fees FROM l WINDOW w AS (PARTITION BY account_id ORDER BY period_end)""")
def period_summaries(spark, sf):
    return _d(performance.period_summaries(ledger.daily_cash(td.cash_events(spark, sf)), "week"))


_UNITS = """s AS (SELECT *, sum(CASE WHEN type = 'SELL' THEN -units ELSE units END) OVER w AS s FROM tr WINDOW w AS (PARTITION BY account_id, security_id ORDER BY trade_date, type, event_id)),
    h0 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY account_id, security_id ORDER BY trade_date, type, event_id)) AS held FROM s),
    h AS (SELECT *, CASE WHEN type = 'SELL' THEN coalesce(lag(held) OVER (PARTITION BY account_id, security_id ORDER BY trade_date, type, event_id), 0) - held ELSE 0 END AS sold FROM h0)"""


@query(f", {_UNITS} SELECT event_id, account_id, security_id, held::DOUBLE AS held, sold::DOUBLE AS sold, (CASE WHEN type = 'SELL' THEN units - sold ELSE 0 END)::DOUBLE AS excess FROM h")
def position_units(spark, sf):
    return _d(ledger.running_units(td.trades(spark, sf)).select("event_id", "account_id", "security_id", "held", "sold", "excess"))


_FIFO = f"""{_UNITS}, m AS (SELECT *, CASE WHEN type = 'SELL' THEN sold ELSE units END AS moved FROM h),
    c AS (SELECT *, sum(moved) OVER (PARTITION BY account_id, security_id, type ORDER BY trade_date, event_id) AS hi FROM m WHERE moved > 0),
    f AS (SELECT b.account_id, b.security_id, b.event_id AS buy_id, s.event_id AS sell_id, least(b.hi, s.hi) - greatest(b.hi - b.moved, s.hi - s.moved) AS units, b.gross, b.fees, b.units AS bought
          FROM c b JOIN c s ON b.account_id = s.account_id AND b.security_id = s.security_id AND b.type = 'BUY' AND s.type = 'SELL' AND b.hi - b.moved < s.hi AND s.hi - s.moved < b.hi)"""


@query(f", {_FIFO} SELECT account_id, security_id, sell_id, round(0.0000123 + sum(units)::DOUBLE, 4) AS units, round(0.0000123 + sum(units::DOUBLE * (gross + fees)::DOUBLE / bought::DOUBLE), 4) AS cost FROM f GROUP BY ALL")
def fifo_disposals(spark, sf):
    own = ledger.fifo_matches(td.trades(spark, sf)).where("sell_id IS NOT NULL")
    return _d(own.groupBy("account_id", "security_id", "sell_id").agg(F.sum("units").alias("units"), F.sum("cost").alias("cost")), 4, 0.0000123)


_AVG = f"""{_UNITS}, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY account_id, security_id ORDER BY trade_date, type, event_id) AS k FROM h),
    av AS (SELECT account_id, security_id, k, event_id, trade_date, type, held, CASE WHEN type = 'BUY' THEN (gross + fees)::DOUBLE ELSE 0 END AS cost, 0.0::DOUBLE AS allocated, CASE WHEN type = 'BUY' THEN 0 ELSE (gross - fees)::DOUBLE END AS gain FROM n WHERE k = 1
           UNION ALL SELECT n.account_id, n.security_id, n.k, n.event_id, n.trade_date, n.type, n.held,
           CASE WHEN n.held = 0 THEN 0 WHEN n.type = 'BUY' THEN av.cost + (n.gross + n.fees)::DOUBLE ELSE av.cost - av.cost * n.sold::DOUBLE / av.held::DOUBLE END,
           CASE WHEN n.type = 'BUY' OR av.held = 0 THEN 0 ELSE av.cost * n.sold::DOUBLE / av.held::DOUBLE END,
           CASE WHEN n.type = 'BUY' THEN 0 ELSE (n.gross - n.fees)::DOUBLE - CASE WHEN av.held = 0 THEN 0 ELSE av.cost * n.sold::DOUBLE / av.held::DOUBLE END END
           FROM av JOIN n ON n.account_id = av.account_id AND n.security_id = av.security_id AND n.k = av.k + 1)"""


@query(f", {_AVG} SELECT account_id, security_id, event_id, round(0.0000123 + held::DOUBLE, 4) AS held, round(0.0000123 + cost, 4) AS cost, round(0.0000123 + allocated, 4) AS allocated, round(0.0000123 + gain, 4) AS gain FROM av")
def average_cost(spark, sf):
    return _d(ledger.average_cost(td.trades(spark, sf)).select("account_id", "security_id", "event_id", "held", "cost", "allocated", "gain"), 4, 0.0000123)


_PRICES = "pr AS (SELECT security_id, last_day(trade_date) AS price_date, round(arg_max(gross, (trade_date, event_id))::DOUBLE / arg_max(units, (trade_date, event_id))::DOUBLE + 0.00000001, 6) AS price FROM tr GROUP BY ALL)"


@query(f", {_PRICES}, p AS (SELECT event_id, security_id, trade_date AS \"on\" FROM tr) SELECT p.event_id, p.security_id, pr.price_date, pr.price, CASE WHEN pr.price IS NULL THEN 'UNAVAILABLE' WHEN pr.price_date = \"on\" THEN 'QUOTED' ELSE 'CARRIED_FORWARD' END AS quality FROM p ASOF LEFT JOIN pr ON p.security_id = pr.security_id AND p.\"on\" >= pr.price_date")
def asof_prices(spark, sf):
    tr = td.trades(spark, sf)
    return ledger.asof_prices(tr.select("event_id", "security_id", F.col("trade_date").alias("on")), td.prices(tr)).select("event_id", "security_id", "price_date", "price", "quality")


_STATE = f"""{_AVG}, {_PRICES}, st0 AS (SELECT account_id, security_id, arg_max(held, k) AS units, arg_max(cost, k) AS cost, sum(gain) AS realised FROM av WHERE trade_date <= DATE '{ON}' GROUP BY ALL),
    st1 AS (SELECT *, DATE '{ON}' AS d FROM st0), st AS (SELECT st1.*, pr.price, pr.price_date, CASE WHEN units = 0 THEN 0 ELSE units::DOUBLE * price END AS value FROM st1 ASOF LEFT JOIN pr ON st1.security_id = pr.security_id AND d >= pr.price_date)"""


@query(f", {_STATE} SELECT account_id, security_id, round(0.0000123 + units::DOUBLE, 3) AS units, round(0.0000123 + cost, 3) AS cost, round(0.0000123 + realised, 3) AS realised, round(0.0000123 + price, 3) AS price, CASE WHEN units = 0 THEN 'NOT_HELD' WHEN price IS NULL THEN 'UNAVAILABLE' WHEN price_date = d THEN 'QUOTED' ELSE 'CARRIED_FORWARD' END AS quality, round(0.0000123 + value, 3) AS value, round(0.0000123 + value - cost, 3) AS unrealised FROM st")
def portfolio_state(spark, sf):
    tr = td.trades(spark, sf)
    return _d(ledger.portfolio_state(tr, td.prices(tr), ON), 3, 0.0000123)


_ALLOC = f"{_STATE}, al AS (SELECT account_id, security_id, value, value / sum(value) OVER (PARTITION BY account_id) AS weight FROM st WHERE units <> 0)"


@query(f", {_ALLOC}, r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY weight DESC, security_id) AS k FROM al) SELECT account_id, round(sum(weight) FILTER (k <= 1), 6) AS largest, round(sum(weight) FILTER (k <= 5), 6) AS top5, round(sum(weight) FILTER (k <= 10), 6) AS top10, round(sum(weight * weight), 6) AS hhi, count(*) AS holdings FROM r GROUP BY ALL")
def concentration(spark, sf):
    tr = td.trades(spark, sf)
    return _d(analytics.concentration(analytics.allocation(ledger.portfolio_state(tr, td.prices(tr), ON))))


@query(f", {_STATE}, l AS (SELECT account_id, 'capital' AS node, security_id AS leaf, realised + coalesce(value - cost, 0) AS value FROM st UNION ALL SELECT account_id, 'fees', 'fees', -sum(fees)::DOUBLE FROM tr WHERE trade_date <= DATE '{ON}' GROUP BY account_id) SELECT account_id, node, leaf, round(0.0000123 + sum(value), 3) AS value FROM l GROUP BY ROLLUP (account_id, node, leaf) HAVING account_id IS NOT NULL")
def attribution_tree(spark, sf):
    tr = td.trades(spark, sf)
    fees = tr.where(F.col("trade_date") <= ON).groupBy("account_id").agg((-F.sum("fees")).cast("double").alias("value"))
    return _d(analytics.attribution(ledger.portfolio_state(tr, td.prices(tr), ON), fees), 3, 0.0000123)


@query(f", {_AVG} SELECT account_id, (year(trade_date) + CASE WHEN month(trade_date) > 6 THEN 1 ELSE 0 END)::INTEGER AS financial_year, round(0.0000123 + sum(greatest(gain, 0)), 3) AS gains, round(0.0000123 + sum(least(gain, 0)), 3) AS losses, round(0.0000123 + sum(gain), 3) AS net, count(*) AS sells FROM av WHERE type = 'SELL' GROUP BY ALL")
def realised_gains(spark, sf):
    return _d(analytics.realised_gains(ledger.average_cost(td.trades(spark, sf)).where("type = 'SELL'")), 3, 0.0000123)


@query("SELECT account_id, make_date(year(trade_date), 12, 31) AS period_end, count(*) FILTER (type = 'BUY') AS buys, count(*) FILTER (type = 'SELL') AS sells, coalesce(sum(gross) FILTER (type = 'BUY'), 0)::DOUBLE AS bought, coalesce(sum(gross) FILTER (type = 'SELL'), 0)::DOUBLE AS sold, round(sum(gross)::DOUBLE / count(*), 6) AS average, max(gross)::DOUBLE AS largest FROM tr GROUP BY ALL")
def trading_activity(spark, sf):
    got = analytics.trading_activity(td.trades(spark, sf))
    return _d(got.withColumn("average", (F.col("bought") + F.col("sold")).cast("double") / (F.col("buys") + F.col("sells"))))


@query("SELECT account_id, security_id, n_trades FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY n_trades DESC, security_id) AS k FROM (SELECT account_id, security_id, count(*) AS n_trades FROM tr GROUP BY ALL)) WHERE k = 1")
def most_traded(spark, sf):
    return analytics.most_traded(td.trades(spark, sf))


@query("SELECT account_id, (date_trunc('week', trade_date) + INTERVAL 6 DAY)::DATE AS period_end, coalesce(sum(amount) FILTER (type = 'DIVIDEND'), 0)::DOUBLE AS dividend, coalesce(sum(amount) FILTER (type = 'DISTRIBUTION'), 0)::DOUBLE AS distribution, coalesce(sum(amount) FILTER (type = 'INTEREST'), 0)::DOUBLE AS interest, sum(amount)::DOUBLE AS gross FROM ca WHERE type IN ('DIVIDEND', 'DISTRIBUTION', 'INTEREST') GROUP BY ALL")
def income_history(spark, sf):
    return _d(analytics.income_history(td.cash_events(spark, sf), "week"))


_TRAILING = f""", {_DAILY}, i AS (SELECT account_id, trade_date, sum(amount) AS i FROM ca WHERE type IN ('DIVIDEND', 'DISTRIBUTION', 'INTEREST') GROUP BY ALL),
    v AS (SELECT da.account_id, da.trade_date, i, CASE WHEN cash > 0 THEN cash END AS cash FROM da LEFT JOIN i ON i.account_id = da.account_id AND i.trade_date = da.trade_date),
    y AS (SELECT account_id, trade_date, coalesce(sum(i) OVER (PARTITION BY account_id ORDER BY trade_date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 0)::DOUBLE AS income, (sum(cash) OVER x)::DOUBLE / count(cash) OVER x AS mean, count(cash) OVER x = count(*) OVER x AS whole FROM v
          WINDOW x AS (PARTITION BY account_id ORDER BY trade_date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW))
    SELECT account_id, trade_date, income, round(0.0000123 + mean, 4) AS average_cash, round(0.0000123 + income / mean, 4) AS yield, CASE WHEN mean IS NULL THEN 'UNAVAILABLE' WHEN whole THEN 'ACTUAL' ELSE 'ESTIMATED' END AS quality FROM y"""


def _valued(cash):
    return ledger.daily_cash(cash).withColumn("cash", F.when(F.col("cash") > 0, F.col("cash")))


@query(_TRAILING)
def trailing_income(spark, sf):
    cash = td.cash_events(spark, sf)
    return _d(analytics.trailing_income(cash, _valued(cash), 7), 4, 0.0000123)


@query(f"{_TRAILING} WHERE dayofweek(trade_date) = 0")
def rolling_income_yield(spark, sf):
    """At the ends of weeks, since the given events span one month."""
    cash = td.cash_events(spark, sf)
    return _d(analytics.trailing_income(cash, _valued(cash), 7, ends="week"), 4, 0.0000123)


_TAXED = "SELECT *, CASE WHEN type <> 'INTEREST' THEN 'S' || event_id % 5 END AS security_id, CASE WHEN type = 'DIVIDEND' AND event_id % 2 = 0 THEN (amount * 100)::BIGINT * 3 // 7 END::DECIMAL(18,2) AS franking, CASE WHEN event_id % 7 = 0 THEN (amount * 100)::BIGINT // 10 END::DECIMAL(18,2) AS withheld FROM ca"


def _taxed(spark, sf):
    e = F.col("event_id")
    return td.cash_events(spark, sf).withColumns({
        "security_id": F.when(F.col("type") != "INTEREST", F.concat(F.lit("S"), e % 5)), "franking": F.when((F.col("type") == "DIVIDEND") & (e % 2 == 0), F.expr("cast(amount * 100 AS bigint) * 3 div 7")).cast("decimal(18,2)"), "withheld": F.when(e % 7 == 0, F.expr("cast(amount * 100 AS bigint) div 10")).cast("decimal(18,2)"),
    })


@query(f"""SELECT account_id, security_id, last_day(trade_date) AS period_end, coalesce(sum(amount) FILTER (type = 'DIVIDEND'), 0)::DOUBLE AS dividend, coalesce(sum(amount) FILTER (type = 'DISTRIBUTION'), 0)::DOUBLE AS distribution, coalesce(sum(amount) FILTER (type = 'INTEREST'), 0)::DOUBLE AS interest,
    sum(amount)::DOUBLE AS gross, coalesce(sum(franking), 0)::DOUBLE AS franking, coalesce(sum(withheld), 0)::DOUBLE AS withheld, (sum(amount) - coalesce(sum(withheld), 0))::DOUBLE AS net FROM ({_TAXED}) WHERE type IN ('DIVIDEND', 'DISTRIBUTION', 'INTEREST') GROUP BY ALL""")
def income_by_security(spark, sf):
    return _d(analytics.income_history(_taxed(spark, sf), "month", "security_id"))


@query(f", {_DAILY} SELECT account_id, 'reached ' || t AS milestone, min(trade_date) AS \"on\" FROM da, (VALUES (100), (500), (1000)) v(t) WHERE cash >= t GROUP BY ALL UNION ALL SELECT account_id, 'all-time high', arg_max(trade_date, (cash, trade_date)) FROM da GROUP BY ALL")
def milestones(spark, sf):
    return analytics.milestones(ledger.daily_cash(td.cash_events(spark, sf)), [100, 500, 1000])


@query("SELECT account_id, min(g)::INTEGER AS finest_gap, count(*) AS dates FROM (SELECT account_id, trade_date - lag(trade_date) OVER (PARTITION BY account_id ORDER BY trade_date) AS g FROM (SELECT DISTINCT account_id, trade_date FROM tr)) GROUP BY ALL")
def finest_gap(spark, sf):
    return analytics.finest_gap(td.trades(spark, sf))


@query(f", {_UNITS} SELECT account_id, security_id, event_id, (units - sold)::DOUBLE AS excess, 'OVERSOLD' AS code FROM h WHERE type = 'SELL' AND units > sold")
def check_oversold(spark, sf):
    return quality.check_oversold(ledger.running_units(td.trades(spark, sf)))


@query("SELECT event_id, field, value::DOUBLE AS value, 'NEGATIVE' AS code FROM (SELECT event_id, unnest(['units', 'gross', 'fees']) AS field, unnest([units::DOUBLE, (gross - 1000)::DOUBLE, fees::DOUBLE]) AS value FROM tr) WHERE value < 0")
def check_signs(spark, sf):
    return quality.check_signs(td.trades(spark, sf).withColumn("gross", F.col("gross") - 1000))


@query("SELECT account_id, security_id, month::DATE AS month FROM (SELECT account_id, security_id, unnest(generate_series(date_trunc('month', min(trade_date)), date_trunc('month', max(trade_date)), INTERVAL 1 MONTH)) AS month FROM tr GROUP BY account_id, security_id) s WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.security_id = s.security_id AND tr.account_id = s.account_id AND date_trunc('month', trade_date) = month)")
def missing_months(spark, sf):
    return quality.missing_months(td.trades(spark, sf), "security_id")


@query("SELECT account_id, left(sha256(string_agg(h, '' ORDER BY trade_date)), 16) AS fingerprint FROM (SELECT account_id, trade_date, sha256(string_agg(event_id, '' ORDER BY event_id)) AS h FROM tr GROUP BY ALL) GROUP BY ALL")
def ledger_fingerprint(spark, sf):
    return quality.ledger_fingerprint(td.trades(spark, sf))


@query("SELECT event_id, account_id, (CASE WHEN account_id % 2 = 0 THEN gross * 2 ELSE gross END)::DOUBLE AS gross FROM tr WHERE security_id <> 'Brand#1'")
def upsert_and_delete(spark, sf):
    tr = td.trades(spark, sf).select("event_id", "account_id", "security_id", "gross")
    new = tr.where("account_id % 2 = 0").withColumn("gross", (F.col("gross") * 2).cast("decimal(18,2)"))
    return _d(quality.delete_by_ids(quality.upsert(tr, new, "event_id"), tr.where("security_id = 'Brand#1'"), "event_id").select("event_id", "account_id", "gross"))


@query(r"SELECT doc_id, len(r)::INTEGER AS n_runs, list_max(list_transform(r, lambda x: length(x)))::INTEGER AS longest, regexp_matches(regexp_replace(text, '\b\d{1,2}-(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)-\d{4}\b', '', 'g'), '\d{4,}') AS identifier FROM (SELECT doc_id, text, regexp_extract_all(text, '\b\d{6,}\b') AS r FROM documents) WHERE len(r) > 0")
def scan_pii(spark, sf):
    return quality.scan_pii(td.table(spark, sf, "documents"), "doc_id", "text")


_DATE = r"\b\d{1,2}-(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)-\d{4}\b"


@query(rf"SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '(?s){_DATE}|\d{{4,}}|.'), lambda x: CASE WHEN regexp_full_match(x, '\d{{4,}}') THEN repeat('#', length(x)) ELSE x END), '')) AS redacted_md5 FROM documents WHERE regexp_matches(regexp_replace(text, '{_DATE}', '', 'g'), '\d{{4,}}')")
def redact_documents(spark, sf):
    return quality.redacted(td.table(spark, sf, "documents"), "doc_id", "text")


_TWO = "SELECT *, (hash_of % 7) AS z FROM (SELECT *, (units::BIGINT * 31 + (gross * 100)::BIGINT) AS hash_of FROM tr)"


def _two_sources(spark, sf, stored=False):
    """The trades, and a copy with some rows left out, some a day or two later, some a cent higher."""
    one = td.stored_trades(spark, sf) if stored else td.trades(spark, sf)
    z = (F.col("units").cast("long") * 31 + (F.col("gross") * 100).cast("long")) % 7
    other = one.withColumn("z", z).where("z <> 0").withColumn("trade_date", F.date_add("trade_date", F.when(F.col("z") == 1, 2).when(F.col("z") == 2, 9).otherwise(0)))
    return one, other.withColumn("gross", (F.col("gross") + F.when(F.col("z") == 3, F.lit("0.01").cast("decimal(3,2)")).otherwise(0)).cast("decimal(18,2)")).withColumn("event_id", F.concat(F.lit("x"), "event_id")).drop("z")


@query(f""", o AS (SELECT 'x' || event_id AS event_id, account_id, security_id, type, (trade_date + CASE z WHEN 1 THEN 2 WHEN 2 THEN 9 ELSE 0 END)::DATE AS trade_date, (gross * 100)::BIGINT + CASE WHEN z = 3 THEN 1 ELSE 0 END AS c FROM ({_TWO}) WHERE z <> 0),
    p AS (SELECT a.event_id AS id1, o.event_id AS id2, (a.gross * 100)::BIGINT AS c1, o.c AS c2, (o.trade_date - a.trade_date)::INTEGER AS days, count(*) OVER (PARTITION BY a.event_id) AS n1, count(*) OVER (PARTITION BY o.event_id) AS n2
          FROM tr a JOIN o ON a.account_id = o.account_id AND a.security_id = o.security_id AND a.type = o.type AND abs((a.gross * 100)::BIGINT - o.c) <= 1 AND abs(o.trade_date - a.trade_date) <= 5),
    g AS (SELECT id1, max(greatest(n1, n2)) AS n, max(id2) AS id2, max(days) AS days, max(CASE WHEN c1 <> c2 OR days <> 0 THEN 1 ELSE 0 END) AS minor FROM p GROUP BY id1)
    SELECT event_id AS id1, CASE WHEN n IS NULL THEN 'UNMATCHED_INVESTMENT' WHEN n > 1 THEN 'AMBIGUOUS' WHEN minor = 1 THEN 'MATCH_WITH_MINOR_DIFFERENCE' ELSE 'MATCH' END AS status, CASE WHEN n = 1 THEN id2 END AS id2, CASE WHEN n = 1 THEN days END AS days FROM tr LEFT JOIN g ON event_id = id1
    UNION ALL SELECT NULL, 'UNMATCHED_CASH', event_id, NULL FROM o WHERE event_id NOT IN (SELECT id2 FROM p)""")
def match_trades(spark, sf):
    return matching.match_trades(*_two_sources(spark, sf))


_PAIRS = f""", tt AS (SELECT account_id, event_id, trade_date, round(100 * CASE WHEN type = 'SELL' THEN gross - fees ELSE -(gross + fees) END)::BIGINT AS c, 1 AS side FROM tr),
    o AS (SELECT account_id, 'x' || event_id AS event_id, (trade_date + CASE z WHEN 1 THEN 2 WHEN 2 THEN 9 ELSE 0 END)::DATE AS trade_date,
          round(100 * CASE WHEN type = 'SELL' THEN g - fees ELSE -(g + fees) END)::BIGINT AS c, 2 AS side FROM (SELECT *, gross + CASE WHEN z = 3 THEN 0.01 ELSE 0 END AS g FROM ({_TWO}) WHERE z <> 0)),
    bo AS (SELECT * FROM tt UNION ALL SELECT * FROM o), sp AS (SELECT *, c - lag(c) OVER (PARTITION BY account_id ORDER BY c) > 1 AS gap FROM (SELECT DISTINCT account_id, c FROM bo)),
    bl AS (SELECT account_id, c, coalesce(sum(gap::INTEGER) OVER (PARTITION BY account_id ORDER BY c), 0) AS block FROM sp),
    lf AS (SELECT account_id, event_id, trade_date, c, block, row_number() OVER (PARTITION BY account_id, block ORDER BY trade_date, event_id) AS k FROM tt JOIN bl USING (account_id, c)),
    cd AS MATERIALIZED (SELECT l.account_id, l.block, l.k, l.event_id AS trade_id, l.trade_date AS traded, o.event_id AS transfer_id, o.trade_date AS settled, o.trade_date - l.trade_date AS days
           FROM lf l JOIN o ON o.account_id = l.account_id AND o.c IN (l.c - 1, l.c, l.c + 1) AND o.trade_date >= l.trade_date),
    st AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY account_id, block ORDER BY k) AS n FROM cd),
    g(account_id, block, n, used, k, best) AS (SELECT DISTINCT account_id, block, 0::BIGINT, []::VARCHAR[], 0::BIGINT, NULL::VARCHAR FROM st
        UNION ALL SELECT account_id, block, n, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, k, best FROM (
            SELECT st.account_id, st.block, st.n, g.used, st.k, arg_min(st.transfer_id, (st.days, st.transfer_id)) FILTER (NOT list_contains(g.used, st.transfer_id)) AS best
            FROM g JOIN st ON st.account_id = g.account_id AND st.block = g.block AND st.n = g.n + 1 GROUP BY ALL))"""
_PAIRED = "SELECT cd.account_id, trade_id, traded, transfer_id, settled, days::INTEGER AS days_to_cash FROM g JOIN cd ON cd.account_id = g.account_id AND cd.block = g.block AND cd.k = g.k AND cd.transfer_id = g.best"


@query(f"{_PAIRS} {_PAIRED}")
def settlement_pairs(spark, sf):
    one, other = _two_sources(spark, sf)
    net = F.when(F.col("type") == "SELL", F.col("gross") - F.col("fees")).otherwise(-(F.col("gross") + F.col("fees")))
    return matching.pair_settlements(one, other.select("account_id", "event_id", "trade_date", net.alias("amount"))).drop("block")


@query("SELECT account_id, min(trade_date) AS rebuild_from, count(*) AS late FROM tr WHERE units > 40 AND account_id % 3 <> 0 GROUP BY ALL")
def rebuild_boundary(spark, sf):
    """A wider export of the accounts of two thirds: rows of over 40 units are new to the store."""
    tr = td.trades(spark, sf).where("account_id % 3 <> 0")
    return staging.rebuild_boundary(tr.where("units <= 40"), tr)


@query(f""", o AS (SELECT event_id, concat_ws('|', account_id, security_id, trade_date) AS slot FROM tr WHERE account_id % 3 <> 0), n AS (SELECT CASE WHEN units > 40 THEN 'n' ELSE '' END || event_id AS event_id, concat_ws('|', account_id, security_id, trade_date) AS slot FROM tr)
    SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM o) THEN 'UNCHANGED' WHEN slot IN (SELECT slot FROM o) THEN 'SOURCE_CHANGED' ELSE 'ADDED' END AS status FROM n""")
def stage_events(spark, sf):
    tr = td.trades(spark, sf).withColumn("slot", F.concat_ws("|", "account_id", "security_id", "trade_date"))
    new = tr.withColumn("event_id", F.concat(F.when(F.col("units") > 40, "n").otherwise(""), "event_id"))
    return staging.stage(tr.where("account_id % 3 <> 0").select("event_id", "slot"), new.select("event_id", "slot")).select("event_id", "status")


def _returns(spark, sf):
    tr = td.trades(spark, sf)
    return quarterly_returns(tr, td.prices(tr))


_QE = "last_day(date_trunc('quarter', {0}) + INTERVAL 2 MONTH)"
_RETURNS = f"""{_UNITS}, {_PRICES}, la AS (SELECT account_id, security_id, {_QE.format("trade_date")} AS period_end, arg_max(held, (trade_date, type, event_id)) AS held FROM h GROUP BY ALL),
    qs AS (SELECT last_day(q + INTERVAL 2 MONTH) AS period_end, (q - INTERVAL 1 DAY)::DATE AS period_start FROM (SELECT unnest(generate_series(date_trunc('quarter', min(trade_date)), date_trunc('quarter', max(trade_date)), INTERVAL 3 MONTH)) AS q FROM tr)),
    un AS (SELECT g.account_id, g.security_id, qs.period_end, coalesce(last_value(la.held IGNORE NULLS) OVER (PARTITION BY g.account_id, g.security_id ORDER BY qs.period_end), 0) AS held
           FROM (SELECT DISTINCT account_id, security_id FROM la) g CROSS JOIN qs LEFT JOIN la ON la.account_id = g.account_id AND la.security_id = g.security_id AND la.period_end = qs.period_end),
    pq AS (SELECT s.security_id, qs.period_end, last_value(p.price IGNORE NULLS) OVER (PARTITION BY s.security_id ORDER BY qs.period_end) AS price FROM (SELECT DISTINCT security_id FROM pr) s CROSS JOIN qs
           LEFT JOIN (SELECT security_id, {_QE.format("price_date")} AS period_end, arg_max(price, price_date) AS price FROM pr GROUP BY ALL) p ON p.security_id = s.security_id AND p.period_end = qs.period_end),
    va AS (SELECT account_id, un.period_end, sum(CASE WHEN held <> 0 THEN held::DOUBLE * price ELSE 0 END) AS end_value FROM un JOIN pq ON pq.security_id = un.security_id AND pq.period_end = un.period_end GROUP BY ALL),
    fl AS (SELECT account_id, {_QE.format("trade_date")} AS period_end, trade_date, CASE WHEN type = 'BUY' THEN gross::DOUBLE ELSE -gross::DOUBLE * sold::DOUBLE / units::DOUBLE END AS amount FROM h),
    fs AS (SELECT account_id, fl.period_end, sum(amount) AS flow, sum(amount * (fl.period_end - trade_date) / (fl.period_end - period_start)) AS weighted FROM fl JOIN qs ON qs.period_end = fl.period_end GROUP BY ALL),
    qr AS (SELECT account_id, period_end, period_start, begin_value, end_value, flow, CASE WHEN begin_value + weighted > 0 THEN (end_value - begin_value - flow) / (begin_value + weighted) END AS r
           FROM (SELECT va.account_id, va.period_end, period_start, coalesce(lag(end_value) OVER (PARTITION BY va.account_id ORDER BY va.period_end), 0) AS begin_value, end_value, coalesce(flow, 0) AS flow, coalesce(weighted, 0) AS weighted
                 FROM va JOIN qs ON qs.period_end = va.period_end LEFT JOIN fs ON fs.account_id = va.account_id AND fs.period_end = va.period_end)),
    ix AS (SELECT *, 100 * product(coalesce(1 + r, 1)) OVER w AS index FROM qr WINDOW w AS (PARTITION BY account_id ORDER BY period_end)),
    hi AS (SELECT *, greatest(100, max(index) OVER (PARTITION BY account_id ORDER BY period_end)) AS high FROM ix)"""


@query(f", {_RETURNS} SELECT account_id, period_end, period_start, round(0.0000123 + begin_value, 3) AS begin_value, round(0.0000123 + end_value, 3) AS end_value, round(0.0000123 + flow, 3) AS flow, round(r, 6) + 0.0::DOUBLE AS r FROM qr")
def quarterly_returns_query(spark, sf):
    money = lambda c: F.round(F.col(c) + 0.0000123, 3).alias(c)
    return _returns(spark, sf).select("account_id", "period_end", "period_start", money("begin_value"), money("end_value"), money("flow"), F.round("r", 6).alias("r"))


@query(f", {_RETURNS} SELECT account_id, period_end, round(0.0000123 + index, 4) AS index, round(0.0000123 + high, 4) AS high, round(0.0000123 + index / high - 1, 4) AS drawdown FROM hi")
def return_index(spark, sf):
    return _d(performance.return_index(_returns(spark, sf)).select("account_id", "period_end", "index", "high", "drawdown"), 4, 0.0000123)


@query(f", {_RETURNS} SELECT account_id, period_end, round(0.0000123 + index, 4) AS index, round(0.0000123 + high, 4) AS high, round(0.0000123 + index / high - 1, 4) AS drawdown FROM hi")
def extended_index(spark, sf):
    """The return index, built anew from the end of 1996 on what is stored before."""
    returns = _returns(spark, sf)
    stored = performance.return_index(returns.where("period_end <= DATE '1996-12-31'")).select("account_id", "period_end", "index", "high", "drawdown")
    later = performance.extended_index(stored, returns.where("period_end > DATE '1996-12-31'")).select(stored.columns)
    return _d(stored.unionByName(later), 4, 0.0000123)


_EPISODES = f"""{_RETURNS}, ep0 AS (SELECT account_id, period_end, index, max(index) OVER (PARTITION BY account_id ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ix),
    ep1 AS (SELECT *, top IS NULL OR index >= top AS touch FROM ep0), ep2 AS (SELECT *, sum(touch::INTEGER) OVER (PARTITION BY account_id ORDER BY period_end) AS segment FROM ep1),
    ep3 AS (SELECT account_id, segment, min(period_end) FILTER (touch) AS touched, min(index) FILTER (touch) AS level, min(top) FILTER (touch) AS top, min(index) FILTER (NOT touch) AS low, arg_min(period_end, (index, period_end)) FILTER (NOT touch) AS trough FROM ep2 GROUP BY ALL),
    ep4 AS (SELECT *, coalesce(1 - low / level >= 0.05, false) AS deep FROM ep3),
    ep5 AS (SELECT *, top IS NULL OR level > top OR coalesce(lag(deep) OVER (PARTITION BY account_id ORDER BY segment), false) AS anchor, lead(touched) OVER (PARTITION BY account_id ORDER BY segment) AS recovery FROM ep4),
    ep AS (SELECT *, last_value(CASE WHEN anchor THEN touched END IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY segment) AS peak FROM ep5)"""


@query(f", {_EPISODES} SELECT account_id, peak, trough, recovery, round(0.0000123 + low / level - 1, 4) AS depth, (recovery - trough)::INTEGER AS recovery_days FROM ep WHERE deep")
def drawdown_episodes(spark, sf):
    return _d(performance.drawdown_episodes(performance.return_index(_returns(spark, sf))), 4, 0.0000123)


@query(f", {_EPISODES} SELECT account_id, round(0.0000123 + min(depth), 4) AS worst, round(0.0000123 + avg(depth), 4) AS average, count(*) AS episodes, max(recovery - peak)::INTEGER AS longest_days, min(recovery - trough)::INTEGER AS fastest_days FROM (SELECT *, low / level - 1 AS depth FROM ep WHERE deep) GROUP BY ALL")
def drawdown_analytics(spark, sf):
    got = history.drawdown_analytics(performance.drawdown_episodes(performance.return_index(_returns(spark, sf))))
    return _d(got, 4, 0.0000123)


@query(f""", {_RETURNS}, a AS (SELECT account_id, count(r) AS observations, stddev_samp(r) AS s, stddev_samp(r) FILTER (r < 0) AS d, product(1 + r) AS p FROM qr WHERE r IS NOT NULL GROUP BY ALL),
    b AS (SELECT *, CASE WHEN observations >= 6 AND p > 0 THEN pow(p, 4.0 / observations) - 1 END AS annualised FROM a)
    SELECT account_id, observations, round(0.0000123 + CASE WHEN observations >= 6 THEN 2 * s END, 4) AS volatility, round(0.0000123 + annualised, 4) AS annualised, round(0.0000123 + annualised / nullif(2 * s, 0), 4) AS sharpe, round(0.0000123 + annualised / nullif(2 * d, 0), 4) AS sortino,
           CASE WHEN observations >= 24 THEN 'HIGH' WHEN observations >= 12 THEN 'MEDIUM' WHEN observations >= 6 THEN 'LOW' ELSE 'NONE' END AS confidence FROM b""")
def risk_summary(spark, sf):
    return _d(performance.risk_summary(_returns(spark, sf)), 4, 0.0000123)


@query(f", {_RETURNS} SELECT account_id, period_end, round(0.0000123 + 2 * s, 4) AS volatility FROM (SELECT account_id, period_end, stddev_samp(r) OVER w AS s, count(*) OVER w AS n FROM qr WHERE r IS NOT NULL WINDOW w AS (PARTITION BY account_id ORDER BY period_end ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) WHERE n = 8")
def rolling_volatility(spark, sf):
    return _d(performance.rolling_volatility(_returns(spark, sf)), 4, 0.0000123)


@query(f", {_RETURNS} SELECT account_id, arg_max(period_end, (r, -(period_end - DATE '1970-01-01'))) AS best, round(0.0000123 + max(r), 4) AS best_return, arg_min(period_end, (r, period_end)) AS worst, round(0.0000123 + min(r), 4) AS worst_return FROM qr WHERE r IS NOT NULL GROUP BY ALL")
def best_worst(spark, sf):
    return _d(analytics.best_worst(_returns(spark, sf)), 4, 0.0000123)


@query(""", f0 AS (SELECT account_id, trade_date, sum(-amount)::DOUBLE AS amount FROM ca WHERE type IN ('DEPOSIT', 'WITHDRAWAL') GROUP BY ALL),
    f AS MATERIALIZED (SELECT account_id, amount, (trade_date - min(trade_date) OVER (PARTITION BY account_id)) / 365.0::DOUBLE AS years FROM f0),
    w AS MATERIALIZED (SELECT account_id, min(amount) < 0 AND max(amount) > 0 AND sign(sum(amount * pow(0.0001, -years))) * sign(sum(amount * pow(11.0, -years))) < 0 AS ok, sign(sum(amount * pow(0.0001, -years))) AS s FROM f GROUP BY ALL),
    b(account_id, s, low, high, k, answer) AS (SELECT account_id, s, -0.9999::DOUBLE, 10.0::DOUBLE, 0, NULL::DOUBLE FROM w WHERE ok
        UNION ALL SELECT account_id, s, CASE WHEN sign(v) = s THEN mid ELSE low END, CASE WHEN sign(v) = s THEN high ELSE mid END, k + 1, CASE WHEN abs(v) < 1e-9 OR k = 199 THEN mid END FROM (
            SELECT b.account_id, b.s, b.low, b.high, b.k, (b.low + b.high) / 2 AS mid, sum(f.amount * pow(1 + (b.low + b.high) / 2, -f.years)) AS v FROM b JOIN f ON f.account_id = b.account_id WHERE b.answer IS NULL AND b.k < 200 GROUP BY ALL))
    SELECT w.account_id, round(answer, 6) AS xirr FROM w LEFT JOIN (SELECT * FROM b WHERE answer IS NOT NULL) b ON b.account_id = w.account_id""")
def xirr(spark, sf):
    cash = td.cash_events(spark, sf).where("type IN ('DEPOSIT', 'WITHDRAWAL')").select("account_id", F.col("trade_date").alias("date"), (-F.col("amount")).alias("amount"))
    return _d(performance.xirr(cash, "account_id"))


@query(r"SELECT user_id AS account_id, event_id, value AS parsed, left(sha256('EVENT|' || user_id || '|' || event_type || '|'), 16) AS id FROM events")
def parse_amounts(spark, sf):
    ev = td.table(spark, sf, "events")
    shown = F.concat(F.lit("$ "), F.format_number("value", 2))
    return ev.select(F.col("user_id").alias("account_id"), "event_id", t.parse_decimal(shown).cast("double").alias("parsed"), t.make_id("EVENT", F.col("user_id"), F.col("event_type"), F.lit(None)).alias("id"))
