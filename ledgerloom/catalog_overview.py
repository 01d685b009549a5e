"""Registered queries of windows with money-weighted returns, income summaries and reported figures, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.catalog import _DAILY, _TAXED, _d, _taxed, query
from ledgerloom.operators import income, ledger, overview
from ledgerloom.operators.periods import STANDARD_DAYS
from ledgerloom.sources import testdata as td
from ledgerloom.streaming import histories


def _r(x: str, places: int = 6) -> str:
    """Rounded as _d does it, halves off the border."""
    return f"round(0.0000000123 + {x}, {places})"


#: A daily series out of cash balances: valued on each fifth day, with days that have no value.
_SERIES = f"""{_DAILY}, dl AS (SELECT account_id, trade_date AS t, CASE WHEN cash > 0 THEN cash::DOUBLE END AS value, CASE WHEN z IS NOT NULL THEN 100 + cumulative_income::DOUBLE / 1000 END AS index, z, cumulative_income::DOUBLE AS income, cumulative_fees::DOUBLE AS fees, CASE WHEN z = trade_date THEN 'ACTUAL' ELSE 'CALCULATED' END AS status
           FROM (SELECT *, max(CASE WHEN day(trade_date) % 5 = 0 THEN trade_date END) OVER (PARTITION BY account_id ORDER BY trade_date) AS z FROM da)),
    fl AS (SELECT account_id, trade_date AS t, sum(amount)::DOUBLE AS a FROM ca WHERE type IN ('DEPOSIT', 'WITHDRAWAL') GROUP BY ALL)"""


def _series(spark, sf):
    cash = td.cash_events(spark, sf)
    z = F.max(F.when(F.day("trade_date") % 5 == 0, F.col("trade_date"))).over(W.partitionBy("account_id").orderBy("trade_date"))
    own = ledger.daily_cash(cash).withColumn("index_as_at", z)
    daily = own.select(
        "account_id", F.col("trade_date").alias("on"), F.when(F.col("cash") > 0, F.col("cash").cast("double")).alias("value"), F.when(F.col("index_as_at").isNotNull(), 100 + F.col("cumulative_income").cast("double") / 1000).alias("index"), "index_as_at",
        F.col("cumulative_income").cast("double").alias("income"), F.col("cumulative_fees").cast("double").alias("fees"), F.when(F.col("index_as_at") == F.col("trade_date"), "ACTUAL").otherwise("CALCULATED").alias("status"),
    )
    return daily, cash.where("type IN ('DEPOSIT', 'WITHDRAWAL')").select("account_id", F.col("trade_date").alias("date"), "amount")


def _solved(points: str) -> str:
    """Steps that bisect (k, t, a), dated amounts by key: xr has (k, xirr)."""
    worth = "sum(f.a * pow(1 + {0}, -f.y))"
    return f"""xp AS MATERIALIZED (SELECT k, a, (t - min(t) OVER (PARTITION BY k)) / 365.0::DOUBLE AS y FROM ({points})),
    xs AS MATERIALIZED (SELECT k, sign({worth.format("-0.9999")}) AS s FROM xp f GROUP BY k HAVING min(a) < 0 AND max(a) > 0 AND sign({worth.format("-0.9999")}) * sign({worth.format("10.0")}) < 0),
    xb(k, s, low, high, n, answer) AS (SELECT k, s, -0.9999::DOUBLE, 10.0::DOUBLE, 0, NULL::DOUBLE FROM xs
        UNION ALL SELECT k, s, CASE WHEN sign(v) = s THEN mid ELSE low END, CASE WHEN sign(v) = s THEN high ELSE mid END, n + 1, CASE WHEN abs(v) < 1e-9 OR n = 199 THEN mid END FROM (
            SELECT b.k, b.s, b.low, b.high, b.n, (b.low + b.high) / 2 AS mid, {worth.format("(b.low + b.high) / 2")} AS v FROM xb b JOIN xp f ON f.k = b.k WHERE b.answer IS NULL AND b.n < 200 GROUP BY ALL)),
    xr AS (SELECT k, answer AS xirr FROM xb WHERE answer IS NOT NULL)"""


def _window_sql(anchor: str, closing: str) -> str:
    """Steps from windows wn (account_id, label, start, as_at): mz has what window_performance measures."""
    return f"""an AS (SELECT wn.account_id, label, start, as_at, greatest(as_at - start, 1) AS asked, greatest(7, greatest(as_at - start, 1) // 10) AS tol, min(t) AS first, min(t) FILTER (t >= start) AS nxt, min(t) FILTER (index IS NOT NULL) AS priced,
           arg_min(t, (abs(t - start), t)) FILTER (z = t) AS near, max(t) FILTER (t <= start AND value IS NOT NULL) AS w1, min(t) FILTER (t >= start AND value IS NOT NULL) AS w2, max(t) FILTER (t <= as_at) AS e0 FROM wn JOIN dl ON dl.account_id = wn.account_id GROUP BY ALL),
    ac AS (SELECT *, {anchor} AS so, {closing} AS eo FROM an),
    mw AS (SELECT ac.*, ac.account_id || '|' || label AS k, s.value AS opening, e.value AS closing, e.income - s.income AS income, e.fees - s.fees AS fees, s.index AS i1, e.index AS i2, s.z AS z1, e.z AS z2, e.status AS es,
           coalesce((SELECT sum(a) FROM fl WHERE fl.account_id = ac.account_id AND fl.t > so AND fl.t <= as_at), 0) AS flow, coalesce((SELECT sum(a * CASE WHEN as_at = so THEN 1.0 ELSE (as_at - fl.t)::DOUBLE / (as_at - so) END) FROM fl WHERE fl.account_id = ac.account_id AND fl.t > so AND fl.t <= as_at), 0) AS weighted
           FROM ac LEFT JOIN dl s ON s.account_id = ac.account_id AND s.t = so LEFT JOIN dl e ON e.account_id = ac.account_id AND e.t = eo),
    {_solved("SELECT k, so AS t, -opening AS a FROM mw WHERE opening <> 0 AND closing IS NOT NULL UNION ALL SELECT k, fl.t, -a FROM mw JOIN fl ON fl.account_id = mw.account_id AND fl.t > so AND fl.t <= as_at WHERE opening IS NOT NULL AND closing IS NOT NULL UNION ALL SELECT k, as_at, closing FROM mw WHERE opening IS NOT NULL AND closing IS NOT NULL")},
    mz AS (SELECT mw.*, xirr, closing - opening - flow AS gain, CASE WHEN opening + weighted > 0 THEN opening + weighted END AS capital, CASE WHEN i1 <> 0 AND i2 <> 0 THEN i2 / i1 - 1 END AS twrr FROM mw LEFT JOIN xr ON xr.k = mw.k)"""


def _figures(when: str) -> str:
    of = {"opening": "opening", "closing": "closing", "flow": "flow", "gain": "gain", "income": "income", "fees": "fees", "total_return": "gain / capital", "capital_return": "(gain - income + fees) / capital", "income_return": "income / capital", "twrr": "twrr", "xirr": "xirr"}
    return ", ".join(f"CASE WHEN {when} THEN {_r(x)} END AS {n}" for n, x in of.items())


_DAYS = ", ".join(f"('{k}', {'NULL' if d is None else d})" for k, d in STANDARD_DAYS.items())
_STANDARD = f"""{_SERIES}, wn AS (SELECT account_id, label, CASE label WHEN 'INCEPTION' THEN f WHEN 'YTD' THEN greatest(date_trunc('year', e)::DATE, f) ELSE e - n END AS start, e AS as_at FROM (SELECT account_id, min(t) AS f, max(t) AS e FROM dl GROUP BY ALL), (VALUES {_DAYS}) v(label, n)),
    {_window_sql("CASE WHEN label = 'INCEPTION' THEN coalesce(priced, nxt) WHEN abs(near - start) <= tol THEN near ELSE nxt END", "as_at")},
    rz AS (SELECT *, CASE WHEN start < first THEN 'begins before the first day' WHEN coalesce(z1, so) = coalesce(z2, as_at) THEN 'both ends are one valuation' WHEN coalesce(z2, as_at) - coalesce(z1, so) > asked + tol THEN 'valuations lie too far apart' WHEN opening IS NULL OR closing IS NULL THEN 'no value at an end' END AS reason FROM mz)
    SELECT account_id, label, as_at, CASE WHEN reason IS NULL THEN so END AS measured_from, {_figures("reason IS NULL")}, CASE WHEN reason IS NOT NULL THEN 'UNAVAILABLE' WHEN coalesce(z1, so) = so AND coalesce(z2, as_at) = as_at THEN es ELSE 'ESTIMATED' END AS status, reason FROM rz"""


@query(f", {_STANDARD}")
def standard_returns(spark, sf):
    daily, flows = _series(spark, sf)
    return _d(overview.window_performance(daily, flows, overview.standard_windows(daily)), 6, 0.0000000123)


@query(f""", {_SERIES}, wn AS (SELECT DISTINCT account_id, 'CUSTOM' AS label, DATE '2024-01-08' AS start, DATE '2024-01-24' AS as_at FROM dl), {_window_sql("coalesce(CASE WHEN abs(near - start) <= tol THEN near END, w1, w2)", "CASE WHEN e0 >= start THEN e0 END")}
    SELECT account_id, so AS measured_from, {_figures("eo IS NOT NULL")}, coalesce(es, 'UNAVAILABLE') AS status FROM mz""")
def range_overview(spark, sf):
    daily, flows = _series(spark, sf)
    return _d(overview.range_overview(daily, flows, "2024-01-08", "2024-01-24"), 6, 0.0000000123)


_WEEKS = f"""{_SERIES}, bk AS (SELECT account_id, (date_trunc('week', t) + INTERVAL 6 DAY)::DATE AS period_end, min(t) AS a, max(t) AS z, arg_min(index, t) AS first_index, arg_max(value, t) FILTER (TRUE) AS v0 FROM dl GROUP BY ALL),
    bb AS (SELECT bk.*, lag(z) OVER (PARTITION BY account_id ORDER BY period_end) AS prior FROM bk),
    bm AS (SELECT bb.account_id, bb.period_end, bb.a, bb.z, bb.account_id || '|' || bb.period_end AS k, CASE WHEN prior IS NULL THEN 0 ELSE s.value END AS opening, e.value AS closing, CASE WHEN prior IS NULL THEN bf.index ELSE s.index END AS i1, e.index AS i2,
           coalesce((SELECT sum(fl.a) FROM fl WHERE fl.account_id = bb.account_id AND fl.t >= bb.a AND fl.t <= bb.z), 0) AS flow FROM bb LEFT JOIN dl s ON s.account_id = bb.account_id AND s.t = prior JOIN dl e ON e.account_id = bb.account_id AND e.t = bb.z JOIN dl bf ON bf.account_id = bb.account_id AND bf.t = bb.a),
    {_solved("SELECT k, a AS t, -opening AS a FROM bm WHERE opening <> 0 AND closing IS NOT NULL UNION ALL SELECT k, fl.t, -fl.a FROM bm JOIN fl ON fl.account_id = bm.account_id AND fl.t >= bm.a AND fl.t <= bm.z WHERE opening IS NOT NULL AND closing IS NOT NULL UNION ALL SELECT k, z, closing FROM bm WHERE opening IS NOT NULL AND closing IS NOT NULL")}
    SELECT account_id, period_end, {_r("opening")} AS opening, {_r("closing")} AS closing, {_r("flow")} AS flow, {_r("closing - opening - flow")} AS gain, CASE WHEN i1 <> 0 AND i2 <> 0 THEN {_r("i2 / i1 - 1")} END AS twrr, {_r("xirr")} AS xirr FROM bm LEFT JOIN xr ON xr.k = bm.k"""


@query(f", {_WEEKS}")
def bucket_returns(spark, sf):
    daily, flows = _series(spark, sf)
    return _d(overview.bucket_returns(daily, flows, "week").select("account_id", "period_end", "opening", "closing", "flow", "gain", "twrr", "xirr"), 6, 0.0000000123)


@query(f""", tx AS ({_TAXED}), p AS (SELECT account_id, sum(amount) AS paid, sum(withheld) AS withheld, sum(franking) AS df FROM tx WHERE type IN ('DIVIDEND', 'DISTRIBUTION') GROUP BY ALL),
    i AS (SELECT account_id, sum(amount) AS interest FROM tx WHERE type = 'INTEREST' GROUP BY ALL), y AS (SELECT account_id, sum((amount * 100)::BIGINT // 8) / 100 AS tf FROM tx WHERE type = 'DISTRIBUTION' AND account_id % 3 = 0 GROUP BY ALL),
    s AS (SELECT account_id, coalesce(sum(paid), 0)::DOUBLE AS paid, coalesce(sum(interest), 0)::DOUBLE AS interest, coalesce(sum(withheld), 0)::DOUBLE AS withheld, coalesce(sum(df), 0)::DOUBLE AS df, coalesce(sum(tf), 0)::DOUBLE AS tf FROM (SELECT account_id, paid, withheld, df, NULL AS interest, NULL AS tf FROM p UNION ALL SELECT account_id, NULL, NULL, NULL, interest, NULL FROM i UNION ALL SELECT account_id, NULL, NULL, NULL, NULL, tf FROM y) GROUP BY ALL)
    SELECT account_id, round(paid + interest, 6) AS gross, interest, withheld, round(paid + interest - withheld, 6) AS net, df AS dividend_franking, tf AS trust_franking, round(df + tf, 6) AS franking, round(paid + interest + df + tf, 6) AS grossed_up, df + tf > 0 AS franking_available FROM s""")
def income_summary(spark, sf):
    taxed = _taxed(spark, sf)
    trust = taxed.where("type = 'DISTRIBUTION' AND account_id % 3 = 0").select("account_id", (F.expr("cast(amount * 100 AS bigint) div 8") / 100).cast("decimal(18,2)").alias("franking"))
    return _d(income.income_summary(taxed.where("type IN ('DIVIDEND', 'DISTRIBUTION')"), taxed.where("type = 'INTEREST'"), trust))


@query(f""", {_DAILY}, op AS (SELECT account_id, coalesce(arg_min(cash, trade_date) FILTER (event_day % 3 = 0), 0) AS o FROM (SELECT *, day(trade_date) AS event_day FROM da) GROUP BY ALL)
    SELECT da.account_id, trade_date, o::DOUBLE AS opening_cash, (cash + o)::DOUBLE AS cash FROM da JOIN op ON op.account_id = da.account_id""")
def opening_cash(spark, sf):
    """Balances that start at what the first statement opens with; statements are days, of which each third states it."""
    cash = td.cash_events(spark, sf)
    daily = ledger.daily_cash(cash)
    first = ledger.opening_cash(daily.select("account_id", F.col("trade_date").alias("period_start"), F.when(F.day("trade_date") % 3 == 0, F.col("cash")).alias("opening_cash")))
    return _d(ledger.daily_cash(cash, first).join(first, "account_id").select("account_id", "trade_date", "opening_cash", "cash"))


_CHECKS = f"""{_DAILY}, st AS (SELECT account_id, trade_date AS t, CASE WHEN day(trade_date) % 11 <> 0 THEN (cash + cumulative_income)::DOUBLE END AS value, cash::DOUBLE AS cash FROM da),
    su AS (SELECT account_id, trade_date AS t, 'S' || event_id % 3 AS s, sum(amount)::DOUBLE AS u FROM ca GROUP BY ALL),
    re AS (SELECT account_id, t, CASE WHEN account_id % 7 = 0 THEN NULL ELSE value + CASE WHEN account_id % 5 = 0 THEN 1 ELSE 0 END END AS value, CASE WHEN account_id % 3 <> 0 THEN cash + CASE WHEN day(t) % 4 = 0 THEN 0.04 ELSE 0 END END AS cash, CASE WHEN account_id % 2 = 0 THEN 0.5 END AS accrued FROM st WHERE day(t) % 2 = 0),
    ru AS (SELECT account_id, t, CASE WHEN s = 'S2' AND account_id % 4 = 0 THEN 'S9' ELSE s END AS s, u FROM su WHERE NOT (s = 'S1' AND account_id % 6 = 0)),
    ck AS (SELECT re.account_id, re.t, 'value' AS what, NULL::VARCHAR AS s, re.value AS r, st.value + coalesce(accrued, 0) AS c FROM re LEFT JOIN st ON st.account_id = re.account_id AND st.t = re.t UNION ALL SELECT re.account_id, re.t, 'cash', NULL, re.cash, st.cash FROM re LEFT JOIN st ON st.account_id = re.account_id AND st.t = re.t WHERE re.cash IS NOT NULL
           UNION ALL SELECT coalesce(a.account_id, b.account_id), coalesce(a.t, b.t), 'units', coalesce(a.s, b.s), coalesce(a.u, 0), coalesce(b.u, 0) FROM ru a FULL JOIN su b ON a.account_id = b.account_id AND a.t = b.t AND a.s = b.s WHERE day(coalesce(a.t, b.t)) % 2 = 0),
    cs AS (SELECT *, round(c - r, 6) AS difference, CASE WHEN c - r IS NULL THEN 'SKIP' WHEN abs(round(c - r, 6)) <= 0.05 THEN 'PASS' ELSE 'FAIL' END AS status FROM ck)"""


def _checks(spark, sf):
    cash = td.cash_events(spark, sf)
    day, account = F.day("on"), F.col("account_id")
    daily = ledger.daily_cash(cash).withColumnRenamed("trade_date", "on")
    states = daily.select("account_id", "on", F.when(day % 11 != 0, (F.col("cash") + F.col("cumulative_income")).cast("double")).alias("value"), F.col("cash").cast("double").alias("cash"))
    units = cash.groupBy("account_id", F.col("trade_date").alias("on"), F.concat(F.lit("S"), F.col("event_id") % 3).alias("security_id")).agg(F.sum("amount").cast("double").alias("units"))
    reported = states.where(day % 2 == 0).select("account_id", "on", F.when(account % 7 != 0, F.col("value") + F.when(account % 5 == 0, 1).otherwise(0)).alias("value"), F.when(account % 3 != 0, F.col("cash") + F.when(day % 4 == 0, 0.04).otherwise(0.0)).alias("cash"), F.when(account % 2 == 0, 0.5).alias("accrued"))
    said = units.where(~((F.col("security_id") == "S1") & (account % 6 == 0))).withColumn("security_id", F.when((F.col("security_id") == "S2") & (account % 4 == 0), "S9").otherwise(F.col("security_id")))
    return income.reported_reconciliation(reported, said, states, units)


@query(f""", {_CHECKS} SELECT account_id, t AS "on", what, s AS security_id, round(r, 6) AS reported, round(c, 6) AS calculated, difference, status FROM cs""")
def reported_reconciliation(spark, sf):
    return _d(_checks(spark, sf))


@query(f", {_CHECKS} SELECT account_id, count(*) AS total, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'SKIP') AS skipped FROM cs GROUP BY ALL")
def reconciliation_counts(spark, sf):
    return income.reconciliation_counts(_checks(spark, sf))


@query(f""", d AS (SELECT account_id, trade_date AS t, sum(amount) AS net, coalesce(sum(amount) FILTER (type IN ('DEPOSIT', 'WITHDRAWAL')), 0) AS ext FROM ca GROUP BY ALL), c AS (SELECT *, sum(net) OVER w AS cash, sum(net) OVER w - net AS prior FROM d WINDOW w AS (PARTITION BY account_id ORDER BY t)),
    i AS (SELECT *, 100 * product(CASE WHEN prior > 0 THEN 1 + (net - ext)::DOUBLE / prior::DOUBLE ELSE 1 END) OVER (PARTITION BY account_id ORDER BY t) AS index FROM c)
    SELECT account_id, t AS "on", (cash * 100)::BIGINT AS cash, greatest(0, (max(cash) OVER w * 100)::BIGINT) AS high, {_r("index")} AS index, {_r("greatest(100, max(index) OVER w)")} AS index_high FROM i WINDOW w AS (PARTITION BY account_id ORDER BY t)""")
def cash_history(spark, sf):
    """What stream_history keeps up by account, built at once; tests hold the stream against it."""
    return _d(histories.cash_history(td.cash_events(spark, sf)), 6, 0.0000000123)
