"""Registered queries of stored ledgers: codes, stored ids, accounting of export rows, quarters, personal data; and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog import ORACLE, _d, query
from ledgerloom.catalog_history import parse_cash
from ledgerloom.functions.text import quarter_of
from ledgerloom.operators import quality, reconcile
from ledgerloom.sources import exports, ledgers
from ledgerloom.sources import testdata as td

_SECURITIES = "se AS (SELECT DISTINCT 'S-' || p_brand AS security_id, p_brand AS code, 'Shares of ' || p_brand AS name FROM part WHERE p_brand NOT LIKE 'Brand#5%')"


def _securities(spark, sf):
    """A security for each brand but those of 5x."""
    own = td.table(spark, sf, "part").where("p_brand NOT LIKE 'Brand#5%'")
    return own.select(F.concat(F.lit("S-"), "p_brand").alias("security_id"), F.col("p_brand").alias("code"), F.concat(F.lit("Shares of "), "p_brand").alias("name")).distinct()


@query(f""", {_SECURITIES}, al AS (SELECT event_id, account_id, type, 'S-' || security_id AS security_id FROM tr UNION ALL SELECT event_id::VARCHAR, account_id, type, NULL FROM ca)
    SELECT event_id, account_id, type, al.security_id, code, name FROM al LEFT JOIN se ON se.security_id = al.security_id""")
def ledger_with_codes(spark, sf):
    """Trades and cash rows as one stored ledger, with codes; securities of brands 5x aren't stored."""
    one = td.trades(spark, sf).select("event_id", "account_id", "type", F.concat(F.lit("S-"), "security_id").alias("security_id"))
    two = td.cash_events(spark, sf).select(F.col("event_id").cast("string").alias("event_id"), "account_id", "type", F.lit(None).cast("string").alias("security_id"))
    return ledgers.with_codes(one.unionByName(two), _securities(spark, sf))


@query(f", {_SECURITIES} SELECT security_id AS code, count(*) AS n_rows FROM tr WHERE security_id NOT IN (SELECT code FROM se) GROUP BY ALL")
def unknown_codes(spark, sf):
    return reconcile.unknown_codes(td.trades(spark, sf), _securities(spark, sf))


@query(f", {_SECURITIES} SELECT event_id, account_id, se.security_id FROM tr JOIN se ON code = tr.security_id UNION ALL SELECT event_id::VARCHAR, account_id, NULL FROM ca")
def with_stored_ids(spark, sf):
    """Trades of stored securities and cash rows, as they'd be promoted."""
    one = td.trades(spark, sf).where("security_id NOT LIKE 'Brand#5%'").select("event_id", "account_id", "security_id")
    two = td.cash_events(spark, sf).select(F.col("event_id").cast("string").alias("event_id"), "account_id", F.lit(None).cast("string").alias("security_id"))
    return reconcile.with_stored_ids(one.unionByName(two), _securities(spark, sf))


@query(f""", pc AS ({ORACLE['parse_cash']}), fi AS (SELECT event_id % 40 AS file, count(*) AS n_rows, count(*) FILTER (reason_code IS NULL AND (event_id % 40 >= 10 OR event_id % 3 <> 0)) AS n_records, count(*) FILTER (reason_code IS NOT NULL) AS n_quarantined FROM pc GROUP BY ALL)
    SELECT file, n_rows, n_records, n_quarantined, 'ROWS_UNACCOUNTED' AS code FROM fi WHERE n_rows <> n_records + n_quarantined""")
def unaccounted(spark, sf):
    """Cash rows of forty files, of which ten lost some of their good rows."""
    parsed = parse_cash(spark, sf).withColumn("file", F.col("event_id") % 40)
    good, bad = exports.split_quarantine(parsed)
    return exports.unaccounted(parsed, good.where("file >= 10 OR event_id % 3 <> 0"), bad, "file")


@query("SELECT account_id, year(trade_date)::INTEGER AS year, quarter(trade_date)::INTEGER AS quarter, count(*) AS trades, sum(gross)::DOUBLE AS gross FROM tr GROUP BY ALL")
def trades_by_quarter(spark, sf):
    own = td.trades(spark, sf).groupBy("account_id", quarter_of(F.col("trade_date")).alias("q")).agg(F.count("*").alias("trades"), F.sum("gross").alias("gross"))
    return _d(own.select("account_id", "q.year", "q.quarter", "trades", "gross"))


@query(r""", ce AS (SELECT doc_id::VARCHAR AS row_id, unnest([{'field': 'text', 'text': coalesce(text, '')}, {'field': 'source', 'text': coalesce(source, '')}]) AS c FROM documents),
    cf AS (SELECT row_id, c.field AS field, c.text AS text FROM ce)
    SELECT row_id, field, 'PII_LABEL_PRESENT' AS code, label AS detail, 'ERROR' AS severity FROM cf, (VALUES ('investor name'), ('tax file number'), ('account number'), ('bsb:'), ('email'), ('phone')) v(label) WHERE contains(lower(text), label)
    UNION ALL SELECT row_id, field, 'PII_DIGITS_PRESENT', length(d)::VARCHAR, 'ERROR' FROM (SELECT row_id, field, unnest(regexp_extract_all(text, '\b\d{6,}\b')) AS d FROM cf)""")
def pii_issues(spark, sf):
    """Texts and sources of all documents, by the fixed labels and two more."""
    return quality.pii_issues(td.table(spark, sf, "documents"), "doc_id", ["text", "source"], [*quality.FORBIDDEN_LABELS, "email", "phone"])
