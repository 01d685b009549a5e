import datetime as dt

import duckdb
import pytest

import __spark_entry__ as e
from ledgerloom.functions.text import quarter_of
from ledgerloom.operators import quality, reconcile
from ledgerloom.sources import exports, ledgers
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
QUERIES = ["ledger_with_codes", "unknown_codes", "with_stored_ids", "unaccounted", "trades_by_quarter", "pii_issues"]


def _key(row):
    return [repr(x) for x in row]


@pytest.mark.parametrize("name", QUERIES)
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in ["part", "orders", "lineitem", "events", "documents"]:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(e.oracle_sql()[name])
    columns = sorted(want.columns)
    got = e.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    mine = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=_key)
    assert mine == sorted(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall(), key=_key)


def test_read_ledger_keeps_rows_without_a_security(spark, tmp_path):
    day = lambda n: dt.date(2024, 1, n)
    rows = [("e1", "S1", day(1), "old"), ("e2", None, day(2), "old"), ("e3", "S9", day(3), "old"), ("e4", "S1", day(4), "old")]
    spark.createDataFrame(rows, "event_id string, security_id string, trade_date date, code string").write.parquet(f"{tmp_path}/t")
    spark.createDataFrame([("S1", "AAA", "First")], "security_id string, code string, name string").write.parquet(f"{tmp_path}/s")
    got = {r.event_id: (r.security_id, r.code, r.name) for r in ledgers.read_ledger(spark, f"{tmp_path}/t", f"{tmp_path}/s", until="2024-01-03").collect()}
    assert got == {"e1": ("S1", "AAA", "First"), "e2": (None, None, None), "e3": ("S9", None, None)}
    later = ledgers.read_ledger(spark, f"{tmp_path}/t", f"{tmp_path}/s", since="2024-01-03")
    assert [r.event_id for r in later.collect()] == ["e4"]
    assert "GreaterThan(trade_date" in later._jdf.queryExecution().toString()


def test_unknown_codes_fail_a_promotion(spark):
    securities = spark.createDataFrame([("S2", "A"), ("S1", "A"), ("S3", None)], "security_id string, code string")
    new = spark.createDataFrame([("e1", "A"), ("e2", None)], "event_id string, security_id string")
    assert {tuple(r) for r in reconcile.with_stored_ids(new, securities).collect()} == {("e1", "S1"), ("e2", None)}
    bad = new.unionByName(spark.createDataFrame([("e3", "Z")], "event_id string, security_id string"))
    assert [tuple(r) for r in reconcile.unknown_codes(bad, securities).collect()] == [("Z", 1)]
    with pytest.raises(Exception, match="unknown security Z"):
        reconcile.with_stored_ids(bad, securities).collect()


def test_every_row_is_accounted_for(spark):
    raw = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "file string, n int")
    exports.assert_accounted(raw, raw.where("n <> 2"), raw.where("n = 2"), "file")
    with pytest.raises(ValueError, match="'file': 'a', 'n_rows': 2, 'n_records': 1"):
        exports.assert_accounted(raw, raw.where("n <> 2"), raw.where("n = 9"), "file")
    assert [r.file for r in exports.unaccounted(raw.where("file = 'b'"), raw, raw.where("n = 9"), "file").collect()] == ["a"]


def test_labels_and_runs_in_free_text_only(spark):
    rows = spark.createDataFrame([(123456789, "BSB: 062-000, Account Number 12345678 and 1234567", None), (2, "12345 is short", "TAX FILE NUMBER"), (3, None, "")], "id long, text string, note string")
    got = sorted((r.row_id, r.field, r.code, r.detail) for r in quality.pii_issues(rows, "id", ["text", "note"]).collect())
    assert got == [("123456789", "text", "PII_DIGITS_PRESENT", "7"), ("123456789", "text", "PII_DIGITS_PRESENT", "8"), ("123456789", "text", "PII_LABEL_PRESENT", "account number"), ("123456789", "text", "PII_LABEL_PRESENT", "bsb:"), ("2", "note", "PII_LABEL_PRESENT", "tax file number")]
    assert {r.code for r in quality.pii_issues(rows, "id", ["text"], []).collect()} == {"PII_DIGITS_PRESENT"}


def test_quarter_of(spark):
    one = spark.createDataFrame([(dt.date(2024, 3, 31),), (dt.date(2024, 4, 1),), (None,)], "d date").select(quarter_of(F.col("d")).alias("q")).collect()
    assert [r.q and tuple(r.q) for r in one] == [(2024, 1), (2024, 2), None]
