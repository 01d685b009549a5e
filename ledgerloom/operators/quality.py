"""Checks that return issue rows, upserts, deletions, fingerprints and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import contains_identifier, redact


def check_signs(trades: DataFrame) -> DataFrame:
    """Negative units, gross or fees, one issue each."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in ("units", "gross", "fees")]))
    return trades.select("event_id", cells.alias("c")).select("event_id", "c.*").where("value < 0").select("event_id", "field", "value", F.lit("NEGATIVE").alias("code"))


def check_oversold(units: DataFrame) -> DataFrame:
    """Sells of more than is held."""
    return units.where("excess > 0").select("account_id", "security_id", "event_id", F.col("excess").cast("double").alias("excess"), F.lit("OVERSOLD").alias("code"))


def scan_pii(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Runs of six or more digits in free text, with the text's identifier flag."""
    runs = F.regexp_extract_all(text_col, F.lit(r"\b\d{6,}\b"), F.lit(0))
    return texts.select(F.col(id_col), runs.alias("runs"), contains_identifier(F.col(text_col)).alias("identifier")).where(F.size("runs") > 0).select(id_col, F.size("runs").alias("n_runs"), F.array_max(F.transform("runs", F.length)).alias("longest"), "identifier")


#: Labels of personal fields, which stored text must not hold.
FORBIDDEN_LABELS = ["investor name", "tax file number", "account number", "bsb:"]


def pii_issues(rows: DataFrame, id_col: str, text_cols: list[str], labels: list[str] = FORBIDDEN_LABELS) -> DataFrame:
    """One issue for each label that a free-text cell holds, whatever its case, and for each run of six or more digits in it.

    (row_id, field, code, detail, severity); detail is the label, or the run's length, never the run. Only ``text_cols`` are
    looked at: a long number elsewhere is an amount, a date or an id. Null cells have no issues.
    """
    cells = rows.select(F.col(id_col).cast("string").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c), F.lit("")).alias("text")) for c in text_cols])).alias("c")).select("row_id", "c.*")
    low = F.lower("text")
    named = [F.when(F.contains(low, F.lit(label)), F.struct(F.lit("PII_LABEL_PRESENT").alias("code"), F.lit(label).alias("detail"))) for label in labels]
    runs = F.transform(F.regexp_extract_all("text", F.lit(r"\b\d{6,}\b"), F.lit(0)), lambda x: F.struct(F.lit("PII_DIGITS_PRESENT").alias("code"), F.length(x).cast("string").alias("detail")))
    found = F.concat(F.array_compact(F.array(*named)), runs) if named else runs
    return cells.select("row_id", "field", F.inline(found)).withColumn("severity", F.lit("ERROR"))


def redacted(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts.where(contains_identifier(F.col(text_col))).select(id_col, F.md5(redact(F.col(text_col))).alias("redacted_md5"))


def upsert(target: DataFrame, updates: DataFrame, *keys: str) -> DataFrame:
    """Insert or replace on keys: updates win; of several rows of one side with a key, the one with the least hash stays."""
    both = target.withColumn("__v", F.lit(0)).unionByName(updates.withColumn("__v", F.lit(1)))
    w = W.partitionBy(*keys).orderBy(F.desc("__v"), F.xxhash64(*target.columns))
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__v")


def delete_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def ledger_fingerprint(trades: DataFrame) -> DataFrame:
    """Per account, a hash of its event ids in ledger order, by way of each day's hash."""
    days = trades.groupBy("account_id", "trade_date").agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("event_id"))), 256).alias("h"))
    whole = F.array_sort(F.collect_list(F.struct("trade_date", "h")))
    return days.groupBy("account_id").agg(F.substring(F.sha2(F.concat_ws("", F.transform(whole, lambda x: x["h"])), 256), 1, 16).alias("fingerprint"))


def missing_months(trades: DataFrame, *keys: str) -> DataFrame:
    """Months between the first and last trade of each account (and of further keys) without any."""
    by, month = ["account_id", *keys], F.trunc("trade_date", "month")
    span = trades.groupBy(*by).agg(F.min(month).alias("a"), F.max(month).alias("b")).select(*by, F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return span.join(trades.select(*by, month.alias("month")).distinct(), [*by, "month"], "left_anti")
