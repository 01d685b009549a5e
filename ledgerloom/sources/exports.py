"""Readers of trade and cash exports, statement lines, and writers of history and datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalise_code, parse_date, parse_decimal

#: Columns of the two exports, and one that is never kept.
INVESTMENT_COLUMNS = ["Investment", "Product ID", "Product Type", "Trade Date", "Type", "Unit Price", "Quantity", "Value", "Brokerage"]
CASH_COLUMNS = ["Date", "Type", "Product Type", "Product Name", "Product ID", "Units", "Total"]
IDENTITY_COLUMN = "account number"

#: Class and expected sign (0: either) of each type of cash row.
CASH_CLASSES = {"deposit": "DEPOSIT", "withdrawal": "WITHDRAWAL", "distribution": "DISTRIBUTION_INCOME", "interest": "INTEREST", "buy": "TRADE_BUY_CASH", "sell": "TRADE_SELL_CASH"}
CASH_SIGNS = {"DEPOSIT": 1, "WITHDRAWAL": -1, "DISTRIBUTION_INCOME": 1, "INTEREST": 0, "ADMIN_FEE": -1, "TRADE_BROKERAGE_CASH": -1, "FEE_REVERSAL": 1, "TRADE_BUY_CASH": -1, "TRADE_SELL_CASH": 1}


def read_export(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV export as strings, without its account numbers; ValueError names the columns it lacks."""
    raw = spark.read.option("header", True).option("multiLine", False).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    if missing := sorted(set(required) - set(raw.columns)):
        raise ValueError(f"columns missing from the export: {missing}")
    return raw.drop(*[c for c in raw.columns if c.lower() == IDENTITY_COLUMN])


def page_lines(pages: DataFrame) -> DataFrame:
    """Trimmed lines of pages (document_id, page, text) that aren't blank, numbered as they stand."""
    each = pages.select("document_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return each.select("document_id", "page", "line_no", F.trim("line").alias("line")).where("line <> ''")


def _fixed(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def parse_investment(raw: DataFrame, review_blank: bool = False) -> DataFrame:
    """Typed trade rows with ``reason_code`` (null: good) and ``warned`` (value isn't units times price).

    Reasons are tried in a fixed order: type, date, numbers, zero units, sign, brokerage. A blank brokerage counts as 0.00
    and says so in its status. Extra columns are kept.
    """
    label, blank = F.lower(F.trim("Type")), F.coalesce(F.trim("Brokerage"), F.lit("")) == ""
    side = F.when(label.isin("buy trade", "buy"), "BUY").when(label.isin("sell trade", "sell"), "SELL")
    own = raw.withColumns({
        "side": side, "trade_date": parse_date(F.col("Trade Date")), "raw_quantity": parse_decimal(F.col("Quantity"), "decimal(18,6)"), "unit_price": parse_decimal(F.col("Unit Price"), "decimal(18,6)"),
        "gross_value": parse_decimal(F.col("Value"), "decimal(18,2)"), "raw_brokerage": parse_decimal(F.col("Brokerage"), "decimal(18,2)"), "product_id": normalise_code(F.col("Product ID")),
    })
    reason = (
        F.when(F.col("side").isNull(), "UNKNOWN_TRADE_TYPE")
        .when(F.col("trade_date").isNull(), "BAD_TRADE_DATE")
        .when(F.col("raw_quantity").isNull() | F.col("unit_price").isNull() | F.col("gross_value").isNull(), "BAD_NUMERIC")
        .when(F.col("raw_quantity") == 0, "ZERO_QUANTITY")
        .when((F.col("side") == "BUY") != (F.col("raw_quantity") > 0), "SIGN_MISMATCH")
        .when(~blank & F.col("raw_brokerage").isNull(), "BAD_BROKERAGE")
    )
    units = F.abs("raw_quantity")
    gap = F.abs(F.round(units * F.col("unit_price"), 2) - F.col("gross_value"))
    return own.withColumns({
        "canonical_units": units, "canonical_brokerage": F.when(blank, F.lit(0)).otherwise(F.col("raw_brokerage")).cast("decimal(18,2)"),
        "brokerage_source_status": F.when(blank, "SOURCE_BLANK_NEEDS_REVIEW" if review_blank else "SOURCE_BLANK_INTERPRETED_AS_ZERO").otherwise("SOURCE_VALUE"),
        "warned": F.coalesce(gap > units * F.lit("0.01").cast("decimal(3,2)") + F.lit("0.01").cast("decimal(3,2)"), F.lit(False)), "reason_code": reason,
    })


def parse_cash(raw: DataFrame) -> DataFrame:
    """Typed cash rows with ``cash_class``, ``reason_code`` (null: good) and ``warned`` (a sign that contradicts the class)."""
    label, name = F.lower(F.trim("Type")), F.lower(F.coalesce("Product Name", F.lit("")))
    fee = F.when(name.startswith("reversal:"), "FEE_REVERSAL").when(name.contains("transaction fee for"), "TRADE_BROKERAGE_CASH").otherwise("ADMIN_FEE")
    own = raw.withColumns({"cash_class": F.when(label == "fees and charges", fee).otherwise(_fixed(CASH_CLASSES, label)), "date": parse_date(F.col("Date")), "signed_total": parse_decimal(F.col("Total"), "decimal(18,2)"), "units": parse_decimal(F.col("Units"), "decimal(18,6)"), "product_id": normalise_code(F.col("Product ID"))})
    reason = F.when(F.col("cash_class").isNull(), "UNKNOWN_CASH_TYPE").when(F.col("date").isNull(), "BAD_DATE").when(F.col("signed_total").isNull(), "BAD_TOTAL")
    return own.withColumns({"reason_code": reason, "warned": F.coalesce(_fixed(CASH_SIGNS, F.col("cash_class")) * F.signum(F.col("signed_total").cast("double")) < 0, F.lit(False))})


def split_quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined ones; every row is in one of them."""
    return parsed.where("reason_code IS NULL").drop("reason_code"), parsed.where("reason_code IS NOT NULL")


def unaccounted(raw: DataFrame, records: DataFrame, quarantined: DataFrame, *keys: str) -> DataFrame:
    """Files (``keys``) whose rows aren't as many as their records and quarantined rows together, with all three counts."""
    counts = ["n_rows", "n_records", "n_quarantined"]
    parts = [df.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, *[F.col("n").alias(c) if c == own else F.lit(0).cast("long").alias(c) for c in counts]) for own, df in zip(counts, (raw, records, quarantined))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
    return both.where("n_rows <> n_records + n_quarantined").withColumn("code", F.lit("ROWS_UNACCOUNTED"))


def assert_accounted(raw: DataFrame, records: DataFrame, quarantined: DataFrame, *keys: str) -> None:
    """ValueError that names up to ten files which unaccounted() finds."""
    if bad := unaccounted(raw, records, quarantined, *keys).limit(10).collect():
        raise ValueError(f"rows unaccounted for: {[r.asDict() for r in bad]}")


def stream_exports(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Export files as they arrive, as strings without account numbers; parse_* apply to it as to a batch."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.readStream.option("header", True).schema(schema).csv(path)


def write_history(rows: DataFrame, path: str, date: str = "trade_date", from_date: str | None = None) -> None:
    """Persist a history, partitioned by year, under ``path``.

    With ``from_date`` stored rows before it stay, all others give way to those of ``rows`` from it on; without, ``rows``
    replace everything. What is kept of the boundary's year is written anew with the rest of that year, years after it
    that have no rows any more are removed, and years before it aren't touched.
    """
    spark = rows.sparkSession
    new = rows.withColumn("year", F.year(date))
    if from_date is None:
        new.write.mode("overwrite").partitionBy("year").parquet(path)
        return
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    new = new.where(F.col(date) >= F.lit(from_date))
    if fs.exists(folder):
        stored = spark.read.option("mergeSchema", True).parquet(path)
        boundary = int(from_date[:4])
        kept = stored.where((F.col("year") == boundary) & (F.col(date) < F.lit(from_date)))
        new = new.unionByName(kept, allowMissingColumns=True)
        gone = [r["year"] for r in stored.where(F.col("year") >= boundary).select("year").distinct().join(new.select("year").distinct(), "year", "left_anti").collect()]
    else:
        gone = []
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    for year in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/year={year}"), True)


def export_dataset(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Write CSV (nested cells as JSON) or JSON; ValueError where a column's name or a text cell looks like an identity."""
    if bad := [c for c in rows.columns if c.lower().replace("_", " ") == IDENTITY_COLUMN]:
        raise ValueError(f"identity columns: {bad}")
    texts = [c for c, k in rows.dtypes if k == "string" and not c.endswith("_id")]
    if texts and not rows.where(F.concat_ws("\n", *texts).rlike(r"\b\d{6,}\b")).isEmpty():
        raise ValueError("runs of six or more digits in text")
    flat = rows.select(*[F.to_json(c).alias(c) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in rows.dtypes]) if kind == "csv" else rows
    flat.write.mode("overwrite").option("header", True).format(kind).save(path)
