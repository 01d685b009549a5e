"""Column functions for parsing, normalising and redacting export text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"\b\d{1,2}-(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)-\d{4}\b"

#: What all five layouts of parse_date look like: no text of this shape is two of them in a row.
_DATE_SHAPE = r"^([+-]?\d+([- ])[A-Za-z]+\2[+-]?\d+|[+-]?\d+-\d+-\d+)$"

#: Same-day order of event types.
TYPE_ORDER = ["CORPORATE_ACTION", "DEPOSIT", "TRANSFER", "BUY", "SELL", "DIVIDEND", "DISTRIBUTION", "INTEREST", "TAX", "FEE", "WITHDRAWAL", "OTHER"]


def parse_decimal(c: Column, kind: str = "decimal(28,8)") -> Column:
    """Number without currency signs, commas and spaces; a leading double minus is one; null where it isn't a number.

    One pattern cleans a text once; what has no digit isn't tried, since a failed cast costs more than a good one.
    """
    bare = F.regexp_replace(c, r"^[$,\s]*-(?=[$,\s]*-)|[$,\s]", "")
    return F.when(c.rlike(r"\p{Nd}"), bare).try_cast(kind)


def parse_date(c: Column) -> Column:
    """Date in one of five layouts; null for others and for markers of a date that isn't there.

    The layouts are optional parts of one pattern: five of them in a row fail one by one and fill a task's generated code.
    """
    t = F.trim(c)
    return F.when(t.rlike(_DATE_SHAPE), F.try_to_date(t, "[d-MMM-yyyy][d-MMM-yy][d MMMM yyyy][d MMM yyyy][yyyy-MM-dd]"))


def normalise_code(c: Column) -> Column:
    """Security code: upper case, without exchange suffix, letters and digits only; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.upper(F.trim(c)), r"\.(AX|ASX|XASX)(\.[A-Z]{2})?$|[^A-Z0-9]", ""), F.lit(""))


def redact(c: Column) -> Column:
    """Runs of four or more digits as as many #, but for those inside dates such as 05-Jan-2024."""
    parts = F.regexp_extract_all(c, F.lit(rf"(?s){_DATE}|\d{{4,}}|."), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d{4,}$"), F.repeat(F.lit("#"), F.length(x))).otherwise(x)), "")


def contains_identifier(c: Column) -> Column:
    return F.regexp_replace(c, _DATE, "").rlike(r"\d{4,}")


def redact_inline(c: Column) -> Column:
    return F.regexp_replace(c, r"\b\d{6,}\b", "[redacted]")


def make_id(kind: str, *cols: Column, length: int = 16) -> Column:
    """Stable id of a natural key; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256), 1, length)


def slug(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(c), r"[^\p{L}#]", ""), 1, 32)


def financial_year(d: Column) -> Column:
    """July to June, named for the year in which it ends."""
    return F.year(d) + (F.month(d) > 6).cast("int")


def quarter_of(d: Column) -> Column:
    """(year, quarter) of a date; null for none."""
    return F.when(d.isNotNull(), F.struct(F.year(d).alias("year"), F.quarter(d).alias("quarter")))


def bucket_end(d: Column, granularity: str) -> Column:
    """Last day of a date's day, week (Sunday), month, quarter or year."""
    return {
        "day": d,
        "week": F.date_add(F.date_trunc("week", d).cast("date"), 6),
        "month": F.last_day(d),
        "quarter": F.last_day(F.add_months(F.trunc(d, "quarter"), 2)),
        "year": F.make_date(F.year(d), F.lit(12), F.lit(31)),
    }[granularity]


def type_order(c: Column) -> Column:
    """Place of an event type within its day; types that aren't known come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TYPE_ORDER)), c), F.lit(0)), F.lit(99)).cast("int")
