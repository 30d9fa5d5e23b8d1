"""Dates as the sources write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact_date(text: Column) -> Column:
    """`YYYYMMDD` to ISO text; text that is no date stays as it came."""
    parsed = F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd")
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), text)


def iso_date(text: Column) -> Column:
    """Strict ISO date; anything else is null and belongs with the rejects."""
    trimmed = F.trim(text)
    return F.when(
        trimmed.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(trimmed, "yyyy-MM-dd")
    )


def day_group(day: Column) -> Column:
    """`weekend` or `weekday`; a missing date counts as a weekday."""
    return F.when(F.weekday(day) >= 5, "weekend").otherwise("weekday")


def resolve_receipt_date(text: Column, currency: Column) -> Column:
    """struct<date, alternative, needs_review> from a printed date.

    ISO order and a written month are plain. For two numbers and a year, a number above 12 settles
    the order, then the currency's usual order; otherwise both readings come back for review.
    """
    raw = F.trim(text)
    iso = iso_date(raw)
    written = F.coalesce(
        F.try_to_date(raw, "d MMM yyyy"), F.try_to_date(raw, "MMM d yyyy"),
        F.try_to_date(raw, "MMM d, yyyy"),
    )
    pattern = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})$"
    first = F.regexp_extract(raw, pattern, 1).try_cast("int")
    second = F.regexp_extract(raw, pattern, 2).try_cast("int")
    year_text = F.regexp_extract(raw, pattern, 3)
    year = F.when(F.length(year_text) == 2, year_text.try_cast("int") + 2000).otherwise(
        year_text.try_cast("int")
    )
    day_first = _date_of(year, second, first)
    month_first = _date_of(year, first, second)
    code = F.upper(F.trim(currency))
    by_number = F.when(first > 12, day_first).when(second > 12, month_first)
    by_locale = F.when(code.isin("GBP", "EUR"), day_first).when(code == "USD", month_first)
    same = day_first == month_first
    settled = F.coalesce(iso, written, by_number, F.when(same, day_first), by_locale)
    unclear = settled.isNull()
    return F.struct(
        F.coalesce(settled, day_first, month_first).alias("date"),
        F.when(unclear & day_first.isNotNull() & month_first.isNotNull(), month_first).alias(
            "alternative"
        ),
        unclear.alias("needs_review"),
    )


def _date_of(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws(
        "-",
        year.cast("string"),
        F.lpad(month.cast("string"), 2, "0"),
        F.lpad(day.cast("string"), 2, "0"),
    )
    return F.try_to_date(text, "yyyy-MM-dd")


def display_date(day: Column, style: str = "long") -> Column:
    patterns = {"long": "MMM d, yyyy", "short": "MMM d", "iso": "yyyy-MM-dd"}
    return F.coalesce(F.date_format(day, patterns[style]), F.lit(""))


def display_range(start: Column, end: Column) -> Column:
    return F.concat(display_date(start), F.lit(" – "), display_date(end))
