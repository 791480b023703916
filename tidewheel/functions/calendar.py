"""Months and dates (DT-1 to DT-8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def month_of(c: Column) -> Column:
    """DT-4, DOM-14: first day of the month, a date."""
    return F.trunc(c, "month").cast("date")


def days_in_month(c: Column) -> Column:
    """DT-6."""
    return F.dayofmonth(F.last_day(c))


def month_from_parts(year: Column, month: Column) -> Column:
    """DT-2."""
    return F.make_date(year, month, F.lit(1))


def month_number(name: Column) -> Column:
    """DT-3: from an English month name of three letters or more, in any case; NULL if there is no such month."""
    table = F.create_map(*(x for i, m in enumerate(MONTH_NAMES) for x in (F.lit(m), F.lit(i + 1))))
    return table[F.lower(F.substring(F.trim(name), 1, 3))]


def parse_date(c: Column, *formats: str) -> Column:
    """DT-1: by the first format that fits, e.g. yyyy-MM-dd, ddMMyyyy, dd-MM-yyyy; NULL if none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats))


def months_before(c: Column, n: int | Column) -> Column:
    """DT-7."""
    return F.add_months(c, -n)


def month_starts(first: Column, last: Column) -> Column:
    """DT-8: array of month starts from first to last."""
    return F.sequence(month_of(first), month_of(last), F.expr("interval 1 month"))


def month_end(c: Column) -> Column:
    """DT-8."""
    return F.last_day(c)


def day_text(c: Column) -> Column:
    """STR-6: dd-MM-yyyy."""
    return F.date_format(c, "dd-MM-yyyy")
