"""Date parsing and as-of arithmetic. No function reads the clock."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from studyloom.functions.nulls import as_column

# Weekday names in calendar order.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def parse_date(col: Column | str, formats: list[str]) -> Column:
    """First layout that parses wins; null when none does, also for impossible dates."""
    text = F.trim(as_column(col).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def days_between(later: Column | str | date, earlier: Column | str | date) -> Column:
    """Whole days from `earlier` to `later`, negative when it lies after."""
    return F.datediff(_day(later), _day(earlier))


def _day(value: Column | str | date) -> Column:
    return F.lit(value) if isinstance(value, date) else as_column(value)


def months_complete(start: Column | str, end: Column | str) -> Column:
    """Calendar months fully passed; a month counts once its day of month is reached."""
    s, e = as_column(start), as_column(end)
    months = (F.year(e) * 12 + F.month(e)) - (F.year(s) * 12 + F.month(s))
    return months - F.when(F.dayofmonth(e) < F.dayofmonth(s), 1).otherwise(0)


def weekday_name(col: Column | str) -> Column:
    return F.date_format(as_column(col), "EEEE")


def weekday_order(as_of: date) -> list[str]:
    """The seven weekday names starting at the weekday of `as_of`."""
    first = as_of.weekday()
    return [WEEKDAYS[(first + i) % 7] for i in range(7)]


def weekday_rank(col: Column | str, as_of: date) -> Column:
    """0 for the weekday of `as_of`, 6 for the day before it in the week."""
    return (F.weekday(as_column(col)) - F.lit(as_of.weekday()) + 7) % 7


def date_text(col: Column | str) -> Column:
    """Date as text such as 2021Jan05."""
    return F.date_format(as_column(col), "yyyyMMMdd")
