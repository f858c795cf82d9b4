"""Calendar dates without time zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_date(text: Column) -> Column:
    """The calendar date an ISO string itself states, or null.

    Only the first ten characters count: converting through a timestamp would
    move dates near midnight into the session's time zone.
    """
    day = F.substring(text, 1, 10)
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date"))


def month_day(text: Column) -> Column:
    """``MM-DD`` as the number month*100+day."""
    return F.split_part(text, F.lit("-"), F.lit(1)).cast("int") * 100 + F.split_part(
        text, F.lit("-"), F.lit(2)
    ).cast("int")


def month_day_of(day: Column) -> Column:
    return F.month(day) * 100 + F.dayofmonth(day)


def in_season(day: Column, start: Column, end: Column) -> Column:
    """Whether a date's month and day lie in [start, end] in any year.

    A window whose start sorts after its end runs across New Year.
    """
    key = month_day_of(day)
    return F.when(start <= end, (key >= start) & (key <= end)).otherwise((key >= start) | (key <= end))


def valid_month_day(text: Column) -> Column:
    """Whether text is a month and day that exist in a leap year."""
    parts = F.split(text, "-")
    whole = text.rlike(r"^[0-9]+-[0-9]+$")
    probe = F.try_make_timestamp(
        years=F.lit(2000),
        months=F.get(parts, F.lit(0)).try_cast("int"),
        days=F.get(parts, F.lit(1)).try_cast("int"),
        hours=F.lit(0),
        mins=F.lit(0),
        secs=F.lit(0),
    )
    return F.coalesce(whole & probe.isNotNull(), F.lit(False))


def placed_in_year(number: Column, year: Column) -> Column:
    """A month*100+day number in a year; Feb 29 becomes Feb 28 if need be."""
    month = F.floor(number / 100).cast("int")
    first = F.make_date(year, month, F.lit(1))
    return F.date_add(first, F.least(number % 100, F.dayofmonth(F.last_day(first))) - 1)
