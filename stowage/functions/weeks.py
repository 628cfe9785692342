"""ISO weeks. Tables store the Monday date; labels are rendered at the edge."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of_column(as_of: dt.date) -> Column:
    return F.lit(as_of).cast("date")


def monday(date: Column) -> Column:
    """The Monday of the ISO week holding ``date``."""
    return F.date_trunc("week", date).cast("date")


def monday_of(as_of: dt.date) -> dt.date:
    return as_of - dt.timedelta(days=as_of.weekday())


def iso_year(date: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), date).cast("int")


def two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def history_label(date: Column) -> Column:
    """``2025-W24``."""
    return F.concat(iso_year(date).cast("string"), F.lit("-W"), two_digits(F.weekofyear(date)))


def week_label(date: Column) -> Column:
    """``2025-24W``."""
    return F.concat(iso_year(date).cast("string"), F.lit("-"), two_digits(F.weekofyear(date)), F.lit("W"))


def week_number(date: Column) -> Column:
    """``202524`` as an integer."""
    return iso_year(date) * 100 + F.weekofyear(date)


def monday_of_week(year: Column, week: Column) -> Column:
    """The Monday of an ISO year and week: January 4 always lies in week 1."""
    first = monday(F.make_date(year, F.lit(1), F.lit(4)))
    return F.date_add(first, (week - 1) * 7)


def parse_week(label: Column) -> Column:
    """The Monday of ``2025-W24``, ``2025-24W`` or ``202524``; anything else gives null."""
    text = label.cast("string")
    digits = F.regexp_replace(text, "[-W]", "")
    well_formed = text.rlike(r"^(\d{4}-W\d{2}|\d{4}-\d{2}W|\d{6})$")
    year = F.substring(digits, 1, 4).try_cast("int")
    week = F.substring(digits, 5, 2).try_cast("int")
    return F.when(well_formed & week.between(1, 53), monday_of_week(year, week))


def number_to_label(number: Column) -> Column:
    """``202524`` to ``2025-24W``."""
    n = number.cast("int")
    return F.concat(F.floor(n / 100).cast("string"), F.lit("-"), two_digits(n % 100), F.lit("W"))


def next_weeks(start: Column, count: int) -> Column:
    """An array of ``count`` Mondays starting with the week of ``start``."""
    first = monday(start)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.date_add(first, k * 7))
