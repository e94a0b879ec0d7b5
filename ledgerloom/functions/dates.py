"""Dates as printed on statements, months, quarters and financial years (March to February)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date formats in the order they are tried; day first, month first only where that is impossible.
FORMATS = ("d/M/yyyy", "d/M/yy", "d-M-yyyy", "d-M-yy", "d MMM yyyy", "d MMMM yyyy", "yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d MMM yy")
FIRST_MONTH = 3


def parse_date(raw: Column) -> Column:
    """The date, by the first format that reads the whole text; null if none does (31/02, month 25)."""
    text = F.initcap(F.regexp_replace(F.trim(raw), r"\s+", " "))
    return F.coalesce(*[F.try_to_date(text, f) for f in FORMATS])


def month_key(day: Column) -> Column:
    """'2026-03'; null without a date."""
    return F.date_format(day, "yyyy-MM")


def month_label(month: Column) -> Column:
    """'Mar 2026' of a month key."""
    return F.date_format(F.try_to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd"), "MMM yyyy")


def financial_year(day: Column) -> Column:
    """The calendar year in which the financial year starts."""
    return F.year(day) - (F.month(day) < FIRST_MONTH).cast("int")


def financial_quarter(day: Column) -> Column:
    return (F.floor(F.pmod(F.month(day) - FIRST_MONTH, F.lit(12)) / 3) + 1).cast("int")


def financial_year_label(start: Column) -> Column:
    return F.concat(F.lit("FY"), start.cast("string"), F.lit("/"), F.lpad(F.pmod(start + 1, F.lit(100)).cast("string"), 2, "0"))


def vat_period_end(day: Column, category: str) -> Column:
    """The month key in which the VAT period of a date ends: A ends in odd months, B in even ones, C monthly."""
    if category == "C":
        return month_key(day)
    odd = F.month(day) % 2 == 1
    return month_key(F.when(odd == F.lit(category == "A"), day).otherwise(F.add_months(day, 1)))


def date_in_period(day: Column, month: Column, start: Column, end: Column) -> Column:
    """A date without a year, in the period if it can be.

    Of the end's year and the two before it: the latest year that puts it between
    start and end; without one, the date nearest to the period. Without a start:
    the end's year, or the one before if that is over 31 days after the end. Null
    for a day that no such year has.
    """
    made = [F.try_to_date(F.concat_ws("-", (F.year(end) - k).cast("string"), month.cast("string"), day.cast("string")), "yyyy-M-d") for k in range(3)]
    inside = F.coalesce(*[F.when((d >= start) & (d <= end), d) for d in made])
    away = lambda d: F.greatest(F.datediff(start, d), F.datediff(d, end))
    near = F.array_min(F.filter(F.array(*[F.when(d.isNotNull(), F.struct(away(d).alias("far"), F.lit(k).alias("k"), d.alias("d"))) for k, d in enumerate(made)]), lambda x: x.isNotNull()))
    late = F.datediff(made[0], end) > 31
    return F.when(start.isNotNull(), F.coalesce(inside, near["d"])).otherwise(F.when(late | made[0].isNull(), made[1]).otherwise(made[0]))


def period_range(text: Column) -> Column:
    """(start, end) of 'date to date'; null unless both can be read and are in order."""
    part = F.split(text, r"(?i)\s+to\s+")
    start, end = parse_date(F.get(part, F.lit(0))), parse_date(F.get(part, F.lit(1)))
    return F.when((F.size(part) == 2) & (start <= end), F.struct(start.alias("start"), end.alias("end")))
