"""Reporting periods as a bridge table (period, month), generated from the months that have rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import financial_quarter, financial_year, financial_year_label, month_label, vat_period_end

MONTH, QUARTER, YEAR, ALL, VAT = "month", "quarter", "year", "all", "vat"


def _labelled(months: DataFrame) -> DataFrame:
    return months.select("month").where("month is not null").distinct().withColumn("d", F.to_date(F.concat("month", F.lit("-01"))))


def periods(months: DataFrame) -> DataFrame:
    """(kind, label, sort_key, length, month): every period that a month belongs to, a row for each.

    months: a column month ('2026-03'). Years begin in March; a quarter or year is
    partial if it has fewer months here than its length.
    """
    m = _labelled(months).withColumn("fy", financial_year(F.col("d"))).withColumn("q", financial_quarter(F.col("d")))
    fy = financial_year_label(F.col("fy"))
    first = F.add_months(F.to_date(F.concat(F.col("fy").cast("string"), F.lit("-03-01"))), (F.col("q") - 1) * 3)
    ends = months.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))  # one row
    all_label = F.concat(F.lit("All months ("), month_label(F.col("lo")), F.lit(" - "), month_label(F.col("hi")), F.lit(")"))
    span = lambda k: F.date_format(F.add_months(first, k), "MMM")
    year = F.struct(F.lit(YEAR).alias("kind"), F.concat(fy, F.lit(" (Mar "), F.col("fy").cast("string"), F.lit(" - Feb "), (F.col("fy") + 1).cast("string"), F.lit(")")).alias("label"), F.concat(F.lit("1-"), F.col("fy").cast("string"), F.lit("-0")).alias("sort_key"), F.lit(12).alias("length"))
    quarter = F.struct(F.lit(QUARTER).alias("kind"), F.concat(fy, F.lit(" Q"), F.col("q").cast("string"), F.lit(" ("), span(0), F.lit(" - "), F.date_format(F.add_months(first, 2), "MMM yyyy"), F.lit(")")).alias("label"), F.concat(F.lit("1-"), F.col("fy").cast("string"), F.lit("-"), F.col("q").cast("string")).alias("sort_key"), F.lit(3).alias("length"))
    month = F.struct(F.lit(MONTH).alias("kind"), month_label(F.col("month")).alias("label"), F.concat(F.lit("2-"), "month").alias("sort_key"), F.lit(1).alias("length"))
    every = F.struct(F.lit(ALL).alias("kind"), all_label.alias("label"), F.lit("0").alias("sort_key"), F.lit(0).alias("length"))
    return m.crossJoin(F.broadcast(ends)).select(F.explode(F.array(every, year, quarter, month)).alias("p"), "month").select("p.*", "month")


def vat_periods(months: DataFrame, category: str) -> DataFrame:
    """(label, end_month, month) of the VAT periods A, B (two months) or C (monthly)."""
    m = _labelled(months).withColumn("end_month", vat_period_end(F.col("d"), category))
    end = F.to_date(F.concat("end_month", F.lit("-01")))
    label = month_label(F.col("end_month")) if category == "C" else F.concat(F.date_format(F.add_months(end, -1), "MMM yyyy"), F.lit(" - "), F.date_format(end, "MMM yyyy"))
    return m.select(label.alias("label"), "end_month", "month")


def in_months(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Rows of a range of months, both ends in, whichever way round they are given."""
    return rows.where(F.col("month").between(min(first, last), max(first, last)))
