"""A ledger over a table of orders, with known faults, to run the operators on.

An order is a transaction of its customer's account: money in where it is
fulfilled, else out. Printed balances are the running ones, but for every 13th
order's, which is missing, and every 101st's, which is 1.00 too large; every 29th
order does not say its direction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import month_key
from ..functions.money import from_cents
from ..operators.assess import APPROVED, REVIEW
from ..operators.rules import DRAWINGS, EXPENSE, INCOME, TRANSFER, Category, categorize, type_of, vat_default, with_fallbacks

BY, ORDER = ["account"], ["date", "seq"]
CATEGORIES = with_fallbacks(
    [
        Category("Sales", INCOME, ("urgent", "high"), vat=True),
        Category("Rent", EXPENSE, ("purchase 1", "purchase 4"), vat=True),
        Category("Bank charges", EXPENSE, ("medium",), vat=True),
        Category("Own accounts", TRANSFER, ("low purchase",)),
        Category("Drawings", DRAWINGS, ("specified purchase 2", "purchase 5")),
    ]
)


def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    amount = from_cents(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    unknown, is_in = F.col("o_orderkey") % 29 == 0, F.col("o_orderstatus") == "F"
    day = F.to_date("o_orderdate")
    rows = o.select(
        F.col("o_custkey").cast("string").alias("account"),
        F.col("o_orderkey").alias("seq"),
        day.alias("date"),
        month_key(day).alias("month"),
        F.concat(F.substring("o_orderpriority", 3, 20), F.lit(" purchase "), (F.col("o_custkey") % 7).cast("string")).alias("description"),
        F.when(~unknown & ~is_in, amount).alias("debit"),
        F.when(~unknown & is_in, amount).alias("credit"),
        F.when(unknown, amount).alias("unassigned"),
    )
    zero = F.lit(0).cast("decimal(18,2)")
    running = F.sum(F.coalesce("credit", zero) - F.coalesce("debit", zero)).over(Window.partitionBy(*BY).orderBy(*ORDER))
    faulty = running + F.when(F.col("seq") % 101 == 0, 1).otherwise(0)
    rows = rows.withColumn("balance", F.when(F.col("seq") % 13 != 0, faulty).cast("decimal(18,2)"))
    rows = rows.withColumn("status", F.when(F.col("unassigned").isNotNull() | F.col("balance").isNull(), REVIEW).otherwise(APPROVED))
    rows = rows.withColumn("category", categorize(F.col("description"), F.col("credit"), CATEGORIES))
    return rows.withColumn("type", type_of(F.col("category"), CATEGORIES)).withColumn("vat", vat_default(F.col("category"), CATEGORIES))
