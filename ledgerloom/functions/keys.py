"""What makes two ledger rows the same transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import same_words

KEY_LENGTH = 24


def _amount(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def row_key(client: Column, bank: Column, account: Column, day: Column, description: Column, debit: Column, credit: Column, balance: Column, unassigned: Column, occurrence: Column) -> Column:
    """The head of a SHA-256 over the row's own figures and words.

    Client, bank, day, words, debit, credit and balance always take a place;
    account, unassigned and a repeat's number only where they are there.
    """
    empty = lambda c: F.coalesce(c, F.lit(""))
    parts = F.concat_ws(
        "|",
        empty(client),
        empty(bank),
        F.nullif(account, F.lit("")),
        empty(day.cast("string")),
        same_words(description),
        empty(_amount(debit)),
        empty(_amount(credit)),
        empty(_amount(balance)),
        F.concat(F.lit("u"), _amount(unassigned)),
        F.when(occurrence > 0, occurrence.cast("string")),
    )
    return F.substring(F.sha2(parts, 256), 1, KEY_LENGTH)


def with_row_keys(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds occurrence (0 for the first of equal rows) and row_key.

    Equal rows are told apart by `order` alone, so a statement read twice numbers
    its repeats the same way. One shuffle, by the base key.
    """
    c = lambda name: F.col(name)
    fields = [c(x) for x in ("client", "bank", "account", "date", "description", "debit", "credit", "balance", "unassigned")]
    base = rows.withColumn("base_key", row_key(*fields, F.lit(0)))
    same = Window.partitionBy("base_key").orderBy(*order)
    return base.withColumn("occurrence", F.row_number().over(same) - 1).withColumn("row_key", row_key(*fields, c("occurrence"))).drop("base_key")


def statement_id(source_file: Column) -> Column:
    """The same statement under any name: the 12 hex digits of a stored file and its '(statement 2 of 3)'; other names as they are."""
    head = F.regexp_extract(source_file, r"^([0-9a-f]{12})_", 1)
    return F.when(head != "", F.concat(head, F.regexp_extract(source_file, r"(\(statement \d+ of \d+\))$", 1))).otherwise(source_file)


def ledger_name(client: Column, account: Column, source_file: Column) -> Column:
    """Where a row's ledger is kept: one for each account; without a number, one for each source, so that nothing is mixed."""
    who = F.nullif(F.coalesce(F.nullif(client, F.lit("UNMAPPED_CLIENT")), F.lit("")), F.lit(""))
    stem = F.regexp_replace(source_file, r"\.[^.]*$", "")
    known = F.coalesce(F.concat(who, F.lit(" ("), account, F.lit(")")), F.concat(F.lit("Account "), account))
    name = F.when(F.coalesce(account, F.lit("")) != "", known).otherwise(F.concat(F.coalesce(who, F.lit("Unknown account")), F.lit(" - "), stem))
    return F.trim(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"))
