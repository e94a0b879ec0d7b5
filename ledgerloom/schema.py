"""The canonical ledger: one row a transaction, in an order of its own (seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEDGER = (
    "account string, client string, bank string, statement_id string, statement_period string, source_file string, seq bigint, "
    "date date, date_text string, month string, description string, debit decimal(18,2), credit decimal(18,2), unassigned decimal(18,2), "
    "balance decimal(18,2), ocr boolean, evidence string, reasons array<string>, status string, confidence double, row_key string, "
    "category string, category_source string, suggested_category string, vat string"
)
COLUMNS = {part.split(" ", 1)[0]: part.split(" ", 1)[1] for part in LEDGER.split(", ")}


def as_ledger(rows: DataFrame) -> DataFrame:
    """All ledger columns in order and of their types; those that rows does not have are null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])
