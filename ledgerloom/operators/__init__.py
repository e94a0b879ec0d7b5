"""Operators on ledger rows: DataFrame in, DataFrame out."""
