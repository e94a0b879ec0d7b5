"""Spark-native analytics over account ledgers (see README.md)."""
