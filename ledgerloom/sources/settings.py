"""Rules as files: categories, banks and clients, from YAML or JSON, read on the driver (they are short lists that people write)."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..operators.rules import Category, with_fallbacks

try:
    import yaml
except ImportError:
    yaml = None


def _read(spark: SparkSession, path: str) -> dict:
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        if yaml is None:
            raise ValueError(f"{path}: YAML cannot be read here; give the rules as JSON")
        return yaml.safe_load(text) or {}
    return json.loads(text or "{}")


def _needles(rule: dict) -> tuple[str, ...]:
    return tuple(str(n).lower() for n in rule.get("match") or rule.get("detect") or ())


def load_categories(spark: SparkSession, path: str) -> list[Category]:
    """The categories in the file's order, with the two catch-alls; a type or direction that does not exist is an error."""
    rules = _read(spark, path).get("categories") or []
    registered = lambda c: c.get("vat") == "if_registered"
    return with_fallbacks([Category(c["name"], c["type"], _needles(c), c.get("vat") is True, c.get("direction"), registered(c)) for c in rules])


def load_needles(spark: SparkSession, path: str, key: str) -> list[tuple[str, tuple[str, ...]]]:
    """(name, needles) of the file's banks or clients, in order; those without a needle match nothing and are left out."""
    rules = _read(spark, path).get(key) or []
    rules = [{"name": n, **r} for n, r in rules.items()] if isinstance(rules, dict) else rules
    return [(r["name"], n) for r in rules if (n := _needles(r))]
