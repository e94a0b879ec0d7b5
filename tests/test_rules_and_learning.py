"""Rules and patterns as tables, and what is learned batch by batch."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import learn, lifecycle, rule_table, rules

RULES = "rule_order int, rule string, needle string, way string"


def test_rules_as_a_table_are_the_rules_as_branches(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abc ") for _ in range(n))
    texts = [word(r.randrange(0, 14)).upper() for _ in range(300)] + [None, "", "\U0001f600 abc", "x" * 20_000 + "cab"]
    cats = [rules.Category(f"c{k}", ("income", "expense", "transfer")[k % 3], (word(r.randrange(1, 6)), word(4))) for k in range(40)]
    cats = [rules.Category(c.name, c.type, tuple(n for n in c.needles if n)) for c in cats]
    rows = spark.createDataFrame([(k, t, Decimal(1) if k % 2 else None) for k, t in enumerate(texts)], "id int, d string, credit decimal(18,2)").withColumn("is_in", rules.money_in(F.col("credit")))
    table = spark.createDataFrame([(k, c.name, n, c.way) for k, c in enumerate(cats) for n in c.needles], RULES)
    got = {x.id: x.rule for x in rule_table.first_rules(rows.repartition(4), table, "d", "is_in").collect()}
    want = {x.id: x.c for x in rows.select("id", rules.categorize(F.col("d"), F.col("credit"), cats).alias("c")).collect()}
    assert {k: v or "none" for k, v in got.items()} == {k: "none" if "uncategorised" in v else v for k, v in want.items()}


def test_ten_thousand_rules(spark):
    """As many as no expression could hold; a third of all rows have one text."""
    table = spark.createDataFrame([(k, f"r{k}", f"shop {k:05d}", "any") for k in range(10_000)] + [(10_000, "last", "zz", None), (-1, "none", "", "any")], RULES)
    rows = spark.createDataFrame([(k, f"Card SHOP {k % 9_999 if k % 3 else 77:05d} town") for k in range(3000)] + [(3000, "ZZ"), (3001, None)], "id int, d string")
    got = {x.id: x.rule for x in rule_table.first_rules(rows, table, "d").collect()}
    assert all(got[k] == f"r{k % 9_999 if k % 3 else 77}" for k in range(3000)) and got[3000] == "last" and got[3001] is None


def test_no_rules_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "a")], "id int, d string")
    none = spark.createDataFrame([], RULES)
    assert [x.rule for x in rule_table.first_rules(rows, none, "d").collect()] == [None]
    assert not rule_table.first_rules(rows.where("false"), spark.createDataFrame([(1, "r", "a", "any")], RULES), "d").count()


def test_own_patterns_first(spark):
    lines = [("a", 0, "Total: 1.00"), ("a", 1, "First Bank"), ("a", 2, "Sum 5.00"), ("a", 3, "Sum 6.00"), ("b", 0, "Total: 2.00"), ("b", 1, "Sum 9.00"), ("c", 0, "First bank"), ("c", 1, "Total: 3.00"), ("d", 0, None)]
    banks = spark.createDataFrame([(1, "One", "first bank")], "rule_order int, rule string, needle string")
    patterns = spark.createDataFrame([("One", "total", 2, "^Sum (.+)$"), ("One", "total", 1, "^Never (.+)$"), (None, "total", 1, "^Total: (.+)$")], "bank string, field string, priority int, pattern string")
    got = {r.s: (r.bank, r.found.get("total")) for r in rule_table.bank_patterns(spark.createDataFrame(lines, "s string, line_no int, text string"), ["s"], "line_no", banks, patterns).collect()}
    assert got == {"a": ("One", ["5.00", "6.00"]), "b": (None, ["2.00"]), "c": ("One", ["3.00"]), "d": (None, None)}


LEDGER = "row_key string, description string, credit decimal(18,2), category string, category_source string, suggested_category string"


def _rows():
    shops = [("corner grocer market", "Food"), ("river garage petrol", "Fuel"), ("hill water works", "Utilities")]
    rows = []
    for k in range(60):
        words, category = shops[k % 3]
        by_hand = k % 4 == 0
        rows.append((f"k{k:02d}", f"{words} ref{'abc'[k % 3]}{'xyz'[k % 2]}", None, category if by_hand else None, lifecycle.BY_HAND if by_hand else None, None))
    return rows


@pytest.mark.parametrize("parts", [1, 3])
def test_batches_teach_as_all_at_once(spark, tmp_path, parts):
    """Suggestions when a ledger is opened again, from the index that grew with it and from the ledger itself."""
    ledger = spark.createDataFrame(_rows(), LEDGER)
    index = learn.WordIndex(spark, f"file://{tmp_path}/index")
    for k in range(parts):
        lifecycle.teach_index(index, ledger.where(F.col("row_key").substr(2, 2).cast("int") % parts == k))
    shown = lambda df: sorted((r.row_key, r.category, r.category_source, r.suggested_category) for r in df.collect())
    got = shown(lifecycle.suggest_for_open(ledger, index=index))
    assert got == shown(lifecycle.suggest_for_open(ledger))
    # The rarest word of every second row is in no row that is taught.
    assert {c for _, c, _, _ in got} == {"Food", "Fuel", "Utilities", None} and sum(s == lifecycle.SUGGESTED for _, _, s, _ in got) == 15


def test_a_row_that_changes_its_category_teaches_the_new_one(spark, tmp_path):
    ledger = spark.createDataFrame(_rows(), LEDGER)
    index = learn.WordIndex(spark, f"file://{tmp_path}/index")
    lifecycle.teach_index(index, ledger)
    changed = ledger.withColumn("category", F.when(F.col("category") == "Food", "Groceries").otherwise(F.col("category")))
    lifecycle.teach_index(index, changed.where("category = 'Groceries' or category = 'Fuel'").withColumn("category_source", F.when(F.col("category") == "Groceries", lifecycle.BY_HAND)), new=False)
    got = {r.category for r in lifecycle.suggest_for_open(changed.where("category is null"), index=index).collect()}
    assert got == {"Groceries", None, "Utilities"}  # Fuel is no longer a person's, and teaches nothing
