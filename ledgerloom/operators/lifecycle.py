"""What happens to a ledger's categories and VAT marks when it is opened again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learn import WordIndex, suggest_categories
from .rules import Category, categorize, money_in, uncategorised, vat_default

BY_RULE, BY_HAND, SUGGESTED = "Rule", "Set by you", "Suggested"


def reapply_rules(ledger: DataFrame, categories: list[Category]) -> DataFrame:
    """Adds category_was; category and category_source afresh.

    A category that is still the suggestion is reopened, and one that is none of
    a person's gets the rules again. Any other stays, as by a rule if the rules
    would give the same, else as by hand.
    """
    rule = categorize(F.col("description"), F.col("credit"), categories)
    reopened = F.col("suggested_category").isNotNull() & F.col("category").eqNullSafe(F.col("suggested_category"))
    open_ = reopened | uncategorised(F.col("category"))
    source = F.when(open_, F.when(~uncategorised(rule), BY_RULE)).otherwise(F.when(F.col("category") == rule, BY_RULE).otherwise(BY_HAND))
    out = ledger.withColumn("category_was", F.col("category")).withColumn("__s", source).withColumn("category", F.when(open_, rule).otherwise(F.col("category")))
    return out.drop("category_source", "suggested_category").withColumnRenamed("__s", "category_source").withColumn("suggested_category", F.lit(None).cast("string"))


def _taught() -> Column:
    return F.coalesce((F.col("category_source") == BY_HAND) & ~uncategorised(F.col("category")), F.lit(False))


def teach_index(index: WordIndex, rows: DataFrame, id_col: str = "row_key", new: bool = True) -> None:
    """Rows go into the stored index: their words, if they are new, and those that a person has categorised as examples."""
    if new:
        index.add(rows.select("description"))
    category = F.when(_taught(), F.col("category"))
    index.teach(rows.select(F.col(id_col).alias("id"), "description", money_in(F.col("credit")).alias("money_in"), category.alias("category")))


def suggest_for_open(ledger: DataFrame, id_col: str = "row_key", index: WordIndex | None = None) -> DataFrame:
    """Uncategorised rows get what the rows categorised by hand suggest; rules' categories never teach.

    index: what has been added batch by batch; without one the ledger is read for it.
    """
    rows = ledger.withColumn("money_in", money_in(F.col("credit"))).withColumn("id", F.col(id_col))
    asked = rows.where(uncategorised(F.col("category"))).select("id", "description", "money_in")
    if index is None:
        found = suggest_categories(asked, rows.where(_taught()).select("id", "description", "money_in", "category"), rows.where(~_taught()).select("description"))
    else:
        found = index.suggest(asked)
    found = found.select(F.col("id").alias(id_col), F.col("category").alias("__c"))
    out = ledger.join(found, id_col, "left")
    out = out.withColumn("suggested_category", F.coalesce("__c", "suggested_category")).withColumn("category_source", F.when(F.col("__c").isNotNull(), SUGGESTED).otherwise(F.col("category_source")))
    return out.withColumn("category", F.coalesce("__c", "category")).drop("__c")


def settle_vat(ledger: DataFrame, categories: list[Category], reset: bool = False) -> DataFrame:
    """VAT marks: a changed category (or reset) takes the new one's default; a Yes or No stays."""
    changed = ~F.col("category").eqNullSafe(F.col("category_was")) | F.lit(reset)
    keeps = ~changed & F.col("vat").isin("Yes", "No")
    return ledger.withColumn("vat", F.when(F.coalesce(keeps, F.lit(False)), F.col("vat")).otherwise(vat_default(F.col("category"), categories))).drop("category_was")
