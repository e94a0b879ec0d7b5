"""Rules and patterns as tables, for as many as there are: needles met by an equi-join, patterns by the bank that a statement names.

A needle is indexed by one gram of three letters, that which fewest texts hold; a
text meets the needles of its grams alone, and what meets is verified. So ten
thousand rules cost a join, where an expression of as many branches could not be compiled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored

GRAM = 3
#: Rows of a table of patterns that is broadcast; a larger one is shuffled.
BROADCAST_PATTERNS = 10_000
ANY, IN, OUT = "any", "in", "out"


def _grams(text: Column, size: Column) -> Column:
    """The distinct pieces of this length."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substr(text, k, size)))).otherwise(F.array().cast("array<string>"))


def met_needles(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(text, and the columns of needles) for each needle that stands in a text.

    texts: text, lower case, each once. needles: needle, lower case and not empty, and what
    comes with it. A needle that holds a gram that no text has is in none; one of fewer
    than three letters is its own gram.
    """
    sized = needles.withColumn("__size", F.least(F.length("needle"), F.lit(GRAM)))
    sizes = [r[0] for r in sized.select("__size").distinct().collect()] or [GRAM]  # three at most
    grams = texts.select("text", F.explode(F.concat(*[_grams(F.col("text"), F.lit(n)) for n in sizes])).alias("__gram"))
    held = grams.groupBy("__gram").agg(F.count(F.lit(1)).alias("__df"))
    distinct = sized.select("needle", "__size").distinct()
    each = distinct.select("needle", F.explode(_grams(F.col("needle"), F.col("__size"))).alias("__gram")).join(held, "__gram", "left")
    rarest = each.groupBy("needle").agg(F.min(F.struct(F.coalesce("__df", F.lit(0)).alias("df"), F.col("__gram").alias("gram"))).alias("r")).where("r.df > 0")
    met = grams.join(rarest.select("needle", F.col("r.gram").alias("__gram")), "__gram").where(F.contains("text", "needle")).select("text", "needle")
    return met.join(needles, "needle")


def first_rules(rows: DataFrame, rules: DataFrame, text: str, money_in: str | None = None) -> DataFrame:
    """Adds rule and rule_order: the first rule of which a needle stands in the text, case aside, and that takes the row's direction; null without one.

    rules: rule_order, rule, needle, and way ('in', 'out' or 'any'; without the column every
    rule takes any), a row for each needle. Equal texts are one. Null texts are empty; a rule without letters matches nothing.
    """
    way = F.coalesce(F.lower("way"), F.lit(ANY)) if "way" in rules.columns else F.lit(ANY)
    needles = rules.select("rule_order", "rule", F.lower("needle").alias("needle"), way.alias("way")).where("needle <> ''")
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    met = met_needles(rows.select(low.alias("text")).distinct(), needles)
    one = F.struct("rule_order", "rule")
    best = met.groupBy("text").agg(F.min(F.when(F.col("way") != OUT, one)).alias("__in"), F.min(F.when(F.col("way") != IN, one)).alias("__out"), F.min(F.when(F.col("way") == ANY, one)).alias("__any"))
    # Stored, so that rows of one text that are very many can be split when they meet it.
    best = stored(best.withColumnRenamed("text", "__text"))
    pick = F.col("__any") if money_in is None else F.when(F.col(money_in), F.col("__in")).when(~F.col(money_in), F.col("__out")).otherwise(F.col("__any"))
    out = rows.withColumn("__low", low).join(best, F.col("__low") == F.col("__text"), "left")
    return out.withColumn("__p", pick).select(*rows.columns, F.col("__p.rule_order").alias("rule_order"), F.col("__p.rule").alias("rule"))


def detect_banks(lines: DataFrame, by: list[str], banks: DataFrame) -> DataFrame:
    """(by, bank): the first bank of which a needle stands in any line of the statement; null without one. banks: rule_order, rule, needle."""
    found = first_rules(lines.select(*by, "text"), banks, "text")
    return found.groupBy(*by).agg(F.min_by("rule", "rule_order").alias("bank"))


def bank_patterns(lines: DataFrame, by: list[str], order: str, banks: DataFrame, patterns: DataFrame) -> DataFrame:
    """(by, bank, found): for each field what the first pattern captures that any line of the statement has, line by line.

    patterns: bank (null for those that all banks have), field, priority, pattern (its
    first group is captured). A statement's own bank's patterns go first, each list
    in order of priority, then those of all. found: field to values, in the order of the lines.
    """
    bank = detect_banks(lines, by, banks)
    # The general patterns stand under each bank's name and under none, so that a line meets its patterns by one key.
    names = patterns.select("bank").union(banks.select("rule")).where("bank is not null").distinct().select(F.col("bank").alias("__of"))
    names = names.union(names.sparkSession.createDataFrame([("",)], "__of string"))
    own = patterns.where("bank is not null").select(F.col("bank").alias("__of"), "field", F.lit(0).alias("__all"), "priority", "pattern")
    general = patterns.where("bank is null").select(F.lit(1).alias("__all"), "field", "priority", "pattern").join(names, F.lit(True)).select(*own.columns)
    table = own.unionByName(general)
    if table.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS:
        table = F.broadcast(table)
    p = lines.select(*by, F.col(order).alias("__o"), "text").join(bank, by).withColumn("__bank", F.coalesce("bank", F.lit("")))
    met = p.join(table, p["__bank"] == table["__of"]).drop("__of", "__bank")
    caught = met.withColumn("__v", F.expr("CASE WHEN rlike(text, pattern) THEN regexp_extract(text, pattern, 1) END")).where(F.trim("__v") != "")
    w = Window.partitionBy(*by, "field").orderBy("__all", "priority")
    first = caught.withColumn("__first", F.dense_rank().over(w)).where("__first = 1")
    values = first.groupBy(*by, "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__v"))), lambda x: x["__v"]).alias("v"))
    maps = values.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias("found"))
    return bank.join(maps, by, "left").withColumn("found", F.coalesce("found", F.create_map().cast("map<string,array<string>>")))
