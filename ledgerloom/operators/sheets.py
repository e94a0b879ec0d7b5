"""Transactions from the cells of spreadsheets, confirmed group by group by the balances they print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.money import MONEY, sheet_money
from ..functions.text import heading, phrases_pattern
from .chain import confirm_groups

#: Words of a Type column, and the way that money goes.
DIRECTIONS = {"cr": 1, "credit": 1, "c": 1, "+": 1, "dr": -1, "debit": -1, "d": -1, "-": -1}
#: Phrases of rows that carry a balance over.
OPENING_PHRASES = ("opening balance", "balance brought forward", "brought forward", "balance b/f", "balance bf", "previous balance")
OPENING = phrases_pattern(OPENING_PHRASES)


def _direction(cell: Column) -> Column:
    # heading() keeps letters and digits only; the signs are words of their own.
    word = F.when(F.trim(cell).isin("+", "-"), F.trim(cell)).otherwise(heading(cell))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in DIRECTIONS.items() for x in kv]), word)


def sheet_amounts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds day, amount, sign, bal, words, bad_amount and bad_balance to rows of text cells (one column a role).

    A debit other than 0 goes out, else a credit other than 0 comes in, else the
    amount column counts with its own sign. A type column says the way only if
    all of the sheet's types do; otherwise it belongs to the description. A column
    balance_type, if there is one, makes the balances that it calls debits negative.
    """
    side = _direction(F.col("balance_type")) if "balance_type" in rows.columns else F.lit(None).cast("int")
    kinds = ("debit", "credit", "amount", "balance")
    rows = rows.withColumns({f"__{c}": sheet_money(F.col(c)) for c in kinds} | {"__says": _direction(F.col("type"))})
    debit, credit, amount, balance = (F.col(f"__{c}") for c in kinds)
    says = F.max(F.when(F.trim(F.coalesce("type", F.lit(""))) != "", F.col("__says").isNull()).otherwise(F.lit(False))).over(Window.partitionBy(*by))
    out, in_ = F.coalesce(debit["value"] != 0, F.lit(False)), F.coalesce(credit["value"] != 0, F.lit(False))
    size = F.when(out, debit["value"]).when(in_, credit["value"]).when(amount["value"].isNotNull(), amount["value"]).when(debit["value"].isNotNull() | credit["value"].isNotNull(), F.lit(0).cast(MONEY))
    way = F.when(out, -1).when(in_, 1).otherwise(amount["sign"])
    rows = rows.withColumn("typed", ~says)
    return rows.select(
        "*",
        parse_date(F.col("date")).alias("day"),
        size.cast(MONEY).alias("size"),
        F.coalesce(F.when(F.col("typed"), F.col("__says")), way).alias("sign"),
        (balance["value"] * F.coalesce(F.when(side == -1, -1), balance["sign"], F.lit(1))).cast(MONEY).alias("bal"),
        F.concat_ws(" | ", F.nullif(F.trim("description"), F.lit("")), F.when(~F.col("typed"), F.nullif(F.trim("type"), F.lit("")))).alias("words"),
        F.when(size.isNull(), F.coalesce(amount["unreadable"], debit["unreadable"], credit["unreadable"])).alias("bad_amount"),
        balance["unreadable"].alias("bad_balance"),
    ).drop("__says", *[f"__{c}" for c in kinds])


def sheet_transactions(rows: DataFrame, by: list[str], order: str = "row_no", opening: DataFrame | None = None) -> DataFrame:
    """Ledger rows of a sheet: by, seq, date, date_text, description, debit, credit, unassigned, balance, check.

    rows: by, order, and the text columns of the roles (see sources.files). opening:
    by, opening, the balance above the table. Rows without money are left out; the
    first of them that has a balance before any other row opens the chain. Rows
    that print no balance are confirmed together by the next one. check is empty
    for confirmed rows, else: amount_unreadable, balance_unreadable,
    no_earlier_balance, no_later_balance, ambiguous or does_not_follow. The chain
    starts anew at a figure that cannot be read.
    """
    p = sheet_amounts(rows, by)
    w = Window.partitionBy(*by).orderBy(order)
    moves = (F.coalesce("size", F.lit(0).cast(MONEY)) != 0) | F.col("bad_amount").isNotNull()
    total = F.col("day").isNull() & F.col("bal").isNull() & F.col("bad_balance").isNull() & (F.trim(F.coalesce("date", F.lit(""))) == "")
    p = p.withColumn("moves", moves & ~total).withColumn("n", F.count_if(F.col("moves")).over(w))
    # The last opening line, or the first balance, above the first row.
    head = p.where("not moves and n = 0 and bal is not null")
    head = head.groupBy(*by).agg(F.max_by("bal", F.struct(F.col("words").rlike(OPENING).alias("o"), F.when(F.col("words").rlike(OPENING), F.col(order)).otherwise(-F.col(order)).alias("p"))).alias("__head"))
    p = p.where("moves").join(head, by, "left")
    p = p.join(opening.select(*by, F.col("opening").alias("__open")), by, "left") if opening is not None else p.withColumn("__open", F.lit(None).cast(MONEY))
    broken = F.col("bad_amount").isNotNull() | F.col("bad_balance").isNotNull()
    p = p.withColumn("segment", F.count_if(broken).over(w))
    start = F.when(F.col("segment") == 0, F.coalesce("__head", "__open"))
    unread = F.col("bad_amount").isNotNull()
    p = p.select(*by, order, "segment", F.col("day"), "date", "words", "bad_amount", "bad_balance", start.alias("__start"), F.col("size").alias("__size"), F.col("sign").alias("__own"),
                 F.when(unread, F.lit(0).cast(MONEY)).otherwise(F.col("size")).alias("amount"), F.when(unread, F.lit(1)).otherwise(F.col("sign")).alias("sign"), F.col("bal").alias("balance"))
    p = confirm_groups(p, [*by, "segment"], [order], opening="__start")
    g = Window.partitionBy(*by, "segment", "group_id")
    ends = F.max("balance").over(g).isNotNull()
    began = F.coalesce(F.last("balance", ignorenulls=True).over(Window.partitionBy(*by, "segment").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), "__start")
    begins = F.min_by(began, F.col(order)).over(g).isNotNull()
    p = p.withColumn("__ends", ends).withColumn("__begins", begins)
    check = (
        F.when(F.col("bad_amount").isNotNull(), "amount_unreadable")
        .when(F.col("bad_balance").isNotNull(), "balance_unreadable")
        .when(F.col("fits") == 1, "")
        .when(~F.col("__begins"), "no_earlier_balance")
        .when(~F.col("__ends"), "no_later_balance")
        .when(F.col("fits") > 1, "ambiguous")
        .otherwise("does_not_follow")
    )
    way = F.when(check == "", F.col("resolved_sign")).otherwise(F.col("__own"))
    size = F.col("__size")
    return p.select(
        *by,
        F.col(order).cast("bigint").alias("seq"),
        F.col("day").alias("date"),
        F.coalesce("date", F.lit("")).alias("date_text"),
        F.coalesce(F.nullif("words", F.lit("")), F.lit("(no description)")).alias("description"),
        F.when(way == -1, size).alias("debit"),
        F.when(way == 1, size).alias("credit"),
        F.when(way.isNull(), size).alias("unassigned"),
        "balance",
        check.alias("check"),
    )


def compare_sheets(first: DataFrame, second: DataFrame, keys: list[str], figures: list[str]) -> DataFrame:
    """Adds agreed: the row of the same place in the second reading has the same figures; null where it has none."""
    other = second.select(*keys, F.struct(*[F.col(f).cast("string").alias(f) for f in figures]).alias("__s"))
    out = first.join(other, keys, "left")
    same = F.lit(True)
    for f in figures:
        same = same & F.col(f).cast("string").eqNullSafe(F.col("__s")[f])
    return out.withColumn("agreed", F.when(F.col("__s").isNotNull(), same)).drop("__s")


def lines_from_words(words: DataFrame, by: list[str]) -> DataFrame:
    """(by, line_no, text) of words with boxes x0, y0, x1, y1, text on a page.

    Words are taken by height and then from the left; a word is in the line if its
    centre is within 1.5 points, or 0.4 of the smaller height, of that of the
    line's first word. A page is one array; the fold over it is an expression.
    """
    c = ((F.col("y0") + F.col("y1")) / 2).alias("c")
    page = words.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(c, F.col("x0").alias("x"), (F.col("y1") - F.col("y0")).alias("h"), F.col("text").alias("t")))).alias("ws"))
    start = F.struct(F.lit(None).cast("double").alias("c"), F.lit(None).cast("double").alias("h"), F.array().cast("array<int>").alias("at"))

    def add(acc: Column, word: Column) -> Column:
        near = F.coalesce(F.abs(acc["c"] - word["c"]) <= F.greatest(F.lit(1.5), F.least(word["h"], acc["h"]) * 0.4), F.lit(False))
        last = F.coalesce(F.try_element_at(acc["at"], F.lit(-1)), F.lit(0))
        return F.struct(
            F.when(near, acc["c"]).otherwise(word["c"].cast("double")).alias("c"),
            F.when(near, acc["h"]).otherwise(word["h"].cast("double")).alias("h"),
            F.concat(acc["at"], F.array(F.when(near, last).otherwise(last + 1))).alias("at"),
        )

    placed = page.select(*by, "ws", F.aggregate("ws", start, add)["at"].alias("at"))
    each = placed.select(*by, F.explode(F.arrays_zip("at", "ws")).alias("p"))
    lines = each.groupBy(*by, F.col("p.at").cast("bigint").alias("line_no")).agg(F.array_sort(F.collect_list(F.struct(F.col("p.ws.x").alias("x"), F.col("p.ws.t").alias("t")))).alias("w"))
    return lines.select(*by, "line_no", F.array_join(F.transform("w", lambda x: x["t"]), " ").alias("text"))
