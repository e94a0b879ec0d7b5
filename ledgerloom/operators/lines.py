"""Transactions from lines of statement text: a date, words, then figures, and the running balance.

Lines are rows (statement, line number, text); everything is native. A line is cut
once: the date that it begins with, the figures that it ends with, and the words
between. Which figure is which is told by counting from the end; the sign comes from
the balance printed before, and a fee is a row of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.figures import dates_of, lattice, plain_words, read_as, words_of
from ..functions.let import let
from .chain import continuation_lines, skipped_lines, stands_alone

#: The shapes of dates that lines begin with, with and without a year.
DATES = ("9/9/9999", "9-9-9999", "9999-99-99", "9 Month 9999")
DATES_WITHOUT_YEAR = ("9 Mon",)
_SHAPES = {"9999-99-99": r"\d{4}-\d\d-\d\d", "9/9/9999": r"\d\d?/\d\d?/\d{2,4}", "9-9-9999": r"\d\d?-\d\d?-\d{2,4}", "9 Month 9999": r"\d\d? [A-Za-z]{3,9} \d{2,4}", "9 Mon": r"\d\d? [A-Za-z]{3}"}
OPENING_PHRASE = "opening balance"


@dataclass(frozen=True)
class LineFormat:
    """How a bank prints rows: the separator of thousands, a fee before the balance, a column after it, unmarked amounts going out."""

    thousands: str = ","
    fee_column: bool = False
    year: bool = True
    trailing_column: bool = False
    unmarked_is_debit: bool = False

    @property
    def date(self) -> str:
        return "(?:" + "|".join(_SHAPES[d] for d in (DATES if self.year else DATES_WITHOUT_YEAR)) + ")"

    def figures(self, tokens: Column) -> Column:
        """The line's figures as this format groups thousands; those grouped in another way are none."""
        fits = F.filter(tokens, lambda t: ~t["grouped"]) if self.thousands != "," else tokens
        return read_as(fits, ".", self.thousands == " ")

    def cut(self, words: Column, date: Column, figures: Column) -> Column:
        """(description, amount, fee, balance) of a line's words, figures and the date that it begins with; null for a line that is no row.

        Of the figures that the line ends with two are an amount and a balance, more
        of them a fee between or a column behind, if the format has these; what is
        left over is part of the description.
        """
        most = 2 + self.fee_column + self.trailing_column
        # From the end: a figure is part of the tail while it ends where the tail begins.
        tail = F.aggregate(F.reverse(figures), F.struct(F.size(words).alias("at"), F.lit(0).alias("n")), lambda s, f: F.when(f["last"] + 1 == s["at"], F.struct(f["first"].alias("at"), (s["n"] + 1).alias("n"))).otherwise(s))["n"]

        def named(n: Column) -> Column:
            used = F.slice(figures, -F.least(n, F.lit(most)), F.lit(most))
            begin = F.size(F.split(date, " "))
            signed = lambda f: F.when(f["sign"] == -1, -f["value"]).otherwise(f["value"])
            balance = lambda u: F.get(u, F.size(u) - 1 - F.when(F.size(u) == most, int(self.trailing_column)).otherwise(0))
            said = lambda u: F.array_join(F.slice(words, begin + 1, F.greatest(u[0]["first"] - begin, F.lit(0))), " ")
            cells = lambda u: F.struct(F.nullif(said(u), F.lit("")).alias("description"), signed(u[0]).alias("amount"), u[0]["sign"].alias("sign"), (F.get(u, F.lit(1))["value"] if self.fee_column else F.lit(None).cast("decimal(18,2)")).alias("fee"), signed(balance(u)).alias("balance"), balance(u)["sign"].alias("balance_sign"))
            # With two figures the second one is the balance.
            whole = lambda x: x.withField("fee", F.when(n > 2, x["fee"]))
            return let(let(used, cells), whole)

        return let(tail, lambda n: F.when((date != "") & (n >= 2), named(n)))


def cut_lines(lines: DataFrame, by: list[str], order: str = "line_no") -> DataFrame:
    """(by, order, text, words, tokens, dates): each line cut once, for every reader; lines that are so already stay as they are."""
    if {"words", "tokens", "dates"} <= set(lines.columns):
        return lines
    return lines.select(*by, order, "text", plain_words(F.col("text")).alias("words"), lattice(words_of(F.col("text"))).alias("tokens"), dates_of(F.col("text")).alias("dates"))


def read_lines(lines: DataFrame, fmt: LineFormat, by: list[str], order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """(rows, statements) of the lines that the format reads.

    A row whose amount leads from the balance before to its own goes that way; else
    a mark (minus, brackets, Cr, Dr) says the way; else it is unassigned. A fee on
    the row becomes a row after it, which alone has the printed balance. Rows of 0
    without a fee are dropped. A description that goes on in the next line (short,
    without a date, figures or a phrase of its own) takes it along. statements: by,
    opening, n_skipped, examples.
    """
    text = F.trim("text")
    w = Window.partitionBy(*by).orderBy(order)
    p = cut_lines(lines, by, order).select(*by, order, "text", "words", "tokens", F.regexp_extract(text, rf"^{fmt.date}(?=\s)", 0).alias("date_text"), fmt.figures(F.col("tokens")).alias("figures"))
    # Unmarked amounts go out only on statements that mark some as Cr.
    unmarked = F.lit(fmt.unmarked_is_debit) & F.max(F.exists("tokens", lambda t: t["marked_in"])).over(Window.partitionBy(*by))
    p = p.withColumn("__unmarked", F.coalesce(unmarked, F.lit(False)))
    sign = lambda v, s: F.when(F.col("__unmarked") & s.isNull(), -v).otherwise(v)
    # The figure right after the words opening balance.
    place = F.size(F.split(F.regexp_replace(F.lower(text), rf"^(.*?{OPENING_PHRASE}):?(?= |$).*$|^.*$", "$1"), r"\s+"))
    after = F.when(F.lower(text).rlike(rf"{OPENING_PHRASE}:?( |$)"), F.get(F.filter("figures", lambda f: f["first"] == place), F.lit(0)))
    p = p.select("*", fmt.cut(F.col("words"), F.col("date_text"), F.col("figures")).alias("cut"), F.when(after["sign"] == -1, -after["value"]).otherwise(after["value"]).alias("__opening"), ((F.col("date_text") != "") & (F.size("figures") > 0)).alias("looks_like_row"))
    p = p.select(*by, order, "text", "__unmarked", "__opening", "looks_like_row", F.when(F.col("cut").isNotNull(), F.col("date_text")).alias("date_text"), "cut.description", F.col("cut.amount").alias("__amount"), F.col("cut.sign").alias("__sign"), sign(F.col("cut.amount"), F.col("cut.sign")).alias("amount"), sign(F.col("cut.balance"), F.col("cut.balance_sign")).alias("balance"), "cut.fee")
    p = p.withColumn("is_row", F.coalesce(F.col("amount").isNotNull() & ((F.col("amount") != 0) | F.col("fee").isNotNull()), F.lit(False)))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    started = F.coalesce(F.max("is_row").over(past), F.lit(False))
    p = p.withColumn("__open", F.when(~started, F.col("__opening")))
    heads = p.groupBy(*by).agg(F.min_by("__open", F.when(F.col("__open").isNotNull(), F.col(order))).alias("opening"))
    heads = heads.join(skipped_lines(p.withColumn("is_row", F.col("__amount").isNotNull()), by, [order]), by, "left").withColumn("n_skipped", F.coalesce("n_skipped", F.lit(0).cast("bigint")))
    told = continuation_lines(p.select("*", F.coalesce("description", F.when(~F.col("is_row"), text)).alias("__said"), (F.col("is_row") | stands_alone(text)).alias("is_blocked")), by, [order], said="__said")
    rows = told.where("is_row").withColumn("description", F.nullif("full_description", F.lit(""))).join(heads.select(*by, "opening"), by)
    nxt = rows.withColumn("__b", F.coalesce(F.lag("balance").over(w), "opening"))
    after = F.col("balance") + F.coalesce("fee", F.lit(0).cast("decimal(18,2)"))
    size = F.abs("amount")
    goes_out, goes_in = F.col("__b") - size == after, F.col("__b") + size == after
    marked = F.col("__unmarked") | F.col("__sign").isNotNull()
    way = F.when(goes_out, -1).when(goes_in, 1).when(marked, F.when(F.col("amount") < 0, -1).otherwise(1))
    nxt = nxt.withColumn("way", way).withColumn("description", F.coalesce("description", F.lit("(no description)")))
    part = lambda k, desc, debit, credit, unassigned, balance: F.struct(F.lit(k).alias("sub"), desc.alias("description"), debit.alias("debit"), credit.alias("credit"), unassigned.alias("unassigned"), balance.alias("balance"))
    none = F.lit(None).cast("decimal(18,2)")
    main = part(0, F.col("description"), F.when(F.col("way") == -1, size), F.when(F.col("way") == 1, size), F.when(F.col("way").isNull(), size), F.when(F.col("fee").isNull(), F.col("balance")))
    fee = part(1, F.concat(F.lit("Fee: "), F.col("description")), F.col("fee"), none, none, F.col("balance"))
    both = nxt.select(*by, order, "date_text", F.col("text").alias("evidence"), F.explode(F.when(F.col("fee").isNull(), F.array(main)).otherwise(F.array(main, fee))).alias("r"))
    out = both.select(*by, (F.col(order) * 2 + F.col("r.sub")).cast("bigint").alias("seq"), "date_text", parse_date(F.col("date_text")).alias("date"), "r.description", "r.debit", "r.credit", "r.unassigned", "r.balance", "evidence")
    return out, heads

