"""Money as printed on statements, as DECIMAL(18,2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

MONEY = "decimal(18,2)"
#: Fixed value: the VAT rate, in per cent.
VAT_PERCENT = 15


def parse_amount(raw: Column) -> Column:
    """The amount of a printed figure; null for blanks, placeholders and what is no figure.

    Parentheses around it or a trailing Dr make it negative; a currency R, blanks
    and a trailing Cr or Dr are dropped. Of comma and point the last one is the
    decimal mark; a comma alone is one if just two digits follow it, and groups
    thousands if not.
    """
    # Each step is named once: copies of it in the branches would not fit into generated code.
    number = lambda p: F.when(p.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"), p.try_cast("decimal(38,6)"))

    def plain(bare: Column) -> Column:
        comma, point = F.instr(F.reverse(bare), ","), F.instr(F.reverse(bare), ".")
        decimal = F.when((comma > 0) & (point > 0), comma < point).otherwise(bare.rlike(r"^-?\d+,\d{2}$"))
        return F.when(comma == 0, bare).when(decimal, F.translate(bare, ",.", ".")).otherwise(F.translate(bare, ",", ""))

    def signed(text: Column) -> Column:
        negative = (text.startswith("(") & text.endswith(")")) | F.lower(text).endswith("dr")
        bare = F.translate(F.regexp_replace(F.translate(F.regexp_replace(text, r"(?i)\s*(cr|dr)\s*$", ""), "Rr", ""), r"^[ ()]+|[ ()]+$", ""), " ", "")
        value = let(let(bare, plain), number)
        return F.when(~F.lower(text).isin("", "-", "--", "n/a", "na"), let(value, lambda v: F.when(negative, -F.abs(v)).otherwise(v)))

    return let(F.regexp_replace(raw, r"^\s+|\s+$", ""), signed).try_cast(MONEY)


def signed_token(token: Column, unmarked_is_debit: bool = True) -> Column:
    """A figure with a Cr or Dr mark as a signed amount; an unmarked one goes out, if it's said so."""
    return let(parse_amount(token), lambda v: by_mark(v, token, unmarked_is_debit))


def by_mark(amount: Column, token: Column, unmarked_is_debit: bool = True) -> Column:
    """The amount of a token, with the sign that its Cr or Dr says."""
    marked = F.lower(F.trim(token))
    out = marked.endswith("dr") | (~marked.endswith("cr") & F.lit(unmarked_is_debit))
    return F.when(out, -F.abs(amount)).otherwise(F.abs(amount))


def sheet_money(cell: Column) -> Column:
    """(value, sign, unreadable) of a spreadsheet cell: sign is null where the cell does not say."""
    low = F.lower(F.trim(F.coalesce(cell, F.lit(""))))
    none = low.isin("", "-", "--", "n/a", "na")

    def parts(v: Column) -> Column:
        sign = F.when(low.endswith("cr"), 1).when(v < 0, -1)
        return F.struct(F.abs(v).alias("value"), sign.alias("sign"), F.when(v.isNull() & ~none, cell).alias("unreadable"))

    return let(parse_amount(cell), parts)


def cents(amount: Column) -> Column:
    return (amount * 100).cast("bigint")


def from_cents(c: Column) -> Column:
    return (c.cast("decimal(18,0)") / 100).cast(MONEY)


def rand(amount: Column) -> Column:
    """'R 1 234.56', thousands by blanks; minus in front."""
    size = F.abs(amount)
    whole = F.translate(F.format_number(F.floor(size).cast("bigint"), 0), ",", " ")
    part = F.lpad((F.floor(size * 100) % 100).cast("string"), 2, "0")
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("R "), whole, F.lit("."), part)


def vat_of(amount: Column, percent: int = VAT_PERCENT) -> Column:
    """The VAT in an amount that includes it, not rounded (a wide decimal)."""
    return (amount * percent / (100 + percent)).cast("decimal(28,10)")


def net_cents(amount_cents: Column, percent: int = VAT_PERCENT) -> Column:
    """An amount of cents, 0 or more, without its VAT, half up."""
    whole = 100 + percent
    return F.call_function("div", amount_cents * 200 + whole, F.lit(2 * whole).cast("bigint"))
