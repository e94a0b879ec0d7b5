"""Words, figures and clean-ups of statement text; regular expressions in Java's dialect."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .figures import DIGITS, bare_word
from .let import let

#: Month names, which say nothing about what a transaction is for.
MONTH_WORDS = (
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
    "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december",
)
#: Letters that scans show for digits, and words for a page.
LOOKALIKES, PAGE_WORDS = "OIlSB", ("page", "pg")


def same_words(description: Column) -> Column:
    """The lower-case words in a fixed order, so that other line breaks don't make another text."""
    return F.array_join(F.array_sort(F.regexp_extract_all(F.lower(F.coalesce(description, F.lit(""))), F.lit(r"[^\s|]+"), F.lit(0))), " ")


def telling_words(description: Column) -> Column:
    """Words of two letters or more, repeats kept, without month names."""
    found = F.regexp_extract_all(F.lower(F.coalesce(description, F.lit(""))), F.lit(r"[a-z][a-z&']+"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*MONTH_WORDS))


def garbled_figures(text: Column) -> Column:
    """Figures of which a scan has made letters: words with one point and two places after it whose characters are digits, commas and letters that look like digits, some of each."""
    # Words that cannot be one are left out before their marks are taken off.
    some = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w.contains(".") & w.rlike(f"[{LOOKALIKES}a]") & w.rlike("[0-9]"))
    bare = F.transform(some, lambda w: bare_word(w)["core"])
    shape = lambda w: F.translate(w, DIGITS + LOOKALIKES, "9" * len(DIGITS) + "a" * len(LOOKALIKES))

    def mixed(s: Column) -> Column:
        rest = F.translate(F.translate(s, "a", "9"), ",", "")
        return s.contains("9") & s.contains("a") & (F.translate(rest, "9", "") == ".") & (F.instr(rest, ".") > 1) & (F.instr(rest, ".") == F.length(rest) - 2) & ~s.startswith(",")

    return F.filter(bare, lambda w: let(shape(w), mixed))


def page_numbers(text: Column) -> Column:
    """(page, of) of each 'page 2 of 4' or 'pg 2/4' whose numbers make sense: a word for page, a number, of, a number."""
    apart = F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("/"), F.lit(" of ")), "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ")

    def all_(words: Column) -> Column:
        number = lambda i: F.get(words, i).try_cast("int")
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(*PAGE_WORDS) & (F.get(words, i + 2) == "of"))
        pages = F.transform(at, lambda i: F.struct(number(i + 1).alias("page"), number(i + 3).alias("of")))
        return F.filter(pages, lambda p: (p["page"] > 0) & (p["page"] <= p["of"]) & (p["of"] < 1000))

    named = reduce(Column.__or__, [F.lower(text).contains(w) for w in PAGE_WORDS])
    return F.when(named, let(F.split(apart, "[^a-z0-9]+"), all_)).otherwise(F.array().cast("array<struct<page:int,of:int>>"))


def missing_pages(pages: Column) -> Column:
    """The numbers up to the largest 'of' that no page has; pages as page_numbers gives them."""
    last = F.array_max(F.transform(pages, lambda p: p["of"]))
    return F.when(F.size(pages) > 0, F.array_except(F.sequence(F.lit(1), last), F.transform(pages, lambda p: p["page"]))).otherwise(F.array().cast("array<int>"))


def heading(cell: Column) -> Column:
    """A column heading as it is compared: lower case, letters and digits, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(cell, F.lit(""))), "[^a-z0-9]+", " "))


def clean_scan(text: Column) -> Column:
    """What a scan adds to a line goes: rules of tables, lone marks, and marks stuck to figures and dates. Digits never change; blanks are single.

    Words are looked at one by one. Brackets that are a figure's own, both of them,
    stay, as do the marks that say something alone: # ( ) : and -.
    """
    figure = r"\d[\d,]*\.\d{2}(?:Cr|Dr)?"

    def word(w: Column) -> Column:
        stuck = F.regexp_extract(w, rf"^([^\w]*{figure})[^\w%]*$", 1)  # a figure, less the marks after it
        closed = w.startswith("(") & w.contains(")")
        return F.when(closed & w.rlike(rf"^\({figure}\)"), F.regexp_extract(w, rf"^(\({figure}\))", 1)).when(stuck != "", stuck).otherwise(w)

    def line(x: Column) -> Column:
        plain = F.regexp_replace(F.translate(x, "|[]{}\ufffd", "      "), r"(\d\.\d{2}) (Cr|Dr)\b", "$1$2")
        words = F.filter(F.split(plain, r"[ \t]+"), lambda w: w != "")
        dated = F.size(words) > 2
        noise = lambda w, k: w.rlike(r"^[^\w#():-]{1,3}$") | ((k == 0) & w.rlike(r"^[^\w]{1,3}$") & dated & F.get(words, F.lit(1)).rlike(r"^\d{1,2}$"))
        return F.array_join(F.filter(F.transform(words, word), lambda w, k: ~noise(w, k)), " ")

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def phrases_pattern(phrases: tuple[str, ...]) -> str:
    """A pattern for any of the phrases as whole words, in either case."""
    return r"(?i)\b(?:" + "|".join(re.escape(p).replace(r"\ ", r"\s+") for p in phrases) + r")\b"


def first_match(text: Column, patterns: list[str], group: int = 1) -> Column:
    """What the first pattern that matches captures; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns], F.lit(None).cast("string"))


def account_number(text: Column, patterns: list[str]) -> Column:
    return F.nullif(F.regexp_replace(first_match(text, patterns), r"\D", ""), F.lit(""))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
