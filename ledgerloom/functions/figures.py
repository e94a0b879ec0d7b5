"""Figures and dates inside lines of statement text, in whatever style a statement prints them.

A style is a decimal mark and a separator of thousands. A date is read as the units
that a line begins with (figures or words, and what stands between them); which kind
of date they make is told by what each unit can be. A figure is read word by word: marks go off both ends,
and what is left must be digits around one mark. Everything is an expression of
structs, so a line costs no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

#: Fixed values: (decimal mark, separator of thousands) in the order they are preferred.
STYLES = ((".", ","), (",", "."), (".", " "), (",", " "))
#: What stands before a figure for the currency, and after it for the side of the account.
CURRENCIES, SIDES = ("R", "ZAR"), ("cr", "dr")
#: Month names by their first three letters, in order; the names in full.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LONG_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "sept")
#: Kinds of dates that lines begin with, in the order of preference, as their units: Day, Month in figures, month's Name, Year.
DATE_KINDS = {"dmy": "DMY", "ymd": "YMD", "d_mon_y": "DNY", "mon_d_y": "NDY", "d_mon": "DN", "mon_d": "ND", "dm": "DM"}
_UNIT, _BETWEEN = r"(\d{1,4}|[A-Za-z]{3,9})", r"([-/., ]{0,2})"
_CUT = "\u0001"


DIGITS = "0123456789"
#: Words without digits of which bare_word would take nothing off.
_NO_FIGURE = r"^(?![-(RZ])[^0-9]*[^0-9*)rR-]\z"


def bare_word(w: Column) -> Column:
    """A word without its marks: what stood before and after, its core, and the core's shape with a 9 for each digit."""
    # Most words begin and end with none of the marks, which is told by one character.
    starts = F.substr(w, F.lit(1), F.lit(1)).isin("(", "-", *sorted({c[0] for c in CURRENCIES}))
    front = F.when(starts, F.ltrim(F.regexp_replace(F.ltrim(w, F.lit("(-")), "^(" + "|".join(reversed(CURRENCIES)) + ")", ""), F.lit("-"))).otherwise(w)
    ends = lambda f: F.substr(f, F.lit(-1), F.lit(1)).isin("*", ")", "-", *sorted({x for c in SIDES for x in (c[-1], c[-1].upper())}))
    back = lambda f: F.when(ends(f), F.rtrim(F.regexp_replace(F.rtrim(f, F.lit("*")), "(?i)(" + "|".join(SIDES) + ")$", ""), F.lit(")-"))).otherwise(f)

    def parts(x: Column) -> Column:
        f, c = x["f"], x["c"]
        return F.struct(
            F.substr(w, F.lit(1), F.length(w) - F.length(f)).alias("before"),
            F.lower(F.substr(f, F.length(c) + 1)).alias("after"),
            c.alias("core"),
            F.translate(c, DIGITS, "9" * 10).alias("shape"),
        )

    return let(let(front, lambda f: F.struct(f.alias("f"), back(f).alias("c"))), parts)


def _whole(shape: Column, mark: str, other: str) -> Column:
    """Whether a shape is digits, in groups of three by the other mark or without, then this decimal mark and two digits."""
    return shape.endswith(mark + "99") & shape.rlike(rf"^(?:9+|9{{1,3}}(?:[{other}]999)+)[{mark}]99\z")


def plain_words(text: Column) -> Column:
    """The words of a line, cut at blanks."""
    return F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+")


def words_of(text: Column) -> Column:
    """The words of a line, cut at blanks, with their marks apart and what each can be.

    (word, before, after, core, shape, mark, grouped): mark is the decimal mark of a
    word that is a figure of two decimals, grouped says that the other one sets its thousands apart.
    """

    def one(w: Column) -> Column:
        def cells(before: Column, after: Column, core: Column, shape: Column, mark: Column, grouped: Column) -> Column:
            return F.struct(w.alias("word"), before.alias("before"), after.alias("after"), core.alias("core"), shape.alias("shape"), mark.alias("mark"), grouped.alias("grouped"))

        def told(x: Column) -> Column:
            mark = F.when(_whole(x["shape"], ".", ","), ".").when(_whole(x["shape"], ",", "."), ",")
            return let(mark, lambda m: cells(x["before"], x["after"], x["core"], x["shape"], m, F.when(m == ".", x["shape"].contains(",")).when(m == ",", x["shape"].contains("."))))

        nothing = F.lit("")
        bare = cells(nothing, nothing, w, w, F.lit(None).cast("string"), F.lit(None).cast("boolean"))
        return F.when(w.rlike(_NO_FIGURE), bare).otherwise(let(bare_word(w), told))

    return F.transform(plain_words(text), one)


def lattice(words: Column) -> Column:
    """The figures of a line in order, with their places and each of their readings.

    words: as words_of gives them. (first, last, mark, grouped, out, marked_in, value, joined): first and last are
    places of words from 0. joined is (first, value, out) of the second reading of a figure of
    three digits before the mark, where words of digits stand right before: as thousands set
    apart by blanks; null without. out and marked_in: a bracket, minus or Dr, and a Cr. A currency, minus or side may be a
    word of its own.
    """
    none = F.lit(None)

    def all_(w: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            at = lambda k: F.when(i >= k, F.get(w, i - k))
            lone = lambda y: (y["core"] == "") & (y["before"] != "") & ~y["before"].contains("(") & (y["after"] == "")
            digits = lambda y: y["shape"].isin("9", "99", "999") & (y["after"] == "")
            longer = lambda y: (y["shape"] == "999") & (y["before"] == "")
            side = F.when(x["after"] == "", F.lower(F.rtrim(F.get(w, i + 1)["word"], F.lit("*"))))
            side = F.when(side.isin(*SIDES), side).otherwise("")
            joins = (x["shape"].like("999_99")) & (x["before"] == "")
            n = F.when(~(joins & F.coalesce(digits(at(1)), F.lit(False))), 0).when(~(longer(at(1)) & F.coalesce(digits(at(2)), F.lit(False))), 1).when(~(longer(at(2)) & F.coalesce(digits(at(3)), F.lit(False))), 2).otherwise(3)
            return F.struct(x.alias("x"), i.alias("i"), side.alias("side"), n.alias("n"), F.coalesce(lone(at(1)), F.lit(False)).alias("apart"))

        def token(t: Column) -> Column:
            x, i = t["x"], t["i"]
            value = lambda d: F.try_divide(d.try_cast("decimal(18,0)"), F.lit(100)).cast("decimal(18,2)")
            digits = lambda c: F.translate(c, ".,", "")
            ends_out = x["after"].rlike("[)-]|dr") | (t["side"] == "dr")
            starts_out = lambda y: y["before"].rlike("[(-]")
            before = lambda k: F.coalesce(F.when(i >= k, F.get(w, i - k)["core"] == "") & F.when(i >= k, F.get(w, i - k)["before"].rlike("^-?(ZAR|R)?$") & (F.get(w, i - k)["before"] != "")), F.lit(False))
            parts = F.array_join(F.transform(F.slice(w, F.greatest(i - t["n"], F.lit(0)) + 1, t["n"] + 1), lambda y: digits(y["core"])), "")
            start = lambda k: F.when(before(k + 1), i - k - 1).otherwise(i - k)
            minus = lambda k: F.coalesce(before(k + 1) & F.get(w, i - k - 1)["before"].contains("-"), F.lit(False))
            joined = F.struct(start(t["n"]).alias("first"), value(parts).alias("value"), (ends_out | starts_out(F.get(w, i - t["n"])) | minus(t["n"])).alias("out"))
            return F.struct(
                F.when(t["apart"], start(F.lit(0))).otherwise(i).alias("first"),
                (i + (t["side"] != "").cast("int")).alias("last"),
                x["mark"].alias("mark"),
                x["grouped"].alias("grouped"),
                (ends_out | starts_out(x) | minus(F.lit(0))).alias("out"),
                (x["after"].contains("cr") | (t["side"] == "cr")).alias("marked_in"),
                value(digits(x["core"])).alias("value"),
                F.when(t["n"] > 0, joined).otherwise(none).alias("joined"),
            )

        some = F.filter(F.transform(w, one), lambda t: t["x"]["mark"].isNotNull())
        return F.filter(F.transform(some, token), lambda t: t["value"].isNotNull())

    return let(words, all_)


def token_sign(t: Column) -> Column:
    """-1 where a bracket, a minus or Dr says it, 1 where Cr does, else null."""
    return F.when(t["out"], -1).when(t["marked_in"], 1)


def read_as(tokens: Column, decimal: Column | str, blanks: Column | bool) -> Column:
    """[(first, last, value, sign)]: the figures with this decimal mark; with blanks, those of digits set apart are one."""
    joins = blanks if isinstance(blanks, Column) else F.lit(blanks)

    def one(t: Column) -> Column:
        j = t["joined"]
        apart = F.struct(j["first"].alias("first"), t["last"].alias("last"), j["value"].alias("value"), F.when(j["out"], -1).when(t["marked_in"], 1).alias("sign"))
        plain = F.struct(t["first"].alias("first"), t["last"].alias("last"), t["value"].alias("value"), token_sign(t).alias("sign"))
        return F.when(joins & j.isNotNull(), apart).otherwise(plain)

    return F.transform(F.filter(tokens, lambda t: t["mark"] == decimal), one)


def figures(text: Column, decimal: str = ".", thousands: str = ",") -> Column:
    """[(first, last, value, sign)]: sizes, with the sign where brackets, a minus, Cr or Dr say it."""
    return read_as(lattice(words_of(text)), decimal, thousands == " ")


def month_number(word: Column) -> Column:
    """1 to 12 of a month's name, short or long; 0 of three letters of which one was misread; null if it is none."""
    names = F.array(*[F.lit(m) for m in MONTHS])

    def read(w: Column) -> Column:
        place = F.array_position(names, F.substring(w, 1, 3)).cast("int")
        wrong = lambda m: F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.lit(0), lambda n, k: n + (F.substr(w, k, F.lit(1)) != F.substr(m, k, F.lit(1))).cast("int"))
        named = (place > 0) & ((F.length(w) <= 4) | w.isin(*LONG_MONTHS))
        return F.when(named, place).when((F.length(w) == 3) & F.exists(names, lambda m: wrong(m) <= 1), 0)

    return let(F.lower(word), read)


def date_head(text: Column, units: int) -> Column:
    """(raw, u, g) of the first two or three units of a line: the units and what stands between them; null where the line does not begin so."""
    whole = r"^\W{0,3}" + _BETWEEN.join([_UNIT] * units) + r"(?=\s|$)"
    cut = _CUT.join(f"${k}" for k in range(1, 2 * units))

    def parts(raw: Column) -> Column:
        return let(F.split(F.regexp_replace(raw, whole, cut), _CUT), lambda x: F.struct(F.trim(raw).alias("raw"), F.filter(x, lambda _, k: k % 2 == 0).alias("u"), F.filter(x, lambda _, k: k % 2 == 1).alias("g")))

    return let(F.regexp_extract(text, whole, 0), lambda raw: F.when(raw != "", parts(raw)))


def dates_of(text: Column) -> Column:
    """What a line's head makes as each kind of date, in the order of DATE_KINDS: (day_first, month_first), each (raw, day, month, year) or null.

    day and month are null where a date is printed that no calendar has, or whose
    month was misread; year where none is printed. The two differ only for kinds
    of which day and month may stand the other way round.
    """

    def real(d: Column, m: Column, y: Column, raw: Column) -> Column:
        # Without a year the 29th of February is a day. No parser is asked: what is no date would be an exception each time.
        of = F.coalesce(y, F.lit(2000))
        leap = (of % 4 == 0) & ((of % 100 != 0) | (of % 400 == 0))
        last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        there = m.between(1, 12) & d.between(F.lit(1), last) & of.between(1000, 9999)
        return F.struct(raw.alias("raw"), F.when(there, d).alias("day"), F.when(there, m).alias("month"), y.alias("year"))

    def as_kind(letters: str) -> Column:
        gaps = _gaps(letters)

        def read(h: Column) -> Column:
            at = lambda letter: F.get(h["u"], F.lit(letters.index(letter)))
            number = lambda t: t.try_cast("int")
            month = F.when(at("N").rlike("^[A-Za-z]"), month_number(at("N"))) if "N" in letters else F.when(F.length(at("M")) <= 2, number(at("M")))
            year = F.lit(None).cast("int")
            if "Y" in letters:
                sizes = (4,) if letters in ("YMD", "NDY") else (2, 4)
                year = F.when(F.length(at("Y")).isin(*sizes), let(number(at("Y")), lambda n: F.when(n < 100, n + 2000).otherwise(n)))
            parted = reduce(Column.__and__, [F.get(h["g"], F.lit(k)).rlike(f"^{g}$") for k, g in enumerate(gaps)])
            return F.struct(parted.alias("parted"), F.when(F.length(at("D")) <= 2, number(at("D"))).alias("d"), month.alias("m"), year.alias("y"), h["raw"].alias("raw"))

        def both(x: Column) -> Column:
            plain = real(x["d"], x["m"], x["y"], x["raw"])
            other = real(x["m"], x["d"], x["y"], x["raw"]) if letters in ("DMY", "DM") else plain
            fits = x["parted"] & x["d"].isNotNull() & x["m"].isNotNull() & (F.lit("Y" not in letters) | x["y"].isNotNull())
            return F.when(fits, F.struct(plain.alias("day_first"), other.alias("month_first")))

        # A pattern that every date of the kind fits; the head is cut for those lines alone.
        years = r"\d{4}" if letters in ("YMD", "NDY") else r"(?:\d{4}|\d{2})"
        unit = {"D": r"\d{1,2}", "M": r"\d{1,2}", "N": "[A-Za-z]{3,9}", "Y": years}
        shape = "".join(unit[letter] + gap for letter, gap in zip(letters, [*gaps, ""], strict=True))
        return F.when(text.rlike(rf"^\W{{0,3}}{shape}(?=\s|$)"), let(let(date_head(text, len(letters)), read), both))

    return F.array(*[as_kind(letters) for letters in DATE_KINDS.values()])


def _gaps(letters: str) -> list[str]:
    """What may stand between a kind's units, as patterns."""

    def gap(pair: str) -> str:
        if "N" in pair:
            return "[-., ]{0,2}"
        return "[-,. ]{1,2}" if "N" in letters else "[-/.]" if len(letters) == 3 else "/"

    return [gap(letters[k : k + 2]) for k in range(len(letters) - 1)]


def date_parts(text: Column, kind: str, month_first: bool = False) -> Column:
    """The date that a line begins with, if it is of this kind."""
    return F.get(dates_of(text), F.lit(list(DATE_KINDS).index(kind)))["month_first" if month_first else "day_first"]
