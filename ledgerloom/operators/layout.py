"""Statements of unknown layout: styles by counting, columns by what makes the running balance add up.

A line is cut once into words, its figures with all their readings, and the dates that
it can begin with. A statement's decimal mark and kind of date are what most of its
lines use. Which figure is the amount, which the fee and which the balance is found along
the balance, line after line, statement by statement (see beam).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.dates import date_in_period
from ..functions.figures import DATE_KINDS, plain_words, token_sign
from ..functions.money import cents, from_cents
from ..functions.text import phrases_pattern
from ..sources.stored import stored
from .beam import read_statements
from .chain import continuation_lines, link_entry_lines, listed_lines, stands_alone
from .lines import cut_lines
from .whole import by_statement

MONEY = "decimal(18,2)"
#: Phrases of lines that open a balance, of those that close one, of those that are no transactions, and of headings of lists.
OPENING_PHRASES = ("opening balance", "brought forward", "balance b/f", "balance bf", "b/fwd", "balance forward", "previous balance", "balance at start", "start balance", "starting balance")
CLOSING_PHRASES = ("closing balance", "carried forward", "balance c/f", "balance cf", "c/fwd", "balance at end", "end balance", "ending balance", "new balance")
OTHER_PHRASES = ("total", "totals", "turnover", "summary", "available balance", "interest rate")
LIST_PHRASES = ("pending", "scheduled", "upcoming", "future", "subscription", "subscriptions", "debit orders", "standing orders", "recurring", "not yet processed", "not yet cleared", "authorised", "authorisations")
OPENING, CLOSING, NO_ROW, LIST_HEADING = (phrases_pattern(p) for p in (OPENING_PHRASES, CLOSING_PHRASES, OTHER_PHRASES, LIST_PHRASES))
#: Kinds whose day and month may stand the other way round.
_DAY_MONTH = ("dmy", "dm")
#: A description goes on over so many lines, none longer than this.
MORE_LINES, LONGEST = 2, 70


def statement_styles(lines: DataFrame, by: list[str], order: str = "line_no") -> DataFrame:
    """(by, decimal, spaced, kind, month_first): how each statement prints figures and dates.

    A decimal comma needs more figures than the point has; spaced says that
    thousands are set apart by blanks. Only lines with a figure vote on the kind
    of date; ties go to the kind named first. Months come first if more lines can
    only be read so than only the other way.
    """
    return styles_of(cut_lines(lines, by, order), by).drop("grouped")


def styles_of(parsed: DataFrame, by: list[str]) -> DataFrame:
    """statement_styles of parsed lines, and whether a statement groups thousands by a mark."""
    return _styles(parsed.groupBy(*by).agg(*[c.alias(n) for n, c in _style_counts().items()]), [F.col(c) for c in by])


def _style_counts() -> dict[str, Column]:
    """What is counted over a statement's lines to tell its style."""
    with_mark = lambda m: F.size(F.filter("tokens", lambda t: t["mark"] == m))
    has = F.size("tokens") > 0
    some = lambda test: F.when(test, 1).otherwise(0)
    as_kind = lambda k: F.col("dates")[list(DATE_KINDS).index(k)]
    first, second = (lambda k: as_kind(k)["day_first"]["day"]), (lambda k: as_kind(k)["month_first"]["day"])
    return {
        "points": F.sum(with_mark(".")),
        "commas": F.sum(with_mark(",")),
        "spaces": F.count_if(F.exists("tokens", lambda t: t["joined"].isNotNull())),
        "n_grouped": F.count_if(F.exists("tokens", lambda t: t["grouped"])),
        **{f"n_{k}": F.count_if(has & (as_kind(k).isNotNull() if k in _DAY_MONTH else first(k).isNotNull())) for k in DATE_KINDS},
        "months": F.sum(sum((some(has & first(k).isNull() & second(k).isNotNull()) for k in _DAY_MONTH), F.lit(0))),
        "days": F.sum(sum((some(has & (first(k) > 12)) for k in _DAY_MONTH), F.lit(0))),
    }


def _styles(counts: DataFrame, kept: list[Column]) -> DataFrame:
    """kept and the style that the counts say."""
    best = F.array_max(F.array(*[F.struct(F.col(f"n_{k}").alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(DATE_KINDS)]))
    return counts.select(
        *kept,
        F.when(F.col("commas") > F.col("points"), ",").otherwise(".").alias("decimal"),
        ((F.col("spaces") > 0) & (F.col("n_grouped") == 0)).alias("spaced"),
        F.when(best["n"] > 0, best["kind"]).alias("kind"),
        (F.col("months") > F.col("days")).alias("month_first"),
        (F.col("n_grouped") > 0).alias("grouped"),
    )


def _styled(parsed: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, order, text, words, decimal, kind, at, after, tokens): the date of the statement's kind that a line begins with, the first word after it, and the figures behind with what the statement allows."""
    kinds = F.array(*[F.lit(k) for k in DATE_KINDS])
    # Counted over windows that all later ones share, so that a statement's lines are shuffled and sorted once.
    counts = parsed.select("*", *[c.over(_whole(by, order)).alias(f"{n}") for n, c in _style_counts().items()])
    p = _styles(counts, [F.col(c) for c in (*by, order, "text", "words", "tokens", "dates")])
    p = p.withColumn("at", F.get("dates", F.array_position(kinds, F.col("kind")).cast("int") - 1))
    p = p.withColumn("at", F.when(F.col("month_first"), F.col("at.month_first")).otherwise(F.col("at.day_first")))
    p = p.withColumn("after", F.coalesce(F.size(F.split("at.raw", r"\s+")), F.lit(0)))
    behind = lambda x: x["first"] >= F.col("after")
    of_style = F.filter("tokens", lambda t: (t["mark"] == F.col("decimal")) & behind(t))
    joined = lambda t: F.when(~F.col("grouped") & behind(t["joined"]), t["joined"])
    return p.select(*by, order, "text", "words", "decimal", "kind", "at", "after", F.transform(of_style, lambda t: t.withField("joined", joined(t))).alias("tokens"))


def _whole(by: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _values(tokens: Column) -> Column:
    """Both readings of the line's last figure, with the sign that it has."""
    t = F.try_element_at(tokens, F.lit(-1))
    value = lambda v, out: F.when(out, -v).otherwise(v).cast(MONEY)
    return F.array_compact(F.array(value(t["joined"]["value"], t["joined"]["out"]), value(t["value"], t["out"])))


def read_unknown(lines: DataFrame, by: list[str], order: str = "line_no", bounds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, statements) of lines (by, order, text; or as cut_lines gives them) in a layout that nobody has named.

    bounds: by, period_start, period_end, for dates without a year. rows: by, seq,
    date, date_text, description, debit, credit, unassigned, balance, evidence,
    confirmed, ambiguous. A row is confirmed and goes the way in which it leads, with
    the amounts without a balance before it, from the balance before to its own, if
    there is one way only (ambiguous: more do). Any other is kept as printed: by
    its mark, or by the statement's own convention (only credits marked: unmarked is out;
    only debits marked: unmarked is in), else unassigned. A fee becomes a row after its own.
    An undated line with figures under a dated one without belongs to that; dated lines
    of a list under a heading are rows only where the balance needs them; a description goes on over two lines.
    statements: by, decimal, kind, n_rows, n_confirmed, opening, closings. A
    statement without dated lines of figures has no rows.
    """
    parsed = lines if "tokens" in lines.columns else stored(cut_lines(lines, by, order))
    n = F.size("tokens")
    p = _styled(parsed.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in by])), by, order)
    p = link_entry_lines(p.withColumn("line_date", F.col("at")).withColumn("n_figures", n), by, [order], said="words").drop("line_date", "n_figures")
    p = p.withColumn("is_head", F.col("text").rlike(OPENING)).withColumn("is_close", F.col("text").rlike(CLOSING))
    dated = F.col("entry_date").isNotNull()
    row = (n > 0) & ~F.col("is_head") & ~F.col("is_close") & ~F.col("text").rlike(NO_ROW)
    p = p.withColumn("row", row).withColumn("dated", dated).withColumn("single", row & dated & (n == 1)).withColumn("is_heading", F.col("text").rlike(LIST_HEADING)).withColumn("is_blank", F.lit(False))
    p = listed_lines(p, by, [order])
    p = continuation_lines(p.withColumn("said", F.when(F.col("row") & dated, "").otherwise(F.col("text"))).withColumn("is_row", F.col("row") & dated).withColumn("is_blocked", stands_alone(F.col("text")) | F.col("is_heading")), by, [order], LONGEST, MORE_LINES, "said")
    w = Window.partitionBy(*by).orderBy(order)
    p = p.withColumn("seen", F.count_if(F.col("row") & dated).over(w))
    sign = token_sign(F.try_element_at("tokens", F.lit(1)))
    marks = lambda c: F.exists("tokens", lambda t: t[c])
    on_row = F.col("row") & dated
    about = {
        "openings": F.min_by(_values(F.col("tokens")), F.when(F.col("is_head") & (n > 0) & (F.col("seen") == 0), F.col(order))),
        "closings": F.collect_list(F.when(F.col("is_close") & (n > 0), _values(F.col("tokens")))),
        "n_cr": F.count_if(on_row & (sign == 1)),
        "n_dr": F.count_if(on_row & (sign == -1)),
        "n_in": F.count_if(on_row & marks("marked_in")),
        "n_out": F.count_if(on_row & marks("out")),
    }
    p = p.select("*", *[c.over(_whole(by, order)).alias(f"__{name}") for name, c in about.items()])
    p = p.withColumn("__openings", F.coalesce("__openings", F.array().cast(f"array<{MONEY}>"))).withColumn("__closings", F.array_distinct(F.flatten("__closings")))
    convention = F.when((F.col("__n_cr") > 0) & (F.col("__n_dr") == 0), -1).when((F.col("__n_dr") > 0) & (F.col("__n_cr") == 0), 1)
    # What the search needs are small numbers; of many figures the last five can be columns.
    in_cents = lambda c: F.transform(c, cents)
    last = F.when(n > 5, F.slice("tokens", F.greatest(n - 4, F.lit(1)), F.lit(5))).otherwise(F.col("tokens"))
    figure = lambda t, j: F.struct(
        t["first"].alias("first"), cents(t["value"]).alias("value"), token_sign(t).cast("tinyint").alias("sign"),
        j["first"].alias("joined_first"), cents(j["value"]).alias("joined_value"), F.when(j["out"], -1).when(t["marked_in"], 1).cast("tinyint").alias("joined_sign"),
    )
    entry = F.array_join(F.slice("entry_said", F.size(F.split("entry_date.raw", r"\s+")) + 1, 1 << 20), " ")
    keep = [*by, order, "text", "entry_date", "after", "entry", "full_description"]
    given = p.where("row").select(
        *by, order, "text", "entry_date", "after", entry.alias("entry"), "full_description", "dated", "listed", F.transform(last, lambda t: figure(t, t["joined"])).alias("tokens"),
        convention.alias("unmarked"), ((F.col("__n_in") > 0) & (F.col("__n_out") == 0)).alias("flips"), in_cents("__openings").alias("openings"), in_cents("__closings").alias("closings"),
    )
    kinds = dict(given.dtypes)
    added = "amount long, first_word int, fee long, balance long, way int, confirmed boolean, ambiguous boolean, start long"
    rows = by_statement(given, by, [order], lambda t, starts: read_statements(t, starts, keep), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + added)
    if bounds is not None:
        rows = rows.join(bounds.select(*by, "period_start", "period_end"), by, "left")
        guess = date_in_period(F.col("entry_date.day"), F.col("entry_date.month"), F.col("period_start"), F.col("period_end"))
    else:
        guess = F.lit(None).cast("date")
    made = F.try_to_date(F.concat_ws("-", F.col("entry_date.year").cast("string"), F.col("entry_date.month").cast("string"), F.col("entry_date.day").cast("string")), "yyyy-M-d")
    day = F.when(F.col("entry_date.day").isNotNull(), F.when(F.col("entry_date.year").isNotNull(), made).otherwise(guess))
    own = F.array_join(F.slice(plain_words(F.col("text")), F.col("after") + 1, F.greatest(F.col("first_word") - F.col("after"), F.lit(0))), " ")
    said = F.concat_ws(" ", *[F.nullif(F.trim(x), F.lit("")) for x in (F.when(own == "", F.col("entry")), own, F.col("full_description"))])
    money = lambda c: from_cents(F.col(c))
    rows = rows.select(*by, order, "text", "confirmed", "ambiguous", "way", "start", day.alias("date"), F.col("entry_date.raw").alias("date_text"), F.coalesce(F.nullif(said, F.lit("")), F.lit("(no description)")).alias("description"), *[money(c).alias(c) for c in ("amount", "fee", "balance")])
    size, none = F.col("amount"), F.lit(None).cast(MONEY)
    part = lambda k, text, debit, credit, left, balance: F.struct(F.lit(k).alias("sub"), text.alias("description"), debit.alias("debit"), credit.alias("credit"), left.alias("unassigned"), balance.alias("balance"))
    has_fee = F.col("fee") != 0
    main = F.when(size != 0, part(0, F.col("description"), F.when(F.col("way") == -1, size), F.when(F.col("way") == 1, size), F.when(F.col("way").isNull(), size), F.when(~has_fee, F.col("balance"))))
    extra = F.when(has_fee, part(1, F.concat(F.lit("Fee: "), "description"), F.when(F.col("fee") > 0, F.col("fee")), F.when(F.col("fee") < 0, -F.col("fee")), none, F.col("balance")))
    out = rows.select(*by, order, "date", "date_text", F.col("text").alias("evidence"), "confirmed", "ambiguous", "start", F.explode(F.array_compact(F.array(main, extra))).alias("r"))
    out = out.select(*by, (F.col(order) * 2 + F.col("r.sub")).cast("bigint").alias("seq"), "date", "date_text", "r.description", "r.debit", "r.credit", "r.unassigned", "r.balance", "evidence", "confirmed", "ambiguous", "start")
    out = stored(out)
    found = out.groupBy(*by).agg(F.max(money("start")).alias("start"), F.count(F.lit(1)).alias("n_rows"), F.count_if("confirmed").alias("n_confirmed"))
    heads = p.groupBy(*by).agg(F.first("__openings").alias("openings"), F.first("__closings").alias("closings"))
    statements = styles_of(parsed, by).select(*by, "decimal", "kind").join(heads.select(*by, F.get("openings", F.lit(-1) + F.size("openings")).alias("printed"), "closings"), by, "left").join(found, by, "left")
    zero = F.lit(0).cast("bigint")
    return out.drop("start"), statements.select(*by, "decimal", "kind", F.coalesce("start", "printed").alias("opening"), F.coalesce("closings", F.array().cast(f"array<{MONEY}>")).alias("closings"), F.coalesce("n_rows", zero).alias("n_rows"), F.coalesce("n_confirmed", zero).alias("n_confirmed"))
