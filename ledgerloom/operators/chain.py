"""Operators that follow the order of rows: balance chains, repeats, dates, months, segments.

Every window is partitioned (by account, statement, file) and ordered by columns
that the caller names; none runs over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import missing_pages, page_numbers, phrases_pattern

#: Words of lines that are about the statement, and no part of a description.
ALONE_WORDS = ("balance", "brought forward", "carried forward", "total", "totals", "page", "statement", "account", "date", "description", "amount", "debit", "credit", "vat", "continued")
ALONE = phrases_pattern(ALONE_WORDS)


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast("decimal(18,2)"))


def _before(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def balance_chain(rows: DataFrame, by: list[str], order: list[str], opening: str | None = None) -> DataFrame:
    """Adds expected, missing (balance - expected), breaks and after_date.

    A row's expected balance is the balance printed on the row before it (for the
    first row, the column `opening`, if there is one) plus money in less money
    out. It is unknown after a row without a balance. breaks: both are known and
    differ. The next row follows from the printed balance, so an error shows once.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1
    before = F.lag("balance").over(w)
    if opening:
        before = F.when(first, F.col(opening)).otherwise(before)
    out = rows.withColumn("expected", (before + _zero("credit") - _zero("debit")).cast("decimal(18,2)"))
    out = out.withColumn("missing", (F.col("balance") - F.col("expected")).cast("decimal(18,2)"))
    return out.withColumn("breaks", F.coalesce(F.col("missing") != 0, F.lit(False))).withColumn("after_date", F.lag("date").over(w))


def balance_gaps(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The breaks of each account's chain: between which dates how much is missing."""
    broken = balance_chain(rows, by, order).where("breaks")
    return broken.select(*by, "after_date", F.col("date").alias("at_date"), "seq", "description", "expected", F.col("balance").alias("actual"), "missing")


def flag_duplicates(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds duplicate: the same date, words and amounts as a row before it, and nothing to tell them apart.

    The nearest such row counts: its evidence (the printed line) is the same, or
    the two do not both have evidence and their balances are equal or not both there.
    """
    same = Window.partitionBy(*by, "date", "description", "debit", "credit", "unassigned").orderBy(*order)
    rows = rows.withColumn("__o", F.lag(F.struct(F.lit(1).alias("there"), F.col("evidence").alias("evidence"), F.col("balance").alias("balance"))).over(same))
    told, told_before = F.coalesce(F.col("evidence"), F.lit("")) != "", F.coalesce(F.col("__o.evidence"), F.lit("")) != ""
    one_line = told & F.col("evidence").eqNullSafe(F.col("__o.evidence"))
    other_line = told & told_before & ~one_line
    alike = F.col("balance").isNull() | F.col("__o.balance").isNull() | (F.col("balance") == F.col("__o.balance"))
    return rows.withColumn("duplicate", F.col("__o").isNotNull() & (one_line | (~other_line & F.coalesce(alike, F.lit(False))))).drop("__o")


def flag_date_order(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds out_of_order: against the statement's own direction, judged by the dated row before.

    A statement ascends if at least as many neighbouring dates do not fall as do not rise.
    """
    rows = rows.withColumn("__p", F.last("date", ignorenulls=True).over(_before(by, order)))
    whole = Window.partitionBy(*by)
    rising = F.count_if(F.col("__p") <= F.col("date")).over(whole) >= F.count_if(F.col("__p") >= F.col("date")).over(whole)
    wrong = F.when(rising, F.col("date") < F.col("__p")).otherwise(F.col("date") > F.col("__p"))
    return rows.withColumn("out_of_order", F.coalesce(wrong, F.lit(False))).drop("__p")


def month_balances(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, month, opening, closing): each month opens with the closing carried over from the months before.

    The first month opens with its first balanced row worked back over that row
    alone. closing: the month's last printed balance, null without one.
    """
    place = F.struct(*order)
    has = F.col("balance").isNotNull()
    first = F.struct(place.alias("p"), (F.col("balance") + _zero("debit") - _zero("credit")).cast("decimal(18,2)").alias("v"))
    months = rows.where("month is not null").groupBy(*by, "month").agg(F.min(F.when(has, first)).alias("f"), F.max_by("balance", F.when(has, place)).alias("last"))
    w = Window.partitionBy(*by).orderBy("month")
    carried = F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opening = F.coalesce(carried, F.first(F.col("f.v"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return months.select(*by, "month", opening.alias("opening"), F.col("last").alias("closing"))


def opening_closing(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, opening, closing) of each group, the rows before the first balanced one worked back as well."""
    w = Window.partitionBy(*by).orderBy(*order)
    seen = F.count("balance").over(w)
    early = F.when(seen == 0, _zero("debit") - _zero("credit")).otherwise(0)
    start = F.when((seen == 1) & F.col("balance").isNotNull(), F.col("balance") + _zero("debit") - _zero("credit"))
    rows = rows.select(*by, early.alias("e"), start.alias("s"), "balance", F.struct(*order).alias("p"))
    out = rows.groupBy(*by).agg(F.max("s").alias("s"), F.sum("e").alias("e"), F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("p"))).alias("closing"))
    return out.select(*by, (F.col("s") + F.col("e")).cast("decimal(18,2)").alias("opening"), "closing")


def confirm_groups(rows: DataFrame, by: list[str], order: list[str], most: int = 10, opening: str | None = None) -> DataFrame:
    """Signs of amounts that a sheet doesn't say, by the next printed balance.

    rows: amount (0 or more), sign (1, -1 or null), balance. Rows without a balance
    wait for the next one; the group is confirmed together: of all ways to give the
    unknown signs, one alone must lead from the balance before to this one. Adds
    group_id, fits (how many ways do) and resolved_sign; more than `most` unknown
    signs are a misfit (fits 0). Before the first printed balance stands that of
    the column `opening`, if there is one. The search is an expression over 2^unknown masks,
    bounded by `most`.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("group_id", F.count("balance").over(_before(by, order)).cast("bigint"))
    before = F.last("balance", ignorenulls=True).over(_before(by, order))
    before = F.coalesce(before, opening) if opening else before
    rows = rows.withColumn("__before", before).withColumn("__pos", F.row_number().over(w))
    parts = F.array_sort(F.collect_list(F.struct(F.col("__pos").alias("pos"), F.col("amount").cast("decimal(18,2)").alias("amount"), F.col("sign").cast("int").alias("sign"))))
    groups = rows.groupBy(*by, "group_id").agg(parts.alias("parts"), F.min_by("__before", "__pos").alias("before"), F.max("balance").alias("balance"))
    open_ = F.filter("parts", lambda p: p["sign"].isNull())
    known = F.aggregate(F.filter("parts", lambda p: p["sign"].isNotNull()), F.lit(0).cast("decimal(28,2)"), lambda s, p: (s + p["amount"] * p["sign"]).cast("decimal(28,2)"))
    groups = groups.select(*by, "group_id", "before", "balance", known.alias("known"), open_.alias("open")).withColumn("need", F.col("balance") - F.col("before") - F.col("known"))
    masks = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.least(F.size("open"), F.lit(most))) - 1)
    total = lambda m: F.aggregate(F.transform("open", lambda p, i: F.when(F.getbit(m, i) == 1, p["amount"]).otherwise(-p["amount"])), F.lit(0).cast("decimal(28,2)"), lambda s, a: (s + a).cast("decimal(28,2)"))
    ways = F.when(F.size("open") <= most, F.filter(masks, lambda m: total(m) == F.col("need"))).otherwise(F.array().cast("array<int>"))
    groups = groups.withColumn("ways", ways)
    signs = F.when(F.size("ways") == 1, F.map_from_entries(F.transform("open", lambda p, i: F.struct(p["pos"], F.when(F.getbit(F.col("ways")[0], i) == 1, 1).otherwise(-1)))))
    groups = groups.select(*by, "group_id", F.size("ways").alias("fits"), signs.alias("__signs"))
    out = rows.join(groups, [*by, "group_id"])
    return out.withColumn("resolved_sign", F.coalesce(F.col("sign").cast("int"), F.try_element_at("__signs", F.col("__pos")))).drop("__before", "__pos", "__signs")


def link_entry_lines(lines: DataFrame, by: list[str], order: list[str], said: str | None = None) -> DataFrame:
    """Adds entry_date: an undated line of two figures or more takes the date of the dated line of one at most before it.

    lines: text, line_date, n_figures; blank lines don't count as lines between. said: a
    column that such a line takes from the line before as well, as entry_said.
    """
    full = lines.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.lag(F.struct("line_date", "n_figures", *([said] if said else []))).over(w)
    follows = (F.col("n_figures") >= 2) & (before["n_figures"] <= 1)
    out = full.withColumn("entry_date", F.coalesce("line_date", F.when(follows, before["line_date"])))
    return out.withColumn("entry_said", F.when(follows & F.col("line_date").isNull() & before["line_date"].isNotNull(), before[said])) if said else out


def page_segments(pages: DataFrame, by: list[str], order: list[str], period: str = "period") -> DataFrame:
    """Adds segment (0, 1, ...): a page that prints another period than the last one printed begins a new statement."""
    last = F.last(period, ignorenulls=True).over(_before(by, order))
    changed = F.coalesce(F.col(period) != last, F.lit(False))
    w = Window.partitionBy(*by).orderBy(*order)
    return pages.withColumn("__new", changed.cast("int")).withColumn("segment", F.sum("__new").over(w).cast("bigint")).drop("__new")


def stands_alone(text: Column) -> Column:
    """Whether a line is nothing that a description goes on in: blank, with money or a date, or about balances, totals or pages."""
    return (F.trim(text) == "") | text.rlike(r"\d[.,]\d\d\b") | text.rlike(r"^\W{0,3}\d{1,4}[-/. ](?:\d|[A-Za-z]{3})") | text.rlike(ALONE)


def continuation_lines(lines: DataFrame, by: list[str], order: list[str], longest: int = 60, most: int = 1, said: str = "description") -> DataFrame:
    """Adds full_description: a transaction line's text (column `said`) with up to `most` following lines that are nothing of their own.

    lines: is_row, is_blocked (as stands_alone says it); a line that is longer than `longest` is none either.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    parts, open_ = [F.col(said)], F.lit(True)
    for k in range(1, most + 1):
        nxt = F.lead(F.struct(F.col(said).alias("said"), "is_row", "is_blocked"), k).over(w)
        open_ = open_ & F.coalesce(~nxt["is_row"] & ~nxt["is_blocked"] & (F.length(nxt["said"]) <= longest), F.lit(False))
        parts.append(F.when(open_, nxt["said"]))
    return lines.withColumn("full_description", F.when(F.col("is_row"), F.concat_ws(" ", *parts)))


def listed_lines(lines: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds listed: in a run of dated lines of one amount that stands right under a list heading.

    lines: single (dated, one amount), is_heading, is_blank.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    lines = lines.withColumn("__run", F.sum((~F.col("single")).cast("int")).over(w))
    heads = F.last(F.when(~F.col("is_blank") & ~F.col("single"), F.col("is_heading")), ignorenulls=True).over(w)
    return lines.withColumn("listed", F.col("single") & F.coalesce(heads, F.lit(False))).drop("__run")


def skipped_lines(lines: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, n_skipped, examples): lines that look like transactions after the first read one, but were not read.

    lines: text, is_row, looks_like_row. The first three are given as examples.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    seen = lines.withColumn("__n", F.count_if(F.col("is_row")).over(w)).where("__n > 0 and looks_like_row and not is_row")
    ranked = seen.withColumn("__k", F.row_number().over(w))
    some = F.array_sort(F.collect_list(F.when(F.col("__k") <= 3, F.struct("__k", F.substring("text", 1, 60).alias("t")))))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_skipped"), some.alias("e")).select(*by, "n_skipped", F.transform("e", lambda x: x["t"]).alias("examples"))


def pages_missing(pages: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, missing): page numbers that 'page k of n' says there are and no page has."""
    found = pages.groupBy(*by).agg(pages_found(text).alias("p"))
    return found.select(*by, missing_pages(F.col("p")).alias("missing"))


def pages_found(text: str = "text") -> Column:
    """All that a group's texts say about pages, as one aggregate."""
    found = page_numbers(F.col(text))
    return F.flatten(F.collect_list(F.when(F.size(found) > 0, found)))


def reference_numbers(rows: DataFrame, by: list[str], order: list[str], prefix: Column) -> DataFrame:
    """Adds reference: the prefix and a number from 01 in each group."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("reference", F.concat(prefix, F.when(n < 100, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))))
