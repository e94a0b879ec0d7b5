"""From lines of statement text to a ledger: every reading of every statement, checked, the best one kept."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_key, period_range
from ..functions.money import MONEY, parse_amount
from ..functions.text import garbled_figures, missing_pages
from ..operators.assess import assess, choose_reading, confirm_by_second, finalize, printed_total
from ..operators.chain import page_segments, pages_found
from ..operators.layout import read_unknown
from ..operators.lines import LineFormat, cut_lines, read_lines
from ..operators.rule_table import bank_patterns
from ..operators.rules import UNMAPPED, Category, categorize, detect_bank, match_client, vat_default
from ..schema import as_ledger
from ..sources.stored import stored

_FIGURE = r"(-?\s?R?\s?\d[\d ,.]*\d)"


@dataclass(frozen=True)
class Patterns:
    """What a statement prints about itself; of a field's patterns the first that matches anywhere counts."""

    account: tuple[str, ...] = (r"(?i)account (?:number|no\.?):?\s*([\d -]{5,})",)
    period: tuple[str, ...] = (r"(?i)statement period:?\s*(.+? to .+)$",)
    debits: tuple[str, ...] = (rf"(?i)total (?:debits|money out|payments):?\s*{_FIGURE}",)
    credits: tuple[str, ...] = (rf"(?i)total (?:credits|money in|deposits):?\s*{_FIGURE}",)
    fees: tuple[str, ...] = (rf"(?i)total (?:fees|charges):?\s*{_FIGURE}",)
    closing: tuple[str, ...] = (rf"(?i)closing balance:?\s*{_FIGURE}",)
    banks: tuple[tuple[str, tuple[str, ...]], ...] = ()
    clients: tuple[tuple[str, tuple[str, ...]], ...] = ()
    #: Tables of banks' needles and of patterns by bank (see rule_table), in the place of the lists above.
    bank_table: DataFrame | None = None
    pattern_table: DataFrame | None = None


def _first(patterns: tuple[str, ...], order: str) -> Column:
    """What the first pattern that any line has captures, from the first such line."""
    found = [F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("k"), F.col(order).cast("bigint").alias("o"), F.regexp_extract("text", p, 1).alias("v"))) for k, p in enumerate(patterns)]
    return F.min(F.coalesce(*found))["v"]


def _every(patterns: tuple[str, ...]) -> Column:
    """What the first pattern that any line has captures in all lines, as amounts."""
    found = [F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("k"), parse_amount(F.regexp_extract("text", p, 1)).alias("v"))) for k, p in enumerate(patterns)]
    all_ = F.array_compact(F.collect_list(F.coalesce(*found)))
    first = F.array_min(F.transform(F.filter(all_, lambda x: x["v"].isNotNull()), lambda x: x["k"]))
    return F.transform(F.filter(all_, lambda x: (x["k"] == first) & x["v"].isNotNull()), lambda x: F.abs(x["v"]))


def with_totals(statements: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """statements with printed_debits, printed_credits and printed_fees out of all that is printed; a grand total counts if it is what was read."""
    read = rows.groupBy(*by).agg(*[F.sum(c).cast(MONEY).alias(f"__{c}") for c in ("debit", "credit")])
    s = statements.join(read, by, "left")
    none = F.lit(None).cast(MONEY)
    return s.select("*", *[printed_total(F.col(f"all_{n}"), of).alias(f"printed_{n}") for n, of in (("debits", F.col("__debit")), ("credits", F.col("__credit")), ("fees", none))]).drop("__debit", "__credit", "all_debits", "all_credits", "all_fees")


def statement_facts(lines: DataFrame, by: list[str], order: str = "line_no", patterns: Patterns = Patterns()) -> DataFrame:
    """(by, account_number, period_start, period_end, all printed totals, closings, missing_pages, bank, client).

    With tables of patterns the bank that a statement names has its own first, then come
    those of all banks; else one aggregation over the lines with the same list for every bank.
    """
    hit = lambda rules, of: F.min(F.coalesce(*[F.when(of == name, F.struct(F.lit(k).alias("k"), F.lit(name).alias("v"))) for k, (name, _) in enumerate(rules)], F.lit(None)))["v"]
    nothing = F.first(F.lit(None).cast("string"))
    client = (hit(patterns.clients, match_client([F.col("text")], list(patterns.clients))) if patterns.clients else nothing).alias("__client")
    totals = ("debits", "credits", "fees")
    if patterns.pattern_table is not None:
        found = bank_patterns(lines, by, order, patterns.bank_table, patterns.pattern_table)
        values = lambda field: F.coalesce(F.try_element_at("found", F.lit(field)), F.array().cast("array<string>"))
        amounts = lambda field: F.array_compact(F.transform(values(field), parse_amount))
        got = found.select(
            *by, F.get(values("account"), F.lit(0)).alias("account_number"), F.get(values("period"), F.lit(0)).alias("statement_period"),
            *[F.transform(amounts(n), lambda x: F.abs(x)).alias(f"all_{n}") for n in totals], amounts("closing").alias("closings"), "bank",
        )
        got = got.join(lines.groupBy(*by).agg(client, pages_found().alias("__pages")), by)
    else:
        closing = [F.when(F.col("text").rlike(p), parse_amount(F.regexp_extract("text", p, 1))) for p in patterns.closing]
        got = lines.groupBy(*by).agg(
            _first(patterns.account, order).alias("account_number"),
            _first(patterns.period, order).alias("statement_period"),
            *[_every(getattr(patterns, n)).alias(f"all_{n}") for n in totals],
            F.array_compact(F.collect_list(F.coalesce(*closing))).alias("closings"),
            (hit(patterns.banks, detect_bank(F.col("text"), list(patterns.banks))) if patterns.banks else nothing).alias("bank"),
            client,
            pages_found().alias("__pages"),
        )
    span = period_range(F.col("statement_period"))
    got = got.select(
        *by, F.nullif(F.regexp_replace("account_number", r"\D", ""), F.lit("")).alias("account_number"), "statement_period", span["start"].alias("period_start"), span["end"].alias("period_end"),
        *[f"all_{n}" for n in totals], F.lit(None).cast(MONEY).alias("printed_closing"), "closings", "bank", F.coalesce("__client", F.lit(UNMAPPED)).alias("client"),
        missing_pages(F.col("__pages")).alias("missing_pages"),
    )
    # A statement without a name is none.
    return got.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in by]))


def all_readings(lines: DataFrame, formats: list[LineFormat], by: list[str], order: str = "line_no", bounds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, heads) of each format and of the reader of unknown layouts, told apart by `reading`."""
    cut = cut_lines(lines, by, order)
    lines = cut if cut is lines else stored(cut)
    rows, heads = [], []
    columns = [*by, "seq", "date", "date_text", "description", "debit", "credit", "unassigned", "balance", "evidence"]
    for k, fmt in enumerate(formats):
        r, h = read_lines(lines, fmt, by, order)
        rows.append(r.select(*columns, F.lit(k).alias("reading")))
        heads.append(h.select(*by, "opening", "n_skipped", F.lit(k).alias("reading")))
    r, h = read_unknown(lines, by, order, bounds)
    rows.append(r.select(*columns, F.lit(len(formats)).alias("reading")))
    heads.append(h.select(*by, "opening", F.lit(0).cast("bigint").alias("n_skipped"), F.lit(len(formats)).alias("reading")))
    return reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, heads)


def split_statements(lines: DataFrame, by: list[str], page: str = "page", order: str = "line_no", patterns: Patterns = Patterns()) -> DataFrame:
    """Adds statement: a file's name, and where its pages print several periods, which of them a line is of.

    by: one column, the file. A page that prints another period than the one last
    printed begins a new statement; pages without one belong to that before.
    """
    (name,) = by
    pages = lines.groupBy(name, page).agg(_first(patterns.period, order).alias("period"))
    parts = page_segments(pages, by, [page])
    n = F.max("segment").over(Window.partitionBy(name)) + 1
    part = F.concat(F.col(name).cast("string"), F.when(n > 1, F.concat(F.lit(" (statement "), (F.col("segment") + 1).cast("string"), F.lit(" of "), n.cast("string"), F.lit(")"))).otherwise(""))
    return lines.join(parts.select(name, page, part.alias("statement")), [name, page])


def process_statements(lines: DataFrame, formats: list[LineFormat], categories: list[Category], by: list[str], order: str = "line_no", patterns: Patterns = Patterns(), second: DataFrame | None = None, one_reading: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ledger, statements): the lines of any number of statements as a checked and categorised ledger.

    second: the lines as another extraction of the same statements has them, read on
    its own and compared row by row. Without a second reading nothing is approved,
    but where the source has no other (one_reading: text that was never extracted).

    by: the columns that name a statement; the first goes to statement_id and
    source_file. Each reading is assessed on its own and the one with the fewest
    problems, then the fewest flagged rows, then the most rows is kept. Nothing is
    corrected; what cannot be confirmed has reasons and is to be reviewed.
    """
    # Where lines come from may be work too: all that is read here is read from the lines as they are cut.
    lines = stored(cut_lines(lines, by, order))
    facts = stored(statement_facts(lines, by, order, patterns))
    rows, heads = all_readings(lines, formats, by, order, facts)
    keys = [*by, "reading"]
    # The checks read the rows several times, and the choice reads the checked rows again.
    rows = stored(rows.withColumn("garbled", garbled_figures(F.col("evidence"))).withColumn("ocr", F.lit(False)))
    rows, s = (stored(x) for x in assess(rows, stored(with_totals(heads.join(facts, by), rows, keys)), keys, ["seq"]))
    flagged = rows.groupBy(*keys).agg(F.count_if(F.size("reasons") > 0).alias("n_flagged"), F.count(F.lit(1)).alias("n"))
    graded = s.join(flagged, keys).select(*keys, F.size("problems").alias("n_problems"), "n_flagged", F.col("n").alias("n_rows"))
    best = choose_reading(graded, by).select(*keys)
    rows, s = rows.join(best, keys), s.join(best, keys)
    if not one_reading:
        figures = ["date", "debit", "credit", "unassigned", "balance"]
        other = None if second is None else stored(all_readings(second, formats, by, order, facts)[0].join(best, keys).select(*by, "seq", *figures))
        rows, s = confirm_by_second(rows, s, other, by, ["seq"], figures)
    rows, s = finalize(rows, s, keys)
    ledger = rows.join(s.select(*by, "account_number", "statement_period", "bank", "client"), by)
    ledger = ledger.withColumn("statement_id", F.col(by[0]).cast("string")).withColumn("source_file", F.col("statement_id"))
    ledger = ledger.withColumn("account", F.coalesce("account_number", F.lit(""))).withColumn("month", month_key(F.col("date")))
    ledger = ledger.withColumn("category", categorize(F.col("description"), F.col("credit"), categories)).withColumn("category_source", F.lit("Rule"))
    ledger = ledger.withColumn("vat", vat_default(F.col("category"), categories))
    return as_ledger(ledger), s
