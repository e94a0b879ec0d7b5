"""Reports as DataFrames. Money is DECIMAL(18,2); rows without a month are in no monthly figure.

`by` are the columns that tell ledgers apart (an account); every aggregation
combines on the map side and shuffles one row for each group and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_label
from ..functions.money import VAT_PERCENT, vat_of
from ..operators.assess import REVIEW
from ..operators.chain import month_balances, opening_closing, reference_numbers
from ..operators.rules import DRAWINGS, EXPENSE, INCOME, TRANSFER

MONEY = "decimal(18,2)"


def _z(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0).cast(MONEY))


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)


def net() -> Column:
    return _z("credit") - _z("debit")


def signed() -> Column:
    """What a row adds to its section: income as money in less out, everything else the other way."""
    return F.when(F.col("type") == INCOME, net()).otherwise(-net())


def _of(kind: str) -> Column:
    return _sum(F.when(F.col("type") == kind, signed()))


def _movements() -> list[Column]:
    return [_sum(F.col("credit")).alias("money_in"), _sum(F.col("debit")).alias("money_out"), _sum(net()).alias("net"), F.count(F.lit(1)).alias("transactions"), F.count_if(F.col("status") == REVIEW).alias("to_review")]


def monthly_summary(ledger: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """A row for each month: balances carried from month to month, money in and out, and what does not reconcile."""
    sums = ledger.where("month is not null").groupBy(*by, "month").agg(*_movements())
    out = sums.join(month_balances(ledger, by, order), [*by, "month"])
    return out.withColumn("difference", (F.col("opening") + F.col("money_in") - F.col("money_out") - F.col("closing")).cast(MONEY))


def monthly_totals(ledger: DataFrame, by: list[str]) -> DataFrame:
    """Money in and out by month, with a total (month null) for each `by` and over all."""
    return ledger.where("month is not null").rollup(*by, "month").agg(*_movements())


def monthly_table(ledger: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The monthly page: balances worked back from each month's own rows, income, expenses, profit, VAT."""
    rows = ledger.where("month is not null")
    keys = [*by, "month"]
    sums = rows.groupBy(*keys).agg(*_movements(), _of(INCOME).alias("income"), _of(EXPENSE).alias("expenses"))
    out = sums.join(opening_closing(rows, keys, order), keys).join(vat_by_month(ledger, by).select(*keys, "vat_payable"), keys, "left")
    return out.withColumn("profit", F.col("income") - F.col("expenses")).withColumn("label", month_label(F.col("month"))).withColumn("vat_payable", F.coalesce("vat_payable", F.lit(0)))


def income_statement(ledger: DataFrame, months: list[str], by: list[str]) -> DataFrame:
    """A row for each (type, category), a column for each month and a total; category null: the type's total.

    Pass the months: a pivot over known values is one aggregation.
    """
    rows = ledger.where(F.col("month").isin(months) & F.col("type").isNotNull())
    cells = [_sum(F.when(F.col("month") == m, signed())).alias(m) for m in months]
    out = rows.groupBy(*by, "type", "category").agg(*cells, _sum(signed()).alias("total"))
    sections = out.groupBy(*by, "type").agg(F.lit(None).cast("string").alias("category"), *[_sum(F.col(f"`{m}`")).alias(m) for m in [*months, "total"]])
    return out.unionByName(sections)


def net_profit(ledger: DataFrame, by: list[str]) -> DataFrame:
    """Income less expenses by month; transfers and drawings are outside profit."""
    out = ledger.where("month is not null").groupBy(*by, "month").agg(_of(INCOME).alias("income"), _of(EXPENSE).alias("expenses"))
    return out.withColumn("net_profit", (F.col("income") - F.col("expenses")).cast(MONEY))


def cash_flow(ledger: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """By month: from the opening balance over operations, transfers and drawings to the closing one, and the difference."""
    flows = ledger.where("month is not null").groupBy(*by, "month").agg(_of(INCOME).alias("income"), (-_of(EXPENSE)).alias("expenses"), (-_of(TRANSFER)).alias("transfers"), (-_of(DRAWINGS)).alias("drawings"))
    out = flows.withColumn("operations", F.col("income") + F.col("expenses")).withColumn("change", F.col("operations") + F.col("transfers") + F.col("drawings"))
    out = out.join(month_balances(ledger, by, order), [*by, "month"])
    out = out.withColumn("closing_calculated", (F.col("opening") + F.col("change")).cast(MONEY)).withColumnRenamed("closing", "closing_printed")
    return out.withColumn("difference", (F.col("closing_calculated") - F.col("closing_printed")).cast(MONEY))


def cash_flow_total(flow: DataFrame, by: list[str]) -> DataFrame:
    """The total of cash_flow: flows summed, the first month's opening, the last month's closing."""
    sums = [_sum(F.col(c)).alias(c) for c in ("income", "expenses", "transfers", "drawings", "operations", "change")]
    out = flow.groupBy(*by).agg(*sums, F.min_by("opening", "month").alias("opening"), F.max_by("closing_printed", "month").alias("closing_printed"))
    return out.withColumn("closing_calculated", (F.col("opening") + F.col("change")).cast(MONEY))


def category_breakdown(ledger: DataFrame, by: list[str], month: str | None = None) -> DataFrame:
    """By category: count, in, out, net, and of expenses the share of all expenses (in basis points, half up); of one month, if it is named."""
    rows = ledger.where("category is not null")
    if month is not None:
        rows = rows.where(F.col("month") == month)
    out = rows.groupBy(*by, "type", "category").agg(F.count(F.lit(1)).alias("transactions"), _sum(F.col("credit")).alias("money_in"), _sum(F.col("debit")).alias("money_out"), _sum(net()).alias("net"))
    total = rows.where(F.col("type") == EXPENSE).groupBy(*by).agg(_sum(-net()).alias("__t"))
    out = out.join(total, by, "left") if by else out.crossJoin(F.broadcast(total))
    share = F.when((F.col("type") == EXPENSE) & (F.col("__t") != 0), F.round((F.col("money_out") - F.col("money_in")) * 10000 / F.col("__t"), 0).cast("bigint"))
    return out.withColumn("share_bp", share).drop("__t")


def spend_by_category(ledger: DataFrame, by: list[str]) -> DataFrame:
    return ledger.where(F.col("type") == EXPENSE).groupBy(*by, "category").agg(_sum(-net()).alias("spent")).orderBy(*by, F.col("spent").desc(), "category")


def vat_by_month(ledger: DataFrame, by: list[str], percent: int = VAT_PERCENT) -> DataFrame:
    """Income and expenses by month, the VAT in those marked Yes (not rounded), and what is payable."""
    yes = F.col("vat") == "Yes"
    part = lambda kind, of: F.coalesce(F.sum(F.when(F.col("type") == kind, of)), F.lit(0))
    rows = ledger.where(F.col("month").isNotNull() & F.col("type").isin(INCOME, EXPENSE))
    out = rows.groupBy(*by, "month").agg(
        part(INCOME, signed()).cast(MONEY).alias("income"),
        part(EXPENSE, signed()).cast(MONEY).alias("expenses"),
        part(INCOME, F.when(yes, signed())).cast(MONEY).alias("income_with_vat"),
        part(EXPENSE, F.when(yes, signed())).cast(MONEY).alias("expenses_with_vat"),
    )
    out = out.withColumn("vat_on_income", vat_of(F.col("income_with_vat"), percent)).withColumn("vat_on_expenses", vat_of(F.col("expenses_with_vat"), percent))
    return out.withColumn("vat_payable", (F.col("vat_on_income") - F.col("vat_on_expenses")).cast("decimal(28,10)"))


#: The fields of the VAT return that bank statements can support.
VAT_FIELDS = (
    ("1", "income_with_vat"),
    ("2 / 3", "income_without_vat"),
    ("4", "vat_on_income"),
    ("13", "vat_on_income"),
    ("15", "vat_on_expenses"),
    ("19", "vat_on_expenses"),
    ("20", "vat_payable"),
)


def vat_return(ledger: DataFrame, by: list[str]) -> DataFrame:
    """(by, month, field, amount), the fields of the return as rows."""
    m = vat_by_month(ledger, by).withColumn("income_without_vat", F.col("income") - F.col("income_with_vat"))
    cells = [F.struct(F.lit(f).alias("field"), F.col(c).cast("decimal(28,10)").alias("amount")) for f, c in VAT_FIELDS]
    return m.select(*by, "month", F.explode(F.array(*cells)).alias("x")).select(*by, "month", "x.*")


def vat_return_total(fields: DataFrame, by: list[str]) -> DataFrame:
    """(by, field, amount): each field of vat_return over all months."""
    return fields.groupBy(*by, "field").agg(F.sum("amount").cast("decimal(28,10)").alias("amount"))


def vat_return_by_period(ledger: DataFrame, by: list[str], bridge: DataFrame) -> DataFrame:
    """The return summed over VAT periods, rounded to cents for showing; bridge as vat_periods gives it."""
    out = vat_return(ledger, by).join(F.broadcast(bridge), "month").groupBy(*by, "label", "end_month", "field").agg(F.sum("amount").alias("a"))
    return out.select(*by, "label", "end_month", "field", F.round("a", 2).cast(MONEY).alias("amount"))


def vat_summary(ledger: DataFrame, by: list[str]) -> DataFrame:
    """vat_by_month with the amounts without VAT and their differences."""
    m = vat_by_month(ledger, by)
    m = m.withColumn("income_excl", F.col("income") - F.col("vat_on_income")).withColumn("expenses_excl", F.col("expenses") - F.col("vat_on_expenses"))
    return m.withColumn("difference", F.col("income") - F.col("expenses")).withColumn("difference_excl", F.col("income_excl") - F.col("expenses_excl"))


def vat_summary_total(months: DataFrame, by: list[str]) -> DataFrame:
    """The total row of vat_summary; its VAT is that of the summed amounts, so that months' roundings do not add up."""
    sums = months.groupBy(*by).agg(*[_sum(F.col(c)).alias(c) for c in ("income", "expenses", "income_with_vat", "expenses_with_vat", "difference")])
    m = sums.withColumn("vat_on_income", vat_of(F.col("income_with_vat"))).withColumn("vat_on_expenses", vat_of(F.col("expenses_with_vat")))
    m = m.withColumn("income_excl", F.col("income") - F.col("vat_on_income")).withColumn("expenses_excl", F.col("expenses") - F.col("vat_on_expenses"))
    return m.withColumn("difference_excl", F.col("income_excl") - F.col("expenses_excl"))


def month_vat_sheet(ledger: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Each month's income and expense rows with running references (JUL26R01), amounts with and without VAT."""
    rows = ledger.where(F.col("month").isNotNull() & F.col("type").isin(INCOME, EXPENSE)).withColumn("amount", signed().cast(MONEY))
    prefix = F.concat(F.upper(F.date_format(F.to_date(F.concat("month", F.lit("-01"))), "MMMyy")), F.when(F.col("type") == INCOME, "R").otherwise("P"))
    rows = reference_numbers(rows, [*by, "month", "type"], order, prefix)
    vat = F.when(F.col("vat") == "Yes", vat_of(F.col("amount"))).otherwise(F.lit(0).cast("decimal(28,10)"))
    return rows.withColumn("vat_amount", vat).withColumn("amount_excl", (F.col("amount") - F.col("vat_amount")).cast("decimal(28,10)"))


def period_summary(ledger: DataFrame, by: list[str], order: list[str], bridge: DataFrame) -> DataFrame:
    """For each period: months, opening of the first, closing of the last, and sums; bridge as periods() gives it.

    Rows are aggregated to months first, so a period adds no pass over the ledger.
    """
    keys = [*by, "month"]
    months = ledger.where("month is not null").groupBy(*keys).agg(*_movements(), _of(INCOME).alias("income"), _of(EXPENSE).alias("expenses"))
    months = months.join(month_balances(ledger, by, order), keys).join(vat_by_month(ledger, by).select(*keys, "vat_payable"), keys, "left")
    sums = [_sum(F.col(c)).alias(c) for c in ("money_in", "money_out", "income", "expenses")]
    out = months.join(F.broadcast(bridge), "month").groupBy(*by, "kind", "label", "sort_key", "length").agg(
        *sums,
        F.count(F.lit(1)).alias("months"),
        F.min_by("opening", "month").alias("opening"),
        F.max_by("closing", F.when(F.col("closing").isNotNull(), F.col("month"))).alias("closing"),
        F.sum("transactions").alias("transactions"),
        F.sum("to_review").alias("to_review"),
        F.coalesce(F.sum("vat_payable"), F.lit(0)).alias("vat_payable"),
    )
    return out.withColumn("net_profit", (F.col("income") - F.col("expenses")).cast(MONEY)).withColumn("partial", F.col("months") < F.col("length"))


def overview(ledger: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row: balances, money in and out, sums by type."""
    sums = ledger.groupBy(*by).agg(*_movements(), _of(INCOME).alias("income"), _of(EXPENSE).alias("expenses"), _of(TRANSFER).alias("transfers"), _of(DRAWINGS).alias("drawings"))
    return sums.join(opening_closing(ledger, by, order), by)


def money_chart(ledger: DataFrame, by: list[str]) -> DataFrame:
    """(by, month, flow, amount): money in and out as rows."""
    sums = ledger.where("month is not null").groupBy(*by, "month").agg(_sum(F.col("credit")).alias("money_in"), _sum(F.col("debit")).alias("money_out"))
    return sums.unpivot([*by, "month"], ["money_in", "money_out"], "flow", "amount")


def review_lines(rows: DataFrame, statements: DataFrame, by: list[str]) -> DataFrame:
    """A line for each statement: its figures, counts of rows and of rows to review, and its issues."""
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == REVIEW).alias("rows_to_review"))
    figures = ["opening", "total_credits", "total_debits", "computed_closing", "last_balance", "printed_closing_used", "status", "issues"]
    return statements.select(*by, *figures).join(n, by, "left")


def session_stats(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """One row over everything: statements, rows, accounts, rows to review, and the VAT in what is marked Yes, without its sign."""
    yes = F.when((F.col("vat") == "Yes") & F.col("type").isin(INCOME, EXPENSE), vat_of(F.abs(signed().cast(MONEY))))
    sums = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("account").alias("accounts"), F.count_if(F.col("status") == REVIEW).alias("to_review"), F.coalesce(F.sum(yes), F.lit(0)).cast("decimal(28,10)").alias("vat"))
    return sums.crossJoin(statements.agg(F.count(F.lit(1)).alias("statements")))  # two tables of one row


def dominant(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by, column): the value that most rows of each group have; the first in order of equal ones."""
    n = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(column))


def run_stats(files: DataFrame, registry: DataFrame, added: DataFrame) -> DataFrame:
    """One row on an ingestion: files seen, new, known before, and rows added."""
    keys = ["source_id", "content_hash"]
    seen = files.select(*keys).join(registry.select(*keys, F.lit(1).alias("known")).distinct(), keys, "left")
    counts = seen.agg(F.count(F.lit(1)).alias("files"), F.count("known").alias("skipped"))
    return counts.withColumn("processed", F.col("files") - F.col("skipped")).crossJoin(added.agg(F.count(F.lit(1)).alias("rows_added")))  # two tables of one row


def write_reports(reports: dict[str, DataFrame], folder: str, kind: str = "parquet") -> list[str]:
    """Each report as a folder of files of its own; kind is any format of Spark's writers without nested columns."""
    for name, df in reports.items():
        out = df.write.mode("overwrite").format(kind)
        (out.option("header", "true") if kind == "csv" else out).save(f"{folder.rstrip('/')}/{name}")
    return sorted(reports)
