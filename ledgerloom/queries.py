"""Queries over the driver's tables, one or more for each group of operators; amounts are given in cents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dates, figures, keys, money, text
from .functions.keys import with_row_keys
from .functions.money import cents
from .operators import assess, chain, ingest, layout, learn, lifecycle, lines, rules, sheets
from .operators import rule_table as rule_tables
from .plans import periods, reports, statements
from .sources import files
from .sources.demo import BY, CATEGORIES, ORDER, order_ledger
from .sources.stored import shared_folder, stored


def _c(*names: str) -> list:
    return [cents(F.col(n)).alias(n) for n in names]


def _exact(name: str, scale: int = 1_000_000):
    """A wide decimal in millionths, half up, as a long."""
    return F.round(F.col(name) * scale, 0).cast("bigint").alias(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def monthly_summary(spark, sf):
    out = reports.monthly_summary(order_ledger(spark, sf), BY, ORDER)
    return out.select("account", "month", *_c("opening", "money_in", "money_out", "net", "closing", "difference"), "transactions", "to_review")


def monthly_total_rollup(spark, sf):
    return reports.monthly_totals(order_ledger(spark, sf), BY).select("account", "month", *_c("money_in", "money_out", "net"), "transactions", "to_review")


def monthly_table(spark, sf):
    out = reports.monthly_table(order_ledger(spark, sf), BY, ORDER)
    return out.select("account", "month", "label", *_c("opening", "closing", "money_in", "money_out", "income", "expenses", "profit"), _exact("vat_payable"), "transactions", "to_review")


def balance_breaks(spark, sf):
    out = chain.balance_chain(order_ledger(spark, sf), BY, ORDER).where("breaks")
    return out.select("account", "seq", *_c("expected", "balance", "missing"))


def workbook_gaps(spark, sf):
    out = chain.balance_gaps(order_ledger(spark, sf), BY, ORDER)
    return out.select("account", F.col("after_date").cast("string").alias("after_date"), F.col("at_date").cast("string").alias("at_date"), "seq", "description", *_c("expected", "actual", "missing"))


def opening_closing(spark, sf):
    return chain.opening_closing(order_ledger(spark, sf), BY, ORDER).select("account", *_c("opening", "closing"))


def flag_duplicates(spark, sf):
    li = _read(spark, sf, "lineitem")
    rows = li.select(
        F.col("l_orderkey").alias("account"),
        F.to_date("l_shipdate").alias("date"),
        F.lit("line").alias("description"),
        F.lit(None).cast("decimal(18,2)").alias("debit"),
        F.lit(None).cast("decimal(18,2)").alias("credit"),
        F.col("l_quantity").cast("decimal(18,2)").alias("unassigned"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("evidence"),
        F.when(F.col("l_partkey") % 3 != 0, F.col("l_suppkey")).cast("decimal(18,2)").alias("balance"),
        F.xxhash64("l_orderkey").alias("__unused"),
        "l_partkey", "l_suppkey", "l_extendedprice", "l_linenumber", "l_returnflag",
    ).drop("__unused").withColumn("date", F.trunc("date", "year"))
    rows = rows.withColumn("unassigned", (F.col("unassigned") % 5).cast("decimal(18,2)"))
    out = chain.flag_duplicates(rows, BY, ["l_partkey", "l_suppkey", "l_extendedprice", "l_linenumber", "l_returnflag"])
    return out.where("duplicate").groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"))


def flag_date_order(spark, sf):
    e = _read(spark, sf, "events").select(F.col("user_id").alias("account"), F.to_date("ts").alias("date"), F.col("event_id").alias("seq"))
    out = chain.flag_date_order(e.withColumn("shuffled", F.col("seq") * 7919 % 1009), BY, ["shuffled", "seq"])
    return out.groupBy("account").agg(F.count_if("out_of_order").alias("n_out"), F.count(F.lit(1)).alias("n"))


def confirm_groups(spark, sf):
    o = order_ledger(spark, sf)
    small = o.where("unassigned is null").withColumn("amount", F.coalesce("debit", "credit")).withColumn("sign", F.when(F.col("seq") % 3 == 0, F.when(F.col("credit").isNotNull(), 1).otherwise(-1)))
    out = chain.confirm_groups(small.select("account", "date", "seq", "amount", "sign", "balance"), BY, ORDER)
    return out.select("account", "seq", "group_id", F.col("fits").cast("bigint").alias("fits"), F.col("resolved_sign").cast("bigint").alias("resolved_sign"))


def page_segments(spark, sf):
    p = _read(spark, sf, "pages").select(F.lit(1).alias("file"), "page_id", F.when(F.col("page_id") % 3 == 0, F.regexp_extract("url", r"example\.([a-z]+)", 1)).alias("period"))
    out = chain.page_segments(p.withColumn("file", F.floor(F.col("page_id") / 50).cast("bigint")), ["file"], ["page_id"])
    return out.select("file", "page_id", "segment")


def missing_pages(spark, sf):
    p = _read(spark, sf, "pages").where("page_id % 4 <> 2")
    p = p.select(F.floor(F.col("page_id") / 8).cast("bigint").alias("file"), F.concat(F.lit("Statement Page "), (F.col("page_id") % 8 + 1).cast("string"), F.lit(" of 8")).alias("text"))
    return chain.pages_missing(p, ["file"]).select("file", F.array_join("missing", ",").alias("missing"))


def income_statement_pivot(spark, sf):
    months = ["1995-01", "1995-02", "1995-03"]
    out = reports.income_statement(order_ledger(spark, sf).withColumn("account", F.lit("all")), months, BY)
    return out.select("account", "type", "category", *[cents(F.col(f"`{m}`")).alias("m" + m.replace("-", "")) for m in months], *_c("total"))


def cash_flow(spark, sf):
    out = reports.cash_flow(order_ledger(spark, sf), BY, ORDER)
    return out.select("account", "month", *_c("opening", "income", "expenses", "operations", "transfers", "drawings", "change", "closing_calculated", "closing_printed", "difference"))


def cash_flow_total(spark, sf):
    out = reports.cash_flow_total(reports.cash_flow(order_ledger(spark, sf), BY, ORDER), BY)
    return out.select("account", *_c("opening", "income", "expenses", "transfers", "drawings", "change", "closing_calculated", "closing_printed"))


def category_breakdown(spark, sf):
    out = reports.category_breakdown(order_ledger(spark, sf), BY)
    return out.select("account", "type", "category", "transactions", *_c("money_in", "money_out", "net"))


def spend_by_category(spark, sf):
    return reports.spend_by_category(order_ledger(spark, sf).withColumn("account", F.lit("all")), BY).select("account", "category", *_c("spent"))


def vat_by_month(spark, sf):
    out = reports.vat_by_month(order_ledger(spark, sf).withColumn("account", F.lit("all")), BY)
    return out.select("month", *_c("income", "expenses", "income_with_vat"), _exact("vat_on_income"), _exact("vat_on_expenses"), _exact("vat_payable"))


def vat_return(spark, sf):
    out = reports.vat_return(order_ledger(spark, sf).withColumn("account", F.lit("all")), BY)
    return out.select("month", "field", _exact("amount"))


def vat_return_by_period(spark, sf):
    """The return over two months, to the cent."""
    rows = order_ledger(spark, sf).withColumn("account", F.lit("all"))
    out = reports.vat_return_by_period(rows, BY, periods.vat_periods(rows, "A"))
    return out.select("label", "end_month", "field", *_c("amount"))


def range_of_months(spark, sf):
    """Totals of the months of a range that a person gives, the last one first."""
    rows = periods.in_months(order_ledger(spark, sf), "1996-08", "1994-03")
    return reports.monthly_totals(rows, BY).select("account", "month", *_c("money_in", "money_out", "net"), "transactions", "to_review")


def vat_registration(spark, sf):
    """The VAT that categories carry for a client that is registered, and for one that is not."""
    cats = [*CATEGORIES[:1], rules.Category("Rent", rules.EXPENSE, ("purchase 1", "purchase 4"), vat_if_registered=True), *CATEGORIES[2:]]
    rows = order_ledger(spark, sf)
    default = lambda yes: rules.vat_default(F.col("category"), rules.for_vat_registration(cats, yes))
    return rows.groupBy("category", default(True).alias("registered"), default(False).alias("other")).agg(F.count(F.lit(1)).alias("n"))


def newest_files(spark, sf):
    """The thirty files that changed last."""
    files_ = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), F.to_date("o_orderdate").alias("modified"))
    return ingest.newest(files_).select("name", F.col("modified").cast("string").alias("modified"))


def review_lines(spark, sf):
    """A line for each statement: its figures, its rows and those to review, its issues."""
    rows, s = _statements(spark, sf)
    out = reports.review_lines(rows, s, BY)
    return out.select("account", *_c("total_credits", "total_debits", "computed_closing", "last_balance"), "rows", "rows_to_review", "status", "issues")


def vat_summary(spark, sf):
    out = reports.vat_summary(order_ledger(spark, sf).withColumn("account", F.lit("all")), BY)
    return out.select("month", *_c("difference"), _exact("income_excl"), _exact("expenses_excl"), _exact("difference_excl"))


def vat_net_lineitem(spark, sf):
    li = _read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("c").alias("gross"), F.sum(money.net_cents(F.col("c"))).alias("net"))


def month_vat_sheet(spark, sf):
    """References run within the account, so no window holds a month of the whole table."""
    out = reports.month_vat_sheet(order_ledger(spark, sf), BY, ORDER)
    return out.select("account", "seq", "reference", "vat", *_c("amount"), _exact("vat_amount"), _exact("amount_excl"))


def period_summary(spark, sf):
    rows = order_ledger(spark, sf)
    out = reports.period_summary(rows, BY, ORDER, periods.periods(rows))
    return out.select("account", "kind", "label", "sort_key", "months", "partial", *_c("opening", "closing", "money_in", "money_out", "income", "expenses", "net_profit"), "transactions", "to_review")


def vat_periods_ab(spark, sf):
    rows = order_ledger(spark, sf).select("month")
    a = periods.vat_periods(rows, "A").withColumn("category", F.lit("A"))
    b = periods.vat_periods(rows, "B").withColumn("category", F.lit("B"))
    return a.unionByName(b).unionByName(periods.vat_periods(rows, "C").withColumn("category", F.lit("C")))


def overview(spark, sf):
    out = reports.overview(order_ledger(spark, sf), BY, ORDER)
    return out.select("account", *_c("opening", "closing", "money_in", "money_out", "income", "expenses", "transfers", "drawings"), "transactions", "to_review")


def money_chart(spark, sf):
    return reports.money_chart(order_ledger(spark, sf).withColumn("account", F.lit("all")), BY).select("month", "flow", *_c("amount"))


def categorize_first_match(spark, sf):
    p = _read(spark, sf, "part")
    found = rules.first_needle([F.col("p_name"), F.col("p_type")], [("Metals", ("STEEL", "brass", "copper"), None), ("Green", ("green", "lime"), F.col("p_size") > 20), ("Small", ("small",), None)], F.lit("Other"))
    return p.select("p_partkey", found.alias("category"))


def rule_table(spark, sf):
    """A rule for each part, a piece of its name being the needle, over the names of all parts; the first that takes the row's direction."""
    p = _read(spark, sf, "part")
    way = F.get(F.array(F.lit("any"), F.lit("in"), F.lit("out")), (F.col("p_partkey") % 3).cast("int"))
    rules_ = p.select((F.col("p_partkey") * 7919 % 100003).alias("rule_order"), F.col("p_brand").alias("rule"), F.substr("p_name", F.lit(3), (F.col("p_partkey") % 12).cast("int")).alias("needle"), way.alias("way"))
    rows = p.select("p_partkey", F.concat_ws(" ", F.upper("p_name"), "p_type").alias("description"), (F.col("p_size") > 25).alias("money_in"))
    return rule_tables.first_rules(rows, rules_, "description", "money_in").select("p_partkey", "rule_order", "rule")


#: Fixed values of bank_facts: what its banks call themselves, and how each prints what a statement says about itself.
BANK_NAMES = ((1, "Quayside", "quayside savings"), (2, "Ridgeway", "ridgeway trust"), (2, "Ridgeway", "ridgeway.example"))
BANK_PATTERNS = (
    ("Quayside", "debits", 1, r"(?i)^money out in all (-?R?[\d,.]+)$"), ("Quayside", "credits", 1, r"(?i)^money in in all (-?R?[\d,.]+)$"), ("Quayside", "period", 1, r"(?i)^from (.+ to .+)$"),
    ("Ridgeway", "debits", 1, r"(?i)^no\. of payments \d+ (-?[\d,.]+)$"), ("Ridgeway", "credits", 1, r"(?i)^no\. of deposits \d+ (-?[\d,.]+)$"),
    (None, "debits", 1, r"(?i)^total debits:? (-?[\d,.]+)$"), (None, "credits", 1, r"(?i)^total credits:? (-?[\d,.]+)$"),
    (None, "account", 1, r"(?i)^account(?: number)?:? ([\d ]+)$"), (None, "period", 1, r"(?i)^statement period:? (.+ to .+)$"), (None, "closing", 1, r"(?i)^closing balance:? (-?[\d,.]+)$"),
)


def bank_facts(spark, sf):
    """What statements of three banks print about themselves, each in its own words, and in those of all banks what the bank has no words for."""
    o = _printable(spark, sf)
    zero = F.lit(0).cast("decimal(18,2)")
    s = o.groupBy("account").agg(F.coalesce(F.sum("debit"), zero).alias("d"), F.coalesce(F.sum("credit"), zero).alias("c"), F.count("debit").alias("nd"), F.count("credit").alias("nc"), F.max_by("b", "line_no").alias("last"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    k = F.col("account").cast("int") % 3
    span = F.concat(F.date_format("lo", "dd/MM/yyyy"), F.lit(" to "), F.date_format("hi", "dd/MM/yyyy"))
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    d, c = _shown(F.col("d")), _shown(F.col("c"))
    wrong = say("Total Debits: 1.00")  # not what Quayside and Ridgeway call it
    first = F.array(F.lit("QUAYSIDE Savings Limited"), wrong, say("Money out in all R", d), say("Money in in all R", c), say("From ", span), say("Statement Period: 01/01/1990 to 02/01/1990"))
    second = F.array(F.lit("www.ridgeway.example"), wrong, say("No. of payments ", F.col("nd").cast("string"), " ", d), say("No. of deposits ", F.col("nc").cast("string"), " ", c), say("Statement Period: ", span), F.lit(""))
    third = F.array(F.lit("Some bank"), say("Total Debits: ", d), say("Total Credits: ", c), say("Statement Period: ", span), F.lit("Money out in all R1.00"), F.lit(""))
    text = F.concat(F.when(k == 0, first).when(k == 1, second).otherwise(third), F.array(say("Account: 62 ", F.lpad("account", 9, "0")), say("Closing Balance: ", _shown(F.col("last")))))
    lines_ = s.select("account", F.posexplode(text).alias("line_no", "text"))
    banks = spark.createDataFrame(list(BANK_NAMES), "rule_order int, rule string, needle string")
    patterns = spark.createDataFrame(list(BANK_PATTERNS), "bank string, field string, priority int, pattern string")
    out = statements.statement_facts(lines_, BY, patterns=statements.Patterns(bank_table=banks, pattern_table=patterns))
    one = lambda name: cents(F.get(F.col(name), F.lit(0))).alias(name)
    return out.select("account", "bank", "account_number", F.col("period_start").cast("string").alias("period_start"), F.col("period_end").cast("string").alias("period_end"), one("all_debits"), one("all_credits"), one("closings"))


def report_categories(spark, sf):
    out = rules.report_categories(order_ledger(spark, sf).withColumn("category", F.when(F.col("seq") % 17 == 0, "Manual").otherwise(F.col("category"))), CATEGORIES)
    return out.select("category", "type", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("rank")).cast("bigint").alias("place"))


def row_key_dedup(spark, sf):
    rows = order_ledger(spark, sf).withColumn("client", F.lit("c")).withColumn("bank", F.lit("b"))
    old, new = rows.where("seq % 3 <> 0"), rows.where("seq % 3 <> 1")
    ledger = with_row_keys(old, ["seq"]).drop("occurrence")
    return ingest.append(ledger, new, ["seq"]).select("seq", "row_key")


def file_registry(spark, sf):
    c = _read(spark, sf, "customer").select(F.col("c_name").alias("source_id"), F.sha2(F.col("c_mktsegment").cast("binary"), 256).alias("content_hash"), F.col("c_custkey").alias("processed_at"))
    registry = c.where("processed_at % 2 = 0")
    done = ingest.mark_processed(registry, ingest.new_files(c.where("processed_at % 3 = 0"), registry))
    return done.select("source_id", "content_hash", "processed_at")


def mixed_accounts(spark, sf):
    """All rows that the ledger does not hold are the batch."""
    rows = order_ledger(spark, sf).select("account", F.concat(F.lit("f"), F.col("month")).alias("source_file"), "seq")
    named = lambda df: df.select(F.when(F.col("seq") % 2 == 0, F.col("account")).alias("account"), "source_file")
    held = F.col("account").cast("int") % 5 == 0
    return ingest.mixed_accounts(named(rows.where(held)), named(rows.where(~held)))


def parse_amount_formats(spark, sf):
    o = _read(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c"))
    whole, part = F.floor(F.col("c") / 100).cast("bigint"), F.lpad((F.col("c") % 100).cast("string"), 2, "0")
    grouped = F.format_number(whole, 0)
    shapes = [
        F.concat(F.lit("R "), grouped, F.lit("."), part),
        F.concat(F.lit("("), grouped, F.lit("."), part, F.lit(")")),
        F.concat(F.translate(grouped, ",", " "), F.lit(","), part, F.lit(" Dr")),
        F.concat(F.translate(grouped, ",", "."), F.lit(","), part),
        F.concat(whole.cast("string"), F.lit("."), part, F.lit("Cr")),
        F.concat(F.lit(" -R"), grouped, F.lit("."), part),
        F.lit(" - "),
        F.concat(F.lit("x"), part),
    ]
    raw = F.element_at(F.array(*shapes), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return o.select("o_orderkey", cents(money.parse_amount(raw)).alias("amount"))


def parse_date_formats(spark, sf):
    o = _read(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    shapes = [F.date_format("d", f) for f in ("dd/MM/yyyy", "d-M-yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-MM-dd", "yyyy/MM/dd")] + [F.upper(F.date_format("d", "dd MMM yyyy")), F.lit("31/02/2024"), F.date_format("d", "'13/'dd'x'")]
    raw = F.element_at(F.array(*shapes), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return o.select("o_orderkey", dates.parse_date(raw).cast("string").alias("day"))


def fiscal_calendar(spark, sf):
    d = _read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select(F.col("d").cast("string").alias("day"), dates.financial_year(F.col("d")).cast("bigint").alias("fy"), dates.financial_quarter(F.col("d")).cast("bigint").alias("quarter"), dates.financial_year_label(dates.financial_year(F.col("d"))).alias("fy_label"), dates.month_label(dates.month_key(F.col("d"))).alias("label"))


def same_words(spark, sf):
    return _read(spark, sf, "part").select("p_partkey", text.same_words(F.concat_ws(" | ", "p_type", "p_name")).alias("words"))


def telling_words(spark, sf):
    raw = F.concat_ws(" ", F.col("o_orderpriority"), F.date_format("o_orderdate", "d MMM"), F.lit("O'Neil & co 12"))
    return _read(spark, sf, "orders").select("o_orderkey", F.array_join(text.telling_words(raw), " ").alias("words"))


def garbled_figures(spark, sf):
    o = _read(spark, sf, "orders")
    figure = F.format_string("%d.00", F.col("o_orderkey"))
    raw = F.concat(F.lit("paid R"), F.when(F.col("o_orderkey") % 3 == 0, F.translate(figure, "015", "OIS")).otherwise(figure), F.lit("Cr on "), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", F.array_join(text.garbled_figures(raw), ",").alias("garbled"))


def rand_format(spark, sf):
    o = _read(spark, sf, "orders").select("o_orderkey", money.from_cents(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("a"))
    return o.select("o_orderkey", money.rand(F.when(F.col("o_orderkey") % 2 == 0, F.col("a")).otherwise(-F.col("a"))).alias("shown"))


def learned_category(spark, sf):
    """A fifth of the rows is taught; every other row is asked for. What is known grows in three batches."""
    p = _read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", F.translate("p_brand", "#0123456789", "_abcdefghij")).alias("description"), (F.col("p_size") > 25).alias("money_in"), F.concat(F.lit("C"), (F.col("p_size") % 3).cast("string")).alias("category"))
    index = learn.WordIndex(spark, shared_folder(spark))
    for k in range(3):
        index.add(p.where((F.col("id") % 3 == k) & (F.col("id") % 5 != 1)).select("description"))
        index.teach(p.where((F.col("id") % 3 == k) & (F.col("id") % 5 == 0)))
    return index.suggest(p.where("id % 5 <> 0")).select("id", "category", "n_alike", "example_id", F.round(F.col("similarity") * 1_000_000).cast("bigint").alias("similarity"))


def category_lifecycle(spark, sf):
    rows = order_ledger(spark, sf).withColumn("suggested_category", F.when(F.col("seq") % 4 == 0, F.lit("Rent")))
    typed = F.when(F.col("seq") % 4 == 0, "Rent").when(F.col("seq") % 4 == 1, "Drawings").when(F.col("seq") % 4 == 2, None).otherwise(F.col("category"))
    rows = rows.withColumn("category", typed).withColumn("category_source", F.lit(None).cast("string")).withColumn("vat", F.when(F.col("seq") % 5 == 0, "Yes"))
    out = lifecycle.settle_vat(lifecycle.reapply_rules(rows, CATEGORIES), CATEGORIES)
    return out.select("seq", "category", "category_source", "vat")


def _statements(spark, sf):
    rows = order_ledger(spark, sf)
    rows = rows.withColumn("date_text", F.col("date").cast("string")).withColumn("evidence", F.concat_ws(" ", "date_text", "description", "seq")).withColumn("garbled", F.when(F.col("seq") % 31 == 0, F.array(F.lit("1O.00"))).otherwise(F.array().cast("array<string>"))).withColumn("ocr", F.col("seq") % 2 == 0)
    zero = F.lit(0).cast("decimal(18,2)")
    n = F.col("account").cast("int")
    s = rows.groupBy("account").agg(F.sum(F.coalesce("credit", zero)).cast("decimal(18,2)").alias("tc"), F.sum(F.coalesce("debit", zero)).cast("decimal(18,2)").alias("td"), F.max_by("balance", F.when(F.col("balance").isNotNull(), F.struct("date", "seq"))).alias("lb"))
    s = s.select(
        "account",
        F.when(n % 3 != 0, zero).alias("opening"),
        F.lit("1992-06-01").cast("date").alias("period_start"),
        F.lit("1998-06-30").cast("date").alias("period_end"),
        F.when(n % 7 != 0, F.col("td") + F.when(n % 4 == 0, 1).otherwise(0)).cast("decimal(18,2)").alias("printed_debits"),
        F.when(n % 7 != 0, F.col("tc")).alias("printed_credits"),
        F.lit(None).cast("decimal(18,2)").alias("printed_fees"),
        F.lit(None).cast("decimal(18,2)").alias("printed_closing"),
        F.when((n % 5 == 0) | F.col("lb").isNull(), F.array().cast("array<decimal(18,2)>")).otherwise(F.array((F.col("lb") + F.when(n % 6 == 0, 2).otherwise(0)).cast("decimal(18,2)"))).alias("closings"),
        F.lit(0).alias("n_skipped"),
        F.array().cast("array<int>").alias("missing_pages"),
        F.when(n % 9 != 0, F.col("account")).alias("account_number"),
    )
    rows, s = assess.assess(rows, s, BY, ORDER)
    return assess.finalize(rows, s, BY)


def _assessed_rows(rows):
    return rows.select("account", "seq", F.array_join("reasons", ";").alias("reasons"), "status", F.round(F.col("confidence") * 100).cast("bigint").alias("confidence"))


def assess_rows(spark, sf):
    return _assessed_rows(_statements(spark, sf)[0])


def _assessed_statements(s):
    return s.select("account", F.array_join("problems", ";").alias("problems"), *_c("computed_closing", "last_balance", "printed_closing_used"), "n_flagged", "status")


def assess_statements(spark, sf):
    return _assessed_statements(_statements(spark, sf)[1])


def choose_reading(spark, sf):
    li = _read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.sum(F.col("l_partkey") % 3)).alias("n_problems"), F.sum(F.col("l_suppkey") % 4).alias("n_flagged"), F.count(F.lit(1)).alias("n_rows"))
    return assess.choose_reading(li.withColumnRenamed("l_linenumber", "reading"), ["l_orderkey"]).withColumn("reading", F.col("reading").cast("bigint"))


def compare_readings(spark, sf):
    """A second reading that has lost every 6th order, reads every 7th differently, every 11th twice, and has each fourth pair of rows the other way round."""
    w = Window.partitionBy("account").orderBy(*ORDER)
    rows = order_ledger(spark, sf).select("account", "seq", "date", "debit", "credit", "unassigned", F.row_number().over(w).alias("n"), F.count(F.lit(1)).over(Window.partitionBy("account")).alias("most"))
    pair = F.floor((F.col("n") + 1) / 2)
    swapped = (pair % 4 == 0) & (pair * 2 <= F.col("most"))
    place = F.when(swapped, F.when(F.col("n") % 2 == 1, F.col("n") + 1).otherwise(F.col("n") - 1)).otherwise(F.col("n"))
    more = F.when(F.col("seq") % 7 == 0, 1).otherwise(0)
    second = rows.where("seq % 6 <> 0").withColumns({c: (F.col(c) + more).cast("decimal(18,2)") for c in ("debit", "credit", "unassigned")})
    second = second.select("account", "date", "debit", "credit", "unassigned", F.explode(F.when((F.col("seq") % 11 == 0) & ~swapped, F.array(place * 2, place * 2 + 1)).otherwise(F.array(place * 2))).alias("place"))
    first = rows.withColumn("place", (F.col("n") * 2).cast("bigint"))
    out = assess.align_readings(first, second, BY, ["place"], ["date", "debit", "credit", "unassigned"])
    return out.select("account", "place", F.col("date").cast("string").alias("day"), *_c("debit", "credit", "unassigned"), "side")


def _shown(c):
    """A figure as statements print it, thousands by commas."""
    return F.concat(F.when(c < 0, "-").otherwise(""), F.format_number(F.floor(F.abs(c)).cast("bigint"), 0), F.lit("."), F.lpad((cents(F.abs(c)) % 100).cast("string"), 2, "0"))


def _printable(spark, sf):
    """All orders as a statement prints them: numbered, with their way and running balance b, and in hard statements (lost, wrong) without a balance or with one that is 1.00 too large."""
    o = order_ledger(spark, sf)
    is_in = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "F").alias("is_in"))
    o = o.join(is_in, "seq").withColumn("a", F.coalesce("debit", "credit", "unassigned"))
    o = o.withColumn("debit", F.when(~F.col("is_in"), F.col("a"))).withColumn("credit", F.when(F.col("is_in"), F.col("a")))
    w = Window.partitionBy("account").orderBy(*ORDER)
    o = o.withColumn("b", F.sum(F.when(F.col("is_in"), F.col("a")).otherwise(-F.col("a"))).over(w).cast("decimal(18,2)")).withColumn("line_no", F.row_number().over(w))
    # One wrong balance an account: two in a row would be right again.
    odd = F.col("seq") % 101 == 0
    o = o.withColumn("wrong", odd & (F.count_if(odd).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1))
    o = o.withColumn("lost", (F.col("seq") % 13 == 0) & ~F.col("wrong"))
    return o.withColumn("printed", F.when(~F.col("lost"), F.col("b") + F.when(F.col("wrong"), 1).otherwise(0)).cast("decimal(18,2)"))


def read_lines(spark, sf):
    """Statements printed from orders and read back: a way where the balance printed before leads to the row's own; rows without a balance are no rows of this format."""
    o = _printable(spark, sf)
    printed = o.select("account", "line_no", F.concat_ws(" ", F.date_format("date", "dd/MM/yyyy"), "description", _shown(F.col("a")), _shown(F.col("printed"))).alias("text"))
    head = o.select("account").distinct().select("account", F.lit(0).alias("line_no"), F.lit("Opening Balance: 0.00").alias("text"))
    rows, _ = lines.read_lines(printed.unionByName(head), lines.LineFormat(), BY)
    return rows.select("account", "seq", F.col("date").cast("string").alias("day"), "description", *_c("debit", "credit", "unassigned", "balance"))


def _layouts(spark, sf):
    """Statements in five layouts: points or commas, blanks in thousands, marks, fees, a column after the balance, dates in words; rows without a balance and with a wrong one among them."""
    o = _printable(spark, sf).withColumn("k", F.col("account").cast("int") % 5)
    plain = lambda c: _shown(F.abs(c))
    comma = lambda c: F.translate(plain(c), ",.", ".,")
    blank = lambda c: F.translate(plain(c), ",", " ")
    minus = lambda c: F.concat(plain(c), F.when(c < 0, "-").otherwise(""))
    bracket = lambda shown, c: F.when(c < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)
    marked = lambda c: F.concat(plain(c), F.when(c < 0, " Dr").otherwise(" Cr"))
    b = F.col("printed")
    text_of = (
        F.when(F.col("k") == 0, F.concat_ws(" ", F.date_format("date", "dd/MM/yyyy"), "description", plain(F.col("a")), minus(b)))
        .when(F.col("k") == 1, F.concat_ws("  ", F.date_format("date", "yyyy-MM-dd"), "description", comma(F.col("a")), bracket(comma(b), b)))
        .when(F.col("k") == 2, F.concat_ws("  ", F.date_format("date", "d MMM yyyy"), "description", F.concat(F.lit("R"), blank(F.col("a"))), bracket(blank(b), b)))
        .when(F.col("k") == 3, F.concat_ws(" ", F.date_format("date", "dd.MM.yyyy"), "description", plain(F.col("a")), marked(b), F.when(~F.col("lost"), "3.00")))
        .otherwise(F.concat_ws(" ", F.date_format("date", "MMM d, yyyy"), "description", F.concat(plain(F.col("a")), F.when(F.col("credit").isNotNull(), "Cr").otherwise("")), marked(b)))
    )
    printed = o.select("account", F.col("line_no").cast("bigint").alias("line_no"), text_of.alias("text"))
    k = F.col("account").cast("int") % 5
    head = o.select("account").distinct().select("account", F.lit(0).cast("bigint").alias("line_no"), F.concat(F.lit("Opening Balance: "), F.when(k == 1, "0,00").otherwise("0.00")).alias("text"))
    return printed.unionByName(head)


def unknown_layouts(spark, sf):
    """The statements of five layouts read back without being told them; a row without a balance goes the way that the next one says, one with a wrong balance keeps it unconfirmed."""
    rows, _ = layout.read_unknown(_layouts(spark, sf), BY)
    return rows.select("account", "seq", F.col("date").cast("string").alias("day"), "description", *_c("debit", "credit", "unassigned", "balance"), "confirmed")


def yearless_dates(spark, sf):
    """An account's years as statements that print days and months alone; the period says the year."""
    o = _printable(spark, sf).withColumn("s", F.concat_ws("-", "account", F.year("date").cast("string")))
    w = Window.partitionBy("s").orderBy("line_no")
    o = o.withColumn("n", F.row_number().over(w).cast("bigint")).withColumn("rb", F.sum(F.when(F.col("is_in"), F.col("a")).otherwise(-F.col("a"))).over(w).cast("decimal(18,2)"))
    printed = o.select("s", F.col("n").alias("line_no"), F.concat_ws(" ", F.date_format("date", "d MMM"), "description", _shown(F.col("a")), _shown(F.col("rb"))).alias("text"))
    ends = o.select("s", F.year("date").alias("y")).distinct()
    head = ends.select("s", F.lit(0).cast("bigint").alias("line_no"), F.lit("Balance brought forward 0.00").alias("text"))
    bounds = ends.select("s", F.make_date("y", F.lit(1), F.lit(1)).alias("period_start"), F.make_date("y", F.lit(12), F.lit(31)).alias("period_end"))
    rows, _ = layout.read_unknown(printed.unionByName(head), ["s"], bounds=bounds)
    return rows.select("s", "seq", F.col("date").cast("string").alias("day"), *_c("debit", "credit", "unassigned", "balance"), "confirmed")


def client_of_files(spark, sf):
    """Whose file it is, by what stands in its sender, subject or name; the first client counts."""
    c = _read(spark, sf, "customer").select("c_custkey", F.concat(F.lit("From: "), "c_mktsegment").alias("sender"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("Statement of Acme "), F.col("c_custkey").cast("string"))).alias("subject"), "c_name")
    clients = [("Acme", ("acme",)), ("Builders", ("BUILDING",)), ("Nobody", ()), ("Homes", ("household", "furniture")), ("Nines", ("9",))]
    return c.select("c_custkey", rules.match_client([F.col("sender"), F.col("subject"), F.col("c_name")], clients).alias("client"))


def statement_styles(spark, sf):
    """How each of those statements prints figures and dates."""
    return layout.statement_styles(_layouts(spark, sf), BY)


def _statement_lines(o, wrong=0):
    """Whole statements as text; wrong is added to the total of debits that they print."""
    zero = F.lit(0).cast("decimal(18,2)")
    printed = o.select("account", (F.col("line_no") + 9).cast("bigint").alias("line_no"), F.concat_ws(" ", F.date_format("date", "dd/MM/yyyy"), "description", _shown(F.coalesce("credit", "debit")), _shown(F.col("b"))).alias("text"))
    s = o.groupBy("account").agg(F.coalesce(F.sum("debit"), zero).alias("d"), F.coalesce(F.sum("credit"), zero).alias("c"), F.max_by("b", "line_no").alias("last"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    about = F.array(
        F.concat(F.lit("Account Number: 62"), F.lpad("account", 9, "0")),
        F.concat(F.lit("Statement Period: "), F.date_format("lo", "dd/MM/yyyy"), F.lit(" to "), F.date_format("hi", "dd/MM/yyyy")),
        F.concat(F.lit("Total Debits: "), _shown(F.col("d") + wrong)),
        F.concat(F.lit("Total Credits: "), _shown(F.col("c"))),
        F.concat(F.lit("Closing Balance: "), _shown(F.col("last"))),
        F.lit("Opening Balance: 0.00"),
    )
    head = s.select("account", F.posexplode(about).alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("bigint"))
    return printed.unionByName(head).withColumnRenamed("account", "statement")


def statement_ledger(spark, sf):
    """Whole statements, with what they print about themselves, as a checked ledger; every 5th prints a wrong total."""
    every = _statement_lines(_printable(spark, sf), F.when(F.col("account").cast("int") % 5 == 0, 1).otherwise(0))
    ledger, _ = statements.process_statements(every, [lines.LineFormat()], CATEGORIES, ["statement"], one_reading=True)
    return ledger.select("statement_id", "account", "seq", F.col("date").cast("string").alias("day"), "month", "description", *_c("debit", "credit", "unassigned", "balance"), "category", "vat", "status", F.array_join("reasons", ";").alias("reasons"))


def second_reading(spark, sf):
    """The same statements extracted twice: every 17th line reads differently the second time, every 9th statement was extracted once."""
    o = _printable(spark, sf)
    other = o.where("cast(account as int) % 9 <> 0")
    more = F.when(F.col("line_no") % 17 == 0, 1).otherwise(0)
    other = other.withColumn("debit", (F.col("debit") + more).cast("decimal(18,2)")).withColumn("credit", (F.col("credit") + more).cast("decimal(18,2)"))
    ledger, _ = statements.process_statements(_statement_lines(o), [lines.LineFormat()], CATEGORIES, ["statement"], second=_statement_lines(other))
    return ledger.select("statement_id", "seq", *_c("debit", "credit", "unassigned", "balance"), "status", F.array_join("reasons", ";").alias("reasons"))


#: What the statements of line_formats look like, by account % 8.
FORMATS = (
    lines.LineFormat(), lines.LineFormat(thousands=" ", year=False), lines.LineFormat(fee_column=True), lines.LineFormat(trailing_column=True), lines.LineFormat(unmarked_is_debit=True),
    lines.LineFormat(thousands=" "), lines.LineFormat(year=False, trailing_column=True, unmarked_is_debit=True), lines.LineFormat(thousands=" ", fee_column=True),
)


def line_formats(spark, sf):
    """Statements in eight formats read back: blanks in thousands, no years, fees, a column behind, Cr and Dr marks; in the first, descriptions that go on, and every 13th line without a balance."""
    o = _printable(spark, sf).withColumn("k", F.col("account").cast("int") % 8)
    o = o.withColumn("fee", F.when(F.col("k").isin(2, 7) & (F.col("line_no") % 11 == 0), 5).otherwise(0).cast("decimal(18,2)"))
    o = o.withColumn("b", (F.col("b") - F.sum("fee").over(Window.partitionBy("account").orderBy("line_no"))).cast("decimal(18,2)"))
    day, b = F.date_format("date", "dd/MM/yyyy"), _shown(F.col("b"))
    amount, none = _shown(F.col("a")), F.lit(None).cast("string")
    marked = lambda x, is_in: F.concat(x, F.when(is_in, " Cr").otherwise(" Dr"))
    text_of = (
        F.when(F.col("k") == 0, F.concat_ws(" ", day, "description", amount, F.when(F.col("line_no") % 13 != 0, b)))
        .when(F.col("k") == 1, F.concat_ws(" ", F.date_format("date", "dd MMM"), "description", F.lit("no"), F.translate(amount, ",", " "), F.translate(b, ",", " ")))
        .when(F.col("k") == 2, F.concat_ws(" ", day, "description", amount, F.when(F.col("fee") > 0, F.concat(_shown(F.col("fee")), F.lit("*"))), b))
        .when(F.col("k") == 3, F.concat_ws(" ", day, "description", amount, b, F.lit("0.00")))
        .when(F.col("k") == 4, F.concat_ws(" ", day, "description", F.when(F.col("credit").isNotNull(), F.concat(amount, F.lit("Cr"))).otherwise(amount), marked(_shown(F.abs("b")), F.col("b") >= 0)))
        .when(F.col("k") == 5, F.concat_ws(" ", day, "description", F.lit("no"), F.translate(amount, ",", " "), F.translate(b, ",", " ")))
        .when(F.col("k") == 6, F.concat_ws(" ", F.date_format("date", "dd MMM"), "description", F.when(F.col("credit").isNotNull(), F.concat(amount, F.lit("Cr"))).otherwise(amount), marked(_shown(F.abs("b")), F.col("b") >= 0), F.lit("3.00")))
        .otherwise(F.concat_ws(" ", day, "description", F.lit("no"), F.translate(amount, ",", " "), F.when(F.col("fee") > 0, F.concat(_shown(F.col("fee")), F.lit("*"))), F.translate(b, ",", " ")))
    )
    wrapped = F.when((F.col("k") == 0) & (F.col("line_no") % 7 == 0) & (F.col("line_no") % 13 != 0), F.concat(F.lit("ref X"), F.col("line_no").cast("string"))).otherwise(none)
    printed = o.select("account", "k", (F.col("line_no") * 2).cast("bigint").alias("line_no"), F.array_compact(F.array(text_of, wrapped)).alias("t"))
    printed = printed.select("account", "k", "line_no", F.posexplode("t").alias("more", "text")).select("account", "k", (F.col("line_no") + F.col("more")).alias("line_no"), "text")
    head = o.select("account", "k").distinct().select("account", "k", F.lit(0).cast("bigint").alias("line_no"), F.lit("Opening Balance: 0.00").alias("text"))
    every, out = stored(lines.cut_lines(printed.unionByName(head), ["account", "k"])), None
    for k, fmt in enumerate(FORMATS):
        rows = lines.read_lines(every.where(F.col("k") == k), fmt, BY)[0]
        out = rows if out is None else out.unionByName(rows)
    return out.select("account", "seq", "date_text", "description", *_c("debit", "credit", "unassigned", "balance"))


def printed_totals(spark, sf):
    """The total that counts where months print theirs and perhaps a grand one."""
    o = _read(spark, sf, "orders").select(F.col("o_custkey").alias("account"), "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c"))
    some = F.col("o_orderkey") % 7 < 2
    g = o.groupBy("account").agg(F.collect_list(F.when(some, money.from_cents(F.col("c")))).alias("found"), F.when(F.col("account") % 2 == 0, money.from_cents(F.max(F.when(some, F.col("c"))))).alias("read"))
    return g.select("account", cents(assess.printed_total(F.col("found"), F.col("read"))).alias("total"))


def vat_return_total(spark, sf):
    out = reports.vat_return(order_ledger(spark, sf).withColumn("account", F.lit("all")), BY)
    return reports.vat_return_total(out, BY).select("field", _exact("amount"))


def vat_summary_total(spark, sf):
    out = reports.vat_summary_total(reports.vat_summary(order_ledger(spark, sf).withColumn("account", F.lit("all")), BY), BY)
    return out.select(*_c("income", "expenses", "difference"), *[_exact(c) for c in ("vat_on_income", "vat_on_expenses", "income_excl", "expenses_excl", "difference_excl")])


def category_breakdown_month(spark, sf):
    """One month's categories, with the share that each has of the account's expenses."""
    out = reports.category_breakdown(order_ledger(spark, sf), BY, month="1995-03")
    return out.select("account", "type", "category", "transactions", *_c("money_in", "money_out", "net"), "share_bp")


def entry_lines(spark, sf):
    """Lines of figures that belong to the dated line before."""
    e = _read(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.to_date("ts")).alias("line_date"), (F.col("event_id") % 4).alias("n_figures"), F.when(F.col("event_id") % 11 != 0, "line").alias("text"))
    return chain.link_entry_lines(e, ["user_id"], ["event_id"]).select("user_id", "event_id", F.col("entry_date").cast("string").alias("entry_date"))


def listed_lines(spark, sf):
    """Lines that stand in a list under a heading, and are no transactions."""
    n = F.col("event_id") % 5
    e = _read(spark, sf, "events").select("user_id", "event_id", n.isin(1, 2).alias("single"), (n == 0).alias("is_heading"), (F.col("event_id") % 7 == 3).alias("is_blank"))
    return chain.listed_lines(e, ["user_id"], ["event_id"]).where("listed").select("user_id", "event_id")


def run_stats(spark, sf):
    """Files seen, known and new, and the rows that they added."""
    c = _read(spark, sf, "customer").select(F.col("c_name").alias("source_id"), F.sha2(F.col("c_mktsegment").cast("binary"), 256).alias("content_hash"), "c_custkey")
    return reports.run_stats(c, c.where("c_custkey % 2 = 0"), _read(spark, sf, "orders").where("o_custkey % 2 = 1")).select("files", "skipped", "processed", "rows_added")


def _sheet(spark, sf):
    """Orders as text cells of sheets: signs unsaid in three of four, balances printed in two of three, some cells spoilt."""
    o = order_ledger(spark, sf).where("unassigned is null")
    zero = F.lit(0).cast("decimal(18,2)")
    w = Window.partitionBy("account").orderBy(*ORDER)
    o = o.withColumn("b", F.sum(F.coalesce("credit", zero) - F.coalesce("debit", zero)).over(w).cast("decimal(18,2)")).withColumn("row_no", F.row_number().over(w).cast("bigint"))
    amount = F.coalesce("credit", "debit").cast("string")
    none = F.lit(None).cast("string")
    cells = o.select(
        "account", "row_no", F.date_format("date", "yyyy-MM-dd").alias("date"), "description",
        none.alias("debit"), none.alias("credit"),
        F.when(F.col("seq") % 97 == 0, "illegible").otherwise(amount).alias("amount"),
        F.when(F.col("seq") % 4 == 0, F.when(F.col("credit").isNotNull(), "Cr").otherwise("DR")).alias("type"),
        F.when(F.col("seq") % 89 == 0, "?").when(F.col("seq") % 3 != 0, F.col("b").cast("string")).alias("balance"),
    )
    return cells


def sheet_rows(spark, sf):
    """Sheets read back: each group of rows up to a printed balance confirmed by it, or marked with why not."""
    head = order_ledger(spark, sf).select("account").distinct().select("account", F.when(F.col("account").cast("int") % 6 != 0, F.lit(0)).cast("decimal(18,2)").alias("opening"))
    out = sheets.sheet_transactions(_sheet(spark, sf), BY, opening=head)
    return out.select("account", "seq", F.col("date").cast("string").alias("day"), "description", *_c("debit", "credit", "unassigned", "balance"), "check")


def delimited_cells(spark, sf):
    """Accounts as delimited files with another mark each, quoted fields that hold marks, quotes and line breaks, read back as cells."""
    o = order_ledger(spark, sf).select("account", "seq", "description", F.coalesce("debit", "credit", "unassigned").cast("string").alias("a"))
    k = (F.col("account").cast("int") % 4).cast("int")
    mark = F.get(F.array(*map(F.lit, files.DELIMITERS)), k)
    said = F.when(F.col("seq") % 3 == 0, F.concat(F.lit('"'), "description", mark, F.lit(' ""x""\n'), "seq", F.lit('"'))).otherwise(F.col("description"))
    record = F.concat("seq", mark, said, mark, "a", mark)
    whole = o.withColumn("record", record).groupBy("account").agg(F.array_sort(F.collect_list(F.struct("seq", "record"))).alias("r"))
    texts = whole.select(F.col("account").alias("path"), F.concat(F.array_join(F.transform("r", lambda x: x["record"]), "\r\n"), F.lit("\r\n")).alias("text"))
    return files.delimited_cells(texts).select("path", "row_no", "col_no", "value")


def paged_tables(spark, sf):
    """Tables cut from print, four rows a page: headers on the first page, on each page, or on the first with a page of another table after it; amounts with a sign, or a column for each way."""
    o = _printable(spark, sf)
    k, signed, n = F.col("account").cast("int") % 3, F.col("account").cast("int") % 2 == 0, F.col("line_no") - 1
    page = F.floor(n / 4)
    head = (page == 0) | (k == 2)
    blank = F.col("seq") % 11 == 0
    said = F.when(F.col("seq") % 5 == 0, " ").otherwise(F.col("description"))
    one = F.when(blank, "").otherwise(_shown(F.when(F.col("is_in"), F.col("a")).otherwise(-F.col("a"))))
    day = F.date_format("date", "dd/MM/yyyy")
    values = F.when(signed, F.array(day, said, one, _shown(F.col("b")))).otherwise(F.array(day, said, F.when(F.col("is_in") | blank, "").otherwise(_shown(-F.col("a"))), F.when(F.col("is_in") & ~blank, _shown(F.col("a"))).otherwise(""), _shown(F.col("b"))))
    shown_page = F.when((k == 1) & (page > 0), page + 1).otherwise(page)
    rows = o.select("account", shown_page.alias("page"), (n % 4 + 1 + head.cast("int")).alias("row_no"), values.alias("v"))
    titles = F.when(signed, F.array(*map(F.lit, ("Date", "Narrative", "Amount", "Balance")))).otherwise(F.array(*map(F.lit, ("Posting date", "Details", "Debit", "Credit", "Balance"))))
    heads = o.where(head).select("account", shown_page.alias("page"), F.lit(1).alias("row_no"), titles.alias("v")).distinct()
    other = o.where(k == 1).select("account", F.lit(1).alias("page"), F.lit(1).alias("row_no"), F.array(F.lit("Summary"), F.lit("12.00")).alias("v")).distinct()
    every = reduce(lambda a, b: a.unionByName(b), [x.select("account", F.col("page").cast("long").alias("page"), F.col("row_no").cast("long").alias("row_no"), "v") for x in (rows, heads, other)])
    cells = every.select(F.col("account").alias("path"), "page", "row_no", F.posexplode("v").alias("c", "value")).select("path", "page", "row_no", (F.col("c") + 1).cast("long").alias("col_no"), "value")
    out = files.paged_transactions(files.paged_rows(cells))
    return out.select("path", "page", "row_no", F.col("date").cast("string").alias("day"), "description", *_c("debit", "credit", "balance"))


def split_statements(spark, sf):
    """Files of several statements: of every two pages the first one prints the period."""
    o = _printable(spark, sf).withColumn("page", F.floor((F.col("line_no") - 1) / 3).cast("long"))
    printed = o.select("account", "page", F.col("line_no").cast("long").alias("line_no"), F.lit("a row").alias("text"))
    head = o.where("page % 2 = 0").select("account", "page", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("Statement Period: 01/01/"), (F.col("page") + 1990).cast("string"), F.lit(" to 31/12/"), (F.col("page") + 1990).cast("string")).alias("text")).distinct()
    return statements.split_statements(printed.unionByName(head), BY).select("account", "page", "line_no", "statement")


def word_lines(spark, sf):
    """Words with boxes, a part's name a line, put together again."""
    p = _read(spark, sf, "part").select(F.floor(F.col("p_partkey") / 40).cast("bigint").alias("page"), (F.col("p_partkey") % 40).alias("line"), F.posexplode(F.split("p_name", " ")).alias("k", "text"))
    y = F.col("line") * 14.0 + (F.col("k") % 3) * 0.5
    words = p.select("page", (F.col("k") * 40.0).alias("x0"), y.alias("y0"), (F.col("k") * 40.0 + 30).alias("x1"), (y + 10).alias("y1"), "text")
    return sheets.lines_from_words(words, ["page"])


def printed_figures(spark, sf):
    """The figures of a line in four styles: how many, their sum and their signs; and beside them the sum of the other readings, of digits set apart by blanks."""
    o = _read(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c"))
    shown = _shown(money.from_cents(F.col("c")))
    k = (F.col("o_orderkey") % 4).cast("int")
    t = F.get(F.array(shown, F.translate(shown, ",.", ".,"), F.translate(shown, ",", " "), F.translate(shown, ",.", " ,")), k)
    line = F.concat(F.lit("12/03/2024 ref 12.345 at 10:15 paid "), t, F.lit(" ("), t, F.lit(") R"), t, F.lit("Dr 15.5% -"), t, F.lit(" end "), t, F.lit("Cr"))
    o = o.select("o_orderkey", k.alias("k"), figures.lattice(figures.words_of(line)).alias("tokens"))
    out = o.withColumn("f", figures.read_as(F.col("tokens"), F.when(F.col("k") % 2 == 0, ".").otherwise(","), F.col("k") > 1))
    total = lambda x, of: F.aggregate(x, F.lit(0).cast("bigint"), lambda n, f: n + F.coalesce(cents(of(f)), F.lit(0)))
    signs = F.array_join(F.transform("f", lambda f: F.coalesce(f["sign"].cast("string"), F.lit("?"))), " ")
    return out.select("o_orderkey", F.size("f").cast("bigint").alias("n"), total(F.col("f"), lambda f: f["value"]).alias("total"), signs.alias("signs"), total(F.col("tokens"), lambda x: x["value"]).alias("apart"), F.array_max(F.transform("tokens", lambda x: x["last"])).cast("bigint").alias("last_word"))


def ledger_names(spark, sf):
    """Ids of statements and names of ledgers from file names."""
    c = _read(spark, sf, "customer")
    part = F.when(F.col("c_custkey") % 3 == 0, " (statement 2 of 3)").otherwise("")
    stored = F.concat(F.substring(F.sha2(F.col("c_name").cast("binary"), 256), 1, 12), F.lit("_"), "c_name", F.lit(".pdf"), part)
    name = F.when(F.col("c_custkey") % 2 == 0, stored).otherwise(F.concat("c_name", F.lit(".pdf")))
    c = c.select("c_custkey", name.alias("f"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey").cast("string")).alias("a"), F.when(F.col("c_custkey") % 7 == 0, "UNMAPPED_CLIENT").otherwise(F.concat(F.lit("A/B "), "c_mktsegment")).alias("who"))
    return c.select("c_custkey", keys.statement_id(F.col("f")).alias("statement_id"), keys.ledger_name(F.col("who"), F.col("a"), F.col("f")).alias("ledger"))


def session_stats(spark, sf):
    rows = order_ledger(spark, sf)
    return reports.session_stats(rows, rows.select("account", "month").distinct()).select("statements", "rows", "accounts", "to_review", _exact("vat"))


def dominant_category(spark, sf):
    return reports.dominant(order_ledger(spark, sf), "category", BY)


QUERIES = {
    f.__name__: f
    for f in (
        monthly_summary, monthly_total_rollup, monthly_table, balance_breaks, workbook_gaps, opening_closing, flag_duplicates, flag_date_order,
        confirm_groups, page_segments, missing_pages, income_statement_pivot, cash_flow, cash_flow_total, category_breakdown, spend_by_category,
        vat_by_month, vat_return, vat_return_by_period, range_of_months, vat_registration, newest_files, review_lines, vat_summary, vat_net_lineitem, month_vat_sheet, period_summary, vat_periods_ab, overview, money_chart,
        categorize_first_match, rule_table, bank_facts, report_categories, row_key_dedup, file_registry, mixed_accounts, parse_amount_formats, parse_date_formats,
        fiscal_calendar, same_words, telling_words, garbled_figures, rand_format, learned_category, category_lifecycle, assess_rows,
        assess_statements, choose_reading, compare_readings, read_lines, unknown_layouts, yearless_dates, client_of_files, statement_styles, statement_ledger, sheet_rows, delimited_cells, paged_tables, split_statements, word_lines, printed_figures, ledger_names,
        session_stats, dominant_category, second_reading, line_formats, printed_totals, vat_return_total, vat_summary_total,
        category_breakdown_month, entry_lines, listed_lines, run_stats,
    )
}
