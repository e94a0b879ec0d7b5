"""What SQL cannot show: files, versions, streams, rule files, and what happens when everything is read twice."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, text
from ledgerloom.functions.keys import with_row_keys
from ledgerloom.functions.money import parse_amount, rand
from ledgerloom.operators import chain, ingest, rules, sheets
from ledgerloom.plans import reports
from ledgerloom.sources import files, settings
from ledgerloom.sources.demo import BY, ORDER, order_ledger
from ledgerloom.streaming.ingest import ingest_stream

ROW = "account string, client string, bank string, date date, description string, debit decimal(18,2), credit decimal(18,2), unassigned decimal(18,2), balance decimal(18,2), source_file string, seq long"


def _row(seq, description, debit=None, credit=None, balance=None, account="1", day=1, source="a.pdf"):
    d = lambda v: None if v is None else Decimal(str(v))
    return (account, "c", "b", date(2026, 3, day), description, d(debit), d(credit), None, d(balance), source, seq)


def test_amounts(spark):
    cases = {"1,234.56": "1234.56", "(12.50)": "-12.50", "R 5.00 Dr": "-5.00", "1.234,56": "1234.56", "12,50": "12.50", "1,234": "1234.00", "-": None, "n/a": None, "": None, "abc": None, "--": None, None: None, "7.5Cr": "7.50", "1-2": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", parse_amount(F.col("t")).cast("string").alias("v"))
    assert {r.t: r.v for r in df.collect()} == cases


def test_dates_without_a_year(spark):
    cases = [(31, 12, date(2025, 12, 15), date(2026, 1, 14), date(2025, 12, 31)), (2, 1, date(2025, 12, 15), date(2026, 1, 14), date(2026, 1, 2)), (29, 2, date(2026, 2, 1), date(2026, 2, 28), date(2024, 2, 29)), (31, 2, date(2026, 2, 1), date(2026, 2, 28), None), (5, 6, None, date(2026, 3, 31), date(2025, 6, 5))]
    df = spark.createDataFrame([c[:4] for c in cases], "d int, m int, a date, z date")
    got = df.select(dates.date_in_period(F.col("d"), F.col("m"), F.col("a"), F.col("z")).alias("x")).collect()
    assert [r.x for r in got] == [c[4] for c in cases]


def test_small_text_functions(spark):
    one = spark.range(1)
    got = one.select(
        text.escape_html(F.lit("<a & 'b'>")).alias("h"), text.safe_file_name(F.lit("a b/c.pdf")).alias("f"), text.heading(F.lit(" Money-Out (R) ")).alias("g"),
        text.clean_scan(F.lit("| 12.00Cr: | x")).alias("s"), text.account_number(F.lit("Account No: 62 000-1"), [r"No: ([\d -]+)"]).alias("n"), rand(F.lit(Decimal("-1234.5")).cast("decimal(18,2)")).alias("r"),
    ).first()
    assert (got.h, got.f, got.g, got.n, got.r) == ("&lt;a &amp; &#x27;b&#x27;&gt;", "a_b_c.pdf", "money out r", "620001", "-R 1 234.50")
    assert "12.00Cr" in got.s


def test_break_shows_once(spark):
    rows = spark.createDataFrame([_row(1, "a", None, 100, 100), _row(2, "b", 10, None, 95), _row(3, "c", 5, None, 90), _row(4, "d", 5), _row(5, "e", 5, None, 70)], ROW)
    got = chain.balance_chain(rows, BY, ["seq"]).where("breaks").select("seq", "expected", "missing").collect()
    assert [(r.seq, r.expected, r.missing) for r in got] == [(2, Decimal("90.00"), Decimal("5.00"))]


def test_second_ingestion_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([_row(1, "fee x", 2, None, 98), _row(2, "fee x", 2, None, 98), _row(3, "wrapped words", None, 5, 103)], ROW)
    table = ingest.VersionedTable(spark, f"file://{tmp_path}/ledger")
    assert ingest.ingest(table, rows, ["seq"]).count() == 3  # equal fees are two rows
    assert ingest.ingest(table, rows.withColumn("description", F.concat(F.lit(" "), F.upper("description"))), ["seq"]).count() == 3
    assert ingest.ingest(table, spark.createDataFrame([_row(9, "new", 1, None, 102)], ROW), ["seq"]).count() == 4
    other = spark.createDataFrame([_row(1, "x", 1, account="2")], ROW)
    with pytest.raises(ingest.MixedAccountsError):
        ingest.ingest(table, other, ["seq"], one_account=True)
    assert len(table.versions()) == 3 and table.read().count() == 4
    table.save(table.read(), keep=2)
    assert len(table.versions()) == 2


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both have seen the same version; one of them was first. A folder that another writer still fills stays."""
    table = ingest.VersionedTable(spark, f"file://{tmp_path}/ledger")
    rows = lambda k: spark.createDataFrame([_row(10 * k + n, f"r{k}-{n}", n + 1) for n in range(3)], ROW)
    (tmp_path / "ledger" / "__rows=unfinished").mkdir(parents=True)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: ingest.VersionedTable(spark, table.path).add(rows(k), keep=3), range(8)))
    assert table.read().count() == 24 and len(table.versions()) == 3
    assert (tmp_path / "ledger" / "__rows=unfinished").exists()
    # The loser of a number compares its keys with what the winner added.
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: ingest.ingest(ingest.VersionedTable(spark, f"file://{tmp_path}/keyed"), rows(k // 2), ["seq"]), range(6)))
    assert ingest.VersionedTable(spark, f"file://{tmp_path}/keyed").read().count() == 9


def test_second_writer_tries_the_next_number(spark, tmp_path):
    table = ingest.VersionedTable(spark, f"file://{tmp_path}/ledger")
    rows = lambda k: spark.createDataFrame([_row(k, f"r{k}", 1)], ROW)
    table.add(rows(0))
    seen = []

    def make(version):
        if not seen:  # another writer commits between our look and our commit
            ingest.VersionedTable(spark, table.path).add(rows(1))
        seen.append(version)
        return table.folders(version), [table._write(rows(2))]

    table.commit(make)
    assert len(seen) == 1 and table.read().count() == 3 and table.versions()[-1] == "v-000000000003"


def test_reviews_are_replaced_by_marks(spark, tmp_path):
    table = ingest.VersionedTable(spark, f"file://{tmp_path}/reviews")
    line = lambda f, n: spark.createDataFrame([(f, n)], "source_file string, issues string")
    for f, n in (("a", "1"), ("b", "1"), (None, "1")):
        table.add(line(f, n))
    before = {n for n in table.folders()}
    ingest.replace_reviews(table, line("a", "2").union(line(None, "2")))
    ingest.replace_reviews(table, line("a", "3"))
    show = lambda t: sorted((r.source_file or "", r.issues) for r in t.collect())
    assert show(table.read()) == [("", "2"), ("a", "3"), ("b", "1")] and before <= set(table.folders())
    assert show(table.read(table.versions()[2])) == [("", "1"), ("a", "1"), ("b", "1")]
    table.compact(keep=1)
    assert show(table.read()) == [("", "2"), ("a", "3"), ("b", "1")] and len(table.folders()) == 1


def test_a_batch_reads_the_buckets_it_touches(spark, tmp_path):
    table = ingest.VersionedTable(spark, f"file://{tmp_path}/ledger", buckets=16)
    many = spark.createDataFrame([_row(k, f"r{k}", k + 1, account=str(k % 40)) for k in range(400)], ROW)
    ingest.ingest(table, many, ["seq"])
    batch = with_row_keys(spark.createDataFrame([_row(3, "r3", 4, account="3"), _row(900, "new", 4, account="3")], ROW), ["seq"]).drop("occurrence")
    fresh = ingest._fresh(table, batch, table.versions()[-1])
    assert [r.description for r in fresh.collect()] == ["new"]
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "FileScan parquet" in x and "row_key" in x)
    assert "__bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]
    joined = plan.split("LeftSemi", 1)[1]
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(row_key" not in joined.split("FileScan parquet")[0]
    assert ingest.ingest(table, batch.drop("row_key"), ["seq"]).count() == 401


def test_any_order_of_batches(spark, tmp_path):
    """A late statement redoes its own account's months and gaps; the order of arrival doesn't matter."""
    rows = spark.createDataFrame([_row(k, f"r{k}", None, 10, 10 * (k // 3 + 1) + (5 if k == 13 else 0), account=str(k % 3), day=k + 1) for k in range(24)], ROW).withColumn("month", F.lit("2026-03"))
    months = lambda df: chain.month_balances(df, BY, ["seq"])
    gaps = lambda df: chain.balance_gaps(df, BY, ["seq"])
    want = [sorted(map(str, make(rows).collect())) for make in (months, gaps)]
    for name, order in (("up", (0, 1, 2, 3)), ("down", (3, 1, 0, 2))):
        (tmp_path / f"land-{name}").mkdir()
        tables = [ingest.VersionedTable(spark, f"file://{tmp_path}/{name}-{t}", buckets=4) for t in ("ledger", "months", "gaps")]
        for k in order:
            rows.where(F.col("seq") % 4 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/land-{name}")
            stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/land-{name}")
            ingest_stream(stream, tables[0], ["seq"], f"{tmp_path}/check-{name}", derived=[(tables[1], months), (tables[2], gaps)]).awaitTermination(120)
        got = [sorted(map(str, t.read().select(*make(rows).columns).collect())) for t, make in zip(tables[1:], (months, gaps), strict=True)]
        assert got == want, name


def test_stream_replays(spark, tmp_path):
    rows = spark.createDataFrame([_row(k, f"r{k}", k + 1) for k in range(20)], ROW)
    rows.repartition(3).write.parquet(f"{tmp_path}/landed")
    table = ingest.VersionedTable(spark, f"file://{tmp_path}/ledger")
    for k in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/landed")
        ingest_stream(stream, table, ["seq"], f"{tmp_path}/check{k}").awaitTermination(120)
    assert table.read().count() == 20


def test_delimited_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("My bank\nOpening balance,100\nTransaction Date,Details,Money Out,Money In,Running Balance\n2026-03-01,shop,30,,70\n2026-03-02,pay,,50,120\n2026-03-03,odd,5,,999\nCount of rows: 3\n")
    (tmp_path / "b.csv").write_bytes("Date;Narrative;Amount;Dr/Cr;Balance\n2026-03-01;\"x; y\";1 234,56;Dr;-1 234,56\n2026-03-02;z \xe9;34,56;Cr;-1 200,00\n".encode("latin-1"))
    cells = files.read_cells(files.scan_folder(spark, str(tmp_path)))
    tables = files.find_tables(cells)
    rows = files.table_rows(cells, tables).withColumn("file", F.element_at(F.split("path", "/"), -1))
    above = files.opening_above(cells, tables).select(F.element_at(F.split("path", "/"), -1).alias("file"), parse_amount(F.col("opening_text")).alias("opening"))
    got = sheets.sheet_transactions(rows, ["file"], opening=above).orderBy("file", "seq").collect()
    shown = [(r.file, r.description, r.debit and float(r.debit), r.credit and float(r.credit), r.check) for r in got]
    assert shown == [("a.csv", "shop", 30.0, None, ""), ("a.csv", "pay", None, 50.0, ""), ("a.csv", "odd", 5.0, None, "does_not_follow"), ("b.csv", "x; y", 1234.56, None, "no_earlier_balance"), ("b.csv", "z é", None, 34.56, "")]


def test_quotes_in_delimited_text(spark):
    texts = [("q", 'a;"x ""y"" ;z";1\r\n;"two\nlines";\n'), ("tab", "a\tb,c\n1\t2"), ("open", 'a,"never closed\nb,c'), ("empty", ""), ("none", None), ("bom", "\ufeffa|b")]
    got = {(r.path, r.row_no, r.col_no): r.value for r in files.delimited_cells(spark.createDataFrame(texts, "path string, text string")).collect()}
    assert [got["q", 1, k] for k in (1, 2, 3)] == ["a", 'x "y" ;z', "1"] and got["q", 2, 2] == "two\nlines" and got["q", 2, 3] == ""
    assert got["tab", 1, 2] == "b,c" and got["open", 1, 2] == '"never closed\nb,c' and got["bom", 1, 1] == "a"
    assert not any(k[0] in ("empty", "none") for k in got)


def test_cells_that_differ(spark):
    one = spark.createDataFrame([("a", "", 1, 1, "x"), ("a", "", 1, 2, "y"), ("a", "", 2, 1, " ")], files.CELLS)
    other = spark.createDataFrame([("a", "", 1, 1, "x"), ("a", "", 1, 2, "z"), ("a", "", 3, 1, "w")], files.CELLS)
    assert sorted((r.row_no, r.col_no, r.first, r.second) for r in files.differing_cells(one, other).collect()) == [(1, 2, "y", "z"), (3, 1, None, "w")]


def test_rule_files(spark, tmp_path):
    made = {"categories": [{"name": "Fuel", "type": "expense", "match": ["Garage"], "vat": True}, {"name": "Pay", "type": "income", "match": ["pay"]}], "banks": {"one": {"detect": ["First Bank"]}, "none": {"detect": []}}}
    (tmp_path / "r.json").write_text(json.dumps(made))
    categories = settings.load_categories(spark, f"{tmp_path}/r.json")
    assert [c.name for c in categories] == ["Fuel", "Pay", rules.OTHER_IN, rules.OTHER_OUT]
    assert settings.load_needles(spark, f"{tmp_path}/r.json", "banks") == [("one", ("first bank",))]
    rows = spark.createDataFrame([("GARAGE 5", None), ("payment", Decimal(1)), ("payment", None)], "d string, c decimal(18,2)")
    assert [r.x for r in rows.select(rules.categorize(F.col("d"), F.col("c"), categories).alias("x")).collect()] == ["Fuel", "Pay", rules.OTHER_OUT]
    with pytest.raises(ValueError):
        rules.Category("x", "nothing")


def test_other_partitions_same_result(spark, sf_dir):
    ledger = order_ledger(spark, sf_dir)
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(reports.monthly_summary(ledger, BY, ORDER)) == plain(reports.monthly_summary(ledger.repartition(9), BY, ORDER))


def test_months_add_up_to_the_total(spark, sf_dir):
    ledger = order_ledger(spark, sf_dir)
    months = reports.monthly_summary(ledger, BY, ORDER).agg(F.sum("money_in"), F.sum("money_out"), F.sum("transactions")).first()
    assert tuple(months) == tuple(ledger.agg(F.sum("credit"), F.sum("debit"), F.count(F.lit(1))).first())


def test_empty_ledger(spark, sf_dir):
    none = order_ledger(spark, sf_dir).where("false")
    assert not reports.monthly_summary(none, BY, ORDER).count()
    assert not with_row_keys(none.withColumn("client", F.lit("c")).withColumn("bank", F.lit("b")), ["seq"]).count()
    assert reports.session_stats(none, none).first()["rows"] == 0


def test_reports_as_files(spark, sf_dir, tmp_path):
    ledger = order_ledger(spark, sf_dir)
    names = reports.write_reports({"spend": reports.spend_by_category(ledger, BY)}, str(tmp_path), "csv")
    assert names == ["spend"] and spark.read.option("header", "true").csv(f"{tmp_path}/spend").count() == reports.spend_by_category(ledger, BY).count()


def test_header_by_alias(spark):
    cells = lambda path, *rows: [(path, "", r, c, v) for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1)]
    made = cells("a", ["Bank", "of it"], ["Posting  Date", "Description of entry", "Debit (R)", "Credit (R)", "Balance"]) + cells("b", ["Date", "Description", "Debit Credit", "Balance"])
    got = files.find_header(spark.createDataFrame(made, files.CELLS), {"date": ("date",), "description": ("description",), "debit": ("debit",), "credit": ("credit",), "amount": (), "balance": ("balance",)}).collect()
    assert [(r.path, r.header_row, r["columns"]) for r in got] == [("a", 2, {"date": 1, "description": 2, "debit": 3, "credit": 4, "balance": 5})]


def test_balance_type(spark):
    row = ("s", 1, "2026-03-01", "x", None, None, "5.00", None, "20.00", "Dr")
    rows = spark.createDataFrame([row], "f string, row_no int, date string, description string, debit string, credit string, amount string, type string, balance string, balance_type string")
    assert sheets.sheet_amounts(rows, ["f"]).first().bal == Decimal("-20.00")


def test_months_that_were_misread(spark):
    from ledgerloom.functions import figures

    cases = {"10 Der 2026 x": (None, None), "10 Dec 2026 x": (10, 12), "41 Mar 2026 x": (None, None), "10 Xyz 2026 x": None, "31/02/2026 x": (None, None), "1 Shop 20 x": None, "12Mar26 x": (12, 3)}
    kind = lambda t: "dmy" if "/" in t else "d_mon_y"
    for t, want in cases.items():
        r = spark.range(1).select(figures.date_parts(F.lit(t), kind(t)).alias("x")).first().x
        assert (None if r is None else (r.day, r.month)) == want, t


def test_nothing_is_approved_on_one_reading(spark):
    from ledgerloom.operators.lines import LineFormat
    from ledgerloom.plans import statements
    from ledgerloom.sources.demo import CATEGORIES

    text = ["Account Number: 62000111222", "Statement Period: 01/03/2026 to 31/03/2026", "Opening Balance: 100.00", "02/03/2026 shop 30.00 70.00", "05/03/2026 pay 50.00 120.00", "Total Debits: 30.00", "Total Credits: 50.00", "Closing Balance: 120.00"]
    rows = lambda t: spark.createDataFrame([("s", k, x) for k, x in enumerate(t)], "statement string, line_no long, text string")
    read = lambda **more: statements.process_statements(rows(text), [LineFormat()], CATEGORIES, ["statement"], **more)
    status = lambda out: [r.status for r in out[0].orderBy("seq").collect()] + [r.status for r in out[1].collect()]
    assert status(read()) == ["REVIEW_REQUIRED"] * 3
    assert status(read(second=rows(text))) == ["APPROVED"] * 3
    other = [x.replace("shop 30.00", "shop 80.00") for x in text]
    assert status(read(second=rows(other))) == ["REVIEW_REQUIRED", "APPROVED", "REVIEW_REQUIRED"]
