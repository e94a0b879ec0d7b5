"""Statements in many made-up styles, read back row by row; and cases that a reader must not guess at."""

from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import figures
from ledgerloom.operators import beam, layout

DATES = {"dmy": "%d/%m/%Y", "dashes": "%d-%m-%Y", "points": "%d.%m.%Y", "iso": "%Y-%m-%d", "words": "%d %b %Y", "us": "%b %d, %Y"}
SIGNS = ("columns", "minus", "crdr", "cr", "trailing", "brackets")
LINES = "s string, line_no long, text string"


def _money(cents: int, gap: str, mark: str) -> str:
    whole, part = divmod(abs(cents), 100)
    return f"{whole:,}".replace(",", gap) + f"{mark}{part:02d}"


class Printed:
    """A statement and the rows that it has: (date, debit, credit, balance)."""

    def __init__(self, seed: int):
        r = random.Random(seed)
        self.mark, self.gap = r.choice([(".", ","), (".", " "), (".", ""), (",", "."), (",", " ")])
        self.sign, self.currency, form = r.choice(SIGNS), r.choice(["", "", "R"]), DATES[r.choice(list(DATES))]
        every, fees, listed, behind = r.random() < 0.6, r.random() < 0.4, r.random() < 0.4, r.random() < 0.3
        fee_lines = fees and not behind and r.random() < 0.5
        every = every or fee_lines or behind or self.sign == "columns" and fees
        balance = r.randrange(100_000, 5_000_000)
        self.lines, self.rows = ["Some Bank Limited", f"{r.choice(['Opening balance', 'Balance brought forward', 'Previous balance'])} {self.shown(balance, False)}"], []
        day = date(2026, 3, 1)
        for k in range(r.randrange(8, 25)):
            last_of_day = every or r.random() < 0.5 or k == 7
            cents, fee = r.randrange(100, 4_000_000) * r.choice([1, -1, -1]), r.choice([0, 0, 550, 1200]) if fees and last_of_day else 0
            words = f"{r.choice(['Shop', 'Pay', 'Rent', 'Fuel'])} {r.choice(['A', 'ref B', 'no'])}{r.randrange(1000, 9999)}x"
            balance += cents - fee
            text = [day.strftime(form), words, self.shown(cents, True)]
            end = [self.shown(balance, False)] if last_of_day else []
            iso = day.isoformat()
            self.rows.append((iso, -cents if cents < 0 else None, cents if cents > 0 else None, balance if end and not fee else None))
            if fee:
                self.rows.append((iso, fee, None, balance))
            plain = _money(fee, self.gap, self.mark)
            if fee and fee_lines:
                self.lines += [" ".join(text), " ".join(["Charge", self.shown(-fee, True), *end])]
            else:
                self.lines.append(" ".join([*text, *([plain] if fee else []), *end, *([f"0{self.mark}00"] if behind else [])]))
            if last_of_day:
                day += timedelta(days=r.choice([0, 1, 2]))
        if not last_of_day:
            balance -= 1234
            self.lines.append(" ".join([day.strftime(form), "Last", self.shown(-1234, True), self.shown(balance, False)]))
            self.rows.append((day.isoformat(), 1234, None, balance))
        self.lines.append(f"Closing balance {self.shown(balance, False)}")
        if listed:
            self.lines += ["Debit orders still pending", *[f"{day.strftime(form)} Later {n} {_money(n * 1357, self.gap, self.mark)}" for n in (1, 2)]]

    def shown(self, cents: int, moves: bool) -> str:
        body, out = self.currency + _money(cents, self.gap, self.mark), cents < 0
        if self.sign == "crdr":
            return body + ("Dr" if out else "Cr")
        if self.sign == "cr":
            return body + ("" if out else "Cr")
        if self.sign == "trailing":
            return body + ("-" if out else "")
        if self.sign == "brackets":
            return f"({body})" if out else body
        return body if self.sign == "columns" and moves or not out else "-" + body


def _read(spark, statements: dict[str, list[str]]):
    df = spark.createDataFrame([(s, k, t) for s, text in statements.items() for k, t in enumerate(text)], LINES)
    rows, heads = layout.read_unknown(df.repartition(3), ["s"])
    out: dict[str, list] = {s: [] for s in statements}
    for r in rows.orderBy("s", "seq").collect():
        out[r.s].append(r)
    return out, {r.s: r for r in heads.collect()}


def _plain(r):
    cents = lambda v: None if v is None else int(v * 100)
    return (str(r.date), cents(r.debit), cents(r.credit), cents(r.balance))


def test_sixty_styles(spark):
    made = {f"{k:02d}": Printed(k) for k in range(60)}
    read, _ = _read(spark, {s: p.lines for s, p in made.items()})
    wrong = {s: [(x, _plain(y)) for x, y in zip(p.rows, read[s], strict=False) if x != _plain(y)][:2] or (len(p.rows), len(read[s])) for s, p in made.items() if p.rows != [_plain(r) for r in read[s]]}
    assert not wrong
    assert all(r.confirmed for rows in read.values() for r in rows)


def test_two_readings_of_a_figure(spark):
    """'3 250.00' is what makes the balance right, here and there."""
    read, heads = _read(
        spark,
        {
            "words": ["Opening balance 1 000.00", "01 Mar 2026 Shop 3 250.00 750.00", "02 Mar 2026 Pay 500.00 1 250.00"],
            "number": ["Opening balance 9 000.00", "01 Mar 2026 Shop 3 250.00 5 750.00", "02 Mar 2026 Rent 1 5 000.00 750.00"],
            "waits": ["Opening balance 9 000.00", "01 Mar 2026 Shop 3 250.00", "01 Mar 2026 Shop 2 250.00 3 500.00"],
        },
    )
    assert [(r.description, str(r.debit or r.credit)) for r in read["words"]] == [("Shop 3", "250.00"), ("Pay", "500.00")]
    assert [(r.description, str(r.debit)) for r in read["number"]] == [("Shop", "3250.00"), ("Rent 1", "5000.00")]
    assert [str(r.debit) for r in read["waits"]] == ["3250.00", "2250.00"]
    assert heads["words"].opening == Decimal("1000.00") and all(r.confirmed for rows in read.values() for r in rows)


def test_nothing_is_guessed(spark):
    read, _ = _read(
        spark,
        {
            # 40 in and 40 out, in this order or the other one
            "either": ["Opening balance 100.00", "01 Mar 2026 a 40.00", "01 Mar 2026 b 40.00", "02 Mar 2026 c 10.00 90.00"],
            # a balance that does not follow, and follows on
            "odd": ["Opening balance 100.00", "01 Mar 2026 a 10.00 90.00", "02 Mar 2026 b 5.00 58.00", "03 Mar 2026 c 5.00 80.00"],
            # nothing above the first row
            "bare": ["01 Mar 2026 a 10.00 90.00", "02 Mar 2026 b 5.00 85.00"],
            # never a balance
            "none": ["Opening balance 100.00", "01 Mar 2026 a 10.00", "02 Mar 2026 b 5.00-"],
        },
    )
    show = lambda s: [(str(r.debit or ""), str(r.credit or ""), str(r.unassigned or ""), str(r.balance or ""), r.confirmed) for r in read[s]]
    assert show("either") == [("", "", "40.00", "", False), ("", "", "40.00", "", False), ("10.00", "", "", "90.00", True)]
    assert [r.ambiguous for r in read["either"]] == [True, True, False]
    assert show("odd") == [("10.00", "", "", "90.00", True), ("5.00", "", "", "58.00", False), ("5.00", "", "", "80.00", True)]
    assert show("bare") == [("", "", "10.00", "90.00", False), ("5.00", "", "", "85.00", True)]
    # the one mark that there is says that amounts without one come in
    assert show("none") == [("", "10.00", "", "", False), ("5.00", "", "", "", False)]


def test_lines_that_belong_together(spark):
    """An entry under its date, a list under its heading, descriptions over three lines, lines that are about the statement."""
    text = ["Opening balance 100.00", "01 Mar 2026 Card purchase", "10.00 90.00", "in a shop", "by the sea", "03 Mar 2026 Rent 20.00 70.00", "Page 1 of 2", "Scheduled payments", "09 Mar 2026 Later 30.00", "10 Mar 2026 Later 40.00", "Closing balance 70.00"]
    read, heads = _read(spark, {"s": text})
    assert [(r.description, str(r.date), str(r.debit)) for r in read["s"]] == [("Card purchase in a shop by the sea", "2026-03-01", "10.00"), ("Rent", "2026-03-03", "20.00")]
    assert heads["s"].closings == [Decimal("70.00")]


def test_edges(spark):
    """Null, empty and very long lines, repeated numbers, statements without rows, no lines at all."""
    long = "01 Mar 2026 " + "word " * 20_000 + "1.00 2.00"
    read, heads = _read(spark, {"long": [long], "empty": ["", None, "   "], "words": ["nothing here"], "many": ["Opening balance 10.00", "01 Mar 2026 " + "1.00 " * 30]})
    assert [len(read[s]) for s in ("long", "empty", "words", "many")] == [1, 0, 0, 2]  # thirty figures: an amount, a fee and a balance
    assert len(heads) == 4
    none = spark.createDataFrame([], LINES)
    rows, heads = layout.read_unknown(none, ["s"])
    assert not rows.count() and not heads.count()


@pytest.mark.parametrize("text, want", [("a 12 345 678.90 b", [(3, 3, "678.90", (1, "12345678.90"))]), ("x 1234 567.00", [(2, 2, "567.00", None)]), ("- R 5.00 Cr", [(1, 3, "5.00", None)]), ("(1 234,50) 7,00-", [(1, 1, "234.50", (0, "1234.50")), (2, 2, "7.00", None)]), ("1,2345.00 12.345 1.000.00 5.0 5% 5.00%", []), (None, [])])
def test_lattice(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(figures.lattice(figures.words_of(F.col("t"))).alias("x")).first().x
    assert [(t.first, t.last, str(t.value), t.joined and (t.joined.first, str(t.joined.value))) for t in got] == want


def test_many_waiting_amounts_are_bounded():
    """Thirty amounts before one balance: too many sums to tell apart, so that they are kept as printed."""
    fig = lambda v: [(beam.Figure(3, v, None), 0)]
    lines = [(k, True, False, [fig(100 * 2**k)]) for k in range(30)] + [(30, True, False, [fig(100), fig(5000)])]
    rows, _ = beam.read_along(lines, beam.Style(None, False), [1000], [])
    assert len(rows) == 31 and all(r.way is None for r in rows[:-1]) and not any(r.confirmed for r in rows)
