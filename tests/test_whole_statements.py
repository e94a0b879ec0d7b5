"""Work that must not grow with the number of statements or with what waits: batches, sums, lines made once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.operators import assess, beam
from ledgerloom.operators.lines import LineFormat
from ledgerloom.operators.whole import whole_statements
from ledgerloom.plans import statements
from ledgerloom.sources.demo import CATEGORIES


def test_statements_are_whole_wherever_batches_end():
    keys = ["a"] * 4 + ["b"] + ["c"] * 7 + [None] * 2 + ["d"]
    rows = pa.table({"s": keys, "n": list(range(len(keys)))})
    for size in range(1, 16):
        got = [(t.slice(int(a), int(b - a)).to_pydict()) for t, starts in whole_statements(iter(rows.to_batches(size)), ["s"]) for a, b in zip(starts, np.append(starts[1:], t.num_rows), strict=True)]
        assert [g["s"] for g in got] == [["a"] * 4, ["b"], ["c"] * 7, [None] * 2, ["d"]]
        assert [n for g in got for n in g["n"]] == list(range(len(keys)))


def _batch(texts: dict[str, list[list[int]]], opening: int) -> pa.Table:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("value", pa.int64()), ("sign", pa.int8()), ("joined_first", pa.int32()), ("joined_value", pa.int64()), ("joined_sign", pa.int8())]))
    rows = [(s, [{"first": 3 + k, "value": abs(v), "sign": -1 if v < 0 else None} for k, v in enumerate(line)]) for s, lines in texts.items() for line in lines]
    n = len(rows)
    cells = {"s": [s for s, _ in rows], "dated": [True] * n, "listed": [False] * n, "tokens": pa.array([t for _, t in rows], kind), "unmarked": pa.array([None] * n, pa.int32()), "flips": [False] * n}
    return pa.table(cells | {"openings": pa.array([[opening]] * n, pa.list_(pa.int64())), "closings": pa.array([[]] * n, pa.list_(pa.int64()))})


def test_many_statements_in_a_batch():
    """Told by arithmetic where each line has one way, else along the balance: a lost one, one that is odd, two ways, a fee."""
    texts = {"plain": [[10, 90], [20, 110]], "lost": [[10], [20, 70], [5, 75]], "odd": [[10, 90], [5, 58], [5, 80]], "either": [[40], [40], [10, 90]], "fee": [[10, 2, 88], [100, -12], [12, 0]]}
    table = _batch(texts, 100)
    starts = np.cumsum([0, *[len(x) for x in texts.values()]])[:-1]
    got = beam.read_statements(table, starts, ["s"]).to_pylist()
    show = [(r["s"], r["way"], r["amount"], r["fee"], r["balance"], r["confirmed"], r["ambiguous"]) for r in got]
    assert show == [
        ("plain", -1, 10, 0, 90, True, False), ("plain", 1, 20, 0, 110, True, False),
        ("lost", -1, 10, 0, None, True, False), ("lost", -1, 20, 0, 70, True, False), ("lost", 1, 5, 0, 75, True, False),
        ("odd", -1, 10, 0, 90, True, False), ("odd", -1, 5, 0, 58, False, False), ("odd", -1, 5, 0, 80, True, False),
        ("either", None, 40, 0, None, False, True), ("either", None, 40, 0, None, False, True), ("either", -1, 10, 0, 90, True, False),
        ("fee", -1, 10, 2, 88, True, False), ("fee", -1, 100, 0, -12, True, False), ("fee", 1, 12, 0, 0, True, False),
    ]
    assert {r["start"] for r in got} == {100}


def test_sums_of_waiting_amounts_are_kept_in_halves():
    """Twelve amounts move 4,096 sums; two halves of 64 tell them as well. Equal amounts move few sums, however many wait."""
    style, state = beam.Style(None, False), beam.State(0, 0)
    for k in range(12):
        state = state.wait(beam.Waiting(k, beam.Figure(3, 3**k, None), False), style)
    assert sum(len(half) for half in state.sums) <= 128
    assert state.ways_to(sum(3**k for k in range(12))) == ((1,) * 12,) and state.ways_to(3**11 - 3**10) == ()
    assert state.wait(beam.Waiting(12, beam.Figure(3, 3**12, None), False), style).sums is None
    same = beam.State(0, 0)
    for k in range(100):
        same = same.wait(beam.Waiting(k, beam.Figure(3, 5, None), False), style)
    assert same.ways_to(-500) == ((-1,) * 100,) and len(same.ways_to(0)) == 2 and same.ways_to(5) == ()


def test_lines_are_made_once(spark):
    """Where lines come from may be work: it is done once for a ledger."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def shown(text):
        made.add(1)
        return text

    text = ["Account Number: 62000001", "Opening Balance: 100.00", "01/03/2026 Shop 10.00 90.00", "02/03/2026 Pay 20.00 110.00", "Closing Balance: 110.00"]
    lines = spark.createDataFrame([("a", k, t) for k, t in enumerate(text)], "statement string, line_no long, text string").withColumn("text", shown("text"))
    ledger, _ = statements.process_statements(lines, [LineFormat()], CATEGORIES, ["statement"], one_reading=True)
    assert [(str(r.debit or ""), str(r.credit or ""), r.status) for r in ledger.orderBy("seq").collect()] == [("10.00", "", "APPROVED"), ("", "20.00", "APPROVED")]
    assert made.value == len(text)


def test_statements_are_aligned_many_at_once():
    """Of a batch each statement is compared with its own second reading alone: equal, differing, read once, found by the second only."""
    sides = {"same": ("ab", "ab"), "differs": ("abc", "axc"), "once": ("ab", ""), "more": ("", "a"), "swapped": ("ab", "ba")}
    rows = [(s, key, k) for s, both in sides.items() for k, keys in enumerate(both) for key in keys]
    table = pa.table({"s": [r[0] for r in rows], "__key": [r[1] for r in rows], "__side": pa.array([r[2] for r in rows], pa.int32())})
    starts = np.cumsum([0, *[len(a) + len(b) for a, b in sides.values()]])[:-1]
    got = assess._align(table, starts)
    assert list(zip(got.column("s").to_pylist(), got.column("side").to_pylist(), strict=True)) == [
        ("same", "both"), ("same", "both"), ("differs", "both"), ("differs", "first"), ("differs", "both"), ("differs", "second"),
        ("once", "first"), ("once", "first"), ("more", "second"), ("swapped", "first"), ("swapped", "both"), ("swapped", "second"),
    ]
