"""The order-bound part of reading unknown layouts: which of a line's figures is what, decided along the running balance.

Lines come with the readings of their figures already found. A state is a balance,
the amounts that wait for the next printed one, and what it cost to get there; a line
leads from each state to those that its readings allow, of which the six cheapest are
kept. Nothing is guessed: what two equally cheap ways read differently is marked.
Values are cents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: States kept after a line, sums of waiting amounts that are told apart, and how many of them a half keeps.
WIDTH, MOST_SUMS, HALF = 6, 4096, 64
#: What amounts can move, with the ways that do it, two of them at most.
Sums = dict[int, tuple[tuple[int, ...], ...]]
NOTHING: Sums = {0: ((),)}


class Figure(NamedTuple):
    first: int
    value: int
    sign: int | None


class Reading(NamedTuple):
    """behind: whether a column stands behind the balance."""

    amount: Figure
    fee: int
    balances: tuple[int, ...]
    behind: int
    cost: int


class Row(NamedTuple):
    """What a line becomes; way is None where nothing tells it."""

    line: int
    amount: Figure
    fee: int
    balance: int | None
    way: int | None
    confirmed: bool
    ambiguous: bool = False


@dataclass(frozen=True)
class Style:
    """What an amount without a mark does in this statement (-1, 1, or None: not known), and whether balances without one may be below zero."""

    unmarked: int | None
    flips: bool

    def ways(self, f: Figure) -> tuple[int, ...]:
        told = f.sign or self.unmarked
        return (told,) if told else (-1, 1)

    def way(self, f: Figure) -> int | None:
        return f.sign or self.unmarked

    def balances(self, f: Figure) -> tuple[int, ...]:
        return (f.value * f.sign,) if f.sign else (f.value, -f.value) if self.flips and f.value else (f.value,)


class Waiting(NamedTuple):
    """printed is a balance that the row prints, but that doesn't follow."""

    line: int
    amount: Figure
    listed: bool
    printed: int | None = None


def _with_amount(sums: Sums, value: int, options: tuple[int, ...]) -> Sums:
    out: Sums = {}
    for total, ways in sums.items():
        for way in options:
            at = total + way * value
            more = tuple((*x, way) for x in ways)
            out[at] = (*out[at], *more)[:2] if at in out else more
    return out


class State(NamedTuple):
    """rows: a chain of (rows before, Row). behind: of the row before, if there is one. sums: what the waiting amounts can move, those that came first and the others apart; None if it is too much to tell apart."""

    balance: int | None
    start: int | None = None
    cost: int = 0
    waiting: tuple[Waiting, ...] = ()
    sums: tuple[Sums, Sums] | None = (NOTHING, NOTHING)
    rows: tuple | None = None
    behind: int | None = None

    def wait(self, w: Waiting, style: Style, cost: int = 0) -> State:
        options = (*style.ways(w.amount), *((0,) if w.listed else ()))
        sums = self.sums
        if sums:
            left, right = sums
            if right is NOTHING and len(left) * len(options) <= HALF:
                sums = _with_amount(left, w.amount.value, options), right
            else:
                sums = left, _with_amount(right, w.amount.value, options)
                if len(left) * len(sums[1]) > MOST_SUMS:
                    sums = self._whole(*sums)
        # With too many sums nothing fits any more, and what waits is kept as printed.
        return self._replace(waiting=(*self.waiting, w), sums=sums, cost=self.cost + cost)

    @staticmethod
    def _whole(left: Sums, right: Sums) -> tuple[Sums, Sums] | None:
        """Both halves as one, if its sums can be told apart."""
        if len({a + b for a in left for b in right}) > MOST_SUMS:
            return None
        out: Sums = {}
        for a, before in left.items():
            for b, after in right.items():
                out[a + b] = (*out.get(a + b, ()), *((*x, *y) for x in before for y in after))[:2]
        return out, NOTHING

    def ways_to(self, need: int) -> tuple[tuple[int, ...], ...]:
        """The ways in which the waiting amounts move so much, two of them at most."""
        if not self.sums:
            return ()
        left, right = self.sums
        if right is NOTHING:
            return left.get(need, ())
        out: tuple[tuple[int, ...], ...] = ()
        for b, after in right.items():
            if before := left.get(need - b):
                out = (*out, *((*x, *y) for x in before for y in after))[:2]
        return out

    def with_rows(self, rows: list[Row], balance: int | None, cost: int, behind: int | None = None) -> State:
        """Columns seldom change from row to row: another column behind than before costs one."""
        chain = self.rows
        for r in rows:
            chain = (chain, r)
        return State(balance, self.start, self.cost + cost + (None not in (behind, self.behind) and behind != self.behind), rows=chain, behind=behind)

    def settled(self, ways: tuple[tuple[int, ...], ...]) -> list[Row]:
        """The waiting amounts, each going the one way that leads to the balance; if there are more, none is taken."""
        if len(ways) > 1:
            return [Row(w.line, w.amount, 0, w.printed, w.amount.sign, False, True) for w in self.waiting]
        return [Row(w.line, w.amount, 0, w.printed, way, w.printed is None) for w, way in zip(self.waiting, ways[0], strict=True) if way]

    def unsettled(self, style: Style) -> list[Row]:
        """Waiting amounts that no balance confirms, as printed; those of a list are no transactions."""
        return [Row(w.line, w.amount, 0, w.printed, style.way(w.amount), False) for w in self.waiting if not w.listed]


def readings(options: list[list[tuple[Figure, int]]], style: Style) -> list[Reading]:
    """What a line's figures can be: amount and balance, perhaps with a fee between, perhaps with a column behind; the cheapest first.

    A column of zero before the amount is an empty one; any other figure there, and
    digits that a reading leaves out, cost one each.
    """
    if len(options) == 2 and len(options[0]) == 1 == len(options[1]):
        ((amount, c),), ((balance, d),) = options
        return [Reading(amount, 0, style.balances(balance), 0, c + d)]
    found: dict[tuple, Reading] = {}
    for some in product(*options):
        figures, left = [f for f, _ in some], sum(c for _, c in some)
        for behind in (0, 1):
            seq = figures[: len(figures) - behind]
            for size in (2, 3):
                if len(seq) < size or len(figures) - behind - size < 0:
                    continue
                amount, fee = seq[-size], seq[-2].value * (-1 if seq[-2].sign == 1 else 1) if size == 3 else 0
                cost = left + sum(f.value != 0 for f in seq[:-size])
                if size == 3 and not amount.value and seq[-2].value:
                    continue  # an empty column, then the amount: that of two figures
                for f in reversed(seq[:-size]):  # empty columns before it are no words of the description
                    if f.value:
                        break
                    amount = amount._replace(first=f.first)
                key = (amount.value, amount.sign, fee, seq[-1].value, seq[-1].sign)
                if key not in found or cost < found[key].cost:
                    found[key] = Reading(amount, fee, style.balances(seq[-1]), behind, cost)
    return sorted(found.values(), key=lambda r: r.cost)


def _fitting(state: State, line: int, all_: list[Reading], style: Style) -> Iterator[State]:
    """The states in which the balance before, the waiting amounts and this row lead to the printed balance."""
    for r in all_:
        for balance in r.balances:
            for way in style.ways(r.amount) if r.amount.value else (1,):
                need = balance - state.balance - way * r.amount.value + r.fee
                if ways := state.ways_to(need):
                    row = Row(line, r.amount, r.fee, balance, way, True)
                    yield state.with_rows([*state.settled(ways), row], balance, r.cost + 5 * (len(ways) > 1), r.behind)


def _not_fitting(state: State, line: int, all_: list[Reading], style: Style, listed: bool) -> Iterator[State]:
    """The row as printed, its balance being the next one's start; or, its balance being the odd one, its amount waiting for the next."""
    kept = state.unsettled(style)
    for r in all_:
        if r.cost > all_[0].cost:
            break
        for balance in r.balances if state.balance is None else r.balances[:1]:
            row = Row(line, r.amount, r.fee, balance, style.way(r.amount), False)
            yield state.with_rows([*kept, row], balance, 10 * (1 + len(kept)) + r.cost, r.behind)
        if state.balance is not None:
            yield state._replace(behind=r.behind).wait(Waiting(line, r.amount, listed, r.balances[0]), style, 11 + (state.behind not in (None, r.behind)))


def _pruned(states: list[State]) -> list[State]:
    best: dict[tuple, State] = {}
    for s in states:
        key = (s.balance, s.waiting)
        if key not in best or s.cost < best[key].cost:
            best[key] = s
    return sorted(best.values(), key=lambda s: s.cost)[:WIDTH]


def _rows(state: State) -> dict[int, Row]:
    out, at = {}, state.rows
    while at:
        at, row = at
        out[row.line] = row
    return out


class Step(NamedTuple):
    """A line that leads from this balance, with nothing waiting, to its row's in one way only and at no cost."""

    before: int
    row: Row


def read_along(lines: Sequence[tuple[int, bool, bool, list[list[tuple[Figure, int]]]]], style: Style, openings: list[int], closings: list[int], steps: Sequence[Step | None] = ()) -> tuple[list[Row], int | None]:
    """The rows of one statement, and the opening balance from which they were read; lines: (number, dated, listed, readings of each figure with their cost), in order.

    steps: for each line its step, if it is known; a lone state takes it without looking at the line's readings.
    """
    states = [State(v, v) for v in dict.fromkeys(openings)] or [State(None)]
    for k in range(len(lines)):
        step = steps[k] if steps and len(states) == 1 else None
        if step and not states[0].waiting and states[0].balance == step.before:
            states = [states[0].with_rows([step.row], step.row.balance, 0, 0)]
            continue
        line, dated, listed, options = lines[k]
        nxt: list[State] = []
        if len(options) == 1:
            if dated:
                nxt = [s.wait(Waiting(line, f, listed), style, c) for s in states for f, c in options[0]]
        else:
            all_ = readings(options, style)
            for s in states:
                fit = list(_fitting(s, line, all_, style)) if s.balance is not None else []
                nxt += fit or (_not_fitting(s, line, all_, style, listed) if dated else [s])
        states = (nxt if len(nxt) == 1 else _pruned(nxt)) if nxt else states
    ends = []
    for s in states:
        kept = s.unsettled(style)
        ends.append(s.with_rows(kept, s.balance, 10 * len(kept) + (10 if closings and s.balance not in closings else 0)))
    ends.sort(key=lambda s: s.cost)
    out = _rows(ends[0])
    for rival in ends[1:]:
        if rival.cost == ends[0].cost:
            other = _rows(rival)
            out = {k: r._replace(ambiguous=True, confirmed=False, way=r.amount.sign) if k not in other or (other[k].way, other[k].amount.value) != (r.way, r.amount.value) else r for k, r in out.items()}
    return [out[k] for k in sorted(out)], ends[0].start


#: What read_statements adds to a line that is a row, and the fields of the figures that it is given, in cents.
ADDED = (("amount", pa.int64()), ("first_word", pa.int32()), ("fee", pa.int64()), ("balance", pa.int64()), ("way", pa.int32()), ("confirmed", pa.bool_()), ("ambiguous", pa.bool_()), ("start", pa.int64()))
FIELDS = ("first", "value", "sign", "joined_first", "joined_value", "joined_sign")


class _Lines:
    """The lines of a batch from one place on, made for read_along when they are asked for."""

    def __init__(self, table: pa.Table, offsets: np.ndarray, fields: dict[str, np.ndarray], joined: np.ndarray):
        self.dated, self.listed = table.column("dated").to_pylist(), table.column("listed").to_pylist()
        self.offsets, self.joined = offsets.tolist(), joined.tolist()
        self.fields = [fields[c].tolist() for c in FIELDS]
        self.begin = self.end = 0

    def of(self, begin: int, end: int) -> _Lines:
        self.begin, self.end = begin, end
        return self

    def __len__(self) -> int:
        return self.end - self.begin

    def __getitem__(self, k: int) -> tuple[int, bool, bool, list[list[tuple[Figure, int]]]]:
        line = self.begin + k
        return line, self.dated[line], self.listed[line], [self._options(t) for t in range(self.offsets[line], self.offsets[line + 1])]

    def _options(self, t: int) -> list[tuple[Figure, int]]:
        """A figure's readings; to leave digits right before it unread costs one."""
        first, value, sign, joined_first, joined_value, joined_sign = (f[t] for f in self.fields)
        plain = Figure(first, value, sign or None)
        return [(Figure(joined_first, joined_value, joined_sign or None), 0), (plain, 1)] if self.joined[t] else [(plain, 0)]


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def read_statements(lines: pa.Table, starts: np.ndarray, keep: list[str]) -> pa.Table:
    """Of whole statements' lines, in order, those that are rows, with the columns `keep` and ADDED; starts: where each statement does.

    lines: dated, listed, tokens (FIELDS, with a sign of 0 or null where nothing says it, and
    joined values where there are some), and unmarked, flips, openings and closings, which are the
    same in all lines of a statement. A line of two plain figures that leads from the balance printed
    before to its own is told by arithmetic over all of them; a statement of such lines alone has one way to be read.
    """
    n = lines.num_rows
    ends = np.append(starts[1:], n)
    tokens = _column(lines, "tokens")
    offsets, flat = tokens.offsets.to_numpy(), tokens.values
    fields = {c: flat.field(c).fill_null(0).to_numpy(zero_copy_only=False) for c in FIELDS}
    joined = flat.field("joined_value").is_valid().to_numpy(zero_copy_only=False)
    flag = lambda c: lines.column(c).to_numpy()
    heads = lines.select(["unmarked", "flips", "openings", "closings"]).take(pa.array(starts))
    openings = [list(dict.fromkeys(v or [])) for v in heads.column("openings").to_pylist()]
    of = np.repeat(np.arange(len(starts)), ends - starts)
    unmarked, flips = heads.column("unmarked").fill_null(0).to_numpy()[of], heads.column("flips").to_numpy()[of]
    two = np.diff(offsets) == 2
    one, other = np.where(two, offsets[:-1], offsets[0]), np.where(two, offsets[:-1] + 1, offsets[0])
    amount, sign, shown, side = fields["value"][one], fields["sign"][one], fields["value"][other], fields["sign"][other]
    balance = np.where(side < 0, -shown, shown)
    before = np.append(0, balance[:-1])
    before[starts] = [v[0] if v else 0 for v in openings]
    way = np.where(balance - before == amount, 1, np.where(balance - before == -amount, -1, 0))
    told = np.where(sign != 0, sign, unmarked)
    plain = two & flag("dated") & ~joined[one] & ~joined[other] & (amount != 0) & ((side != 0) | ~flips | (shown == 0)) & (way != 0) & ((told == 0) | (told == way))
    plain[starts] &= [len(v) == 1 for v in openings]
    easy = np.logical_and.reduceat(plain, starts)
    first, fee, confirmed, ambiguous = fields["first"][one].copy(), np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, bool)
    is_row, no_balance, no_way = easy[of], np.zeros(n, bool), np.zeros(n, bool)
    start, no_start = before[starts][of], np.zeros(n, bool)
    amount = amount.copy()
    if not easy.all():
        given, marks = _Lines(lines, offsets, fields, joined), heads.select(["unmarked", "flips", "closings"]).to_pylist()
        columns = [c.tolist() for c in (plain, before, amount, first, sign, balance, way)]

        def step(k: int) -> Step | None:
            ok, b, a, f, marked, after, w = (c[k] for c in columns)
            return Step(b, Row(k, Figure(f, a, marked or None), 0, after, w, True)) if ok else None

        for s in np.flatnonzero(~easy).tolist():
            begin, end, mark = int(starts[s]), int(ends[s]), marks[s]
            style = Style(mark["unmarked"], mark["flips"])
            rows, opening = read_along(given.of(begin, end), style, openings[s], mark["closings"] or [], [step(k) for k in range(begin, end)])
            no_start[begin:end], start[begin:end] = opening is None, opening or 0
            if not rows:
                continue
            at = [r.line for r in rows]
            is_row[at] = True
            for into, values in ((amount, [r.amount.value for r in rows]), (first, [r.amount.first for r in rows]), (fee, [r.fee for r in rows]), (balance, [r.balance or 0 for r in rows]), (no_balance, [r.balance is None for r in rows]),
                                 (way, [r.way or 0 for r in rows]), (no_way, [r.way is None for r in rows]), (confirmed, [r.confirmed for r in rows]), (ambiguous, [r.ambiguous for r in rows])):
                into[at] = values
    kept = lines.select(keep)
    values = [(amount, None), (first, None), (fee, None), (balance, no_balance), (way, no_way), (confirmed, None), (ambiguous, None), (start, no_start)]
    for (name, kind), (column, none) in zip(ADDED, values, strict=True):
        kept = kept.append_column(name, pa.array(column, kind, mask=none))
    return kept if is_row.all() else kept.filter(pa.array(is_row))
