"""Verification of statements: checks that mark rows with reasons and statements with problems.

Nothing is corrected and nothing dropped. A reason or problem is a short code; the
order of the codes is the order of the checks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from .chain import balance_chain, flag_date_order, flag_duplicates
from .whole import by_statement

APPROVED, REVIEW = "APPROVED", "REVIEW_REQUIRED"
#: Confidence of confirmed rows, of confirmed rows of a scan, and of the others.
CONFIDENCE, CONFIDENCE_SCAN, CONFIDENCE_REVIEW = 1.0, 0.97, 0.8


def _codes(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for test, code in checks]))


def assess(rows: DataFrame, statements: DataFrame, by: list[str], order: list[str], groups_confirmed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with reasons, statements with problems and the reconciliation's figures).

    rows: by, order, date, date_text, description, debit, credit, unassigned,
    balance, evidence, garbled (figures with letters). statements: by, opening,
    period_start, period_end, printed_debits, printed_credits, printed_fees,
    printed_closing, closings (all printed ones), n_skipped, missing_pages,
    account_number; nulls where nothing is printed. The two meet in one join by
    `by`, and everything else is windows and one aggregation on the same key.
    """
    zero = F.lit(0).cast("decimal(18,2)")
    rows = rows.join(statements.select(*by, "opening", "period_start", "period_end"), by, "left")
    rows = balance_chain(rows, by, order, "opening")
    rows = flag_date_order(flag_duplicates(rows, by, order), by, order)
    whole = Window.partitionBy(*by)
    rows = rows.withColumn("__balances", F.count("balance").over(whole))
    place = F.struct(*order)
    sums = rows.groupBy(*by).agg(
        F.coalesce(F.sum("credit"), zero).alias("total_credits"),
        F.coalesce(F.sum("debit"), zero).alias("total_debits"),
        F.max_by("balance", F.when(F.col("balance").isNotNull(), place)).alias("last_balance"),
        F.count("balance").alias("n_balances"),
        F.count_if(F.coalesce("unassigned", zero) != 0).alias("n_unassigned"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    s = statements.join(sums, by, "left")
    s = s.withColumn("computed_closing", (F.col("opening") + F.col("total_credits") - F.col("total_debits")).cast("decimal(18,2)"))
    fees = F.coalesce("printed_fees", zero)
    debits_fit = (F.col("printed_debits") == F.col("total_debits")) | (F.col("printed_debits") + fees == F.col("total_debits"))
    no_totals = F.col("printed_debits").isNull() & F.col("printed_credits").isNull() & F.col("printed_closing").isNull()
    totals_wrong = F.coalesce(~debits_fit, F.lit(False)) | F.coalesce(F.col("printed_credits") != F.col("total_credits"), F.lit(False))
    no_balance = (F.col("n_rows") > 0) & (F.col("n_balances") == 0)
    closings = F.coalesce("closings", F.array().cast("array<decimal(18,2)>"))
    closing_wrong = (F.size(closings) > 0) & F.col("last_balance").isNotNull() & ~F.coalesce(F.array_contains(closings, F.col("last_balance")), F.lit(False))
    problems = _codes(
        (no_balance & (totals_wrong | no_totals), "no_running_balance"),
        (F.col("n_skipped") > 0, "unreadable_lines"),
        (totals_wrong, "totals_differ"),
        ((F.col("n_rows") > 0) & (F.size(closings) == 0) & no_totals, "end_not_proved"),
        (F.size("missing_pages") > 0, "pages_missing"),
        (closing_wrong, "closing_differs"),
        ((F.col("n_unassigned") == 0) & (F.col("computed_closing") != F.col("last_balance")), "does_not_add_up"),
        (F.coalesce("account_number", F.lit("")) == "", "no_account_number"),
    )
    s = s.withColumn("problems", problems).withColumn("unreconciled", totals_wrong | closing_wrong)
    s = s.withColumn("printed_closing_used", F.when(F.array_contains(closings, F.col("last_balance")), F.col("last_balance")).otherwise(F.get(closings, F.lit(0))))
    rows = rows.join(s.select(*by, "unreconciled", F.array_contains("problems", "no_running_balance").alias("__unproved")), by, "left")
    amountless = F.col("debit").isNull() & F.col("credit").isNull() & F.col("unassigned").isNull()
    reasons = _codes(
        (F.col("date").isNull() & (F.coalesce("date_text", F.lit("")) != ""), "date_unreadable"),
        (F.col("date").isNull() & (F.coalesce("date_text", F.lit("")) == ""), "no_date"),
        (amountless, "no_amount"),
        (F.col("unassigned").isNotNull(), "direction_unknown"),
        (F.col("__unproved"), "not_confirmed"),
        ((F.col("__balances") > 0) & F.col("balance").isNull() & F.lit(not groups_confirmed), "no_balance"),
        (F.col("breaks"), "chain_break"),
        (F.size("garbled") > 0, "garbled_figure"),
        (F.col("duplicate"), "possible_duplicate"),
        (F.col("out_of_order"), "out_of_order"),
        (~F.col("date").between(F.col("period_start"), F.col("period_end")), "outside_period"),
        (F.col("unreconciled"), "statement_unreconciled"),
    )
    inner = ["opening", "period_start", "period_end", "expected", "missing", "breaks", "after_date", "duplicate", "out_of_order", "unreconciled", "__balances", "__unproved"]
    return rows.withColumn("reasons", reasons).drop(*inner), s


def _rising(places: list[int]) -> list[int]:
    """Which of the places are a longest rising run; of several the one that ends lowest."""
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, p in enumerate(places):
        n = bisect_left(ends, p)
        before.append(last[n - 1] if n else -1)
        ends[n:] = [p, *ends[n + 1 :]] if n < len(ends) else [p]
        last[n:] = [k, *last[n + 1 :]] if n < len(last) else [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def aligned(first: list[str], second: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal rows that both have in the same order.

    Rows that are there just once on both sides are anchors, of which a longest
    rising run counts; the gaps between are aligned by the same rule, equal rows at their
    beginning first. A gap without anchors has its repeats numbered, which makes them such.
    """
    pairs, gaps = [], [(0, len(first), 0, len(second))]
    while gaps:
        a, a_end, b, b_end = gaps.pop()
        while a < a_end and b < b_end and first[a] == second[b]:
            pairs.append((a, b))
            a, b = a + 1, b + 1
        if a == a_end or b == b_end:
            continue
        mine, theirs = Counter(first[a:a_end]), Counter(second[b:b_end])
        once = {k for k, n in mine.items() if n == 1 == theirs[k]}
        seen_a, seen_b = Counter(), Counter()
        there: dict[tuple[str, int], int] = {}
        for k in range(b, b_end):
            seen_b[second[k]] += 1
            there[second[k], seen_b[second[k]]] = k
        anchors = []
        for k in range(a, a_end):
            seen_a[first[k]] += 1
            key = first[k], seen_a[first[k]]
            if key in there and (first[k] in once or not once):
                anchors.append((k, there[key]))
        run = [anchors[k] for k in _rising([p for _, p in anchors])]
        pairs += run
        edges = [(a - 1, b - 1), *run, (a_end, b_end)]
        if run:
            gaps += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:], strict=False) if x + 1 < y and u + 1 < v]
    return sorted(pairs)


def _align(rows: pa.Table, starts: np.ndarray) -> pa.Table:
    """Both sides' rows of whole statements with side, equal ones once, as the first has them; of a statement the first side's rows come first."""
    keys, first = rows.column("__key").to_pylist(), rows.column("__side").to_numpy() == 0
    side = np.where(first, 0, 2)
    keep = np.ones(len(keys), bool)
    for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
        cut = begin + int(np.count_nonzero(first[begin:end]))
        pairs = aligned(keys[begin:cut], keys[cut:end])
        if pairs:
            a, b = zip(*pairs, strict=True)
            side[np.array(a) + begin] = 1
            keep[np.array(b) + cut] = False
    names = pa.array(["first", "both", "second"]).take(pa.array(side))
    return rows.append_column("side", names).drop_columns(["__key", "__side"]).filter(pa.array(keep))


def align_readings(first: DataFrame, second: DataFrame, by: list[str], order: list[str], figures: list[str]) -> DataFrame:
    """(by, order, figures, side): first's rows with side 'both' or 'first', and those that only second has, 'second'.

    Rows are equal if all figures are, nulls too; a row that the second reading has
    in another place is not the same one (it is on both sides then). order names a row of
    its statement. One shuffle of both sides by statement, of these columns alone; statements are aligned many in a batch.
    """
    # Nulls must meet nulls: every figure is compared as text with a mark for null.
    key = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("\0")) for f in figures]).alias("__key")
    columns = [*by, *order, *figures]
    kinds = dict(first.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", side string"
    a, b = (df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns], key, F.lit(k).alias("__side")) for k, df in enumerate((first, second)))
    return by_statement(a.unionByName(b), by, ["__side", *order], _align, schema)


def compare_readings(first: DataFrame, second: DataFrame, by: list[str], order: list[str], figures: list[str]) -> DataFrame:
    """Adds agreed: the second reading has the row's figures as well, in the same place among the others."""
    sides = align_readings(first, second, by, order, figures).where("side <> 'second'").select(*by, *order, (F.col("side") == "both").alias("agreed"))
    return first.join(sides, [*by, *order])


def confirm_by_second(rows: DataFrame, statements: DataFrame, second: DataFrame | None, by: list[str], order: list[str], figures: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, statements) with what a second, independent reading does not confirm added to reasons and problems.

    A row that the second reading has not with the same figures in the same place: second_reading_differs.
    Of a statement without a second reading no row is confirmed: no_second_reading.
    Rows that only the second reading has: second_reading_has_more.
    """
    if second is None:
        second = rows.where("false")
    sides = stored(align_readings(rows, second, by, order, figures).select(*by, *order, "side"))
    told = sides.groupBy(*by).agg(F.count_if(F.col("side") != "first").alias("__second"), F.count_if(F.col("side") == "second").alias("__more"))
    rows = rows.join(sides.where("side <> 'second'"), [*by, *order]).join(told, by)
    reason = F.when(F.col("__second") == 0, "no_second_reading").when(F.col("side") == "first", "second_reading_differs")
    rows = rows.withColumn("reasons", F.concat("reasons", F.array_compact(F.array(reason)))).drop("side", "__second", "__more")
    s = statements.join(told, by, "left")
    problem = F.when(F.coalesce("__second", F.lit(0)) == 0, "no_second_reading").when(F.col("__more") > 0, "second_reading_has_more")
    return rows, s.withColumn("problems", F.concat("problems", F.array_compact(F.array(problem)))).drop("__second", "__more")


def choose_reading(readings: DataFrame, by: list[str]) -> DataFrame:
    """One reading of each statement: fewest problems, then fewest flagged rows, then most rows, then the first."""
    best = F.struct("n_problems", "n_flagged", (-F.col("n_rows")).alias("r"), "reading")
    return readings.where("n_rows > 0").groupBy(*by).agg(F.min(best).alias("b")).select(*by, F.col("b.reading").alias("reading"), F.col("b.n_problems").alias("n_problems"), F.col("b.n_flagged").alias("n_flagged"), (-F.col("b.r")).alias("n_rows"))


def finalize(rows: DataFrame, statements: DataFrame, by: list[str], scanned: str = "ocr") -> tuple[DataFrame, DataFrame]:
    """status and confidence of each row, and status of each statement."""
    clean = F.size("reasons") == 0
    rows = rows.withColumn("status", F.when(clean, APPROVED).otherwise(REVIEW))
    rows = rows.withColumn("confidence", F.when(~clean, CONFIDENCE_REVIEW).when(F.coalesce(F.col(scanned), F.lit(False)), CONFIDENCE_SCAN).otherwise(CONFIDENCE))
    flagged = rows.groupBy(*by).agg(F.count_if(~clean).alias("n_flagged"))
    s = statements.join(flagged, by, "left").withColumn("n_flagged", F.coalesce("n_flagged", F.lit(0).cast("bigint")))
    ok = (F.size("problems") == 0) & (F.col("n_flagged") == 0)
    return rows, s.withColumn("status", F.when(ok, APPROVED).otherwise(REVIEW)).withColumn("issues", F.array_join("problems", "; "))


def printed_total(found: Column, read: Column) -> Column:
    """Of the totals printed in a statement of several months: the one, or the grand one if it is what was read, else their sum."""
    most = F.array_max(found)
    sum_ = F.aggregate(found, F.lit(0).cast("decimal(28,2)"), lambda s, x: (s + x).cast("decimal(28,2)"))
    return F.when(F.size(found) <= 1, F.get(found, F.lit(0))).when(most == read, most).otherwise(sum_).cast("decimal(18,2)")
