"""Python over whole statements, many of them in a batch: a group of its own for each would cost more than the work in it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows that are handed back at once.
BATCH = 10_000


def _changes(keys: pa.Table) -> np.ndarray:
    """Whether each row but the first has another key than the row before; null is a key of its own."""

    def one(column: pa.ChunkedArray) -> np.ndarray:
        a, b = column.slice(0, len(column) - 1), column.slice(1)
        other = pc.fill_null(pc.not_equal(a, b), False)
        return pc.or_(other, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy()

    return reduce(np.logical_or, [one(c) for c in keys.columns])


def whole_statements(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, places where a statement starts) of batches sorted by statement: a batch's last statement waits for the rest of it."""
    open_: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        if open_:
            before = open_[-1].slice(open_[-1].num_rows - 1).select(by)
            starts = np.flatnonzero(_changes(pa.concat_tables([before, new.select(by)])))
        else:
            starts = np.concatenate([[0], np.flatnonzero(_changes(new.select(by))) + 1])
        if not len(starts):
            open_.append(new)
            continue
        held = sum(t.num_rows for t in open_)
        if held + starts[-1]:
            begins = np.concatenate([[0] if held else [], starts[:-1] + held]).astype(np.int64)
            yield pa.concat_tables([*open_, new.slice(0, starts[-1])]).combine_chunks(), begins
        open_ = [new.slice(starts[-1])]
    if open_:
        yield pa.concat_tables(open_).combine_chunks(), np.zeros(1, np.int64)


def by_statement(rows: DataFrame, by: list[str], order: list[str], read: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """read's rows; it gets tables of whole statements in order, and the places where each starts.

    One shuffle by statement, none where the rows lie so already. A task holds a
    batch and the statement that goes on over it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_statements(batches, by):
            yield from read(table, starts).combine_chunks().to_batches(BATCH)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
