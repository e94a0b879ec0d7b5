"""A fixed number of bits that says which 64-bit values may be in a column.

It is built by tasks, has the same size whatever the column's, and only spares
later joins rows that cannot match; where it fills up, they get more rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame

from .common import mixed

PART = 1 << 16


def _bit(values: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(values.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _mark(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(part, bits): the task's values as bits, in parts of 64 KiB; those parts alone that have one."""
    out = np.zeros(bits, bool)
    for batch in batches:
        out[_bit(np.asarray(batch.column(0)), bits)] = True
    packed = np.packbits(out).reshape(-1, PART)
    some = np.flatnonzero(packed.any(1))
    yield pa.RecordBatch.from_pydict({"part": some.tolist(), "bits": [packed[i].tobytes() for i in some]}, schema=pa.schema([("part", pa.int64()), ("bits", pa.binary())]))


def _or(parts: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros(PART, np.uint8)
    for x in parts["bits"]:
        out |= np.frombuffer(x, np.uint8)
    return pd.DataFrame({"part": parts["part"].iloc[:1], "bits": [out.tobytes()]})


def bit_table(column: DataFrame, bits: int) -> Broadcast:
    """The bits of a column of longs without nulls, as a broadcast of `bits` bits (a power of two, 2^19 at least)."""
    marks = column.mapInArrow(partial(_mark, bits=bits), "part long, bits binary").groupBy("part").applyInPandas(_or, "part long, bits binary").collect()
    out = np.zeros((bits // 8 // PART, PART), np.uint8)
    for r in marks:
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return column.sparkSession.sparkContext.broadcast(out.ravel())


def may_have(table: Broadcast, values: np.ndarray) -> np.ndarray:
    packed = table.value
    at = _bit(values.astype(np.int64), len(packed) * 8)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def filtered(batches: Iterator[pa.RecordBatch], table: Broadcast, column: str, inside: bool) -> Iterator[pa.RecordBatch]:
    """What `only` keeps of each batch, for functions of batches that go on with it."""
    for batch in batches:
        ids = batch.column(column)
        valid = np.asarray(ids.is_valid())
        have = valid & may_have(table, np.asarray(ids.fill_null(0)))
        yield batch.filter(pa.array(have if inside else ~have))


def only(df: DataFrame, table: Broadcast, column: str, inside: bool) -> DataFrame:
    """The rows whose integer `column` may be in the table, or (not inside) those where it cannot be; a null cannot."""
    return df.mapInArrow(partial(filtered, table=table, column=column, inside=inside), df.schema)
