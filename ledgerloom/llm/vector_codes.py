"""Codes of vectors: each part of a vector by its nearest entry of a codebook, learned by Lloyd rounds with Hamerly's bounds.

All values are integers. A table in the shared folder keeps for each part of each
vector its entry, an upper bound of its distance to that entry and a lower bound of
its distance to every other one. A round moves the bounds by how far the entries moved;
where the upper one is still strictly below, no other entry can be as near and
nothing is computed. Only where that fails are all entries compared, in integers, and a tie
goes to the lower index. Each task adds up its own rows; the driver sees sums of a
fixed size, whatever the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import hand_back, remove, shared_dir, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest integer of a component either way: squared distances of a part of 16 of them stay below 2^63.
LARGEST = 1 << 29
SALTS = 64
ROWS = 4096

_STATE = "vec_id {id}, label {label}, x binary, code binary, upper binary, lower binary, sums array<long>"


def _up(v: np.ndarray) -> np.ndarray:
    """A 4-byte number that is no smaller."""
    return np.nextafter(v.astype(np.float32), np.float32(np.inf))


def _down(v: np.ndarray) -> np.ndarray:
    return np.nextafter(v.astype(np.float32), np.float32(-np.inf))


def _squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Integer distances of each row of x to each entry."""
    out = np.empty((len(x), len(entries)), np.int64)
    for k, e in enumerate(entries):
        d = x - e
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


class Moves:
    """What a round's bounds need of one part's codebook: its entries now, how far each moved, and half the way to the nearest other."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None):
        self.now = now
        between = _squared(now, now).astype(np.float64)
        np.fill_diagonal(between, np.inf)
        self.half = _down(np.sqrt(between.min(1)) / 2)
        step = np.zeros(len(now)) if before is None else np.sqrt(((now - before) ** 2).sum(1).astype(np.float64))
        self.step = _up(step)
        most = int(np.argmax(self.step))
        rest = np.delete(self.step, most).max(initial=np.float32(0))
        self.others = np.where(np.arange(len(now)) == most, rest, self.step[most]).astype(np.float32)

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings one part's entries and bounds of all rows up to date, in place; how many rows were compared with all entries."""
        upper[:] = _up(upper.astype(np.float64) + self.step[code])
        lower[:] = _down(lower.astype(np.float64) - self.others[code])
        bound = np.maximum(lower, self.half[code])
        open_ = np.flatnonzero(~(upper < bound))
        if len(open_):
            d = x[open_] - self.now[code[open_]]
            upper[open_] = _up(np.sqrt(np.einsum("ij,ij->i", d, d).astype(np.float64)))
            open_ = open_[~(upper[open_] < bound[open_])]
        if len(open_):
            d = _squared(x[open_], self.now)
            best = d.argmin(1)
            nearest = d[np.arange(len(d)), best]
            d[np.arange(len(d)), best] = np.iinfo(np.int64).max
            code[open_] = best
            upper[open_] = _up(np.sqrt(nearest.astype(np.float64)))
            lower[open_] = _down(np.sqrt(d.min(1).astype(np.float64))) if d.shape[1] > 1 else np.float32(np.inf)
        return len(open_)


def _bytes(a: np.ndarray) -> pa.Array:
    """A row's bytes as a value of its own."""
    a = np.ascontiguousarray(a)
    size = a.nbytes // len(a)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(0, a.nbytes + 1, size, dtype=np.int32)), pa.py_buffer(a)])


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1).copy()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)
    hand_back()


def _integers(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, x): components times SCALE rounded down, zeros up to `size` of them, four bytes each."""
    for batch in _slices(batches):
        lists = batch.column("v")
        flat = np.asarray(lists.flatten(), np.float64)
        n = np.asarray(lists.value_lengths())
        x = np.zeros((len(n), size), np.int32)
        at = np.repeat(np.arange(len(n)) * size - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(flat))
        x.ravel()[at] = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _bytes(x)], ["vec_id", "label", "x"])


def _round(batches: Iterator[pa.RecordBatch], books: np.ndarray, before: np.ndarray | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """All rows with their entries and bounds under these codebooks, and at last a row with the sums and counts of the task's entries."""
    moves = [Moves(books[p], None if before is None else before[p]) for p in range(PARTS)]
    k, width = books.shape[1:]
    sums, scans = np.zeros((PARTS, k, width + 1), np.int64), 0
    for batch in _slices(batches):
        x = _matrix(batch.column("x"), "<i4").astype(np.int64).reshape(-1, PARTS, width)
        if before is None:
            code, upper, lower = np.zeros((len(x), PARTS), np.uint8), np.full((len(x), PARTS), np.inf, np.float32), np.zeros((len(x), PARTS), np.float32)
        else:
            code, upper, lower = (_matrix(batch.column(c), t) for c, t in (("code", "u1"), ("upper", "<f4"), ("lower", "<f4")))
        for p in range(PARTS):
            c, u, lo = code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
            scans += moves[p].assign(x[:, p], c, u, lo)
            code[:, p], upper[:, p], lower[:, p] = c, u, lo
            np.add.at(sums[p, :, :width], c, x[:, p])
            sums[p, :, width] += np.bincount(c, minlength=k)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("x"), _bytes(code), _bytes(upper), _bytes(lower), pa.nulls(len(x), schema.field("sums").type)], schema=schema)
    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:-1]), pa.array([[*sums.ravel().tolist(), scans]], schema.field("sums").type)], schema=schema)


def _errors(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        x = _matrix(batch.column("x"), "<i4").astype(np.int64).reshape(-1, *books.shape[::2])
        code = _matrix(batch.column("code"), "u1")
        d = x - books[np.arange(PARTS), code]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code]), pa.array((d * d).sum((1, 2)))], ["vec_id", "label", "code", "error"])


def _totals(state: DataFrame) -> np.ndarray:
    """The tasks' sums added up; as many rows as a codebook has numbers."""
    rows = state.where("sums is not null").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows), np.int64)
    for r in rows:
        out[r.k] = r.v
    return out


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES, scans: list[int] | None = None) -> DataFrame:
    """A row (id, code, error, label_error, codebooks_sha256) for each row whose vector is whole and finite.

    Rows whose vector is null, or holds a null, an infinite value or no number, are left out. Components become
    floor(4096 x), at most 2^29 either way. Vectors are cut into 8 equal parts; shorter ones, and
    lengths that 8 does not divide, are filled with zeros to the longest. A
    part's codebook starts as that part of the rows with the 16 smallest ids (a null id
    is last, rows of one id follow in the order of their bytes; with fewer rows there are fewer entries), and in each of 6 rounds
    every entry becomes the floored mean of the parts nearest to it. Ties go to the
    lower index; an entry that nothing is nearest to stays. Rows that repeat count each.
    error is the sum of the final squared distances, label_error its sum over equal labels, nulls being one.
    An empty table gives an empty one; other columns are not used.

    scans: gets, for each round and the last assignment, how many parts were compared with all entries.
    """
    spark = vectors.sparkSession
    where = shared_dir(spark)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & finite)
    kinds = dict(kept.dtypes)
    size = max(PARTS, -(-(kept.agg(F.max(F.size("v"))).first()[0] or 0) // PARTS) * PARTS)
    state = written(kept.mapInArrow(partial(_integers, size=size), f"vec_id {kinds['vec_id']}, label {kinds['label']}, x binary"), where, "integers")
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    if not first:
        return state.select(F.col("vec_id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books, before = np.stack([np.frombuffer(r.x, "<i4").astype(np.int64).reshape(PARTS, -1) for r in first], 1), None
    schema = _STATE.format(id=kinds["vec_id"], label=kinds["label"])
    arrow = pa.schema([*to_arrow_schema(state.select("vec_id", "label").schema), *((n, pa.binary()) for n in ("x", "code", "upper", "lower")), ("sums", pa.list_(pa.int64()))])
    for k in range(rounds + 1):
        state = written(state.mapInArrow(partial(_round, books=books, before=before, schema=arrow), schema), where, f"round-{k}")
        remove(spark, f"{where}/round-{k - 1}" if k else f"{where}/integers")
        total = _totals(state)
        if scans is not None:
            scans.append(int(total[-1]))
        state = state.where("sums is null")
        if k < rounds:
            sums = total[:-1].reshape(*books.shape[:2], -1)
            count = sums[:, :, -1:]
            before, books = books, np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = written(state.mapInArrow(partial(_errors, books=books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), where, "coded")
    remove(spark, f"{where}/round-{rounds}")
    # Few labels may hold most rows: each label's sum stands under SALTS keys, over which its rows are dealt.
    keyed = coded.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    per_label = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), where, "labels")
    per_label = per_label.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("key"))
    met = keyed.join(per_label, (keyed["salt"] == per_label["key"]) & keyed["label"].eqNullSafe(per_label["of"]))
    return met.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

