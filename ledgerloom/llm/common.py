"""What several operators share: cutting Arrow text buffers into words, hashing
words and word windows with numpy, and tables in the cluster's shared folder.

Word rules are given as 256-entry byte tables. Both rules used here keep every
non-ASCII character, so a rule on UTF-8 bytes is the same as one on characters.
A text that is null has no words.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SEP = 0x20


def _table(keep_word: str, lower: bool) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    if keep_word == "alnum":
        ok = np.zeros(256, bool)
        ok[48:58] = ok[97:123] = ok[128:] = True
        if lower:
            ok[65:91] = True
        t[~ok] = SEP
    else:
        t[9:14] = SEP
    return t


#: A-Z lower-cased, words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM_LOWER = _table("alnum", True)
#: words [^\x20\x09-\x0D]+, as they are / with A-Z lower-cased
SPACED = _table("space", False)
SPACED_LOWER = _table("space", True)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and each row's offsets; a null row is empty."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def hand_back() -> None:
    """Free memory goes back to the system; else a worker that waits for its next task keeps the most that it ever had."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Bytes of an Arrow batch that goes to a worker: about a block of text.
BATCH_BYTES = 3 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Rows go to workers in batches of BATCH_BYTES or one row, for the rest of the session.

    Spark's own limit is 64 MB a batch, held by the executor, doubled while it grows, and held
    by the worker too, for each task. Which rows there are does not change. A smaller limit stays.
    """
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_KEY)) > BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def blocks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about max_bytes of text, so that memory doesn't follow the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_buffer(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + max_bytes, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    hand_back()


@dataclass
class Words:
    """Words of a block of texts: byte ranges in buf (already translated, padded by 8), and where each row's words begin."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def hashes(self) -> np.ndarray:
        return hash_ranges(self.buf, self.starts, self.ends)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def cut_words(col: pa.Array, table: np.ndarray) -> Words:
    data, offs = text_buffer(col)
    n = len(data)
    buf = np.full(n + 8, SEP, np.uint8)
    np.take(table, data, out=buf[:n])
    word = buf[:n] != SEP
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    at = offs[:-1][offs[:-1] < n]
    first[at] = word[at]
    at = offs[1:][offs[1:] > 0] - 1
    last[at] = word[at]
    starts = np.flatnonzero(first)
    return Words(buf, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs))


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    for shift in (32, 29, 32):
        h ^= h >> np.uint64(shift)
        h *= _B
    h ^= h >> np.uint64(32)
    return h


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; buf has 8 bytes to spare at its end."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lanes = np.ndarray((len(buf) - 7,), "<u8", buffer=buf.data, strides=(1,))
    size = ends - starts
    h = size.astype(np.uint64) * _A
    some, at, left = slice(None), starts, size
    while len(at):
        v = lanes[at] & _MASK[np.minimum(left, 8)]
        x = (h[some] ^ v) * _B
        h[some] = x ^ (x >> np.uint64(31))
        more = left > 8
        some = np.flatnonzero(more) if isinstance(some, slice) else some[more]
        at, left = at[more] + 8, left[more] - 8
    return mixed(h)


def window_hashes(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """The hash of each run of `size` consecutive values; windows ignore row ends."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    n = len(h) - size + 1
    with np.errstate(over="ignore"):
        out = np.full(n, (seed * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for k in range(size):
        out ^= h[k : k + n]
        out *= _B
        out ^= out >> np.uint64(30)
    return mixed(out)


def inside_rows(rows: np.ndarray, size: int) -> np.ndarray:
    """The starts of the windows of `size` words that lie within one row."""
    n = int(rows[-1])
    if n < size:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    lo, hi = np.maximum(rows[1:] - size + 1, rows[:-1]), rows[1:]
    bad = np.zeros(n + 1, np.int32)
    np.add.at(bad, lo, 1)
    np.add.at(bad, hi, -1)
    ok &= np.cumsum(bad[:-1]) == 0
    return np.flatnonzero(ok)


def row_sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of each row's values; 0 for an empty row."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[rows[1:]] - total[rows[:-1]]


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent one is made in the temp folder, for a local session as in
    tests; on a cluster that is an error, as executors share no such folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/ll-{uuid.uuid4().hex}"


def written(df: DataFrame, where: str, name: str) -> DataFrame:
    """df as a table in the shared folder: later reads need neither its lineage nor its executors."""
    path = f"{where}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of shared_dir that nothing will read again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession, where: str, keep: tuple[str, ...]) -> None:
    """Delete the tables of a shared_dir that what is left to run will not read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(where)
    for found in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder):
        if (name := found.getPath().getName()) not in keep:
            remove(spark, f"{where}/{name}")


def parts_for(rows: int, each: int) -> int:
    """How many groups hold `rows` rows at about `each` a group."""
    return max(1, -(-rows // each))


def spread(df: DataFrame, groups: int, *columns: str) -> DataFrame:
    """df dealt by the columns over as many partitions as it has groups, or as the cluster keeps busy a few times over.

    Few bytes may be much work: what is dealt so is not put together again for being small.
    """
    context = df.sparkSession.sparkContext
    return df.repartition(max(1, min(groups, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * context.defaultParallelism))), *columns)
