"""Language identification by interpolated Kneser-Ney character models.

Letters are lower-cased; every run of other characters is one blank. Spark counts
the n-grams of each language over all training texts (tasks combine their own
counts first); lower orders are continuation counts of the higher one, and each order
is joined with its contexts and with the order below, whose probabilities it is
interpolated with. All languages share the sorted arrays of hashed n-grams of an order,
cut into shards of equal hash ranges, with a row of log probabilities for each language
beside them, so that a position takes one binary search whatever the number of
languages. Shards are files of the shared folder, written by tasks and memory-mapped by
workers; the driver holds the languages, their discounts and the sizes of the shards.
The predicted language has the lowest cross-entropy a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, clear, mixed, parts_for, remove, shared_dir, text_buffer, written
from .files import mapped, write_array

ORDER = 4
#: Bytes of the keys and log probabilities of a shard.
SHARD_BYTES = 32 << 20
#: Bytes of text that a task looks at at once.
TEXT_BYTES = 1 << 20
UNKNOWN = "und"
_BLANK, _OTHER = 32, 0xFFFF


@lru_cache
def _lower() -> np.ndarray:
    """For each character below 0x10000: its lower-case letter, or a blank if it is none."""
    out = np.full(1 << 16, _BLANK, np.uint16)
    for c in range(1 << 16):
        if (x := chr(c)).isalpha():
            out[c] = ord(y) if len(y := x.lower()) == 1 and ord(y) < 1 << 16 else c
    return out


def symbols(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each row ORDER - 1 blanks, then its letters and blanks; and the rows' offsets."""
    data, offs = text_buffer(col)
    head = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    rows = head[offs]
    low = _lower()[np.minimum(chars, _OTHER)]
    for at in np.flatnonzero(chars > _OTHER).tolist():
        low[at] = _OTHER if chr(int(chars[at])).isalpha() else _BLANK
    letter = low != _BLANK
    before = np.concatenate([[False], letter[:-1]])
    before[rows[:-1][rows[:-1] < len(low)]] = False
    keep = letter | before
    kept_rows = np.concatenate([[0], np.cumsum(keep)])[rows]
    pad = ORDER - 1
    n = len(rows) - 1
    out = np.full(int(kept_rows[-1]) + pad * n, _BLANK, np.uint64)
    row_of = np.repeat(np.arange(n), np.diff(kept_rows))
    out[np.arange(kept_rows[-1]) + pad * (row_of + 1)] = low[keep]
    return out, kept_rows + pad * np.arange(n + 1)


def ngrams(s: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each character of each row, and the rows' offsets among these."""
    pad = ORDER - 1
    if len(s) <= pad:
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    code = s[pad:].copy()
    for k in range(1, ORDER):
        code |= s[pad - k : len(s) - k] << np.uint64(16 * k)
    own = np.ones(len(s), bool)
    for k in range(pad):
        own[rows[:-1] + k] = False
    return code[own[pad:]], rows - pad * np.arange(len(rows))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of the task's texts."""
    kept: dict[str, list] = {}
    size = 0

    def out():
        for lang, parts in kept.items():
            gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for block in blocks(batches, "__text", TEXT_BYTES):
        code, rows = ngrams(*symbols(block.column("__text")))
        langs = np.array(block.column("__lang").to_pylist(), object)
        of = np.repeat(langs, np.diff(rows))
        for lang in dict.fromkeys(langs):
            gram, n = np.unique(code[of == lang], return_counts=True)
            kept.setdefault(lang, []).append((gram, n))
            size += len(gram)
        if size > 4_000_000:
            yield from out()
            kept, size = {}, 0
    if kept:
        yield from out()


def _of_range(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards of equal ranges of 64-bit hashes."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


@dataclass
class Sharded:
    """Where the sorted hashes of n-grams (or contexts) are, and their rows of one float a language."""

    path: str
    sizes: list[int]
    width: int

    def __len__(self) -> int:
        return sum(self.sizes)

    def _shard(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(mapped(f"{self.path}-keys-{s}.bin", "<u8")), np.asarray(mapped(f"{self.path}-rows-{s}.bin", "<f4")).reshape(-1, self.width)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each hash's row (zeros where it has none), and whether it has one."""
        rows, known = np.zeros((len(h), self.width), np.float32), np.zeros(len(h), bool)
        shard = _of_range(h, len(self.sizes)) if len(self.sizes) > 1 else np.zeros(len(h), np.int64)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(len(self.sizes) + 1))
        for s, n in enumerate(self.sizes):
            some = order[ends[s] : ends[s + 1]]
            if not n or not len(some):
                continue
            keys, values = self._shard(s)
            at = np.minimum(np.searchsorted(keys, h[some]), n - 1)
            known[some] = hit = keys[at] == h[some]
            rows[some] = np.where(hit[:, None], values[at], 0)
        return rows, known


@dataclass
class Model:
    """Log probabilities of the n-grams of orders 1 to `order` in all languages, and the log weights of their contexts; small, whatever the corpus."""

    langs: list[str]
    order: int
    floor: float
    tables: list[tuple[Sharded, Sharded]]

    def log_probs(self, code: np.ndarray, k: int | None = None) -> np.ndarray:
        """A row of natural logs for each packed n-gram."""
        k = self.order if k is None else k
        if k == 0:
            return np.full((len(code), len(self.langs)), self.floor, np.float32)
        grams, contexts = self.tables[k - 1]
        code = code & np.uint64((1 << 16 * k) - 1)
        out, known = grams.find(mixed(code))
        miss = np.flatnonzero(~known)
        if len(miss):
            out[miss] = contexts.find(mixed(code[miss] >> np.uint64(16)))[0] + self.log_probs(code[miss], k - 1)
        return out

    def entropies(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cross-entropy a character in every language (nats), and its number of letters and blanks."""
        code, rows = ngrams(*symbols(col))
        n = np.diff(rows)
        sums = np.zeros((len(n), len(self.langs)))
        if len(code):
            full = np.flatnonzero(n)
            kinds, at = np.unique(code, return_inverse=True)
            sums[full] = -np.add.reduceat(self.log_probs(kinds)[at], rows[:-1][full], axis=0, dtype=np.float64)
        return sums / np.maximum(n, 1)[:, None], n


def _dense(col: pa.Array, width: int) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=float).reshape(-1, width)


def _doubles(col: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(text_buffer(col)[0].tobytes(), "<f8").reshape(-1, width)


def _bytes(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _gamma(total: np.ndarray, kinds: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The weight of the order below; all of it where a language has not seen the context."""
    return np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)


def _interpolated(batches: Iterator[pa.RecordBatch], d: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(gram, p): of n-grams with their counts, their contexts' and the order below, one probability a language."""
    for b in batches:
        n, total, kinds = (_dense(b.column(c), len(d)) for c in ("n", "total", "kinds"))
        p = np.maximum(n - d, 0) / np.maximum(total, 1) + _gamma(total, kinds, d) * _doubles(b.column("lower"), len(d))
        yield pa.RecordBatch.from_arrays([b.column("gram"), _bytes(p)], names=["gram", "p"])


def _weights(batches: Iterator[pa.RecordBatch], d: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(gram, p): of contexts, the weight that each language gives to the order below."""
    for b in batches:
        total, kinds = (_dense(b.column(c), len(d)) for c in ("total", "kinds"))
        yield pa.RecordBatch.from_arrays([b.column("context"), _bytes(_gamma(total, kinds, d))], names=["gram", "p"])


def _dealt(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = mixed(np.asarray(b.column("gram")).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(_of_range(h, shards)), pa.array(h.view(np.int64)), b.column("p")], names=["shard", "hash", "p"])


def _write_shard(rows: pa.Table, path: str, width: int) -> pa.Table:
    shard = rows["shard"][0].as_py()
    h = np.asarray(rows["hash"]).view(np.uint64)
    order = np.argsort(h)
    p = np.concatenate([_doubles(c, width) for c in rows["p"].chunks])
    write_array(f"{path}-keys-{shard}.bin", h[order])
    write_array(f"{path}-rows-{shard}.bin", np.log(p[order]).astype("<f4"))
    return pa.table({"shard": [shard], "n": [len(h)]})


def _sharded(rows: DataFrame, path: str, width: int, shards: int) -> Sharded:
    """The arrays of rows (gram, p), written by tasks, a shard each."""
    dealt = rows.mapInArrow(partial(_dealt, shards=shards), "shard long, hash long, p binary").repartition(shards, "shard")
    sizes = dict(dealt.groupBy("shard").applyInArrow(lambda t: _write_shard(t, path, width), "shard long, n long").collect())
    return Sharded(path, [sizes.get(s, 0) for s in range(shards)], width)


def _score(batches: Iterator[pa.RecordBatch], model, limits: dict | None) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    names = np.array([*m.langs, UNKNOWN], object)
    most = max((limits or {}).values(), default=np.inf)
    worst = np.array([(limits or {}).get(x, most) for x in m.langs])
    for block in blocks(batches, "__text", TEXT_BYTES):
        h, n = m.entropies(block.column("__text"))
        best = np.argmin(h, 1)
        low = h[np.arange(len(h)), best]
        # The posterior of the best language, were the text as long as 20 characters (or less, if it is).
        score = 1 / np.exp((low[:, None] - h) * np.minimum(n, 20)[:, None]).sum(1)
        none = n == 0
        yield pa.RecordBatch.from_arrays(
            [block.column("__id"), pa.array(names[np.where(none, len(m.langs), best)], pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(np.where(none, 0.0, low)), pa.array(none | (low > worst[best]))],
            names=["__id", "lang_pred", "score", "entropy", "rejected"],
        )


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; null for a null id, which is then not learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> Model | None:
    """The model of all rows with a text and a language, of the same order whatever their number; None where no such row has a letter.

    Counts, contexts and probabilities are tables in the shared folder, removed once the
    arrays are written. A context or a suffix is followed or preceded by one alphabet at most, so
    that no key of the joins is hot. Languages are labels, and as many as a row of floats can hold.
    """
    spark = docs.sparkSession
    where = shared_dir(spark)
    rows = docs.select(F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang")).where("__text is not null and __lang is not null")
    found = written(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), where, "found")
    langs = sorted(r.lang for r in found.select("lang").distinct().collect())
    if not langs:
        remove(spark, where)
        return None
    width = len(langs)
    each = lambda value: F.array(*[value(i) for i in range(width)])
    of = lambda i: F.get("n", F.lit(i))
    levels = {ORDER: written(found.groupBy("gram").agg(each(lambda i: F.sum(F.when(F.col("lang") == langs[i], F.col("n")).otherwise(0))).alias("n")), where, f"counts-{ORDER}")}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("gram")
        levels[k] = written(levels[k + 1].groupBy(suffix).agg(each(lambda i: F.count_if(of(i) > 0)).alias("n")), where, f"counts-{k}")
    flat = 1 / (levels[1].count() + 1)
    tables, below = [], None
    for k in range(1, ORDER + 1):
        few = levels[k].agg(*[each(lambda i, x=x: F.count_if(of(i) == x)) for x in (1, 2)], F.count(F.lit(1))).first()
        once, twice = np.array(few[:2], float)
        d = np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.05, 0.95)
        context = F.shiftrightunsigned("gram", 16).alias("context") if k > 1 else F.lit(0).cast("long").alias("context")
        around = levels[k].groupBy(context).agg(each(lambda i: F.sum(of(i))).alias("total"), each(lambda i: F.count_if(of(i) > 0)).alias("kinds"))
        seen = levels[k].select("gram", "n", context)
        if below is None:
            seen = seen.withColumn("lower", F.lit(np.full(width, flat, "<f8").tobytes()))
        else:
            lower = below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            seen = seen.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1))).join(lower, "suffix")
        joined = seen.join(around, "context").select("gram", "n", "total", "kinds", "lower")
        below = written(joined.mapInArrow(partial(_interpolated, d=d), "gram long, p binary"), where, f"p-{k}")
        weights = around.mapInArrow(partial(_weights, d=d), "gram long, p binary")
        shards = parts_for(few[2] * (8 + 4 * width), shard_bytes)  # contexts are fewer than n-grams
        tables.append(tuple(_sharded(x, f"{where}/arrays/{name}-{k}", width, shards) for x, name in ((below, "grams"), (weights, "contexts"))))
    clear(spark, where, ("arrays",))
    return Model(langs, ORDER, float(np.log(flat)), tables)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", calibration: DataFrame | None = None) -> DataFrame:
    """For each row of docs: id, lang_pred, score (0 to 1), entropy (nats a character), rejected.

    A null text and one without letters is `und`, with score 0, and rejected; so
    is every text where nothing was learned. Equal entropies go to the language
    first in the alphabet. rejected: the entropy lies over the 99.9 % point of the
    calibration rows predicted as that language by three standard deviations, as
    texts not learned from have more (never, without calibration rows). A language
    that no calibration row is predicted as has the highest such limit. Calibration
    rows should not be those learned from. Repeated rows each get their own result;
    texts of any length are whole, an empty table gives an empty result, and other
    columns are not used.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = dict(base.dtypes)["__id"]
    schema = f"__id {kind}, lang_pred string, score double, entropy double, rejected boolean"
    if model is None:
        return base.select(F.col("__id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"), F.lit(True).alias("rejected"))
    shared = spark.sparkContext.broadcast(model)
    limits = {}
    if calibration is not None:
        rows = calibration.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
        got = rows.mapInArrow(partial(_score, model=shared, limits=None), schema).where(F.col("lang_pred") != UNKNOWN)
        most = F.percentile_approx("entropy", 0.999, 10_000) + 3 * F.coalesce(F.stddev_pop("entropy"), F.lit(0.0))
        limits = {r[0]: r[1] for r in got.groupBy("lang_pred").agg(most).collect()}
    return base.mapInArrow(partial(_score, model=shared, limits=limits), schema).withColumnRenamed("__id", id_col)


def calibration_rows(docs: DataFrame, id_col: str = "doc_id", rows: int | None = None) -> DataFrame:
    """All rows of docs; or about `rows` of them, chosen by a hash of the id."""
    if rows is None:
        return docs
    share = min(1.0, rows / max(1, docs.count()))
    return docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(4)), F.lit(1_000_000)) < int(share * 1_000_000))
