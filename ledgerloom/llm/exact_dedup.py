"""Exact duplicates by recipes: a text is the ordered list of its content-defined chunks' identifiers.

Texts are cut where a rolling hash of the last 32 bytes says so, hence equal
texts in the same places. A chunk's identifier is a keyed digest of its bytes, and
is verified: wherever two documents have the same recipe, the bytes behind each of its
identifiers are compared over the whole table, and if two different chunks share one,
all recipes are made anew under another key. After that, equal recipes are equal
texts. Texts themselves don't move: of a recipe that only one document has nothing
is compared, and of the others each task sends each chunk once, however many copies
it holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import bit_table, may_have
from .common import blocks, remove, shared_dir, text_buffer, written

#: Bytes of a chunk: at least, at most, and about 1024 of them more than the least one.
LEAST, MOST, CUT_BITS = 512, 8192, 10
#: Bytes of an identifier.
DIGEST = 16
REPEATED_BITS = 1 << 23

_GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash of the 32 bytes that end at each place: the sum of g[data[i - k]] << k."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cuts(data: np.ndarray, offs: np.ndarray) -> list[list[int]]:
    """The ends of each text's chunks; data is all texts end to end. An empty text has none."""
    may = np.flatnonzero(rolling(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
    out = []
    for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        ends = []
        while lo < hi:
            # LEAST is over 32, so that no window that counts reaches into the text before.
            k = int(np.searchsorted(may, lo + LEAST))
            lo = min(hi, lo + MOST, int(may[k]) if k < len(may) else hi)
            ends.append(lo)
        out.append(ends)
    return out


def _chunks(batch: pa.RecordBatch, key: bytes, size: int) -> Iterator[tuple[bytes, list[bytes], bytes]]:
    """Of each row: the lower-cased text, its chunks' identifiers in order, and where the chunks end."""
    data, offs = text_buffer(batch.column("text"))
    data = _LOWER[data]
    raw = memoryview(data)
    for lo, hi, ends in zip(offs[:-1].tolist(), offs[1:].tolist(), cuts(data, offs), strict=True):
        yield raw[lo:hi], [hashlib.blake2b(raw[a:b], digest_size=size, key=key).digest() for a, b in zip([lo, *ends], ends, strict=False)], [e - lo for e in ends]


def _print(recipe: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(recipe, digest_size=8).digest(), "little", signed=True)


def _recipes(batches: Iterator[pa.RecordBatch], key: bytes, size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        found = [(b"".join(ids), hashlib.sha256(text).hexdigest()) for text, ids, _ in _chunks(batch, key, size)]
        columns = [batch.column("id"), pa.array([r for r, _ in found], pa.binary()), pa.array([_print(r) for r, _ in found], pa.int64()), pa.array([s for _, s in found], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field("id", batch.schema.field("id").type), *schema]))


_RECIPE = pa.schema([("recipe", pa.binary()), ("print", pa.int64()), ("text_sha256", pa.string())])


def _contents(batches: Iterator[pa.RecordBatch], key: bytes, size: int, repeated: Broadcast) -> Iterator[pa.RecordBatch]:
    """(identifier, bytes) of the chunks of every text whose recipe may be that of another; each once a block."""
    for batch in blocks(batches, "text"):
        rows = list(_chunks(batch, key, size))
        prints = np.array([_print(b"".join(ids)) for _, ids, _ in rows], np.int64)
        some = {(i, bytes(text[a:b])) for k in np.flatnonzero(may_have(repeated, prints)).tolist() for text, ids, ends in [rows[k]] for i, a, b in zip(ids, [0, *ends], ends, strict=False)}
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.binary()), pa.array([c for _, c in some], pa.binary())], ["identifier", "bytes"])


def _verified_recipes(texts: DataFrame, where: str, size: int) -> DataFrame:
    """(id, recipe, print, text_sha256) for each row, under a key that gives no two chunks of texts that look equal one identifier."""
    kind = dict(texts.dtypes)["id"]
    attempt = 0
    while True:
        key = f"chunk {attempt}".encode()
        recipes = written(texts.mapInArrow(partial(_recipes, key=key, size=size, schema=_RECIPE), f"id {kind}, recipe binary, print long, text_sha256 string"), where, f"recipes-{attempt}")
        again = recipes.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print")
        contents = texts.mapInArrow(partial(_contents, key=key, size=size, repeated=bit_table(again, REPEATED_BITS)), "identifier binary, bytes binary").distinct()
        if contents.groupBy("identifier").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return recipes
        remove(texts.sparkSession, f"{where}/recipes-{attempt}")
        attempt += 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = DIGEST) -> DataFrame:
    """A row (id, keep_id, group_size, kept, text_sha256, n_chunks) for each row of docs.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty
    one, and empty texts, whose recipe is empty, are equal. keep_id is the largest id
    among the rows of equal texts, group_size their number (rows that repeat count each),
    kept is true for one of them: of rows that tie in the largest id, for one.
    A null id is below every other; where all are null, keep_id is null and one row stays. Texts of any
    length are cut whole; an empty table gives an empty one; other columns are not used.

    digest_bytes: the size of an identifier; with fewer bytes more keys are tried.
    """
    spark = docs.sparkSession
    where = shared_dir(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    recipes = _verified_recipes(texts, where, digest_bytes).withColumn("row", F.monotonically_increasing_id())
    rows = written(recipes, where, "rows")
    best = F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", F.negative("row").alias("row")))
    groups = rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).where("n > 1")
    # Written first, so that the join reads plain rows on both sides and a recipe of very many copies can be split.
    groups = written(groups.select("recipe", "n", F.col("best.id").alias("keep"), F.negative("best.row").alias("keep_row")), where, "groups")
    met = rows.join(groups, "recipe", "left")
    single = F.col("n").isNull()
    return met.select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
        (F.length("recipe") / digest_bytes).cast("long").alias("n_chunks"),
    )
