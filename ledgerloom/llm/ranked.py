"""Ranked lexical search over bit-sliced impacts.

A block of documents holds for each term the places of its documents and the bits of
their impacts, one bitmap for each bit. An item's scores in a block are the sum of its terms'
bitmaps: 64 documents at a time are added with and, or and exclusive or, a carry going from each
slice to the next. The best k then come from the slices, the most significant
first: documents with the bit set go ahead of those without, until k are chosen. No
score is ever written out but those of the documents chosen.

The index is a table with a row for each block and term. It holds the terms of
the items alone, whose hashes and weights lie in sorted arrays in the shared folder, mapped by every task.
Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM_LOWER, blocks, cut_words, hand_back, remove, shared_dir, spread, written
from .files import mapped, write_array

K = 20
#: Documents of a block (an offset takes two bytes), postings after which one is closed, and items added up at a time.
BLOCK_DOCS, BLOCK_POSTINGS, BATCH_ITEMS = 4096, 1 << 21, 256
#: The largest impact before its weight.
IMPACT = 1_000_000


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(cut_words(batch.column("text"), ALNUM_LOWER).hashes()).view(np.int64))], ["term"])


def _write_vocabulary(batches: Iterator[pa.RecordBatch], where: str) -> Iterator[pa.RecordBatch]:
    terms = np.sort(np.concatenate([np.zeros(0, np.int64), *(np.asarray(b.column(0)) for b in batches)]).view(np.uint64))
    write_array(f"{where}/terms", terms)
    yield pa.RecordBatch.from_pydict({"n": [len(terms)]}, schema=pa.schema([("n", pa.int64())]))


def _known(hashes: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are terms of the vocabulary, and the numbers of those."""
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    hit = np.flatnonzero(terms[at] == hashes)
    return hit, at[hit]


def _postings(column: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each (row, term of the vocabulary) that occurs: the row, the term's number, how often; and each row's words."""
    words = cut_words(column, ALNUM_LOWER)
    hit, term = _known(words.hashes(), terms)
    key, tf = np.unique(words.row_of()[hit] * len(terms) + term, return_counts=True)
    return key // len(terms), key % len(terms), tf, words.counts


def _statistics(batches: Iterator[pa.RecordBatch], where: str) -> Iterator[pa.RecordBatch]:
    """(key, n): a term's number and its documents in this task; -1 and the documents with words; -2 and all words."""
    terms = mapped(f"{where}/terms", "<u8")
    df, docs, total = np.zeros(len(terms), np.int64), 0, 0
    for batch in blocks(batches, "text"):
        _, term, _, counts = _postings(batch.column("text"), terms)
        df += np.bincount(term, minlength=len(terms))
        docs, total = docs + int((counts > 0).sum()), total + int(counts.sum())
    some = np.flatnonzero(df)
    hand_back()
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some])), pa.array(np.concatenate([[docs, total], df[some]]))], ["key", "n"])


def _write_weights(batches: Iterator[pa.RecordBatch], where: str, size: int, docs: int) -> Iterator[pa.RecordBatch]:
    df = np.zeros(size, np.int64)
    for b in batches:
        key, n = np.asarray(b.column("key")), np.asarray(b.column("n"))
        df[key[key >= 0]] = n[key >= 0]
    # math.log is the C library's, as SQL's ln is; numpy's may differ in the last bit.
    write_array(f"{where}/weights", np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64))
    yield pa.RecordBatch.from_pydict({"n": [size]}, schema=pa.schema([("n", pa.int64())]))


def _write_items(batches: Iterator[pa.RecordBatch], where: str, batch_items: int) -> Iterator[pa.RecordBatch]:
    """Items in batches, those of most terms first: where each one's terms begin, their numbers, how often each stands in the item."""
    terms = mapped(f"{where}/terms", "<u8")
    for block in blocks(batches, "text"):
        for at in range(0, block.num_rows, batch_items):
            some = block.slice(at, batch_items)
            row, term, often, _ = _postings(some.column("text"), terms)
            size = np.bincount(row, minlength=some.num_rows)
            order = np.argsort(-size, kind="stable")
            first = np.concatenate([[0], np.cumsum(size)])
            taken = np.concatenate([np.zeros(0, np.int64), *(np.arange(first[r], first[r + 1]) for r in order)]).astype(np.int64)
            name = uuid.uuid4().hex
            for what, a in (("first", np.concatenate([[0], np.cumsum(size[order])])), ("term", term[taken]), ("often", often[taken])):
                write_array(f"{where}/{name}-{what}", a.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([name] * some.num_rows), pa.array(np.arange(some.num_rows)), some.column("id").take(pa.array(order))], ["batch", "place", "id"])


def _packed(ids: pa.Array) -> bytes:
    out = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids], ["id"])
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _index(batches: Iterator[pa.RecordBatch], where: str, n_docs: int, n_words: int, block_docs: int) -> Iterator[pa.RecordBatch]:
    """(block, term, docs, planes): places of the term's documents in the block, and a bitmap over them for each bit of their impacts; at term -1 the documents' ids."""
    terms, weights = mapped(f"{where}/terms", "<u8"), mapped(f"{where}/weights", "<i8")
    held: list[tuple[np.ndarray, ...]] = []
    ids: list[pa.Array] = []

    def closed() -> pa.RecordBatch:
        term, doc, impact = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, term))
        term, doc, impact = term[order], doc[order].astype(np.uint16), impact[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        places, planes = [], []
        for doc_, x in zip(np.split(doc, first)[1:], np.split(impact, first)[1:], strict=True):
            bits = np.arange(int(x.max()).bit_length())[:, None]
            places.append(doc_.tobytes())
            planes.append(np.packbits((x >> bits & 1).astype(np.uint8), axis=1, bitorder="little").tobytes())
        every = pa.concat_arrays(ids)
        held.clear()
        ids.clear()
        key = pa.array([uuid.uuid4().hex] * (len(first) + 1))
        return pa.RecordBatch.from_arrays([key, pa.array([-1, *term[first].tolist()], pa.int64()), pa.array([_packed(every), *places], pa.binary()), pa.array([b"", *planes], pa.binary())], ["block", "term", "docs", "planes"])

    for block in blocks(batches, "text"):
        for at in range(0, block.num_rows, block_docs):
            some = block.slice(at, block_docs)
            if ids and sum(map(len, ids)) + some.num_rows > block_docs:
                yield closed()
            row, term, tf, counts = _postings(some.column("text"), terms)
            long = np.array([75 + 25 * n * n_docs // n_words for n in counts.tolist()], np.int64)
            impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * long[row]))
            on = impact > 0
            held.append((term[on], row[on] + sum(map(len, ids)), impact[on]))
            ids.append(some.column("id"))
            if sum(len(h[0]) for h in held) > BLOCK_POSTINGS:
                yield closed()
    if ids:
        yield closed()
    hand_back()


def spread_out(docs: np.ndarray, planes: bytes, words: int) -> np.ndarray:
    """A term's bitmaps over all documents of the block: (bits, words)."""
    each = -(-len(docs) // 8)
    held = np.unpackbits(np.frombuffer(planes, np.uint8).reshape(-1, each), axis=1, count=len(docs), bitorder="little")
    out = np.zeros((len(held), words * 64), np.uint8)
    out[:, docs] = held
    return np.packbits(out, axis=1, bitorder="little").view("<u8")


def add(total: np.ndarray, more: np.ndarray, shift: int) -> None:
    """total += more << shift, both (items, bits, words), the carry going up slice by slice."""
    carry = np.zeros((total.shape[0], total.shape[2]), np.uint64)
    for s in range(shift, total.shape[1]):
        a = total[:, s]
        if s - shift < more.shape[1]:
            b = more[:, s - shift]
            half = a ^ b
            total[:, s], carry = half ^ carry, a & b | carry & half
        elif carry.any():
            total[:, s], carry = a ^ carry, a & carry
        else:
            break


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (items, words) of the documents surely among the k best with a score over 0, and of those that tie for what is left."""
    tied = np.bitwise_or.reduce(total, axis=1)
    sure = np.zeros_like(tied)
    for s in range(total.shape[1] - 1, -1, -1):
        with_bit = tied & total[:, s]
        n = np.bitwise_count(sure | with_bit).sum(1, dtype=np.int64)[:, None]
        sure = np.where(n > k, sure, sure | with_bit)
        tied = np.where(n > k, with_bit, np.where(n == k, np.uint64(0), tied & ~total[:, s]))
    return sure, tied


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _scores(total: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The scores of an item's chosen documents; total: (bits, words)."""
    bits = total[:, docs >> 6] >> (docs & 63).astype(np.uint64) & np.uint64(1)
    return (bits.astype(np.int64) << np.arange(len(total))[:, None]).sum(0)


def _search(rows: pa.Table, where: str, names: list[str], k: int) -> pa.Table:
    """(batch, place, doc, score): the best k of this block for each item."""
    weights = mapped(f"{where}/weights", "<i8")
    held = {t: (d, p) for t, d, p in zip(*(rows.column(c).to_pylist() for c in ("term", "docs", "planes")), strict=True)}
    ids = pa.ipc.open_stream(held.pop(-1)[0]).read_all().column(0).combine_chunks()
    words = -(-len(ids) // 64)
    rank = np.empty(len(ids), np.int64)
    rank[np.asarray(pc.array_sort_indices(ids))] = np.arange(len(ids))
    batch, place, doc, score = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for name in names:
        first, term, often = (mapped(f"{where}/{name}-{what}", "<i8") for what in ("first", "term", "often"))
        size = np.diff(first)
        most = max((sum(q * w for q, w in zip(often[a:b].tolist(), weights[term[a:b]].tolist(), strict=True)) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)), default=0)
        total = np.zeros((len(size), max(1, (most * IMPACT).bit_length()), words), np.uint64)
        for t in range(int(size.max(initial=0))):
            # Items come with the most terms first: those that have a t-th one are the first of them.
            now = first[:-1][: int((size > t).sum())] + t
            planes = {x: spread_out(np.frombuffer(held[x][0], "<u2"), held[x][1], words) for x in set(term[now].tolist()) if x in held}
            have = np.array([i for i, x in enumerate(term[now].tolist()) if x in planes], np.int64)
            if not len(have):
                continue
            more = np.zeros((len(have), max(len(p) for p in planes.values()), words), np.uint64)
            for j, i in enumerate(have.tolist()):
                p = planes[int(term[now[i]])]
                more[j, : len(p)] = p
            times = often[now[have]]
            for bit in range(int(times.max()).bit_length()):
                if len(on := np.flatnonzero(times >> bit & 1)):
                    part = total[have[on]]
                    add(part, more[on], bit)
                    total[have[on]] = part
        sure, tied = best(total, k)
        for i in range(len(size)):
            certain, even = _places(sure[i]), _places(tied[i])
            chosen = np.concatenate([certain, even[np.argsort(rank[even])][: k - len(certain)]])
            batch += [name] * len(chosen)
            place += [i] * len(chosen)
            doc.append(chosen)
            score.append(_scores(total[i], chosen))
    hand_back()
    return pa.table([pa.array(batch, pa.string()), pa.array(place, pa.int64()), ids.take(pa.array(np.concatenate(doc))), pa.array(np.concatenate(score))], ["batch", "place", "doc", "score"])


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", k: int = K, block_docs: int = BLOCK_DOCS, batch_items: int = BATCH_ITEMS) -> DataFrame:
    """A row (item id, rank, doc id, score) for each of the k best documents, with a score over 0, of each item.

    A score is the sum over the item's words, repeats included, of weight times impact, in
    integers throughout: the weight falls with the documents that hold the word, the impact grows with how often
    it stands in the document and falls with the document's length. Equal scores come by ascending id, a null id
    last. Null and empty texts have no words: such items find nothing, such documents are not found and don't count.
    Each row is a document or an item of its own, rows that repeat too. Texts of any length count whole.
    With an empty table on either side nothing is found; other columns are not used.

    A block holds block_docs documents at most, and ends sooner when it has two million postings.
    Items are the query set: their distinct words' hashes and weights (16 bytes a word) pass one task.
    """
    spark = docs.sparkSession
    where = shared_dir(spark)
    arrays = f"{where}/arrays"
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("id"), F.col(text_col).alias("text"))
    doc_kind, item_kind = dict(texts.dtypes)["id"], dict(asked.dtypes)["id"]
    nothing = asked.where("false").select(F.col("id").alias(item_col), F.lit(0).alias("rank"), F.lit(None).cast(doc_kind).alias(id_col), F.lit(0).cast("long").alias("score"))
    if not (size := asked.mapInArrow(_distinct_terms, "term long").distinct().repartition(1).mapInArrow(partial(_write_vocabulary, where=arrays), "n long").first()):
        return nothing
    counted = written(texts.mapInArrow(partial(_statistics, where=arrays), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), where, "counted")
    all_ = {r["key"]: r["n"] for r in counted.where("key < 0").collect()}
    n_docs, n_words = all_.get(-1, 0), all_.get(-2, 0)
    if not n_words:
        return nothing
    counted.repartition(1).mapInArrow(partial(_write_weights, where=arrays, size=size[0], docs=n_docs), "n long").collect()
    batches = written(asked.mapInArrow(partial(_write_items, where=arrays, batch_items=batch_items), f"batch string, place long, id {item_kind}"), where, "asked")
    names = [r.batch for r in batches.select("batch").distinct().collect()]
    index = texts.mapInArrow(partial(_index, where=arrays, n_docs=n_docs, n_words=n_words, block_docs=block_docs), "block string, term long, docs binary, planes binary")
    index = written(index, where, "index")
    n_blocks = index.where("term = -1").count()
    found = spread(index, n_blocks, "block").groupBy("block").applyInArrow(lambda rows: _search(rows, arrays, names, k), f"batch string, place long, doc {doc_kind}, score long")
    order = Window.partitionBy("batch", "place").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    top = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), where, "top")
    remove(spark, f"{where}/index")
    return top.join(batches, ["batch", "place"]).select(F.col("id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
