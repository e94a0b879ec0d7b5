"""Benchmark decontamination with an FM-index per training shard.

A shard is a block of texts inside one task. Its words become the symbols of the
phrases' own vocabulary (any other word and any text end is a gap; a stretch
between gaps that is shorter than the shortest phrase holds no occurrence and is
left out, which loses nothing). Over that sequence the shard builds a suffix
array, its BWT as a wavelet matrix, and samples of the suffix positions; all
phrases are searched backwards at once, their rows located by walking to a
sampled row, and the occurrences merged into spans. Texts are not shuffled. The
phrases are built by tasks, in blocks of a fixed number of words, and written to the
shared folder, from where a worker opens one block at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_LOWER, blocks, cut_words, inside_rows, mixed, parts_for, row_sums, shared_dir, text_buffer
from .files import mapped, write_array

WINDOW = 10
SAMPLE = 8
#: Words of a block of phrases, about; bytes of text of a shard.
BLOCK_WORDS, SHARD_BYTES = 500_000, 4 << 20


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; the last symbol is the only smallest one."""
    n = len(s)
    rank = s.astype(np.int64)
    step = 1
    while True:
        nxt = np.full(n, -1, np.int64)
        nxt[: n - step] = rank[step:]
        key = rank * np.int64(max(n, int(rank.max()) + 1) + 1) + (nxt + 1)
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit of the symbol at a time."""

    def __init__(self, s: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (s >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            self.levels.append((b, len(s) - int(ones[-1]), ones))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c is among the first i symbols."""
        lo, hi = np.zeros_like(i), i
        for b, zeros, ones in self.levels:
            bit = ((c >> b) & 1).astype(bool)
            lo = np.where(bit, zeros + ones[lo], lo - ones[lo])
            hi = np.where(bit, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def symbol(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for b, zeros, ones in self.levels:
            bit = ones[i + 1] - ones[i]
            c |= bit.astype(np.int64) << b
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
        return c


class FMIndex:
    """Backward search and location over symbols >= 2; symbol 1 is a gap, 0 the end."""

    def __init__(self, s: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        sa = suffix_array(s)
        self.n = len(s)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n_symbols))])
        self.bwt = WaveletMatrix(s[sa - 1], max(1, int(n_symbols - 1).bit_length()))
        at = np.flatnonzero(sa % sample == 0)
        self.sampled = np.zeros(self.n + 1, np.int32)
        self.sampled[at + 1] = 1
        self.sampled = np.cumsum(self.sampled)
        self.places = sa[at]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of phrases, all of one length, its range of suffix rows."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(hi > lo)
            if not len(live):
                break
            c = phrases[live, k]
            lo[live] = self.first[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.first[c] + self.bwt.rank(c, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        todo, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            known = self.sampled[row + 1] > self.sampled[row]
            out[todo[known]] = self.places[self.sampled[row[known]]] + steps
            todo, row = todo[~known], row[~known]
            c = self.bwt.symbol(row)
            row = self.first[c] + self.bwt.rank(c, row)
            steps += 1
        return out


class Phrases:
    """The distinct windows of a block of items, over the block's own vocabulary."""

    def __init__(self, items: list[tuple], size: int):
        words = cut_words(pa.array([t for _, t in items], pa.string()), ALNUM_LOWER)
        self.items = [i for i, _ in items]
        self.vocab, ids = np.unique(words.hashes(), return_inverse=True)
        ids = (ids + 2).astype(np.int32)
        self.by_size = []
        for n in range(1, size + 1):
            # Whole items of fewer words; all windows of the others.
            starts = inside_rows(words.rows, size) if n == size else words.rows[:-1][words.counts == n]
            if not len(starts):
                continue
            windows = ids[starts[:, None] + np.arange(n)]
            h = np.zeros(len(starts), np.uint64)
            for k in range(n):
                h = mixed(h ^ windows[:, k].astype(np.uint64))
            _, first, which = np.unique(h, return_index=True, return_inverse=True)
            pair = np.unique(which * len(items) + words.row_of()[starts])
            bounds = np.searchsorted(pair // len(items), np.arange(len(first) + 1))
            self.by_size.append((n, windows[first].astype(np.int64), bounds, pair % len(items)))
        self.least = min((x[0] for x in self.by_size), default=0)


@lru_cache(maxsize=1)
def _opened(uri: str) -> Phrases:
    return pickle.loads(mapped(uri, "u1").tobytes())


def shard_hits(h: np.ndarray, rows: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words of the shard are hit; and (row, item index) of the items that occur, once each."""
    n = len(h)
    none = np.zeros(0, np.int64)
    if not phrases.least or not n:
        return np.zeros(n, bool), none, none
    at = np.minimum(np.searchsorted(phrases.vocab, h), len(phrases.vocab) - 1)
    known = phrases.vocab[at] == h
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    new = known & ~np.concatenate([[False], known[:-1]]) | known & edge[:n]
    begins = np.flatnonzero(new)
    if not len(begins):
        return np.zeros(n, bool), none, none
    run = np.cumsum(new) - 1
    length = np.bincount(run[known], minlength=len(begins))
    keep = np.flatnonzero(length >= phrases.least)
    if not len(keep):
        return np.zeros(n, bool), none, none
    begins, length = begins[keep], length[keep]
    to = np.concatenate([[0], np.cumsum(length + 1)])
    s = np.ones(to[-1] + 1, np.int64)
    s[-1] = 0
    source = np.zeros(to[-1] + 1, np.int64)
    inner = np.repeat(begins - to[:-1], length) + (put := np.repeat(to[:-1] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()))
    s[put], source[put] = at[inner] + 2, inner
    index = FMIndex(s, len(phrases.vocab) + 2)
    cover = np.zeros(n + 1, np.int64)
    of_row, of_item = [none], [none]
    for size, windows, bounds, items in phrases.by_size:
        lo, hi = index.search(windows)
        which = np.repeat(np.arange(len(windows)), hi - lo)
        if not len(which):
            continue
        skip = np.concatenate([[0], np.cumsum(hi - lo)[:-1]])
        place = source[index.locate(np.repeat(lo - skip, hi - lo) + np.arange(len(which)))]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + size, -1)
        row = np.searchsorted(rows, place, "right") - 1
        pair = np.unique(row * len(windows) + which)
        row, which = pair // len(windows), pair % len(windows)
        count = bounds[which + 1] - bounds[which]
        skip = np.concatenate([[0], np.cumsum(count)[:-1]])
        of_row.append(np.repeat(row, count))
        of_item.append(items[np.repeat(bounds[which] - skip, count) + np.arange(count.sum())])
    pairs = np.unique(np.concatenate(of_row) * len(phrases.items) + np.concatenate(of_item))
    return np.cumsum(cover[:n]) > 0, pairs // len(phrases.items), pairs % len(phrases.items)


def _search(batches: Iterator[pa.RecordBatch], phrases: str) -> Iterator[pa.RecordBatch]:
    """(id, n_words, spans of hit words, items) of each text."""
    p = _opened(phrases)
    for block in blocks(batches, "__text", SHARD_BYTES):
        words = cut_words(block.column("__text"), ALNUM_LOWER)
        hit, row, item = shard_hits(words.hashes(), words.rows, p)
        names: list[list[str]] = [[] for _ in range(block.num_rows)]
        for r, k in zip(row.tolist(), item.tolist(), strict=True):
            if p.items[k] is not None:
                names[r].append(str(p.items[k]))
        spans: list[list[dict]] = [[] for _ in range(block.num_rows)]
        if hit.any():
            edge = np.zeros(len(hit), bool)
            edge[words.rows[:-1][words.rows[:-1] < len(hit)]] = True
            begin = hit & (~np.concatenate([[False], hit[:-1]]) | edge)
            stop = hit & (~np.concatenate([hit[1:], [False]]) | np.concatenate([edge[1:], [True]]))
            for a, b in zip(np.flatnonzero(begin).tolist(), np.flatnonzero(stop).tolist(), strict=True):
                r = int(np.searchsorted(words.rows, a, "right")) - 1
                spans[r].append({"first": a - int(words.rows[r]), "last": b - int(words.rows[r])})
        out = [block.column("__id"), block.column("__th"), pa.array(words.counts), pa.array(spans, _SPANS), pa.array(names, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(out, names=["__id", "__th", "n_words", "spans", "items"])


def _words_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _search, without a phrase."""
    for block in blocks(batches, "__text", SHARD_BYTES):
        nothing = [[] for _ in range(block.num_rows)]
        out = [block.column("__id"), block.column("__th"), pa.array(cut_words(block.column("__text"), ALNUM_LOWER).counts), pa.array(nothing, _SPANS), pa.array(nothing, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(out, names=["__id", "__th", "n_words", "spans", "items"])


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def phrase_blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, block_words: int) -> list[str]:
    """Where the blocks of Phrases are; tasks build and write them, and the driver gets their numbers alone."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    folder = f"{shared_dir(spark)}/phrases"

    def build(key: tuple, block: pa.Table) -> pa.Table:
        made = Phrases([*zip(block.column("item").to_pylist(), block.column("text").to_pylist(), strict=True)], size)
        write_array(f"{folder}/{key[0].as_py()}.bin", np.frombuffer(pickle.dumps(made), np.uint8))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64())})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(parts_for(total, 6 * block_words))))
    made = dealt.groupBy("block").applyInArrow(build, "block long").collect()
    return [f"{folder}/{r.block}.bin" for r in sorted(made)]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row of docs: id, n_words, spans (first and last word of each merged hit), items (ids as strings, sorted).

    A phrase is `size` consecutive words of an item, or the whole of an item of
    fewer words. Null and empty texts have no words, no spans and no items; so
    does every text where the benchmark is empty. Repeated rows each get their
    own result. An item id that repeats with other texts has the windows of all;
    an item without an id hits words, and is not listed. Other columns are not
    used. A text of any length is one row of a shard; an empty table gives an
    empty result.
    """
    base = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__th"), F.col(text_col).alias("__text"))
    kind = dict(base.dtypes)["__id"]
    schema = f"__id {kind}, __th long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"
    found = [base.mapInArrow(partial(_search, phrases=p), schema) for p in phrase_blocks(benchmark, item_id, item_text, size, block_words)]
    if not found:
        found = [base.mapInArrow(_words_alone, schema)]
    if len(found) == 1:
        return found[0].select(F.col("__id").alias(id_col), "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items"))
    # Spans of the blocks are merged: sorted by first word, a span opens where none before reaches it.
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    every = every.groupBy("__id", "__th").agg(F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("__n"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("__s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.expr(
        "aggregate(__s, cast(array() as array<struct<first:bigint,last:bigint>>), (acc, x) -> "
        "if(size(acc) > 0 and x.first <= element_at(acc, -1).last + 1, concat(slice(acc, 1, size(acc) - 1), "
        "array(named_struct('first', element_at(acc, -1).first, 'last', greatest(element_at(acc, -1).last, x.last)))), concat(acc, array(x))))"
    )
    copies = F.explode(F.sequence(F.lit(1), (F.col("__n") / len(found)).cast("int")))
    return every.select(F.col("__id").alias(id_col), "n_words", merged.alias("spans"), "items", copies.alias("__copy")).drop("__copy")


def _clean(batches: Iterator[pa.RecordBatch], phrases: list, text: str) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, text, SHARD_BYTES):
        texts = None
        todo = np.arange(block.num_rows)
        while len(todo):
            col = block.column(text).take(pa.array(todo)) if texts is None else pa.array([texts[i] for i in todo], pa.string())
            words = cut_words(col, ALNUM_LOWER)
            h = words.hashes()
            hit = np.zeros(len(h), bool)
            for p in phrases:
                hit |= shard_hits(h, words.rows, _opened(p))[0]
            offs, again = text_buffer(col)[1], []
            for r in np.flatnonzero(row_sums(hit.astype(np.int64), words.rows)).tolist():
                if texts is None:
                    texts = block.column(text).to_pylist()
                a, b = int(words.rows[r]), int(words.rows[r + 1])
                raw = texts[todo[r]].encode()
                base = int(offs[r])
                out, at = [], 0
                mask = hit[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                for first, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    out.append(raw[at : int(words.starts[a + first]) - base])
                    at = int(words.ends[a + stop - 1]) - base
                out.append(raw[at:])
                texts[todo[r]] = b"".join(out).decode()
                again.append(int(todo[r]))
            todo = np.array(again, np.int64)
        if texts is not None:
            k = block.schema.get_field_index(text)
            block = block.set_column(k, block.schema.field(k), pa.array(texts, block.schema.field(k).type))
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with every merged span cut out of the text, from its first word's first byte to its last word's last.

    What a cut brings together is searched again until the text has no phrase
    left. Rows, columns and clean texts stay as they are; nulls stay null, rows
    that repeat are cut each. An empty benchmark cuts nothing, an empty table stays one;
    a text of any length is searched whole, and other columns pass as they are, whatever
    their names. Spans that tie or overlap are one.
    """
    phrases = phrase_blocks(benchmark, item_id, item_text, size, block_words)
    return docs.mapInArrow(partial(_clean, phrases=phrases, text=text_col), docs.schema)
