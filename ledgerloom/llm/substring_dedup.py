"""Substring dedup with repeated-phrase automata.

1. Phrases: in every window of 50 words the phrase of 20 words with the least hash
   stands for the window, so that equal windows have equal phrases, and there is
   about one phrase for 16 words. Phrases of two or more documents recur.
2. Recurring passages: the stretches of documents around recurring phrases are cut
   out (segments); the windows in them are grouped by hash to the first document
   that has each, and of that document the runs of windows that others have too
   are its passages. Each repeated window is in a passage of its first document.
3. Automata: passages are dealt by first document into shards of a bounded number of
   words, and a shard's Aho-Corasick automaton holds every 25th run of 25 words of
   them (any window of 50 holds one). A document's segments go to the shards that
   have a passage of a smaller document with a phrase of theirs; where those of a
   shard are many, several tasks build its automaton and share them. A hit is
   extended word by word (by numbers of word hashes) against the passage; 50 equal
   words or more are a repeat, and they go.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import bit_table, filtered, only
from .common import SPACED, Words, blocks, clear, cut_words, mixed, parts_for, remove, shared_dir, window_hashes, written

WINDOW, PHRASE = 50, 20
HOP = WINDOW // 2
#: Bytes of text in a group of documents, in what is cut at once, and in the segments that an automaton reads.
BLOCK_BYTES, TEXT_BYTES, READ_BYTES = 6 << 20, 2 << 20, 8 << 20
#: Words of passages in one automaton, and in one passage; longer ones are cut, one window less a word overlapping.
SHARD_WORDS, PASSAGE_WORDS = 300_000, 50_000
ID_BITS, PHRASE_BITS = 1 << 23, 1 << 25


def _phrases(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts of all windows, the phrase that stands for each, and each one's hash."""
    h, row = words.hashes(), words.row_of()
    if len(h) < WINDOW:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, none
    g = window_hashes(h, PHRASE)
    least, span, want = g, 1, WINDOW - PHRASE + 1
    while span * 2 <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n = len(h) - WINDOW + 1
    least = np.minimum(least[:n], least[want - span : want - span + n])
    starts = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    whole = mixed(g[starts] ^ mixed(g[starts + PHRASE] ^ mixed(g[starts + WINDOW - PHRASE])))
    return starts, least[starts], whole


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _steps(key: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    if not len(key):
        return np.zeros(0, np.int64)
    new = key[1:] != key[:-1]
    for x in more:
        new |= x[1:] != x[:-1]
    return np.flatnonzero(np.concatenate([[True], new]))


def _doc_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(m, id) of each document's phrases."""
    for block in blocks(batches, "__text", TEXT_BYTES):
        words = cut_words(block.column("__text"), SPACED)
        starts, m, _ = _phrases(words)
        row = words.row_of()[starts]
        at = _steps(m, row)
        yield pa.RecordBatch.from_arrays([_longs(m[at]), block.column("__id").take(pa.array(row[at]))], names=["m", "id"])


def _pairs_in(of: np.ndarray, value: np.ndarray, pool_of: np.ndarray, pool_value: np.ndarray) -> np.ndarray:
    """Which (of, value) are among the pool's pairs."""
    mark = mixed(pool_value ^ mixed(pool_of.view(np.uint64) + np.uint64(1)))
    return np.isin(mixed(value ^ mixed(of.view(np.uint64) + np.uint64(1))), mark)


def _runs(starts: np.ndarray, rows: np.ndarray, join: int) -> Iterator[tuple[int, int, int]]:
    """(row, first, last + 1) of words for runs of window starts that are `join` apart at most."""
    if not len(starts):
        return
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(starts) > join) | (rows[1:] != rows[:-1])]))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(starts)], strict=True):
        yield int(rows[a]), int(starts[a]), int(starts[b - 1]) + WINDOW


def _listed(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], names=names)


def _segments(docs: pa.Table, phrases: pa.Table) -> pa.Table:
    """(id, start, text, ms) of the stretches of the block's documents around their recurring phrases, and these phrases."""
    out: list[tuple] = []
    if phrases.num_rows:
        pool = [np.asarray(phrases.column(c).combine_chunks()) for c in (1, 2)]
        for block in blocks(iter(docs.combine_chunks().to_batches()), "text", TEXT_BYTES):
            words = cut_words(block.column("text"), SPACED)
            starts, m, _ = _phrases(words)
            ids = np.asarray(block.column("id"))
            row = words.row_of()[starts]
            ok = _pairs_in(ids[row], m, pool[0], pool[1].view(np.uint64))
            starts, row, m = starts[ok], row[ok], m[ok]
            for r, a, b in _runs(starts, row, WINDOW):
                own = m[np.searchsorted(starts, a) : np.searchsorted(starts, b - WINDOW, "right")]
                out.append((int(ids[r]), a - int(words.rows[r]), words.buf[words.starts[a] : words.ends[b - 1]].tobytes(), np.unique(own).view(np.int64).tolist()))
    return _listed(out, ["id", "start", "text", "ms"], [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", TEXT_BYTES):
        words = cut_words(block.column("text"), SPACED)
        starts, _, w = _phrases(words)
        yield pa.RecordBatch.from_arrays([_longs(w), block.column("id").take(pa.array(words.row_of()[starts]))], names=["w", "id"])


def _passages(segments: pa.Table, repeated: pa.Table) -> pa.Table:
    """(first, piece, n_words, passage, ms) of the runs of windows that begin with this document."""
    out: list[tuple] = []
    if repeated.num_rows:
        pool = [np.asarray(repeated.column(c).combine_chunks()) for c in (1, 2)]
        for block in blocks(iter(segments.combine_chunks().to_batches()), "text", TEXT_BYTES):
            words = cut_words(block.column("text"), SPACED)
            starts, m, w = _phrases(words)
            ids = np.asarray(block.column("id"))
            row = words.row_of()[starts]
            ok = _pairs_in(ids[row], w, pool[0], pool[1].view(np.uint64))
            starts, row, m = starts[ok], row[ok], m[ok]
            for r, first, end in _runs(starts, row, 1):
                for a in range(first, end - WINDOW + 1, PASSAGE_WORDS - WINDOW + 1):
                    b = min(end, a + PASSAGE_WORDS)
                    own = m[np.searchsorted(starts, a) : np.searchsorted(starts, b - WINDOW, "right")]
                    out.append((int(ids[r]), (a - first) // PASSAGE_WORDS, b - a, words.buf[words.starts[a] : words.ends[b - 1]].tobytes(), np.unique(own).view(np.int64).tolist()))
    return _listed(out, ["first", "piece", "n_words", "passage", "ms"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())])


class Automaton:
    """Runs of HOP words of some passages; a word's number is a character of the strings that are matched.

    A window that holds such a run reaches HOP words to either side of it at most, so
    for each place of a run these words are kept, with gaps (-2) beyond the passage.
    """

    #: Characters that stand for words; numbers beyond share them, and the comparison of numbers decides.
    LETTERS = 1_100_000

    def __init__(self, first: np.ndarray, passages: list[np.ndarray]):
        gap = np.full(2 * HOP, -2, np.int32)
        flat = np.concatenate([gap, *(x for p in passages for x in (p, gap))])
        begin = 2 * HOP + np.concatenate([[0], np.cumsum([len(p) + 2 * HOP for p in passages])[:-1]])
        runs = [np.arange(0, len(p) - HOP + 1, HOP) for p in passages]
        at = np.concatenate([b + r for b, r in zip(begin, runs, strict=True)])
        around = np.lib.stride_tricks.sliding_window_view(flat, 3 * HOP)[at - HOP]
        text, kinds = self.string(flat), {}
        kind = np.array([kinds.setdefault(text[i : i + HOP], len(kinds)) for i in at.tolist()])
        order = np.argsort(kind, kind="stable")
        self.begin = np.searchsorted(kind[order], np.arange(len(kinds) + 1))
        self.around, self.first = around[order], np.repeat(first, [len(r) for r in runs])[order]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for key, k in kinds.items():
            self.machine.add_word(key, k)
        self.machine.make_automaton()

    @classmethod
    def string(cls, ids: np.ndarray) -> str:
        """A character from 1 on, past the surrogates, for each number; 0 for those below 0."""
        at = np.where(ids < 0, 0, ids % cls.LETTERS + 1)
        return np.where(at < 0xD800, at, at + 0x800).astype(np.uint32).tobytes().decode("utf-32-le")

    def repeats(self, at: np.ndarray, doc: int) -> np.ndarray:
        """Which words (numbers) are in a window that a passage of a smaller document has."""
        covered = np.zeros(len(at), bool)
        gap = np.full(HOP, -3, np.int32)
        padded = np.concatenate([gap, at, gap])
        for end, key in self.machine.iter(self.string(at)):
            p = end - HOP + 1
            if covered[max(p - HOP, 0) : end + HOP + 1].all():
                continue  # all that windows with this hit could cover
            some = slice(self.begin[key], self.begin[key + 1])
            same = self.around[some][self.first[some] < doc] == padded[p : p + 3 * HOP]
            if not len(same):
                continue
            # The run itself must be equal (its letters are), then the words next to it one by one.
            same = same[same[:, HOP : 2 * HOP].all(1)]
            left = np.logical_and.accumulate(same[:, HOP - 1 :: -1], 1).sum(1)
            right = np.logical_and.accumulate(same[:, 2 * HOP :], 1).sum(1)
            for x, y in set(zip(left.tolist(), right.tolist(), strict=True)):
                if x + y >= WINDOW - HOP:
                    covered[p - x : end + 1 + y] = True
        return covered


def _word_hashes(texts: pa.ChunkedArray) -> Iterator[np.ndarray]:
    """The hashes of each text's words."""
    for block in blocks(iter(pa.table({"text": texts}).combine_chunks().to_batches()), "text", TEXT_BYTES):
        words = cut_words(block.column("text"), SPACED)
        h = words.hashes()
        for a, b in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True):
            yield h[a:b]


def _locate(segments: pa.Table, passages: pa.Table) -> pa.Table:
    """(id, a, b) of the repeats in the segments, which are read one by one."""
    out: list[tuple] = []
    if passages.num_rows and segments.num_rows:
        rows = [h.copy() for h in _word_hashes(passages.column("passage"))]
        vocab, at = np.unique(np.concatenate(rows), return_inverse=True)
        numbers = np.split(at.astype(np.int32), np.cumsum([len(x) for x in rows])[:-1])
        del rows
        machine = Automaton(np.asarray(passages.column("first").combine_chunks()), numbers)
        ids, begins = segments.column("id").to_pylist(), segments.column("start").to_pylist()
        for doc, start, h in zip(ids, begins, _word_hashes(segments.column("text")), strict=True):
            at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
            covered = machine.repeats(np.where(vocab[at] == h, at, -1).astype(np.int32), doc)
            if covered.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))).reshape(-1, 2)
                out += [(doc, start + a, start + b) for a, b in edges.tolist()]
    return _listed(out, ["id", "a", "b"], [pa.int64()] * 3)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_words, n_removed, kept text) with the spans cut."""
    for block in blocks(batches, "__text", TEXT_BYTES):
        texts = block.column("__text").cast(pa.binary())
        n, cut, kept = [], [], []
        spans = block.column("__spans").to_pylist() if "__spans" in block.schema.names else [None] * block.num_rows
        for text, some in zip(texts, spans, strict=True):
            words = (text.as_py() or b"").split()
            n.append(len(words))
            if some:
                keep = np.ones(len(words), bool)
                for s in some:
                    keep[s["a"] : s["b"]] = False
                cut.append(int(len(words) - keep.sum()))
                words = [words[i] for i in np.flatnonzero(keep).tolist()]
            else:
                cut.append(0)
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([block.column("__id"), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(kept, pa.binary())], names=["__id", "n_words", "n_removed", "kept"])


def repeats(docs: DataFrame, where: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, b): the words a to b - 1 of document id are covered by windows that a document of a smaller id has."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).where("__id is not null and __text is not null")
    size = base.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    n = parts_for(size, BLOCK_BYTES)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n))

    two = [F.min("id").alias("first"), F.max("id").alias("last")]
    phrases = written(base.mapInArrow(_doc_phrases, "m long, id long"), where, "phrases")
    recurring = written(phrases.groupBy("m").agg(*two).where("first < last").select("m"), where, "recurring")
    own = only(phrases, bit_table(recurring, PHRASE_BITS), "m", inside=True).join(recurring, "m").select(F.col("id").alias("pid"), F.col("m").alias("pm"))
    own = written(own.distinct(), where, "own")
    remove(spark, f"{where}/phrases")
    some = only(base, bit_table(own.select("pid").distinct(), ID_BITS), "__id", inside=True)
    some = some.select(block("__id").alias("qb"), F.col("__id").alias("id"), F.col("__text").alias("text"))
    own = own.select(block("pid").alias("pb"), "pid", "pm")
    segments = some.groupBy("qb").cogroup(own.groupBy("pb")).applyInArrow(_segments, "id long, start long, text binary, ms array<long>")
    segments = written(segments, where, "segments")

    repeated = segments.select("text", "id").mapInArrow(_windows, "w long, id long").groupBy("w").agg(*two).where("first < last").select("first", "w")
    repeated = written(repeated, where, "repeated")
    holds = bit_table(repeated.select("first").distinct(), ID_BITS)
    cut = only(segments.select("id", "text"), holds, "id", inside=True).select(block("id").alias("qb"), "id", "text")
    repeated = repeated.select(block("first").alias("pb"), F.col("first").alias("pid"), F.col("w").alias("pw"))
    passages = cut.groupBy("qb").cogroup(repeated.groupBy("pb")).applyInArrow(_passages, "first long, piece long, n_words long, passage binary, ms array<long>")
    passages = written(passages, where, "passages")

    # Passages that share phrases go to one shard, as far as its size allows: they are asked for by the same segments.
    known = passages.select("first", "piece", F.explode("ms").alias("m"))
    anchors = known.join(known.groupBy("m").agg(F.min("first").alias("anchor")), "m").groupBy("first", "piece").agg(F.min("anchor").alias("anchor"))
    passages = written(passages.join(anchors, ["first", "piece"]), where, "anchored")
    total = passages.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    spread = passages.groupBy("anchor").agg(F.ceil(F.sum("n_words") / SHARD_WORDS).alias("spread"))
    part = F.pmod(F.xxhash64("first", "piece"), F.col("spread"))
    passages = passages.join(spread, "anchor").withColumn("shard", F.pmod(F.xxhash64("anchor", part), F.lit(parts_for(total, SHARD_WORDS))))

    has = passages.select("shard", "first", F.explode("ms").alias("m")).groupBy("m", "shard").agg(F.min("first").alias("first"))
    asks = segments.select("id", "start", F.octet_length("text").alias("size"), F.explode("ms").alias("m"))
    routes = asks.join(has, "m").where("first < id").groupBy("id", "start", "shard").agg(F.max("size").alias("size"))
    routes = written(routes, where, "routes")
    tasks = written(routes.groupBy("shard").agg(F.ceil(F.sum("size") / READ_BYTES).alias("tasks")), where, "tasks")
    asked = segments.select("id", "start", "text").join(routes.join(tasks, "shard"), ["id", "start"]).select("shard", F.pmod(F.xxhash64("id", "start"), F.col("tasks")).alias("task"), "id", "start", "text")
    told = passages.join(tasks, "shard").select(F.col("shard").alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("t"), "first", "passage")
    return asked.groupBy("shard", "task").cogroup(told.groupBy("s", "t")).applyInArrow(_locate, "id long, a long, b long")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id (an integer), n_words, n_removed, kept (the kept words as bytes, joined by one space).

    Words are what stands between blanks, unchanged. A word goes if a window of 50
    words covers it that also starts in a document of a smaller id; windows are
    those of the input, so what goes does not protect what it repeats. Null and
    empty texts have no words. A null id is no smaller id than another and has
    none: such rows stay whole. Rows that repeat an id do not count as smaller
    than each other, and lose the words that any row of the id loses at the same
    places. Empty tables give an empty result; other columns are not used.
    """
    where = shared_dir(docs.sparkSession)
    spans = written(repeats(docs, where, id_col, text_col), where, "spans")
    clear(docs.sparkSession, where, keep=("spans",))
    ids = bit_table(spans.select("id").distinct(), ID_BITS)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    out = "__id long, n_words long, n_removed long, kept binary"
    whole = base.mapInArrow(lambda batches: _kept(filtered(batches, ids, "__id", inside=False)), out)
    listed = spans.groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("__spans"))
    cut = only(base, ids, "__id", inside=True).join(listed, F.col("__id") == F.col("id"), "left").select("__id", "__text", "__spans").mapInArrow(_kept, out)
    return whole.union(cut).select(F.col("__id").cast(kind).alias(id_col), "n_words", "n_removed", "kept")
