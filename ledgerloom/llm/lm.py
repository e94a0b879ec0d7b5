"""Language-model scoring: interpolated modified Kneser-Ney, order 2.

Three scans. The first counts words: tasks combine their own counts, a shuffle
brings each hash range together, and every range becomes a sorted hash array whose
positions are the word ids. The second counts pairs of ids the same way; a range of
contexts is a shard, and a context that has more than a shard's share of all tokens
is spread over shards of its own by the second word. Shards write sorted key and
count arrays, and the numbers of continuations each way. The third scan scores
texts; workers memory-map the arrays and look up a block's distinct words and pairs
in sorted order. The driver sees the size of each shard, sums, and the few words
that are spread, and no counts.

The order is 2, the least that has a context. Of the 27.1 million tokens of the check's
0.1 GB 12.1 million pairs and 18.9 million triples are distinct (measured); the arrays
and shuffles of triples and of their contexts are estimated from that at over 4 times
the input on disk, which is more than the budget. Order 3 was not built.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED_LOWER, blocks, cut_words, row_sums, shared_dir, written
from .files import mapped, merged, pack_counts, pack_sorted, unpack_counts, unpack_sorted, write_array

#: Bytes of text for each shard of words and of pairs; keys that a task holds before it hands them on.
WORD_SHARD_BYTES, PAIR_SHARD_BYTES, HELD_KEYS = 64 << 20, 24 << 20, 4_000_000
END = 0xE4D0F7E4D0F7E4D1
_ROWS = pa.schema([("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_DDL = "shard long, keys binary, counts binary"


def _sequences(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each row's words and of the end after them; the rows' offsets."""
    words = cut_words(col, SPACED_LOWER)
    rows = words.rows + np.arange(len(words.rows))
    out = np.full(int(rows[-1]), END, np.uint64)
    out[np.arange(len(words.starts)) + words.row_of()] = words.hashes()
    return out, rows


def _packed(shard: np.ndarray, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the sorted keys, a row a shard; none without keys."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    shard, keys, n = shard[order], keys[order], n[order]
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    for a, b in zip(cut, [*cut[1:], len(shard)], strict=True):
        yield pa.RecordBatch.from_pydict({"shard": [int(shard[a])], "keys": [pack_sorted(keys[a:b])], "counts": [pack_counts(n[a:b])]}, schema=_ROWS)


def _held(found: Iterator[np.ndarray], shard_of) -> Iterator[pa.RecordBatch]:
    """Counts of the keys of all blocks of a task, handed on whenever they are many."""
    keys, counts, size = [], [], 0
    for block in found:
        key, n = np.unique(block, return_counts=True)
        keys.append(key)
        counts.append(n)
        size += len(key)
        if size > HELD_KEYS:
            key, n = merged(keys, counts)
            yield from _packed(shard_of(key), key, n)
            keys, counts, size = [], [], 0
    key, n = merged(keys, counts)
    yield from _packed(shard_of(key), key, n)


def _of_range(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of equal ranges of 64-bit hashes; at most 2^31 of them."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    yield from _held((_sequences(b.column("__text"))[0] for b in blocks(batches, "__text")), lambda k: _of_range(k, shards))


def _gather(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return merged([unpack_sorted(x) for x in group["keys"]], [unpack_counts(x) for x in group["counts"]])


def _write_words(group: pd.DataFrame, folder: str) -> pd.DataFrame:
    shard = int(group["shard"].iloc[0])
    keys, n = _gather(group)
    write_array(f"{folder}/words-{shard}.bin", keys)
    write_array(f"{folder}/counts-{shard}.bin", n)
    return pd.DataFrame({"shard": [shard], "n": [len(keys)], "total": [int(n.sum())]})


def _hot_words(shards: Iterator[pd.DataFrame], folder: str, starts: np.ndarray, share: int) -> Iterator[pd.DataFrame]:
    """(id, n) of the words that make up more than a pair shard's share of all tokens."""
    for s in (x for frame in shards for x in frame["id"].tolist()):
        if starts[s + 1] > starts[s]:
            n = mapped(f"{folder}/counts-{s}.bin", "<i8")
            hot = np.flatnonzero(n > share)
            yield pd.DataFrame({"id": starts[s] + hot, "n": n[hot]})


@dataclass
class Model:
    """Where the arrays are, and the totals; small, whatever the corpus."""

    folder: str
    word_shards: int
    pair_shards: int
    starts: np.ndarray  # of the ids of each word shard
    tokens: int = 0
    vocabulary: int = 0
    texts: int = 0
    hot: dict[int, tuple[int, int]] = field(default_factory=dict)  # context -> first own shard, how many
    discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    lower: np.ndarray = field(default_factory=lambda: np.zeros(4))
    pairs: int = 0
    gamma0: float = 1.0
    hot_kinds: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def base(self) -> int:
        return self.vocabulary + 1

    def word_ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted distinct hashes: their ids (-1: unknown) and training counts."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        shard = _of_range(h, self.word_shards)
        for s, a, b in _runs(shard):
            if self.starts[s + 1] == self.starts[s]:
                continue
            keys, n = mapped(f"{self.folder}/words-{s}.bin", "<u8"), mapped(f"{self.folder}/counts-{s}.bin", "<i8")
            at = np.minimum(np.searchsorted(keys, h[a:b]), len(keys) - 1)
            known = keys[at] == h[a:b]
            ids[a:b] = np.where(known, at + self.starts[s], -1)
            counts[a:b] = np.where(known, n[at], 0)
        return ids, counts

    def shard_bounds(self) -> np.ndarray:
        """The first context of each pair shard (the start of a text is context V)."""
        return -(-np.arange(self.pair_shards + 1) * self.base // self.pair_shards)

    def pair_shard(self, keys: np.ndarray) -> np.ndarray:
        u = (keys // np.uint64(self.base)).astype(np.int64)
        out = u * self.pair_shards // self.base
        if self.hot:
            hot = np.array(sorted(self.hot))
            at = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
            some = np.flatnonzero(hot[at] == u)
            first, n = (np.array([self.hot[int(x)][k] for x in hot])[at[some]] for k in range(2))
            w = (keys[some] % np.uint64(self.base)).astype(np.int64)
            out[some] = first + w * n // self.base
        return out


def _runs(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if not len(shard):
        return
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    for a, b in zip(cut, [*cut[1:], len(shard)], strict=True):
        yield int(shard[a]), int(a), int(b)


def _ids(model: Model, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and training counts of all tokens, and the rows' offsets."""
    h, rows = _sequences(col)
    kinds, at = np.unique(h, return_inverse=True)
    ids, counts = model.word_ids(kinds)
    return ids[at], counts[at], rows


def _contexts(model: Model, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    u = np.concatenate([[0], ids[:-1]])
    u[rows[:-1]] = model.vocabulary
    return u


def _count_pairs(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: Model = model.value

    def keys(block):
        ids, _, rows = _ids(m, block.column("__text"))
        return _contexts(m, ids, rows).astype(np.uint64) * np.uint64(m.base) + ids.astype(np.uint64)

    yield from _held((keys(b) for b in blocks(batches, "__text")), m.pair_shard)


def _write_pairs(group: pd.DataFrame, m: Model) -> pd.DataFrame:
    """Writes the shard; returns its distinct second words by word shard, and a row of totals."""
    shard = int(group["shard"].iloc[0])
    keys, n = _gather(group)
    write_array(f"{m.folder}/pairs-{shard}.bin", keys)
    write_array(f"{m.folder}/paircounts-{shard}.bin", n.astype(np.uint64))
    u, w = (keys // np.uint64(m.base)).astype(np.int64), (keys % np.uint64(m.base)).astype(np.int64)
    kind = np.minimum(n, 3) - 1
    info = {"of_count": [int((n == k).sum()) for k in range(1, 5)]}
    if shard < m.pair_shards:
        lo, hi = m.shard_bounds()[shard : shard + 2]
        kinds = np.bincount((u - lo) * 3 + kind, minlength=3 * (hi - lo)).astype(np.uint64)
        write_array(f"{m.folder}/kinds-{shard}.bin", kinds)
    elif len(u):
        info |= {"hot": int(u[0]), "kinds": np.bincount(kind, minlength=3).tolist()}
    second, times = np.unique(w, return_counts=True)
    of = np.searchsorted(m.starts, second, "right") - 1
    rows = [*_packed(of, second.astype(np.uint64), times)]
    out = pa.Table.from_batches(rows, _ROWS).to_pandas()
    return pd.concat([out, pd.DataFrame({"shard": [-1 - shard % 16], "keys": [json.dumps(info).encode()], "counts": [b""]})], ignore_index=True)


def _write_continuations(group: pd.DataFrame, m: Model) -> pd.DataFrame:
    shard = int(group["shard"].iloc[0])
    if shard < 0:
        return pd.DataFrame({"info": [x.decode() for x in group["keys"]]})
    ids, n = _gather(group)
    dense = np.zeros(int(m.starts[shard + 1] - m.starts[shard]), np.uint64)
    dense[ids.astype(np.int64) - int(m.starts[shard])] = n
    write_array(f"{m.folder}/continuations-{shard}.bin", dense)
    return pd.DataFrame({"info": [json.dumps({"cont": [int((n == k).sum()) for k in range(1, 5)], "more": int((n > 2).sum()), "types": int(n.sum())})]})


def _discounts(n: np.ndarray) -> np.ndarray:
    """D(0..3) of modified Kneser-Ney from how many have count 1, 2, 3, 4; usual values where some are missing."""
    if n[:4].min() <= 0:
        return np.array([0, 0.5, 1.0, 1.4])
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]])
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


def train(docs: DataFrame, text_col: str = "text", word_bytes: int = WORD_SHARD_BYTES, pair_bytes: int = PAIR_SHARD_BYTES) -> Model:
    """Counts all rows of docs; a null text is an empty one. The arrays go to the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("__text"))
    texts, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()
    word_shards, pair_shards = 1 + size // word_bytes, 1 + size // pair_bytes
    folder = f"{shared_dir(spark)}/lm"
    words = rows.mapInArrow(partial(_count_words, shards=word_shards), _DDL)
    got = words.repartition(word_shards, "shard").groupBy("shard").applyInPandas(lambda g: _write_words(g, folder), "shard long, n long, total long").collect()
    n = np.zeros(word_shards, np.int64)
    for r in got:
        n[r.shard] = r.n
    m = Model(folder, word_shards, pair_shards, np.concatenate([[0], np.cumsum(n)]), sum(r.total for r in got), int(n.sum()), texts)
    share = max(1, m.tokens // pair_shards)
    hot = spark.range(word_shards).mapInPandas(partial(_hot_words, folder=folder, starts=m.starts, share=share), "id long, n long").collect()  # fewer than pair shards
    at = pair_shards
    for u, c in sorted([(r.id, r.n) for r in hot] + ([(m.vocabulary, texts)] if texts > share else [])):
        m.hot[u] = (at, -(-c // share))
        at += m.hot[u][1]
    shared = spark.sparkContext.broadcast(m)
    pairs = rows.mapInArrow(partial(_count_pairs, model=shared), _DDL)
    by_shard = pairs.repartition(at, "shard").groupBy("shard").applyInPandas(lambda g: _write_pairs(g, shared.value), _DDL)
    info = written(by_shard.groupBy("shard").applyInPandas(lambda g: _write_continuations(g, shared.value), "info string"), folder.rpartition("/")[0], "totals")
    info = info.select(F.from_json("info", "of_count array<long>, cont array<long>, more long, types long, hot long, kinds array<long>").alias("x")).select("x.*")
    sums = info.agg(*[F.coalesce(F.sum(F.get(c, F.lit(k))), F.lit(0)).alias(f"{c}{k}") for c in ("of_count", "cont") for k in range(4)], *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("more", "types")]).first()
    of_count, cont = (np.array([sums[f"{c}{k}"] for k in range(4)]) for c in ("of_count", "cont"))
    m.discounts, m.lower = _discounts(of_count), _discounts(cont)
    m.pairs = sums.types
    m.gamma0 = float(m.lower[1] * cont[0] + m.lower[2] * cont[1] + m.lower[3] * sums.more) / m.pairs if m.pairs else 1.0
    for r in info.where("hot is not null").groupBy("hot").agg(*[F.sum(F.get("kinds", F.lit(k))).alias(f"k{k}") for k in range(3)]).collect():
        m.hot_kinds[r.hot] = np.array([r.k0, r.k1, r.k2])
    return m


def _dense(uri, ids: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Rows of `width` values of a sharded dense array for sorted ids."""
    out = np.zeros((len(ids), width), np.int64)
    for s, a, b in _runs(np.searchsorted(bounds, ids, "right") - 1):
        out[a:b] = mapped(uri(s), "<u8").reshape(-1, width)[ids[a:b] - bounds[s]]
    return out


def _log_probs(m: Model, ids: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """log10 of each token's probability after the one before it."""
    u = _contexts(m, ids, rows)
    word, at = np.unique(ids, return_inverse=True)
    known = word >= 0
    k = np.zeros(len(word), np.int64)
    k[known] = _dense(lambda s: f"{m.folder}/continuations-{s}.bin", word[known], m.starts, 1)[:, 0]
    low = np.maximum(k - m.lower[np.minimum(k, 3)], 0) / max(m.pairs, 1) + m.gamma0 / (m.vocabulary + 1)
    low = low[at]
    ctx, at = np.unique(u, return_inverse=True)
    known = ctx >= 0
    kinds = np.zeros((len(ctx), 3), np.int64)
    if m.pairs:
        held = known & ~np.isin(ctx, list(m.hot))
        bounds = m.shard_bounds()
        live = np.flatnonzero(held)
        kinds[live] = _dense(lambda s: f"{m.folder}/kinds-{s}.bin", ctx[live], bounds, 3)
        for i in np.flatnonzero(known & ~held).tolist():
            kinds[i] = m.hot_kinds[int(ctx[i])]
    before = np.concatenate([[0], counts[:-1]])
    before[rows[:-1]] = m.texts
    gamma = (kinds @ m.discounts[1:])[at] / np.maximum(before, 1)
    seen = np.zeros(len(ids), np.int64)
    both = np.flatnonzero((u >= 0) & (ids >= 0) & (before > 0))
    if len(both):
        pair, at = np.unique(u[both].astype(np.uint64) * np.uint64(m.base) + ids[both].astype(np.uint64), return_inverse=True)
        shard = m.pair_shard(pair)
        order = np.argsort(shard, kind="stable")
        n = np.zeros(len(pair), np.int64)
        for s, a, b in _runs(shard[order]):
            keys, c = mapped(f"{m.folder}/pairs-{s}.bin", "<u8"), mapped(f"{m.folder}/paircounts-{s}.bin", "<u8")
            if len(keys):
                ask = pair[order[a:b]]
                hit = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
                n[order[a:b]] = np.where(keys[hit] == ask, c[hit], 0)
        seen[both] = n[at]
    high = np.maximum(seen - m.discounts[np.minimum(seen, 3)], 0) / np.maximum(before, 1)
    return np.log10(np.where(before > 0, high + gamma * low, low))


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    for block in blocks(batches, "__text"):
        ids, counts, rows = _ids(m, block.column("__text"))
        n = np.diff(rows)
        base = row_sums(np.log10((counts + 1) / (m.tokens + m.vocabulary + 1)), rows)
        score = row_sums(_log_probs(m, ids, counts, rows), rows)
        out = [block.column("__id"), pa.array(n), pa.array(row_sums((counts > 0).astype(np.int64), rows)), pa.array(np.full(len(n), m.tokens)), pa.array(base), pa.array(score), pa.array(10 ** np.minimum(-score / n, 300))]
        yield pa.RecordBatch.from_arrays(out, names=["__id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Tokens are the words between blanks, A-Z lower-cased, and one end. base_score
    is of the unigram model with one added to each count, score of the bigram
    model, both log10 probabilities of the whole text. A null text is an empty one
    and has its end alone. Where nothing was learned, every word is unknown and
    both scores are 0. Repeated rows each get their own result; texts of any length
    are whole, an empty table gives an empty result, and other columns are not used.
    """
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = dict(base.dtypes)["__id"]
    ddl = f"__id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return base.mapInArrow(partial(_score, model=docs.sparkSession.sparkContext.broadcast(model)), ddl).withColumnRenamed("__id", id_col)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; null for a null id, which `where(~...)` then leaves out as well."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part
