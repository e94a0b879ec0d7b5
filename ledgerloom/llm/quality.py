"""Quality classifier by co-training of a text view and a metadata view.

Two logistic models see different columns of the same labelled rows. In each round
all unlabelled rows are scored in Spark, and each view hands the rows that it is most
sure of, of each class, to the other one's training set. At the end both are
calibrated on labelled rows that neither has seen, a third logistic model combines
the two calibrated views, and all documents are scored in one pass. Toxic labels are
a second target, learned in the same way and the same passes; its text view holds the
words that tell toxic labelled rows from others, counted in Spark. Features are
computed once and stored in the shared folder for the rounds; each model is fitted in a
task, and the driver holds weights alone. The labelled rows are a bounded sample,
chosen by a hash of the id; the bound is a parameter.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import ALNUM_LOWER, SPACED, blocks, cut_words, hand_back, hash_ranges, remove, row_sums, shared_dir, text_buffer, written

#: Labelled rows at most; rounds of co-training, and rows that a view hands over in each.
LABELLED_ROWS, ROUNDS, PER_ROUND = 20_000, 5, 500
SURE = 0.95
#: Share of the good calibration rows that the threshold may reject.
LOST = 0.002
BUCKETS, SOURCES = 128, 64
#: Bytes of text that a task looks at at once.
TEXT_BYTES = 1 << 20
#: Words of the toxic target's text view, at most; each is so many standard deviations from chance.
TELLING_WORDS, TELLING_FAR = 256, 3.0


def _classes() -> np.ndarray:
    t = np.full(256, 7, np.uint8)  # 7: non-ASCII
    t[:128] = 6  # 6: control
    t[97:123], t[65:91], t[48:58] = 0, 1, 2
    t[[32, 9, 10, 11, 12, 13]] = 3
    t[[ord(c) for c in ".,;:!?'\"-()"]] = 4
    t[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 5
    return t


_CLASS = _classes()


def text_features(col: pa.Array, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of character classes, word and line statistics, and hashed word frequencies of each row; and how often, up to 255 times, it has each word of vocab (sorted hashes)."""
    data, offs = text_buffer(col)
    n = np.maximum(np.diff(offs), 1).astype(float)
    cls = _CLASS[data]
    out = [row_sums((cls == k).astype(np.int64), offs) / n for k in range(8)]
    words = cut_words(col, ALNUM_LOWER)
    h, count = words.hashes(), np.maximum(words.counts, 1)
    row = words.row_of()
    key = np.sort(row.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=len(n))
    most = np.zeros(len(n))
    if len(key):
        at = np.flatnonzero(new)
        np.maximum.at(most, (key[at] >> np.uint64(40)).astype(np.int64), np.diff(np.append(at, len(key))))
    size = row_sums((words.ends - words.starts).astype(np.int64), words.rows)
    tokens = np.maximum(cut_words(col, SPACED).counts, 1)
    out += [np.log1p(words.counts), size / count, distinct / count, most / count, words.counts / tokens]
    ends = np.unique(np.concatenate([np.flatnonzero(data == 10), offs[1:][np.diff(offs) > 0] - 1])) if len(data) else np.zeros(0, np.int64)
    line_row = np.searchsorted(offs, ends, "right") - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    lines = np.maximum(np.bincount(line_row, minlength=len(n)), 1)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    stop = np.where(data[ends] == 10, ends, ends + 1)
    lh = hash_ranges(padded, begins, np.maximum(stop, begins))
    key = np.unique(line_row.astype(np.uint64) << np.uint64(40) | lh >> np.uint64(24))
    kinds = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=len(n))
    closed = np.isin(padded[np.maximum(stop - 1, 0)], [46, 33, 63]) & (stop > begins)
    out += [np.log1p(lines), np.log1p(n / lines), kinds / lines, np.bincount(line_row, closed, minlength=len(n)) / lines]
    bag = np.zeros(len(n) * BUCKETS)
    np.add.at(bag, row * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), 1)
    told = np.zeros(len(n) * len(vocab))
    if len(vocab):
        at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
        hit = vocab[at] == h
        np.add.at(told, row[hit] * len(vocab) + at[hit], 1)
    told = np.minimum(told, 255).reshape(len(n), len(vocab)).astype(np.uint8)
    return np.column_stack([*out, np.sqrt(bag.reshape(len(n), BUCKETS) / count[:, None])]).astype(np.float32), told


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Hashed source and language, and the recorded length."""
    out = np.zeros((len(source), SOURCES + 16 + 4), np.float32)
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, zlib.crc32(str(s).encode()) % SOURCES] = 1
        out[i, SOURCES + zlib.crc32(str(g).encode()) % 16] = 1
        size = np.log1p(max(n or 0, 0))
        out[i, -4:] = (n is None, size, size * size / 10, (n or 0) < 200)
    return out


def _features(block: pa.RecordBatch, vocab: np.ndarray, text: str = "__text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return *text_features(block.column(text), vocab), meta_features(*(block.column(c).to_pylist() for c in ("__source", "__lang", "__n")))


def _toxic_view(text: np.ndarray, told: np.ndarray) -> np.ndarray:
    return np.column_stack([text[:, :-BUCKETS], np.log1p(told, dtype=np.float32)])


class Logistic:
    """L2 logistic regression on standardised columns, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = self._z(x)
        weight = np.ones(len(y)) if weight is None else weight
        self.w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], l2)
        ridge[-1] = 1e-3
        for _ in range(25):
            g, hess = ridge * self.w, np.diag(ridge)
            for a in range(0, len(z), 2048):  # wide numbers for a part of the rows at a time
                part, own = z[a : a + 2048].astype(np.float64), weight[a : a + 2048]
                p = 1 / (1 + np.exp(-np.clip(part @ self.w, -30, 30)))
                g += part.T @ (own * (p - y[a : a + 2048]))
                hess += (part * (own * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ part
            step = np.linalg.solve(hess, g)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break

    def _z(self, x: np.ndarray) -> np.ndarray:
        z = np.ones((len(x), x.shape[1] + 1), x.dtype)
        np.subtract(x, self.mean, out=z[:, :-1])
        z[:, :-1] /= self.scale
        return z

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._z(x) @ self.w, -30, 30)

    def proba(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


class CoTrained:
    """Two views, calibrated and combined; threshold is the least probability that is kept. It holds models alone, no rows."""

    def __init__(self, share: float, per_round: int):
        """share: of good rows among those that are learned from."""
        self.share, self.per_round, self.models, self.n_handed = share, per_round, [], [0, 0]

    def wanted(self) -> list[tuple[int, float, float, int]]:
        """(view, class, how sure at least, how many rows at most) of what is handed over in a round."""
        out = []
        for k in (0, 1):
            for good, most in ((1.0, self.share), (0.0, 1 - self.share)):
                # By chance alone a row is of a common class: to be sure of that takes more.
                out.append((k, good, 1 - (1 - SURE) * min(1.0, 2 * (1 - most)), max(1, int(self.per_round * most))))
        return out

    def calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        """raw: both views' logits of rows kept back, a row each."""
        self.platt = [Logistic(raw[:, [k]], y, l2=0.1) for k in range(2)]
        both = np.column_stack([p.logit(raw[:, [k]]) for k, p in enumerate(self.platt)])
        self.joint = Logistic(both, y, l2=0.1)
        good = np.sort(self.joint.proba(both)[y == 1])
        self.threshold = float(min(0.5, good[int(len(good) * LOST)]))

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = [m.logit(v)[:, None] for m, v in zip(self.models, (text, meta), strict=True)]
        both = [p.logit(x) for p, x in zip(self.platt, raw, strict=True)]
        views = [1 / (1 + np.exp(-b)) for b in both]
        return views[0], views[1], self.joint.proba(np.column_stack(both))


class Classifier:
    """What rejects bad rows and what rejects toxic ones; either may be missing."""

    def __init__(self, good: CoTrained | None, safe: CoTrained | None, vocab: np.ndarray):
        self.good, self.safe, self.vocab = good, safe, vocab
        self.n_pseudo = (good or safe).n_handed

    def score(self, text: np.ndarray, told: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, ...]:
        """p_text, p_meta, p_good, p_safe, keep."""
        ones = np.ones(len(text))
        a, b, good = self.good.score(text, meta) if self.good else (ones, ones, ones)
        safe = self.safe.score(_toxic_view(text, told), meta)[2] if self.safe else ones
        keep = np.ones(len(text), bool)
        for p, m in ((good, self.good), (safe, self.safe)):
            if m:
                keep &= p >= m.threshold
        return a, b, good, safe, keep


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, n_toxic) of the task's rows: in how many, and in how many toxic ones."""
    kept = []
    for block in blocks(batches, "__text", TEXT_BYTES):
        words = cut_words(block.column("__text"), ALNUM_LOWER)
        pair = np.unique(np.rec.fromarrays([words.row_of(), words.hashes()], names="row,word"))
        word, at = np.unique(pair["word"], return_inverse=True)
        toxic = np.array(block.column("__t").to_pylist(), float)[pair["row"].astype(np.int64)]
        kept.append((word, np.bincount(at, minlength=len(word)), np.bincount(at, toxic, minlength=len(word))))
    if kept:
        word, at = np.unique(np.concatenate([w for w, _, _ in kept]), return_inverse=True)
        n, t = (np.bincount(at, np.concatenate([x[k] for x in kept]), len(word)).astype(np.int64) for k in (1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n), pa.array(t)], names=["word", "n", "n_toxic"])
        kept = word = at = None
    hand_back()


def telling_words(rows: DataFrame, most: int = TELLING_WORDS, least_far: float = TELLING_FAR) -> np.ndarray:
    """Sorted hashes of the words of __text whose share among toxic rows (__t = 1) is farthest from chance, in standard deviations (of one row more in variance, so that rare words need more)."""
    size, toxic = rows.agg(F.count(F.lit(1)), F.sum("__t")).first()
    if not toxic or toxic == size:
        return np.zeros(0, np.uint64)
    share = toxic / size
    found = rows.mapInArrow(_count_words, "word long, n long, n_toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("t"))
    far = F.abs(F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)) + 1)
    got = found.where(far >= least_far).orderBy(far.desc(), "word").limit(most).select("word").toArrow()
    return np.sort(np.array(got["word"].to_pylist(), np.int64).view(np.uint64))


_FEATURES = "doc long, key long, y int, t int, text binary, told binary, meta binary"


def _stored_features(batches: Iterator[pa.RecordBatch], vocab: np.ndarray) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "__text", TEXT_BYTES):
        views = [pa.array([x.tobytes() for x in v], pa.binary()) for v in _features(block, vocab)]
        yield pa.RecordBatch.from_arrays([*(block.column(c) for c in ("__row", "__key", "__y", "__t")), *views], names=["doc", "key", "y", "t", "text", "told", "meta"])


def _matrices(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = rows.num_rows
    return tuple(np.frombuffer(b"".join(rows.column(c).to_pylist()), kind).reshape(n, -1) if n and len(rows.column(c)[0].as_py()) else np.zeros((n, 0), kind) for c, kind in (("text", np.float32), ("told", np.uint8), ("meta", np.float32)))


def _surest(batches: Iterator[pa.RecordBatch], trained, used) -> Iterator[pa.RecordBatch]:
    """(g, sure, and the row) of the task's unlabelled rows that a view of a target is most sure of, as many as a round takes; one of each text."""
    best: dict[int, tuple[np.ndarray, np.ndarray, pa.Table]] = {}
    for batch in batches:
        keys = np.asarray(batch.column("key"))
        text, told, meta = _matrices(batch)
        for target, (model, column, done) in enumerate(zip(trained.value, ("y", "t"), used, strict=True)):
            if model is None:
                continue
            models, wanted = model
            free = np.flatnonzero(np.asarray(batch.column(column).is_null()) & ~np.isin(keys, done))
            free = free[np.unique(keys[free], return_index=True)[1]]
            views = (text if target == 0 else _toxic_view(text, told), meta)
            for k, good, least, n in wanted:
                p = models[k].proba(views[k][free])
                sure = p if good else 1 - p
                some = np.flatnonzero(sure >= least)
                some = some[np.lexsort((keys[free[some]], -sure[some]))[:n]]
                g = target * 4 + k * 2 + int(good)
                rows = pa.Table.from_batches([batch.take(pa.array(free[some]))]).select(["key", "text", "told", "meta"])
                if g in best:
                    rows = pa.concat_tables([best[g][2], rows])
                    sure_all, key_all = np.concatenate([best[g][0], sure[some]]), np.concatenate([best[g][1], keys[free[some]]])
                else:
                    sure_all, key_all = sure[some], keys[free[some]]
                order = np.lexsort((key_all, -sure_all))
                order = order[np.sort(np.unique(key_all[order], return_index=True)[1])][:n]
                best[g] = (sure_all[order], key_all[order], rows.take(pa.array(order)).combine_chunks())
        batch = text = told = meta = views = rows = None  # else held while the next batch comes
    hand_back()
    for g, (sure, _, rows) in best.items():
        for part in rows.to_batches():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sure), g, np.int32)), pa.array(sure), *part.columns], names=["g", "sure", "key", "text", "told", "meta"])
    best = rows = part = None
    hand_back()


#: What a model is fitted on: its number (two for each target: text, metadata), the round that a row is from, the row's hash, its class and its columns.
_FITTED_ON = pa.schema([("model", pa.int32()), ("part", pa.int32()), ("doc", pa.int64()), ("good", pa.float64()), ("x", pa.binary())])
_FITTED_DDL = "model int, part int, doc long, good double, x binary"


def _view_of(model: int, text: np.ndarray, told: np.ndarray, meta: np.ndarray) -> np.ndarray:
    return meta if model % 2 else text if model < 2 else _toxic_view(text, told)


def _rows_for(model: int, part: int, doc: np.ndarray, good: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, model, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(doc), pa.array(good.astype(float)), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())], schema=_FITTED_ON)


def _labels(batch: pa.RecordBatch, target: int) -> np.ndarray:
    """1 for rows that are to stay, 0 for those that are to go, -1 for those of which that isn't known."""
    return np.array([-1 if v is None else int(v == 1 - target) for v in batch.column("yt"[target]).to_pylist()], int)


def _from_labelled(batches: Iterator[pa.RecordBatch], targets: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        views, doc = _matrices(batch), np.asarray(batch.column("doc"))
        for target in targets:
            label = _labels(batch, target)
            known = label >= 0
            for model in (2 * target, 2 * target + 1):
                yield _rows_for(model, 0, doc[known], label[known], _view_of(model, *views)[known])
        batch = views = None
    hand_back()


def _from_handed(batches: Iterator[pa.RecordBatch], part: int, taken: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """taken: of each group (target, view, class) the keys of the rows that its view hands to the other one."""
    for batch in batches:
        views, key, group = _matrices(batch), np.asarray(batch.column("key")), np.asarray(batch.column("g"))
        for g, keys in taken.items():
            some = (group == g) & np.isin(key, keys)
            model = g // 4 * 2 + 1 - g // 2 % 2
            yield _rows_for(model, part, key[some], np.full(some.sum(), g % 2), _view_of(model, *views)[some])
        batch = views = None
    hand_back()


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the group's rows, which labelled_rows and what was handed over bound."""
    some, x = [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        some.append(batch.select(["model", "part", "doc", "good"]))
        x.append(np.frombuffer(text_buffer(batch.column("x"))[0], np.float32).reshape(batch.num_rows, -1).copy())
        batch = None
    rows, x = pa.Table.from_batches(some), np.concatenate(x)
    part, doc, good = (rows.column(c).to_numpy() for c in ("part", "doc", "good"))
    order = np.lexsort((good, doc, part))  # a row's hash comes once with each part
    model = Logistic(x[order], good[order])
    found = pa.RecordBatch.from_arrays([rows.column("model")[:1].combine_chunks().cast(pa.int32()), pa.array([pickle.dumps(model)], pa.binary())], names=["model", "fitted"])
    some = x = rows = part = doc = good = order = model = None
    hand_back()
    yield found


def _logits(batches: Iterator[pa.RecordBatch], models: list[list[Logistic] | None]) -> Iterator[pa.RecordBatch]:
    """(target, doc, held, good, text, meta): both views' logits of labelled rows."""
    for batch in batches:
        views, doc = _matrices(batch), np.asarray(batch.column("doc"))
        held = (doc.view(np.uint64) >> np.uint64(7) & np.uint64(3)) == 0
        for target, fitted in enumerate(models):
            if fitted:
                label = _labels(batch, target)
                known = label >= 0
                raw = [m.logit(_view_of(2 * target + k, *views)[known]) for k, m in enumerate(fitted)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(known.sum(), target, np.int32)), pa.array(doc[known]), pa.array(held[known]), pa.array(label[known]), *map(pa.array, raw)], ["target", "doc", "held", "good", "text", "meta"])
        batch = views = None
    hand_back()


def _apply(batches: Iterator[pa.RecordBatch], model, text: str) -> Iterator[pa.RecordBatch]:
    m: Classifier = model.value
    for block in blocks(batches, text, TEXT_BYTES):
        got = m.score(*_features(block, m.vocab, text))
        yield pa.RecordBatch.from_arrays([*(block.column(c) for c in block.schema.names if not c.startswith("__")), *map(pa.array, got)], names=[*(c for c in block.schema.names if not c.startswith("__")), "__p_text", "__p_meta", "__p_good", "__p_safe", "__keep"])


def _view(docs: DataFrame, text_col: str, source_col: str, lang_col: str, chars_col: str, *more):
    return docs.select(*more, F.col(text_col).alias("__text"), F.col(source_col).cast("string").alias("__source"), F.col(lang_col).cast("string").alias("__lang"), F.col(chars_col).cast("long").alias("__n"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", label_col: str = "quality", labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS, per_round: int = PER_ROUND, toxic_col: str = "toxic") -> Classifier | None:
    """The classifier; None where the labelled rows have both classes of neither label.

    A document labelled twice counts with its smaller label and as toxic if once
    labelled so; null labels and labels of unknown documents do not count. Labels
    without a column toxic_col teach nothing about toxic texts. An unlabelled text
    that repeats is handed over once; of rows that a view is equally sure of, those
    of the smaller text hash. Texts of any length are whole; an empty table teaches
    nothing, and other columns are not used.
    """
    spark = docs.sparkSession
    toxic = F.col(toxic_col).cast("int") if toxic_col in labels.columns else F.lit(None).cast("int")
    y = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(F.col(label_col).cast("int")).alias("__y"), F.max(toxic).alias("__t"))
    y = y.where("__y is not null or __t is not null").orderBy(F.xxhash64("__id"), "__id").limit(labelled_rows)
    y = spark.createDataFrame(y.toArrow(), y.schema)  # bounded by labelled_rows
    rows = _view(docs, text_col, source_col, lang_col, chars_col, F.xxhash64(F.col(id_col), F.col(text_col)).alias("__row"), F.xxhash64(text_col).alias("__key"), F.col(id_col).alias("__doc"))
    taught = F.shiftrightunsigned("__row", 7).bitwiseAND(F.lit(3)) != 0
    told = rows.join(F.broadcast(y), F.col("__doc") == F.col("__id"))
    vocab = telling_words(told.where(F.col("__t").isNotNull() & taught).select("__text", "__t")) if toxic_col in labels.columns else np.zeros(0, np.uint64)
    rows = rows.join(F.broadcast(y), F.col("__doc") == F.col("__id"), "left").drop("__doc", "__id")
    where = shared_dir(spark)
    features = written(rows.mapInArrow(partial(_stored_features, vocab=vocab), _FEATURES), where, "features")
    labelled = features.where("y is not null or t is not null").dropDuplicates(["doc"]).orderBy("doc").limit(2 * labelled_rows)
    labelled = written(labelled, where, "labelled")
    learned = labelled.where(F.shiftrightunsigned("doc", 7).bitwiseAND(F.lit(3)) != 0)
    counts = learned.agg(*[F.count_if(F.col(c) == v) for c, v in (("y", 0), ("y", 1), ("t", 1), ("t", 0))]).first()
    trained = [CoTrained(counts[k + 1] / (counts[k] + counts[k + 1]), per_round) if min(counts[k], counts[k + 1]) else None for k in (0, 2)]
    targets = [k for k, m in enumerate(trained) if m]
    handed: list[DataFrame] = []

    def fit() -> None:
        """Each model in a task of its own; the driver gets their weights."""
        rows = [learned.mapInArrow(partial(_from_labelled, targets=targets), _FITTED_DDL), *handed]
        for r in sorted(reduce(DataFrame.union, rows).groupBy("model").applyInArrow(_fitted, "model int, fitted binary").collect(), key=lambda r: r.model):
            trained[r.model // 2].models[r.model % 2 :] = [pickle.loads(r.fitted)]

    if targets:
        fit()
    used: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    ddl = "g int, sure double, key long, text binary, told binary, meta binary"
    for turn in range(rounds if targets else 0):
        light = spark.sparkContext.broadcast([m and (m.models, m.wanted()) for m in trained])
        best = features.mapInArrow(partial(_surest, trained=light, used=used), ddl)
        place = Window.partitionBy("g").orderBy(F.col("sure").desc(), "key")
        best = best.dropDuplicates(["g", "key"]).withColumn("place", F.row_number().over(place)).where(F.col("place") <= per_round)
        best = written(best, where, f"handed-{turn}")
        told = best.select("g", "place", "key").toArrow().sort_by([("g", "ascending"), ("place", "ascending")])  # eight groups of per_round rows at most
        group, places, keys = (np.asarray(told[c].combine_chunks()) for c in ("g", "place", "key"))
        taken: dict[int, np.ndarray] = {}
        for target in targets:
            for k, good, _, n in trained[target].wanted():
                g = target * 4 + k * 2 + int(good)
                mine = keys[(group == g) & (places <= n)]
                taken[g] = mine[~np.isin(mine, used[target])]
                used[target] = np.concatenate([used[target], taken[g]])
                trained[target].n_handed[1 - k] += len(taken[g])
        handed.append(best.mapInArrow(partial(_from_handed, part=turn + 1, taken=taken), _FITTED_DDL))
        fit()
        light.destroy()
        hand_back()
    if targets:
        raw = labelled.mapInArrow(partial(_logits, models=[m and m.models for m in trained]), "target int, doc long, held boolean, good long, text double, meta double").toArrow()  # bounded by labelled_rows
        raw = raw.sort_by([("target", "ascending"), ("doc", "ascending"), ("text", "ascending")])
        target, held, good, text, meta = (np.asarray(raw[c].combine_chunks()) for c in ("target", "held", "good", "text", "meta"))
        for k in targets:
            use = (target == k) & held if len(set(good[(target == k) & held].tolist())) == 2 else (target == k) & ~held
            trained[k].calibrate(np.column_stack([text[use], meta[use]]), good[use].astype(float))
    remove(spark, where)
    hand_back()
    return Classifier(*trained, vocab) if targets else None


def classify(docs: DataFrame, model: Classifier | None, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", keep_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep_cols of each row of docs, with p_text, p_meta, p_good, p_safe and keep (p_good and p_safe reach their thresholds).

    p_text, p_meta and p_good tell good quality, p_safe that the text is not toxic.

    Null and empty texts are scored as texts of no characters; null metadata are
    values of their own. An empty table gives an empty one; a text of any length is whole,
    in blocks of a megabyte or its own size; a row whose probability ties with the threshold
    is kept; other columns are not used. Without a model all probabilities are 1 and all rows
    kept; likewise for a label that could not be learned. Repeated rows each get their own, equal, result.
    """
    names = [F.col(c).alias(f"c{k}") for k, c in enumerate(keep_cols)]
    back = [F.col(f"c{k}").alias(c) for k, c in enumerate(keep_cols)]
    if model is None:
        return docs.select(*keep_cols, F.lit(1.0).alias("p_text"), F.lit(1.0).alias("p_meta"), F.lit(1.0).alias("p_good"), F.lit(1.0).alias("p_safe"), F.lit(True).alias("keep"))
    base, text = _view(docs, text_col, source_col, lang_col, chars_col, *names), "__text"
    if text_col in keep_cols:  # once is enough
        base, text = base.drop("__text"), f"c{keep_cols.index(text_col)}"
    ddl = StructType([*base.schema.fields[: len(names)], *(StructField(f"__{c}", DoubleType()) for c in ("p_text", "p_meta", "p_good", "p_safe")), StructField("__keep", BooleanType())])
    scored = base.mapInArrow(partial(_apply, model=docs.sparkSession.sparkContext.broadcast(model), text=text), ddl)
    return scored.select(*back, F.col("__p_text").alias("p_text"), F.col("__p_meta").alias("p_meta"), F.col("__p_good").alias("p_good"), F.col("__p_safe").alias("p_safe"), F.col("__keep").alias("keep"))
