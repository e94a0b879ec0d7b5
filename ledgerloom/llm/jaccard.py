"""N-gram Jaccard join: T-occurrence search over inverted lists, and its components.

1. Texts with equal shingle sets are one class; its smallest id represents it.
2. Routing. For a band of set sizes, links differ in at most H shingles. Shingles are
   dealt by hash into H + T parts; a part's content is a key. A difference spoils one
   part, so what links shares T keys or more, less the parts that both have empty:
   a T-occurrence problem over lists that are far more telling than a shingle's. No
   frequencies are needed, and lists do not grow with the commonness of shingles. A
   class with fewer keys in lists than it must share links with nothing.
3. A list's leader is the member that most lists know. Each class is searched for
   with the one leader of most of its lists. Links make components; lists inside one
   component are done, whatever their length.
4. In the other lists, DivideSkip sets aside the T - 1 longest of each class: it must
   meet any partner in one of the rest. What still meets is searched in blocks of a
   bounded number of shingles, block against block where a group needs more than one.
5. A search in a block has inverted lists of whole sets. DivideSkip again sets the
   longest aside; the short ones are merged by a heap (or as sorted runs, where they
   are many), and documents that got enough are looked up in the long ones by binary
   search.

No pairs are made but in a block's lists: a class meets one leader, then blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bits import bit_table, filtered, only
from .common import SPACED_LOWER, Words, blocks, clear, cut_words, mixed, parts_for, shared_dir, spread, window_hashes, written
from .components import components

SHINGLE, PERCENT = 4, 85
#: Shingles of a block's side; bytes of text that a task cuts at once.
BLOCK_SHINGLES, TEXT_BYTES = 1 << 20, 2 << 20
BITS = 1 << 25
#: A band's upper size over its lower one; parts beyond those that differences can spoil, as a share of these.
BAND, SPARE = 1.3, 0.25
#: Rows without an id get one from here on; ids lie below.
NAMELESS = 1 << 62
#: Elements of short lists that a heap merges; more are merged as sorted runs.
HEAPED = 512
_MU = 0.01
_PREFIX = 2


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes in order, and the rows' offsets among them."""
    h = words.hashes()
    n = words.counts
    row = words.row_of()
    out, of = [], []
    for k in range(1, size):  # texts of fewer words: the whole sequence is the one shingle
        short = np.flatnonzero(n == k)
        if len(short):
            got = np.full(len(short), k * 0x9E3779B9, np.uint64)
            for j in range(k):
                got = mixed(got ^ h[words.rows[short] + j])
            out.append(got)
            of.append(short)
    if len(h) >= size:
        w = window_hashes(h, size)
        ok = np.flatnonzero(row[: len(w)] == row[size - 1 :])
        out.append(w[ok])
        of.append(row[ok])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    value, at = np.concatenate(out), np.concatenate(of)
    order = np.argsort(value)
    at = at[order].astype(np.uint16 if len(n) < 1 << 16 else np.uint32)
    order = order[np.argsort(at, kind="stable")]
    value, at = value[order], np.concatenate(of)[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (at[1:] != at[:-1])])
    return value[new], np.searchsorted(at[new], np.arange(len(n) + 1))


def _signatures(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(id, size of its set, two signatures of it)."""
    for block in blocks(batches, "__text", TEXT_BYTES):
        h, rows = shingles(cut_words(block.column("__text"), SPACED_LOWER), size)
        sig = []
        for seed in (0, 0x5851F42D4C957F2D):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h ^ np.uint64(seed)), dtype=np.uint64)])
            sig.append(pa.array((sums[rows[1:]] - sums[rows[:-1]]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([block.column("__id"), pa.array(np.diff(rows)), *sig], names=["__id", "n", "s1", "s2"])


def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least size of each band; the most shingles by which links differ if the larger set is of the band; the parts."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(max(least[-1] + 1, int(least[-1] * BAND)))
    differ = np.array([2 * (up - 1) * (100 - percent) // (100 + percent) for up in least[1:]], np.int64)
    parts = np.where(differ > 0, differ + 1 + (differ * SPARE).astype(np.int64), 0)  # sets that do not differ are one class
    return np.array(least[:-1], np.int64), differ, parts


def _postings(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(k, id, p) of each document's keys; p holds the size, how many keys it must share, and the kind of key.

    Kind 0: the parts of the own band; 1: those of the next band, for sets that may
    link into it. Where so many parts are empty that two such sets may share only
    empty ones, the least shingles by hash are keys too (_PREFIX), of which any two
    sets that link share one.
    """
    least, differ, parts = bands(percent)
    for block in blocks(batches, "__text", TEXT_BYTES):
        h, rows = shingles(cut_words(block.column("__text"), SPACED_LOWER), size)
        ids, n = np.asarray(block.column("__id")), np.diff(rows)
        row = np.repeat(np.arange(len(n)), n)
        h = mixed(h)
        high, value = (h >> np.uint64(33)).astype(np.int64), mixed(h ^ np.uint64(0xA0761D6478BD642F))
        own = np.searchsorted(least, n, "right") - 1
        keys, of, need, kinds = [], [], [], []
        poor = np.zeros(len(n), bool)
        for kind in (0, 1):
            band = own + kind
            use = (n > 0) & (parts[band] > 0)
            if kind:
                use &= n * 100 >= least[band] * percent
            count = np.where(use, parts[band], 0)
            begin = np.concatenate([[0], np.cumsum(count)])
            some = np.flatnonzero(use[row])
            part = high[some] * count[row[some]] >> 31
            at = begin[row[some]] + part
            sums = np.zeros(int(begin[-1]), np.uint64)
            np.add.at(sums, at, value[some])
            full = np.flatnonzero(np.bincount(at, minlength=len(sums)))
            r = np.searchsorted(begin, full, "right") - 1
            filled = np.bincount(r, minlength=len(n))
            share = filled - differ[band]  # parts, less empty ones, less those that may be spoilt
            poor |= use & (share < 1)
            keys.append(mixed(sums[full] ^ mixed((full - begin[r]).astype(np.uint64) << np.uint64(8) ^ band[r].astype(np.uint64))))
            of.append(r)
            need.append(np.maximum(share, 1)[r])
            kinds.append(np.full(len(r), kind))
        for r in np.flatnonzero(poor).tolist():
            got = np.sort(value[rows[r] : rows[r + 1]])[: n[r] - -(-percent * n[r] // 100) + 1]
            keys.append(mixed(got))
            of.append(np.full(len(got), r))
            need.append(np.ones(len(got), np.int64))
            kinds.append(np.full(len(got), _PREFIX))
        r = np.concatenate(of)
        p = n[r] << 32 | np.concatenate(need) << 2 | np.concatenate(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(ids[r]), pa.array(p)], names=["k", "id", "p"])


def _sets_of(texts: pa.ChunkedArray, size: int) -> Iterator[np.ndarray]:
    """Each text's set."""
    for block in blocks(iter(pa.table({"__text": texts}).combine_chunks().to_batches()), "__text", TEXT_BYTES):
        h, rows = shingles(cut_words(block.column("__text"), SPACED_LOWER), size)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            yield h[a:b].copy()


class Inverted:
    """Inverted lists of whole sets; a search finds the sets that reach the similarity."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(token, kind="stable")
        self.docs = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        token = token[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        self.tokens, self.begin = token[first], np.append(first, len(token))

    def _merged(self, short: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that are in `least` of the lists or more, and in how many."""
        n = self.begin[short + 1] - self.begin[short]
        if n.sum() <= HEAPED:
            runs = [self.docs[self.begin[i] : self.begin[i + 1]].tolist() for i in short.tolist()]
            counted = [(doc, sum(1 for _ in same)) for doc, same in groupby(heapq.merge(*runs))]
            got = np.array([x for x in counted if x[1] >= least], np.int64).reshape(-1, 2)
            return got[:, 0], got[:, 1]
        skip = np.cumsum(n) - n
        every = np.sort(self.docs[np.repeat(self.begin[short] - skip, n) + np.arange(n.sum())], kind="stable")
        at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        count = np.diff(np.append(at, len(every)))
        some = count >= least
        return every[at[some]].astype(np.int64), count[some]

    def search(self, query: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.tokens, query)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == query)] if len(self.tokens) else at[:0]
        t = -(-self.percent * len(query) // 100)
        if len(at) < t or not len(query):
            return np.zeros(0, np.int64)
        length = self.begin[at + 1] - self.begin[at]
        order = np.argsort(length, kind="stable")
        n_long = min(int(t / (_MU * math.log2(length.max() + 1) + 1)), t - 1, len(at))
        short, long = at[order[: len(at) - n_long]], at[order[len(at) - n_long :]]
        found, overlap = self._merged(short, t - n_long)
        for k, i in enumerate(long.tolist()):
            if not len(found):
                break
            part = self.docs[self.begin[i] : self.begin[i + 1]]
            place = np.minimum(np.searchsorted(part, found), len(part) - 1)
            overlap = overlap + (part[place] == found)
            alive = overlap + (n_long - 1 - k) >= t
            if not alive.all():
                found, overlap = found[alive], overlap[alive]
        return found[100 * overlap >= self.percent * (self.sizes[found] + len(query) - overlap)]


def _search(block: pa.Table, size: int, percent: int) -> pa.Table:
    """(a, b) of the links between the block's queries and its index; one to each other component c is as good as all."""
    sets = [*_sets_of(block.column("text"), size)]
    ids, comps, asks, held = (np.asarray(block.column(c).combine_chunks()) for c in ("id", "c", "asks", "held"))
    index = np.flatnonzero(held)
    lists = Inverted([sets[i] for i in index.tolist()], percent)
    ids_of, comps_of = ids[index], comps[index]
    a, b = [], []
    for q in np.flatnonzero(asks).tolist():
        rows = lists.search(sets[q])
        rows = rows[comps_of[rows] != comps[q]]
        rows = rows[np.unique(comps_of[rows], return_index=True)[1]]
        a += ids_of[rows].tolist()
        b += [int(ids[q])] * len(rows)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _links(routes: DataFrame, base: DataFrame, size: int, percent: int) -> DataFrame:
    """The links (a, b) in the blocks of routes (g, h, id, c, asks, held): each row is a text that asks in block (g, h), or is held in it, or both.

    Texts travel, not sets, which are three times as large; only those in routes do.
    """
    texts = only(base, bit_table(routes.select("id"), BITS), "__id", inside=True).select(F.col("__id").alias("id"), F.col("__text").alias("text"))
    n = routes.select("g", "h").distinct().count()
    return spread(routes.join(texts, "id"), n, "g", "h").groupBy("g", "h").applyInArrow(lambda t: _search(t, size, percent), "a long, b long")


def _hashed(column: str, parts) -> F.Column:
    return F.pmod(F.xxhash64(column), parts)


def _leader_routes(asked: DataFrame, where: str) -> DataFrame:
    """Blocks for (leader, id, n): a leader asks in blocks of those that it leads; small ones share blocks."""
    led = asked.groupBy("leader").agg(F.sum("n").alias("all"))
    total = led.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
    bins = F.lit(parts_for(2 * total, BLOCK_SHINGLES))
    led = led.select("leader", F.when(F.col("all") * 2 > BLOCK_SHINGLES, F.col("leader")).otherwise(-1 - _hashed("leader", bins)).alias("g"), F.when(F.col("all") * 2 > BLOCK_SHINGLES, F.ceil(F.col("all") / BLOCK_SHINGLES)).otherwise(1).alias("parts"))
    held = written(asked.join(led, "leader").select("g", _hashed("id", F.col("parts")).alias("h"), "leader", "id"), where, "led")
    yes, no = F.lit(True), F.lit(False)
    return held.select("g", "h", "id", F.col("id").alias("c"), no.alias("asks"), yes.alias("held")).union(held.select("g", "h", "leader", "leader", yes, no).distinct())


def _group_routes(rows: DataFrame, where: str) -> DataFrame:
    """Blocks for (id, n, c, group): all of a group that are of different components c meet in one.

    Small groups share blocks. A large one is cut: those outside its largest
    component ask among themselves and in the parts of that component.
    """
    by_comp = written(rows.groupBy("group", "c").agg(F.sum("n").alias("all")), where, "by-component")
    groups = by_comp.groupBy("group").agg(F.sum("all").alias("all"), F.max(F.struct("all", "c")).alias("major"))
    total = groups.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
    bins = F.lit(parts_for(2 * total, BLOCK_SHINGLES))
    large = F.col("all") * 2 > BLOCK_SHINGLES
    parts = lambda c: F.when(large, F.ceil(c / BLOCK_SHINGLES)).otherwise(F.lit(0))
    groups = groups.select("group", F.when(large, F.col("group")).otherwise(-1 - _hashed("group", bins)).alias("g"), F.when(large, F.col("major.c")).alias("major"),
                           F.greatest(F.lit(1), parts(F.col("all") - F.col("major.all"))).alias("minors"), parts(F.col("major.all")).alias("majors"))
    own = rows.join(groups, "group").withColumn("is_major", F.coalesce(F.col("c") == F.col("major"), F.lit(False)))
    own = own.withColumn("at", F.when(F.col("is_major"), F.col("minors") + _hashed("id", F.col("majors"))).otherwise(_hashed("id", F.col("minors"))))
    last = F.when(F.col("is_major"), F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1
    met = own.select("g", "id", "c", "at", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("other"))
    first, second = F.least("at", "other"), F.greatest("at", "other")
    return met.select("g", (first * (1 << 31) + second).alias("h"), "id", "c", (first == F.col("at")).alias("asks"), (second == F.col("at")).alias("held"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """For each row of docs: id (an integer), n_shingles, component_id.

    A text's set holds its distinct runs of `size` words (words between blanks,
    A-Z lower-cased); a text of fewer words has its whole sequence, one without
    words or a null text nothing, and it links with nothing. Two rows link where
    100 * intersection >= percent * union; component_id is the smallest id that
    links reach, the own one included. Ties cannot occur: nothing is ranked. Rows
    that repeat an id count as linked. A null id is reached and reaches like any
    other, but names no component; where links reach no id, the component is null.
    Ids are below 2^62. Very long texts are sets like any other. An empty table
    gives an empty result; other columns are not used, whatever their names.
    """
    spark = docs.sparkSession
    where = shared_dir(spark)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    nameless = F.xxhash64(F.col(text_col)).bitwiseAND(NAMELESS - 1) + NAMELESS
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), nameless).alias("__id"), F.col(text_col).alias("__text"))

    # Classes of equal sets.
    rows = written(base.mapInArrow(partial(_signatures, size=size), "__id long, n long, s1 long, s2 long"), where, "signatures")
    same = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("__id").alias("rep"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    rows = written(rows.join(same, ["s1", "s2", "n"], "left").select("__id", "n", F.coalesce("rep", "__id").alias("rep")), where, "rows")
    others = bit_table(rows.where("rep <> __id").select("__id"), BITS)
    maybe = only(base, others, "__id", inside=True).join(rows.where("rep = __id").select("__id"), "__id", "left_semi")

    # Lists of two or more, and of them those of classes that are in enough lists.
    ddl = "k long, id long, p long"
    post = base.mapInArrow(lambda batches: _postings(filtered(batches, others, "__id", inside=False), size, percent), ddl)
    post = post.union(maybe.mapInArrow(partial(_postings, size=size, percent=percent), ddl))
    post = post.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("k"))).where("m > 1")
    post = written(post.select("k", "id", F.shiftright("p", 32).alias("n"), (F.shiftright("p", 2).bitwiseAND((1 << 30) - 1)).alias("t"), F.col("p").bitwiseAND(3).alias("kind")), where, "lists")
    enough = post.groupBy("id", "kind").agg(F.count(F.lit(1)).alias("known"), F.min("t").alias("t")).where("known >= t")
    live = written(post.drop("t").join(enough, ["id", "kind"]), where, "live")

    lead = live.groupBy("k").agg(F.max(F.struct("known", (-F.col("id")).alias("less"))).alias("top"), F.count(F.lit(1)).alias("m")).where("m > 1")
    asked = live.join(lead.select("k", (-F.col("top.less")).alias("leader")), "k").where("id <> leader")
    asked = asked.groupBy("id", "leader").agg(F.count(F.lit(1)).alias("lists"), F.max("n").alias("n"))
    asked = asked.groupBy("id").agg(F.max(F.struct("lists", (-F.col("leader")).alias("less"), "n")).alias("top"))
    asked = written(asked.select((-F.col("top.less")).alias("leader"), "id", "top.n"), where, "asked")
    edges = written(_links(written(_leader_routes(asked, where), where, "routes-1"), base, size, percent), where, "links-1")
    comp = written(components(edges, f"{where}/cc-1"), where, "comp-1")

    # Lists that still have several components.
    post = live.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    post = written(post, where, "live-2")
    several = post.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi")
    own = Window.partitionBy("id", "kind")
    opened = post.join(several.select("k", "m"), "k").withColumn("open", F.count(F.lit(1)).over(own)).withColumn("place", F.row_number().over(own.orderBy("m", "k")))
    opened = written(opened.where("place <= open - t + 1").select("k", "id", "n", "c"), where, "open")
    several = opened.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("id").alias("least")).where("lo <> hi")
    opened = written(opened.join(several.select("k", "least"), "k").groupBy("id", "n", "c", "least").agg(F.count(F.lit(1)).alias("lists")), where, "meet")
    groups = components(opened.select(F.col("id").alias("a"), F.col("least").alias("b")), f"{where}/cc-meet")
    members = opened.select("id", "n", "c").distinct().join(groups.select(F.col("node").alias("id"), F.col("component").alias("group")), "id")
    routes = written(_group_routes(written(members, where, "members"), where), where, "routes-2")
    edges = edges.union(written(_links(routes, base, size, percent), where, "links-2"))

    # Rows that share an id: their classes are linked.
    again = rows.groupBy("__id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    again = rows.join(again.select("__id"), "__id").select(F.col("__id").alias("a"), F.col("rep").alias("b"))
    comp = components(edges.union(again), f"{where}/cc-2")
    clear(spark, where, keep=("rows", "links-1", "links-2", "cc-2"))
    out = rows.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = lambda c: F.when(F.col(c) < NAMELESS, F.col(c)).cast(kind)
    return out.select(named("__id").alias(id_col), F.col("n").alias("n_shingles"), named("component").alias("component_id"))
