"""Best-fit packing with conflicts.

Documents become pieces of at most `capacity` words. Pieces are dealt by a hash of
their id into groups of about `group_rows` (so no group follows the table, a source
or a cluster), and each group is packed on its own, larger pieces first. Bins are
ordered by residual; each carries a bitmap of its sources and one of its duplicate
clusters. A piece starts at the tightest bin that holds it and goes on to the next
larger residual until source and cluster both are new to the bin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, blocks, cut_words, parts_for

CAPACITY, GROUP_ROWS = 2048, 20_000


class Bins:
    """Open bins in the order of their residual.

    residuals 0..capacity are the leaves of a tree; a node knows which sources
    all of its bins share, so the successor search passes over residuals where
    every bin has the piece's source already.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        self.shared = [-1] * (2 * self.leaves)  # -1: no bins, all bits set
        self.at: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _update(self, r: int) -> None:
        bits = -1
        for b in self.at[r]:
            bits &= self.sources[b]
            if not bits:
                break
        k = self.leaves + r
        self.shared[k] = bits
        while k > 1:
            k >>= 1
            bits = self.shared[2 * k] & self.shared[2 * k + 1]
            if self.shared[k] == bits:
                break
            self.shared[k] = bits

    def _next(self, least: int, source: int) -> int | None:
        """The smallest residual from `least` on that has a bin without this source."""
        k = self.leaves + least
        while self.shared[k] & source:
            while k & 1:
                k >>= 1
                if k == 0:
                    return None
            if k <= 1:
                return None
            k += 1
        while k < self.leaves:
            k *= 2
            if self.shared[k] & source:
                k += 1
        return k - self.leaves

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin that the piece goes to, and where in it the piece begins."""
        r = self._next(size, source) if size <= self.capacity else None
        while r is not None:
            for b in self.at[r]:
                if not self.sources[b] & source and not self.clusters[b] & cluster:
                    del self.at[r][b]
                    self.sources[b] |= source
                    self.clusters[b] |= cluster
                    self.at[r - size][b] = None
                    self._update(r)
                    self._update(r - size)
                    return b, self.capacity - r
            r = self._next(r + 1, source) if r < self.capacity else None
        b = len(self.sources)
        self.sources.append(source)
        self.clusters.append(cluster)
        self.at[self.capacity - size][b] = None
        self._update(self.capacity - size)
        return b, 0


def pack(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """bin and bin_start for each piece (key, piece, n_tokens, source, cluster), in the order of size, then key, then piece."""
    pieces = pieces.sort_values(["n_tokens", "__key", "piece", "__dup"], ascending=[False, True, True, True], kind="stable")
    source = pieces["__source"].fillna("").astype(str)
    source = pd.factorize(source.where(pieces["__source"].notna(), "\0null"), sort=True)[0]
    cluster, sizes = pd.factorize(pieces["__cluster"], sort=True)
    twice = np.bincount(cluster[cluster >= 0], minlength=len(sizes)) > 1
    bit = np.cumsum(twice) - 1
    bins = Bins(capacity)
    got = [bins.put(n, 1 << s, (1 << int(bit[c])) if c >= 0 and twice[c] else 0) for n, s, c in zip(pieces["n_tokens"].tolist(), source.tolist(), cluster.tolist(), strict=True)]
    return pieces.assign(bin=[b for b, _ in got], bin_start=[s for _, s in got])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "__text"):
        n = cut_words(block.column("__text"), SPACED).counts
        yield pa.RecordBatch.from_arrays([*(block.column(c) for c in ("__id", "__source", "__cluster", "__th")), pa.array(n)], names=["__id", "__source", "__cluster", "__th", "n"])


def _pack(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    return pack(group, capacity)[["__id", "__source", "__cluster", "piece", "start", "n_tokens", "__group", "bin", "bin_start"]]


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """A row for each piece: id, source, cluster, piece, start, n_tokens, bin_id, bin_start.

    Tokens are the words between blanks. A text of more than `capacity` words is
    cut; its full pieces fill a bin each. No two pieces of a bin share a source
    (null counts as one) or a cluster (null shares nothing). cluster_col names the
    duplicate cluster; without it, texts that are equal but for case and blanks
    are one. Null and empty texts are one piece of 0 words, so that no row is
    lost. Rows that repeat are packed each, as members of one cluster. Ties: by
    size, then by a hash of the id, then by piece; among bins, the tightest, of
    those the one that got this residual first. An empty table has no bins; a text of
    any length is as many pieces as it needs, dealt over the groups by 64; other columns
    are not used. The result depends on the rows
    and not on their partitions.
    """
    text = F.col(text_col)
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.when(F.trim(text) != "", F.sha2(F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))), 256))
    base = docs.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__source"), cluster.alias("__cluster"), F.xxhash64(text).alias("__th"), text.alias("__text"))
    kind = dict(base.dtypes)["__id"]
    counted = base.mapInArrow(_count, f"__id {kind}, __source string, __cluster string, __th long, n long")
    pieces = counted.select("*", F.explode(F.expr(f"sequence(0L, greatest(n - 1, 0L) div {capacity}L)")).alias("piece"))
    pieces = pieces.select("__id", "__source", "__cluster", F.xxhash64("__id", "__th").alias("__key"), "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("n_tokens"))
    groups = parts_for(docs.count(), group_rows)
    # Rows of one id are spread by piece, so that one endless text does not fill a group.
    pieces = pieces.withColumn("__group", F.pmod(F.xxhash64("__key", F.floor(F.col("piece") / 64)), F.lit(groups))).withColumn("__dup", F.lit(0))
    packed = pieces.groupBy("__group").applyInPandas(lambda group: _pack(group, capacity), f"__id {kind}, __source string, __cluster string, piece long, start long, n_tokens long, __group long, bin long, bin_start long")
    return packed.select(F.col("__id").alias(id_col), F.col("__source").alias("source"), F.col("__cluster").alias("cluster"), "piece", "start", "n_tokens", F.concat_ws("-", "__group", "bin").alias("bin_id"), "bin_start")
