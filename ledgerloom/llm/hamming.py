"""Exact top-k by Hamming distance over sign codes, with multi-index hashing.

Codes are cut into segments of 16 bits. A block of codes is indexed by each
segment's value; a query looks up the values within radius 0, 1, 2, ... of its own
in every segment, verifies what it finds, and stops once its k-th distance cannot
be bettered: after radius r in all m segments every code within m(r + 1) - 1 has
been seen. Equal codes are indexed once, with their k + 1 smallest ids (no answer
can need more), which two grouped steps with a salt collect.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, spread

K, SEGMENT = 10, 16
#: Rows of a block of the index and of queries, at most; queries that are worth a block.
INDEX_ROWS, QUERY_ROWS, FEW_QUERIES = 200_000, 20_000, 50


@lru_cache
def flips(radius: int) -> np.ndarray:
    """The 16-bit masks with just `radius` bits set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(SEGMENT), radius)], np.uint16)


class MultiIndex:
    def __init__(self, codes: np.ndarray):
        """codes: (n, m) uint16, a row a code."""
        self.codes = codes
        self.m = codes.shape[1]
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(self.m)]
        self.begin = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, s], minlength=1 << SEGMENT))]) for s in range(self.m)]

    def top(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of all codes up to the k-th smallest distance."""
        seen = np.zeros(0, np.int64)
        for radius in range(SEGMENT + 1):
            new = []
            for s in range(self.m):
                values = flips(radius) ^ code[s]
                lo, n = self.begin[s][values], self.begin[s][values.astype(np.int64) + 1] - self.begin[s][values]
                skip = np.concatenate([[0], np.cumsum(n)[:-1]])
                new.append(self.order[s][np.repeat(lo - skip, n) + np.arange(n.sum())])
            seen = np.unique(np.concatenate([seen, *new]))
            d = np.bitwise_count(self.codes[seen] ^ code).sum(1, dtype=np.int64)
            if len(d) >= k and (kth := np.partition(d, k - 1)[k - 1]) <= self.m * (radius + 1) - 1:
                return seen[d <= kth], d[d <= kth]
        return seen, d


def _codes(column: pd.Series) -> np.ndarray:
    """The codes' segments, without the size in front."""
    return np.frombuffer(b"".join(x[4:] for x in column), ">u2").reshape(len(column), -1).astype(np.uint16)


def _search(queries: pd.DataFrame, index: pd.DataFrame, k: int) -> pd.DataFrame:
    """The block's nearest k + 1 (distance, id) of each query code."""
    out: list[tuple] = []
    head, heads = queries["__code"].map(lambda x: x[:4]), index["__code"].map(lambda x: x[:4])
    for size, some in queries.groupby(head):
        part = index[heads == size]
        if len(part):
            mi, ids = MultiIndex(_codes(part["__code"])), part["__ids"].to_list()
            codes = _codes(some["__code"])
            for raw, code in zip(some["__code"], codes, strict=True):
                rows, d = mi.top(code, k + 1)
                near = sorted((dist, i) for r, dist in zip(rows.tolist(), d.tolist(), strict=True) for i in ids[r])
                out += [(raw, i, dist) for dist, i in near[: k + 1]]
    return pd.DataFrame(out, columns=["__code", "__nid", "distance"])


def sign_code(vector: Column) -> Column:
    """The vector's size in four bytes, and a bit for each value over 0, padded with zeros to whole segments."""
    bits = F.array_join(F.transform(vector, lambda x: F.when(x > 0, F.lit("1")).otherwise("0")), "")
    wide = F.rpad(bits, (F.ceil(F.size(vector) / SEGMENT) * SEGMENT).cast("int"), "0")
    parts = F.regexp_extract_all(wide, F.lit(f"[01]{{{SEGMENT}}}"), F.lit(0))
    return F.unhex(F.concat(F.lpad(F.hex(F.size(vector)), 8, "0"), F.array_join(F.transform(parts, lambda p: F.lpad(F.conv(p, 2, 16), SEGMENT // 4, "0")), "")))


def exact_top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """A row (id, rank, neighbor_id, distance) for each of the k nearest rows of each query.

    Distances are Hamming distances between sign codes (a value over 0 gives 1, as
    does NaN, which is over all numbers; null, zero and negative values give 0). Ties go to the smaller id. A
    query's own id is no neighbour of it. Null or empty vectors have no code:
    they find nothing and are not found. Only vectors of equal length are compared.
    Rows that repeat an id with the same vector count once. With fewer than k
    other rows, there are fewer neighbours; empty tables find none and give none.
    Vectors of any length are codes of as many segments. Other columns are not used.
    A task holds one block of the index and one of queries: 200,000 codes and their k + 1 ids,
    and for each segment an order of these and a table of 65,536 values.

    Queries and distinct codes meet in blocks of bounded size, of which each pair
    is a group of its own; there are at least as many blocks of queries as keep the
    cluster busy, and an index block goes to each of them.
    """
    coded = lambda df: df.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__v")).where("__id is not null and size(__v) > 0").select("__id", sign_code(F.col("__v")).alias("__code"))
    rows, asked = coded(vectors), coded(queries).distinct()
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(64)))
    few = Window.partitionBy("__code", "__salt").orderBy("__id")
    few = salted.distinct().withColumn("__n", F.row_number().over(few)).where(F.col("__n") <= k + 1)
    index = few.groupBy("__code").agg(F.slice(F.array_sort(F.collect_list("__id")), 1, k + 1).alias("__ids"))
    n_rows, n_asked = vectors.count(), queries.count()
    busy = min(2 * vectors.sparkSession.sparkContext.defaultParallelism, parts_for(n_asked, FEW_QUERIES))
    n_i, n_q = parts_for(n_rows, index_rows), max(parts_for(n_asked, query_rows), busy)
    kind = dict(rows.dtypes)["__id"]
    index = index.withColumn("__ib", F.pmod(F.xxhash64("__code"), F.lit(n_i))).withColumn("__qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))
    probes = asked.select("__code").distinct().withColumn("__qb", F.pmod(F.xxhash64("__code"), F.lit(n_q))).withColumn("__ib", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_i - 1).cast("long"))))
    probes, index = (spread(x, n_q * n_i, "__qb", "__ib") for x in (probes, index))
    found = probes.groupBy("__qb", "__ib").cogroup(index.groupBy("__qb", "__ib")).applyInPandas(lambda q, i: _search(q, i, k), f"__code binary, __nid {kind}, distance long")
    near = found.groupBy("__code").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "__nid"))), 1, k + 1).alias("__near"))
    own = asked.join(near, "__code").select("__id", F.slice(F.filter("__near", lambda x: x["__nid"] != F.col("__id")), 1, k).alias("__near"))
    return own.select("__id", F.posexplode("__near").alias("__p", "__x")).select(F.col("__id").alias(id_col), (F.col("__p") + 1).cast("long").alias("rank"), F.col("__x")["__nid"].alias("neighbor_id"), F.col("__x")["distance"].alias("distance"))
