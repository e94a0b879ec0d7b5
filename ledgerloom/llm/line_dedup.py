"""Line dedup: repeated windows of three consecutive lines.

DataFrame functions only. A window is hashed to 128 bits; the hashes are grouped
with map-side combine to the first place of each repeated window, and joined back
on the hash, where a window that very many documents share is an AQE skew split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def line_windows(docs: DataFrame, size: int) -> DataFrame:
    """A row (__id, __th, __pos, __h1, __h2) for each window of `size` lines."""
    n = F.size("__l") - (size - 1)
    cut = docs.select("__id", "__th", F.split("__text", "\n", -1).alias("__l")).where(F.size("__l") >= size)
    zipped = F.arrays_zip(*[F.slice("__l", k + 1, n).alias(f"l{k}") for k in range(size)])
    rows = cut.select("__id", "__th", F.posexplode(zipped).alias("__pos", "__w"))
    lines = [F.col("__w").getField(f"l{k}") for k in range(size)]
    return rows.select("__id", "__th", "__pos", F.xxhash64(*lines).alias("__h1"), F.xxhash64(F.lit(size), *lines).alias("__h2"))


def _flags(covered: Column, n: Column) -> Column:
    """'1' for each covered position and '0' for the others, from sorted distinct positions."""
    before = F.concat(F.array(F.lit(-1)), F.slice(covered, 1, F.size(covered) - 1))
    runs = F.zip_with(before, covered, lambda p, q: F.concat(F.repeat(F.lit("0"), q - p - 1), F.lit("1")))
    return F.rpad(F.array_join(runs, ""), n, "0")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove every line covered by a later occurrence of a repeated window.

    Lines are the parts between newlines, compared as they are, blank ones too.
    Places are ordered by (id, position); of a window's places the first stays and
    all lines of the others go, windows that overlap being merged. Texts of fewer
    than `size` lines stay whole. The result has one row for each row of docs:
    id, n_lines long, n_removed long, text (the kept lines, joined by newlines),
    and the columns named in keep, as they are.

    Null text: no lines, text null. Empty text: one empty line. A null id is an id
    that comes first. Rows that repeat an id with the same text count as one
    document and all get its result; rows that repeat an id with other texts are
    ordered by a hash of the text. An empty table gives an empty result; a text of any
    length is cut into lines in its row, and only hashes of windows are shuffled. Other columns of docs are not used, and those
    in keep not looked at; whatever their names, they cannot clash with inner ones.
    """
    more = F.struct(*[F.col(c).alias(f"k{k}") for k, c in enumerate(keep)]) if keep else F.lit(0)
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__th"), more.alias("__more"))
    windows = line_windows(base, size)
    place = F.struct("__id", "__th", "__pos")
    first = windows.groupBy("__h1", "__h2").agg(F.min(place).alias("__first"), F.max(place).alias("__last")).where("__first < __last")
    later = windows.join(first.drop("__last"), ["__h1", "__h2"]).where(F.struct("__id", "__th", "__pos") > F.col("__first"))
    covered = later.groupBy("__id", "__th").agg(F.collect_set("__pos").alias("__p"))
    spans = F.flatten(F.transform("__p", lambda p: F.sequence(p, p + (size - 1))))
    covered = covered.select(F.col("__id").alias("__cid"), F.col("__th").alias("__cth"), F.sort_array(F.array_distinct(spans)).alias("__c"))
    both = base.join(covered, F.col("__id").eqNullSafe(F.col("__cid")) & (F.col("__th") == F.col("__cth")), "left")
    lines = F.split("__text", "\n", -1)
    kept = F.zip_with(lines, F.split(_flags(F.col("__c"), F.size(lines)), ""), lambda x, f: F.when(f == "0", x))
    return both.select(
        F.col("__id").alias(id_col),
        F.when(F.col("__text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("__c").isNull(), 0).otherwise(F.size("__c")).cast("long").alias("n_removed"),
        F.when(F.col("__c").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n")).alias(text_col),
        *[F.col("__more").getField(f"k{k}").alias(c) for k, c in enumerate(keep)],
    )
