"""Small tables of documents, and words as the operators cut them."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as further columns of an input.
CLASHING = ("__id", "__text", "__th", "__l", "id", "m", "n", "a", "b", "k", "rep", "keys", "text2", "component_id", "__p", "__c", "__group", "bin", "lang_pred", "score", "spans", "keep")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows (doc_id, text[, lang[, source]]) as documents."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DDL)


def clashing(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING) if c not in df.columns])


def words(seed: int, n: int, vocabulary: int = 4000) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def awkward(n_long: int = 60_000) -> list[tuple]:
    """Null and empty texts, blanks, null ids and columns, repeated rows, texts beyond ASCII, one very long text."""
    long = " ".join(words(7, n_long))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "lone text without an id"), (None, None),
        (6, "Größe übt Zoë 漢字 \U0001f600 x"), (7, long), (8, long), (9, "a\nb\nc\nd"), (10, "x\ny\na\nb\nc\nz"), (11, "\n\n\n\n"),
        (12, "1234 5678 ... !!!", None, None), (13, "MIT License", "en", None), (14, "cc by cc by", None, "s1"), (15, "\x00 nul \x00"),
    ]
