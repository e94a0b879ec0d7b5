"""The corpus pipeline: five stages from documents to packed training sequences.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents.

Edges, the same in every stage: null and empty texts pass (see the operators), a null
id is a document of its own, texts of any length are whole, rows that repeat are
kept each but for near_duplicates (rows of one id are one document there, of which
one row stays), an empty table gives an empty one, and further columns come through
unchanged, whatever their names: inside, columns go by number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import quality
from ledgerloom.llm.bits import bit_table, only
from ledgerloom.llm.common import remove, shared_dir, small_batches, written
from ledgerloom.llm.decontaminate import decontaminate
from ledgerloom.llm.jaccard import jaccard_groups
from ledgerloom.llm.line_dedup import line_dedup
from ledgerloom.llm.packing import best_fit_packing

#: Words of a shingle, and the least similarity in per cent, of near duplicates.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80
SUSPECT_BITS = 1 << 23


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., which clash with nothing, and the new name of each."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _with_length(docs: DataFrame) -> DataFrame:
    """docs with n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the co-trained classifier rejects."""
    small_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, c = _numbered(docs)
    scored = quality.classify(rows, model, text_col=c["text"], source_col=c["source"], lang_col=c["lang"], chars_col=c["n_chars"], keep_cols=tuple(rows.columns))
    return scored.where("keep").select(*rows.columns).toDF(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines of repeated three-line windows after their first place; documents stay, if empty."""
    rows, c = _numbered(docs)
    rest = tuple(x for x in rows.columns if x not in (c["doc_id"], c["text"]))
    return _with_length(line_dedup(rows, id_col=c["doc_id"], text_col=c["text"], keep=rest).select(*rows.columns).toDF(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones, that of the smallest id; null ids stay."""
    small_batches(spark)
    where = shared_dir(spark)
    rows, c = _numbered(docs)
    key = c["doc_id"]
    groups = written(jaccard_groups(docs, size=NEAR_SHINGLE, percent=NEAR_PERCENT).where("doc_id is not null"), where, "groups")
    per_id = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("component"))
    doubtful = written(per_id.where("n > 1 or doc_id <> component").withColumnRenamed("doc_id", key), where, "doubtful")
    bits = bit_table(doubtful.select(F.col(key).cast("long")), SUSPECT_BITS)
    # Only documents whose bit is set can be doubtful; the others need no shuffle.
    some = only(rows, bits, key, inside=True).join(doubtful, key, "left").where(F.col("component").isNull() | (F.col("component") == F.col(key)))
    once = some.where("n is null or n = 1").select(*rows.columns)
    twice = some.where("n > 1").dropDuplicates([key]).select(*rows.columns)
    return only(rows, bits, key, inside=False).union(once).union(twice).toDF(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the benchmark's passages out of the texts."""
    small_batches(spark)
    rows, c = _numbered(docs)
    return _with_length(decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text_col=c["text"]).toDF(*docs.columns))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of training sequences: one row for each piece of a document."""
    small_batches(spark)
    return best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_filter", quality_filter),
    ("repeated_lines", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("packed_sequences", packed_sequences),
]

#: Logistic regression, near-duplicate components and packing are not SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), where, f"{k}-{name}")
        if k:
            remove(spark, f"{where}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
