"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names; and the same result from other partitions."""

from __future__ import annotations

from collections import Counter

import pytest
from making import DDL, awkward, clashing, table
from pyspark.sql import functions as F

from ledgerloom.llm import language, lm, quality
from ledgerloom.llm.decontaminate import contamination, decontaminate
from ledgerloom.llm.exact_dedup import exact_dedup
from ledgerloom.llm.hamming import exact_top_k
from ledgerloom.llm.jaccard import jaccard_groups
from ledgerloom.llm.licenses import license_scan
from ledgerloom.llm.line_dedup import line_dedup
from ledgerloom.llm.packing import best_fit_packing
from ledgerloom.llm.ranked import ranked_search
from ledgerloom.llm.substring_dedup import substring_dedup

ITEMS = [(1, "one two three"), (1, "cc by cc"), (2, None), (3, "")]


def _benchmark(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def _labels(spark):
    return spark.createDataFrame([(k, k % 2) for k in range(1, 16)] + [(5, None), (999, 1), (None, 0)], "doc_id long, quality int")


OPERATORS = {
    "lines": lambda s, d: line_dedup(d),
    "licenses": lambda s, d: license_scan(d),
    "substrings": lambda s, d: substring_dedup(d),
    "language": lambda s, d: language.identify(d, language.train(d), calibration=language.calibration_rows(d)),
    "packing": lambda s, d: best_fit_packing(d),
    "jaccard": lambda s, d: jaccard_groups(d),
    "contamination": lambda s, d: contamination(d, _benchmark(s)),
    "clean": lambda s, d: decontaminate(d.select(*DDL.replace(",", "").split()[::2]), _benchmark(s)),
    "cut beside clashing columns": lambda s, d: decontaminate(d, _benchmark(s)).select("doc_id", "text"),
    "exact": lambda s, d: exact_dedup(d),
    "ranked": lambda s, d: ranked_search(d, _benchmark(s, [(1, "one"), (1, "cc by cc"), (2, None), (3, "w1 w2 W3 Zoë")])),
    "lm": lambda s, d: lm.score(d, lm.train(d)),
    "quality": lambda s, d: quality.classify(d, quality.train(d, _labels(s), labelled_rows=100)),
}
#: A row for each input row (packing has a row for each piece, ranked some for each item).
EACH = set(OPERATORS) - {"packing", "ranked"}


def _rows(df):
    plain = lambda v: round(v, 6) if isinstance(v, float) else str(v) if isinstance(v, list) else bytes(v) if isinstance(v, bytearray) else v
    return Counter(tuple(plain(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward(name, spark):
    docs = table(spark, awkward())
    first = _rows(OPERATORS[name](spark, docs.coalesce(1)))
    again = _rows(OPERATORS[name](spark, clashing(docs.repartition(5, F.col("text")))))
    assert first == again
    if name in EACH:
        assert sum(first.values()) == len(awkward())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, spark):
    assert not _rows(OPERATORS[name](spark, spark.createDataFrame([], DDL)))


@pytest.mark.parametrize("name", OPERATORS)
def test_nothing_but_nulls(name, spark):
    rows = [(None, None, None, None)] * 3
    got = _rows(OPERATORS[name](spark, table(spark, rows)))
    assert sum(got.values()) == (0 if name == "ranked" else 3)


def test_line_dedup_results(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb\nc"), (4, "a\nb"), (5, "r\nr\nr\nr\nr")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup(table(spark, rows)).collect()}
    assert got == {1: (4, 0, "a\nb\nc\nd"), 2: (6, 4, "x\ny"), 3: (3, 3, ""), 4: (2, 0, "a\nb"), 5: (5, 4, "r")}


def test_decontaminate_cuts_until_clean(spark):
    item = " ".join(f"q{k}" for k in range(10))
    nested = "start " + " ".join(f"q{k}" for k in range(5)) + " " + item + " " + " ".join(f"q{k}" for k in range(5, 10)) + " end"
    docs = table(spark, [(1, nested), (2, f"A, {item.upper()}! B"), (3, "clean  text\n stays"), (4, None)])
    bench = _benchmark(spark, [(1, item)])
    got = {r.doc_id: r.text for r in decontaminate(docs, bench).collect()}
    assert got[1].split() == ["start", "end"]
    assert got[2] == "A, ! B" and got[3] == "clean  text\n stays" and got[4] is None
    assert not contamination(decontaminate(docs, bench), bench).where(F.size("spans") > 0).count()


def test_contamination_without_benchmark(spark):
    got = contamination(table(spark, awkward()), _benchmark(spark, [(1, None)])).collect()
    assert len(got) == len(awkward()) and not any(r.spans or r["items"] for r in got)


def test_top_k_ties_and_few_rows(spark):
    v = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = [1.0] * 20
    rows = v([(k, one) for k in range(40)] + [(100, None), (101, []), (102, [1.0] * 21), (None, one), (3, one)])
    got = exact_top_k(clashing(rows), rows.where("vec_id in (0, 3, 100, 101, 102)"), k=5).collect()
    assert sorted((r.vec_id, r["rank"], r.neighbor_id, r.distance) for r in got) == sorted([(0, k, k, 0) for k in range(1, 6)] + [(3, k + 1, n, 0) for k, n in enumerate((0, 1, 2, 4, 5))])
    assert not exact_top_k(v([]), v([])).count()


def test_top_k_of_nothing_but_nulls(spark):
    rows = spark.createDataFrame([(None, None), (1, None), (None, [1.0])], "vec_id long, embedding array<double>")
    assert not exact_top_k(clashing(rows), rows).count()


def test_top_k_in_blocks(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = rows.where("vec_id % 5 = 0")
    assert _rows(exact_top_k(rows, asked)) == _rows(exact_top_k(rows.repartition(7), asked, index_rows=50, query_rows=20))
