"""The pipeline's stages, each on what its predecessor kept, against plain Python."""

from __future__ import annotations

from collections import defaultdict

import pytest
from making import ALNUM, LOWER, SPACED
from pyspark.sql import functions as F
from test_brute import _components

import corpus_pipeline
from making import awkward, clashing, table


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The rows after each stage; index 0 holds the documents."""
    where = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
        out.append(docs)
    return out


def test_columns(stages):
    assert all(s.dtypes == stages[0].dtypes for s in stages[:-1])
    assert all(r.n_chars == len(r.text) for s in stages[2:-1] for r in s.collect() if r.text is not None)


def test_quality_keeps_clean_documents(spark, sf_dir, stages):
    kept = {r.doc_id: r.text for r in stages[1].collect()}
    before = {r.doc_id: r.text for r in stages[0].collect()}
    assert all(before[k] == t for k, t in kept.items()) and len(kept) < len(before)
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").collect()}  # toxic rows are to go
    assert len(good & set(kept)) >= 0.98 * len(good)


def _lines(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def test_lines(stages):
    assert {r.doc_id: r.text for r in stages[2].collect()} == _lines([(r.doc_id, r.text) for r in stages[1].collect()])


def test_near_duplicates(stages):
    rows = {r.doc_id: r.text for r in stages[2].collect()}
    want = {c for _, _, c in _components(list(rows.items()), 5, 80)}
    assert {r.doc_id: r.text for r in stages[3].collect()} == {k: rows[k] for k in want}


def test_benchmark(spark, sf_dir, stages):
    cut = lambda t: ALNUM.findall((t or "").translate(LOWER))
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = cut(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    hit = lambda t: any(tuple(w[i : i + 10]) in windows for w in [cut(t)] for i in range(len(w) - 9))
    before, after = ({r.doc_id: r.text for r in stages[k].collect()} for k in (3, 4))
    assert set(before) == set(after) and any(map(hit, before.values()))
    assert not any(map(hit, after.values()))
    assert all(after[k] == t for k, t in before.items() if not hit(t))


def test_packing(stages):
    n = {r.doc_id: len(SPACED.findall(r.text or "")) for r in stages[4].collect()}
    got = defaultdict(int)
    for r in stages[5].collect():
        got[r.doc_id] += r.n_tokens
    assert dict(got) == n


def test_run(spark, sf_dir, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, stages[5].collect()))


MORE = ("p_good", "Keep", "n_lines", "n_removed", "__n", "__more", "component", "c0", "odd name")


@pytest.mark.parametrize("k", range(5))
def test_stage_edges(spark, sf_dir, k):
    """Nulls, empties, repeats, a text longer than a block, other columns with names used inside; and no rows at all."""
    name, stage = corpus_pipeline.STAGES[k]
    rows = awkward(1500) + [(20, "long " * 900_000)]
    docs = clashing(table(spark, rows)).select("*", *[F.col("doc_id").alias(c) for c in MORE])
    got = stage(spark, docs, sf_dir)
    out = got.collect()
    if name == "packed_sequences":
        assert {r.doc_id for r in out} == {r[0] for r in rows} and sum(r.n_tokens for r in out if r.doc_id == 20) == 900_000
    else:
        assert got.columns == docs.columns
        assert all(r[c] == r.doc_id for r in out for c in MORE)
        if name in ("repeated_lines", "benchmark_passages"):
            assert len(out) == len(rows)
        if name == "near_duplicates":  # 8 is as 7; 5 is as 4; of rows that repeat an id one stays
            assert sorted(r.doc_id for r in out if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 9, 10, 11, 12, 13, 14, 15, 20]
            assert sum(r.doc_id is None for r in out) == 2
    assert not stage(spark, docs.where("false"), sf_dir).count()
