"""Queries that SQL can express, on the small tables and on awkward rows."""

from __future__ import annotations

import duckdb
import pytest
from comparing import differences, duck_rows, rows_of

import __spark_entry__ as entry
from ledgerloom.llm import queries
from ledgerloom.llm.decontaminate import contamination
from ledgerloom.llm.oracles import ORACLES
from making import awkward, clashing, table, words


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, sf_dir, duck):
    assert not differences(rows_of(queries.QUERIES[name](spark, sf_dir)), duck_rows(duck, ORACLES[name]))


def _planted(tmp_path_factory, spark):
    where = str(tmp_path_factory.mktemp("planted"))
    shared = words(1, 130)
    rows = [r for r in awkward(1500) if r[0] is not None and r[1] is not None or r[0] == 1]
    rows = list(dict.fromkeys(rows))
    rows += [(100 + k, " ".join([*words(k + 50, 40), *shared[k : k + 90], *words(k + 900, 30)])) for k in range(30)]
    rows += [(200 + k, "\n".join(["head", f"own {k}", "l1", "l2", "l3", "l4", f"tail {k % 3}", "end", "x"])) for k in range(40)]
    rows += [(300 + k, f"before {k} " + " ".join(f"q{j}" for j in range(k, k + 11)) + " after") for k in range(8)]
    table(spark, rows).repartition(5).write.parquet(f"{where}/documents.parquet")
    items = [(1, " ".join(f"q{j}" for j in range(25))), (2, "one"), (3, ""), (4, None), (5, " ".join(f"Q{j}" for j in range(3, 20))), (6, "...")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    vectors = [(k, [float((k * j) % 5 - 2) for j in range(1, 33)] if k % 7 else None) for k in range(120)]
    vectors += [(200, []), (220, [1.0] * 40), (221, [1.0] * 40)] + [(300 + k, [1.0, -1.0] * 16) for k in range(30)]
    vectors += [(400, [float("nan")] * 32), (402, [float("-inf")] * 32)]
    labelled = [(k, v, k % 3 if k % 4 else None) for k, v in vectors]
    spark.createDataFrame(labelled, "vec_id long, embedding array<float>, label int").write.parquet(f"{where}/embeddings.parquet")
    return where


@pytest.fixture(scope="module")
def planted(tmp_path_factory, spark):
    where = _planted(tmp_path_factory, spark)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}/{t}.parquet/*.parquet')")
    return where, con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_planted(name, spark, planted):
    where, con = planted
    ours = rows_of(queries.QUERIES[name](spark, where))
    assert ours[1]
    assert not differences(ours, duck_rows(con, ORACLES[name]))


def test_phrases_in_blocks_give_the_same(spark, planted):
    where, _ = planted
    docs, items = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda df: sorted((r.doc_id, r.n_words, str(r.spans), str(r["items"])) for r in df.collect())
    assert plain(contamination(docs, items)) == plain(contamination(clashing(docs), items, block_words=5))


def test_entry_lists_all():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
