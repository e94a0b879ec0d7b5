"""What a worker gets at once, and how often a model is fitted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

import corpus_pipeline
from ledgerloom.llm import common, quality
from making import table, words


def _logged(real, path, what):
    """real, which first writes what(batch) of each of its batches to a file; it may run in a worker."""

    def run(batches, *more, **named):
        def seen():
            for batch in batches:
                with open(path, "a") as f:
                    f.write(f"{what(batch)}\n")
                yield batch

        return real(seen(), *more, **named)

    return run


def _labelled(spark, tmp_path, n, each):
    docs = table(spark, [(k, (" ".join(words(k, each)) + ".") if k % 4 else "Buy now! " * (each // 2 + k % 9), "en", f"s{k % 4 > 0}") for k in range(n)])
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(0, n, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return docs


def test_quality_filter_gets_texts_once_in_small_batches(spark, tmp_path, monkeypatch):
    docs = _labelled(spark, tmp_path, 1600, 1400).coalesce(1)  # 12 MB of text
    monkeypatch.setattr(quality, "_apply", _logged(quality._apply, f"{tmp_path}/seen", lambda b: f"{b.nbytes} {b.num_rows} {sum(str(t) == 'string' for t in b.schema.types)}"))
    kept = corpus_pipeline.quality_filter(spark, docs, str(tmp_path)).collect()
    seen = [tuple(map(int, x.split())) for x in open(f"{tmp_path}/seen")]
    assert sum(n for _, n, _ in seen) == 1600 and {r.doc_id for r in kept} == {k for k in range(1600) if k % 4}
    assert max(size for size, _, _ in seen) < 1.1 * common.BATCH_BYTES
    assert {texts for _, _, texts in seen} == {5}  # text, lang and source of the row, and the two that are looked at


def test_each_model_is_fitted_once_a_round(spark, tmp_path, monkeypatch):
    docs = _labelled(spark, tmp_path, 400, 40)
    real = quality._fitted
    path = f"{tmp_path}/fits"

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "a") as f:
            f.write("x\n")
        return real(batches)

    monkeypatch.setattr(quality, "_fitted", fitted)
    quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet").drop("toxic"), rounds=2, per_round=20)
    assert len(open(path).readlines()) == 2 * 3


def test_a_smaller_limit_stays(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("64m", common.BATCH_BYTES), ("100k", 100 << 10)):
            spark.conf.set(key, given)
            common.small_batches(spark)
            got = spark.conf.get(key)
            assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(got) == want
    finally:
        spark.conf.set(key, before)
