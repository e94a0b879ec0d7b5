"""The co-trained classifier on labelled rows that it has and has not seen."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from making import table, words
from pyspark.sql import functions as F

from ledgerloom.llm import quality, queries


def _corpus(spark, n=400):
    rows = [(k, (" ".join(words(k, 80)) + ". ") if k % 4 else "Buy now! " * (20 + k % 9), "en", f"good{k % 5}" if k % 4 else f"junk{k % 3}") for k in range(n)]
    return table(spark, rows), [(k, int(k % 4 > 0)) for k in range(0, n)]


def test_unseen_rows(spark):
    docs, truth = _corpus(spark)
    labels = spark.createDataFrame([x for x in truth if x[0] % 3 == 0], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, quality.train(docs, labels, per_round=50)).collect()}
    unseen = [x for x in truth if x[0] % 3]
    assert sum(got[k].keep == bool(y) for k, y in unseen) >= 0.97 * len(unseen)
    assert all(0 <= v <= 1 for r in got.values() for v in (r.p_text, r.p_meta, r.p_good))


def test_views_exchange_labels(spark):
    docs, truth = _corpus(spark)
    labels = spark.createDataFrame([x for x in truth if x[0] % 5 == 0], "doc_id long, quality int")
    model = quality.train(docs, labels, rounds=3, per_round=40)
    assert min(model.n_pseudo) > 0
    assert quality.train(docs, labels, rounds=0).n_pseudo == [0, 0]


def test_one_class_keeps_all(spark):
    docs, truth = _corpus(spark, 40)
    model = quality.train(docs, spark.createDataFrame([x for x in truth if x[1]], "doc_id long, quality int"))
    assert model is None
    assert quality.classify(docs, model).where("keep").count() == 40


def test_query_keeps_the_good(spark, sf_dir):
    got = {r.doc_id: r.keep for r in queries.op10_quality_classifier(spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    good = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").collect()]  # toxic rows are to go
    assert sum(got[k] for k in good) >= 0.98 * len(good)


def test_rejects_toxic_rows_of_good_quality(spark):
    """Labelled good and toxic at once: such rows go, seen or not."""
    docs = table(spark, [(k, " ".join([*words(k, 80), *(["idiot", "scum"] if k % 7 == 0 else [])]) + ".", "en", f"s{k % 5}") for k in range(700)])
    labels = spark.createDataFrame([(k, 1, int(k % 7 == 0)) for k in range(700) if k % 3 == 0], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.classify(docs, quality.train(docs, labels)).collect()}
    toxic, clean = [[k for k in got if k % 3 and (k % 7 == 0) == t] for t in (True, False)]
    assert sum(not got[k] for k in toxic) >= 0.95 * len(toxic)
    assert sum(got[k] for k in clean) >= 0.98 * len(clean)


def test_held_out_labels(spark, sf_dir):
    """Trained without a fifth of the real labels: of these, toxic and bad rows go, rows clean on both stay."""
    sf = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.keep for r in quality.classify(docs, quality.train(docs, labels.where("doc_id % 5 <> 2"))).collect()}
    rest = [r for r in labels.where("doc_id % 5 = 2").collect()]
    toxic, bad, clean = [r for r in rest if r.toxic], [r for r in rest if not r.quality], [r for r in rest if r.quality and not r.toxic]
    assert sum(not got[r.doc_id] for r in toxic) >= 0.9 * len(toxic) > 0
    assert sum(not got[r.doc_id] for r in bad) >= 0.9 * len(bad) > 0
    assert sum(got[r.doc_id] for r in clean) >= 0.98 * len(clean)


def _logistic(x, y, l2=1.0):
    """L2 logistic regression by Newton steps, as a function from rows to logits."""
    x, y = np.asarray(x, np.float64), np.asarray(y, float)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], l2), 1e-3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * np.maximum(p * (1 - p), 1e-6)[:, None]) + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w = w - step
        if abs(step).max() < 1e-6:
            break
    return lambda rows: np.clip(np.hstack([(np.asarray(rows, np.float64) - mean) / scale, np.ones((len(rows), 1))]) @ w, -30, 30)


def test_co_training_by_hand(spark):
    """All rows in one place, plain loops: the same probabilities and the same rows kept."""
    docs, truth = _corpus(spark)
    docs = docs.where("doc_id % 11 <> 4").union(docs.where("doc_id % 50 = 7").withColumn("doc_id", F.col("doc_id") + 1000))
    labels = {k: y for k, y in truth if k % 5 == 0}
    model = quality.train(docs, spark.createDataFrame([*labels.items()], "doc_id long, quality int"), rounds=3, per_round=40)
    got = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    rows = docs.select("*", F.xxhash64("doc_id", "text").alias("row"), F.xxhash64("text").alias("key")).collect()
    text = quality.text_features(pa.array([r.text for r in rows]), np.zeros(0, np.uint64))[0]
    meta = quality.meta_features([r.source for r in rows], [r.lang for r in rows], [r.n_chars for r in rows])
    fold = np.array([(r.row % (1 << 64)) >> 7 & 3 for r in rows])
    y = np.array([labels.get(r.doc_id, -1) for r in rows])
    known, held = np.flatnonzero((y >= 0) & (fold > 0)), np.flatnonzero((y >= 0) & (fold == 0))
    assert len(set(y[held])) == 2
    share = y[known].mean()
    views, sets, free = (text, meta), [[(i, y[i]) for i in known] for _ in range(2)], {}
    for i, r in enumerate(rows):
        if y[i] < 0:
            free.setdefault(r.key, i)
    for turn in range(4):
        fitted = [_logistic([v[i] for i, _ in s], [g for _, g in s]) for v, s in zip(views, sets)]
        if turn == 3:
            break
        offers = []
        for k in range(2):
            keys = sorted(free)
            p = dict(zip(keys, 1 / (1 + np.exp(-fitted[k](np.array([views[k][free[x]] for x in keys]))))))
            for good, most in ((1, share), (0, 1 - share)):
                sure = {x: v if good else 1 - v for x, v in p.items()}
                least = 1 - 0.05 * min(1.0, 2 * (1 - most))
                offers.append((k, good, sorted((x for x in keys if sure[x] >= least), key=lambda x: (-sure[x], x))[: max(1, int(40 * most))]))
        for k, good, some in offers:
            for x in some:
                if x in free:
                    sets[1 - k].append((free.pop(x), good))
    assert model.n_pseudo == [len(s) - len(known) for s in sets] and min(model.n_pseudo) > 0
    raw = np.column_stack([f(v) for f, v in zip(fitted, views)])
    both = np.column_stack([_logistic(raw[held][:, [k]], y[held], 0.1)(raw[:, [k]]) for k in range(2)])
    good = 1 / (1 + np.exp(-_logistic(both[held], y[held], 0.1)(both)))
    least = min(0.5, sorted(good[held][y[held] == 1])[int((y[held] == 1).sum() * quality.LOST)])
    for r, p in zip(rows, good):
        assert got[r.doc_id].p_good == pytest.approx(p, abs=1e-4)
        assert got[r.doc_id].keep == (p >= least) or abs(p - least) < 1e-4
