"""Operators that SQL cannot express, against plain Python over whole texts."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import pytest
from making import ALNUM, LOWER, SPACED, awkward, clashing, table, words
from pyspark.sql import functions as F

from ledgerloom.llm import language, lm, queries
from ledgerloom.llm.jaccard import jaccard_groups
from ledgerloom.llm.licenses import BASE, NOTICES, license_scan
from ledgerloom.llm.packing import best_fit_packing


def _held(i, parts, part):
    return i is not None and zlib.crc32(str(i).encode()) % parts == part


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


def _base_hits(text):
    w = ALNUM.findall((text or "").translate(LOWER))
    hits = []
    for label, phrase in BASE.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), hits


def test_license_base(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op2_license_scan(spark, sf_dir).collect()}
    rows = _documents(spark, sf_dir)
    assert len(got) == len(rows)
    for r in rows:
        n, hits = _base_hits(r.text)
        x = got[r.doc_id]
        assert (x.n_words, x.n_base) == (n, len(hits))
        assert (x.first_word, x.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert x.base_labels == ",".join(sorted({k for _, k in hits}))
        assert {k for _, k in hits} <= set(x.labels.split(","))
        assert 0 <= x.score <= 1


def test_license_notices(spark):
    texts = [(k, "Some code. " + t + " and so on") for k, (t, _) in enumerate(NOTICES.values())]
    changed = NOTICES["mit-text"][0].replace("person", "human").replace("files", "papers")
    without = NOTICES["isc"][0].replace("with or without fee", "gratis")
    rows = {r.doc_id: r for r in license_scan(clashing(table(spark, [*texts, (100, changed), (101, without), (102, "mit mit license MIT  License cc-by")]))).collect()}
    for k, label in enumerate(NOTICES):
        assert label in rows[k].labels, label
    assert rows[100].labels == ["mit-text"] and rows[100].score < 1
    assert rows[101].labels == []
    assert [(b["word"], b["label"]) for b in rows[102].base] == [(1, "mit"), (3, "mit"), (5, "cc-by")]


def _sets(rows, size):
    out = []
    for _, text in rows:
        w = SPACED.findall((text or "").translate(LOWER))
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def _components(rows, size, percent):
    sets = _sets(rows, size)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in at[x] if j > i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                up[root(j)] = root(i)
    for first in {r[0]: i for i, r in reversed(list(enumerate(rows)))}.items():
        for i, r in enumerate(rows):
            if r[0] == first[0] and r[0] is not None:
                up[root(i)] = root(first[1])
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    return sorted((r[0], len(sets[i]), min(x for x in least[root(i)] if x is not None)) for i, r in enumerate(rows) if any(x is not None for x in least[root(i)]))


def _near(seed, n_groups=12):
    rows, k = [], 0
    for g in range(n_groups):
        base = words(seed + g, 40 + 25 * g)
        for copy in range(7):
            w = list(base)
            for j in range(copy * max(1, len(w) // 60)):
                w[(j * 37 + copy) % len(w)] = f"new{g}-{copy}-{j}"
            rows.append(((k * 7919) % 1000, " ".join(w)))
            k += 1
    return rows + [(5000 + i, f"short {i % 3}") for i in range(9)]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_jaccard_groups(spark, sf_dir, size, percent):
    rows = [(r.doc_id, r.text) for r in _documents(spark, sf_dir)]
    for some in (rows, _near(3), list(dict.fromkeys(_near(90) + [r for r in awkward() if r[0] is not None]))):
        some = [(i + 10_000, t) if some is not rows and 1 <= i < 20 and any(i == j and t != u for j, u, *_ in some) else (i, t) for i, t, *_ in some]
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(clashing(table(spark, some).repartition(7)), size=size, percent=percent).collect())
        assert got == _components(some, size, percent)


def test_jaccard_through_a_null_id(spark):
    """A text without an id links two that do not link with each other; one that links with none has no component."""
    base = words(5, 200)
    ends = [" ".join([*(f"x{k}" for k in range(8)), *base[8:]]), " ".join([*base[:-8], *(f"y{k}" for k in range(8))])]
    rows = [(9, ends[0]), (None, " ".join(base)), (5, ends[1]), (None, "alone in here"), (None, None), (7, " ".join(words(6, 90)))]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(table(spark, rows)).collect()}
    assert got == {(9, 197, 5), (None, 197, 5), (5, 197, 5), (None, 1, None), (None, 0, None), (7, 87, 7)}


def test_jaccard_in_many_blocks(spark, monkeypatch):
    """Blocks far smaller than the groups, so that leaders and what stays open are searched block against block."""
    from ledgerloom.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
    base = words(11, 150)
    rows = []
    for k in range(90):
        w = list(base)
        for j in range(k % 9):
            w[(j * 29 + k * 7) % 150] = f"n{k}-{j}"
        rows.append(((k * 37) % 97, " ".join(w)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(table(spark, rows)).collect())
    assert got == _components(rows, 4, 85) and len({c for *_, c in got}) > 3


def test_jaccard_query(spark, sf_dir):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op6_jaccard_join(spark, sf_dir).collect())
    assert got == _components([(r.doc_id, r.text) for r in _documents(spark, sf_dir)], 4, 85)


def _kneser_ney(learn, score):
    """Interpolated modified Kneser-Ney of order 2 with dictionaries."""
    end = object()
    cut = lambda t: [*SPACED.findall((t or "").translate(LOWER)), end]
    uni, pairs = Counter(), Counter()
    for t in learn:
        w = cut(t)
        uni.update(w)
        pairs.update(zip([None, *w[:-1]], w, strict=True))
    n, v = sum(uni.values()), len(uni)
    before = Counter(uni)
    before[None] = len(learn)
    cont, kinds = Counter(), defaultdict(Counter)
    for (u, w), c in pairs.items():
        cont[w] += 1
        kinds[u][min(c, 3)] += 1

    def discounts(values):
        k = [sum(x == i for x in values) for i in range(1, 5)]
        if min(k) == 0:
            return [0, 0.5, 1.0, 1.4]
        y = k[0] / (k[0] + 2 * k[1])
        d = [1 - 2 * y * k[1] / k[0], 2 - 3 * y * k[2] / k[1], 3 - 4 * y * k[3] / k[2]]
        return [0] + [min(max(x, 0.05), m) for x, m in zip(d, (0.95, 1.95, 2.95), strict=True)]

    d2, d1 = discounts(pairs.values()), discounts(cont.values())
    types = len(pairs)
    gamma0 = sum(d1[min(c, 3)] for c in cont.values()) / types if types else 1.0
    out = []
    for t in score:
        w = cut(t)
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        total = 0.0
        for u, x in zip([None, *w[:-1]], w, strict=True):
            low = max(cont[x] - d1[min(cont[x], 3)], 0) / max(types, 1) + gamma0 / (v + 1)
            if before[u]:
                c = pairs[u, x]
                low = max(c - d2[min(c, 3)], 0) / before[u] + sum(d2[k] * m for k, m in kinds[u].items()) / before[u] * low
            total += math.log10(low)
        out.append((len(w), sum(uni[x] > 0 for x in w), n, base, total))
    return out


def test_lm_query(spark, sf_dir):
    rows = _documents(spark, sf_dir)
    want = _kneser_ney([r.text for r in rows if not _held(r.doc_id, 7, 2)], [r.text for r in rows])
    got = {r.doc_id: r for r in queries.op8_lm_scoring(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r, (n, known, tokens, base, score) in zip(rows, want, strict=True):
        x = got[r.doc_id]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (_held(r.doc_id, 7, 2), n, known, tokens)
        assert x.base_score == pytest.approx(base, rel=1e-9)
        assert x.score == pytest.approx(score, rel=1e-9)
    held = [x for x in got.values() if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)


def test_lm_shards_and_hot_contexts(spark):
    """Many shards, and one context that is most of the text, give what one shard gives."""
    rows = [(k, " ".join(x for w in words(k, 120, 60) for x in (("the", w) if len(w) > 2 else (w,)))) for k in range(40)] + [r[:2] for r in awkward() if r[0] is not None]
    docs = clashing(table(spark, rows).repartition(6))
    learned = [t for _, t in rows]
    want = Counter((n, k, t, round(b, 6), round(s, 6)) for n, k, t, b, s in _kneser_ney(learned, learned))
    model = lm.train(docs, word_bytes=20_000, pair_bytes=20_000)
    assert model.hot and model.pair_shards > 3
    got = Counter((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs, model).collect())
    assert got == want


def test_language_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r for r in docs.collect()}
    got = queries.op4_language_id(spark, sf_dir).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == _held(r.doc_id, 4, 2) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_learns_only_what_it_may(spark, sf_dir, tmp_path):
    """Held-out languages, sources and ids change nothing but themselves."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language.held_out("doc_id", 4, 2)
    docs.withColumn("lang", F.when(out, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z")).write.parquet(f"{tmp_path}/documents.parquet")
    plain = lambda where: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in queries.op4_language_id(spark, where).collect())
    assert plain(str(tmp_path)) == plain(sf_dir)


def test_language_without_letters_and_strangers(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs)
    odd = [(1, None), (2, ""), (3, "123 ... \U0001f600"), (4, "漢字仮名交じり文は日本語の表記である。" * 6), (5, "the is of and to the")]
    got = {r.doc_id: r for r in language.identify(clashing(table(spark, odd)), model, calibration=docs).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3
    assert [got[k].rejected for k in (1, 2, 3, 4)] == [True] * 4
    assert got[5].lang_pred == "en" and not got[5].rejected


def _naive_packing(pieces, capacity):
    """Best fit, bins in the order of residual, then of when they got it; conflicts by sets."""
    bins, clock, out = [], 0, {}
    for key, size, source, cluster in pieces:
        fit = [(b["left"], b["since"], k) for k, b in enumerate(bins) if b["left"] >= size and source not in b["sources"] and (cluster is None or cluster not in b["clusters"])]
        clock += 1
        if fit:
            k = min(fit)[2]
        else:
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
            k = len(bins) - 1
        out[key] = (k, capacity - bins[k]["left"])
        bins[k]["left"] -= size
        bins[k]["sources"].add(source)
        bins[k]["clusters"].add(cluster)
        bins[k]["since"] = clock
    return out


def test_packing_is_best_fit(spark):
    rows = [(k, " ".join(words(k % 90, (k * 37) % 260)), "en", f"s{k * k % 11}" if k % 13 else None) for k in range(300)]
    got = best_fit_packing(clashing(table(spark, rows).repartition(5)), capacity=200).collect()
    key = {r["doc_id"]: r["k"] for r in table(spark, rows).select("doc_id", F.xxhash64("doc_id", F.xxhash64("text")).alias("k")).collect()}
    pieces = sorted(((-r.n_tokens, key[r.doc_id], r.piece, r) for r in got), key=lambda x: x[:3])
    want = _naive_packing([((r.doc_id, r.piece), r.n_tokens, r.source, r.cluster) for *_, r in pieces], 200)
    assert {(r.doc_id, r.piece): (int(r.bin_id.split("-")[1]), r.bin_start) for r in got} == want
    n = {k: len(SPACED.findall(t)) for k, t, *_ in rows}
    whole = defaultdict(list)
    for r in got:
        whole[r.doc_id].append((r.start, r.n_tokens))
    assert all(sum(x for _, x in v) == n[k] and sorted(s for s, _ in v) == [200 * j for j in range(len(v))] for k, v in whole.items()) and len(whole) == 300


def test_packing_in_groups(spark):
    """Each group is best fit on its own, and holds what its hash says; a text of many pieces is over several groups."""
    rows = [(k, " ".join(words(k % 90, (k * 37) % 260)), "en", f"s{k * k % 11}") for k in range(300)] + [(1000, "w " * 60_000, "en", "long")]
    got = best_fit_packing(table(spark, rows).repartition(4), capacity=200, group_rows=60).collect()
    key = {r["doc_id"]: r["k"] for r in table(spark, rows).select("doc_id", F.xxhash64("doc_id", F.xxhash64("text")).alias("k")).collect()}
    groups = defaultdict(list)
    for r in got:
        groups[r.bin_id.split("-")[0]].append(r)
    assert len(groups) == 6 and len({r.bin_id.split("-")[0] for r in got if r.doc_id == 1000}) > 1
    for some in groups.values():
        pieces = sorted(((-r.n_tokens, key[r.doc_id], r.piece, r) for r in some), key=lambda x: x[:3])
        want = _naive_packing([((r.doc_id, r.piece), r.n_tokens, r.source, r.cluster) for *_, r in pieces], 200)
        assert {(r.doc_id, r.piece): (int(r.bin_id.split("-")[1]), r.bin_start) for r in some} == want
    assert sum(r.n_tokens for r in got) == sum(len(t.split()) for _, t, *_ in rows)


def test_packing_keeps_bins_apart(spark, sf_dir):
    rows = queries.op5_best_fit_packing(spark, sf_dir).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
    for b in bins.values():
        assert len({r.source for r in b}) == len(b)
        clusters = [r.cluster for r in b if r.cluster is not None]
        assert len(set(clusters)) == len(clusters)
        at = 0
        for r in sorted(b, key=lambda r: (r.bin_start, r.n_tokens)):
            assert r.bin_start >= at and r.bin_start + r.n_tokens <= 2048
            at = r.bin_start + r.n_tokens
    assert {r.doc_id for r in rows} == {r.doc_id for r in _documents(spark, sf_dir)}
