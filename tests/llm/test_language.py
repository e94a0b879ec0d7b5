"""The language model and its rejection over all rows, whatever their number."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from making import table, words

from ledgerloom.llm import language


def test_order_does_not_fall(spark):
    """More than 4,000,000 n-grams."""
    r = np.random.default_rng(1)
    rows = [(k, "".join(map(chr, r.integers(0x4E00, 0x9FA0, 100_000))), f"l{k % 2}") for k in range(43)]
    model = language.train(table(spark, rows))
    assert model.order == language.ORDER == len(model.tables)
    assert len(model.tables[-1][0]) > 4_000_000


def test_many_shards_are_one_model(spark):
    """Shards of some hundred n-grams each score as one array does."""
    r = np.random.default_rng(5)
    docs = table(spark, [(k, "".join(r.choice(list("abcdefgh "), 200)), "en" if k % 2 else "fr") for k in range(20)] + [(50, None, "en"), (51, "ça", None)])
    whole, cut = language.train(docs), language.train(docs, shard_bytes=8000)
    assert len(whole.tables[-1][0].sizes) == 1 < len(cut.tables[-1][0].sizes)
    assert [[len(x) for x in t] for t in whole.tables] == [[len(x) for x in t] for t in cut.tables]
    scored = [sorted(tuple(r) for r in language.identify(docs, m).collect()) for m in (whole, cut)]
    assert scored[0] == scored[1] and {r[0] for r in scored[0]} == {*range(20), 50, 51}


def test_all_rows_calibrate(spark):
    assert language.calibration_rows(spark.range(30_000).withColumnRenamed("id", "doc_id")).count() == 30_000


def test_language_without_calibration_rows_has_a_limit(spark):
    """No calibration row is predicted as `xx`; a text unlike all others that goes there is rejected."""
    docs = table(spark, [(k, " ".join(words(k, 60, 50)), "en") for k in range(60)] + [(100 + k, "zzqzz qqzqq " * 9, "xx") for k in range(9)])
    odd = table(spark, [(1, "zzqzz kvjkv qqzqq wjbhj zzqzz " * 5)])
    model = language.train(docs)
    got = language.identify(odd, model, calibration=docs.where("lang = 'en'")).first()
    assert got.lang_pred == "xx" and got.rejected


def _symbols(text):
    """Lower-case letters; other characters after a letter are one blank."""
    out = []
    for c in text or "":
        if c.isalpha():
            out.append(c.lower())
        elif out and out[-1] != " ":
            out.append(" ")
    return out


def _grams(text, order):
    s = [" "] * (order - 1) + _symbols(text)
    return [tuple(s[i : i + order]) for i in range(len(s) - order + 1)]


def test_entropies_by_dictionary(spark):
    """Interpolated Kneser-Ney with dictionaries, each language on its own."""
    r = np.random.default_rng(3)
    word = lambda letters: "".join(r.choice(list(letters), r.integers(2, 8)))
    rows = [(k, " ".join(word("abcdeé" if k % 2 else "dexyzß") for _ in range(60)) + (", 12." if k % 3 else "") + " A", "ab"[k % 2]) for k in range(30)]
    odd = [(100, "abc"), (101, "q"), (102, "xyz zyx ZYX!"), (103, "ß é"), (104, None), (105, "...")]
    order, counts = language.ORDER, {}
    for lang in "ab":
        levels = [Counter(g for _, t, x in rows if x == lang for g in _grams(t, order))]
        for _ in range(order - 1):
            levels.append(Counter(g[1:] for g in levels[-1]))
        counts[lang] = levels[::-1]
    letters = len({g for c in counts.values() for g in c[0]})
    tables = {}
    for lang, levels in counts.items():
        for k, level in enumerate(levels, 1):
            once, twice = (sum(v == x for v in level.values()) for x in (1, 2))
            d = min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5
            total, kinds = defaultdict(int), defaultdict(int)
            for g, c in level.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            tables[lang, k] = level, d, total, kinds

    def p(lang, g, k):
        if not k:
            return 1 / (letters + 1)
        level, d, total, kinds = tables[lang, k]
        low, n = p(lang, g[1:], k - 1), total[g[:-1]]
        return max(level[g] - d, 0) / n + d * kinds[g[:-1]] / n * low if n else low

    model = language.train(table(spark, rows))
    for r in language.identify(table(spark, [x[:2] for x in rows] + odd), model).collect():
        text = dict([x[:2] for x in rows] + odd)[r.doc_id]
        grams = _grams(text, order)
        if not any(c != " " for c in _symbols(text)):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        h = {lang: -sum(math.log(p(lang, g, order)) for g in grams) / len(grams) for lang in "ab"}
        assert r.entropy == pytest.approx(min(h.values()), abs=1e-4)
        assert r.lang_pred == min(h, key=h.get) or abs(h["a"] - h["b"]) < 1e-4
