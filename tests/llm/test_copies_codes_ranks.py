"""Exact copies, vector codes and ranked search against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from making import DDL, LOWER, awkward, clashing, table, words

from ledgerloom.llm import exact_dedup as ed
from ledgerloom.llm.exact_dedup import exact_dedup
from ledgerloom.llm.ranked import add, best, ranked_search
from ledgerloom.llm.vector_codes import vector_codes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _plain(df):
    return Counter(tuple(r) for r in df.collect())


# exact copies


def _groups(rows):
    """Of each row without its kept: as the docstring says."""
    by = defaultdict(list)
    for r in rows:
        by[(r[1] or "").translate(LOWER)].append(r[0])
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    out = Counter()
    for r in rows:
        t = (r[1] or "").translate(LOWER)
        out[(r[0], largest[t], len(by[t]), hashlib.sha256(t.encode()).hexdigest())] += 1
    return out, len(by)


def _copies():
    long = " ".join(words(3, 9000))
    rows = [r[:2] for r in awkward(30_000)] + [(1000 + k, f"copy {k % 7} " + long[: 900 * (k % 7 + 1)]) for k in range(60)]
    return rows + [(2000, long), (2001, long.upper()), (2002, long[:-1] + "x"), (2003, "x" + long), (2004, "a" * 70_000), (2005, "A" * 70_000), (2006, "a" * 69_999), (2007, "É"), (2008, "é")]


def test_copies(spark):
    rows = _copies()
    got = exact_dedup(clashing(table(spark, rows).repartition(6))).collect()
    want, groups = _groups(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_identifiers_are_verified(spark, monkeypatch):
    """With identifiers of one byte, different chunks share one until another key is tried."""
    tried = []
    monkeypatch.setattr(ed, "remove", lambda s, path: tried.append(path))
    rows = [(k, " ".join(words(k % 6, 900))) for k in range(40)]
    got = exact_dedup(table(spark, rows), digest_bytes=1).collect()
    want, _ = _groups(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert tried


def test_no_rows_and_nothing_but_nulls(spark):
    assert not exact_dedup(spark.createDataFrame([], DDL)).count()
    got = exact_dedup(table(spark, [(None, None)] * 3 + [(None, "")])).collect()
    assert [r.keep_id for r in got] == [None] * 4 and {r.group_size for r in got} == {4} and sum(r.kept for r in got) == 1


def test_one_text_in_a_third_of_all_rows(spark):
    rows = [(k, "the same " * 400 if k % 3 == 0 else f"own {k}") for k in range(3000)]
    got = exact_dedup(table(spark, rows).repartition(12))
    assert got.where("group_size = 1000 and keep_id = 2997").count() == 1000
    assert got.where("kept").count() == 2001


def test_chunks_follow_the_content():
    """An insertion changes the chunks around it and no others."""
    text = " ".join(words(11, 20_000)).encode()
    other = text[:5000] + b"inserted" + text[5000:]

    def chunks(t):
        data = np.frombuffer(t, np.uint8)
        ends = ed.cuts(data, np.array([0, len(t)]))[0]
        return [t[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    a, b = chunks(text), chunks(other)
    assert b"".join(a) == text and b"".join(b) == other
    assert all(len(c) <= ed.MOST for c in a) and all(len(c) >= ed.LEAST for c in a[:-1])
    assert len(set(a) - set(b)) <= 3 < len(a) // 10


# vector codes


def _lloyd(rows, rounds=6):
    """(id, label, codes, error) of kept rows, and the entries, by plain Lloyd rounds in Python integers."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // 8))
    kept = [(i, v + [0] * (8 * width - len(v)), lab) for i, v, lab in kept]
    start = sorted(kept, key=lambda r: r[0])[:16]
    books = [[v[p * width : (p + 1) * width] for _, v, _ in start] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        codes = [[min((far(v[p * width : (p + 1) * width], e), n) for n, e in enumerate(books[p])) for p in range(8)] for _, v, _ in kept]
        if k < rounds:
            for p in range(8):
                for n in range(len(books[p])):
                    mine = [v[p * width : (p + 1) * width] for (_, v, _), c in zip(kept, codes, strict=True) if c[p][1] == n]
                    if mine:
                        books[p][n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in c) for c in codes]
    by = Counter()
    for (_, _, lab), e in zip(kept, error, strict=True):
        by[lab] += e
    return Counter((i, "".join(f"{n:02x}" for _, n in c), e, by[lab], digest) for (i, _, lab), c, e in zip(kept, codes, error, strict=True))


def _vectors(seed, n, size, values):
    r = random.Random(seed)
    return [(k, [r.choice(values) if isinstance(values, list) else r.gauss(0, values) for _ in range(size)], r.choice([0, 1, 1, 1, None])) for k in range(n)]


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(
    "rows",
    [
        _vectors(1, 400, 64, 0.1),
        _vectors(2, 300, 16, [0.0, 1 / 4096, -1 / 4096, 2 / 4096]),  # few values: many ties and equal entries
        _vectors(3, 9, 24, 1.0),  # fewer rows than entries
        _vectors(4, 40, 13, 0.5) + [(100, [1.0] * 3, 0), (101, [], 0), (102, None, 0), (103, [math.nan] * 13, 0), (104, [None] * 13, 0), (105, [math.inf] * 13, 0), (90, [2.0] * 13, None), (91, [2.0] * 13, None)],
    ],
)
def test_codes(spark, rows):
    df = spark.createDataFrame(rows, VECTORS)
    scans = []
    got = vector_codes(clashing(df.repartition(5)), scans=scans)
    assert _plain(got) == _lloyd(rows)
    assert len(scans) == 7


def test_bounds_spare_scans(spark):
    """Well apart groups: after a few rounds nearly no part is compared with all entries."""
    r = random.Random(5)
    centres = [[r.gauss(0, 3) for _ in range(32)] for _ in range(16)]
    rows = [(k, [x + r.gauss(0, 0.05) for x in centres[k % 16]], 0) for k in range(640)]
    scans = []
    vector_codes(spark.createDataFrame(rows, VECTORS), scans=scans)
    assert scans[0] > 0 and scans[-1] < 0.1 * 8 * 640


def test_codes_of_nothing(spark):
    assert not vector_codes(spark.createDataFrame([], VECTORS)).count()
    assert not vector_codes(spark.createDataFrame([(1, None, 1), (2, [math.nan], None)], VECTORS)).count()


def test_rows_of_one_id_and_without_one(spark):
    rows = [(7, [0.5] * 8, 1)] * 3 + [(None, [1.5] * 8, None)] * 2
    got = vector_codes(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(r.code for r in got) == ["00" * 8] * 3 + ["03" * 8] * 2 and {r.label_error for r in got} == {0}


# ranked search


def _ranks(docs, items, k=20):
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n = [sum(c.values()) for _, c in held]
    docs_n, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for (i, c), size in zip(held, n, strict=True):
            score = 0
            for t in TERM.findall((text or "").translate(LOWER)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * size * docs_n // total)))
            if score > 0:
                found.append((-score, i is None, i or 0, i, score))
        for rank, f in enumerate(sorted(found)[:k], 1):
            out[(item, rank, f[3], f[4])] += 1
    return out


@pytest.mark.parametrize(("block", "batch"), [(4096, 256), (7, 3)])
def test_ranks(spark, block, batch):
    docs = [r[:2] for r in awkward(3000)] + [(100 + k, " ".join(words(k % 90, 3 + k % 60, 150))) for k in range(400)] + [(900, "Zoë ZOË zoë w1 w1 w1"), (None, "w2 w3"), (None, "w2 w3")]
    items = [(k, " ".join(words(1000 + k, 1 + 3 * k, 200))) for k in range(12)] + [(50, "w1 W1 w1 w2 zoë"), (51, None), (52, ""), (53, "nowhere at_all"), (None, "w3"), (50, "w1 W1 w1 w2 zoë"), (54, "one")]
    got = ranked_search(clashing(table(spark, docs).repartition(4)), spark.createDataFrame(items, "item_id long, text string"), block_docs=block, batch_items=batch)
    assert _plain(got) == _ranks(docs, items)


def test_ranks_of_nothing(spark):
    none, items = spark.createDataFrame([], DDL), spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert not ranked_search(none, items).count()
    assert not ranked_search(table(spark, [(1, "one")]), items.where("false")).count()
    assert not ranked_search(table(spark, [(None, None), (1, "")]), items).count()
    assert not ranked_search(table(spark, [(1, "other words")]), items).count()
    assert not ranked_search(table(spark, [(1, "one")]), items.selectExpr("item_id", "'...' AS text")).count()


def test_carries_and_slices():
    r = np.random.default_rng(3)
    want = np.zeros((5, 192), np.int64)
    total = np.zeros((5, 45, 3), np.uint64)
    for shift in (0, 3, 1):
        x = r.integers(0, 1 << 30, (5, 192)) * r.integers(0, 2, (5, 192))
        planes = np.packbits((x[:, None, :] >> np.arange(30)[:, None] & 1).astype(np.uint8), axis=2, bitorder="little").view("<u8")
        add(total, planes, shift)
        want += x << shift
    bits = np.unpackbits(total.view(np.uint8), axis=2, bitorder="little").astype(np.int64)
    assert ((bits << np.arange(45)[:, None]).sum(1) == want).all()
    sure, tied = best(total, 20)
    for i in range(5):
        chosen = np.flatnonzero(np.unpackbits((sure[i] | tied[i]).view(np.uint8), bitorder="little"))
        assert set(np.argsort(-want[i], kind="stable")[:20]) <= set(chosen.tolist())
