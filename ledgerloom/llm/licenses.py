"""License scans over a positional index of rare licence words.

Each template is a run of words. One Spark pass counts in how many documents each
template word stands; a template's index entries are its words of highest IDF and
their offsets. A document is looked up by its own licence words, rarest first; a
posting says where the template would begin, and beginnings that several postings
agree on (within SLACK words, so that a changed word or two does not hide a
notice) are aligned, scored and checked for the template's mandatory phrases.
A base phrase is a template without slack: one posting and all words equal.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_LOWER, blocks, text_buffer

#: The phrases of the base labels.
BASE = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}

#: Public licence notices (label: text, phrases that must be there).
NOTICES = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("free of charge", "without restriction", "sublicense"),
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("with or without fee", "this permission notice appear in all copies"),
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("source and binary forms", "following conditions are met"),
    ),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("endorse or promote products", "prior written permission"),
    ),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    "gpl-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ("gnu general public license", "version 3", "any later version"),
    ),
    "gpl-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        ("gnu general public license", "version 2", "any later version"),
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        ("gnu lesser general public license",),
    ),
    "agpl": ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        ("mozilla public license v 2 0",),
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution ShareAlike International License", ("attribution sharealike",)),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution NonCommercial International License", ("attribution noncommercial",)),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    "cc0": ("To the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related",)),
}

RARE, SLACK, LEAST = 6, 2, 0.6
_BYTES = ALNUM_LOWER.tobytes()


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_BYTES).split()


def _present(batches: Iterator[pa.RecordBatch], vocab: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    """(word, n): in how many of the task's documents each template word stands; word "" counts documents."""
    n: Counter = Counter()
    for block in blocks(batches, "__text"):
        data, offs = text_buffer(block.column("__text"))
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            n.update(vocab.intersection(data[a:b].tobytes().translate(_BYTES).split()))
            n[b""] += 1
    yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in n], "n": list(n.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))


class RareIndex:
    """word -> [(template, offset)] for each template's words of highest IDF."""

    def __init__(self, df: dict[bytes, int], n_docs: int):
        idf = lambda w: math.log((n_docs + 1) / (df.get(w, 0) + 0.5))
        self.templates = [(label, words_of(t), None) for label, t in BASE.items()]
        self.templates += [(label, words_of(t), [words_of(p) for p in must]) for label, (t, must) in NOTICES.items()]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.need = []
        for k, (_, words, must) in enumerate(self.templates):
            ranked = sorted(range(len(words)), key=lambda i: (-idf(words[i]), i))
            some = ranked[: 1 if must is None else RARE]
            for i in some:
                self.postings[words[i]].append((k, i))
            self.need.append(1 if must is None else max(1, (len(some) + 1) // 2))
        self.order = {w: r for r, w in enumerate(sorted(self.postings, key=lambda w: (-idf(w), w)))}
        self.anchors = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Base hits (start, label), and the best score of each further label."""
        rare = self.anchors.intersection(words)
        if not rare:
            return [], {}
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in rare:
                at[w].append(i)
        base: list[tuple[int, str]] = []
        votes: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for w in sorted(at, key=self.order.get):
            for k, offset in self.postings[w]:
                label, t, must = self.templates[k]
                for i in at[w]:
                    begin = i - offset
                    if must is not None:
                        votes[k][begin].add(offset)
                    elif begin >= 0 and words[begin : begin + len(t)] == t:
                        base.append((begin, label))
        found: dict[str, float] = {}
        for k, begins in votes.items():
            label, t, must = self.templates[k]
            for begin in sorted(begins):
                agree = set().union(*(begins[b] for b in range(begin - SLACK, begin + SLACK + 1) if b in begins))
                if len(agree) < self.need[k]:
                    continue
                lo, part = max(0, begin - SLACK), words[max(0, begin - SLACK) : max(0, begin + len(t) + SLACK)]
                same = sum(any(0 <= begin + j + d - lo < len(part) and part[begin + j + d - lo] == x for d in range(-SLACK, SLACK + 1)) for j, x in enumerate(t)) / len(t)
                if same >= LEAST and all(any(part[i : i + len(p)] == p for i in range(len(part) - len(p) + 1)) for p in must):
                    found[label] = max(found.get(label, 0.0), same)
        return sorted(base), found


def _scan(batches: Iterator[pa.RecordBatch], index, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    ix: RareIndex = index.value
    for block in blocks(batches, "__text"):
        data, offs = text_buffer(block.column("__text"))
        out: list[list] = [[] for _ in range(5)]
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            words = data[a:b].tobytes().translate(_BYTES).split()
            base, more = ix.scan(words)
            more = [{"label": k, "score": v} for k, v in sorted(more.items())]
            for column, v in zip(out, (len(words), [{"word": i, "label": k} for i, k in base], more, max([1.0] * bool(base) + [x["score"] for x in more], default=0.0), sorted({k for _, k in base} | {x["label"] for x in more})), strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([block.column("__id"), *(pa.array(c, f.type) for c, f in zip(out, list(schema)[1:], strict=True))], names=schema.names)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id, n_words, base (word, label), notices (label, score), score, labels (sorted).

    base has every place where a base phrase's words stand, notices the further
    labels found. score is 1 for a base phrase and else the best share of a
    notice's words in place, 0 for none. A null or empty text has no words and no
    labels; repeated rows each get their own result; an empty table gives an empty
    result; other columns are not used. Texts of any length are looked at whole, in
    blocks of some megabytes. Of templates that fit equally well each gives its label;
    labels are sorted, so that ties don't show. Two passes: document frequencies of the
    template words (a bounded list of rows reaches the driver), then the scan.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    vocab = frozenset(w for t in [*BASE.values(), *(t for t, _ in NOTICES.values())] for w in words_of(t))
    counts = base.select("__text").mapInArrow(partial(_present, vocab=vocab), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r.word.encode(): r.n for r in counts}
    index = spark.sparkContext.broadcast(RareIndex(df, df.get(b"", 0)))
    kind = dict(base.dtypes)["__id"]
    schema = pa.schema([("__id", pa.null()), ("n_words", pa.int64()), ("base", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))), ("notices", pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))), ("score", pa.float64()), ("labels", pa.list_(pa.string()))])
    ddl = f"__id {kind}, n_words long, base array<struct<word:long,label:string>>, notices array<struct<label:string,score:double>>, score double, labels array<string>"
    return base.mapInArrow(partial(_scan, index=index, schema=schema), ddl).withColumnRenamed("__id", id_col)
