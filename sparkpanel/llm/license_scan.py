"""License scans by patience alignment.

A text's words are aligned with a template's: words that occur once in both are matched, the longest increasing
subsequence of the matches gives the anchors, and the gaps between anchors are aligned the same way, after equal words at
both ends of a gap have been taken.  Coverage is the share of template words that are aligned.

A text is looked at where a template can be: around each occurrence of one of the template's key words, as far as the
template is long, with a margin.  Where template words come repeatedly in such a region, windows of the template's length are aligned, so
that copies close together are found separately.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts_of

_word = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")

#: Public license notices in their usual wording.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                     "International License."],
    "reserved": ["All rights reserved."],
}


@dataclass(frozen=True)
class Template:
    license: str
    words: tuple[str, ...]
    keys: frozenset[str]


def words_with_spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(_word.finditer(text))
    return [m.group().lower() for m in found], [m.span() for m in found]


def templates(notices: dict[str, Sequence[str]] = NOTICES, keys: int = 3, coverage: float = 0.8) -> list[Template]:
    """Each notice's words; its key words are those that the fewest notices share, the longest first on ties: at least
    ``keys``, and so many that a text without any of them has less than ``coverage`` of the notice's words."""
    split = [(name, words_with_spans(t)[0]) for name, texts in notices.items() for t in texts]
    shared = Counter(w for _, words in split for w in set(words))
    out = []
    for name, words in split:
        count, key, held = Counter(words), [], 0
        for w in sorted(count, key=lambda w: (shared[w], -len(w), w)):
            if len(key) >= keys and len(words) - held < coverage * len(words):
                break
            key.append(w)
            held += count[w]
        out.append(Template(name, tuple(words), frozenset(key)))
    return out


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs (i, j) of aligned equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        pairs = [(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place]
        anchors = [pairs[k] for k in increasing([j for _, j in pairs])]
        if anchors:
            out += anchors
            for (i0, j0), (i1, j1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
                open_.append((i0 + 1, i1, j0 + 1, j1))
    return sorted(out)


def regions(words: list[str], template: Template, margin: float = 0.25) -> list[tuple[int, int]]:
    """Word ranges around key words, as far as the template reaches; ranges that touch are one."""
    reach = int(len(template.words) * (1 + margin)) + 1
    out: list[tuple[int, int]] = []
    for i in (i for i, w in enumerate(words) if w in template.keys):
        a, b = max(0, i - reach), min(len(words), i + reach + 1)
        if out and a <= out[-1][1] and b - out[-1][0] <= 4 * reach:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def notices_in(words: list[str], a: int, b: int, template: Template, coverage: float) -> Iterator[list[tuple[int, int]]]:
    """Alignments of the template with words[a:b] that reach ``coverage``.

    Where the range has template words more often than the template has, copies may hide each other's unique words; then
    windows of the template's length are aligned too, one for each place where a template word lets a copy begin.  The
    alignment of the whole range counts unless two copies or more are found, over which it could spread.
    """
    size = len(template.words)
    count, own = Counter(words[a:b]), Counter(template.words)
    whole = [(a + i, j) for i, j in align(words[a:b], template.words)]
    copies, reach = 0, a
    if not any(count[w] > n for w, n in own.items()):
        if len(whole) >= coverage * size:
            yield whole
        return
    # a copy's first aligned word is one of these: at most size - coverage * size template words are missing before it
    first = set(template.words[:int(size - coverage * size) + 1])
    inside = [0]
    for i in range(a, b):
        inside.append(inside[-1] + (words[i] in own))
    for i in range(a, b):
        if words[i] not in first:
            continue
        tried = set()
        for length in (size, size + size // 4 + 1):
            end = min(b, i + length)
            if end in tried or inside[end - a] - inside[i - a] < coverage * size:
                continue
            tried.add(end)
            pairs = [(i + p, q) for p, q in align(words[i:end], template.words)]
            if len(pairs) >= coverage * size:
                yield pairs
                if pairs[0][0] >= reach:
                    copies, reach = copies + 1, pairs[-1][0] + 1
    if copies < 2 and len(whole) >= coverage * size:
        yield whole


def scan(text: str, known: list[Template], coverage: float) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) of each notice, in code points; of overlapping ones the one with most aligned words."""
    words, spans = words_with_spans(text)
    have, hits = set(words), []
    for t in known:
        if not t.keys & have or sum(w in have for w in t.words) < coverage * len(t.words):
            continue
        for a, b in regions(words, t):
            for pairs in notices_in(words, a, b, t, coverage):
                hits.append((len(pairs), len(pairs) / len(t.words), t.license, spans[pairs[0][0]][0], spans[pairs[-1][0]][1]))
    kept: list[tuple[str, float, int, int]] = []
    for _, share, name, start, end in sorted(hits, key=lambda h: (-h[0], -h[1], h[2], h[4] - h[3], h[3])):
        if all(end <= s or start >= e for _, _, s, e in kept):
            kept.append((name, share, start, end))
    return sorted(kept, key=lambda h: (h[2], h[0]))


def license_scan(docs: DataFrame, notices: dict[str, Sequence[str]] = NOTICES, coverage: float = 0.8) -> DataFrame:
    """(doc_id, license, coverage, found array<struct<license, coverage, start, end>>) for every row.

    ``license`` is the notice with the highest coverage, the earliest on ties; null without one, then coverage is 0.
    A null or empty text has none.  Ids may be null or repeat, each row is scanned on its own; further columns are
    not read; an empty table gives no row.
    """
    known = templates(notices, coverage=coverage)
    mark = re.compile("|".join(sorted({re.escape(k) for t in known for k in t.keys})), re.IGNORECASE).search

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            found = [scan(t, known, coverage) if mark(t) else [] for t in texts_of(batch)]
            best = [max(f, key=lambda h: (h[1], -h[2]), default=(None, 0.0)) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()),
                 pa.array([[dict(zip(("license", "coverage", "start", "end"), h)) for h in f] for f in found], pa.list_(hit))],
                names=["doc_id", "license", "coverage", "found"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, license string, coverage double, "
             "found array<struct<license:string,coverage:double,start:long,end:long>>")
