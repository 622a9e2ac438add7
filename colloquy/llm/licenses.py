"""License scan by patience alignment of texts with license templates.

A template aligns with a text as in a patience diff: the words that are unique to both are matched,
the longest increasing subsequence of those matches is the backbone, and each gap between two
neighbours of it is aligned the same way by itself, until a gap has no word unique to both.  A gap
that starts or ends with equal words matches those first.

Coverage is the share of the template's words that are matched.  A text is aligned only where it can
hold a template: words of the template must be dense enough in a window of the template's length,
which rules out no alignment that reaches ``COVERAGE`` within ``STRETCH`` template lengths.

The scan is a narrow map over the documents; templates are small text parameters.

Defined results: words are runs of letters, digits, dots and plus signs between word characters of
the lower-cased text; null and empty texts, and texts without a match, have no licenses; several
licenses in one text are all listed, one hit per place, the best coverage (then the longer template,
then the name that sorts first) where hits overlap; repeated rows repeat their result; other columns
are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

COVERAGE, STRETCH = 0.8, 1.5
_WORD = re.compile(r"\w+(?:[.+]\w+)*\+*")

#: Notices and opening terms of public licenses.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
           "permit persons to whom the Software is furnished to do so",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                  "Public License as published by the Free Software Foundation",
    "CC BY-NC 4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC BY 4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Reserved": "All rights reserved.",
}


def words_of(text: str | None) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text or "")]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence, by first member, whose second members rise (patience piles)."""
    tops: list[int] = []
    pile: list[int] = []
    back: list[int] = []
    for n, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(pile[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            pile.append(n)
        else:
            tops[at], pile[at] = b, n
    out, n = [], pile[-1] if pile else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of two word lists, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = _rising([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if not anchors:
            continue
        ends = [*anchors, (a1, b1)]
        i, j = a0, b0
        for x, y in ends:
            if i < x and j < y:
                todo.append((i, x, j, y))
            i, j = x + 1, y + 1
        out += anchors
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, stretch: float = STRETCH) -> None:
        self.coverage, self.stretch = coverage, stretch
        self.templates = [(name, [w for w, _, _ in words_of(t)]) for name, t in templates.items()]
        self.templates = [(name, ws) for name, ws in self.templates if ws]
        self.vocabulary = {w for _, ws in self.templates for w in ws}

    def _windows(self, places: list[int], need: int, length: int) -> Iterator[tuple[int, int]]:
        """Spans of text positions in which at least ``need`` places lie within ``length``; they don't overlap."""
        span: list[int] | None = None
        for i in range(len(places) - need + 1):
            start, stop = places[i], places[i + need - 1] + 1
            if stop - start > length:
                continue
            if span and start <= span[1]:
                span[1] = stop
            else:
                if span:
                    yield span[0], span[1]
                span = [start, stop]
        if span:
            yield span[0], span[1]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """``(template, coverage, start, stop)`` of every hit, by place."""
        found = words_of(text)
        words = [w for w, _, _ in found]
        of: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.vocabulary:
                of.setdefault(w, []).append(i)
        hits = []
        for name, template in self.templates:
            need = -int(-self.coverage * len(template) // 1)
            wanted = set(template)
            # fewer of the template's words than must match, however they lie
            if sum(n for w, n in Counter(template).items() if w in of) < need:
                continue
            length = int(self.stretch * len(template)) + 1
            places = sorted(p for w in wanted if w in of for p in of[w])
            for start, stop in self._windows(places, need, length):
                hits += self._hits(name, template, words, found, start, stop, need, length)
        hits.sort(key=lambda h: (-h[1], -h[4], h[0], h[2]))
        kept: list[tuple] = []
        for h in hits:
            if all(h[3] <= k[2] or k[3] <= h[2] for k in kept):
                kept.append(h)
        return [h[:4] for h in sorted(kept, key=lambda h: h[2])]

    def _hits(self, name: str, template: list[str], words: list[str], found: list[tuple[str, int, int]], start: int, stop: int,
              need: int, length: int) -> Iterator[tuple[str, float, int, int, int]]:
        """Aligned places of one template inside a span; after a hit the rest is tried again."""
        at = start
        while at < stop:
            while at < stop and words[at] not in template:
                at += 1
            end = min(stop, at + length)
            matched = align(words[at:end], template)
            if len(matched) >= need:
                first, last = at + matched[0][0], at + matched[-1][0]
                yield name, len(matched) / len(template), found[first][1], found[last][2], len(template)
                at = last + 1
            else:
                at += 1


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
                  coverage: float = COVERAGE) -> DataFrame:
    """``(id, n_hits, best, best_coverage, hits)``; hits: ``template:start:stop:coverage`` joined by ``;``."""
    sent = dict(TEMPLATES if templates is None else templates)
    rows = docs.select(id_col, text_col)
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_hits int, best string, best_coverage double, hits string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent, coverage)
        for b in batches:
            out: list[list] = [[], [], [], []]
            for t in b.column(1):
                hits = scanner.scan(t.as_py())
                best = max(hits, key=lambda h: (h[1], h[3] - h[2]), default=None)
                out[0].append(len(hits))
                out[1].append(best and best[0])
                out[2].append(best[1] if best else 0.0)
                out[3].append(";".join(f"{n}:{s}:{e}:{c:.4f}" for n, c, s, e in hits))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int32()), pa.array(out[1], pa.string()),
                                              pa.array(out[2], pa.float64()), pa.array(out[3], pa.string())],
                                             names=[id_col, "n_hits", "best", "best_coverage", "hits"])

    return rows.mapInArrow(run, schema)
