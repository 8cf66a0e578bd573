"""License notices in documents, by patience alignment with template texts.

Words are runs of letters and digits, lower-cased over A-Z.  For each template
the places of a document where enough of its words stand close together are
aligned: words unique to both sides are anchors, the longest increasing
subsequence of them is kept, and the gaps between anchors are aligned the same
way.  Coverage is the share of the template's words that found a partner.

The place search is exact: coverage of at least `least` needs that share of the
template's words within `STRETCH` times its length.

Edge cases: null and empty texts hold nothing; a notice that occurs again is
reported again; repeated rows and null ids are scanned like others; other
columns are ignored; an empty table gives an empty result; very long texts are
read whole.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens as tk

STRETCH = 1.5

# The wording of common notices, as their licenses publish it.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}


def template_words(text: str) -> list[int]:
    return tk.words(pa.array([text]), tk.NOT_ALNUM, fold=True).hashes.tolist()


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, ordered by the first, whose second parts rise (patience sorting with back links)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        j = bisect.bisect_left(tops, b)
        back[i] = at[j - 1] if j else -1
        tops[j : j + 1] = [b]
        at[j : j + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched positions (text, template), rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = unique(text, a, b), unique(template, c, d)
        anchors = increasing(sorted((i, there[w]) for w, i in here.items() if w in there))
        if not anchors:
            continue
        out.extend(anchors)
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]))
    return sorted(out)


def unique(words: list[int], start: int, stop: int) -> dict[int, int]:
    """Word -> position of those that occur once in words[start:stop]."""
    seen: dict[int, int] = {}
    for i in range(start, stop):
        seen[words[i]] = -1 if words[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


def scan(words: np.ndarray, template: list[int], places: np.ndarray, least: float) -> list[tuple[float, int, int]]:
    """(coverage, first word, end word) of the notices in one document; `places` are words the template has."""
    need = max(1, math.ceil(least * len(template) - 1e-9))
    width = math.ceil(STRETCH * len(template))
    found, i = [], 0
    while i + need <= len(places):
        if places[i + need - 1] - places[i] >= width:
            i += 1
            continue
        start = int(places[i])
        pairs = align(words[start : start + width].tolist(), template)
        if len(pairs) < need:
            i += 1
            continue
        end = start + pairs[-1][0] + 1
        found.append((len(pairs) / len(template), start + pairs[0][0], end))
        i = int(np.searchsorted(places, end))
    return found


def notices(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.85) -> DataFrame:
    """(doc_id, license, variant, coverage, start, end): start and end are byte offsets in the UTF-8 text."""
    known = [(name, v, template_words(t)) for name, texts in (templates or TEMPLATES).items() for v, t in enumerate(texts)]
    known = [x for x in known if x[2]]

    def run(batches):
        vocabulary = np.unique(np.array([w for _, _, t in known for w in t], tk.U64))
        member = np.array([np.isin(vocabulary, np.array(t, tk.U64)) for _, _, t in known])
        for batch in batches:
            for rows in tk.slices(batch):
                w = tk.words(rows.column("text"), tk.NOT_ALNUM, fold=True)
                _, base = tk.raw(rows.column("text"))
                slot = np.minimum(np.searchsorted(vocabulary, w.hashes), len(vocabulary) - 1)
                hits = np.flatnonzero(vocabulary[slot] == w.hashes)
                edges = np.searchsorted(hits, w.first)
                out = []
                for d in np.flatnonzero(np.diff(edges)).tolist():
                    places = hits[edges[d] : edges[d + 1]]
                    first, stop = int(w.first[d]), int(w.first[d + 1])
                    terms = slot[places]
                    for j, (name, variant, template) in enumerate(known):
                        mine = places[member[j][terms]] - first
                        if len(mine) < least * len(template):
                            continue
                        for coverage, a, b in scan(w.hashes[first:stop], template, mine, least):
                            out.append((d, name, variant, coverage, int(w.starts[first + a] - base[d]), int(w.ends[first + b - 1] - base[d])))
                ids = rows.column("doc_id").take(pa.array([x[0] for x in out], pa.int64()))
                kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array([x[i + 1] for x in out], kind) for i, kind in enumerate(kinds)]],
                    names=["doc_id", "license", "variant", "coverage", "start", "end"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, license string, variant long, coverage double, start long, end long"
    )
