"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Words are cut at white space and marks, with A-Z lowered.  Of each template the runs of ``RUN`` words are hashed and
winnowed (the least hash of every ``WINDOW`` runs is kept); an inverted index leads from a fingerprint to templates
and places.  Every run of words of a text is looked up in it.  Hits of one template near one another are a candidate,
which is aligned with the template in a band around the hits' diagonal; a candidate is reported when at least
``least`` of the template's words are matched.

Templates are a fixed list or a parameter, not data that grows with the corpus.  Defined results: null or empty texts
match nothing; repeated rows are reported each; a null doc_id stays null; templates shorter than ``RUN`` words are
refused.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from staffloom.llm.common import WordHashes, columns_of, grams, raw

RUN, WINDOW = 3, 4
LEAST = 0.75
MARKS = b".,;:!?\"'()[]{}<>|*#/"

# Wordings of public licenses.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
}


def hasher() -> WordHashes:
    return WordHashes(lower=True, also=MARKS)


def winnow(runs: np.ndarray) -> np.ndarray:
    """Places of the runs that are least in some window of ``WINDOW`` runs (the last of equals)."""
    if len(runs) <= WINDOW:
        return np.arange(len(runs))
    views = np.lib.stride_tricks.sliding_window_view(runs, WINDOW)
    return np.unique(np.arange(len(views)) + WINDOW - 1 - views[:, ::-1].argmin(1))


class Index:
    """Inverted index of fingerprints: sorted hashes, with template and place of each."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.words = list(templates), [hasher()(t.encode())[0] for t in templates.values()]
        short = [n for n, w in zip(self.names, self.words) if len(w) < RUN]
        if short:
            raise ValueError(f"templates of fewer than {RUN} words: {short}")
        rows = [(h, t, p) for t, w in enumerate(self.words) for r in [grams(w, RUN)] for p in winnow(r).tolist() for h in [int(r[p])]]
        rows.sort()
        self.hashes = np.array([r[0] for r in rows], np.uint64)
        self.template, self.place = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Template, place in it and place in the text of every fingerprint met."""
        runs = grams(words, RUN)
        lo, hi = np.searchsorted(self.hashes, runs, "left"), np.searchsorted(self.hashes, runs, "right")
        at = np.flatnonzero(hi > lo)
        n = hi[at] - lo[at]
        entry = np.repeat(lo[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.template[entry], self.place[entry], np.repeat(at, n)


def banded_alignment(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> list[tuple[int, int]]:
    """Most matches of words in order, with text place minus template place within ``band`` of ``diagonal``."""
    width, n = 2 * band + 1, len(text)
    table = np.zeros((len(template) + 1, width + 1), np.int64)  # the last column stands for outside the band
    for i, word in enumerate(template):
        j = i + diagonal - band + np.arange(width)
        inside = (j >= 0) & (j < n)
        same = np.zeros(width, bool)
        same[inside] = text[j[inside]] == word
        row = np.maximum(table[i, :width] + same, np.append(table[i, 1:width], 0))
        table[i + 1, :width] = np.maximum.accumulate(row)
    i, c, matches = len(template), width - 1, []
    while i > 0 and c >= 0 and table[i, c] > 0:
        j = i - 1 + diagonal - band + c
        if c and table[i, c - 1] == table[i, c]:
            c -= 1
        elif c + 1 < width and table[i - 1, c + 1] == table[i, c]:
            i, c = i - 1, c + 1
        else:
            if table[i, c] > table[i - 1, c]:
                matches.append((i - 1, j))
            i -= 1
    return matches[::-1]


def find(words: np.ndarray, index: Index, least: float) -> list[tuple[str, float, int, int]]:
    """License, coverage, first word and end of every template found in a text."""
    template, place, at = index.hits(words)
    out = []
    for t in np.unique(template):
        pattern = index.words[t]
        mine = template == t
        diagonals = np.sort(at[mine] - place[mine])
        reach = max(4, len(pattern) // 4)
        for group in np.split(diagonals, np.flatnonzero(np.diff(diagonals) > reach) + 1):
            middle = int(group[len(group) // 2])
            lo = max(0, middle - reach)
            part = words[lo : middle + len(pattern) + reach]
            matches = banded_alignment(pattern, part, middle - lo, reach)
            if len(matches) >= least * len(pattern):
                out.append((index.names[t], len(matches) / len(pattern), lo + matches[0][1], lo + matches[-1][1] + 1))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """``doc_id, license, coverage, first_word, end_word`` of every license found."""
    index = Index(TEMPLATES if templates is None else templates)

    def look(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = hasher()
        for batch in it:
            rows = [(d, *f) for d, t in zip(batch["doc_id"].to_pylist(), raw(batch["text"])) for f in find(hashes(t)[0], index, least)]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "license", "coverage", "first_word", "end_word"])

    return columns_of(docs, doc_id="long", text="string").mapInArrow(
        look, "doc_id long, license string, coverage double, first_word long, end_word long"
    )
