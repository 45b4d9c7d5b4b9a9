"""License notices in texts: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are word sequences (letters and digits in lower case). Templates and documents are winnowed
alike: of every few consecutive hashes of a few words the smallest is a fingerprint, so that as many
words in a row as both hold make them share one. How many stay in a row at least, where the words that
``COVERAGE`` lets change and the words that the band lets come in are spread as badly as they can be,
follows from the template's length (``unbroken``): four from 136 words on, three from 46 on, else two
or one. It sets the words of a gram and the grams of a window (``shape``); where no more than two words
stay, there is nothing to choose from and every gram is a fingerprint. So no notice lacks one. An inverted
index leads from fingerprints to templates and places in them.
Fingerprints found in a document pair a template with a diagonal (place in the document less place
in the template); each diagonal whose stretch of the document holds enough of the template's
words, in any order, is a candidate, which is aligned with that stretch inside a band around the
diagonal: equal words count, gaps and replaced words don't. A candidate that covers ``COVERAGE`` of its template is reported with its share and span. Of reports
that overlap, the one with more equal words stays, then the one with the higher share, then the
template listed first, then the one with the shorter span.

The templates are a parameter of the caller; their number is checked against ``MAX_WORDS`` before
the index is sent to the executors.

Nulls, ties, repeats: null texts are empty and hold nothing; documents without a notice have no
row; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import batch_of, chunks, utf8
from .wordhash import ALPHANUMERIC, run_hashes, spans, word_hashes

#: Words of a gram at most.
GRAM = 3
COVERAGE = 0.8
#: Words by which an alignment may stray from its diagonal, at most; a third of the template's
#: words if those are fewer.
BAND = 8
#: Words of all templates together.
MAX_WORDS = 5_000_000

# Customary notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file"
        " except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to"
        " in writing, software distributed under the License is distributed on an AS IS BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files, to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute,"
        " sublicense, and/or sell copies of the Software"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of"
        " the GNU General Public License as published by the Free Software Foundation"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International"
        " License."
    ),
}

_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def hashes(text: str | None) -> np.ndarray:
    data = np.frombuffer(utf8((text or "").lower()), dtype=np.uint8)
    return word_hashes(data, *spans(data, ALPHANUMERIC))


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash (the last of equal ones) in every window of hashes, ascending;
    fewer hashes than a window are one window."""
    width = min(window, len(grams))
    if not width:
        return np.zeros(0, dtype=np.int64)
    backwards = np.lib.stride_tricks.sliding_window_view(grams, width)[:, ::-1]
    return np.unique(np.arange(len(backwards)) + width - 1 - backwards.argmin(axis=1))


def band_of(n: int) -> int:
    """A short notice gets a narrow band, or the next copy of it would lie inside."""
    return min(BAND, n // 3)


def unbroken(n: int, coverage: float) -> int:
    """Words in a row that any notice of a template of ``n`` words keeps, if it covers
    ``coverage`` and no more words come in than the band is wide."""
    equal = max(1, math.ceil(coverage * n - 1e-9))
    return -(-equal // (n - equal + band_of(n) + 1))


def shape(n: int, coverage: float) -> tuple[int, int]:
    """``(words of a gram, grams of a window)`` of a template of ``n`` words: any words that stay
    unbroken hold a whole window."""
    row = max(1, unbroken(n, coverage))
    gram = min(GRAM, row - 1) if row > 2 else row
    return gram, row - gram + 1


class Index:
    """Templates and the inverted index of their fingerprints."""

    def __init__(self, templates: Mapping[str, str], coverage: float = COVERAGE):
        self.names = list(templates)
        self.words = [hashes(t) for t in templates.values()]
        n = sum(map(len, self.words))
        if n > MAX_WORDS:
            raise ValueError(f"templates have {n} words; the index is sent to all executors")
        self.shapes = [shape(len(w), coverage) for w in self.words]
        #: By fingerprint and how it was winnowed: templates and places in them.
        self.places: dict[tuple[int, tuple[int, int]], list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            gram, window = self.shapes[t]
            grams = run_hashes(words, gram)
            for at in winnow(grams, window).tolist():
                self.places.setdefault((int(grams[at]), self.shapes[t]), []).append((t, at))
        self.known = np.array(sorted({h for h, _ in self.places}), dtype=np.uint64)


def align(template: list[int], words: list[int], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Most equal words of an alignment inside the band: ``(equal, first, last)``, places of the
    first and last equal word in ``words``. The band holds places ``i + diagonal ± band`` for word
    ``i`` of the template; ties prefer the alignment that begins later (is tighter)."""
    width = 2 * band + 1
    nothing = (0, 0, -1)
    # Best (equal, first, last) that ends at or before (template word, band column).
    above = [nothing] * (width + 1)
    for i, w in enumerate(template):
        row = [nothing] * (width + 1)
        for c in range(width):
            j = i + diagonal + c - band
            best = above[c + 1]  # template word left out: same j, column one to the right
            if c and row[c - 1][0] >= best[0] and row[c - 1] > best:
                best = row[c - 1]  # document word left out
            if 0 <= j < len(words) and words[j] == w:
                n, first, _ = above[c]
                match = (n + 1, first if n else j, j)
                if match[0] > best[0] or match[0] == best[0] and match[1] > best[1]:
                    best = match
            row[c] = best
        above = row
    return max(above, key=lambda r: (r[0], r[1]))


def notices(words: np.ndarray, index: Index, coverage: float = COVERAGE) -> list[tuple]:
    """``(template number, share, equal, first, last)`` of a document's words, in order."""
    found: dict[int, dict[int, int]] = {}
    for gram, window in set(index.shapes):
        grams = run_hashes(words, gram)
        chosen = winnow(grams, window)
        for j in chosen[np.isin(grams[chosen], index.known)].tolist():
            for t, i in index.places.get((int(grams[j]), (gram, window)), ()):
                found.setdefault(t, {})[j - i] = j
    reports = []
    for t, diagonals in found.items():
        template = index.words[t].tolist()
        band, own = band_of(len(template)), Counter(template)
        for d in sorted(diagonals):
            lo, hi = max(0, d - band), min(len(words), d + len(template) + band)
            stretch = words[lo:hi].tolist()
            held = Counter(w for w in stretch if w in own)
            if sum(min(n, own[w]) for w, n in held.items()) < coverage * len(template) - 1e-9:
                continue
            equal, first, end = align(template, stretch, d - lo, band)
            if equal >= coverage * len(template) - 1e-9:
                reports.append((t, equal / len(template), equal, first + lo, end + lo))
    reports.sort(key=lambda r: (-r[2], -r[1], r[0], r[4] - r[3], r[3]))
    kept: list[tuple] = []
    for r in reports:
        at = bisect(kept, r[3], key=lambda k: k[3])
        if (not at or kept[at - 1][4] < r[3]) and (at == len(kept) or r[4] < kept[at][3]):
            kept.insert(at, r)
    return kept


_FOUND = pa.schema(
    [("license", pa.string()), ("coverage", pa.float64()), ("n_equal", pa.int64()),
     ("start", pa.int64()), ("end", pa.int64())]
)


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, license, coverage, n_equal, start, end)``: notices with the share of the template
    that they cover, and their spans in code points (end exclusive)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = slim.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(Index(templates, coverage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        lengths = {gram for gram, _ in index.shapes}
        for batch in batches:
            owners: list[int] = []
            rows: dict[str, list] = {f.name: [] for f in _FOUND}
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                parts = [utf8((t or "").lower()) for t in texts[lo:hi]]
                data = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
                starts, ends = spans(data, ALPHANUMERIC)
                words = word_hashes(data, starts, ends)
                first = np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for p in parts]))
                hot = np.zeros(len(words) + 1, dtype=bool)
                for k in lengths:
                    grams = run_hashes(words, k)
                    hot[1 : len(grams) + 1] |= np.isin(grams, index.known)
                upto = np.cumsum(hot)
                for i in np.flatnonzero(upto[first[1:]] > upto[first[:-1]]).tolist():
                    text = texts[lo + i]
                    places = None
                    for t, share, equal, a, b in notices(words[first[i] : first[i + 1]], index, coverage):
                        places = places or [m.span() for m in _WORD.finditer(text)]
                        owners.append(lo + i)
                        rows["license"].append(index.names[t])
                        rows["coverage"].append(share)
                        rows["n_equal"].append(equal)
                        rows["start"].append(places[a][0])
                        rows["end"].append(places[b][1])
            out = batch_of(_FOUND, **rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owners, pa.int64())), *out.columns],
                names=["doc_id", *_FOUND.names],
            )

    return slim.mapInArrow(
        run, f"doc_id {ids}, license string, coverage double, n_equal long, start long, end long"
    )
