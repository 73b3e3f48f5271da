"""License scans: winnowed fingerprints pick candidates in an inverted index of templates, banded alignment reports coverage and spans.

Texts and templates are words in lower case (letters, marks, numbers); every GRAM words in a row have a hash, and of every WINDOW hashes in a row
the smallest (the last of equals) is a fingerprint. A run of GRAM + WINDOW - 1 words that a text shares with a template so has a common fingerprint.
Of templates so short that MIN_COVERAGE can be reached without such a run every two words in a row are fingerprints instead.
The index leads from fingerprint to places in templates. Hits of one template whose diagonals (place in the text less place in the template) lie
within BAND of each other and that are no further apart than the template is long make a region, of as many diagonals as the template has words at most; there the
template is aligned with the text's words inside a band around the hits' diagonals: a match counts 1, a differing or missing or extra word -0.5. Of the template's words that
match in the best alignment the share is the coverage; the span runs from the first matched word to the last, in characters of the text.

A region of fewer hits than one for every SPARSE words of its template is not aligned: a text that has MIN_COVERAGE of a template has more, unless hardly four words
in a row agree. For short templates it has to have as many hits as MIN_COVERAGE implies, less two for words put in.

Findings under MIN_COVERAGE are left out, and of findings that overlap only the best stays: of templates of LONG words or more (texts and headers, in which
headers and notices are) the one with most words, then most coverage; else the one with most coverage, then most words; then the smaller name. Null, empty and
wordless texts have no findings; repeats within a text are findings each, repeated rows have the same ones; an empty table gives an empty table; texts of any length are read whole. Templates are a parameter: name -> text; by
default the texts and headers in license_texts and the short notices here.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator, Mapping
from itertools import takewhile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, prepare, q, texts_of, without
from .minhash import shingle_hashes, word_characters

GRAM, WINDOW, BAND, MIN_COVERAGE = 3, 2, 6, 0.8
LONG, SPARSE = 60, 50
#: Short notices as authors put them into texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
KIND = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32())]))
SQL_KIND = "array<struct<license:string,coverage:double,matched_words:int,start_char:int,end_char:int>>"


def full_templates() -> dict[str, str]:
    """Full license texts ("MIT text"), standard headers and short notices. Read on the driver; executors get them with the task."""
    found = {p.stem: p.read_text() for p in (Path(__file__).parent / "license_texts").glob("*.txt")}
    return TEMPLATES | {name if name.endswith(" header") else f"{name} text": text for name, text in found.items()}


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the fingerprints of one text."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(view)) + window - 1 - view.argmin(1))


def words_of(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lower-cased words, and where each starts and ends in the text."""
    low = text.lower()
    inside = word_characters()[np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    first, past = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = [low[a:b] for a, b in zip(first, past, strict=True)]
    if len(low) != len(text):  # some letters become two
        ends = np.cumsum([len(c.lower()) for c in text])
        first, past = np.searchsorted(ends, first, "right"), np.searchsorted(ends, past - 1, "right") + 1
    return words, first, past


def align(template: list[str], words: list[str], low: int, high: int) -> tuple[int, int, int]:
    """The best alignment of a template with words on diagonals low..high: matched words, and the first and last matched place (-1 if none)."""
    numbers = {w: i for i, w in enumerate(template)}
    width = high - low + 1
    begin = min(max(0, low), len(words))
    text = np.full(len(template) + width, -1)  # the words from place `low` on; -1 where there is none or it is in no template
    here = words[begin : max(begin, low + len(text))]
    text[begin - low : begin - low + len(here)] = [numbers.get(w, -1) for w in here]
    column, cost = np.arange(width), 0.5 * np.arange(width)
    score, best = np.zeros(width), (0, 0.0, -1, -1)
    kept = np.stack([np.zeros(width, np.int64), np.full(width, -1), np.full(width, -1)])  # matched, first, last
    for i, word in enumerate(template):
        equal = text[i : i + width] == numbers[word]
        above, held = score, kept
        score, kept, place = np.where(equal, above + 1, above - 0.5), held.copy(), i + low + column
        kept[0] += equal
        kept[1] = np.where(equal & (kept[1] < 0), place, kept[1])
        kept[2] = np.where(equal, place, kept[2])
        missing = np.flatnonzero(above[1:] - 0.5 > score[:-1])  # the template's word is missing
        score[missing], kept[:, missing] = above[missing + 1] - 0.5, held[:, missing + 1]
        level = score + cost  # words more in the text: the best to the left
        source = np.maximum.accumulate(np.where(level >= np.maximum.accumulate(level), column, 0))
        score, kept = level[source] - cost, kept[:, source]
        none = (score <= 0) & (kept[0] == 0)
        score[none], kept[1:, none] = 0.0, -1
        most = int(kept[0].max())
        if most >= best[0]:
            at = int(np.where(kept[0] == most, score, -np.inf).argmax())
            best = max(best, (most, float(score[at]), int(kept[1, at]), int(kept[2, at])), key=lambda x: x[:2])
    return best[0], best[2], best[3]


def misses(n: int, min_coverage: float) -> int:
    """How many of n words may fail to match."""
    return n - int(np.ceil(min_coverage * n - 1e-9))


class Library:
    """Templates and the inverted indexes of their fingerprints: of short ones every two words, of others winnowed runs of GRAM words."""

    def __init__(self, templates: Mapping[str, str], min_coverage: float = MIN_COVERAGE):
        self.names, self.min_coverage = sorted(templates), min_coverage
        self.words = [words_of(templates[n])[0] for n in self.names]
        self.needs = [0] * len(self.names)
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = {2: {}, GRAM: {}}
        for t, words in enumerate(self.words):
            n, lost = len(words), misses(len(words), min_coverage)
            short = n > 1 and -(-(n - lost) // (lost + 1)) < GRAM + WINDOW - 1
            own = shingle_hashes([templates[self.names[t]]], 2 if short else GRAM)[0]
            self.needs[t] = max(1, n - 2 * lost - 3) if short else max(1, n // SPARSE)
            for j in range(len(own)) if short else winnow(own).tolist():
                self.places[2 if short else GRAM].setdefault(int(own[j]), []).append((t, j))
        self.keys = {gram: np.array(sorted(places), np.uint64) for gram, places in self.places.items()}

    def scan(self, texts: list[str]) -> list[list[dict]]:
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for gram, keys in self.keys.items():
            hashes, starts = shingle_hashes(texts, gram)
            if not len(keys) or not len(hashes):
                continue
            hit = keys[np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)] == hashes
            for t in np.unique(np.searchsorted(starts, np.flatnonzero(hit), "right") - 1).tolist():
                own, own_hit = hashes[starts[t] : starts[t + 1]], hit[starts[t] : starts[t + 1]]
                found = [p for p in (winnow(own) if gram == GRAM else np.flatnonzero(own_hit)).tolist() if own_hit[p]]
                hits.setdefault(t, []).extend((name, p, j) for p in found for name, j in self.places[gram][int(own[p])])
        return [self.findings(text, hits[t]) if t in hits else [] for t, text in enumerate(texts)]

    def regions(self, name: int, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The lowest and highest diagonals of regions with hits enough; hits are (place in the text, place in the template)."""
        n = len(self.words[name])
        out: list[list[int]] = []  # lowest and highest diagonal, last place, hits
        for p, d in sorted((p, p - j) for p, j in hits):
            recent = takewhile(lambda r: p - r[2] <= 2 * n + BAND, reversed(out))
            near = next((r for r in recent if p - r[2] <= n and r[0] - BAND <= d <= r[1] + BAND and max(r[1], d) - min(r[0], d) <= n), None)
            if near:
                near[:] = min(near[0], d), max(near[1], d), p, near[3] + 1
            else:
                out.append([d, d, p, 1])
        return [(low, high) for low, high, _, count in out if count >= self.needs[name]]

    def findings(self, text: str, hits: list[tuple[int, int, int]]) -> list[dict]:
        by_name: dict[int, list[tuple[int, int]]] = {}
        for name, p, j in hits:
            by_name.setdefault(name, []).append((p, j))
        regions = [(name, low, high) for name in sorted(by_name) for low, high in self.regions(name, by_name[name])]
        if not regions:
            return []
        words, first_char, past_char = words_of(text)
        own = []
        for name, low, high in regions:
            template = self.words[name]
            matched, first, last = align(template, words, low - BAND, high + BAND)
            coverage = matched / len(template)
            if first >= 0 and coverage >= self.min_coverage:
                order = (0, -matched, -coverage) if len(template) >= LONG else (1, -coverage, -matched)
                own.append((order, name, first, last, coverage, matched))
        starts: list[int] = []  # of the spans taken so far, which do not overlap, in order
        ends: list[int] = []
        out = []
        for _, name, first, last, coverage, matched in sorted(set(own)):
            at = bisect(starts, first)
            if not (at and ends[at - 1] >= first or at < len(starts) and starts[at] <= last):
                starts.insert(at, first)
                ends.insert(at, last)
                out.append({"license": self.names[name], "coverage": coverage, "matched_words": matched, "start_char": int(first_char[first]), "end_char": int(past_char[last])})
        return sorted(out, key=lambda f: (f["start_char"], f["license"]))


def scan(df: DataFrame, text: str = "text", templates: Mapping[str, str] | None = None, min_coverage: float = MIN_COVERAGE, out: str = "licenses") -> DataFrame:
    """df with an array of findings, by place: license, coverage, matched_words, start_char, end_char (past the last). A column of that name is replaced. No shuffle."""
    prepare(df.sparkSession)
    templates = full_templates() if templates is None else dict(templates)
    library: list[Library] = []

    @F.arrow_udf(SQL_KIND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not library:
            library.append(Library(templates, min_coverage))
        for batch in batches:
            yield pa.array([x for piece in pieces(batch) for x in library[0].scan(texts_of(piece))], KIND)

    tmp = "_quill_licenses"  # not deterministic in name only: else a filter on the findings would scan every text twice
    rows = df.withColumn(tmp, found.asNondeterministic()(q(text)))
    return without(rows, out).withColumnRenamed(tmp, out)
