"""License scans: winnowed fingerprints find candidates, banded alignment reports coverage and spans.

Fingerprints of a template are the smallest hash of every few consecutive
3-word windows. All 3-word windows of a text are looked up in the inverted
index of fingerprints, so a text that has one is found wherever it stands. Of
templates of fewer than 16 words, where a few changed words can break all windows,
single words are looked up as well: as many as a match may lack, and one more. Hits
of a template whose places differ by about the same number are one candidate;
there the template is aligned with the words of the text in a band around that
difference, which allows for changed, missing and added words. The band grows
with the template. Before that, two counts rule out places where even equal
words in any order would not reach the coverage; no other place is left out.

Templates are whole licence texts and file headers (``license_texts.txt``), one-line
notices, and the openings of three licences, which stand alone in cut texts.

The index has a few entries per template word; its size is checked before it
goes to all tasks. Texts are scanned where they lie: nothing is shuffled.

Defined results: words are runs of letters, digits and apostrophes, A-Z taken as
a-z; null and empty texts have no matches; of overlapping matches of a template the
one with the highest coverage stays, ties to the earlier; the opening of a licence
is not reported inside a match of its whole text. Each licence is matched for
itself, so a text may match related ones too, each with its own coverage.
"""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_right
from typing import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from nestfold.llm import text as T
from nestfold.llm.base import query, table
from nestfold.llm.quality_rules import STOP_WORDS
from nestfold.llm.toxicity import _BREAKS
from nestfold.session import ship_package

#: Notices as they stand in files; ids follow the usual short names.
NOTICES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
}
#: First words of a licence, and the whole texts that begin with them.
OPENINGS = {
    "MIT-opening": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction"),
    "Apache-2.0-opening": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"),
    "BSD-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
}
WHOLE = {
    "MIT-opening": ("MIT", "NCSA", "Unicode-3.0"), "Apache-2.0-opening": ("Apache-2.0", "Apache-2.0-header"),
    "BSD-opening": ("BSD-2-Clause", "BSD-3-Clause"),
}


def _texts() -> dict[str, str]:
    """Whole licence texts and headers by name; each begins with a line of its name and source."""
    whole = pkgutil.get_data(__package__, "license_texts.txt").decode()
    parts = re.split(r"^%% (\S+) \| .*\n", whole, flags=re.M)
    return dict(zip(parts[1::2], parts[2::2]))


TEMPLATES = NOTICES | OPENINGS | _texts()
SIZE, WINDOW = 3, 3  # words of a fingerprint, fingerprints of which one is kept
BAND = 6  # words that may be missing or added, or a tenth of the template if that is more
COVERAGE = 0.8
SHORT = 16  # words; a few changed words may break all fingerprints of a shorter template
MAX_FINGERPRINTS = 1_000_000
_MATCHES = "id long, license string, begin_word int, end_word int, begin_char int, end_char int, matched int, coverage double"


def _hashes(data: np.ndarray, offsets: np.ndarray):
    starts, ends, words = T.word_spans(data, offsets, _BREAKS)
    return T.span_hashes(data, starts, ends, lower=True), starts, ends, words


def _windows(h: np.ndarray) -> np.ndarray:
    rolled = h
    for step in range(1, SIZE):
        rolled = T.pair_hashes(rolled[:-1], h[step:]) if len(rolled) else rolled
    return rolled


def fingerprints(templates: Mapping[str, str]) -> tuple[list[str], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Names, word hashes, and the index: sorted fingerprints with template number and place."""
    names, words, entries = [], [], []
    for number, (name, text) in enumerate(templates.items()):
        data = np.frombuffer(text.encode(), np.uint8)
        h, _, _, _ = _hashes(data, np.array([0, len(data)]))
        if len(h) < SIZE:
            raise ValueError(f"template {name} has fewer than {SIZE} words")
        names.append(name)
        words.append(h)
        grams = _windows(h)
        for at in range(max(1, len(grams) - WINDOW + 1)):
            place = at + int(np.argmin(grams[at:at + WINDOW]))
            entries.append((int(grams[place]), number, place))
    entries = sorted(set(entries))
    if len(entries) > MAX_FINGERPRINTS:
        raise ValueError(f"{len(entries)} fingerprints are too many to send to every task")
    h, number, place = zip(*entries)
    return names, words, np.array(h, np.uint64), np.array(number), np.array(place)


def telling_words(text: str, coverage: float = COVERAGE) -> list[int]:
    """Places of words of which every match of the coverage has at least one: the longest that are no stop words first."""
    data = np.frombuffer(text.encode(), np.uint8)
    _, starts, ends, _ = _hashes(data, np.array([0, len(data)]))
    words = [text.encode()[a:b].decode().lower() for a, b in zip(starts.tolist(), ends.tolist())]
    n_missing = int(len(words) - coverage * len(words) + 1e-9)  # words that a match may lack
    return sorted(range(len(words)), key=lambda i: (words[i] in STOP_WORDS, -len(words[i]), i))[:n_missing + 1]


def word_index(templates: Mapping[str, str], coverage: float = COVERAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The telling words of short templates: sorted hashes with template number and place."""
    entries = []
    for number, text in enumerate(templates.values()):
        data = np.frombuffer(text.encode(), np.uint8)
        h, _, _, _ = _hashes(data, np.array([0, len(data)]))
        if len(h) < SHORT:
            told = {int(h[i]) for i in telling_words(text, coverage)}
            entries += [(int(x), number, i) for i, x in enumerate(h) if int(x) in told]
    h, number, place = zip(*sorted(entries)) if entries else ((), (), ())
    return np.array(h, np.uint64), np.array(number, np.int64), np.array(place, np.int64)


def _found(values: np.ndarray, prints: np.ndarray, number: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, template, place in it) of all values that are in an index."""
    low, high = np.searchsorted(prints, values), np.searchsorted(prints, values, "right")
    hits = np.flatnonzero(high > low)
    n = (high - low)[hits]
    entry = np.repeat(low[hits] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(hits, n), number[entry], place[entry]


def band_of(template: np.ndarray) -> int:
    return max(BAND, len(template) // 10)


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched, begin, end): the best alignment of the template around ``words[shift:]``.

    Cell (i, j) pairs template word i with text word j; |j - i - shift| <= band. A
    match counts 2, a changed, missing or added word -1; text before and after is free.

    A cell is one number, whose order is that of (score, matched, -begin).
    """
    n, width, have = len(template), 2 * band + 1, len(words)
    one, low = 1 << 44, -(1 << 62)
    match, slope = 2 * one + (1 << 30), np.arange(width) * one
    first = shift - band  # text words before cell 0 of row 0
    near = np.zeros(n + width, np.uint64)  # the words of all cells
    real = np.ones(n + width, bool)
    a, b = min(max(0, -first), n + width), max(0, min(n + width, have - first))
    near[a:b] = words[first + a:first + b] if a < b else 0
    real[a:b] = False
    cell = np.full(width + 1, low, np.int64)  # the last stands for what is right of the band
    begin = first + np.arange(width)
    cell[:-1] = np.where((begin >= 0) & (begin <= have), -begin, low)
    for i in range(1, n + 1):
        same = (near[i - 1:i - 1 + width] == template[i - 1]) & ~real[i - 1:i - 1 + width]
        row = np.maximum(cell[:-1] + np.where(same, match, -one), cell[1:] - one)
        left, right = -(i + first), have - (i + first) + 1  # cells from left up to right lie in the text
        if left > 0:
            row[:left] = low
        row = np.maximum.accumulate(row + slope) - slope  # words added in the text
        if right < width:
            row[max(0, right):] = low
        cell[:-1] = row
    cell = cell[:-1]
    score = np.where(cell > low // 2, -(-cell >> 30) >> 14, low)
    k = int(score.argmax())
    if score[k] == low:
        return 0, 0, 0
    return -(-int(cell[k]) >> 30) & ((1 << 14) - 1), -int(cell[k]) & ((1 << 30) - 1), n + shift + k - band


def possible(template: np.ndarray, words: np.ndarray, shifts: np.ndarray, coverage: float) -> np.ndarray:
    """Which shifts can reach the coverage, judged by counts that no alignment in the band exceeds."""
    n, band = len(template), band_of(template)
    low, high = np.clip(shifts - band, 0, len(words)), np.clip(shifts + n + band, 0, len(words))
    good = high - low >= coverage * n
    if good.any():  # words of the text that the template has
        known = np.concatenate([[0], np.cumsum(np.isin(words, template))])
        good &= known[high] - known[low] >= coverage * n
    for k in np.flatnonzero(good):  # words of the template that the text has there
        good[k] = np.isin(template, words[low[k]:high[k]]).sum() >= coverage * n
    return good


def _matches(template: np.ndarray, own: np.ndarray, places: list[int], coverage: float) -> list[tuple[int, int, int]]:
    """(begin, end, matched) of the matches of one template around the given shifts, without overlaps.

    Shifts that found a match search what is left beside the matches kept, until nothing more is found.
    """
    n, band, least = len(template), band_of(template), coverage * len(template)
    places = np.array(places)
    todo, last = [], None
    for shift in places[possible(template, own, places, coverage)].tolist():
        if last is not None and shift - last <= min(band // 2, n - 1):
            continue  # the band of the shift before covers this one
        todo.append(shift)
        last = shift
    kept: list[tuple[int, int, int]] = []  # in the order of the text
    while todo:
        found, again = set(), []
        for shift in todo:
            low, high = max(0, shift - band), min(len(own), shift + n + band)
            near = [k for k in kept[max(0, bisect_right(kept, (low,)) - 1):bisect_right(kept, (high,))] if k[1] > low]
            hit = False
            for a, b in zip([low, *[k[1] for k in near]], [*[k[0] for k in near], high]):
                if b - a >= least:
                    matched, begin, end = align(template, own[a:b], shift - a, band)
                    if matched >= least:
                        found.add((a + begin, a + end, matched))
                        hit = True
            if hit:
                again.append(shift)
        new: list[tuple[int, int, int]] = []
        for match in sorted(found, key=lambda m: (-m[2], m[0])):
            k = bisect_right(new, match)
            if (not k or new[k - 1][1] <= match[0]) and (k == len(new) or match[1] <= new[k][0]):
                new.insert(k, match)
        kept, todo = sorted(kept + new), again
    return kept


def _scan(index, telling, coverage: float):
    def run(batches):
        names, templates, *prints = index
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in T.chunks(T.column(batch, "text")):
                h, starts, ends, words = _hashes(data, offsets)
                shifts: dict[tuple[int, int], set[int]] = {}
                for values, size, entries in ((_windows(h), SIZE, prints), (h, 1, telling)):
                    hits, which, place = _found(values, *entries)
                    owner = np.searchsorted(words, hits, "right") - 1
                    inside = hits + size <= words[owner + 1]
                    for doc, template, shift in zip(*(x[inside].tolist() for x in (owner, which, hits - words[owner] - place))):
                        shifts.setdefault((doc, template), set()).add(shift)
                kept: list[tuple] = []
                for (doc, which), places in sorted(shifts.items()):
                    own = h[words[doc]:words[doc + 1]]
                    kept += [(doc, which, *m, m[2] / len(templates[which])) for m in _matches(templates[which], own, sorted(places), coverage)]
                spans: dict[tuple[int, str], list] = {}
                for m in kept:
                    spans.setdefault((m[0], names[m[1]]), []).append(m[2:4])
                kept = sorted(m for m in kept if not any(
                    a <= m[2] and m[3] <= b for whole in WHOLE.get(names[m[1]], ()) for a, b in spans.get((m[0], whole), ())))
                chars = lambda doc, byte: int(((data[offsets[doc]:byte] & 0xC0) != 0x80).sum())
                columns = [
                    [ids[row + m[0]].as_py() for m in kept], [names[m[1]] for m in kept], [m[2] for m in kept], [m[3] for m in kept],
                    [chars(m[0], starts[words[m[0]] + m[2]]) for m in kept],
                    [chars(m[0], ends[words[m[0]] + m[3] - 1]) for m in kept], [m[4] for m in kept], [m[5] for m in kept]]
                kinds = [pa.int64(), pa.string(), *[pa.int32()] * 5, pa.float64()]
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["id", "license", "begin_word", "end_word", "begin_char", "end_char", "matched", "coverage"])
    return run


def scan(
    df: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """A row per match: the license, its span in words and characters, matched words and their share."""
    ship_package(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scan(fingerprints(templates), word_index(templates, coverage), coverage), _MATCHES)


@query("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices, headers and whole texts in all documents."""
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
