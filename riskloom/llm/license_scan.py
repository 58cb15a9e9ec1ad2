"""License scans by patience alignment.

A template and a region of a text are aligned on words that are unique in both: of these anchors the
longest run that ascends in both stays, common words grow out from each anchor, and the gaps between
anchors are aligned again by themselves, where more words are unique. Coverage is the share of the
template's words that are aligned.

Every word of every text is screened first: a region is a stretch of lines that hold telling words
of some template (its words without the common ones). Copies of a notice in one region leave no word unique, so
a region is not aligned as a whole: windows a little wider than a notice may be move over it, and
those that share enough words with a template are aligned with it, each copy by itself.

Defined cases: a null or empty text has no region; a template without words never matches; a notice
that is found several times in a text gives one row with the number of places, which do not overlap, and the best
coverage; rows that repeat a doc_id are reported once a row.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import chunks, small_batches, table, text_bytes
from riskloom.llm.pretokens import HashIndex
from riskloom.llm.words import words_of

LEAST_COVERAGE = 0.8
SPREAD = 1.5  # words of text that a word of the template may take
STEPS = 8  # windows begin at so many places of a template's length
LINE_GAP = 2  # lines without telling words inside a region

# Words that tell nothing of a licence.
COMMON = """a all an and any are as at be but by can do for free from have if in is it its may more no not of on or other
our out so such terms that the their there these they this to was we will with without work you your"""

# Notices and licence texts, as published.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-text": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
more details.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "proprietary": "All rights reserved.",
}


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by their first places, that ascends in the second as well."""
    tops: list[int] = []
    heads: list[int] = []
    before: list[int] = []
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        before.append(heads[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            heads.append(k)
        else:
            tops[pile], heads[pile] = b, k
    out, k = [], heads[-1] if heads else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of aligned equal words, ascending in both."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = _ascending([(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        stack += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def densest(pairs: list[tuple[int, int]], width: float) -> list[tuple[int, int]]:
    """Most pairs that lie within ``width`` words of the text: a notice stands together."""
    best, first = (0, 0), 0
    for k, (_, b) in enumerate(pairs):
        while b - pairs[first][1] + 1 > width:
            first += 1
        if k + 1 - first > best[1] - best[0]:
            best = first, k + 1
    return pairs[best[0] : best[1]]


class Scanner:
    """Templates ready to scan with."""

    def __init__(self, templates: dict[str, str], least: float = LEAST_COVERAGE) -> None:
        self.names, self.least = list(templates), least
        self.words = [words_of(*text_bytes(pa.array([t]))).hashes.tolist() for t in templates.values()]
        self.bags = [Counter(words) for words in self.words]
        self.sets = [np.array(sorted(bag), np.uint64) for bag in self.bags]
        common = set(words_of(*text_bytes(pa.array([COMMON]))).hashes.tolist())
        # A template that is covered far enough shows at least so many telling words; all words
        # of a template tell where too few others would be left to be sure of one.
        self.fewest, telling = max([1, *map(len, self.words)]), set()
        for words in filter(None, self.words):
            own = [w for w in words if w not in common]
            spare = len(words) - math.ceil(least * len(words))
            own = own if len(own) > spare else words
            self.fewest = min(self.fewest, max(1, len(own) - spare))
            telling |= set(own)
        self.telling = HashIndex(10)
        self.telling.add(np.array(sorted(telling), np.uint64), np.arange(len(telling)))

    def told(self, hashes: np.ndarray) -> np.ndarray:
        """Which words tell of some template."""
        return self.telling.find(hashes) >= 0

    def scan(self, text: bytes, hashes: np.ndarray, starts: np.ndarray) -> dict[int, tuple[float, int]]:
        """Template to (best coverage, places) of one text, given its words and their byte places."""
        told = self.told(hashes)
        upto = np.r_[0, np.cumsum(told)]
        found: dict[int, tuple[float, int]] = {}
        breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
        line = np.searchsorted(breaks, starts)
        lines = np.unique(line[told])
        for region in np.split(lines, np.flatnonzero(np.diff(lines) > LINE_GAP + 1) + 1):
            if not len(region):
                continue
            a, b = np.searchsorted(line, [region[0], region[-1] + 1]).tolist()
            if upto[b] - upto[a] < self.fewest:
                continue
            for template, coverage, places in self.covered(hashes[a:b]):
                best, seen = found.get(template, (0.0, 0))
                found[template] = (max(best, coverage), seen + places)
        return found

    def covered(self, hashes: np.ndarray) -> Iterator[tuple[int, float, int]]:
        """Templates that a region covers: number, best coverage, places."""
        known, number = np.unique(hashes, return_inverse=True)
        words = hashes.tolist()
        for k, template in enumerate(self.words):
            need = self.least * len(template)
            own = np.isin(known, self.sets[k])[number]
            # No alignment is longer than the words both have.
            if not template or own.sum() < need:
                continue
            width = int(SPREAD * len(template) + 1)
            step = max(1, len(template) // STEPS)
            upto = np.r_[0, np.cumsum(own)]
            # Any ``width`` words lie in one window.
            starts = np.arange(0, len(words), step)
            ends = np.minimum(starts + width + step - 1, len(words))
            shared = upto[ends] - upto[starts]
            best, places, free = 0, 0, 0
            for a, b in zip(starts[shared >= need].tolist(), ends[shared >= need].tolist(), strict=True):
                a = max(a, free)
                pairs = self.aligned(k, words, a, b, width)
                if len(pairs) < need:
                    continue
                # Once more from where the notice begins, as the window may end inside it.
                first = a + pairs[0][1]
                again = self.aligned(k, words, first, min(first + width, len(words)), width)
                if len(again) >= len(pairs):
                    a, pairs = first, again
                best, places, free = max(best, len(pairs)), places + 1, a + pairs[-1][1] + 1
            if places:
                yield k, best / len(template), places

    def aligned(self, k: int, words: list[int], a: int, b: int, width: int) -> list[tuple[int, int]]:
        """Pairs of template ``k`` and words [a, b) that stand together; none where too few words are shared."""
        bag, need = Counter(words[a:b]), self.least * len(self.words[k])
        if sum(min(n, bag[w]) for w, n in self.bags[k].items()) < need:
            return []
        return densest(patience(self.words[k], words[a:b]), width)


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, license, coverage, places: every notice of every row that is covered far enough."""
    small_batches(docs.sparkSession)
    scanner = Scanner(templates, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            doc = batch.column("doc_id").to_pylist()
            out = []
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                own = data[part[0] : part[-1]]
                words = words_of(part - part[0], own)
                told = np.r_[0, np.cumsum(scanner.told(words.hashes))]
                for t in np.flatnonzero(np.diff(told[words.first]) >= scanner.fewest).tolist():
                    low, high = int(words.first[t]), int(words.first[t + 1])
                    x, y = int(part[t] - part[0]), int(part[t + 1] - part[0])
                    made = scanner.scan(own[x:y].tobytes(), words.hashes[low:high], words.starts[low:high] - x)
                    out += [(doc[a + t], scanner.names[k], c, n) for k, (c, n) in made.items()]
            columns = [list(x) for x in zip(*out, strict=True)] if out else [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64())
            names = ("doc_id", "license", "coverage", "places")
            yield pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, license string, coverage double, places long")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents, whole texts."""
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {"op10_license_scan": op10_license_scan}
SQL: dict[str, str] = {}
