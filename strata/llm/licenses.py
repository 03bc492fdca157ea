"""License notices in texts, by patience alignment with templates.

Both sides are words (lower-cased letters and digits). A notice begins with a word
of the template so near its front that enough words are left after it; from each such
place of the text the longest common subsequence with the template is measured, up to
twice the template's length and at every end. Regions that have too few of the
template's words in whatever order are left out before. The end is where matched words
most outweigh the others. Regions that stay are aligned: words that are unique in both
are anchors, the longest increasing run of them is kept, and the gaps between are
aligned in the same way, down to gaps without an anchor, which are aligned in full if
they are small; where that matches fewer words than can be, the region is aligned in
full. Coverage is the share of the template's words that are matched.

A notice is reported if its coverage reaches ``COVERAGE``; where notices overlap the
one with more matched words stays, ties going to the shorter, the earlier and then to
the name first in order. Null and empty texts have none. Rows are looked at one by one; other
columns are not looked at. Texts are worked on where they are, nothing is shuffled.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.registry import load, registered
from strata.llm.tokens import slices

COVERAGE = 0.8
SMALL = 4096  # cells of a gap that is aligned in full
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

# Notices as their licenses word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
    "MIT": "Released under the MIT License.",
    "MIT-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.""",
    "ISC-notice": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-notice": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
}


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def aligned(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Matched positions of two word lists, increasing on both sides."""
    found: list[tuple[int, int]] = []
    waiting = [(0, len(left), 0, len(right))]
    while waiting:
        a, b, c, d = waiting.pop()
        while a < b and c < d and left[a] == right[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        anchors = _increasing(_anchors(left, a, b, right, c, d))
        if anchors:
            found += anchors
            for (x, y), (v, w) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
                waiting.append((x + 1, v, y + 1, w))
        elif (b - a) * (d - c) <= SMALL:
            found += [(a + i, c + j) for i, j in _common(left[a:b], right[c:d])]
    return sorted(found)


def _anchors(left, a, b, right, c, d) -> list[tuple[int, int]]:
    """Positions of the words that are there once on either side, in order of the left."""
    once: dict[str, list[int]] = {}
    for i in range(a, b):
        once.setdefault(left[i], [-1, -1, 0, 0])[0] = i
        once[left[i]][2] += 1
    for j in range(c, d):
        if right[j] in once:
            once[right[j]][1] = j
            once[right[j]][3] += 1
    return sorted((i, j) for i, j, n, m in once.values() if n == m == 1)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs whose right sides increase."""
    tops: list[int] = []
    chain: list[int] = []
    before: list[int] = []
    for at, (_, right) in enumerate(pairs):
        place = bisect.bisect_left(tops, right)
        before.append(chain[place - 1] if place else -1)
        tops[place : place + 1] = [right]
        chain[place : place + 1] = [at]
    kept, at = [], chain[-1] if chain else -1
    while at >= 0:
        kept.append(pairs[at])
        at = before[at]
    return kept[::-1]


def _common(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left) - 1, -1, -1):
        for j in range(len(right) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if left[i] == right[j] else max(best[i + 1][j], best[i][j + 1])
    found, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        if left[i] == right[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


class Template:
    """A template's words, and how many of them make a notice."""

    def __init__(self, words: list[str], coverage: float):
        self.words = words
        self.need = max(1, math.ceil(coverage * len(words) - 1e-9))
        self.times = Counter(words)
        self.least = len(self.times) - (len(words) - self.need)  # different words a text with a notice has
        self.front = set(words[: len(words) - self.need + 1])
        self.places = {word: sum(1 << i for i, w in enumerate(words) if w == word) for word in self.times}

    def starts(self, words: list[str]) -> list[int]:
        """Places where a notice can begin: words of the template's front with enough
        of its words, in whatever order, in the region that follows."""
        reach, found = 2 * len(self.words), []
        held = dict.fromkeys(self.times, 0)
        common = end = 0
        for start, word in enumerate(words):
            while end < min(start + reach, len(words)):
                if words[end] in held:
                    held[words[end]] += 1
                    common += held[words[end]] <= self.times[words[end]]
                end += 1
            if common >= self.need and word in self.front:
                found.append(start)
            if word in held:
                common -= held[word] <= self.times[word]
                held[word] -= 1
        return found

    def best(self, words: list[str], start: int) -> tuple[int, int]:
        """(matched words, end) of the notice that begins there, (0, start) without one.
        The longest common subsequence, a row of its table at a time as bits."""
        whole = (1 << len(self.words)) - 1
        rows, matched, best = whole, 0, (0, 0, start)
        for end in range(start, min(start + 2 * len(self.words), len(words))):
            place = self.places.get(words[end])
            if place is None:
                continue
            met = rows & place
            rows = ((rows + met) | (rows - met)) & whole
            now = len(self.words) - rows.bit_count()
            if now > matched:
                matched = now
                worth = 2 * matched - (end + 1 - start)
                if matched >= self.need and (not best[1] or worth >= best[0]):
                    best = worth, matched, end + 1
        return best[1:]


class Templates:
    def __init__(self, texts: dict[str, str], coverage: float):
        made = {name: words_of(text) for name, text in sorted(texts.items())}
        self.all = {name: Template(words, coverage) for name, words in made.items() if words}

    def notices(self, text: str) -> list[tuple[int, int, str, float]]:
        """(first word, end, license, coverage) in order; none overlap."""
        words = words_of(text)
        there = set(words)
        found = []
        for name, template in self.all.items():
            if len(template.times.keys() & there) < template.least:
                continue
            for start in template.starts(words):
                matched, end = template.best(words, start)
                if matched:
                    found.append((matched, start, end, name))
        kept: list[tuple[int, int, str, float]] = []
        for n, start, end, name in sorted(found, key=lambda f: (-f[0], f[2] - f[1], f[1], f[3])):
            if all(end <= a or start >= b for a, b, _, _ in kept):
                template = self.all[name].words
                matched = aligned(template, words[start:end])
                if len(matched) < n:
                    matched = _common(template, words[start:end])
                kept.append((start + matched[0][1], start + matched[-1][1] + 1, name, len(matched) / len(template)))
        return sorted(kept)


_NOTICES = "array<struct<start: long, end: long, license: string, coverage: double>>"


def scanned(documents: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id and its notices: first word, end, license, coverage."""
    known = Templates(TEMPLATES if templates is None else templates, coverage)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("coverage", pa.float64())]))
    fields = ("start", "end", "license", "coverage")

    def scan(batches):
        for batch in slices(batches):
            found = [[dict(zip(fields, n)) for n in known.notices(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "notices"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scan, f"doc_id long, notices {_NOTICES}")


@registered("op3_license_scan")
def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    found = scanned(load(spark, sf_dir, "documents"))
    written = F.transform("notices", lambda n: F.concat_ws(":", n["license"], n["start"].cast("string"), n["end"].cast("string")))
    return found.select(
        "doc_id",
        F.size("notices").cast("long").alias("n_notices"),
        F.array_join(written, ",").alias("notices"),
        F.coalesce(F.array_min(F.transform("notices", lambda n: n["coverage"])), F.lit(0.0)).alias("least_coverage"),
    )
