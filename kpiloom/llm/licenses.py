"""Licence scans: word bigrams of windows of texts against licence templates.

A text is normalised to words of letters and digits. A window of its words
matches a template when the Dice coefficient of their sets of word bigrams
reaches the threshold t, wherever it stands: within a line, wrapped over lines,
or inside a long file. Sets of sizes a and b can reach t only if
t / (2 - t) <= a / b <= (2 - t) / t. So a template is dropped for a text that
holds too few of its bigrams, a start that too few of them follow is skipped, and
a window ends where its set grows too large. A window may have up to (2 - t) / t
times the template's words. One that starts or ends with a foreign bigram is
never better than without it, so windows run from one of the template's bigrams
to another.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import filled

#: Notices, standard headers and texts of licences by their SPDX names.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY-4.0": ("This work is licensed under the Creative Commons Attribution 4.0 International License.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.",
    ),
    "MPL-2.0": (
        "This work is subject to the terms of the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
}

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\W_]+")

Pair = tuple[str, str]


def bigrams(text: str) -> list[Pair]:
    """Adjacent words of letters and digits, A-Z lower-cased, in order."""
    words = _WORD.findall(text.translate(_LOWER))
    return list(zip(words, words[1:]))


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Smallest and largest set that can reach the threshold with one of ``size``."""
    ratio = (2 - threshold) / threshold
    return max(1, math.ceil(size / ratio - 1e-9)), math.floor(size * ratio + 1e-9)


class Scanner:
    """Templates under each of their bigrams."""

    def __init__(self, templates: Mapping[str, Sequence[str]], threshold: float):
        self.threshold = threshold
        self.listed = []  # license, number in it, set size, smallest and largest set, longest window
        self.holders: dict[Pair, list[int]] = {}
        for name, texts in templates.items():
            for number, text in enumerate(texts):
                pairs = bigrams(text)
                for pair in set(pairs):
                    self.holders.setdefault(pair, []).append(len(self.listed))
                least, most = size_bounds(len(set(pairs)), threshold)
                longest = math.floor((len(pairs) + 1) * (2 - threshold) / threshold + 1e-9) - 1
                self.listed.append((name, number, len(set(pairs)), least, most, longest))

    def best(self, text: str) -> dict[str, tuple[float, int, int, int]]:
        """Per licence found: Dice, template, first word and words of its best window."""
        pairs = bigrams(text)
        places: dict[int, list[int]] = {}
        for i, pair in enumerate(pairs):
            for t in self.holders.get(pair, ()):
                places.setdefault(t, []).append(i)
        found: dict[str, tuple[float, int, int, int]] = {}
        for t in sorted(places):
            window = self._window(pairs, places[t], t)
            name, number = self.listed[t][:2]
            if window and (name not in found or window[0] > found[name][0]):
                found[name] = (window[0], number, *window[1:])
        return found

    def _window(self, pairs: list[Pair], places: list[int], t: int) -> tuple[float, int, int] | None:
        """Best window of one template: the largest Dice, then the first start, then the fewest words."""
        _, _, size, least, most, longest = self.listed[t]
        if len({pairs[i] for i in places}) < least:
            return None
        top, own = None, set(places)
        for n, start in enumerate(places):
            end = places[bisect_right(places, start + longest - 1) - 1]
            if bisect_right(places, end) - n < least:
                continue
            seen, both = set(), 0
            for i in range(start, end + 1):
                if pairs[i] not in seen:
                    seen.add(pairs[i])
                    if len(seen) > most:
                        break
                    both += i in own
                if i in own and both >= least:
                    dice = 2 * both / (len(seen) + size)
                    if dice >= self.threshold and (top is None or dice > top[0]):
                        top = (dice, start, i - start + 2)
            if top and top[0] == 1:
                break
        return top


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, id: str = "doc_id", text: str = "text", threshold: float = 0.8
) -> DataFrame:
    """One row per row of ``docs`` and licence found in its whole text: the id,
    ``text_sha256`` of the text, ``license``, ``dice`` of the best window,
    ``template`` (which of the licence's texts, from 0), ``start`` (the window's
    first word, from 0) and ``words`` (its length). Of equal windows the earlier
    template, then the first, then the shortest counts.

    Null and empty texts and texts of one word match nothing. Every row is judged
    alone: rows that repeat an id, or have none, keep their own findings, and the
    digest says which text they are of. No templates, or an empty table, give an
    empty result; other columns are not read. Nothing is shuffled; the templates
    are a setting and go to every task.
    """
    kind = docs.schema[id].dataType.simpleString()
    scanner = Scanner(templates, threshold)
    names = ["id", "text", "license", "dice", "template", "start", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, body in enumerate(batch.column(1)):
                for name, window in scanner.best(body.as_py()).items():
                    rows.append((name, *window))
                    at.append(i)
            if rows:
                kept = batch.take(pa.array(at, pa.int64()))
                types = (pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int32())
                found = [pa.array(c, k) for c, k in zip(zip(*rows), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *found], names=names)

    texts = docs.select(F.col(f"`{id}`").alias("id"), filled(F.col(f"`{text}`")).alias("text"))
    out = texts.mapInArrow(run, f"id {kind}, text string, license string, dice double, template int, start long, words int")
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    return out.select(F.col("id").alias(id), digest, *names[2:])
