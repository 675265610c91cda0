"""License scans: texts compared to license templates by Dice's coefficient over word bigrams."""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import byte_slices, ngram_hashes, span_hashes, string_bytes, word_bounds

#: Notices and short licence texts by SPDX expression.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "BSD-2-Clause OR BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "EPL-1.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "Zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    "Artistic-2.0": ("Licensed under the Artistic License 2.0.",),
    "EUPL-1.2": ("Licensed under the EUPL, Version 1.2 or later.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: The names of the GNU and Creative Commons families, whose notices differ by name and version only.
_GNU = {"GPL": ("GNU General Public License", ("2", "3")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3")), "AGPL": ("GNU Affero General Public License", ("3",))}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_PORTS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}

for _code, (_name, _versions) in _GNU.items():
    for _v in _versions:
        TEMPLATES[f"{_code}-{_v if '.' in _v else _v + '.0'}"] = (
            f"This work is licensed under the {_name}, version {_v}.",
            f"This program is free software: you can redistribute it and/or modify it under the terms of the {_name} as published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version.",
        )
for _code, _name in _CC.items():
    for _v, _port in _CC_PORTS.items():
        _older = _name.replace("NoDerivatives", "NoDerivs") if _v != "4.0" else _name
        TEMPLATES[f"CC-{_code}-{_v}"] = (f"Licensed under CC {_code} {_v}.", f"This work is licensed under a Creative Commons {_older} {_v} {_port} License.")

#: Templates of different licences with this Dice coefficient and more are told apart by what they do not share.
ALIKE, TOLD = 0.6, 0.8

_WORD = re.compile(r"[A-Za-z0-9]+")
_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]] = True
#: Where a notice may begin or end inside a line.
_SENTENCE = re.compile(r"(?<=[.!?:;])\s+")
_FILTER_BITS = 18


def bigrams(text: str) -> frozenset:
    """Word bigrams of the normalised text: runs of ASCII letters and digits in lower case."""
    words = [w.lower() for w in _WORD.findall(text)]
    return frozenset(zip(words, words[1:], strict=False))


def bigram_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word bigrams of every text, and the number of the text of each."""
    raw, offsets = string_bytes(column)
    starts, ends, rows = word_bounds(raw, offsets, _WORD_BYTES)
    pairs = ngram_hashes(span_hashes(raw, starts, ends), 2)
    text = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    inner = np.flatnonzero(text[1:] == text[:-1])
    return pairs[inner], text[inner]


class Scanner:
    """Segments of a text that are near a template; templates and threshold are fixed."""

    def __init__(self, templates: dict[str, tuple[str, ...]], least: float):
        self.least = least
        self.templates = [(name, bigrams(t)) for name, ts in sorted(templates.items()) for t in ts]
        self.templates = [(n, b) for n, b in self.templates if b]
        # For dice >= least, a segment of s bigrams and a template of t have
        # s / t between these bounds, and share at least the lower part of t.
        self.low, self.high = least / (2 - least), (2 - least) / least
        #: Numbers of the templates that hold a bigram, and for which it is an anchor.
        self.holders: dict[tuple[str, str], list[int]] = {}
        self.anchors: dict[tuple[str, str], list[int]] = {}
        #: Of each template, what a segment must have and must not have beside a template that is alike: (bigrams, number).
        self.musts: list[list[tuple[frozenset, int]]] = []
        self.must_nots: list[list[tuple[frozenset, int]]] = []
        for k, (name, grams) in enumerate(self.templates):
            for g in grams:
                self.holders.setdefault(g, []).append(k)
            # Of any (t - shared + 1) bigrams one must occur: those of the longest words.
            spare = len(grams) - self._need(len(grams))
            for g in sorted(grams, key=lambda g: (-max(len(g[0]), len(g[1])), g))[: spare + 1]:
                self.anchors.setdefault(g, []).append(k)
            others = [b for n, b in self.templates if n != name and 2 * len(b & grams) >= ALIKE * (len(b) + len(grams))]
            self.musts.append([(grams - b, -int(-TOLD * len(grams - b) // 1)) for b in others])
            self.must_nots.append([(b - grams, int((1 - TOLD) * len(b - grams) + 1e-9)) for b in others])
        hashes = bigram_hashes(pa.array([f"{a} {b}" for a, b in sorted(self.anchors)], pa.string()))[0]
        self.keys = np.unique(hashes)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, column) -> np.ndarray:
        """Numbers of the texts that hold an anchor bigram; no other text has a match."""
        pairs, text = bigram_hashes(column)
        near = np.flatnonzero(self.seen[(pairs >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        return np.unique(text[near[np.isin(pairs[near], self.keys)]])

    def _need(self, t: int) -> int:
        """Least number of a template's t bigrams that any near segment shares."""
        return max(1, -int(-self.low * t // 1))

    def told(self, k: int, segment: set) -> bool:
        """Whether a segment near template k is not rather one of another licence, named here or not."""
        return all(len(g & segment) >= n for g, n in self.musts[k]) and all(len(g & segment) <= n for g, n in self.must_nots[k])

    def matches(self, segment: set, shared: dict[int, int]) -> list[tuple[int, float, str]]:
        """``(bigrams shared, dice, licence)`` of the templates that the segment is near; ``shared`` counts by template."""
        out = []
        for k, n in shared.items():
            name, grams = self.templates[k]
            if n and self.low * len(grams) <= len(segment) <= self.high * len(grams):
                dice = 2 * n / (len(segment) + len(grams))
                if dice >= self.least and self.told(k, segment):
                    out.append((n, dice, name))
        return out

    def near(self, text: str):
        """``(start, end, bigrams shared, dice, licence)`` of every run of consecutive lines and sentences that is near a template.

        A run begins with a unit that holds a bigram of some template.  It goes on, a unit at a time, as far as the
        largest template can reach that has an anchor within reach (twice its words), with the shared bigrams of these
        templates counted along; so a text costs the reach of its templates for each unit.
        """
        found = list(_WORD.finditer(text))
        words, places = [m[0].lower() for m in found], [m.start() for m in found]
        pairs = list(zip(words, words[1:], strict=False))
        where: dict[int, list[int]] = {}
        for p, g in enumerate(pairs):
            for k in self.anchors.get(g, ()):
                where.setdefault(k, []).append(p)
        if not where:
            return
        grams_of = {k: self.high * len(self.templates[k][1]) for k in where}
        known = [0, *accumulate(g in self.holders for g in pairs), 0]
        units, at = [], 0
        for line in text.split("\n"):
            cuts = [0, *(m.end() for m in _SENTENCE.finditer(line)), len(line)]
            bounds = [bisect_left(places, at + c) for c in cuts]
            units += [(at + x, at + y, i, j) for x, y, i, j in zip(cuts, cuts[1:], bounds, bounds[1:], strict=False) if i < j]
            at += len(line) + 1
        for u, (start, _, i, j) in enumerate(units):
            # Bigrams that begin in the unit, the one into the next unit included.
            if known[min(j, len(pairs))] == known[i]:
                continue
            shared, reach, most = {}, 0, 0
            for k, anchors in where.items():
                x = bisect_left(anchors, i)
                if x < len(anchors) and anchors[x] < i + 2 * grams_of[k] + 2:
                    shared[k], reach, most = 0, max(reach, 2 * grams_of[k] + 2), max(most, grams_of[k])
            if not shared:
                continue
            grams, upto = set(), i
            for _, end, _, j in units[u:]:
                if j - i > reach or len(grams) > most:
                    break
                for g in pairs[upto : j - 1]:
                    if g not in grams:
                        grams.add(g)
                        for k in self.holders.get(g, ()):
                            if k in shared:
                                shared[k] += 1
                upto = j - 1
                for n, dice, name in self.matches(grams, shared):
                    yield start, end, n, dice, name

    def scan(self, text: str) -> list[dict]:
        """The best match at each place: matches by falling number of shared bigrams, then by Dice, that overlap no better one."""
        starts, kept = [], []
        for _, _, start, _, name, end, dice in sorted((-n, -dice, start, -end, name, end, dice) for start, end, n, dice, name in self.near(text)):
            at = bisect_left(starts, start)
            if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or end <= kept[at][0]):
                starts.insert(at, start)
                kept.insert(at, (start, end, name, dice))
        return [{"license": name, "dice": round(dice, 6), "start": start, "end": end} for start, end, name, dice in kept]


MATCH = "struct<license:string,dice:double,start:int,end:int>"


def scan_licenses(docs: DataFrame, *, least: float = 0.8, templates: dict[str, tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, matches)`` for every row: the license notices in its text.

    Segments of the text are runs of its consecutive lines and of the sentences in them.  A segment
    matches a template when Dice's coefficient of
    their sets of word bigrams is ``least`` or more; the bounds that this puts on a
    segment's size prune templates before any comparison.  Templates of other licences that are alike (by ``ALIKE``) must be
    told apart: of what the template has and the other lacks, the segment has four fifths, and of what the
    other has and it lacks, a fifth at most.  So a notice of a variant that no template has is none rather than
    its neighbour's.  Of overlapping matches the one that shares most bigrams stays, then the
    nearest, ties by start, the longer one first, and then by name.  Places are code points, end exclusive.

    Of every template, some bigrams are such that any near segment holds one of them
    (``Scanner.anchors``); texts that hold none are left at that.  Null and empty texts have none, and very long ones are scanned whole in work that follows
    their length.  Null and repeated ids are kept, a row each, a table without rows gives none, other columns are not looked at; nothing is shuffled.
    """
    templates = TEMPLATES if templates is None else templates
    kind = dict(docs.dtypes)[id_col]
    struct = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        scanner = Scanner(templates, least)
        for b in batches:
            found: list[list] = [[] for _ in range(len(b))]
            for lo, hi in byte_slices(b.column(1), 4 << 20):
                part = b.column(1).slice(lo, hi - lo)
                for i in scanner.candidates(part).tolist():
                    found[lo + i] = scanner.scan(part[i].as_py())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, struct)], names=["id", "matches"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, matches array<{MATCH}>").withColumnRenamed("id", id_col)
