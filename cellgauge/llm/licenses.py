"""License scans by patience alignment of texts and license templates.

Where a text is dense in a template's words, the two are aligned: equal words at both ends pair up;
words that occur once in either are anchors; of these, the longest sequence that rises in both is
kept; the gaps between anchors are aligned in the same way. Coverage is the share of the template's
words that pair up.

Coverage alone doesn't tell licenses apart that differ in a word, so a template's distinguishing
words (license names, versions, and terms such as NC or Lesser) must all be paired, and none of
the terms, nor a further part of a version, may stand unpaired in the place. A window has twice the
template's words and starts at one before which no more words can be missing than may. Of those that
reach the coverage around one place the best is taken: most words, then the shortest span, then the
first; where places of several templates overlap, the one with the most words is named.

Words are runs of what is neither ASCII white space nor ASCII punctuation, with A-Z lower-cased. Every
place of a whole text counts, so each repetition of a license in a text is found. Null and blank
texts, empty templates and empty tables give no rows; repeated rows give theirs again; other columns
of the table, whatever their names, are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordHasher, blocks_words

#: Notices and license texts in public use.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT": "Released under the MIT License.",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "Zlib text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0.",
    "Unlicense text": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
}
#: GNU licenses by name and version.
GNU = {"GPL": ("General", ("1", "2", "3")), "LGPL": ("Lesser General", ("2.1", "3")), "AGPL": ("Affero General", ("3",))}
#: Terms of the Creative Commons licenses, their versions and what those are called.
COMMONS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
TERMS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
#: Identifiers whose tag is looked for, besides those of the notices.
TAGGED = ("0BSD", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "ISC", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib", "Apache-1.1", "Apache-2.0", "CC0-1.0")
#: Words of license names; those of TERMS and of the GNU family that change a license's meaning where they stand beside others.
NAMES = frozenset("apache mit isc bsd clause zlib boost mozilla mpl eclipse epl unlicense cc0 cc by gnu gpl lgpl agpl creative commons attribution unencumbered".split())
CHANGES = frozenset("nc sa nd noncommercial sharealike noderivatives noderivs lesser library affero".split())


def _templates() -> dict[str, str]:
    """The notices, and short ones of the families by rule."""
    out = dict(NOTICES)
    for short, (name, versions) in GNU.items():
        for v in versions:
            spdx = f"{short}-{v if '.' in v else v + '.0'}"
            out[spdx] = f"This work is licensed under the GNU {name} Public License, version {v}."
            out[f"{spdx} short"] = f"GNU {name} Public License version {v}"
            out[f"{spdx} notice"] = (
                f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by "
                f"the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
            )
    for kind in COMMONS:
        for v, called in VERSIONS.items():
            terms = "-".join(TERMS[t] for t in kind.split("-"))
            out[f"CC-{kind}-{v}"] = f"Licensed under CC {kind} {v}."
            out[f"CC-{kind}-{v} short"] = f"CC {kind} {v}"
            out[f"CC-{kind}-{v} name"] = f"licensed under a Creative Commons {terms} {v} {called} License"
    for spdx in sorted({*TAGGED, *(n for n in out if " " not in n)}):
        out[f"{spdx} tag"] = f"SPDX-License-Identifier: {spdx}"
    return out


TEMPLATES = _templates()


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of equal words, rising in both lists."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        anchors = _anchors(a, b, alo, ahi, blo, bhi)
        if not anchors:
            continue
        out += anchors
        at, bt = alo, blo
        for i, j in [*anchors, (ahi, bhi)]:
            todo.append((at, i, bt, j))
            at, bt = i + 1, j + 1
    return sorted(out)


def _anchors(a: list, b: list, alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    ca, cb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
    where = {b[j]: j for j in range(blo, bhi) if cb[b[j]] == 1}
    pairs = [(i, where[a[i]]) for i in range(alo, ahi) if ca[a[i]] == 1 and a[i] in where]
    # Longest rising sequence of the second indices, by patience sorting.
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(ends[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [j]
        ends[pile : pile + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def split_words(text: str) -> list[str]:
    """The words of a text as strings, in the hasher's sense."""
    return "".join(" " if c.isascii() and not c.isalnum() and c >= " " and c != "\x7f" or c in "\t\n\v\f\r" else c.lower() if c.isascii() else c for c in text).split(" ")


class Template:
    def __init__(self, name: str, text: str, words: list[int], coverage: float):
        self.name, self.words = name, words
        self.need = max(1, ceil(coverage * len(words) - 1e-9))
        #: A place starts at one of these: more words than come before them can't be missing.
        self.head = frozenset(words[: len(words) - self.need + 1])
        said = [w for w in split_words(text) if w]
        tag = set(said[3:]) if name.endswith(" tag") else set()
        #: The places of the distinguishing words.
        self.marks = frozenset(i for i, w in enumerate(said) if w.isdigit() or w in NAMES or w in CHANGES or w in tag)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.hasher = WordHasher(punctuation=True)
        self.templates: list[Template] = []
        for name, text in templates.items():
            words = self.hasher.words(np.frombuffer(text.encode(), np.uint8))[0]
            if len(words):
                self.templates.append(Template(name, text, words.tolist(), coverage))
        self.known = np.unique(np.array([w for t in self.templates for w in t.words], dtype=np.uint64))
        #: How often each template has each known word; and which of them it can't do without.
        self.has = np.zeros((len(self.templates), len(self.known) + 1), np.float32)
        self.must = np.zeros_like(self.has)
        for k, t in enumerate(self.templates):
            at = np.searchsorted(self.known, np.array(t.words, dtype=np.uint64))
            np.add.at(self.has[k], at, 1)
            self.must[k, at[sorted(t.marks)]] = 1
        self.need = np.array([t.need for t in self.templates])

    def block(self, words: np.ndarray, bounds: np.ndarray):
        """(row, word indices among the known, templates that the row has enough words of) for each row that has any."""
        if not len(self.known):
            return
        at = np.searchsorted(self.known, words)
        at[at == len(self.known)] = 0
        at = np.where(self.known[at] == words, at, len(self.known))
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        hit = at < len(self.known)
        present = np.zeros((len(bounds) - 1, len(self.known) + 1), np.float32)
        present[row[hit], at[hit]] = 1
        possible = (present @ self.has.T >= self.need) & (present @ self.must.T >= self.must.sum(axis=1))
        for k in np.flatnonzero(possible.any(axis=1)):
            yield int(k), at[bounds[k] : bounds[k + 1]], np.flatnonzero(possible[k])

    def spans(self, words: np.ndarray, at: np.ndarray, which: np.ndarray, said) -> list[tuple[str, float, int, int]]:
        """(name, coverage, first word, past the last word) of each place in a text, none overlapping, in order.

        at: the words' indices among the known; said(i, j): the strings and the separators before words i to j - 1.
        """
        found = []
        for k in which:
            t = self.templates[k]
            inside = self.has[k][at] > 0
            # A place can start where so many words of the template lie within a window that coverage can be reached.
            total = np.concatenate(([0], np.cumsum(inside)))
            until = np.minimum(np.arange(len(words)) + 2 * len(t.words), len(words))
            starts = np.flatnonzero(inside & (total[until] - total[:-1] >= t.need))
            found += [(-n, j - i, i, j, t) for n, i, j in self._places(t, words, starts.tolist(), said)]
        # The place with the most words first; a place that overlaps one already named goes.
        found.sort(key=lambda x: (*x[:3], x[4].name))
        taken: list[tuple[int, int]] = []
        out = []
        for n, _, i, j, t in found:
            k = bisect_left(taken, (i, j))
            if (k and taken[k - 1][1] > i) or (k < len(taken) and taken[k][0] < j):
                continue
            insort(taken, (i, j))
            out.append((t.name, -n / len(t.words), i, j))
        return sorted(out, key=lambda x: x[2])

    def _places(self, t: Template, words: np.ndarray, starts: list[int], said):
        """(pairs, first word, past the last) of the best places, each the best of those that start before its first one ends."""
        best, until, after = None, 0, 0
        for at in starts:
            if best and at >= until:
                yield best
                best, after = None, best[2]
            if at < after or int(words[at]) not in t.head:
                continue
            pairs = align(words[at : at + 2 * len(t.words)].tolist(), t.words)
            if len(pairs) < t.need:
                continue
            i, j = at + pairs[0][0], at + pairs[-1][0] + 1
            if not self._is(t, [(at + p, q) for p, q in pairs], said):
                continue
            if best is None:
                until = j
            if best is None or (-len(pairs), j - i, i) < (-best[0], best[2] - best[1], best[1]):
                best = (len(pairs), i, j)
        if best:
            yield best

    @staticmethod
    def _is(t: Template, pairs: list[tuple[int, int]], said) -> bool:
        """Whether the distinguishing words are paired and no other license's stand among them."""
        if not t.marks <= {q for _, q in pairs}:
            return False
        first, last = pairs[0][0], pairs[-1][0]
        strings, before = said(first, last + 2)
        paired = {p for p, _ in pairs}
        for k, w in enumerate(strings):
            if first + k in paired:
                continue
            if w in CHANGES and first + k <= last:
                return False
            # A further part of a version: 2.1 isn't 2, but 3.0 is 3.
            if k and w.isdigit() and int(w) and before[k] == "." and strings[k - 1].isdigit() and first + k - 1 in paired:
                return False
        return True


RESULT = "doc_id {kind}, license string, coverage double, start bigint, stop bigint, span string"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each license place: coverage, the place in UTF-8 bytes (start, stop) and its text."""
    given = TEMPLATES if templates is None else templates

    def run(batches):
        s = Scanner(given, coverage)
        for batch in batches:
            at, rest = [], []
            for lo, words, bounds, start, end in blocks_words(s.hasher, batch.column(1)):
                for k, known, which in s.block(words, bounds):
                    a, b = int(bounds[k]), int(bounds[k + 1])
                    raw = batch.column(1)[lo + k].as_py().encode()

                    def said(i, j, raw=raw, a=a, n=b - a):
                        """The strings of words i to j - 1, lower-cased, and what stands before each of them."""
                        j = min(j, n)
                        strings = [raw[start[a + x] : end[a + x]].decode("utf-8", "replace").lower() for x in range(i, j)]
                        return strings, ["", *(raw[end[a + x - 1] : start[a + x]].decode("utf-8", "replace") for x in range(i + 1, j))]

                    for name, share, i, j in s.spans(words[a:b], known, which, said):
                        p, q = int(start[a + i]), int(end[a + j - 1])
                        at.append(lo + k)
                        rest.append((name, share, p, q, raw[p:q].decode("utf-8", "replace")))
            cols = list(zip(*rest, strict=True)) or [()] * 5
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())], names=["doc_id", "license", "coverage", "start", "stop", "span"])

    return docs.select(key, text).mapInArrow(run, RESULT.format(kind=dict(docs.dtypes)[key])).withColumnRenamed("doc_id", key)
