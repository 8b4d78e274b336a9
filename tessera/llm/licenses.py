"""License scans: matching statistics of texts against a generalised suffix automaton of licence tokens."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, text_buffers, text_chunks

# Notices, openings and whole texts of public licences, with the label that each stands for.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    ),
)
# The phrases of the base labels, as the words that stand before "license".
PHRASES = {("mit",): "mit", ("apache",): "apache", ("general", "public"): "gpl"}
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: everything else becomes a blank.
_SPLIT = LOWER.copy()
_SPLIT[[b for b in range(256) if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F]] = 0x20
SPLIT = _SPLIT.tobytes()


def tokens(text: bytes) -> list[bytes]:
    return text.translate(SPLIT).split()


class Automaton:
    """Generalised suffix automaton of token sequences: every state is a set of substrings that end at the same places."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, tuple[int, int]]] = []
        for k, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token)
                ends.append((last, (k, i + 1)))
        # of a state: where its prefix states end, and the states that link to it, whose ends are its own too
        self.own: dict[int, list[tuple[int, int]]] = {}
        for state, end in ends:
            self.own.setdefault(state, []).append(end)
        self.below: dict[int, list[int]] = {}
        for state, link in enumerate(self.link):
            self.below.setdefault(link, []).append(state)
        self._places: dict[int, list[tuple[int, int]]] = {}

    def places(self, state: int) -> list[tuple[int, int]]:
        """Every (sequence, end in it) of the substrings of a state, gathered once from the states below it."""
        found = self._places.get(state)
        if found is None:
            found, waiting = [], [state]
            while waiting:
                s = waiting.pop()
                found += self.own.get(s, [])
                waiting += self.below.get(s, [])
            found.sort()
            self._places[state] = found
        return found

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """The state of the longest substring of q that p's move by token reaches."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:  # an earlier sequence has this prefix
            return self._split(last, token, self.next[last][token])
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, token, self.next[p][token])
        return new

    def matches(self, stream: list[int], least: int) -> list[tuple[int, int, int]]:
        """Maximal matches of at least `least` tokens: (end in the stream, length, state), by streaming matching statistics."""
        out, state, length = [], 0, 0
        for i, token in enumerate(stream):
            if token not in self.next[state]:
                if length >= least:
                    out.append((i, length, state))
                while state and token not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
            to = self.next[state].get(token)
            state, length = (0, 0) if to is None else (to, length + 1)
        if length >= least:
            out.append((len(stream), length, state))
        return out


class Scanner:
    """Templates, their automaton and the rule that turns chained matches into labels."""

    def __init__(self, templates=TEMPLATES, least: int = 3, gap: int = 6, cover: float = 0.6):
        self.labels = [label for label, _ in templates]
        sequences = [tokens(text.encode()) for _, text in templates]
        self.ids = {t: i for i, t in enumerate(sorted({t for s in sequences for t in s}))}
        self.sizes = [len(s) for s in sequences]
        self.sequences = [[self.ids[t] for t in s] for s in sequences]
        self.automaton = Automaton(self.sequences)
        self.least, self.gap, self.cover = least, gap, cover

    def spans(self, stream: list[int]) -> list[tuple[int, float]]:
        """(template, share of it that its best chain of matches covers). A chain's matches go forward in text and template, gaps being of at most `gap` tokens in each.

        By dynamic programming: the best chain that ends in a match extends the best one that ends in a match near before it; what
        both cover in text or template counts once.
        """
        ends: dict[int, list[tuple[int, int, int]]] = {}  # of a template: (end in the text, end in it, covered), by end in the text
        best: dict[int, int] = {}
        for end, length, state in self.automaton.matches(stream, self.least):
            for k, at in self.automaton.places(state):
                before = ends.setdefault(k, [])
                most = length
                for to, template_to, covered in reversed(before):
                    if to < end - length - self.gap:
                        break
                    lap = max(0, to - (end - length), template_to - (at - length))
                    if to < end and template_to < at and lap < length and at - length - template_to <= self.gap:
                        most = max(most, covered + length - lap)
                before.append((end, at, most))
                best[k] = max(best.get(k, 0), most)
        return [(k, min(1.0, n / self.sizes[k])) for k, n in best.items()]

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        found = tokens(text)
        base, places = set(), []
        for i in range(1, len(found)) if b"license" in found else ():
            if found[i] == b"license":
                for before, label in PHRASES.items():
                    k = len(before)
                    if i >= k and all(found[i - k + j] == w.encode() for j, w in enumerate(before)):
                        base.add(label)
                        places.append(i - k)
        known = self.ids.get
        ids = np.fromiter((known(t, -1) for t in found), np.int32, len(found))
        labels, score = set(base), 0.0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        long = edges[1::2] - edges[::2] >= self.least
        if long.any():
            # only runs of licence words can match; a stranger between two runs stands for any number up to the gap
            stream: list[int] = []
            last = None
            for a, b in zip(edges[::2][long].tolist(), edges[1::2][long].tolist(), strict=True):
                stream += [-1] * (min(a - last, self.gap + 1) if last is not None else 0) + ids[a:b].tolist()
                last = b
            for k, share in self.spans(stream):
                score = max(score, share)
                if share >= self.cover:
                    labels.add(self.labels[k])
        return len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan_licenses(docs: DataFrame, templates=TEMPLATES, least: int = 3, gap: int = 6, cover: float = 0.6) -> DataFrame:
    """Licence labels of every row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels come from fixed phrases at all their places. The method streams a text's words through the
    automaton of the templates, chains matches of at least `least` words and adds a template's label when a chain
    covers `cover` of it; score is the largest share covered. Null and empty texts have no words, labels or places;
    repeated rows are scanned each for itself.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least, gap, cover)
        for batch in text_chunks(batches):
            raw, starts = text_buffers(batch.column("text"))
            whole, at = raw.tobytes(), starts.tolist()
            rows = [scanner.scan(whole[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
