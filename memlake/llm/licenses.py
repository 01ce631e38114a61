"""License scan with a generalised suffix automaton of licence tokens.

The automaton holds every substring of all templates. A text is streamed through
it once: the state gives the longest match that ends at each token (matching
statistics). Maximal long matches are chained for each template, in order in text
and template with small gaps; what a chain covers of the template is its share.

Scale: one pass over each text, no shuffle; templates are a fixed broadcast.

``score`` is the largest share of a template that a chain covers.

Defined cases: null or empty text: no words, no labels, score 0. Long texts are
scanned whole. Repeated rows are alike, equal spans of several templates all count.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import sys
import types
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import ALNUM_TABLE, arrow_batch, text_bytes

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices of public licences.
TEMPLATES = {
    "agpl-3.0": ["licensed under the gnu affero general public license version 3"],
    "apache-2.0": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "bsd": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "released under the bsd license", "licensed under the bsd license"],
    "cc-by-4.0": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "lgpl-2.1": ["licensed under the gnu lesser general public license version 2 1"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}
MIN_MATCH = 4
MAX_GAP = 6
MIN_COVER = 0.7


class SuffixAutomaton:
    """Generalised: one state for each set of substrings with equal ends; ``at`` has, for a state of ``least`` tokens or more, all its ends in each template that holds it."""

    def __init__(self, texts: list[list[int]], least: int = 1):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for t in texts:
            last = 0
            for c in t:
                last = self._add(last, c)
        self.at: list[dict[int, list[int]]] = [{} for _ in self.len]
        for n, t in enumerate(texts):
            s = 0
            for k, c in enumerate(t):
                s = self.next[s][c]
                x = s
                while x > 0 and self.len[x] >= least:
                    self.at[x].setdefault(n, []).append(k)
                    x = self.link[x]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.len[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.len[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return new

    def matches(self, ids: list[int], least: int):
        """(end, length, state) of all matches of at least so many tokens that the next token doesn't extend."""
        s = n = 0
        for k, c in enumerate(ids):
            was, wn = s, n
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.len[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            if n <= wn and wn >= least:
                yield k, wn, was
        if n >= least:
            yield len(ids), n, s


def scanner() -> tuple[dict[bytes, int], SuffixAutomaton, list[tuple[str, int]]]:
    """One for each worker process."""
    kept = sys.modules.setdefault("_memlake_worker", types.ModuleType("_memlake_worker"))
    if not hasattr(kept, "scanner"):
        kept.scanner = _scanner()
    return kept.scanner


def _scanner() -> tuple[dict[bytes, int], SuffixAutomaton, list[tuple[str, int]]]:
    vocabulary: dict[bytes, int] = {}
    texts, names = [], []
    for label, notices in TEMPLATES.items():
        for t in notices:
            texts.append([vocabulary.setdefault(w, len(vocabulary)) for w in t.encode().split()])
            names.append((label, len(texts[-1])))
    return vocabulary, SuffixAutomaton(texts, MIN_MATCH), names


def runs(words: list[bytes], vocabulary: dict[bytes, int], least: int):
    """(start, ids) of stretches of at least so many licence tokens."""
    ids = list(map(vocabulary.get, words))
    k, n = 0, len(ids)
    while k < n:
        if ids[k] is None:
            k += 1
            continue
        j = k
        while j < n and ids[j] is not None:
            j += 1
        if j - k >= least:
            yield k, ids[k:j]
        k = j + 1


def spans(words: list[bytes], least: float = MIN_COVER) -> list[tuple[str, int, int, float]]:
    """(label, first word, end word, share of the template) of template spans covered to ``least`` or more; for each place in a text where a chain of matches ends there is one."""
    vocabulary, automaton, names = scanner()
    by: dict[int, list[tuple[int, int, int]]] = {}
    for start, ids in runs(words, vocabulary, MIN_MATCH):
        for end, length, state in automaton.matches(ids, MIN_MATCH):
            for t, ends in automaton.at[state].items():
                by.setdefault(t, []).extend((start + end - length, length, at - length + 1) for at in ends)
    out = []
    for t, found in by.items():
        label, size = names[t]
        chain: list[tuple[int, int, int, int, int]] = []  # text end, template end, covered, first word, last end
        for a, n, b in sorted(found):
            best = (n, a)
            for te, pe, c, first, _ in chain:
                over = max(0, te - a, pe - b)
                if te <= a + n and pe <= b + n and a - te <= MAX_GAP and b - pe <= MAX_GAP and over < n and c + n - over > best[0]:
                    best = (c + n - over, first)
            chain = [x for x in chain if a - x[0] <= MAX_GAP] + [(a + n, b + n, best[0], best[1], a + n)]
            if best[0] >= least * size:
                out.append((label, best[1], a + n, min(1.0, best[0] / size)))
    return out


_PHRASES = {(b" " + p.encode() + b" "): label for p, label in BASE.items()}
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_spans", pa.int64())])


def scanned(raw: bytes) -> tuple:
    words = raw.translate(ALNUM_TABLE).split()
    line = b" " + b" ".join(words) + b" "
    places, base, starts = [], set(), None
    for phrase, label in _PHRASES.items():
        k = line.find(phrase)
        while k >= 0:
            if starts is None:
                starts = [0, *accumulate(len(w) + 1 for w in words)]
            places.append(bisect_left(starts, k))
            base.add(label)
            k = line.find(phrase, k + 1)
    chains = spans(words, 0)
    found = [x for x in chains if x[3] >= MIN_COVER]
    labels = sorted(base | {x[0] for x in found})
    score = max((x[3] for x in chains), default=0.0)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score, len(found)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans."""

    def scan(batches):
        for b in batches:
            data, bounds = text_bytes(b.column(1))
            rows = [scanned(data[bounds[r] : bounds[r + 1]].tobytes()) for r in range(b.num_rows)]
            if rows:
                yield arrow_batch(_SCHEMA, b.column(0), *zip(*rows))

    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_spans long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, kind)
