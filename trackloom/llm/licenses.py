"""License scans: matching statistics over a generalised suffix automaton of licence words, chained into covered spans.

All templates and base phrases go into one automaton, a few thousand states that each worker builds once. A text is run
through it word by word: after each word the automaton's state stands for the longest suffix read that occurs in some
template. Where that suffix can't grow any more, a match ends; long matches are chained, in the order of both the text and
the template, into spans, and a span counts if it covers enough of its template. A base phrase stands where its state is
an ancestor of the current one, over suffix links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import map_arrow, texts

#: Phrases whose every place is reported, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Words of the public notices by label; pass others as `templates`.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
      documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
      rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
      persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
      this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
      with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
      applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
      WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("gpl", "licensed under the GNU General Public License"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
      License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
      Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
      later version."""),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
      Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
      later version."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
      following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
      conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
      list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
      granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
      distributed with this file, You can obtain one at"""),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
      alter it and redistribute it freely, subject to the following restrictions"""),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication"),
)
#: A match is long from so many words; a span covers its template's share, and so many of its words or all of them.
LONG, SHARE, WORDS = 4, 0.5, 8
#: Words of the text that may stand between two matches of a span.
GAP = 32
#: Bytes of a text that are cut into words at once.
STEP = 1 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_parts(text: str | None) -> Iterator[list[bytes]]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, a part at a time."""
    data = (text or "").encode("utf-8").translate(_FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + STEP) if at + STEP < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Automaton:
    """The suffixes of several word sequences; state 0 is the empty one.

    next, link and length are the usual arrays; own[s] lists the (sequence, end) that first ended in s, and the sequences
    of all states below s in the tree of links are the places where s's strings stand.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.own: list[list[tuple[int, int]]] = [[]]
        for k, sequence in enumerate(sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = self._extend(last, word)
                self.own[last].append((k, i + 1))
        self.below: list[list[int]] = [[] for _ in self.link]
        for s in range(1, len(self.link)):
            self.below[self.link[s]].append(s)

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.own.append([])
        return len(self.link) - 1

    def _split(self, at: int, word: int) -> int:
        """The state of at's longest string plus the word, cut out of the state that holds it."""
        to = self.next[at][word]
        if self.length[to] == self.length[at] + 1:
            return to
        part = self._state(self.length[at] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = part
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = part
            at = self.link[at]
        return part

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, at = self._state(self.length[last] + 1, 0, {}), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word)
        return new

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """State and length of the longest suffix after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, matched + 1)

    def places(self, state: int) -> Iterator[tuple[int, int]]:
        """(sequence, end) of every place of the state's strings."""
        stack = [state]
        while stack:
            s = stack.pop()
            yield from self.own[s]
            stack += self.below[s]


class Scanner:
    """Base phrases and templates in one automaton, with what decides quickly where a text need not be walked."""

    def __init__(self, base: tuple[tuple[str, str], ...], templates: tuple[tuple[str, str], ...], long: int, gap: int):
        cut = lambda text: [w for part in word_parts(text) for w in part]
        self.labels = [label for _, label in base] + [label for label, _ in templates]
        sequences = [cut(text) for text, _ in base] + [cut(text) for _, text in templates]
        if any(len(s) < 2 for s in sequences[: len(base)]) or not all(sequences):
            raise ValueError("base phrases have two words at least, templates one")
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
        coded = [[self.vocabulary[w] for w in s] for s in sequences]
        self.n_base, self.long, self.gap = len(base), long, gap
        self.sizes = [len(s) for s in sequences]
        self.longest = max(self.sizes)
        self.automaton = a = Automaton(coded)
        size = len(self.vocabulary)
        self.pairs = np.unique([x * size + y for s in coded for x, y in zip(s, s[1:])] or [-1])
        self.endings = np.unique([s[-2] * size + s[-1] for s in coded[: len(base)]] or [-1])
        # the base phrases that are suffixes of a state's strings: its own, and those of the states above it
        self.phrases: list[tuple[tuple[int, int], ...]] = [()] * len(a.link)
        at = {}
        for k, s in enumerate(coded[: len(base)]):
            state = 0
            for word in s:
                state = a.next[state][word]
            at.setdefault(state, []).append((k, len(s)))
        for state in sorted(range(1, len(a.link)), key=a.length.__getitem__):
            self.phrases[state] = (*self.phrases[a.link[state]], *at.get(state, ()))
        shortest = min((n for n in self.sizes[len(base) :]), default=long)
        self.least = min(long, shortest)

    def codes(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        parts = [np.array([get(w, -1) for w in words], np.int32) for words in word_parts(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def runs(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Stretches (first, end) of words outside which no match has two words, kept if a long match or a base phrase may be inside."""
        if self.least < 2:
            inside = np.flatnonzero(codes >= 0)
            cuts = np.flatnonzero(np.diff(inside) > 1)
            return [(int(a), int(b) + 1) for a, b in zip(inside[np.r_[0, cuts + 1]], inside[np.r_[cuts, -1]])] if len(inside) else []
        if len(codes) < 2:
            return []
        pair = codes[:-1].astype(np.int64) * len(self.vocabulary) + codes[1:]
        at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
        at = at[np.isin(pair[at], self.pairs)]
        if not len(at):
            return []
        cuts = np.flatnonzero(np.diff(at) > 1)
        first, last = at[np.r_[0, cuts + 1]], at[np.r_[cuts, len(at) - 1]]
        hits = at[np.isin(pair[at], self.endings)]
        has_ending = np.searchsorted(hits, last, "right") > np.searchsorted(hits, first, "left")
        keep = (last - first + 2 >= self.least) | has_ending
        return [(int(a), int(b) + 2) for a, b in zip(first[keep], last[keep])]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, int, float]]]:
        """Number of words; places (base phrase, first word); spans (template, first word, words, covered words, covered share)."""
        codes = self.codes(text)
        places, matches = [], []
        a = self.automaton
        for first, end in self.runs(codes):
            state = matched = 0
            for i, word in enumerate(codes[first:end].tolist(), first):
                before, had = state, matched
                state, matched = a.step(state, matched, word)
                if matched != had + 1 and had >= self.least:
                    matches.append((i, had, before))
                for k, n in self.phrases[state]:
                    if matched >= n:
                        places.append((k, i + 1 - n))
            if matched >= self.least:
                matches.append((end, matched, state))
        return len(codes), places, self.spans(matches)

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float]]:
        """Chains of matches (end, words, state) by template, the best of those that overlap; spans that cover too little stay as hints."""
        of: dict[int, list[tuple[int, int, int, int]]] = {}
        for end, n, state in matches:
            for k, to in self.automaton.places(state):
                if k >= self.n_base and (n >= self.long or n >= self.sizes[k]):
                    of.setdefault(k, []).append((end - n, end, to - n, to))
        found = []
        for k, blocks in of.items():
            found += [(k, *c) for c in self._chains(sorted(blocks))]
        found.sort(key=lambda c: (c[1], c[2], c[0]))
        lesser = set()  # a span most of whose words a wider one of another label holds is a lesser reading of them
        for i, c in enumerate(found):
            for j in range(i + 1, len(found)):
                o = found[j]
                if o[1] >= c[2]:
                    break
                if self.labels[c[0]] != self.labels[o[0]] and c[3] != o[3]:
                    both = min(c[2], o[2]) - o[1]
                    low, k = (c, i) if c[3] < o[3] else (o, j)
                    if 2 * both > low[2] - low[1]:
                        lesser.add(k)
        return [(k, first, end - first, covered, covered / self.sizes[k]) for i, (k, first, end, covered) in enumerate(found) if i not in lesser]

    def _chains(self, blocks: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
        """The heaviest chains (first, end, covered) of blocks (first, end, first in template, end there), each block used once."""
        weight, back = [], []
        low, reach = 0, self.gap + self.longest
        for i, (s, e, ts, te) in enumerate(blocks):
            best, come = e - s, -1
            while blocks[low][0] < s - reach:
                low += 1
            for j in range(low, i):
                _, e0, _, te0 = blocks[j]
                if s - e0 <= self.gap and e0 < e and te0 < te:
                    w = weight[j] + min(e - s, e - e0, te - te0)
                    if w > best:
                        best, come = w, j
            weight.append(best)
            back.append(come)
        used, out = set(), []
        for i in sorted(range(len(blocks)), key=lambda i: (-weight[i], i)):
            if i in used:
                continue
            at, covered = i, weight[i]
            while True:
                used.add(at)
                if back[at] < 0 or back[at] in used:
                    covered -= 0 if back[at] < 0 else weight[back[at]]
                    break
                at = back[at]
            out.append((blocks[at][0], blocks[i][1], covered))
        return out


@lru_cache(4)
def _scanner(*how) -> Scanner:
    return Scanner(*how)


SPAN = "struct<label:string,template:int,first_word:long,n_words:long,covered:long,share:double>"


def license_spans(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE,
    long: int = LONG, gap: int = GAP,
) -> DataFrame:
    """Per row of docs: doc_id, n_words, places array<struct<label, first_word>> of the base phrases, spans of the templates.

    templates are (label, text), base is (phrase, label). A span has label, template (its index), first_word, n_words, covered
    words and the share of the template covered, however little that is. The result has a row for each row: null and empty texts have no words, places or spans;
    repeated rows give repeated rows; ids may be of any type and null. Other columns are ignored, an empty table gives no
    rows. Rows are scanned where they are, whole, without a shuffle.
    """
    how = (tuple(map(tuple, base)), tuple(map(tuple, templates)), long, gap)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, places array<struct<label:string,first_word:long>>, spans array<{SPAN}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*how)
        place = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))
        for b in batches:
            sizes, places, spans = [], [], []
            for text in texts(b):
                n, p, s = scanner.scan(text)
                sizes.append(n)
                places.append([{"label": scanner.labels[k], "first_word": i} for k, i in p])
                spans.append([{"label": scanner.labels[k], "template": k - scanner.n_base, "first_word": i, "n_words": m, "covered": c, "share": r} for k, i, m, c, r in s])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(places, place), pa.array(spans, span)], ["doc_id", "n_words", "places", "spans"])

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, share: float = SHARE, words: int = WORDS) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    n_base counts the places of the base phrases, first_word and last_word are the least and largest word they start at
    (null without any); base_labels and labels are distinct, sorted and comma-joined, empty without any. labels has those
    of the spans found as well: those that cover `share` of their template, and `words` of its words or all of them. score is 1 where a base phrase stands, else the largest share of a template that a span
    covers, found or not, 0 without any. Edges are those of license_spans().
    """
    rows = license_spans(docs, templates)
    template_words = F.array(*[F.lit(sum(map(len, word_parts(t)))) for _, t in templates])
    found = F.filter("spans", lambda s: s["covered"] >= F.greatest(share * F.get(template_words, s["template"]), F.least(F.get(template_words, s["template"]), F.lit(words))))
    base = F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["first_word"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform(found, lambda s: s["label"]))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: F.least(s["share"], F.lit(1.0)))), F.lit(0.0))).alias("score"),
        F.size(found).cast("long").alias("n_spans"),
    )
