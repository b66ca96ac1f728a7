"""Licence texts in documents: matching statistics from a generalised suffix automaton, chained into spans of templates.

The automaton is built over the words of all templates and phrases. A text is streamed through it once, a word at a time: at each word the automaton's state and length say
what longest run of words that ends there occurs in a template. Where a run can't grow by the next word it is a match; the state's end positions, and those of its suffix
links, say where in which templates it stands. Matches of ``LONG`` words and more of a template are chained: they follow each other in text and template, with gaps of ``GAP`` words at most. A chain that covers
``SHARE`` of its template's words is a span of it, and gives the template's label. Phrases are found at every place they stand: a state knows the phrases that its run ends with.

The automaton has at most two states for each word of the templates; they are parameters of fixed size. Texts are read whole, a word at a time.

Score: the largest share of a template that one chain covers, or ``PHRASE_SCORE`` if that is less and a phrase stands in the text, else 0.

Defined cases: a null or empty text has no words, no places and score 0; repeated rows each get their row; very long texts are one row's work and hold their matches only; matches in several templates count for each; an empty table
gives no rows; an id may be of any type; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import store

LONG, GAP, SHARE, PHRASE_SCORE = 4, 40, 0.6, 0.5
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: The phrases of the base, and the words of public licence notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT license."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "Licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]


def words_of(text: str | bytes | None) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text or b""
    return _WORD.findall(data.lower())  # of bytes, A-Z alone


class Automaton:
    """Generalised suffix automaton of sequences of words, with the end positions of its states."""

    def __init__(self, sequences: list[list[bytes]]) -> None:
        self.sequences = sequences
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        self.last_state = []  # of each sequence
        for k, words in enumerate(sequences):
            state = 0
            for at, w in enumerate(words, 1):
                state = self._extend(state, w, ends)
                ends[state].add((k, at))
            self.last_state.append(state)
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            ends[self.link[state]] |= ends[state]
        self.ends = [tuple(sorted(e)) for e in ends]

    def _new(self, length: int, follow: dict[bytes, int], link: int, ends: list) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        ends.append(set())
        return len(self.next) - 1

    def _split(self, at: int, w: bytes, ends: list) -> int:
        """The state of the longest run that ``at`` and w make; cloned off if longer runs share it."""
        known = self.next[at][w]
        if self.length[known] == self.length[at] + 1:
            return known
        clone = self._new(self.length[at] + 1, dict(self.next[known]), self.link[known], ends)
        self.link[known] = clone
        while at >= 0 and self.next[at].get(w) == known:
            self.next[at][w] = clone
            at = self.link[at]
        return clone

    def _extend(self, state: int, w: bytes, ends: list) -> int:
        if w in self.next[state]:
            return self._split(state, w, ends)
        new = self._new(self.length[state] + 1, {}, 0, ends)
        while state >= 0 and w not in self.next[state]:
            self.next[state][w] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, w, ends)
        return new

    def statistics(self, words: Iterable[bytes]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest run that ends here and occurs in a sequence) for each word."""
        follow, link, length = self.next, self.link, self.length
        state = held = 0
        for w in words:
            to = follow[state].get(w)
            while to is None and state:
                state = link[state]
                held = length[state]
                to = follow[state].get(w)
            if to is None:
                held = 0
            else:
                state, held = to, held + 1
            yield state, held


class Licences:
    """Phrases and templates in one automaton."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> None:
        self.labels = [*(label for label, _ in templates), *phrases.values()]
        self.automaton = Automaton([*(words_of(t) for _, t in templates), *(words_of(p) for p in phrases)])
        self.sizes = [len(s) for s in self.automaton.sequences]
        first = len(templates)
        own = defaultdict(list)  # state: the phrases that it is the run of
        for k in range(first, len(self.sizes)):
            own[self.automaton.last_state[k]].append(k)
        self.phrases: list[tuple[int, ...]] = [()] * len(self.automaton.next)  # those that a state's runs can end with
        for state in sorted(range(1, len(self.phrases)), key=lambda s: self.automaton.length[s]):
            self.phrases[state] = (*own[state], *self.phrases[self.automaton.link[state]])
        self.template_ends = [tuple(e for e in ends if e[0] < first) for ends in self.automaton.ends]

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
        """(number of words, places of phrases (start, end, label), the best chains of each template (start, end, label, share))."""
        places, matches = [], []
        n = before = at = 0
        follows = self.automaton.statistics(m[0] for m in _WORD.finditer((text or b"").lower()))
        for n, (state, held) in enumerate(follows, 1):
            if before >= LONG and held <= before:
                matches.append((n - 1, before, at))
            if held:
                places += [(n - self.sizes[k], n, self.labels[k]) for k in self.phrases[state] if self.sizes[k] <= held]
            before, at = held, state
        if before >= LONG:
            matches.append((n, before, at))
        return n, places, self._chains(matches) if matches else []

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        link, length = self.automaton.link, self.automaton.length
        by_template: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # (end, template end, words)
        for end, held, state in matches:
            seen = set()
            while held >= LONG:
                for found in self.template_ends[state]:
                    if found not in seen:
                        seen.add(found)
                        by_template[found[0]].append((end, found[1], held))
                state = link[state]
                held = length[state]
        out = []
        for template, found in by_template.items():
            out += ((s, e, self.labels[template], covered / self.sizes[template]) for s, e, covered in chained(found))
        return out


def chained(found: list[tuple[int, int, int]], gap: int = GAP) -> list[tuple[int, int, int]]:
    """(start, end, words covered) of the chains of matches (end, template end, words) that end where no match follows on; matches come by their ends.

    A match continues the chain, of those that end before it in text and template and at most ``gap`` words away, that covers most with it; words that
    both hold count once."""
    found = sorted(found)
    best: list[tuple[int, int]] = []  # (covered, start) of the best chain that ends with each match
    low, taken = 0, set()
    longest = max(n for *_, n in found)
    for k, (end, there, n) in enumerate(found):
        while found[low][0] < end - longest - gap:
            low += 1
        top, prior = (n, end - n), None
        for j in range(low, k):
            e, t, _ = found[j]
            if e < end and t < there and end - n - e <= gap and there - n - t <= gap:
                covered = best[j][0] + n - max(0, e - (end - n), t - (there - n))
                if covered > top[0]:
                    top, prior = (covered, best[j][1]), j
        best.append(top)
        if prior is not None:
            taken.add(prior)
    return [(best[k][1], found[k][0], best[k][0]) for k in range(len(found)) if k not in taken]


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])
_CHAIN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64())])
_SHAPE = "n_words long, places array<struct<start: long, end: long, label: string>>, spans array<struct<start: long, end: long, label: string, share: double>>, best double"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(id, n_words, places of phrases, spans of templates, best): spans cover ``SHARE`` of a template, best is the largest share of any chain."""
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        licences = Licences(templates, phrases)
        for batch in batches:
            n, places, spans, best = [], [], [], []
            for text in batch.column("text"):
                words, p, chains = licences.scan(text.as_py())
                n.append(words)
                places.append([dict(zip(("start", "end", "label"), x, strict=True)) for x in p])
                spans.append([dict(zip(("start", "end", "label", "share"), x, strict=True)) for x in sorted(chains) if x[3] >= SHARE])
                best.append(max((x[3] for x in chains), default=0.0))
            made = [pa.array(n, pa.int64()), pa.array(places, pa.list_(_SPAN)), pa.array(spans, pa.list_(_CHAIN)), pa.array(best, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], ["id", "n_words", "places", "spans", "best"])

    return frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, {_SHAPE}").withColumnRenamed("id", id_col)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and licence texts of every document."""
    found = scan_licenses(store.table(spark, sf_dir, "documents"))
    base, listed = F.col("places.label"), lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, F.col("spans.label"))).alias("labels"), F.greatest("best", F.when(F.size("places") > 0, PHRASE_SCORE).otherwise(0.0)).alias("score"),
    )
