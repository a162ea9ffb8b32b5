"""Licence scan: a generalised suffix automaton of licence texts, streamed documents, chained matches."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstprint.llm.common import texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Phrases that name a licence, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Licence notices as they are published, by label.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
     files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
     merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
     subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
     portions of the Software."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
     that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
     conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
     disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
     in the documentation and/or other materials provided with the distribution."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
     You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
     software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
     See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
     published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
     distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
     FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
     this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
     compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
     non-commercial, and by any means."""),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]
#: Shortest match (words) that a chain is built from, most words between two matches of a chain, and the share of a template
#: that a chain must cover to give its label.
MATCH, GAP, COVER = 4, 20, 0.5

_WORD_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits and whatever is not ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(_WORD_BYTES).split()


class SuffixAutomaton:
    """Generalised suffix automaton of several word sequences; word numbers start at 1, 0 is any other word."""

    def __init__(self, sequences: list[list[bytes]]):
        self.numbers: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.longest, self.ends = [-1], [0], [[]]
        coded = [[self.numbers.setdefault(w, len(self.numbers) + 1) for w in own] for own in sequences]
        self.coded = coded
        for which, own in enumerate(coded):
            last = 0
            for place, symbol in enumerate(own):
                last = self._append(last, symbol)
                self.ends[last].append((which, place + 1))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.longest[s]):  # what ends a longer string ends its suffixes
            self.ends[self.link[state]] += self.ends[state]
        self.ends[0] = []
        # pairs of neighbouring words: a match of two words or more can only pass over these
        size = len(self.numbers) + 1
        self.pairs = np.zeros((size, size), bool)
        for own in coded:
            self.pairs[own[:-1], own[1:]] = True

    def _state(self, longest: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.longest.append(longest)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, at: int, symbol: int, target: int) -> int:
        """The state of the strings that reach ``target`` from ``at`` and its suffixes, on its own."""
        copy = self._state(self.longest[at] + 1)
        self.step[copy] = dict(self.step[target])
        self.link[copy], self.link[target] = self.link[target], copy
        while at >= 0 and self.step[at].get(symbol) == target:
            self.step[at][symbol] = copy
            at = self.link[at]
        return copy

    def _append(self, last: int, symbol: int) -> int:
        target = self.step[last].get(symbol)
        if target is not None:  # known from an earlier sequence
            return target if self.longest[target] == self.longest[last] + 1 else self._split(last, symbol, target)
        new, at = self._state(self.longest[last] + 1), last
        while at >= 0 and symbol not in self.step[at]:
            self.step[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            target = self.step[at][symbol]
            self.link[new] = target if self.longest[target] == self.longest[at] + 1 else self._split(at, symbol, target)
        return new

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))

    def stream(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(end, length, state): the matching statistics of a document, where at least two words match.

        length is that of the longest stretch of words up to ``end`` that stands in any sequence, state its state.
        """
        if len(codes) < 2:
            return
        linked = np.r_[False, self.pairs[codes[:-1], codes[1:]], False]
        edges = np.flatnonzero(linked[1:] != linked[:-1])
        step, link, longest = self.step, self.link, self.longest
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):  # words a .. b are linked pair by pair
            state, length = 0, 0
            for at, symbol in enumerate(codes[a : b + 1].tolist(), a + 1):
                while symbol not in step[state]:  # never at the root: each of these words is in some sequence
                    state = link[state]
                    length = longest[state]
                state = step[state][symbol]
                length += 1
                if length > 1:
                    yield at, length, state


def chained(matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(start, end, covered words) of chains over matches (start, start in the template, length) of one template.

    A chain goes forward in document and template, with at most ``gap`` words between its matches in the document; words that
    two matches share count once. Chains of the most covered words come first; a match serves one chain.
    """
    matches = sorted(set(matches))
    gains, before = [], []
    low = 0
    reached: list[int] = []  # largest end up to each match, so the look-back can stop
    for i, (start, place, length) in enumerate(matches):
        best, came = length, -1
        while low < i and reached[low] + gap < start:
            low += 1
        for j in range(low, i):
            s, p, n = matches[j]
            if s < start and p < place and start - s - n <= gap:
                gain = gains[j] + length - max(0, s + n - start, p + n - place)
                if gain > best:
                    best, came = gain, j
        gains.append(best)
        before.append(came)
        reached.append(max(start + length, reached[-1] if reached else 0))
    out, used = [], [False] * len(matches)
    for i in sorted(range(len(matches)), key=lambda k: (-gains[k], k)):
        if used[i]:
            continue
        at, end = i, matches[i][0] + matches[i][2]
        while True:
            used[at] = True
            nxt = before[at]
            if nxt < 0 or used[nxt]:
                break
            at = nxt
        out.append((matches[at][0], end, gains[i] - (gains[before[at]] if before[at] >= 0 else 0)))
    return sorted(out)


class Scanner:
    """The automaton of phrases and templates, and what each of its states says."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.phrases = list(phrases.items())
        self.labels = [label for label, _ in templates]
        sequences = [words_of(p) for p, _ in self.phrases] + [words_of(t) for _, t in templates]
        if any(len(s) < 2 for s in sequences[: len(self.phrases)]) or any(len(s) < MATCH for s in sequences[len(self.phrases) :]):
            raise ValueError(f"a phrase has two words or more, a template {MATCH}")
        self.lengths = list(map(len, sequences))
        self.automaton = SuffixAutomaton(sequences)
        # phrases that end wherever a state's strings end, with their lengths
        self.said: list[list[tuple[int, int]]] = [[] for _ in self.automaton.link]
        for k in range(len(self.phrases)):
            state = 0
            for symbol in self.automaton.coded[k]:
                state = self.automaton.step[state][symbol]
            for v in range(len(self.said)):
                up = v
                while up > 0 and up != state:
                    up = self.automaton.link[up]
                if up == state:
                    self.said[v].append((k, self.lengths[k]))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """(label, start) of every phrase; (label, start, end, share covered) of every chain. Word numbers, end exclusive."""
        first = len(self.phrases)
        places, matches = [], {}
        held = None
        for end, length, state in self.automaton.stream(self.automaton.codes(words)):
            places += [(self.phrases[k][1], end - n) for k, n in self.said[state] if length >= n]
            if held and (held[0] + 1 != end or held[1] + 1 != length):
                self._note(held, matches, first)
            held = (end, length, state)
        if held:
            self._note(held, matches, first)
        spans = [(self.labels[which - first], s, e, covered / self.lengths[which])
                 for which, own in matches.items() for s, e, covered in chained(own, GAP)]
        return places, sorted(spans, key=lambda x: (x[1], x[2], x[0]))

    def _note(self, match: tuple[int, int, int], matches: dict, first: int) -> None:
        """A match that does not grow any further, at each place of the templates where it stands."""
        end, length, state = match
        if length >= MATCH:
            for which, place in self.automaton.ends[state]:
                if which >= first:
                    matches.setdefault(which, []).append((end - length, place - length, length))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None,
         phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, places (label, start), spans (label, start, end, covered): a row for each row of ``docs``.

    Texts are read as words (letters, digits and non-ASCII, A-Z lower-cased), numbered from 0, and streamed through one
    suffix automaton of all phrases and templates. ``places`` are all occurrences of the phrases; ``spans`` are chains of matches of MATCH
    words or more with one template, with the share of the template that they cover.

    Whole texts; null and empty ones have no words, places or spans. Null ids and repeated rows come back as they are; an
    empty table gives none. Other columns play no part, so none can clash. Templates are few and go with the task's code.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))
        for batch in batches:
            sizes, places, spans = [], [], []
            for text in batch["text"].to_pylist():
                words = words_of(text)
                sizes.append(len(words))
                found, chains = scanner.scan(words)
                places.append([{"label": x, "start": s} for x, s in found])
                spans.append([{"label": x, "start": s, "end": e, "covered": c} for x, s, e, c in chains])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(places, place), pa.array(spans, span)],
                                             ["doc_id", "n_words", "places", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(run, """doc_id long, n_words long, places array<struct<label:string,start:long>>,
        spans array<struct<label:string,start:long,end:long,covered:double>>""")


def digests(found: DataFrame, cover: float = COVER) -> DataFrame:
    """Counts and labels. ``labels`` joins those of phrases and of chains that cover ``cover`` of a template; score is the largest
    share covered, 1 where a phrase stands, 0 where nothing matches."""
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    more = F.transform(F.filter("spans", lambda s: s["covered"] >= cover), lambda s: s["label"])
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    share = F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.array_union(base, more)).alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(share).alias("score"), spans.alias("spans"))
