"""Licence texts in documents, found with a generalised suffix automaton of the templates' words.

The automaton accepts every run of words of any template. Words stream through it: after each word it knows the longest
run, ending there, that occurs in a template (the matching statistics). Maximal runs of at least MIN_RUN words are
chained per template, in order and with gaps of at most MAX_GAP words in the document and in the template, into spans; a span's cover is the part of the template's
words in it. Templates are opening terms, whole licence texts and short notices; a label may have several. A span of opening
terms counts from a cover of MIN_COVER on, one of a whole text from MIN_WORDS words or that cover on, so that any paragraph of it
is found, and one of a notice from a cover of NOTICE_COVER on. Stretches without MIN_RUN successive known word pairs can't hold a run and are skipped.

Besides, phrases (base) are looked up in all places.

Cases: a null text is an empty text; an empty text has no words, spans or phrases; texts are read whole; repeated rows
get equal results; a run that occurs in several templates counts for each of them; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame

from sparkfacet.llm._arrow import ALNUM, slices, text_buffers, word_hashes
from sparkfacet.llm.license_texts import NOTICES, TEXTS

MIN_RUN, MAX_GAP, MIN_COVER, MIN_WORDS, NOTICE_COVER = 5, 12, 0.3, 20, 0.8

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices of common licences as their authors publish them, shortened to the opening terms.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def hashes_of(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]), ALNUM)[0]


class Automaton:
    """Suffix automaton of several word sequences; ends: for each state the (template, position) where its runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for t, sequence in enumerate(sequences):
            last = 0
            for k, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].add((t, k))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        self.ends = [sorted(e) for e in ends]

    def _state(self, length: int, nxt: dict[int, int], link: int, ends: list) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        ends.append(set())
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int, ends: list) -> int:
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target], ends)
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int, ends: list) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known, ends)
        new, state = self._state(self.length[last] + 1, {}, 0, ends), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, word, target, ends)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest run ending here) after each word."""
        state, length = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                state, length = 0, 0
            yield state, length


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str], min_run: int = MIN_RUN, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER, whole: dict[str, tuple[str, ...]] | None = None, notices: dict[str, tuple[str, ...]] | None = None):
        self.min_run, self.max_gap = min_run, max_gap
        every = [(label, words_of(t), 0) for label, t in templates.items()]
        every += [(label, words_of(t), kind) for kind, of in ((1, whole or {}), (2, notices or {})) for label, ts in of.items() for t in ts]
        self.labels, texts = [e[0] for e in every], [e[1] for e in every]
        self.sizes = [len(t) for t in texts]
        #: Words from which on a template's span counts.
        self.least = [(min_cover * len(t), min(min_cover * len(t), MIN_WORDS), NOTICE_COVER * len(t))[kind] for _, t, kind in every]
        vocabulary = sorted({w for t in texts for w in t})
        hashes = hashes_of(vocabulary)
        order = np.argsort(hashes)
        self.known, number = hashes[order], {vocabulary[k]: n for n, k in enumerate(order.tolist())}
        sequences = [[number[w] for w in t] for t in texts]
        self.automaton, self.sequences = Automaton(sequences), sequences
        self.pairs = np.zeros((len(number) + 1, len(number) + 1), bool)
        for s in sequences:
            self.pairs[s[:-1], s[1:]] = True
        self.phrases = [(hashes_of(p.split()), label) for p, label in phrases.items()]

    def scan(self, hashes: np.ndarray) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """Phrases (label, first word) and template spans (label, first word, end, cover) of one document's words."""
        base = []
        for phrase, label in self.phrases:
            n = len(hashes) - len(phrase) + 1
            if n > 0:
                hit = hashes[:n] == phrase[0]
                for k in range(1, len(phrase)):
                    hit = hit & (hashes[k : n + k] == phrase[k])
                base += [(label, int(w)) for w in np.flatnonzero(hit)]
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        ids = np.where(self.known[at] == hashes, at, len(self.known))
        runs: list[tuple[int, int, int, int]] = []  # template, place in it, first word, words
        if len(ids) >= self.min_run:
            edge = np.flatnonzero(np.diff(np.concatenate([[False], self.pairs[ids[:-1], ids[1:]], [False]]).astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b - a + 1 >= self.min_run:
                    runs += self._runs(ids[a : b + 1].tolist(), a)
        return base, self._chain(runs)

    def _runs(self, words: list[int], start: int) -> list[tuple[int, int, int, int]]:
        """The maximal runs of each place of a template, also those that end within a longer run of another one."""
        out, auto = [], self.automaton
        for k, (state, n) in enumerate(auto.statistics(words)):
            after, seen = words[k + 1] if k + 1 < len(words) else None, set()
            while n >= self.min_run:
                for t, end in auto.ends[state]:
                    if (t, end) not in seen:
                        seen.add((t, end))
                        if end + 1 == self.sizes[t] or self.sequences[t][end + 1] != after:
                            out.append((t, end - n + 1, start + k + 1 - n, n))
                state = auto.link[state]
                n = auto.length[state]
        return out

    def _chain(self, runs: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        out = []
        for t in sorted({r[0] for r in runs}):
            chains: list[list[int]] = []  # first word, end, place in the template after it, words covered
            for _, place, first, n in sorted(r for r in runs if r[0] == t):
                chains.append([first, first + n, place, n])
            chains.sort()
            done: list[list[int]] = []
            near: list[list[int]] = []  # those that may go on
            for first, end, place, n in chains:
                near = [c for c in near if first - c[1] <= self.max_gap]
                last = max((c for c in near if abs(place - c[2]) <= self.max_gap), key=lambda c: c[3], default=None)
                if last:
                    fresh = max(0, end - max(first, last[1]))
                    last[1], last[2], last[3] = max(last[1], end), max(last[2], place + n), last[3] + fresh
                else:
                    done.append([first, end, place + n, n])
                    near.append(done[-1])
            out += [(self.labels[t], a, b, min(1.0, n / self.sizes[t])) for a, b, _, n in done if n >= self.least[t]]
        return out


@lru_cache(4)
def _scanner(templates: tuple, phrases: tuple, whole: tuple, notices: tuple) -> Scanner:
    return Scanner(dict(templates), dict(phrases), whole=dict(whole), notices=dict(notices))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, whole: dict[str, tuple[str, ...]] | None = None, notices: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """id_col, n_words, base (array of struct<label, word>) and spans (array of struct<label, start, end, cover>, in words).
    templates, whole and notices: opening terms, whole texts and short notices of each label. Given templates alone stand by themselves."""
    kind = docs.schema[id_col].dataType.simpleString()
    rest = ({}, {}) if templates else (TEXTS, NOTICES)
    key = tuple(tuple(of.items()) for of in (templates or TEMPLATES, phrases or PHRASES, rest[0] if whole is None else whole, rest[1] if notices is None else notices))
    base_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    span_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*key)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                hashes, counts = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
                found = [scanner.scan(h) for h in np.split(hashes, np.cumsum(counts)[:-1])]
                base = [[{"label": x, "word": w} for x, w in f] for f, _ in found]
                spans = [[dict(zip(("label", "start", "end", "cover"), s)) for s in f] for _, f in found]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(counts), pa.array(base, base_type), pa.array(spans, span_type)], names=["id", "n_words", "base", "spans"])

    schema = f"id {kind}, n_words long, base array<struct<label: string, word: long>>, spans array<struct<label: string, start: long, end: long, cover: double>>"
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
