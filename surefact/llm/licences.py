"""Licence scan: matching statistics over a generalised suffix automaton of licence words.

The automaton holds all templates (whole notices and short phrases). A text streams through it word by
word; the state gives the longest run of words ending there that stands in some template. Maximal runs of
`min_match` words or more are chained along each template, with rising template places and gaps of at
most `max_gap` words, into covered spans; a template counts as present when a chain covers `min_cover` of it.
Phrases are templates that must be covered whole, at every place.

Defined results: a null or empty text has no words, no labels and score 0. Words outside every template
only reset the automaton. Texts of any length stream in bounded memory; equal rows give equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import raw_texts, slices, tidy
from .hashing import ALNUM, Chunk, Table, hash_words

#: Phrases and their labels (fixed values).
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Public notices and their labels (fixed values).
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
)


class SuffixAutomaton:
    """Of several sequences of numbers; each state knows all places where its longest run ends in each sequence."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        for which, seq in enumerate(sequences):
            last = 0
            for place, x in enumerate(seq):
                last = self.extend(last, x)
                self.ends[last].setdefault(which, []).append(place)
        # What ends at a state also ends at those that its link names.
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.ends[self.link[v]]
            for which, places in self.ends[v].items():
                up[which] = sorted({*places, *up.get(which, ())})

    def new(self, size: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        self.ends.append({})
        return len(self.size) - 1

    def split(self, p: int, q: int, x: int) -> int:
        """The state of exactly size[p] + 1 words below q."""
        if self.size[q] == self.size[p] + 1:
            return q
        c = self.new(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = c
            p = self.link[p]
        return c

    def extend(self, last: int, x: int) -> int:
        if x in self.next[last]:
            return self.split(last, self.next[last][x], x)
        new, p = self.new(self.size[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self.split(p, self.next[p][x], x)
        return new


class Scanner:
    def __init__(self, phrases: tuple = PHRASES, notices: tuple = NOTICES, min_match: int = 3, max_gap: int = 6, min_cover: float = 0.75):
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        own = [words_of(t) for t, _ in phrases] + [words_of(t) for _, t in notices]
        self.labels = [x for _, x in phrases] + [x for x, _ in notices]
        self.n_phrases, self.sizes = len(phrases), [len(x) for x in own]
        self.least, self.longest = min([min_match, *self.sizes[: self.n_phrases]]), max(self.sizes)
        names = sorted({w for x in own for w in x})
        number = {w: k for k, w in enumerate(names)}
        self.known = Table(len(names))
        self.known.put(hash_words(names), np.arange(len(names), dtype=np.int32))
        self.auto = SuffixAutomaton([[number[w] for w in x] for x in own])
        # Phrases that end at each state, by going up its links once.
        a = self.auto
        self.phrase_at: list[tuple[int, ...]] = [()] * len(a.size)
        home = {}
        for k in range(self.n_phrases):
            v = 0
            for w in own[k]:
                v = a.next[v][number[w]]
            home[v] = (*home.get(v, ()), k)
        for v in sorted(range(len(a.size)), key=a.size.__getitem__):
            self.phrase_at[v] = home.get(v, ()) + (self.phrase_at[a.link[v]] if v else ())

    def run(self, ids: list[int], start: int, phrases: list[tuple[int, int]], matches: list[tuple[int, int, int]]) -> None:
        """Stream one run of template words that starts at word `start` of its text.

        phrases gets (phrase, start); matches gets maximal (start, words, state)."""
        a, sizes = self.auto, self.sizes
        v = n = 0
        for k, x in enumerate(ids):
            if x not in a.next[v] and n >= self.min_match:
                matches.append((start + k - n, n, v))
            while v and x not in a.next[v]:
                v = a.link[v]
                n = a.size[v]
            v = a.next[v].get(x, 0)
            n = n + 1 if v else 0
            for p in self.phrase_at[v]:
                if sizes[p] <= n:
                    phrases.append((p, start + k + 1 - sizes[p]))
        if n >= self.min_match:
            matches.append((start + len(ids) - n, n, v))

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, share covered) of the best chains that do not overlap within a template.

        A match counts at each place that it has in a template. One follows another within max_gap words of the text and of the
        template, in order in both; where they overlap, the later one loses its beginning. Matches that fit badly are passed over."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, n, v in matches:
            for t, ends in self.auto.ends[v].items():
                if t >= self.n_phrases:
                    by.setdefault(t, []).extend((start, n, end + 1 - n) for end in ends)
        out = []
        for t, own in by.items():
            own.sort()
            best: list[tuple[int, int]] = []  # words covered by the best chain up to here, where it begins
            for j, (start, n, place) in enumerate(own):
                covered, first = n, start
                for i in range(j - 1, -1, -1):
                    before, m, at = own[i]
                    if before + self.longest + self.max_gap < start:
                        break  # so do all earlier ones
                    cut = max(0, before + m - start, at + m - place)
                    if cut < n and start + cut - before - m <= self.max_gap and place + cut - at - m <= self.max_gap and best[i][0] + n - cut > covered:
                        covered, first = best[i][0] + n - cut, best[i][1]
                best.append((covered, first))
            taken: list[tuple[int, int]] = []
            for j in sorted(range(len(own)), key=lambda j: (-best[j][0], own[j])):
                covered, first = best[j]
                end = own[j][0] + own[j][1]
                if covered < self.min_cover * self.sizes[t]:
                    break
                if all(end <= a or first >= b for a, b in taken):
                    taken.append((first, end))
                    out.append((t, first, end, covered / self.sizes[t]))
        return sorted(out)

    def scan(self, raw: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]]:
        """Of each text: number of words, phrases as (phrase, start), covered template spans."""
        c = Chunk(raw, ALNUM)
        ids = self.known.get(c.key)
        out: list = [(n, [], []) for n in c.counts.tolist()]
        hit = np.nonzero(ids >= 0)[0]
        if not len(hit):
            return out
        cuts = np.nonzero((np.diff(hit) != 1) | (np.diff(c.word_doc[hit]) != 0))[0] + 1
        begin, end = np.append(0, cuts), np.append(cuts, len(hit))
        long = end - begin >= self.least  # shorter runs are neither a phrase nor a match
        matches: dict[int, list[tuple[int, int, int]]] = {}
        docs, firsts, ids_hit = c.word_doc[hit], hit - c.first[c.word_doc[hit]], ids[hit].tolist()
        for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            d = int(docs[b])
            self.run(ids_hit[b:e], int(firsts[b]), out[d][1], matches.setdefault(d, []))
        for d, m in matches.items():
            if m:
                out[d][2].extend(self.chain(m))
        return out


def words_of(text: str) -> list[bytes]:
    c = Chunk([text.encode()], ALNUM)
    return [c.word(k) for k in range(len(c.starts))]


@cache
def scanner(**options) -> Scanner:  # type: ignore[no-untyped-def]
    return Scanner(**options)


def scan(df: DataFrame, **options) -> DataFrame:  # type: ignore[no-untyped-def]
    """Per row of (doc_id, text): n_words, phrases array<struct<label,start>>, spans array<struct<label,start,end,cover>>."""
    schema = "n_words long, phrases array<struct<label:string,start:long>>, spans array<struct<label:string,start:long,end:long,cover:double>>"
    kinds = pa.struct([("label", pa.string()), ("start", pa.int64())]), pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(**options)
        for batch in batches:
            for part in slices(batch, "text"):
                found = s.scan(raw_texts(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([n for n, _, _ in found], pa.int64()),
                        pa.array([[{"label": s.labels[p], "start": at} for p, at in x] for _, x, _ in found], pa.list_(kinds[0])),
                        pa.array([[{"label": s.labels[t], "start": a, "end": b, "cover": share} for t, a, b, share in x] for _, _, x in found], pa.list_(kinds[1])),
                    ],
                    ["doc_id", "n_words", "phrases", "spans"],
                )

    src = df.select("doc_id", "text")
    return src.mapInArrow(tidy(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {schema}")
