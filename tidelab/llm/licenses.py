"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds every substring of the templates' words. A text's words are streamed through it:
at each word it gives the matching statistic, the length of the longest template substring that ends
there. Maximal long matches are chained, per template and in order on both sides, into spans; the
share of the template's words that a chain covers is its score, and a chain that covers enough gives
the template's label. Base phrases are templates too; the state a word reaches tells through its
suffix links which phrases end there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelab.llm.common import ship, utf8

#: Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices as their licences word them, and their labels.
TEMPLATES = (
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation either version 3 of the license or at your option "
     "any later version this program is distributed in the hope that it will be useful but without any warranty "
     "without even the implied warranty of merchantability or fitness for a particular purpose", "gpl-notice"),
    ("this work is licensed under the gnu general public license version 3", "gpl-notice"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
     "the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
     "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
     "without warranties or conditions of any kind either express or implied", "apache-notice"),
    ("licensed under the apache license version 2 0", "apache-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the "
     "rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit-notice"),
    ("released under the mit license", "mit-notice"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met redistributions of source code must retain the above copyright notice", "bsd-notice"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-notice"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-notice"),
    ("licensed under cc by 4 0", "cc-by-notice"),
)

_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of letters, digits and non-ASCII bytes."""
    return text.translate(_WORD).split()


@dataclass
class SuffixAutomaton:
    """States of the generalised suffix automaton. ``ends[s]`` are the (template, last word) places
    of the state's strings; ``phrases[s]`` the (phrase, words) that are suffixes of them."""

    words: dict[bytes, int]
    step: list[dict[int, int]]
    link: list[int]
    longest: list[int]
    ends: list[tuple]
    phrases: list[tuple]


def build(templates: tuple, phrases: tuple) -> SuffixAutomaton:
    texts = [words_of(t.encode()) for t, _ in (*phrases, *templates)]
    words: dict[bytes, int] = {}
    step, link, longest = [{}], [-1], [0]
    ends: list[set] = [set()]

    def state(at: int, length: int) -> int:
        step.append(dict(at_step) if (at_step := at and step[at]) else {})
        link.append(-1)
        longest.append(length)
        ends.append(set())
        return len(step) - 1

    def extend(last: int, w: int) -> int:
        known = step[last].get(w)
        if known is not None and longest[known] == longest[last] + 1:
            return known
        here = None if known is not None else state(0, longest[last] + 1)
        p = last
        while here is not None and p >= 0 and w not in step[p]:
            step[p][w] = here
            p = link[p]
        if p < 0:
            link[here] = 0
            return here
        q = step[p][w]
        if longest[q] == longest[p] + 1:
            link[here] = q
            return here
        clone = state(q, longest[p] + 1)
        link[clone], link[q] = link[q], clone
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = clone
            p = link[p]
        if here is None:
            return clone
        link[here] = clone
        return here

    finals = []
    for no, text in enumerate(texts):
        last = 0
        for i, word in enumerate(text):
            last = extend(last, words.setdefault(word, len(words)))
        finals.append(last)
    # Places: every prefix of a template ends in a state; suffix links pass places on.
    for no, text in enumerate(texts):
        s = 0
        for i, word in enumerate(text):
            s = step[s][words[word]]
            ends[s].add((no, i))
    order = sorted(range(1, len(step)), key=lambda s: -longest[s])
    for s in order:
        if link[s] > 0:
            ends[link[s]] |= ends[s]
    own: dict[int, list] = {}
    for no in range(len(phrases)):
        own.setdefault(finals[no], []).append((no, len(texts[no])))
    held: list[tuple] = [()] * len(step)
    for s in reversed(order):
        held[s] = (*own.get(s, ()), *held[link[s]])
    first = len(phrases)
    return SuffixAutomaton(
        words, step, link, longest,
        [tuple(sorted((no - first, i) for no, i in e if no >= first)) for e in ends], held,
    )


def matching_statistics(ids: list[int], sam: SuffixAutomaton) -> Iterator[tuple[int, int]]:
    """For each word id (-1: unknown) the state reached and the length of the longest match."""
    step, link, longest = sam.step, sam.link, sam.longest
    s = length = 0
    for w in ids:
        nxt = step[s].get(w)
        while nxt is None and s:
            s = link[s]
            length = longest[s]
            nxt = step[s].get(w)
        if nxt is None:
            length = 0
        else:
            s = nxt
            length += 1
        yield s, length


@dataclass
class Chain:
    template: int
    begin: int
    end: int
    t_end: int
    covered: int


def scan(text: bytes, sam: SuffixAutomaton, sizes: list[int], least: int, gap: int):
    """``(number of words, base places, chains)``: base places as (word, phrase), chains in order."""
    words = words_of(text)
    n = len(words)
    ids = np.fromiter(map(sam.words.get, words, repeat(-1)), np.int32, n)
    known = np.flatnonzero(ids >= 0)
    places: list[tuple[int, int]] = []
    matches: list[tuple[int, int, int]] = []  # first word, last word, state
    if len(known) > 1:
        cuts = np.flatnonzero(np.diff(known) > 1) + 1
        begins, ends = known[np.r_[0, cuts]], known[np.r_[cuts - 1, len(known) - 1]]
        wide = ends > begins  # one word alone is no phrase and no long match
        for a, b in zip(begins[wide].tolist(), ends[wide].tolist(), strict=True):
            before = (0, 0)
            for i, (s, length) in enumerate(matching_statistics(ids[a : b + 1].tolist(), sam), a):
                for no, size in sam.phrases[s]:
                    if size <= length:
                        places.append((i - size + 1, no))
                if before[1] >= least and length != before[1] + 1:
                    matches.append((i - before[1], i - 1, before[0]))
                before = (s, length)
            if before[1] >= least:
                matches.append((b - before[1] + 1, b, before[0]))
    open_: dict[int, Chain] = {}
    done: list[Chain] = []
    for begin, end, s in matches:
        for no, t_end in sam.ends[s]:
            length = min(end - begin + 1, t_end + 1)
            c = open_.get(no)
            t_begin = t_end - length + 1
            if c and begin - c.end <= gap and c.t_end < t_end and t_begin - c.t_end <= gap and end > c.end:
                new = min(length, t_end - c.t_end, end - c.end)
                c.end, c.t_end, c.covered = end, t_end, c.covered + new
            elif not c or length > c.covered or begin - c.end > gap:
                if c:
                    done.append(c)
                open_[no] = Chain(no, end - length + 1, end, t_end, length)
    done += open_.values()
    return n, places, done


ROW = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, begin: long, end: long, covered: double>>"
)
_SPANS = pa.list_(
    pa.struct([("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])
)


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES,
    phrases: tuple = PHRASES, least: int = 3, gap: int = 8, enough: float = 0.6,
) -> DataFrame:
    """One row per row of ``docs``: number of words, places of the base phrases (``n_base``, the first
    and the last as word numbers from 0, else null), their labels, all labels (base ones and those of
    templates covered to ``enough`` or more; distinct, sorted, comma-joined), ``score`` (the best
    share of a template covered; 1 if a base phrase stands) and the covered ``spans``.

    ``least`` is the words of a long match, ``gap`` the words a chain may skip on either side. Null
    texts count as empty: no words, no labels, score 0. Repeated rows each get their row, other
    columns are not read, an empty table gives no rows. The automaton's size depends on the templates
    alone; it goes with the task."""
    ship(docs.sparkSession)
    sam = build(templates, phrases)
    sizes = [len(words_of(t.encode())) for t, _ in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).cast(pa.binary()):
                n, places, chains = scan(text.as_py(), sam, sizes, least, gap)
                starts = [p[0] for p in places]
                base = sorted({phrases[no][1] for _, no in places})
                spans = sorted(
                    (c.begin, c.end + 1, templates[c.template][1], min(1.0, c.covered / sizes[c.template]))
                    for c in chains
                    if c.covered / sizes[c.template] >= enough
                )
                best = max((c.covered / sizes[c.template] for c in chains), default=0.0)
                out.append((
                    n, len(places), min(starts, default=None), max(starts, default=None), ",".join(base),
                    ",".join(sorted({*base, *(s[2] for s in spans)})), 1.0 if places else min(1.0, best),
                    [{"label": s[2], "begin": s[0], "end": s[1], "covered": s[3]} for s in spans],
                ))
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPANS]
            names = [c.split()[0] for c in ROW.split(", ")[:7]] + ["spans"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, {ROW}")
