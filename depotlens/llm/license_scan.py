"""Licence scan by matching statistics over licence templates.

The words of all templates form one generalised suffix automaton.  A text is streamed through it: at every
word the automaton knows the longest run of words, ending there, that occurs in some template.  Runs that
cannot be extended and have at least ``MIN_MATCH`` words are matches; matches in the same order in text
and template, with small gaps, are chained into spans, and a span that covers enough of its template
labels the document.  Base phrases are counted apart, at every place where their words stand in a row.

Each document is scanned in its own row; nothing is shuffled and the templates travel with the task.

Defined cases: a null text counts as empty and has no words; repeated rows are scanned separately; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")
SEGMENT = 1 << 20
MIN_MATCH, MAX_GAP, MIN_COVERAGE, BASE_SCORE = 3, 8, 0.6, 0.5

# Phrases that count as base places, and public licence notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software"),
    ("apache", "licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the "
               "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the "
            "License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]


def words_of(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, cut at every other ASCII character."""
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower())


@dataclass
class State:
    length: int = 0
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    #: Template to the end of one place where the state's words occur in it.
    ends: dict[int, int] = field(default_factory=dict)


class SuffixAutomaton:
    """All factors of several word sequences."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.states = [State()]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._add(last, symbol)
                self.states[last].ends.setdefault(number, at)
        for state in sorted(self.states[1:], key=lambda s: -s.length):
            for number, at in state.ends.items():
                self.states[state.link].ends.setdefault(number, at)

    def _split(self, origin: int, symbol: int, target: int) -> int:
        """The copy of ``target`` whose longest word ends right after ``origin``."""
        states = self.states
        old = states[target]
        copy = len(states)
        states.append(State(states[origin].length + 1, old.link, dict(old.next), dict(old.ends)))
        old.link = copy
        while origin >= 0 and states[origin].next.get(symbol) == target:
            states[origin].next[symbol] = copy
            origin = states[origin].link
        return copy

    def _add(self, last: int, symbol: int) -> int:
        states = self.states
        if symbol in states[last].next:  # seen in an earlier sequence
            target = states[last].next[symbol]
            if states[target].length == states[last].length + 1:
                return target
            return self._split(last, symbol, target)
        new = len(states)
        states.append(State(states[last].length + 1, 0))
        origin = last
        while origin >= 0 and symbol not in states[origin].next:
            states[origin].next[symbol] = new
            origin = states[origin].link
        if origin >= 0:
            target = states[origin].next[symbol]
            near = states[target].length == states[origin].length + 1
            states[new].link = target if near else self._split(origin, symbol, target)
        return new

    def statistics(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """At every symbol: the longest factor that ends there, and its state."""
        states, state, length = self.states, 0, 0
        for symbol in symbols:
            while state and symbol not in states[state].next:
                state = states[state].link
                length = states[state].length
            if symbol in states[state].next:
                state = states[state].next[symbol]
                length += 1
            else:
                length = 0
            yield length, state


@dataclass(frozen=True)
class Span:
    """Words ``first`` to ``last`` of a text that follow a template."""

    template: int
    first: int
    last: int
    coverage: float


class LicenseScanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]) -> None:
        sequences = [words_of(text) for _, text in templates]
        self.labels = [label for label, _ in templates]
        bases = {phrase: words_of(phrase) for phrase in phrases}
        known = sorted({w for s in [*sequences, *bases.values()] for w in s})
        self.ids = {word: i for i, word in enumerate(known)}
        self.lengths = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton([[self.ids[w] for w in s] for s in sequences])
        self.phrases = [(phrases[p], [self.ids[w] for w in ws]) for p, ws in bases.items()]

    def symbols(self, text: str) -> np.ndarray:
        """Numbers of the words of a text, -1 for words of no template; segment by segment."""
        raw = text.encode("utf-8", "surrogatepass").lower()
        found, begin = [], 0
        while begin < len(raw):
            cut = BREAK.search(raw, begin + SEGMENT)
            end = cut.start() if cut else len(raw)
            words = WORDS.findall(raw, begin, end)
            found.append(np.fromiter(map(self.ids.get, words, repeat(-1)), np.int32, len(words)))
            begin = end
        return np.concatenate(found) if found else np.zeros(0, np.int32)

    def places(self, symbols: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """Starts of every base phrase."""
        out = []
        for label, phrase in self.phrases:
            n = len(symbols) - len(phrase) + 1
            hit = np.ones(max(n, 0), bool)
            for i, symbol in enumerate(phrase):
                hit &= symbols[i:i + max(n, 0)] == symbol
            out.append((label, np.flatnonzero(hit)))
        return out

    def matches(self, symbols: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Template, its first word, first word in the text, length of every maximal long match."""
        edges = np.flatnonzero(np.diff(np.concatenate([[False], symbols >= 0, [False]]).astype(np.int8)))
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - begin < MIN_MATCH:
                continue
            found = [*self.automaton.statistics(symbols[begin:end].tolist()), (0, 0)]
            for i, (length, state) in enumerate(found[:-1]):
                if length >= MIN_MATCH and found[i + 1][0] <= length:
                    for template, at in self.automaton.states[state].ends.items():
                        yield template, at - length + 1, begin + i - length + 1, length

    def spans(self, symbols: np.ndarray) -> list[Span]:
        """Chains of matches that cover enough of a template, in text order."""
        chains: dict[int, list[list[int]]] = {}
        for template, t, d, length in self.matches(symbols):
            open_ = chains.setdefault(template, [])
            if open_:
                last = open_[-1]  # template end, text start, text end, words covered
                skip_t, skip_d = t - last[0], d - last[2]
                if -length < min(skip_t, skip_d) and max(skip_t, skip_d) <= MAX_GAP:
                    new = length + min(skip_t, skip_d, 0)
                    last[0], last[2], last[3] = t + length, d + length, last[3] + new
                    continue
            open_.append([t + length, d, d + length, length])
        out = [
            Span(template, first, end - 1, min(1.0, covered / self.lengths[template]))
            for template, open_ in chains.items() for _, first, end, covered in open_
        ]
        return sorted((s for s in out if s.coverage >= MIN_COVERAGE), key=lambda s: (s.first, s.template))

    def scan(self, text: str) -> dict:
        symbols = self.symbols(text)
        places = self.places(symbols)
        spans = self.spans(symbols)
        starts = np.concatenate([at for _, at in places]) if places else np.zeros(0, int)
        base = {label for label, at in places if len(at)}
        labels = base | {self.labels[s.template] for s in spans}
        score = max([s.coverage for s in spans] + [BASE_SCORE if len(starts) else 0.0])
        return {
            "n_words": len(symbols),
            "n_base": len(starts),
            "first_word": int(starts.min()) if len(starts) else None,
            "last_word": int(starts.max()) if len(starts) else None,
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(labels)),
            "score": float(score),
            "spans": [
                {"label": self.labels[s.template], "first_word": s.first, "last_word": s.last, "coverage": s.coverage}
                for s in spans
            ],
        }


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, first_word: long, last_word: long, coverage: double>>"
)
_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                   ("coverage", pa.float64())])
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(_SPAN)),
])


def scan_licenses(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None
) -> DataFrame:
    """Labels, base places and template spans of every whole text of ``docs`` (``doc_id``, ``text``)."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(templates, phrases)
        for batch in batches:
            rows = [
                {"doc_id": doc_id.as_py(), **scanner.scan(text.as_py() or "")}
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text"))
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
