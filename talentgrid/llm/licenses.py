"""License scans: phrases, and templates whose markup is compiled into automata over words.

Texts are lower-cased (A-Z) and cut into words of digits, letters and bytes from 0x80. A phrase is found where its words
stand in a row. A template is license wording with markup:

    <<beginOptional>> ... <<endOptional>>    may be left out; may be nested
    <<var; words=0..12>>                     that many words of any kind

Everything else is mandatory and must match word for word. A template becomes a nondeterministic automaton whose
states are places in the wording; it is started at every word that can begin it and reads until it accepts or dies, so
one start reads at most the template's longest form. The longest accepted form counts, and a template's matches do
not overlap. Texts without the longest mandatory word of a template are passed over.

Null text is an empty text: no words, no matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from talentgrid.llm import words as W

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if _LETTER[c] else 32 for c in range(256))

#: Phrase and label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label and public license wording, with markup.
TEMPLATES = [
    ("mit-notice", "<<beginOptional>>this <<var; words=1..3>> is<<endOptional>> <<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> <<beginOptional>>distributed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("apache-2.0-notice", "<<beginOptional>>this <<var; words=1..3>> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> apache license version 2 0"),
    ("cc-by-nc-4.0-notice", "<<beginOptional>>this <<var; words=1..3>> is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by nc 4 0 <<beginOptional>>international<<endOptional>> <<beginOptional>>license<<endOptional>>"),
    ("gpl-3.0-notice", "this <<var; words=1..3>> is licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license version 3 <<beginOptional>>0<<endOptional>> <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>"),
    ("gpl-3.0-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or <<beginOptional>>at your option<<endOptional>> any later version"),
    (
        "mit",
        "<<beginOptional>><<beginOptional>>the<<endOptional>> mit license<<endOptional>> <<beginOptional>>copyright <<beginOptional>>c<<endOptional>> <<var; words=1..12>><<endOptional>> "
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
        "<<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software",
    ),
    ("isc", "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<beginOptional>>1<<endOptional>> "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in "
        "binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
]


class Automaton(NamedTuple):
    """moves: by state, (word or None for any word, next state); free: states reached without a word."""

    label: str
    moves: list[list[tuple[bytes | None, int]]]
    free: list[list[int]]
    accept: int
    begin: frozenset[int]
    first: frozenset[bytes]
    anchor: bytes


def compile_template(label: str, template: str) -> Automaton:
    moves, free, open_, anchor = [[]], [[]], [], b""

    def state() -> int:
        moves.append([])
        free.append([])
        return len(moves) - 1

    now = 0
    for part in re.findall(r"<<[^>]*>>|[^<]+", template):
        if part == "<<beginOptional>>":
            open_.append(now)
            new = state()
            free[now].append(new)
            now = new
        elif part == "<<endOptional>>":
            if not open_:
                raise ValueError(f"{label}: no optional region is open")
            new = state()
            free[now].append(new)
            free[open_.pop()].append(new)
            now = new
        elif part.startswith("<<"):
            limits = re.fullmatch(r"<<var; words=(\d+)\.\.(\d+)>>", part)
            if not limits:
                raise ValueError(f"{label}: unknown markup {part}")
            least, most = map(int, limits.groups())
            inner = [now]
            for _ in range(most):
                inner.append(state())
                moves[inner[-2]].append((None, inner[-1]))
            now = state()
            for s in inner[least:]:
                free[s].append(now)
        else:
            for word in part.encode().translate(_FOLD).split():
                new = state()
                moves[now].append((word, new))
                now = new
                if not open_ and len(word) > len(anchor):
                    anchor = word
    if open_ or not anchor:
        raise ValueError(f"{label}: an optional region stays open, or no word is mandatory")
    begin = _reach(free, {0})
    first = {w for s in begin for w, _ in moves[s]}
    if None in first or now in begin:
        raise ValueError(f"{label}: it must begin with a word")
    return Automaton(label, moves, free, now, frozenset(begin), frozenset(first), anchor)


def _reach(free: list[list[int]], states: set[int]) -> set[int]:
    todo = list(states)
    while todo:
        for s in free[todo.pop()]:
            if s not in states:
                states.add(s)
                todo.append(s)
    return states


def accepted(automaton: Automaton, words: list[bytes], start: int) -> int:
    """The end of the longest form that starts at this word, or 0."""
    states, end = set(automaton.begin), 0
    for i in range(start, len(words)):
        word = words[i]
        states = {n for s in states for w, n in automaton.moves[s] if w is None or w == word}
        if not states:
            break
        states = _reach(automaton.free, states)
        if automaton.accept in states:
            end = i + 1
    return end


def matches(automaton: Automaton, words: list[bytes]) -> list[tuple[int, int]]:
    """(from, to) of the matches, which do not overlap."""
    out, free = [], 0
    for i, word in enumerate(words):
        if i >= free and word in automaton.first:
            end = accepted(automaton, words, i)
            if end:
                out.append((i, end))
                free = end
    return out


SCAN = "doc_id long, n_words long, phrases array<struct<label:string,at:int>>, templates array<struct<label:string,from:int,to:int>>"


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, phrases, templates) of every row of `docs` (doc_id, text): all places, in order."""
    told = [(tuple(p.encode().translate(_FOLD).split()), label) for p, label in (PHRASES if phrases is None else phrases).items()]
    automata = [compile_template(*t) for t in (TEMPLATES if templates is None else templates)]
    places = pa.list_(pa.struct([("label", pa.string()), ("at", pa.int32())]))
    spans = pa.list_(pa.struct([("label", pa.string()), ("from", pa.int32()), ("to", pa.int32())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = {a.anchor for a in automata} | {max(p, key=len) for p, _ in told}
        for x in W.slices(batches):
            data, at = W.text_bytes(x.column(1))
            solid = _LETTER[data]
            if len(data):
                cut = np.zeros(len(data) + 1, bool)
                cut[at] = True
                solid[1:] &= ~solid[:-1] | cut[1:-1]
            counts = np.diff(np.concatenate([[0], np.cumsum(solid)])[at])
            low, found, fitting = data.tobytes().translate(_FOLD), [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                text = low[i:j]
                present = {a for a in anchors if a in text}
                base, full = [], []
                if present:
                    words = text.split()
                    where: dict[bytes, list[int]] = {}
                    heads = {p[0] for p, _ in told}
                    for k, w in enumerate(words):
                        if w in heads:
                            where.setdefault(w, []).append(k)
                    for phrase, label in told:
                        base += [{"label": label, "at": k} for k in where.get(phrase[0], []) if tuple(words[k : k + len(phrase)]) == phrase]
                    for a in automata:
                        if a.anchor in present:
                            full += [{"label": a.label, "from": b, "to": e} for b, e in matches(a, words)]
                found.append(sorted(base, key=lambda m: (m["at"], m["label"])))
                fitting.append(sorted(full, key=lambda m: (m["from"], m["to"], m["label"])))
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(counts.astype(np.int64)), pa.array(found, places), pa.array(fitting, spans)], names=["doc_id", "n_words", "phrases", "templates"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(look, SCAN)
