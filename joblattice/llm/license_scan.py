"""Licence scans: base phrases, and templates with optional and replaceable regions.

A template is a line of words with two kinds of markup: ``[[ ... ]]`` is a region
that may be missing (regions nest), ``{{n}}`` is replaceable by any words, n at
most.  It is compiled to an automaton over words: a state per word or replaceable
place, entered by reading it, and the set of states that may follow each state,
skipping what may be missing.  A text is accepted at a place where the automaton
can read its way from the template's first word to its end: all mandatory words
stand there exactly and in order.  Of the ends it can reach from one place the
furthest counts, and a template's places don't overlap.

Words are maximal runs of ASCII letters and digits and all non-ASCII characters,
after lower-casing A-Z.  Texts without a template's longest mandatory words are
passed over by a table of the texts' anchor words; that loses nothing.

Edge cases: a null or empty text has no words, no places and score 0; a text of
any length is read whole; repeated rows are judged alike; a null doc_id is kept;
an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

# Phrases of common licences, and wording of their notices.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("mit", "[[this {{3}} is]] released under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"),
    ("apache", "[[this {{3}} is]] licensed under the apache license version 2 0 [[the license you may not use this file except in compliance with the license]]"),
    ("gpl", "[[this {{3}} is]] licensed under the gnu [[lesser]] general public license [[as published by the free software foundation]] [[either]] version {{1}} [[or at your option any later version]]"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu [[lesser]] general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under [[the]] [[a]] cc by nc [[sa]] [[nd]] 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial [[sharealike]] [[noderivatives]] 4 0 [[international]] [[public]] license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "[[the]] mit license [[mit]] [[copyright {{12}}]] permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[{{1}}]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[[[{{1}}]] neither the name of {{16}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]]"),
    ("isc", "the software is provided as is and {{8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu [[lesser]] [[affero]] general public license for more details"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at [[http]] [[https]] mozilla org mpl 2 0"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, n_words long, base array<struct<label:string,start:long,words:int>>, accepted array<struct<label:string,template:int,start:long,words:long>>"


@dataclass
class Automaton:
    """States 1..n read one word each (None: any); ``after[0]`` is where reading starts."""

    label: str
    words: list[str | None]
    after: list[frozenset[int]]
    final: frozenset[int]

    @property
    def mandatory(self) -> list[str]:
        """Words of every accepted text: those whose state no way round avoids."""
        out = []
        for s, word in enumerate(self.words[1:], 1):
            reach, todo = {0}, [0]
            while todo:
                for t in self.after[todo.pop()]:
                    if t != s and t not in reach:
                        reach.add(t)
                        todo.append(t)
            if word is not None and not reach & self.final:
                out.append(word)
        return out

    def furthest(self, codes: list[int], names: dict[str, int]) -> int:
        """Words read up to the furthest end; 0 if no end can be reached."""
        states, best = self.after[0], 0
        for n, code in enumerate(codes, 1):
            states = {s for s in states if self.words[s] is None or names[self.words[s]] == code}
            if states & self.final:
                best = n
            states = frozenset().union(*(self.after[s] for s in states))
            if not states:
                break
        return best


def compile_template(label: str, markup: str) -> Automaton:
    """Walk the markup once, keeping the states that lie directly before the current place."""
    words: list[str | None] = [None]
    after: list[set[int]] = [set()]
    before, opened = {0}, []
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup):
        if token == "[[":
            opened.append(set(before))
        elif token == "]]":
            before |= opened.pop()
        else:
            repeat = int(token[2:-2]) if token.startswith("{{") else None
            for _ in range(1 if repeat is None else repeat):
                words.append(token if repeat is None else None)
                after.append(set())
                for s in before:
                    after[s].add(len(words) - 1)
                before = {len(words) - 1} if repeat is None else before | {len(words) - 1}
    if opened or 0 in before:
        raise ValueError(f"a region is left open, or nothing is mandatory: {markup}")
    if any(words[s] is None for s in after[0]):
        raise ValueError(f"a template has to begin with a word: {markup}")
    return Automaton(label, words, [frozenset(a) for a in after], frozenset(before))


def as_regex(markup: str) -> str:
    """The template as a regular expression over words that each follow one blank."""
    text = re.sub(r"\{\{(\d+)\}\}", lambda m: f"<{m[1]}>", markup)
    out = []
    for token in re.findall(r"\[\[|\]\]|<\d+>|[^\s\[\]<>]+", text):
        out.append({"[[": "(?:", "]]": ")?"}.get(token) or (f"(?: [^ ]+){{0,{token[1:-1]}}}" if token[0] == "<" else f" {token}"))
    return "".join(out)


class _Scanner:
    def __init__(self, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]):
        self.phrases = [(p.split(), label) for p, label in phrases]
        self.automata = [compile_template(*t) for t in templates]
        known = {w for p, _ in self.phrases for w in p} | {w for a in self.automata for w in a.words if w}
        self.names = {w: i for i, w in enumerate(sorted(known), 1)}
        self.anchors = [sorted(set(a.mandatory), key=lambda w: (-len(w), w))[:4] for a in self.automata]
        every = sorted({w for ws in self.anchors for w in ws})
        self.anchor = np.full(len(self.names) + 1, -1, np.int64)
        self.anchor[[self.names[w] for w in every]] = np.arange(len(every))
        self.need = [[every.index(w) for w in ws] for ws in self.anchors]
        self.n_anchors = len(every)

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[list], list[list]]:
        words = tk.split_words(pc.replace_substring_regex(tk.lower_ascii(texts), BREAKS, " "))
        names = self.names
        of_vocab = pc.index_in(words.vocab, pa.array(list(names), words.vocab.type)).fill_null(-1).to_numpy(zero_copy_only=False)
        code = (np.array([0, *names.values()])[of_vocab + 1])[words.ids]
        n, bounds = len(words.bounds) - 1, words.bounds
        base: list[list] = [[] for _ in range(n)]
        found: list[list] = [[] for _ in range(n)]
        owner = words.owner()
        for phrase, label in self.phrases:
            at = np.flatnonzero(code[: max(0, len(code) - len(phrase) + 1)] == names[phrase[0]])
            for j, w in enumerate(phrase[1:], 1):
                at = at[code[at + j] == names[w]]
            at = at[owner[at] == owner[at + len(phrase) - 1]] if len(at) else at
            for i in at.tolist():
                d = int(owner[i])
                base[d].append({"label": label, "start": i - int(bounds[d]), "words": len(phrase)})
        held = np.zeros((n, self.n_anchors), bool)
        anchor = self.anchor[code]
        at = np.flatnonzero(anchor >= 0)
        held[owner[at], anchor[at]] = True
        for t, automaton in enumerate(self.automata):
            starts = {names[automaton.words[s]] for s in automaton.after[0]}
            for d in np.flatnonzero(held[:, self.need[t]].all(axis=1)).tolist():
                part = code[bounds[d] : bounds[d + 1]]
                free = 0
                for i in np.flatnonzero(np.isin(part, list(starts))).tolist():
                    if i >= free and (size := automaton.furthest(part[i : i + len(automaton.words)].tolist(), names)):
                        found[d].append({"label": automaton.label, "template": t, "start": i, "words": size})
                        free = i + size
        return words.counts, base, found


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per document the number of words, the places of base phrases and the accepted spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(phrases, templates)
        kinds = [pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int32())])), pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("words", pa.int64())]))]
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                n, base, found = scanner.scan(batch.column(1))
                yield pa.record_batch([batch.column(0), pa.array(n.astype(np.int64)), pa.array(base, kinds[0]), pa.array(found, kinds[1])], names=["doc_id", "n_words", "base", "accepted"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """Labels and score per document: 1 if a template is accepted, 0.5 if only a base phrase is there, else 0."""
    base, accepted = F.col("base.label"), F.col("accepted.label")
    score = F.when(F.size("accepted") > 0, 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0)
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        _joined(base).alias("base_labels"),
        _joined(F.concat(base, accepted)).alias("labels"),
        score.alias("score"),
    )


def summary_sql(phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """DuckDB SQL for :func:`summary` over ``documents``."""
    starts, labels, tests = [], [], []
    for phrase, label in phrases:
        words = phrase.split()
        same = " AND ".join(f"words[i + {j}] = '{w}'" for j, w in enumerate(words))
        starts.append(f"list_filter(range(1, len(words) + 1), lambda i: {same})")
        labels.append(label)
    of = {label: [as_regex(m) for x, m in templates if x == label] for label, _ in templates}
    for label, patterns in of.items():
        test = " OR ".join(f"regexp_matches(joined, '{p}( |$)')" for p in patterns)
        tests.append(f"CASE WHEN {test} THEN '{label}' END")
    places = ", ".join(f"{s} AS s{i}" for i, s in enumerate(starts))
    all_places = " || ".join(f"s{i}" for i in range(len(starts)))
    base = ", ".join(f"CASE WHEN len(s{i}) > 0 THEN '{x}' END" for i, x in enumerate(labels))
    return rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), p AS (
  SELECT doc_id, words, array_to_string(list_transform(words, lambda x: ' ' || x), '') AS joined, {places} FROM w
), l AS (
  SELECT doc_id, words, {all_places} AS places,
    list_distinct(list_filter([{base}], lambda x: x IS NOT NULL)) AS b,
    list_distinct(list_filter([{", ".join(tests)}], lambda x: x IS NOT NULL)) AS m
  FROM p
)
SELECT doc_id, len(words)::BIGINT AS n_words, len(places)::BIGINT AS n_base,
  (list_min(places) - 1)::BIGINT AS first_word, (list_max(places) - 1)::BIGINT AS last_word,
  array_to_string(list_sort(b), ',') AS base_labels, array_to_string(list_sort(list_distinct(b || m)), ',') AS labels,
  CASE WHEN len(m) > 0 THEN 1.0 WHEN len(b) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM l
"""
