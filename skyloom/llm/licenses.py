"""License scans by a positional rare-token index.

Words are runs of a-z, 0-9 and characters from U+0080 on, after lower-casing A-Z. Every phrase and licence text below is
a template: mandatory key phrases at relative positions. The document frequencies of all words of key phrases are counted
over the whole corpus (a table of at most as many rows as there are such words). The ``RARE`` words of highest IDF of
each template are indexed: postings lead from a word to the templates and positions where it stands. In a file, its
indexed words are looked up, those of highest IDF first, so only templates that a word leads to are looked at. The rarest word of each proposes where the template would start, the others must agree with a start
within ``SLACK`` words, and then the key phrases are verified word by word. A licence text may gain or lose words between
its key phrases, ``SLACK`` in all. As indexed words are parts of key phrases, no place of a template is lost: a label is
there if and only if the key phrases stand at shifts that differ by ``SLACK`` at most (a test's brute force).

Results by row: n_words, n_base (places of the base phrases), first_word and last_word (smallest and largest start of
those, else null), base_labels, labels (with those of the other templates), score: 1 if any template is there, else half
the largest share of one template's rare words that agree on a start.

Nulls: a null text is empty (no words, no labels, score 0); a null doc_id is kept. Very long texts are scanned whole. Ties
of IDF go to the word that stands first in its template; overlapping places all count. Repeated rows come out as often
as they come in; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RARE, SLACK = 3, 12

#: Base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Phrases that name other licences.
MORE = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: Licence texts with their mandatory key phrases in brackets.
TEXTS = {
    "[permission is hereby granted] free of charge to any person obtaining a copy of this software and associated documentation files the software [to deal in the software without restriction] including without limitation the rights [to use copy modify merge publish distribute sublicense] and or sell copies of the software": "mit",
    "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met redistributions of source code must [retain the above copyright notice] this list of conditions and the following disclaimer redistributions in binary form must [reproduce the above copyright notice] this list of conditions": "bsd",
    "neither the name of the copyright holder nor the names of its contributors [may be used to endorse or promote products] derived from this software [without specific prior written permission]": "bsd-3",
    "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice [appear in all copies]": "isc",
    "you may not use this file except [in compliance with the license] you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is [distributed on an as is basis]": "apache-2",
    "this program is free software [you can redistribute it and or modify it] under the terms of the gnu general public license as published by the [free software foundation] either version 3 of the license": "gpl",
    "this source code form is [subject to the terms of the mozilla public license] v 2 0 if a copy of the mpl was not distributed with this file [you can obtain one at]": "mpl-2",
    "[this is free and unencumbered software] released into the public domain anyone is free to [copy modify publish use compile sell or distribute] this software": "unlicense",
}


class Template:
    """Key phrases (shift from the template's start, words), label, and whether it is a base phrase."""

    def __init__(self, text: str, label: str, is_base: bool):
        self.label, self.is_base, self.phrases, at = label, is_base, [], 0
        for k, part in enumerate(re.split(r"[\[\]]", text if "[" in text else f"[{text}]")):
            w = tuple(part.encode().split())
            if k % 2:
                self.phrases.append((at, w))
            at += len(w)
        self.slack = SLACK if len(self.phrases) > 1 else 0

    def spots(self) -> dict[bytes, list[int]]:
        """Positions of every word of the key phrases."""
        out = defaultdict(list)
        for at, phrase in self.phrases:
            for i, w in enumerate(phrase):
                out[w].append(at + i)
        return dict(out)

    def stands(self, w: list[bytes], start: int) -> bool:
        """Do all key phrases stand at shifts around ``start`` that differ by ``slack`` at most?"""
        found = []
        for at, phrase in self.phrases:
            near = range(max(start - self.slack, -at), start + self.slack + 1)
            found.append([s for s in near if w[s + at : s + at + len(phrase)] == list(phrase)])
        return all(found) and any(all(any(low <= s <= low + self.slack for s in f) for f in found) for low in range(start - self.slack, start + 1))


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def templates_of(base: dict[str, str], more: dict[str, str], texts: dict[str, str]) -> list[Template]:
    return [Template(p, label, is_base) for part, is_base in ((base, True), (more, False), (texts, False)) for p, label in part.items()]


def _frequencies(vocabulary: frozenset):
    def run(batches):
        seen, n = Counter(), 0
        for b in batches:
            for t in b.column(0):
                n += 1
                seen.update(vocabulary.intersection(words(t.as_py())))
        rows = [*seen.items(), (b"", n)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.int64())], names=["word", "df"])

    return run


class Index:
    """Postings of the templates' rare words: word -> (template, its positions there), and each word's rank by IDF."""

    def __init__(self, templates: list[Template], idf: dict[bytes, float], rare: int):
        self.templates, self.sizes, self.postings = templates, [], defaultdict(list)
        for k, t in enumerate(templates):
            spots = t.spots()
            chosen = sorted(spots, key=lambda w: (-idf[w], spots[w][0], w))[:rare]
            self.sizes.append(len(chosen))
            for w in chosen:
                self.postings[w].append((k, spots[w]))
        self.rank = {w: i for i, w in enumerate(sorted(self.postings, key=lambda w: (-idf[w], w)))}


def scan(w: list[bytes], index: Index) -> tuple:
    """One file: its indexed words, those of highest IDF first, gather places by template; only templates that a word of the
    file leads to are looked at, however many there are."""
    places = defaultdict(list)
    for at, word in enumerate(w):
        if word in index.rank:
            places[word].append(at)
    led = defaultdict(list)
    for word in sorted(places, key=index.rank.__getitem__):
        for k, spots in index.postings[word]:
            led[k].append((places[word], spots))
    labels, own, score, starts = set(), set(), 0.0, []
    for k, here in led.items():
        t, size = index.templates[k], index.sizes[k]
        if len(here) < size:  # a key phrase lacks a word
            score = max(score, 0.5 / size)
            continue
        rarest, spots = here[0]
        others = [{at - i for at in found for i in spot} for found, spot in here[1:]]
        for start in sorted({at - i for at in rarest for i in spots}):
            agree = sum(any(s in o for s in range(start - t.slack, start + t.slack + 1)) for o in others)
            if agree == len(others) and t.stands(w, start):
                labels.add(t.label)
                score = 1.0
                if not t.is_base:
                    break
                own.add(t.label)
                starts.append(start)
            else:
                score = max(score, 0.5 * (agree + 1) / size)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), score


def _scan(index: Index):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches):
        for b in batches:
            out = [scan(words(t.as_py()), index) for t in b.column(1)]
            columns = zip(*out) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

    return run


def license_scan(docs: DataFrame, base: dict[str, str] = BASE, more: dict[str, str] = MORE, texts: dict[str, str] = TEXTS, rare: int = RARE) -> DataFrame:
    templates = templates_of(base, more, texts)
    vocabulary = frozenset(w for t in templates for _, p in t.phrases for w in p)
    counted = docs.select("text").mapInArrow(_frequencies(vocabulary), "word binary, df long").groupBy("word").agg(F.sum("df").alias("df"))
    df = {bytes(r.word): r.df for r in counted.collect()}  # at most the templates' words
    n = df.get(b"", 0)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 0.5)) for w in vocabulary}
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", "text").mapInArrow(_scan(Index(templates, idf, rare)), schema)
