"""License scans with a positional index of rare words.

The index holds, for each word of the license templates, where it stands in which template. A word's
weight is its inverse document frequency over all scanned documents. A template counts only with its
mandatory phrases, so the offsets at which it may start are those whose stretch holds the first of them
whole. They are tried by rank: the file looks up its highest-weight words that the template has, and
each place in the file and each posting vote for the offset place minus posting. An offset is aligned
in full, and a template is reported if its mandatory phrases and enough of its weight stand there.

Base labels come from fixed phrases standing anywhere; the templates add labels and never take one
away. score is the best share of a template's weight found in place (1.0 for a base phrase).

Defined results: a null text counts as empty (0 words, empty labels, score 0); template statistics
of an empty table are zero counts, so every word weighs the same.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_lists, pick

# Phrases and the labels they give.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Opening words of well-known license texts: label, text, phrases that must stand in place.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files to deal in the software without restriction",
     ("permission is hereby granted free of charge",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
     "is hereby granted", ("permission to use copy modify", "with or without fee")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance "
     "with the license", ("under the apache license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation", ("gnu general public license",)),
    ("lgpl", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license",)),
    ("epl", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license",
     ("creative commons attribution sharealike",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring "
     "rights to this work", ("waived all copyright",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software",)),
    ("reserved", "all rights reserved", ("all rights reserved",)),
)
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Highest-weight words that rank the offsets of a template; ties at the last place all count.
RAREST = 4
#: Share of a template's weight that has to stand in place.
ENOUGH = 0.3


def words(text: str | None) -> list[bytes]:
    """Words of the text, A-Z lower-cased, as UTF-8; every byte from 0x80 on belongs to a word."""
    return WORD.findall(text.encode().lower()) if text else []


class Index:
    """Positional postings of the templates' words, with weights."""

    def __init__(self, n_docs: int, counts: dict[bytes, int]):
        self.templates = [(label, t.encode().split(), [p.encode().split() for p in must]) for label, t, must in TEMPLATES]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, text, _) in enumerate(self.templates):
            for q, w in enumerate(text):
                self.postings[w].append((t, q))
        self.weight = {w: math.log((n_docs + 1) / (counts.get(w, 0) + 1)) + 1 for w in self.postings}
        self.total = [sum(self.weight[w] for w in text) for _, text, _ in self.templates]
        self.phrases = [(p.encode().split(), label) for p, label in PHRASES]

    def scan(self, text: str | None) -> tuple:
        found = words(text)
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(found):
            if w in self.postings:
                places[w].append(i)
        starts, base = self.base(found, places)
        labels, best = set(base), 1.0 if base else 0.0
        for label, share in self.templates_in(found, places):
            labels.add(label)
            best = max(best, share)
        return (
            len(found), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), min(best, 1.0),
        )

    def base(self, found: list[bytes], places: dict) -> tuple[list[int], set[str]]:
        starts, labels = [], set()
        for phrase, label in self.phrases:
            # all words of the phrases but "cc" and "by" stand in templates; those two are looked for here
            first = places[phrase[0]] if phrase[0] in self.postings else [i for i, w in enumerate(found) if w == phrase[0]]
            hits = [i for i in first if found[i : i + len(phrase)] == phrase]
            starts += hits
            if hits:
                labels.add(label)
        return starts, labels

    def templates_in(self, found: list[bytes], places: dict):
        mine: dict[int, set[bytes]] = defaultdict(set)
        for w in places:
            for t, _ in self.postings[w]:
                mine[t].add(w)
        for t, present in mine.items():
            label, text, must = self.templates[t]
            if not all(w in present for phrase in must for w in phrase):
                continue
            first, size = must[0], len(must[0])
            hits = [p for p in places[first[0]] if found[p : p + size] == first]
            offsets = {at for p in hits for at in range(p + size - len(text), p + 1)}
            if not offsets:
                continue
            ranked = sorted((self.weight[w] for w in present), reverse=True)
            floor = ranked[min(RAREST, len(ranked)) - 1]
            votes: Counter = Counter()
            for w in present:
                if self.weight[w] >= floor:
                    for u, q in self.postings[w]:
                        if u == t:
                            for p in places[w]:
                                votes[p - q] += self.weight[w]
            share = 0.0
            for at in sorted(offsets, key=lambda at: -votes[at]):
                share = max(share, self.aligned(found, t, at))
                if share >= 1.0:
                    break
            if share >= ENOUGH:
                yield label, share

    def aligned(self, found: list[bytes], t: int, at: int) -> float:
        """Share of the template's weight found in place from word `at` on; 0 without its phrases."""
        _, text, must = self.templates[t]
        piece = found[max(at, 0) : max(at + len(text), 0)]
        if not all(contains(piece, phrase) for phrase in must):
            return 0.0
        same = sum(self.weight[w] for q, w in enumerate(text) if 0 <= at + q < len(found) and found[at + q] == w)
        return same / self.total[t]


def contains(piece: list[bytes], phrase: list[bytes]) -> bool:
    return any(piece[i : i + len(phrase)] == phrase for i in range(len(piece) - len(phrase) + 1))


def word_statistics(docs: DataFrame, text: str = "text") -> tuple[int, dict[bytes, int]]:
    """Number of documents, and in how many each template word stands; over all documents.

    The counts that reach the driver are at most one per template word.
    """
    vocabulary = {w.encode() for _, t, _ in TEMPLATES for w in t.split()}

    def work(texts):
        counts: Counter = Counter()
        for t in texts:
            counts.update(vocabulary.intersection(words(t)))
        return [[None, *[w.decode() for w in counts]], [len(texts), *counts.values()]]

    counted = map_lists(pick(docs, text), "word string, n long", work, rows=1024)
    rows = counted.groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    n_docs = found.pop(None, 0)
    return n_docs, {w.encode(): n for w, n in found.items()}


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, base labels, labels and score per row; two narrow passes, no shuffle of texts."""
    n_docs, counts = word_statistics(docs, text)
    ready: list[Index] = []

    def work(ids, texts):
        if not ready:
            ready.append(Index(n_docs, counts))
        rows = [ready[0].scan(t) for t in texts]
        return ids, *([*map(list, zip(*rows))] if rows else [[]] * 7)

    schema = (
        f"{id} {dict(docs.dtypes)[id]}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double"
    )
    return map_lists(pick(docs, id, text), schema, work)
