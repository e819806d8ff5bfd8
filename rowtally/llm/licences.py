"""Operator 7: licence scan by a positional index of rare licence words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtally.llm.words import LETTER_OR_DIGIT, batches_of, hash_words, words

# Phrases and labels that must always be found.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Licence wording: label -> (text, phrases that must stand in it). The public texts of the licences.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license", "2 0"]),
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is"
        " basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ["apache license version 2 0", "unless required by applicable law"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms"]),
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must"
        " retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of"
        " conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ["source and binary forms", "this list of conditions and the following disclaimer"]),
    "cc-by-4.0": ("licensed under cc by 4 0", ["cc by 4 0"]),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ["cc by sa"]),
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2", ["general public license", "version 2"]),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ["general public license", "version 3"]),
    "gpl-3.0-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either"
        " version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied"
        " warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        ["gnu general public license as published by the free software foundation", "version 3 of the license"]),
    "isc-text": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission"
        " notice appear in all copies", ["with or without fee is hereby granted"]),
    "mit": ("released under the mit license", ["mit license"]),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without"
        " restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the"
        " software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions"
        " of the software", ["permission is hereby granted", "free of charge"]),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "mpl-2.0-notice": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org"
        " mpl 2 0", ["mozilla public license v 2 0"]),
}
LEAST_SCORE = 0.6
POSTED = 0.75  # share of a template's IDF that its posted words hold

_BEFORE = 1 << 10  # words a template may begin before a text, more than any has

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


@dataclass
class Index:
    """Words of all templates with their IDF, and each template's rarest words with their places there."""

    vocabulary: list[str]
    idf: np.ndarray
    templates: list[tuple[str, list[int], list[list[int]], bool]]  # label, word numbers, mandatory phrases, is it a base phrase
    postings: dict[int, list[tuple[int, int]]]  # word -> (template, place in it)
    least: np.ndarray  # IDF that the posted words of a template must have in place wherever it stands


def licence_words() -> list[str]:
    return sorted({w for text in [*BASE_PHRASES, *(t for t, _ in TEMPLATES.values())] for w in text.split()})


def build_index(idf: dict[str, float]) -> Index:
    vocabulary = licence_words()
    number = {w: i for i, w in enumerate(vocabulary)}
    weight = np.array([idf.get(w, 0.0) for w in vocabulary])
    as_numbers = lambda text: [number[w] for w in text.split()]
    templates = [(label, as_numbers(phrase), [as_numbers(phrase)], True) for phrase, label in BASE_PHRASES.items()]
    templates += [(label, as_numbers(text), [as_numbers(p) for p in phrases], False) for label, (text, phrases) in TEMPLATES.items()]
    postings: dict[int, list[tuple[int, int]]] = {}
    least = np.zeros(len(templates))
    for t, (_, numbers, _, is_base) in enumerate(templates):
        own = weight[numbers]
        rarest = np.argsort(-own, kind="stable")
        # a base phrase must stand whole, so that its rarest word alone tells all its places
        posted = rarest[:1 if is_base else int(np.searchsorted(np.cumsum(own[rarest]), POSTED * own.sum())) + 1]
        for place in posted.tolist():
            postings.setdefault(numbers[place], []).append((t, place))
        # where a template scores enough, words that aren't posted can't make up for those that are
        left = own.sum() - own[posted].sum()
        least[t] = own[posted].sum() if is_base else LEAST_SCORE * own.sum() - left
    return Index(vocabulary, weight, templates, postings, least - 1e-9)


def candidates(index: Index, key: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(template, start) where posted words of a template stand at places that agree on one start and hold enough IDF.

    ``key`` are the places of licence words in texts, ``number`` the words. Every start that passes the score is among them.
    """
    template, place = (np.array([p[i] for w in range(len(index.vocabulary)) for p in index.postings.get(w, [])], np.int64) for i in (0, 1))
    counts = np.array([len(index.postings.get(w, [])) for w in range(len(index.vocabulary))])
    firsts = np.cumsum(counts) - counts
    n = counts[number]
    ends = np.cumsum(n)
    entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts[number] - (ends - n), n)
    votes = (np.repeat(key, n) - place[entry]) * len(index.templates) + template[entry]
    found, where = np.unique(votes, return_inverse=True)
    idf = np.bincount(where, np.repeat(index.idf[number], n), len(found))
    found = found[idf >= index.least[found % len(index.templates)]]
    return found % len(index.templates), found // len(index.templates)


class Finder:
    """Places of licence words in a batch of texts."""

    def __init__(self, vocabulary: list[str]):
        hashes = hash_words(vocabulary)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, column: pa.Array):
        """Bounds of texts in words; and for each licence word found its text, place in the text and number."""
        w = words(column, LETTER_OR_DIGIT, lower=True)
        at = np.flatnonzero(self.maybe[(w.hashes & np.uint64(0xFFFF)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.hashes, w.hashes[at]), len(self.hashes) - 1)
        same = self.hashes[slot] == w.hashes[at]
        at, number = at[same], self.order[slot[same]]
        text = np.searchsorted(w.bounds, at, side="right") - 1
        return w.bounds, text, at - w.bounds[text], number


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(word, n): in how many texts each licence word occurs, and as word null the number of texts. Counted over all rows."""
    vocabulary = licence_words()

    def count(batches):
        finder = Finder(vocabulary)
        total, texts = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches_of(batches, "text", 8 << 20):
            _, text, _, number = finder(batch.column("text"))
            total += np.bincount(np.unique(text * len(vocabulary) + number) % len(vocabulary), minlength=len(vocabulary))
            texts += len(batch)
        yield pa.RecordBatch.from_arrays([pa.array([*vocabulary, None], pa.string()), pa.array([*total.tolist(), texts], pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: base phrases at all their places, and licences found by the rare-word index.

    First the document frequency of every licence word is counted over all texts. A licence stands at a place if the
    template laid there, which may begin before the text or end behind it, covers all mandatory phrases word for word and
    its score, the IDF-weighted share of template words in place, is LEAST_SCORE or more. Each template posts its words of highest
    IDF, POSTED of its whole. A text's words among these are looked up; each votes for the start it would give the template,
    and starts whose votes hold less IDF than a passing place must are dropped. What is left is verified on
    all words and phrases, so that no place is missed. A text's score is its best; 0 without a licence. Null texts count as empty.
    The vocabulary is fixed, so that what the driver sees doesn't grow.
    """
    counts = {r["word"]: r["n"] for r in document_frequencies(docs).collect()}
    texts = counts.pop(None, 0)
    index = build_index({w: float(np.log((texts + 1) / (n + 1)) + 1) for w, n in counts.items()})

    def run(batches):
        finder = Finder(index.vocabulary)
        for batch in batches_of(batches, "text", 8 << 20):
            yield _scan_batch(batch, index, finder)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _windows(key: np.ndarray, number: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The licence words at ``size`` places from each start; -1 for other words and outside the text."""
    places = starts[:, None] + np.arange(size)
    at = np.minimum(np.searchsorted(key, places), len(key) - 1)
    return np.where(key[at] == places, number[at], -1)


def _scan_batch(batch: pa.RecordBatch, index: Index, finder: Finder) -> pa.RecordBatch:
    bounds, text, place, number = finder(batch.column("text"))
    n = len(batch)
    key = (text.astype(np.int64) << 40) + place + _BEFORE  # sorted, as words come in order
    n_base, first, last, score = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n)
    base: dict[int, set[str]] = {}
    found: dict[int, set[str]] = {}
    template, starts = candidates(index, key, number)
    for t in np.unique(template).tolist():
        label, numbers, phrases, is_base = index.templates[t]
        at, weight = starts[template == t], index.idf[numbers]
        window = _windows(key, number, at, len(numbers))
        fits = np.ones(len(at), bool)
        for p in phrases:
            fits &= np.any([(window[:, i:i + len(p)] == p).all(1) for i in range(len(numbers) - len(p) + 1)], axis=0)
        value = np.minimum(((window == numbers) * weight).sum(1) / weight.sum(), 1.0)
        fits &= is_base | (value >= LEAST_SCORE)
        doc, start = at[fits] >> 40, (at[fits] & ((1 << 40) - 1)) - _BEFORE
        np.maximum.at(score, doc, value[fits])
        of_label = np.unique(doc).tolist()
        if is_base:
            n_base += np.bincount(doc, minlength=n)
            last[of_label] = np.maximum(last[of_label], start[np.searchsorted(doc, of_label, side="right") - 1])
            lowest = start[np.searchsorted(doc, of_label)]
            first[of_label] = np.where(first[of_label] < 0, lowest, np.minimum(first[of_label], lowest))
        for names in (base, found) if is_base else (found,):
            for i in of_label:
                names.setdefault(i, set()).add(label)
    join = lambda sets: pa.array([",".join(sorted(sets[i])) if i in sets else "" for i in range(n)], pa.string())
    place_of = lambda x: pa.array(x, pa.int64(), mask=x < 0)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(n_base), place_of(first), place_of(last), join(base), join(found), pa.array(score)],
        ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
