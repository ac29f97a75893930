"""License scan: positional index of the templates' rare words, and counts of base phrases."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import _ODD, BLOCK, _block, delimiters, mix

#: Phrases whose every occurrence counts, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Templates: label, passages of the notice (any of them may stand in a file), phrases of which one must stand there.
TEMPLATES = {
    "apache-2.0": (["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
                    "licensed under the apache license version 2 0"], ["apache license version 2"]),
    "gpl-3.0": (["this work is licensed under the gnu general public license version 3",
                 "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"],
                ["general public license version 3", "version 3 of the license"]),
    "gpl-2.0": (["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
                 "licensed under the gnu general public license version 2"], ["general public license version 2", "version 2 of the license"]),
    "lgpl": (["you can redistribute it and or modify it under the terms of the gnu lesser general public license"], ["lesser general public license"]),
    "mit": (["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"],
            ["mit license", "permission is hereby granted free of charge"]),
    "bsd": (["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"], ["redistribution and use in source and binary forms"]),
    "mpl-2.0": (["this source code form is subject to the terms of the mozilla public license v 2 0"], ["mozilla public license"]),
    "cc-by-nc": (["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"], ["cc by nc", "creative commons attribution noncommercial"]),
    "cc-by-sa": (["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"], ["cc by sa", "creative commons attribution sharealike"]),
    "unlicense": (["this is free and unencumbered software released into the public domain"], ["unencumbered software released into the public domain"]),
}
#: Bytes that end a word (A-Z are lower-cased before).
NOT_WORD = delimiters(bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))
RARE = 4  # words of highest IDF that are looked up for a passage
COVER = 0.7  # share of a passage's words, at their places, that a file must hold


def _vocabulary() -> list[str]:
    lines = [*BASE] + [p for passages, phrases in TEMPLATES.values() for p in passages + phrases]
    return sorted({w for line in lines for w in line.split()})


def _word_numbers(texts, vocabulary: list[str]):
    """For each text: number of words, places of vocabulary words, and their numbers.

    Words are compared by 64-bit hashes in blocks of bytes; a text longer than a block is cut
    at the end of a word.
    """
    hashes = _hashes([w.encode() for w in vocabulary])
    order = np.argsort(hashes)
    ranked = hashes[order]

    def numbered(start, end, raw):
        h = mix(raw + (end - start).astype(np.uint64) * _ODD[7])
        at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
        return np.where(ranked[at] == h, order[at], -1)

    for text in texts:
        places, numbers, n, at = [], [], 0, 0
        while at < len(text):
            stop = min(at + BLOCK, len(text))
            if stop < len(text):
                blank = _last_end(text, at, stop)
                stop = blank if blank > at else stop
            part = text[at:stop]
            found = numbered(*_block(part, NOT_WORD))
            hit = np.flatnonzero(found >= 0)
            places.append(hit + n)
            numbers.append(found[hit])
            n += len(found)
            at = stop
            if at < len(text) and not NOT_WORD[text[at - 1]]:  # a word longer than a block: skip its rest
                while at < len(text):
                    rest = np.flatnonzero(NOT_WORD[np.frombuffer(text[at : at + BLOCK], np.uint8)])
                    at += int(rest[0]) if len(rest) else min(BLOCK, len(text) - at)
                    if len(rest):
                        break
        yield n, np.concatenate(places) if places else np.zeros(0, np.int64), np.concatenate(numbers) if numbers else np.zeros(0, np.int64)


def _last_end(text: bytes, at: int, stop: int) -> int:
    ends = np.flatnonzero(NOT_WORD[np.frombuffer(text[at:stop], np.uint8)])
    return at + int(ends[-1]) + 1 if len(ends) else at


def _hashes(words: list[bytes]) -> np.ndarray:
    start, end, raw = _block(b" ".join(words), NOT_WORD)
    return mix(raw + (end - start).astype(np.uint64) * _ODD[7])


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many of all of them each template word stands."""
    words = _vocabulary()

    def run(batches):
        counts, n = np.zeros(len(words), np.int64), 0
        for batch in batches:
            for _, _, numbers in _word_numbers(_lowered(batch), words):
                counts[np.unique(numbers)] += 1
                n += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array([*words, ""]), "n": pa.array([*counts.tolist(), n], pa.int64())})

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # template words only
    counts = {r["word"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


def _lowered(batch):
    return [(t or b"").lower() for t in batch.column("text").cast(pa.binary()).to_pylist()]  # bytes.lower changes A-Z alone


class Index:
    """Postings ``word number -> (passage, place)`` of each passage's rarest words, and phrases to verify."""

    def __init__(self, total: int, frequency: dict[str, int]):
        self.words = _vocabulary()
        number = {w: i for i, w in enumerate(self.words)}
        idf = {w: math.log((total + 1) / (frequency.get(w, 0) + 1)) + 1 for w in self.words}
        self.base = [([number[w] for w in phrase.split()], label) for phrase, label in BASE.items()]
        self.passages, self.postings = [], {}
        for label, (passages, phrases) in TEMPLATES.items():
            must = [[number[w] for w in p.split()] for p in phrases]
            for text in passages:
                words = text.split()
                rare = sorted(range(len(words)), key=lambda i, words=words: (-idf[words[i]], i))[:RARE]
                k = len(self.passages)
                weights = np.array([idf[w] for w in words])
                self.passages.append((label, np.array([number[w] for w in words]), weights / weights.sum(), must, len(rare)))
                for i in rare:
                    self.postings.setdefault(number[words[i]], []).append((k, i))


def _phrase_starts(phrase: list[int], at: dict[int, np.ndarray]) -> np.ndarray:
    """Places where the phrase's words stand one after the other."""
    starts = at.get(phrase[0])
    for i, w in enumerate(phrase[1:], 1):
        if starts is None or w not in at:
            return np.zeros(0, np.int64)
        starts = starts[np.isin(starts + i, at[w], assume_unique=True)]
    return np.zeros(0, np.int64) if starts is None else starts


def _scan(index: Index, places: np.ndarray, numbers: np.ndarray):
    """Base places, base labels, all labels, and the best cover of a verified template."""
    order = np.argsort(numbers, kind="stable")
    cut = np.flatnonzero(np.diff(numbers[order])) + 1
    at = {int(numbers[g[0]]): places[g] for g in np.split(order, cut)} if len(order) else {}
    starts, base, best = [], set(), 0.0
    for phrase, label in index.base:
        found = _phrase_starts(phrase, at)
        if len(found):
            starts.append(found)
            base.add(label)
    labels = set(base)
    votes: dict[int, list[np.ndarray]] = {}
    for word, where in at.items():
        for k, i in index.postings.get(word, ()):
            votes.setdefault(k, []).append(where - i)
    for k, offsets in votes.items():
        label, words, weights, must, rare = index.passages[k]
        # a template stands where its rare words agree on its start; half of them must
        start, n = np.unique(np.concatenate(offsets), return_counts=True)
        start = start[n >= max(1, (rare + 1) // 2)]
        if not len(start) or not any(len(_phrase_starts(p, at)) for p in must):
            continue
        cover = np.zeros(len(start))
        for i, w in enumerate(words):
            if w in at:
                cover += weights[i] * np.isin(start + i, at[w])
        if cover.max() >= COVER:
            labels.add(label)
            best = max(best, float(cover.max()))
    return np.concatenate(starts) if starts else np.zeros(0, np.int64), base, labels, best


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every whole text.

    ``n_base`` counts the places of all base phrases, ``first_word`` and ``last_word`` are the
    smallest and largest of these starts.  ``labels`` adds those of templates: a passage's
    highest-IDF words (IDF over all documents) vote for its start, at least half of them must
    agree, one mandatory phrase must stand in the text, and the words found at their places
    must make up 0.7 of the passage's IDF.  ``score`` is the best such share, 1 at least where
    a base phrase stands and no template does better, else 0.

    A null or empty text has no words and empty labels; a null doc_id stays null; rows that
    repeat get the same answer; other columns are ignored; no rows give no rows.
    """
    index = Index(*document_frequencies(docs))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, (n, places, numbers) in zip(batch.column("doc_id").to_pylist(), _word_numbers(_lowered(batch), index.words), strict=True):
                starts, base, labels, best = _scan(index, places, numbers)
                some = len(starts) > 0
                rows.append((doc, n, len(starts), int(starts.min()) if some else None, int(starts.max()) if some else None, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if some else min(best, 1.0)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
