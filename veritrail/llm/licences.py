"""Licence scan by a positional index of rare words, verified by mandatory key phrases."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, table

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Opening or notice sentences of public licences, and the phrases that a file must hold for the label.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ["permission is hereby granted free of charge", "to deal in the software without restriction"],
    ),
    "mit-notice": ("Released under the MIT License.", ["mit license"]),
    "apache": (
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ["apache license version 2 0"],
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        ["gnu general public license"],
    ),
    "gpl-notice": ("This work is licensed under the GNU General Public License, version 3.", ["gnu general public license"]),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        ["gnu lesser general public license"],
    ),
    "agpl": (
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        ["gnu affero general public license"],
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ["redistribution and use in source and binary forms"],
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ["permission to use copy modify", "for any purpose with or without fee is hereby granted"],
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        ["mozilla public license"],
    ),
    "cc-by": ("Licensed under CC BY 4.0.", ["cc by"]),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", ["cc by nc"]),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", ["cc by sa"]),
    "cc0": ("To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal", ["cc0 1 0"]),
    "unlicense": ("This is free and unencumbered software released into the public domain.", ["released into the public domain"]),
    "proprietary": ("All rights reserved. Unauthorized copying of this file is strictly prohibited.", ["all rights reserved"]),
}
#: Templates of short notices share the label before the suffix.
SUFFIX = "-notice"

#: The postings hold so many of the rarest words of each template, by which a file is looked up ...
RARE_WORDS = 8
#: ... and an alignment needs this part of the weight of all the template's words.
MIN_COVER = 0.6

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(raw: bytes) -> list[bytes]:
    """Words of the contract: runs of ASCII letters and digits and all non-ASCII characters, A-Z lower-cased."""
    return raw.translate(_FOLD).split()


class Index:
    """Postings word -> [(template, position)], weighted by how rare each word is in the corpus."""

    def __init__(self, templates: dict, df: dict[bytes, int], n_docs: int) -> None:
        self.words = {name: words_of(text.encode()) for name, (text, _) in templates.items()}
        self.must = {name: [b" " + p.encode() + b" " for p in phrases] for name, (_, phrases) in templates.items()}
        vocabulary = {w for ws in self.words.values() for w in ws}
        self.idf = {w: math.log((1 + n_docs) / (1 + df.get(w, 0))) + 1e-6 for w in vocabulary}
        self.code = {w: i for i, w in enumerate(sorted(vocabulary))}
        self.coded = {name: np.array([self.code[w] for w in ws]) for name, ws in self.words.items()}
        self.weights = {name: np.array([self.idf[w] for w in ws]) for name, ws in self.words.items()}
        self.post: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        for name, ws in self.words.items():
            rare = set(sorted(set(ws), key=lambda w: (-self.idf[w], w))[:RARE_WORDS])  # of equally rare words the first by name
            for i, w in enumerate(ws):
                if w in rare:
                    self.post[w].append((name, i))

    def match(self, words: list[bytes], joined: bytes) -> dict[str, float]:
        """Template -> the share of its whole weight that stands at one relative position, for templates whose key phrases all stand in the file."""
        if self.post.keys().isdisjoint(words):
            return {}
        shifts: dict[str, set[int]] = defaultdict(set)
        for at, w in enumerate(words):
            for name, i in self.post.get(w, ()):
                shifts[name].add(at - i)
        coded = np.fromiter((self.code.get(w, -1) for w in words), np.int64, len(words))
        out = {}
        for name, at in shifts.items():
            if not all(p in joined for p in self.must[name]):
                continue
            start, got = np.fromiter(at, np.int64, len(at)), np.zeros(len(at))
            for i, (c, weight) in enumerate(zip(self.coded[name].tolist(), self.weights[name].tolist())):
                place = start + i
                inside = (place >= 0) & (place < len(coded))
                got += weight * (inside & (coded[np.where(inside, place, 0)] == c))
            cover = float(got.max() / self.weights[name].sum())
            if cover >= MIN_COVER:
                out[name] = min(1.0, cover)
        return out


def base_places(joined: bytes) -> tuple[list[int], set[str]]:
    """Word positions where a base phrase stands, and the labels. ``joined``: the words, each between single spaces."""
    places, labels = [], set()
    for phrase, label in BASE.items():
        needle = b" " + phrase.encode() + b" "
        at, before, word = joined.find(needle), 0, 0
        while at >= 0:
            word += joined.count(b" ", before, at)
            before = at
            places.append(word)
            labels.add(label)
            at = joined.find(needle, at + 1)
    return places, labels


def word_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """How many documents hold each word of the templates, over all documents; bounded by the templates' words."""
    vocab = sorted(vocabulary)
    at = {w: i for i, w in enumerate(vocab)}

    def run(batches):
        seen, n = np.zeros(len(vocab), np.int64), 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                n += 1
                for w in at.keys() & set(words_of(raw)):
                    seen[at[w]] += 1
        yield {"word": [-1, *range(len(vocab))], "n": [n, *seen.tolist()]}

    got = arrow_map(docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")), run, "word int, n long")
    rows = {r.word: r.n for r in got.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # one row per template word
    return {vocab[i]: n for i, n in rows.items() if i >= 0}, rows.get(-1, 0)


def licence_scan(docs: DataFrame, templates: dict = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: n_words, base places and labels, all labels and a score.

    Two passes over all whole texts: document frequencies of the licence words, then for each file its
    licence words of the highest IDF are looked up in the templates' positional postings; a template of which one relative
    position that they give holds MIN_COVER of the weight of all words, and whose key phrases all stand in the file, adds
    its label. score is the largest cover, 1 where a base phrase stands, 0 without labels.

    A null or empty text has no words, places or labels ('' and score 0). Very long texts are scanned whole, in linear time.
    Equally good positions give the same label. Repeated rows, and rows that share a doc_id, are scanned each.
    An empty table gives no rows. Extra columns are ignored.
    """
    df, n = word_frequencies(docs, {w for text, _ in templates.values() for w in words_of(text.encode())})
    index = Index(templates, df, n)

    def run(batches):
        for batch in batches:
            out = defaultdict(list)
            for raw in batch.column(1).to_pylist():
                words = words_of(raw)
                joined = b" " + b" ".join(words) + b" "
                places, base = base_places(joined)
                found = index.match(words, joined)
                labels = base | {name.removesuffix(SUFFIX) for name in found}
                out["n_words"].append(len(words))
                out["n_base"].append(len(places))
                out["first_word"].append(min(places, default=None))
                out["last_word"].append(max(places, default=None))
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(labels)))
                out["score"].append(1.0 if base else max(found.values(), default=0.0))
            yield {"doc_id": batch.column(0), **out}

    source = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(source, run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))
