"""Licence scans with a positional index of rare words.

The templates are short licence notices and mentions, each with its mandatory phrases. Their words make the index: word to
(template, position). A first pass counts in how many documents each of these words stands; the counts give their IDF. A second
pass takes, for each file and template, the template's RARE words of highest IDF, looks up those that the file has, and intersects
their postings by relative position: place in the file less place in the template. Where words of SHARE of the weight agree within
the template's slack, and every mandatory phrase stands in the file word for word about where the template has it, the template's
label is given. Phrases to be found wherever they stand (PHRASES) are led by their word of highest IDF and compared by letters.

The index is as large as the templates, which are a parameter; documents aren't shuffled. Files are read whole, in blocks.

Cases: null, empty and wordless texts have no words, places or labels, and score 0; repeated rows are judged each for itself and
count each for the IDF; overlapping places all count; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.llm.arrays import word_values, words
from tracequarry.llm.common import blocks, fields, table
from tracequarry.llm.decontam import _FOLD, _INSIDE

#: Words of a template that are looked up, and the share of their weight that must agree.
RARE, SHARE = 8, 0.6

#: Phrases found at every place, and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Labels, notices or mentions, mandatory phrases.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2.0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["apache org licenses license 2 0", "distributed on an as is basis"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms", "redistributions of source code must retain"]),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "either version 2 of the license"]),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "either version 3 of the license"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0", ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("cc-by-nc", "licensed under cc by nc 4.0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4.0", ["cc by sa"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license", ["creative commons attribution 4 0"]),
]


def _spelled(text: str) -> list[bytes]:
    data, starts, ends, _ = words([text], _INSIDE, _FOLD)
    return [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]


@dataclass
class Template:
    label: str
    words: list[bytes]
    #: (phrase, its first place in the template)
    phrases: list[tuple[list[bytes], int]]
    slack: int
    #: word number: (weight, places); set from the IDF
    rare: dict[int, tuple[float, np.ndarray]] = field(default_factory=dict)


class Index:
    """Word numbers, postings and weights of the templates and phrases."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, rare: int = RARE, share: float = SHARE):
        self.share, self.count = share, rare
        self.phrases = [(_spelled(text), label) for text, label in phrases]
        self.templates = []
        for label, text, needed in templates:
            w = _spelled(text)
            at = [(p, next((i for i in range(len(w)) if w[i : i + len(p)] == p), None)) for p in map(_spelled, needed)]
            if any(i is None for _, i in at):
                raise ValueError(f"a mandatory phrase of {label} is not in its text")
            self.templates.append(Template(label, w, at, 2 + len(w) // 16))
        self.vocabulary = sorted({w for t in self.templates for w in t.words} | {w for p, _ in self.phrases for w in p})
        self.number = {w: i for i, w in enumerate(self.vocabulary)}
        data, starts, ends, _ = words([w.decode() for w in self.vocabulary], _INSIDE, _FOLD)
        values = word_values(data, starts, ends)
        self.order = np.argsort(values)
        self.values = values[self.order]
        self.weigh(0, {})

    def weigh(self, documents: int, frequency: dict[int, int]) -> Index:
        """Set the IDF of each word, and with it each template's rarest words; ties go by the word."""
        self.idf = np.array([log(1 + (documents + 1) / (frequency.get(i, 0) + 1)) for i in range(len(self.vocabulary))])
        self.shares = np.zeros((len(self.vocabulary), len(self.templates)))
        for k, t in enumerate(self.templates):
            chosen = sorted({self.number[w] for w in t.words}, key=lambda v: (-self.idf[v], v))[: self.count]
            total = sum(self.idf[v] for v in chosen)
            t.rare = {v: (float(self.idf[v] / total), np.array([i for i, w in enumerate(t.words) if w == self.vocabulary[v]])) for v in chosen}
            for v, (weight, _) in t.rare.items():
                self.shares[v, k] = weight
        return self

    def numbers(self, values: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words that the index doesn't have."""
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        return np.where(self.values[at] == values, self.order[at], -1)

    def places(self, numbers: np.ndarray, phrase: list[bytes], same) -> np.ndarray:
        """Where the phrase's words stand consecutively: led by its word of highest IDF, then compared by letters."""
        wanted = [self.number.get(w, -2) for w in phrase]
        lead = max(range(len(wanted)), key=lambda i: (self.idf[wanted[i]] if wanted[i] >= 0 else 0.0, -i))
        at = np.flatnonzero(numbers == wanted[lead]) - lead
        at = at[(at >= 0) & (at + len(phrase) <= len(numbers))]
        for i, v in enumerate(wanted):
            at = at[numbers[at + i] == v]
        return np.array([a for a in at.tolist() if same(a, phrase)], np.int64)

    def aligned(self, template: Template, numbers: np.ndarray, same) -> tuple[float, int] | None:
        """The greatest share of weight that agrees on a place with all mandatory phrases, and the first such place."""
        offsets, owner = [], []
        for v, (_, places) in template.rare.items():
            found = (np.flatnonzero(numbers == v)[:, None] - places[None, :]).ravel()
            offsets.append(found)
            owner.append(np.full(len(found), v))
        at, who = np.concatenate(offsets), np.concatenate(owner)
        order = np.argsort(at, kind="stable")
        at, who = at[order].tolist(), who[order].tolist()
        phrases, seen, weight, left, best = None, {}, 0.0, 0, None
        for right, v in enumerate(who):
            seen[v] = seen.get(v, 0) + 1
            weight += template.rare[v][0] if seen[v] == 1 else 0.0
            while at[right] - at[left] > template.slack:
                seen[who[left]] -= 1
                weight -= template.rare[who[left]][0] if seen[who[left]] == 0 else 0.0
                left += 1
            if weight < self.share - 1e-9 or (best and weight <= best[0] + 1e-9):
                continue
            if phrases is None:
                phrases = [(self.places(numbers, p, same), i) for p, i in template.phrases]
            low, high = at[left] - template.slack, at[right] + template.slack
            if all(np.searchsorted(found, low + i) < np.searchsorted(found, high + i, "right") for found, i in phrases):
                best = (min(weight, 1.0), at[left])
        return best


def scan(texts, index: Index) -> Iterator[tuple[int, list[int], list[int], list[str], list[float], list[int]]]:
    """Number of words, places and phrase numbers, labels with their shares and first places, of each text."""
    for _, part in blocks(texts):
        data, starts, ends, first = words(part, _INSIDE, _FOLD)
        every = index.numbers(word_values(data, starts, ends))
        text = np.repeat(np.arange(len(part)), np.diff(first))
        has = np.zeros((len(part), len(index.vocabulary)))
        has[text[every >= 0], every[every >= 0]] = 1
        likely = has @ index.shares >= index.share - 1e-9

        def same(at: int, phrase: list[bytes], base: int = 0) -> bool:
            return all(data[starts[base + at + i] : ends[base + at + i]].tobytes() == w for i, w in enumerate(phrase))  # noqa: B023

        found: list[list[tuple[int, int]]] = [[] for _ in part]
        for k, (phrase, _label) in enumerate(index.phrases):
            for a in index.places(every, phrase, same).tolist():
                if text[a] == text[a + len(phrase) - 1]:
                    found[text[a]].append((a - int(first[text[a]]), k))
        for i in range(len(part)):
            a, b = int(first[i]), int(first[i + 1])
            best: dict[str, tuple[float, int]] = {}
            for k in np.flatnonzero(likely[i]).tolist():
                t = index.templates[k]
                hit = index.aligned(t, every[a:b], lambda at, p, a=a: same(at, p, a))
                if hit and (t.label not in best or (-hit[0], hit[1]) < (-best[t.label][0], best[t.label][1])):
                    best[t.label] = hit
            places = sorted(found[i])
            labels = sorted(best)
            yield b - a, [p for p, _ in places], [k for _, k in places], labels, [best[x][0] for x in labels], [best[x][1] for x in labels]


def weighed(docs: DataFrame, text: str = "text", index: Index | None = None) -> Index:
    """The index with the IDF of its words over all documents; the driver gets one row a word."""
    index = index or Index()

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = []
            for _, part in blocks(texts):
                data, starts, ends, first = words(part, _INSIDE, _FOLD)
                every = index.numbers(word_values(data, starts, ends))
                pairs = np.unique(np.repeat(np.arange(len(part)), np.diff(first))[every >= 0] * len(index.vocabulary) + every[every >= 0])
                rows += np.split(pairs % len(index.vocabulary), np.searchsorted(pairs // len(index.vocabulary), np.arange(1, len(part))))
            yield pd.Series([r.astype(np.int32) for r in rows])

    counts = docs.select(F.explode(F.concat(F.array(F.lit(-1)), numbers(F.col(text)))).alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counts.collect()}  # as many as the index has words, and the documents
    return index.weigh(frequency.pop(-1, 0), frequency)


def scan_licenses(docs: DataFrame, text: str = "text", name: str = "licenses", index: Index | None = None) -> DataFrame:
    """docs with one more column, a struct: n_words, places (start, label of a phrase) and notices (label, share, start)."""
    index = weighed(docs, text, index)

    @F.pandas_udf(fields("n_words long, places array<long>, phrases array<long>, labels array<string>, shares array<double>, starts array<long>"))
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([*scan(texts, index)], columns=["n_words", "places", "phrases", "labels", "shares", "starts"])

    found = docs.withColumn(name, scanned(F.col(text)))
    part = F.col(name)
    names = F.array(*[F.lit(label) for _, label in index.phrases])
    return found.withColumn(name, F.struct(
        part["n_words"].alias("n_words"),
        F.arrays_zip(part["places"].alias("start"), F.transform(part["phrases"], lambda k: F.get(names, k.cast("int"))).alias("label")).alias("places"),
        F.arrays_zip(part["labels"].alias("label"), part["shares"].alias("share"), part["starts"].alias("start")).alias("notices"),
    ))


def op13_license_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every whole document."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licenses.*")
    starts, base, labels = F.col("places.start"), F.col("places.label"), F.col("notices.label")
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, labels)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("notices.share"), F.lit(0.0))).alias("score"),
    )
