"""Licence scans of paragraphs: sparse word n-gram logistic regression, checked against templates.

The classifier is trained on the template sentences below, varied by rule, and on paragraphs without a licence. Its features
are words and word pairs of the templates; pairs and words of stop words alone are none, so a paragraph without any feature
has the class unknown at the prior. Scores are calibrated by one temperature fitted on variations that were not trained on.
A family is reported only where the classifier prefers it to unknown and enough of one of its templates' three-word shingles
occur in the stretch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import bounded_batches

#: Usual sentences that declare a licence.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "This software is distributed under the Apache 2.0 license."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "You can redistribute it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 3.", "This library is free software under the terms of the GNU Lesser General Public License."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide under CC0."],
    "ISC": ["Licensed under the ISC License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Words that are no feature by themselves.
STOP = frozenset("a all an and any are as at be by for free from in is it may not of on or other out possible that the this to under use with without work you".split())
#: Paragraphs that speak of licences but declare none of these.
OTHERS = ["All rights reserved.", "See the license file for details.", "A driving license is required to rent the car.", "The license fee for this software is due every year.", "Terms and conditions of the general public apply.", "He studied at MIT and worked on public terms.", "The Apache helicopter landed.", "Permission is required to enter.", "Version 3 of the program was released.", "The public library is free."]

UNKNOWN = "unknown"
WINDOW, STRIDE = 64, 32
SHINGLE = 3
CONTAINED = 0.6
VARIATIONS = 60
SEED = 3
#: Lines that are blank part paragraphs; single line ends within them are blanks.
PARAGRAPHS = re.compile(r"\r?\n(?:[^\S\n]*\n)+")
WORD = re.compile(r"[a-z0-9]+(?:[.'-][a-z0-9]+)*")


def words_of(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


class Classifier:
    def __init__(self) -> None:
        self.families = [UNKNOWN, *TEMPLATES]
        grams = {g for ts in TEMPLATES.values() for t in ts for g in self._grams(words_of(t))}
        self.index = {g: i for i, g in enumerate(sorted(grams, key=str))}
        self.marks = frozenset(w for g in grams for w in ([g] if isinstance(g, str) else g) if w not in STOP)
        self.shingles = {f: [_shingles(words_of(t)) for t in ts] for f, ts in TEMPLATES.items()}
        self._fit()

    @staticmethod
    def _grams(words: list[str]) -> list[str | tuple[str, str]]:
        return [w for w in words if w not in STOP] + [p for p in zip(words, words[1:], strict=False) if not STOP.issuperset(p)]

    def features(self, words: list[str]) -> list[int]:
        return sorted({self.index[g] for g in self._grams(words) if g in self.index})

    def _examples(self) -> tuple[list[list[int]], list[int]]:
        rng = np.random.default_rng(SEED)
        filler = ["lorem", "dolor", "the", "of", "quick", "brown", "river", "stone", "with", "and", "seven", "paper"]
        x, y = [], []
        for k, family in enumerate(self.families):
            for text in TEMPLATES.get(family, OTHERS):
                words = words_of(text)
                for _ in range(VARIATIONS // len(TEMPLATES.get(family, OTHERS)) + 10):
                    kept = [w for w in words if rng.random() > 0.08]
                    around = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, WINDOW - 10))]
                    cut = rng.integers(0, len(around) + 1)
                    x.append(self.features(around[:cut] + kept + around[cut:]))
                    y.append(k)
        single = [[i] for i in range(len(self.index))]  # one feature alone declares nothing
        return x + single + [[]] * VARIATIONS, y + [0] * (len(single) + VARIATIONS)

    def _fit(self) -> None:
        rows, labels = self._examples()
        x = np.zeros((len(rows), len(self.index) + 1))
        x[:, -1] = 1
        for i, r in enumerate(rows):
            x[i, r] = 1
        y = np.eye(len(self.families))[labels]
        held = np.arange(len(rows)) % 5 == 0
        w = np.zeros((x.shape[1], len(self.families)))
        m, q = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, 301):
            e = x[~held] @ w
            e = np.exp(e - e.max(axis=1, keepdims=True))
            g = x[~held].T @ (e / e.sum(axis=1, keepdims=True) - y[~held]) / (~held).sum() + 1e-4 * w
            m, q = 0.9 * m + 0.1 * g, 0.999 * q + 0.001 * g * g
            w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
        z = x[held] @ w

        def loss(t: float) -> float:
            s = z / t - (z / t).max(axis=1, keepdims=True)
            return float(-((s - np.log(np.exp(s).sum(axis=1, keepdims=True))) * y[held]).sum())

        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
        self.weights = w

    def classify(self, words: list[str]) -> list[tuple[str, float, float]]:
        """Families that may be declared here, each with its calibrated probability and the share of its best template's shingles found."""
        z = (self.weights[self.features(words)].sum(axis=0) + self.weights[-1]) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        own, out = _shingles(words), []
        for k in range(1, len(p)):
            if p[k] > 0.02 or z[k] > z[0]:  # beside another licence the probability is small, though above that of unknown
                share = max(len(own & t) / len(t) for t in self.shingles[self.families[k]])
                if share >= CONTAINED:
                    out.append((self.families[k], float(p[k]), share))
        return out

    def _declared(self, found: dict[str, tuple[str, float, float]], own: set[tuple[str, ...]]) -> list[tuple[str, float, float]]:
        """Of close relatives the one whose template is there: others need what sets their templates apart as well."""
        words = {w for g in own for w in g}
        ranked = []
        for hit in found.values():
            template = max(self.shingles[hit[0]], key=lambda t: len(own & t) / len(t))
            numbered = {w for g in template for w in g if w[0].isdigit()} <= words
            ranked.append((numbered, len(own & template) / len(template), hit, template))
        out, known = [], set()
        for numbered, _, hit, template in sorted(ranked, key=lambda r: (not r[0], -r[1], -r[2][1], r[2][0])):
            apart = template - known
            relative = 4 * len(apart) <= 3 * len(template)  # shares a quarter with others: its version has to be there
            if apart and len(own & apart) >= CONTAINED * len(apart) and (numbered or not relative):
                out.append(hit)
                known |= template
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, float, int]]:
        """Each family that a paragraph of text declares, with the paragraph's number, or unknown where it holds a feature only.

        Long paragraphs are read in overlapping windows.
        """
        out = []
        for number, paragraph in enumerate(PARAGRAPHS.split(text or "")):
            words = words_of(paragraph)
            if self.marks.isdisjoint(words):
                continue
            best: dict[str, tuple[str, float, float]] = {}
            for s in range(0, max(1, len(words) - STRIDE), STRIDE):
                window = words[s : s + WINDOW]
                if not self.marks.isdisjoint(window):
                    for found in self.classify(window):
                        best[found[0]] = max(best.get(found[0], found), found, key=lambda f: (f[1], f[2]))
            hits = self._declared(best, _shingles(words)) if best else []
            out += [(*h, number) for h in hits or [(UNKNOWN, 0.0, 0.0)]]
        return out


@lru_cache(1)
def classifier() -> Classifier:
    return Classifier()


def _scan(batches: Iterator[pa.RecordBatch], model: Classifier) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            hits = [h for h in model.scan(text) if h[0] != UNKNOWN]
            best = max(hits, key=lambda h: (h[1], h[2], h[0]), default=None)
            out.append((len({h[3] for h in hits}), ",".join(sorted({h[0] for h in hits})), best and best[0], best and best[1], best and best[2]))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        types = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_paragraphs", "families", "family", "probability", "template_share"])


def scan_licences(documents: DataFrame) -> DataFrame:
    """One row for each row of documents (doc_id long, text string; other columns are ignored).

    doc_id, n_paragraphs long (paragraphs that declare a licence), families string (their families, sorted, comma between),
    family, probability and template_share of the surest one, null where there is none. Null and empty texts declare none.
    """
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_scan, model=classifier()), "doc_id long, n_paragraphs long, families string, family string, probability double, template_share double")
