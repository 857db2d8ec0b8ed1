"""License scans (operator 5): a trained paragraph classifier with template confirmation.

A paragraph ends at a blank line or at a sentence's end. It is classified line by line, so that a
notice counts wherever it stands, and as a whole with its line breaks as blanks, so that a wrapped
notice counts, too. Its features are the distinct word n-grams (one to three words) that
are in the vocabulary: the n-grams of the licence templates below. A multinomial logistic
regression, fitted on the driver to varied templates and to a bounded sample of paragraphs of
the corpus, gives weights for every family and for the class `unknown`; small weights are
dropped. Held-out examples, paragraphs of the corpus among them, calibrate it: they are weighted
to the share of licences among the sampled paragraphs, the bias of `unknown` is the one at which
its mean probability over them is its share, and the temperature the one of the least loss. A
paragraph predicted as a family is confirmed if it contains most n-grams of one of that
family's templates.

Scanning is native: DataFrame functions only. Weights are a broadcast table of the vocabulary's
size. Only paragraphs with one of the words that a family can't do without are scored; any other
paragraph can't reach a family.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sample

#: Notices and leading sentences of licence families, as they are published.
TEMPLATES = (
    ("agpl", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("apache", "distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD 3-Clause License"),
    ("bsd", "Released under the BSD license"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("cc0", "This work is dedicated to the public domain under CC0 1.0 Universal"),
    ("epl", "made available under the terms of the Eclipse Public License v2.0"),
    ("epl", "SPDX-License-Identifier: EPL-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "Released under the ISC License"),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("lgpl", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1"),
    ("mit", "MIT License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0"),
    ("mpl", "SPDX-License-Identifier: MPL-2.0"),
    ("proprietary", "All rights reserved"),
    ("proprietary", "Unauthorized copying of this file, via any medium is strictly prohibited"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "SPDX-License-Identifier: Unlicense"),
)
FAMILIES = tuple(sorted({f for f, _ in TEMPLATES}))
CLASSES = (*FAMILIES, "unknown")
GRAMS = (1, 2, 3)
#: Documents whose paragraphs serve as background, and paragraphs kept of them, at most.
BACKGROUND_DOCS, BACKGROUND = 200, 600
#: Temperatures tried by the calibration.
TEMPERATURES = tuple(2.0 ** (k / 4) for k in range(-8, 9))
#: Variants of each template, rounds and step of the fit, weight decay, least weight kept, least share of a template.
VARIANTS, EPOCHS, STEP, DECAY, LEAST_WEIGHT, CONFIRM = 14, 250, 0.1, 2e-3, 0.05, 0.7
#: Paragraphs that stand in for the background where the corpus has none.
PLAIN = ("the weather was fine and the people of the village went to the market", "a short note about the work of the week and what is to be done")

#: Lines end at line breaks and at sentence ends; paragraphs at blank lines (of comments, too) and at sentence ends.
_BREAK = r"\n|(?<=[.!?])[ \t]+"
_PARAGRAPH = r"(?<=[.!?])\s+|\n[ \t\r*#/]*\n\s*"
_SPLIT = r"[^a-z0-9\u0080-￿]+"


def grams(text: str) -> list[str]:
    """Distinct n-grams of the words that aren't numbers: families don't differ by version."""
    words = [w for w in re.split(_SPLIT, text.lower()) if w.strip("0123456789")]
    return sorted({" ".join(words[i : i + n]) for n in GRAMS for i in range(len(words) - n + 1)})


VOCABULARY = sorted({g for _, t in TEMPLATES for g in grams(t)})


class Classifier:
    """Weights (vocabulary x classes), biases, temperature, and the words that a family needs."""

    def __init__(self, background: list[str], seed: int = 5) -> None:
        rng = random.Random(seed)
        plain = [p for p in background if not any(set(grams(t)) <= set(grams(p)) for _, t in TEMPLATES)] or list(PLAIN)
        filler = [w for p in plain for w in p.split()] or PLAIN[0].split()
        rows: list[tuple[str, int]] = [(p, len(FAMILIES)) for p in plain]
        for family, text in TEMPLATES:
            words = text.split()
            for k in range(VARIANTS):
                some = [w for w in words if len(words) < 5 or rng.random() > 0.05 * (k % 3)]
                around = [[rng.choice(filler) for _ in range(rng.randrange(0, 12) * (k % 2))] for _ in range(2)]
                rows.append((" ".join(around[0] + some + around[1]), FAMILIES.index(family)))
        for _ in range(len(rows) // 4):  # words of the licences out of order are no licence
            rows.append((" ".join(rng.sample(filler, min(20, len(filler))) + [rng.choice(rng.choice(TEMPLATES)[1].split())]), len(FAMILIES)))
        rng.shuffle(rows)
        at = {g: i for i, g in enumerate(VOCABULARY)}
        x = np.zeros((len(rows), len(VOCABULARY)))
        for i, (t, _) in enumerate(rows):
            x[i, [at[g] for g in grams(t) if g in at]] = 1
        y = np.eye(len(CLASSES))[[c for _, c in rows]]
        held = np.arange(len(rows)) % 4 == 0
        self.weights, self.bias = self._fit(x[~held], y[~held])
        self.weights[np.abs(self.weights) < LEAST_WEIGHT] = 0
        # Licences among the sampled paragraphs, with one of either kind added.
        share = (sum(p not in plain for p in background) + 1) / (len(background) + 2)
        self.temperature, self.bias[-1] = self._calibrated(x[held] @ self.weights, y[held], share)
        seen = {w: n for w, n in zip(*np.unique([w for p in plain for w in set(grams(p)) if " " not in w], return_counts=True), strict=True)}
        self.needed = self._needed(seen)

    def _needed(self, seen: dict[str, int]) -> list[str]:
        """Words one of which every paragraph of a family must have.

        Each n-gram in favour of a family is reached through its rarest word. The commonest
        words are left out as long as all their n-grams together can't lift any family over
        the lead that `unknown` has without evidence.
        """
        gain = np.maximum(self.weights[:, :-1] - self.weights[:, -1:], 0)
        through: dict[str, np.ndarray] = {}
        for g, x in zip(VOCABULARY, gain, strict=True):
            if x.any():
                word = min(g.split(), key=lambda w: (seen.get(w, 0), w))
                through[word] = through.get(word, 0) + x
        room, out = self.bias[-1] - self.bias[:-1], []
        for word in sorted(through, key=lambda w: (-seen.get(w, 0) / through[w].max(), through[w].max(), w)):
            if (through[word] <= room).all():
                room = room - through[word]
            else:
                out.append(word)
        return sorted(out)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((x.shape[1], y.shape[1])), np.r_[np.zeros(len(FAMILIES)), 2.0]
        for _ in range(EPOCHS):
            d = (self._softmax(x @ w + b) - y) / len(x)
            w -= STEP * len(CLASSES) * (x.T @ d + DECAY * w / len(CLASSES))
            b -= STEP * d.sum(axis=0)
        return w, b

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _calibrated(self, s: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
        """Temperature and bias of `unknown`, from held-out scores and classes, licences weighing `share` in all."""
        unknown = y[:, -1] == 1
        weight = np.where(unknown, (1 - share) / max(unknown.sum(), 1), share / max((~unknown).sum(), 1))
        tried = []
        for t in TEMPERATURES:
            # Least first, as without any evidence a paragraph is unknown; the mean probability grows with the bias.
            low = self.bias[:-1].max()
            high = low + 64.0
            for _ in range(50):
                bias = (low + high) / 2
                p = self._softmax((s + np.r_[self.bias[:-1], bias]) / t)
                low, high = (bias, high) if weight @ (p[:, -1] - y[:, -1]) < 0 else (low, bias)
            tried.append((float(-weight @ np.log((p * y).sum(axis=1) + 1e-12)), t, high))
        return min(tried)[1:]

    def predict(self, text: str) -> tuple[str, float]:
        """Family (or unknown) and its probability, for one paragraph."""
        at = {g: i for i, g in enumerate(VOCABULARY)}
        p = self._softmax(((self.weights[[at[g] for g in grams(text) if g in at]].sum(axis=0) + self.bias) / self.temperature)[None])[0]
        return CLASSES[int(p.argmax())], float(p.max())


def train(docs: DataFrame) -> Classifier:
    """Fit on the templates and on paragraphs of at most BACKGROUND_DOCS documents, by a hash of id and text."""
    some = sample(docs.select("doc_id", "text"), BACKGROUND_DOCS, docs.count(), 3, "doc_id", "text").select(F.explode(F.split("text", _BREAK, -1)).alias("p"))
    lines = [r["p"] for r in some.where("length(trim(p)) > 0").orderBy(F.xxhash64("p"), "p").limit(BACKGROUND).collect()]
    return Classifier(lines)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT, -1), lambda w: F.translate(w, "0123456789", "") != "")


def _grams(words: Column) -> Column:
    """Distinct n-grams of a word array; `words` must be a plain column."""
    out = []
    for n in GRAMS:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), _run(words, n))
        out.append(F.when(F.size(words) >= n, runs).otherwise(F.expr("cast(array() as array<string>)")))
    return F.array_distinct(F.concat(*out))


def _run(words: Column, n: int):
    return lambda i: F.array_join(F.slice(words, i, n), " ")


def _row_key() -> Column:
    """128 bits of a row's id and text: at any number of rows no two different ones share it."""
    return F.struct(F.xxhash64("doc_id", "text").alias("x"), F.xxhash64(F.lit(1), "text", "doc_id").alias("y"))


def license_paragraphs(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """(key, paragraph, family, score, similarity, confirmed) for every paragraph of `docs`
    (doc_id, text, any others) that is predicted as a licence family.

    `key` is a hash (128 bits) of the row's id and text, `paragraph` its place from 0. Each line of a
    paragraph counts for itself; where the whole paragraph confirms a family that no line of
    it does, it counts once, in place of its lines of that family. Repeated rows give one
    result. Null and empty texts have no paragraph of a licence.
    """
    model = model or train(docs)
    spark = docs.sparkSession
    need = F.array(*map(F.lit, model.needed))
    live = [(g, *map(float, w)) for g, w in zip(VOCABULARY, model.weights, strict=True) if w.any()]
    vocabulary = F.broadcast(spark.createDataFrame(live, "gram string, " + ", ".join(f"w{i} double" for i in range(len(CLASSES)))))  # the templates' n-grams at most
    rows = docs.where(F.arrays_overlap(_words(F.col("text")), need)).select(_row_key().alias("key"), F.posexplode(F.split("text", _PARAGRAPH, -1)).alias("paragraph", "whole"))
    rows = rows.where(F.arrays_overlap(_words(F.col("whole")), need)).withColumn("parts", F.split("whole", "\n", -1))
    # The whole is at place 0, its lines from 1; a single line is no whole.
    rows = rows.select("key", "paragraph", F.posexplode(F.concat(F.array(F.when(F.size("parts") > 1, F.col("whole"))), F.col("parts"))).alias("at", "line"))
    lines = cut(rows.where(F.arrays_overlap(_words(F.col("line")), need)), "lines")
    # Each different paragraph is scored once, however many documents share it.
    words = lines.select("line").distinct().select("line", F.explode(F.array(_words(F.col("line")))).alias("words"))
    known = F.array(*(F.lit(r[0]) for r in live))
    sums = words.select("line", F.explode(F.array_intersect(_grams(F.col("words")), known)).alias("gram")).join(vocabulary, "gram")
    score = sums.groupBy("line").agg(*(F.sum(f"w{i}").alias(f"s{i}") for i in range(len(CLASSES))), F.collect_set("gram").alias("grams"))  # grams: the vocabulary at most
    logits = [((F.col(f"s{i}") + float(model.bias[i])) / float(model.temperature)) for i in range(len(CLASSES))]
    scored = score.select("line", "grams", F.array(*(F.struct(x.alias("s"), F.lit(c).alias("c")) for x, c in zip(logits, CLASSES, strict=True))).alias("z"))
    top = scored.withColumn("top", F.array_max("z")).where(F.col("top.c") != "unknown")
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x["s"] - F.col("top.s")))
    found = top.select("line", "grams", F.col("top.c").alias("family"), (1 / total).alias("score"))
    templates = F.broadcast(spark.createDataFrame([(f, grams(t)) for f, t in TEMPLATES], "family string, template array<string>"))  # as many rows as templates
    share = F.size(F.array_intersect("grams", "template")) / F.size("template")
    best = found.join(templates, "family").groupBy("line", "family", "score").agg(F.max(share).alias("similarity"))
    hits = lines.select("key", "paragraph", "at", "line").distinct().join(best, "line").drop("line").withColumn("confirmed", F.col("similarity") >= CONFIRM)
    whole, here = F.col("at") == 0, Window.partitionBy("key", "paragraph", "family")
    wrapped = F.max(F.col("confirmed") & whole).over(here) & ~F.max(F.col("confirmed") & ~whole).over(here)
    return hits.withColumn("wrapped", wrapped).where(F.col("wrapped") == whole).drop("at", "wrapped")


def license_scan(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """(doc_id, families, n_paragraphs, n_unconfirmed, score) for every row of `docs`.

    `families` are the confirmed families, sorted and comma-joined (empty: none),
    `n_paragraphs` their paragraphs, `n_unconfirmed` predicted paragraphs that resemble no
    template enough, `score` the largest probability of a confirmed paragraph (0: none).
    Null and empty texts have none. An empty table gives no rows.
    """
    hits = license_paragraphs(docs, model).groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.sum(F.col("confirmed").cast("long")).alias("n_paragraphs"),
        F.sum((~F.col("confirmed")).cast("long")).alias("n_unconfirmed"),
        F.max(F.when(F.col("confirmed"), F.col("score"))).alias("score"),
    )
    rows = docs.select("doc_id", _row_key().alias("key")).join(hits, "key", "left")
    none = F.lit(0).cast("long")
    return rows.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_paragraphs", none).alias("n_paragraphs"), F.coalesce("n_unconfirmed", none).alias("n_unconfirmed"), F.coalesce("score", F.lit(0.0)).alias("score"))
