"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line of a document. Its features are hashed word unigrams and bigrams, scaled to unit length. A multinomial logistic
regression over the licence families and an unknown class learns from the templates, cut and mixed in fixed chance ways, and from
a bounded sample of paragraphs that no template resembles. A temperature fitted on held-out rows calibrates its probabilities, so that
"unknown" is a class with a probability and not a leftover. A paragraph that is given to a family is then compared with the
family's templates: the share of the best template's bigrams that it holds confirms the prediction or does not.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector
from pyspark.sql import DataFrame, functions as F

from clinfeat.llm import words
from clinfeat.llm.shared import map_batches

BITS = 14
UNKNOWN = "unknown"
SAMPLE_DOCS = 300  # expected number of documents whose paragraphs stand for the unknown class
VARIANTS = 40
CONFIRMED = 0.6

#: Licence families and statements of them.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the software without restriction.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Distributed under the three clause BSD license.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it under the terms of the GNU General Public License, version 2 or later.",
        "Released under the GPL version 3.",
    ],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 3.", "Released under the LGPL version 2.1."],
    "mpl": ["This source code is subject to the terms of the Mozilla Public License, version 2.0."],
    "cc-by": ["This text is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-sa": ["Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0.", "This is free and unencumbered software released into the public domain."],
    "all-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved. No part may be reproduced without written permission."],
}

_BETWEEN = words._SPACE.copy()
_BETWEEN[:] = True
_BETWEEN[48:58] = _BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False


def paragraphs(texts: pa.Array):
    """(block of lines, row of the batch for each line, number of each line in its text)."""
    for block in words.blocks(texts):
        ends = np.flatnonzero(block.data == 10) + 1
        offsets = np.unique(np.concatenate([block.offsets, ends]))
        row = np.searchsorted(block.offsets, offsets[:-1], "right") - 1
        number = np.arange(len(row)) - np.searchsorted(row, row)
        yield words.Block(block.data, offsets, 0, _BETWEEN), block.first_row + row, number


def grams(lines: words.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, hash, is a bigram) of all unigrams and bigrams."""
    hashes, line = lines.word_hashes(lower=True), lines.row_of_word()
    pairs = words.run_hashes(hashes, 2)
    inside = line[:len(pairs)] == line[1:]
    return (
        np.concatenate([line, line[:len(pairs)][inside]]), np.concatenate([hashes, pairs[inside]]),
        np.concatenate([np.zeros(len(line), bool), np.ones(int(inside.sum()), bool)]),
    )


def _bigrams(texts: list[str]) -> list[set]:
    out = [set() for _ in texts]
    for lines, row, _ in paragraphs(pa.array([x.replace("\n", " ") for x in texts], pa.string())):
        line, value, pair = grams(lines)
        for i, h in zip(row[line[pair]].tolist(), value[pair].tolist()):
            out[i].add(h)
    return out


class Scanner:
    """``weights`` (places, classes), ``bias``, ``temperature``; class 0 is unknown."""

    def __init__(self, classes: list[str]):
        self.classes = classes
        self.weights, self.bias, self.temperature = np.zeros((1 << BITS, len(classes)), np.float32), np.zeros(len(classes)), 1.0
        self.bigrams = {c: _bigrams(TEMPLATES[c]) for c in classes if c != UNKNOWN}

    def logits(self, lines: words.Block) -> np.ndarray:
        line, value, _ = grams(lines)
        place = (value & np.uint64((1 << BITS) - 1)).astype(np.int64)
        order = np.argsort(line, kind="stable")
        bounds = np.searchsorted(line[order], np.arange(lines.rows + 1))
        total = np.zeros((lines.rows, len(self.classes)))
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            total[full] = np.add.reduceat(self.weights[place[order]], bounds[:-1][full])
        # unit length of the counts of places
        code, count = np.unique(line * (1 << BITS) + place, return_counts=True)
        length = np.sqrt(np.bincount(code >> BITS, count.astype(float) ** 2, lines.rows))
        return total / np.maximum(length, 1)[:, None] + self.bias

    def probabilities(self, lines: words.Block) -> np.ndarray:
        scaled = self.logits(lines) / self.temperature
        scaled = np.exp(scaled - scaled.max(1, keepdims=True))
        return scaled / scaled.sum(1, keepdims=True)


def _vectors(texts: list[str]) -> list[SparseVector]:
    out = []
    for lines, _, _ in paragraphs(pa.array([x.replace("\n", " ") or " " for x in texts], pa.string())):
        line, value, _ = grams(lines)
        place = (value & np.uint64((1 << BITS) - 1)).astype(np.int64)
        for i in range(lines.rows):
            at, count = np.unique(place[line == i], return_counts=True)
            out.append(SparseVector(1 << BITS, at, count / max(1.0, float(np.sqrt((count ** 2.0).sum())))))
    return out


def _resembles(found: set, templates: list[set]) -> float:
    return max((len(found & t) / len(t) for t in templates if t), default=0.0)


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Scanner:
    """Learn from the templates and the paragraphs of about ``sample`` documents, chosen by a hash of the text."""
    scanner = Scanner([UNKNOWN, *sorted(TEMPLATES)])
    usable = docs.where(F.length(F.trim("text")) > 0)
    chance = F.pmod(F.xxhash64("text", F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = usable.where(chance < min(1.0, sample / max(1, usable.count()))).select(F.explode(F.split("text", "\n")).alias("p"))
    corpus = [r["p"] for r in chosen.distinct().orderBy("p").collect() if r["p"].strip()]  # of a bounded number of documents
    everything = [t for x in scanner.bigrams.values() for t in x]
    other = [p for p, found in zip(corpus, _bigrams(corpus)) if _resembles(found, everything) < 0.3]
    rng = np.random.default_rng(29)
    texts, labels = list(other), [0] * len(other)
    for k, family in enumerate(scanner.classes[1:], 1):
        for template in TEMPLATES[family]:
            parts = template.split()
            for v in range(VARIANTS):
                kept = [w for w in parts if v == 0 or rng.random() > 0.1] or parts
                around = [other[int(rng.integers(len(other)))].split()[:6] if other and v % 3 else [] for _ in range(2)]
                texts.append(" ".join([*around[0], *kept, *around[1]]))
                labels.append(k)
    held = rng.random(len(texts)) < 0.25
    made = _vectors(texts)
    spark = docs.sparkSession
    rows = spark.createDataFrame([(float(y), x) for x, y, h in zip(made, labels, held) if not h], ["label", "features"])
    model = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=60, standardization=False).fit(rows.coalesce(2).persist())
    present = model.coefficientMatrix.toArray()
    scanner.weights[:, :len(present)] = present.T.astype(np.float32)
    scanner.bias[:len(present)] = model.interceptVector.toArray()
    check, truth = [t for t, h in zip(texts, held) if h], np.array([y for y, h in zip(labels, held) if h])
    if len(check):
        lines = paragraphs(pa.array([t.replace("\n", " ") for t in check], pa.large_string()))
        logits = np.concatenate([scanner.logits(block) for block, _, _ in lines])

        def loss(t):
            z = logits / t
            z = z - z.max(1, keepdims=True)
            return -(z[np.arange(len(truth)), truth] - np.log(np.exp(z).sum(1))).mean()

        scanner.temperature = float(min(np.geomspace(0.2, 5, 33), key=loss))
    return scanner


def _scanned(batch, scanner: Scanner):
    ids = batch.column("doc_id")
    for lines, row, number in paragraphs(batch.column("text")):
        share = scanner.probabilities(lines)
        best = share.argmax(1)
        hit = np.flatnonzero((best > 0) & (lines.counts > 0))
        families = [scanner.classes[k] for k in best[hit]]
        texts = [lines.data[lines.offsets[i]:lines.offsets[i + 1]].tobytes().decode() for i in hit]
        alike = [_resembles(found, scanner.bigrams[f]) for found, f in zip(_bigrams(texts), families)]
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(row[hit])).cast(pa.int64()), pa.array(number[hit].astype(np.int64)), pa.array(families, pa.string()),
             pa.array(share[hit, best[hit]].astype(float)), pa.array(alike, pa.float64()), pa.array([x >= CONFIRMED for x in alike], pa.bool_())],
            ["doc_id", "paragraph", "family", "probability", "similarity", "confirmed"],
        )


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed) of the paragraphs that the classifier gives to a family.

    ``paragraph`` counts the lines of the text from 0. Null and empty texts have none; lines without a letter or digit are unknown. Rows
    that repeat a document give their findings again; a null doc_id is passed on. Other columns are ignored; an empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(scanner)  # 2 ** BITS places for each family
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(
        rows, lambda b: _scanned(b, shipped.value),
        "doc_id long, paragraph long, family string, probability double, similarity double, confirmed boolean",
    )
