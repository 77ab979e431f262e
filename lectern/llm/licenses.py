"""Licence scan: a trained paragraph classifier, confirmed by templates.

A block is a run of lines with words, between blank lines. A multinomial logistic regression
over hashed word uni-, bi- and trigrams (as shares of the words' n-grams) gives each family a
probability, and one to plain text. It scores every line. Neighbouring lines of a block that
are not plain, as a wrapped notice's are, make a paragraph, which is scored as a whole, and is cut
where lines are sure notices of different families by themselves.

The classifier is trained here: on the templates and on variants of them (words lost, swapped
or added, parts only, lines as they come from wrapping), and as plain text on at most
``PLAIN_ROWS`` lines of the corpus, the least hash of each of so many parts, that share no run
of three words with a template. A quarter of the examples calibrates two cutoffs: for a name,
the largest that keeps ``KEPT`` of the family examples, and no less than plain lines reach;
for not being plain, what no plain line reaches, and ``MARGIN`` at least.

Every named paragraph is compared with the family's templates: the share of a template's
five-word shingles (of a shorter template: the whole of it) that the paragraph holds, across
its line ends. At ``SIMILAR`` or more the family is confirmed. Paragraphs that are not plain but belong to no family for
certain, or that no template confirms, are ``unknown``, with the likeliest family beside.

Null and empty texts have no paragraphs. Very long texts are read whole, line by line; repeated
rows and paragraphs are reported each time. Empty tables give empty results; extra columns stay out.
The model (``SIZE`` x families) is broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.columns import present, small_batches

SIZE = 1 << 15
PLAIN_ROWS = 4_000
VARIANTS, PASSES, RATE = 60, 100, 2.0
KEPT, SIMILAR = 0.98, 0.8
SHINGLE = 5
REMEMBERED = 300_000
PLAIN, UNKNOWN = "plain", "unknown"
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

#: Fixed texts: customary notices of each licence family.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
        "file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under "
        'the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF '
        "ANY KIND, either express or implied."),
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    "bsd": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this "
        "program."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0."),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
        "International License."),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License."),
    "isc": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."),
    "public-domain": (
        "This work is dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain."),
    "proprietary": ("All rights reserved.", "No part of this work may be reproduced without "
                    "written permission of the publisher."),
}
#: Short names of the families, as they stand in file headers.
SHORT_NAMES = {
    "apache-2.0": ("Apache-2.0", "Apache License 2.0"), "mit": ("MIT",),
    "bsd": ("BSD-2-Clause", "BSD-3-Clause", "BSD"),
    "gpl": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0", "GPL-2.0-or-later", "GPLv3",
            "GPLv2", "GPL"),
    "mpl-2.0": ("MPL-2.0", "MPL"), "cc-by": ("CC-BY-4.0", "CC BY 4.0"),
    "cc-by-sa": ("CC-BY-SA-4.0", "CC BY-SA 4.0"), "cc-by-nc": ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    "isc": ("ISC",), "public-domain": ("CC0-1.0", "Unlicense"),
}
HEADERS = ("SPDX-License-Identifier: {}", "License: {}", "Licence: {}")
for _family, _names in SHORT_NAMES.items():
    TEMPLATES[_family] += tuple(header.format(name) for name in _names for header in HEADERS)
FAMILIES = (*TEMPLATES, PLAIN)
MARGIN = 0.5
#: Words of a line when a notice is wrapped.
WRAPPED = (6, 14)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Features:
    """Hashed n-grams of paragraphs; remembers word hashes within a task."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _code(self, word: str) -> int:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        return self.known.setdefault(word, zlib.crc32(word.encode()))

    def of(self, found: list[str]) -> np.ndarray:
        known, code = self.known, self._code
        codes = np.fromiter((known.get(w) or code(w) for w in found), np.uint64, len(found))
        parts, mixed = [codes * np.uint64(0x9E3779B97F4A7C15)], codes
        for n in (1, 2):
            if len(codes) > n:
                mixed = (mixed[:-1] * np.uint64(0x100000001B3)) ^ codes[n:]
                parts.append((mixed + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15))
        return (np.concatenate(parts) >> np.uint64(49)).astype(np.int64)  # 15 bits


def shingles(found: list[str], width: int) -> set[tuple[str, ...]]:
    return {tuple(found[i:i + width]) for i in range(len(found) - width + 1)}


def similarity(found: list[str], family: str) -> float:
    """The largest share of a template of the family that the paragraph holds."""
    best, cache = 0.0, {}
    for template in TEMPLATES.get(family, ()):
        wanted = words(template)
        width = min(SHINGLE, len(wanted))
        if width not in cache:
            cache[width] = shingles(found, width)
        parts = shingles(wanted, width)
        best = max(best, len(parts & cache[width]) / len(parts))
    return best


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # SIZE x families
    bias: np.ndarray
    cutoff: float
    not_plain: float = MARGIN

    def probabilities(self, numbers: np.ndarray) -> np.ndarray:
        logits = self.weights[numbers].mean(axis=0, dtype=np.float64) + self.bias
        odds = np.exp(logits - logits.max())
        return odds / odds.sum()


def variants() -> tuple[list[list[str]], list[int]]:
    """Templates and altered copies of them, with their families."""
    draw = np.random.default_rng(11)
    rows, families = [], []
    extra = [w for texts in TEMPLATES.values() for t in texts for w in words(t)]
    for number, family in enumerate(TEMPLATES):
        for template in TEMPLATES[family]:
            whole = words(template)
            rows.append(whole)
            families.append(number)
            for _ in range(VARIANTS):
                one = [w for w in whole if draw.random() > 0.08]
                if len(one) > 12 and draw.random() < 0.5:
                    start = draw.integers(0, len(one) // 3)
                    one = one[start:start + max(8, int(len(one) * draw.uniform(0.5, 1)))]
                for _ in range(draw.integers(0, 3)):
                    one.insert(draw.integers(0, len(one) + 1), extra[draw.integers(len(extra))])
                if one:
                    rows.append(one)
                    families.append(number)
            for _ in range(VARIANTS // 4 if len(whole) > 2 * WRAPPED[0] else 0):
                at = -int(draw.integers(0, WRAPPED[0]))
                while at < len(whole):
                    end = at + int(draw.integers(*WRAPPED))
                    if end - max(at, 0) >= 4:
                        rows.append(whole[max(at, 0):end])
                        families.append(number)
                    at = end
    return rows, families


def fit(plain: list[str]) -> Model:
    """Trains and calibrates on the variants and on plain paragraphs."""
    features = Features()
    rows, families = variants()
    known = set().union(*(shingles(words(t), 3) for ts in TEMPLATES.values() for t in ts))
    others = [w for w in map(words, plain) if w and not shingles(w, 3) & known]
    rows += others
    labels = np.array(families + [len(FAMILIES) - 1] * len(others))
    numbers = [features.of(r) for r in rows]
    aside = np.arange(len(rows)) % 4 == 3
    train = [i for i in range(len(rows)) if not aside[i]]
    cells = np.concatenate([numbers[i] for i in train])
    owner = np.repeat(np.arange(len(train)), [len(numbers[i]) for i in train])
    share = np.repeat([1 / len(numbers[i]) for i in train], [len(numbers[i]) for i in train])
    used, places = np.unique(cells, return_inverse=True)
    weights, bias = np.zeros((len(used), len(FAMILIES))), np.zeros(len(FAMILIES))
    squares, bias_squares = np.full(weights.shape, 1e-8), np.full(bias.shape, 1e-8)
    wanted = np.eye(len(FAMILIES))[labels[train]]
    balance = (1 / np.bincount(labels[train], minlength=len(FAMILIES)).clip(1))[labels[train]]
    balance = (balance / balance.mean())[:, None]
    by_cell, by_row = np.argsort(places, kind="stable"), np.flatnonzero(np.diff(owner, prepend=-1))
    cell_starts = np.flatnonzero(np.diff(places[by_cell], prepend=-1))
    for _ in range(PASSES):
        logits = np.add.reduceat(weights[places] * share[:, None], by_row) + bias
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (odds / odds.sum(axis=1, keepdims=True) - wanted) * balance / len(train)
        spread = (error[owner] * share[:, None])[by_cell]
        slope = np.add.reduceat(spread, cell_starts) + 1e-7 * weights
        squares += slope * slope
        weights -= RATE * slope / np.sqrt(squares)
        bias_squares += error.sum(axis=0) ** 2
        bias -= 0.1 * error.sum(axis=0) / np.sqrt(bias_squares)
    full = np.zeros((SIZE, len(FAMILIES)), np.float32)
    full[used] = weights
    model = Model(full, bias, 0.0)
    own, plain_best, plain_any = [], [0.0], [0.0]
    for i in np.flatnonzero(aside):
        p = model.probabilities(numbers[i])
        if labels[i] == len(FAMILIES) - 1:
            plain_best.append(p[:-1].max())
            plain_any.append(1 - p[-1])
        else:
            own.append(p[labels[i]])
    own_cutoff = float(np.quantile(own, 1 - KEPT)) if own else 0.0
    return Model(full, bias, max(own_cutoff, max(plain_best)), max(MARGIN, max(plain_any)))


def train(docs: DataFrame) -> Model:
    lines = docs.select(F.explode(F.split(present(F.col("text")), "\n")).alias("line")).where(
        F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    hashed = lines.select("line", F.xxhash64("line").alias("h"))
    chosen = hashed.groupBy(F.pmod("h", F.lit(PLAIN_ROWS)).alias("part")).agg(
        F.min("h").alias("h")).select("h")  # at most PLAIN_ROWS numbers
    found = hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("line").alias("line"))
    return fit([r["line"] for r in sorted(found.collect())])


FOUND = T.ArrayType(T.StructType([
    T.StructField("paragraph", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("family", T.StringType()),
    T.StructField("likeliest", T.StringType()), T.StructField("probability", T.DoubleType()),
    T.StructField("similarity", T.DoubleType())]))


@dataclass
class Line:
    number: int
    start: int
    end: int
    found: list[str]
    chances: np.ndarray


def paragraphs(text: str, model: Model, features: Features) -> Iterator[list[Line]]:
    """Runs of neighbouring lines that are not plain."""
    start, run = 0, []
    for number, line in enumerate(text.split("\n")):
        found = words(line)
        chances = model.probabilities(features.of(found)) if found else None
        if found and 1 - chances[-1] > model.not_plain:
            run.append(Line(number, start, start + len(line), found, chances))
        elif run:
            yield run
            run = []
        start += len(line) + 1
    if run:
        yield run


def judged(run: list[Line], model: Model, features: Features) -> dict:
    """A paragraph with its family, confirmed by a template, or ``unknown``."""
    found = [word for line in run for word in line.found]
    chances = run[0].chances if len(run) == 1 else model.probabilities(features.of(found))
    order = np.argsort(-chances[:-1], kind="stable")
    family, same = FAMILIES[int(order[0])], similarity(found, FAMILIES[int(order[0])])
    sure = chances[order[0]] >= model.cutoff and same >= SIMILAR
    return {
        "paragraph": run[0].number, "start": run[0].start, "end": run[-1].end,
        "family": family if sure else UNKNOWN, "likeliest": family,
        "probability": float(chances[order[0]]), "similarity": same}


def notices(run: list[Line], model: Model, features: Features) -> list[list[Line]]:
    """A run cut before lines that are sure notices of another family than those before them."""
    sure = [judged([line], model, features)["family"] for line in run]
    if len(set(sure) - {UNKNOWN}) < 2:
        return [run]
    parts, own = [[run[0]]], sure[0]
    for line, family in zip(run[1:], sure[1:]):
        if UNKNOWN not in (family, own) and family != own:
            parts.append([])
        own = own if family == UNKNOWN else family
        parts[-1].append(line)
    return parts


def scan_text(text: str, model: Model, features: Features) -> list[dict]:
    """The licence paragraphs of one text."""
    return [judged(part, model, features) for run in paragraphs(text, model, features)
            for part in (notices(run, model, features) if len(run) > 1 else [run])]


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per licence paragraph: doc_id, place, family, probability, similarity."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        features = Features()
        return pa.array([scan_text(x.as_py() or "", shared.value, features) for x in texts],
                        pa.list_(pa.struct([
                            ("paragraph", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                            ("family", pa.string()), ("likeliest", pa.string()),
                            ("probability", pa.float64()), ("similarity", pa.float64())])))

    return docs.select("doc_id", F.inline(found("text")))
