"""Licence scans: a trained paragraph classifier with a calibrated unknown class, confirmed by comparison with templates.

Sparse features of a line are its words and word pairs, hashed; a multinomial logistic regression gives each licence family a probability, one class
stands for unknown licences and one for other text. Licence-like lines that follow each other, with at most GAP other lines between, are a paragraph, as
licences are wrapped; comment marks count as white space. A paragraph whose pooled probability of a family is above the calibrated threshold is compared
with the family's templates, alone and with a few of the lines around it. If it is not confirmed, its lines are judged one by one, and a licence-like line that passes neither is unknown.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import WordHasher, mix, text_slices

#: Notices of public licences, by family.
TEMPLATES = {
    "mit": [
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "apache": [
        "Apache License Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ],
    "gpl": [
        "GNU General Public License Version 2",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl": [
        "GNU Lesser General Public License Version 3",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "agpl": [
        "GNU Affero General Public License Version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Words of which a family's notice holds one, and words that no notice of it holds.
MARKS = {
    "mit": ({"mit", "hereby"}, set()),
    "apache": ({"apache", "apache-0", "unless"}, set()),
    "bsd": ({"bsd", "bsd-0-clause", "bsd-style", "redistribution"}, set()),
    "isc": ({"isc", "hereby"}, set()),
    "cc0": ({"cc0", "extent"}, set()),
    "unlicense": ({"unencumbered"}, set()),
    "gpl": ({"gnu", "gpl-0"}, {"affero", "lesser", "library"}),
    "lgpl": ({"lesser", "lgpl-0", "library"}, {"affero"}),
    "agpl": ({"affero", "agpl-0"}, set()),
    "mpl": ({"mozilla", "mpl-0"}, set()),
    "cc-by": ({"attribution", "by"}, {"noncommercial", "sharealike", "by-nc", "by-sa"}),
    "cc-by-sa": ({"sharealike", "attribution-sharealike", "by-sa"}, set()),
    "cc-by-nc": ({"noncommercial", "attribution-noncommercial", "by-nc"}, set()),
}
#: Other lines that a wrapped paragraph may hold between licence-like ones, and the most lines of one.
GAP, LINES = 2, 40
#: Lines that a paragraph may take in on either side, as not every line of a wrapped notice is licence-like by itself.
REACH = 4
#: Licence-like lines of no listed family, and ordinary sentences with words of licences.
UNKNOWN_TEXTS = [
    "Licensed under the Example Community License, version 1.2.",
    "This work is licensed under a proprietary agreement; all rights reserved.",
    "Copyright by the authors. All rights reserved.",
    "This program and the accompanying materials are made available under the terms of the Example Public License v2.0.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, express or implied.",
    "Released under a custom licence of the publisher.",
    "Redistribution is not permitted without written permission of the owner.",
]
PLAIN_TEXTS = [
    "He lost his driving license in the general store near the public garden.",
    "Permission to enter the park was granted to any person free of charge.",
    "The apache helicopter was released under heavy fire, version of events disputed.",
    "The work of the foundation is open to the public under the terms of its charter.",
    "Students of the university may copy and modify the source of this software for any purpose.",
    "The warranty covers all conditions of any kind for the first two years.",
    "A fishing licence costs four pounds and is sold at the harbour.",
    "The commons was a creative place, and attribution of the mural remained open.",
]
OTHER, UNKNOWN = "other", "unknown"
BITS = 18
#: Letters lower-cased, digits as 0, a hyphen and bytes of other scripts kept; all else separates words.
_FOLD = np.full(256, 32, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _FOLD[_b] = ord(_c.lower()) if _b < 128 and _c.isalpha() else 48 if _b < 128 and _c.isdigit() else _b if _b >= 128 or _c in "-\n" else 32


def paragraph_features(raw: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end of each line; line and hash of each feature)."""
    rows, _, l_start, l_end = hasher.spans(raw, offsets, 10)
    _, hashed, start, _ = hasher.words(_FOLD[raw], offsets, lower=False)
    line = np.searchsorted(l_start, start, "right") - 1
    same = line[1:] == line[:-1]
    pair = mix(hashed[:-1] * np.uint64(3) + hashed[1:])[same]
    at, both = np.concatenate([line, line[1:][same]]), np.concatenate([hashed, pair])
    return rows, l_start, l_end, at, (both >> np.uint64(64 - BITS)).astype(np.int64)


class LicenceModel:
    """Weights (2 ** BITS, classes), bias and temperature; the last class is other text, the one before it unknown licences."""

    def __init__(self, classes: list[str], weights: np.ndarray, bias: np.ndarray) -> None:
        self.classes, self.weights, self.bias = classes, weights, bias
        self.live, self.temperature, self.threshold = np.abs(weights).max(1) > 1e-6, 1.0, 0.5
        self.templates = {f: [set(folded(t)) for t in ts] for f, ts in TEMPLATES.items()}

    def logits(self, n_lines: int, line: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lines that have a live feature, their logits): features are scaled to unit length in each line."""
        on = self.live[feature]
        line, feature = line[on], feature[on]
        count = np.bincount(line, minlength=n_lines)
        lines = np.flatnonzero(count)
        place = np.cumsum(count > 0) - 1
        own = self.weights[feature] / np.sqrt(count[line])[:, None]
        z = np.stack([np.bincount(place[line], weights=own[:, j], minlength=len(lines)) for j in range(own.shape[1])], axis=1)
        return lines, (z + self.bias) / self.temperature

    def closeness(self, family: str, text: str) -> float:
        """The largest share of a template of the family that the paragraph holds, in distinct words; 0 if a mark of the family lacks or one of another is there."""
        words = set(folded(text))
        needed, foreign = MARKS.get(family, (set(), set()))
        if needed and not needed & words or foreign & words:
            return 0.0
        return max(len(t & words) / len(t) for t in self.templates[family])


def folded(text: str) -> list[str]:
    return _FOLD[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)].tobytes().decode("utf-8", "replace").split()


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def training_paragraphs(background: list[str], per_class: int, seed: int) -> list[tuple[str, str]]:
    """(class, paragraph): templates with words left out, added around and other version numbers, and lines of ordinary text."""
    rng = random.Random(seed)
    filler = sorted({w for t in background + PLAIN_TEXTS for w in t.split()})[:5000]
    names = {**TEMPLATES, UNKNOWN: UNKNOWN_TEXTS, OTHER: PLAIN_TEXTS}
    out = []
    for name, texts in names.items():
        for i in range(per_class):
            words = texts[i % len(texts)].split()
            if i >= len(texts):
                words = [w for w in words if rng.random() > (0.08 if len(words) > 5 else 0.0)]
                words = [str(rng.randrange(1, 9)) if w.rstrip(".,;").isdigit() else w for w in words]
                extra = [rng.choice(filler) for _ in range(rng.choice([0, 0, 1, 3, 6]))]
                cut = rng.randrange(len(extra) + 1)
                words = extra[:cut] + words + extra[cut:]
            out.append((name, " ".join(words)))
    lines = [line for text in background for line in text.split("\n") if line.split()]
    out += [(OTHER, line) for line in rng.sample(lines, min(len(lines), 4 * per_class))]
    out += [(OTHER, " ".join(rng.choice(filler) for _ in range(rng.randrange(3, 30)))) for _ in range(per_class)]
    return out


def train(background: list[str], per_class: int = 24, rounds: int = 200, rate: float = 2.0, seed: int = 7, precision: float = 0.98) -> LicenceModel:
    """Fitted on two thirds of training_paragraphs; temperature and threshold come from the rest."""
    rows = training_paragraphs(background, per_class, seed)
    random.Random(seed + 1).shuffle(rows)
    classes = [*TEMPLATES, UNKNOWN, OTHER]
    hasher = WordHasher()
    blobs = [t.replace("\n", " ").encode("utf-8", "replace") for _, t in rows]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
    row_of, _, _, line, feature = paragraph_features(np.frombuffer(b"".join(blobs), np.uint8), offsets, hasher)
    row = row_of[line]
    y = np.array([classes.index(c) for c, _ in rows])
    fit = np.arange(len(rows)) % 3 != 0
    used, column = np.unique(feature, return_inverse=True)
    x = np.zeros((len(rows), len(used)), np.float32)
    np.add.at(x, (row, column), 1)
    x /= np.maximum(np.sqrt(x.sum(1, keepdims=True)), 1)
    w, b, target = np.zeros((len(used), len(classes)), np.float32), np.zeros(len(classes), np.float32), np.eye(len(classes), dtype=np.float32)[y]
    for _ in range(rounds):
        delta = (softmax(x[fit] @ w + b) - target[fit]) / fit.sum()
        w -= rate * 10 * (x[fit].T @ delta + 1e-4 * w)
        b -= rate * delta.sum(0)
    weights = np.zeros((1 << BITS, len(classes)), np.float32)
    weights[used] = w
    model = LicenceModel(classes, weights, b)
    z, held = x[~fit] @ w + b, y[~fit]
    loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(held)), held], 1e-9)).mean()
    model.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0), key=loss)
    p = softmax(z / model.temperature)
    best, sure = p[:, : len(TEMPLATES)].argmax(1), p[:, : len(TEMPLATES)].max(1)
    for threshold in np.arange(0.2, 0.96, 0.05):
        chosen = sure >= threshold
        if chosen.any() and (best == held)[chosen].mean() >= precision:
            break
    model.threshold = float(threshold)
    return model


def wrapped(licence_like: np.ndarray, lines: np.ndarray, rows: np.ndarray) -> Iterator[list[int]]:
    """The licence-like lines in paragraphs: lines of one text with at most GAP others between, at most LINES in one."""
    block: list[int] = []
    for i in licence_like.tolist():
        if block and (rows[lines[i]] != rows[lines[block[-1]]] or lines[i] - lines[block[-1]] > GAP + 1 or len(block) >= LINES):
            yield block
            block = []
        block.append(i)
    if block:
        yield block


def stretches(first: int, last: int, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """The lines first..last, then with one and more of the lines that follow, then of those before: not beyond a blank line, at most REACH either way."""
    full = lambda i: 0 <= i < len(rows) and rows[i] == rows[first] and end[i] > start[i]
    yield first, last
    for _ in range(REACH):
        if not full(last + 1):
            break
        last += 1
        yield first, last
    for _ in range(REACH):
        if not full(first - 1):
            break
        first -= 1
        yield first, last


def background_texts(docs: DataFrame, id_col: str, text_col: str, sample: int) -> list[str]:
    """Ordinary text for training: at most ``sample`` texts of least hash, of a longer one 20,000 characters, without lines that speak of licences.

    The tasks send few more than that in all: only texts under a hash bound that follows from their number.
    """
    clue = r"(?i)licen[cs]e|copyright|warrant|redistribut|permission"
    own = docs.where(F.length(text_col) > 0).select(F.substring(F.col(text_col).cast("string"), 1, 20000).alias("t"), F.xxhash64(id_col, text_col).alias("h"))
    share = 2 * sample / max(1, docs.where(F.length(text_col) > 0).count())
    if share < 1:
        own = own.where(F.col("h") < int((share - 0.5) * 2**64))
    rows = own.orderBy("h", "t").limit(sample).select(F.expr(rf"array_join(filter(split(t, '\n'), l -> NOT regexp_like(l, '{clue}')), '\n')").alias("t"))
    return [r["t"] for r in rows.collect()]


SPAN = "array<struct<family:string,start:long,end:long,probability:double>>"


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", background: int = 200, closeness: float = 0.6, per_class: int = 24) -> DataFrame:
    """(id_col, licences, families, n_licences, n_unknown): the licence paragraphs of each whole text.

    licences holds (family, start, end, probability) of each confirmed or unknown paragraph, in code points, end exclusive, by start; families
    the distinct confirmed families, sorted and comma-joined ('' if none). The model is fitted on at most ``background`` texts and
    generated paragraphs. A null or empty text has none; rows come back one for one, repeated and null ids too. An empty table gives an
    empty result; further columns play no part.
    """
    trained = docs.sparkSession.sparkContext.broadcast(train(background_texts(docs, id_col, text_col, background), per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hasher = trained.value, WordHasher()
        kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        n_families = len(model.classes) - 2
        for batch in batches:
            for first, raw, offsets in text_slices(batch.column(1)):
                found: list[list] = [[] for _ in range(len(offsets) - 1)]
                if len(raw):
                    rows, start, end, line, feature = paragraph_features(raw, offsets, hasher)
                    lines, z = model.logits(len(rows), line, feature)
                    p = softmax(z)
                    licence_like = np.flatnonzero(p[:, -1] < 0.5)
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)]) if len(licence_like) else None
                    alone = []
                    for block in wrapped(licence_like, lines, rows):
                        j, k = int(lines[block[0]]), int(lines[block[-1]])
                        pooled = p[block].mean(0)
                        best = int(pooled[:n_families].argmax())
                        family, chance = model.classes[best], float(pooled[best])
                        text = lambda j, k: raw[start[j] : end[k]].tobytes().decode("utf-8", "replace")
                        near = stretches(j, k, rows, start, end) if chance >= model.threshold else ()
                        found_at = next(((a, b) for a, b in near if model.closeness(family, text(a, b)) >= closeness), None)
                        if found_at is None:
                            alone += block
                            continue
                        j, k = found_at
                        base = chars[offsets[rows[j]]]
                        found[rows[j]].append({"family": family, "start": int(chars[start[j]] - base), "end": int(chars[end[k]] - base), "probability": chance})
                    for i in alone:
                        j = int(lines[i])
                        text = raw[start[j] : end[j]].tobytes().decode("utf-8", "replace")
                        best = int(p[i, :n_families].argmax())
                        family, chance = model.classes[best], float(p[i, best])
                        if chance < model.threshold or model.closeness(family, text) < closeness:
                            family, chance = UNKNOWN, float(1 - p[i, -1])
                        base = chars[offsets[rows[j]]]
                        found[rows[j]].append({"family": family, "start": int(chars[start[j]] - base), "end": int(chars[end[j]] - base), "probability": chance})
                for own in found:
                    own.sort(key=lambda x: x["start"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(found)), pa.array(found, kind)], ["id", "licences"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = own.mapInArrow(run, f"id long, licences {SPAN}")
    known = F.filter("licences", lambda x: x["family"] != UNKNOWN)
    return out.select(
        F.col("id").alias(id_col),
        "licences",
        F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda x: x["family"]))), ",").alias("families"),
        F.size(known).cast("long").alias("n_licences"),
        (F.size("licences") - F.size(known)).cast("long").alias("n_unknown"),
    )
