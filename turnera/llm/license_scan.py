"""Licence notices in documents, by a trained paragraph classifier that templates confirm.

A paragraph is a block of adjacent lines that are not blank: its words are read across line
ends, so a notice may be wrapped anywhere.  Long blocks are read in overlapping windows, so that
a notice inside running text is not diluted, and each line of a block is read alone too.  A
softmax regression over sparse word n-grams (one to three words of the templates) and the share
of other words tells the chance of every family and of ``unknown``.  It is trained here: on
varied notices for the families, and for ``unknown`` on lines of a bounded sample of the corpus
(``sample`` documents chosen by a hash of their id, ``paragraphs`` lines, those like a template
left out) and on templates' words out of order.  A held-out part calibrates: a temperature that
makes its probabilities fit, and for ``unknown`` an offset at which all but ``STRAY`` of the
held-out corpus lines stay unknown.

Families likelier than ``unknown`` are confirmed by comparison with their templates around the
window: most of one template's word pairs close together, all but a fifth of them in a template
of few.  A short block may also lie, but for a fifth, within a template.  Of confirmed notices
that overlap, that with the most word pairs stays: wordings of related licences share most of
their text, and the words that tell them apart decide.  Every notice names its block and the
line on which it begins (both from 0; lines are counted as they are in the text).

Sums of n-gram weights are prefix sums, so windows cost no second reading.  Nothing is
shuffled; classifier and templates are broadcast and have a fixed size.

Defined cases: null and blank texts have no paragraphs.  Ties go to the likelier family, then
to that named first.  Repeated rows are scanned each; other columns pass through, and an input
column named like an output is replaced.
"""

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnera.llm.common import adding, ready, require, text_of

# Wording of public licence notices, by family.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL, version 2.", "Released under the GPLv3.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.", "Licensed under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL": [
        "Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "CC BY": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under CC BY 3.0.",
    ],
    "CC BY-SA": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC BY-NC": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under CC BY-NC-SA 4.0.",
    ],
    "CC BY-ND": [
        "Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "Unlicense": [
        "Released under the Unlicense.", "This is free and unencumbered software released into the public domain.",
    ],
    "ISC": [
        "Released under the ISC License.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "EPL": [
        "Licensed under the Eclipse Public License, Version 2.0.", "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    ],
    "Boost": [
        "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0",
    ],
    "zlib": [
        "Released under the zlib License.", "SPDX-License-Identifier: Zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    ],
    "Proprietary": [
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
FAMILIES = list(TEMPLATES)
UNKNOWN = len(FAMILIES)

#: Documents whose paragraphs train the unknown class, and paragraphs taken, at most.
SAMPLE, PARAGRAPHS = 512, 2000
#: Words in a window of a long paragraph, and between the starts of two.
WINDOW, STRIDE = 48, 24
#: Shares of word pairs that confirm: of the template in the text, of a template of FEW pairs at most, of a short block in the template.
OF_TEMPLATE, OF_SHORT, OF_PARAGRAPH = 0.6, 0.8, 0.8
FEW, LEAST_WORDS = 8, 4
#: Held-out corpus lines that calibration lets be named, as a share.
STRAY = 0.005
#: Words that are laid out at once.
TOGETHER = 1 << 18

_WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


class Classifier(NamedTuple):
    words: dict[str, int]
    keys: np.ndarray  # sorted n-grams as numbers
    weights: np.ndarray  # n-grams and, last, none: by class
    dense: np.ndarray  # bias, share of other words, shortness: by class
    temperature: float
    offset: float
    pairs: list[tuple[int, dict]]  # family, and number of each word pair, of each template


def _keys(ids: np.ndarray, base: int) -> list[np.ndarray]:
    """N-grams that begin at each word, as numbers; -1 where a word is none of the templates'."""
    pad = np.r_[ids, -1, -1].astype(np.int64)
    one, two, three = pad[:-2], pad[1:-1], pad[2:]
    single = np.where(one >= 0, one, -1)
    double = np.where((one >= 0) & (two >= 0), base + one * base + two, -1)
    triple = np.where((one >= 0) & (two >= 0) & (three >= 0), base + base * base + (one * base + two) * base + three, -1)
    return [single, double, triple]


def _windows(count: int) -> list[tuple[int, int]]:
    if count <= WINDOW + STRIDE:
        return [(0, count)]
    return [(s, min(s + WINDOW, count)) for s in range(0, count - WINDOW + STRIDE, STRIDE)]


def _features(paragraphs: list[list[str]], words: dict[str, int], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training rows: n-gram counts over the root of the length, and dense values."""
    sparse, dense = np.zeros((len(paragraphs), len(keys)), np.float32), np.zeros((len(paragraphs), 3), np.float32)
    for row, own in enumerate(paragraphs):
        ids = np.array([words.get(w, -1) for w in own], np.int64)
        for part in _keys(ids, len(words)):
            found = part[part >= 0]
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            np.add.at(sparse[row], at[keys[at] == found], 1)
        root = np.sqrt(max(1, len(own)))
        sparse[row] /= root
        dense[row] = 1, (ids < 0).mean() if len(ids) else 1, 1 / root
    return sparse, dense


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits = np.exp(logits - logits.max(axis=1, keepdims=True))
    return logits / logits.sum(axis=1, keepdims=True)


def _varied(random, words: list[str], filler: list[str]) -> list[str]:
    """A notice with words lost, cut short, or set in other text."""
    own = [w for w in words if random.random() > 0.08] or words
    if len(own) > 12 and random.random() < 0.4:
        start = int(random.integers(0, len(own) // 2))
        own = own[start : start + max(10, len(own) // 2)]
    extra = [filler[i] for i in random.integers(0, len(filler), int(random.integers(0, WINDOW)))] if filler and random.random() < 0.6 else []
    split = int(random.integers(0, len(extra) + 1))
    return extra[:split] + own + extra[split:]


def _pairs(template: list[str]) -> dict[tuple[str, str], int]:
    return {pair: number for number, pair in enumerate(dict.fromkeys(zip(template, template[1:])))}


def train(corpus: list[str], seed: int = 5, variants: int = 24, rounds: int = 160) -> Classifier:
    random = np.random.default_rng(seed)
    templates = [(f, words_of(t)) for f, name in enumerate(FAMILIES) for t in TEMPLATES[name]]
    words = {w: i for i, w in enumerate(sorted({w for _, t in templates for w in t}))}
    keys = np.unique(np.concatenate([k[k >= 0] for _, t in templates for k in _keys(np.array([words[w] for w in t]), len(words))]))
    pairs = [(f, _pairs(t)) for f, t in templates]
    plain = [own for own in map(words_of, corpus) if own and not any(_confirmed(own, held, True) for _, held in pairs)]
    filler = sorted({w for own in plain for w in own})
    examples = [(_varied(random, t, filler), f) for f, t in templates for _ in range(variants)]
    first = len(examples)
    examples += [(own[:WINDOW], UNKNOWN) for own in plain]
    last = len(examples)
    for _, t in templates:  # the same words, but no notice
        for _ in range(4):
            mixed = [t[i] for i in random.permutation(len(t))][: int(random.integers(1, len(t) + 1))]
            examples.append((mixed + [filler[i] for i in random.integers(0, len(filler), 6)] if filler else mixed, UNKNOWN))
    order = random.permutation(len(examples))
    sparse, dense = _features([examples[i][0] for i in order], words, keys)
    rows, kinds = np.hstack([sparse, dense]), np.array([examples[i][1] for i in order])
    held = np.arange(len(rows)) % 5 == 0
    target = np.eye(UNKNOWN + 1, dtype=np.float32)[kinds]
    share = 1 / np.maximum(1, np.bincount(kinds[~held], minlength=UNKNOWN + 1))[kinds[~held]]
    share = (share / share.sum()).astype(np.float32)[:, None]
    weights = np.zeros((rows.shape[1], UNKNOWN + 1), np.float32)
    speed, scale = np.zeros_like(weights), np.zeros_like(weights)
    x, y = rows[~held], target[~held]
    for step in range(1, rounds + 1):
        grad = x.T @ ((_softmax(x @ weights) - y) * share) + 1e-5 * weights
        speed, scale = 0.9 * speed + 0.1 * grad, 0.99 * scale + 0.01 * grad * grad
        weights -= 0.1 * (speed / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)
    logits, own = rows[held] @ weights, kinds[held]
    at = np.arange(len(own))
    temperature = min((0.25 * 1.25**i for i in range(16)), key=lambda t: -np.log(_softmax(logits / t)[at, own] + 1e-9).mean())
    none = logits[(order[held] >= first) & (order[held] < last)] / temperature  # corpus lines, not templates out of order
    over = np.quantile(none[:, :UNKNOWN].max(axis=1) - none[:, UNKNOWN], 1 - STRAY, method="higher") if len(none) else 0.0
    cut = len(keys)
    padded = np.vstack([weights[:cut], np.zeros((1, UNKNOWN + 1))])
    return Classifier(words, keys, padded, weights[cut:].astype(float), float(temperature), max(0.0, float(over)), pairs)


def _confirmed(own: list[str], pairs: dict[tuple[str, str], int], short: bool) -> tuple[int, float, int, int] | None:
    """Where a template is told best: number of its pairs, likeness, first word and end; none if not confirmed.

    Pairs count while they lie within one and a half times the template's length.  ``short``: the
    words are a whole block, which may also lie within the template.
    """
    at = [(i, pairs[pair]) for i, pair in enumerate(zip(own, own[1:])) if pair in pairs]
    if not at:
        return None
    reach, whole = len(pairs) + len(pairs) // 2 + 2, len(pairs)
    held: dict[int, int] = {}
    best, left = (0, 0, 0), 0
    for i, number in at:
        held[number] = held.get(number, 0) + 1
        while at[left][0] < i - reach:
            gone = at[left][1]
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            left += 1
        if len(held) > best[0]:
            best = (len(held), at[left][0], i + 2)
    common, start, stop = best
    if common >= (OF_SHORT if whole <= FEW else OF_TEMPLATE) * whole:
        return common, common / whole, start, stop
    if short and len(own) >= LEAST_WORDS and len({n for _, n in at}) >= OF_PARAGRAPH * len(set(zip(own, own[1:]))):
        return common, common / len(set(zip(own, own[1:]))), start, stop
    return None


def blocks_of(text: str) -> list[tuple[list[str], list[int], list[int]]]:
    """Blocks of adjacent non-blank lines: words, first word of each line that has words, number of that line."""
    blocks: list[tuple[list[str], list[int], list[int]]] = []
    inside = False
    for number, line in enumerate(text.split("\n")):
        if not line.strip():
            inside = False
            continue
        if not inside:
            blocks.append(([], [], []))
            inside = True
        own = words_of(line)
        if own:
            words, begins, lines = blocks[-1]
            begins.append(len(words))
            lines.append(number)
            words.extend(own)
    return blocks


def scan(texts: list[str], model: Classifier) -> list[tuple[int, list[dict]]]:
    """Per text: number of paragraphs, and its confirmed notices."""
    results: list[tuple[int, list[dict]]] = []
    spans: list[tuple] = []  # text, paragraph, words, begins of lines, numbers of lines
    waiting = 0
    for number, text in enumerate(texts):
        blocks = blocks_of(text)
        results.append((len(blocks), []))
        for at, (own, begins, lines) in enumerate(blocks):
            if own:
                spans.append((number, at, own, begins, lines))
                waiting += len(own)
            if waiting >= TOGETHER:
                _settle(spans, model, results)
                spans, waiting = [], 0
    _settle(spans, model, results)
    return results


def _places(own: list[str], begins: list[int]) -> set[tuple[int, int]]:
    """What is read of a block: windows over all its words, and over each of its lines."""
    ends = [*begins[1:], len(own)]
    return set(_windows(len(own))) | {(b + s, b + e) for b, end in zip(begins, ends) for s, e in _windows(end - b)}


def _apart(found: list[dict]) -> list[dict]:
    """Of notices that overlap, that with the most word pairs, then the likelier."""
    kept: list[dict] = []
    for one in sorted(found, key=lambda n: (-n["common"], -n["probability"], n["number"], n["start"])):
        if all(one["stop"] <= other["start"] or other["stop"] <= one["start"] for other in kept):
            kept.append(one)
    return sorted(kept, key=lambda n: n["start"])


def _settle(spans, model: Classifier, results) -> None:
    if not spans:
        return
    base = len(model.words)
    get = model.words.get
    ids = np.fromiter((get(w, -1) for _, _, own, *_ in spans for w in own), np.int64)
    sums = []
    for part in _keys(ids, base):
        at = np.minimum(np.searchsorted(model.keys, part), len(model.keys) - 1)
        at = np.where(model.keys[at] == part, at, len(model.keys))
        sums.append(np.vstack([np.zeros((1, UNKNOWN + 1)), np.cumsum(model.weights[at], axis=0)]))
    other = np.r_[0, np.cumsum(ids < 0)]
    begins = np.cumsum([0, *(len(own) for _, _, own, *_ in spans)])
    places = [(i, begins[i] + a, begins[i] + b) for i, (_, _, own, lines, _) in enumerate(spans) for a, b in sorted(_places(own, lines))]
    which, start, stop = (np.array(c) for c in zip(*places))
    length = stop - start
    root = np.sqrt(length)[:, None]
    logits = sum(s[np.maximum(start, stop - n)] - s[start] for n, s in enumerate(sums)) / root
    dense = np.stack([np.ones(len(start)), (other[stop] - other[start]) / length, 1 / root[:, 0]], axis=1)
    logits = (logits + dense @ model.dense) / model.temperature
    logits[:, UNKNOWN] += model.offset
    chances = _softmax(logits)
    found: dict[int, dict] = {}
    for w, family in np.argwhere(chances[:, :UNKNOWN] > chances[:, UNKNOWN:]).tolist():
        own = spans[which[w]][2]
        first = max(0, start[w] - begins[which[w]] - WINDOW)  # a template may reach beyond the window
        around = own[first : stop[w] - begins[which[w]] + WINDOW]
        for template, (f, pairs) in enumerate(model.pairs):
            told = _confirmed(around, pairs, len(own) <= WINDOW) if f == family else None
            if told:
                common, likeness, at, end = told
                place = (template, first + at)
                notices = found.setdefault(which[w], {})
                if place not in notices or chances[w, family] > notices[place]["probability"]:
                    notices[place] = {
                        "number": family, "start": int(first + at), "stop": int(first + end), "common": common,
                        "probability": float(chances[w, family]), "similarity": likeness,
                    }
    for i, notices in sorted(found.items()):
        number, paragraph, _, starts, lines = spans[i]
        results[number][1].extend(
            {
                "paragraph": paragraph, "line": lines[bisect_right(starts, n["start"]) - 1], "family": FAMILIES[n["number"]],
                "probability": n["probability"], "similarity": n["similarity"],
            }
            for n in _apart(list(notices.values()))
        )


NOTICES = "struct<n_paragraphs:bigint,notices:array<struct<paragraph:bigint,line:bigint,family:string,probability:double,similarity:double>>>"
_KIND = pa.struct([("n_paragraphs", pa.int64()), ("notices", pa.list_(pa.struct([("paragraph", pa.int64()), ("line", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())])))])


def sampled_paragraphs(docs: DataFrame, key: str, text: str, sample: int = SAMPLE, paragraphs: int = PARAGRAPHS) -> list[str]:
    """Lines of ``sample`` documents, and ``paragraphs`` of them, chosen by hash; cut to a window's size."""
    chosen = docs.select(F.col(f"`{key}`").alias("k")).orderBy(F.xxhash64("k"), "k").limit(sample).distinct()
    texts = docs.select(F.col(f"`{key}`").alias("k"), text_of(text).alias("t"))
    lines = texts.join(F.broadcast(chosen), "k").select(F.explode(F.split("t", "\n")).alias("line")).filter(F.trim("line") != "").select(F.substring("line", 1, 12 * WINDOW).alias("line"))
    return [r["line"] for r in lines.orderBy(F.xxhash64("line"), "line").limit(paragraphs).collect()]


def with_notices(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, paragraphs: int = PARAGRAPHS) -> DataFrame:
    """Add ``n_paragraphs`` and ``notices`` (paragraph, line, family, probability, similarity) to every row."""
    require(docs, key, text)
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(sampled_paragraphs(docs, key, text, sample, paragraphs)))

    @F.arrow_udf(NOTICES)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([{"n_paragraphs": n, "notices": found} for n, found in scan(batch.to_pylist(), shared.value)], _KIND)

    held = adding(docs, {"_scan": scanned(text_of(text))})
    return adding(held, {n: F.col(f"_scan.{n}") for n in ("n_paragraphs", "notices")}).drop("_scan")
