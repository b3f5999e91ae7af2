"""License scans: a trained paragraph classifier with an unknown class, confirmed by templates.

The classifier is a multinomial logistic regression on sparse word n-grams (one to three words, not all
of them function words) that occur in the license templates. It is fitted on the driver to a bounded sample:
pieces of the templates, and paragraphs of the corpus that are like no template, which are the
unknown class; a temperature fitted on held-out pieces calibrates its probabilities. Weights are whole
thousandths, so that sums do not hang on their order.

Scanning is DataFrame code only. A paragraph without a template's content word has no feature and is
unknown by the intercepts, so it goes no further; what is left is scored once for each distinct
paragraph. A prediction stands if enough of the paragraph's word pairs are in a template of its family.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled

UNKNOWN = "unknown"
#: License families and their notices: fixed wordings of the licences.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0. SPDX-License-Identifier: Apache-2.0",
        "This project is licensed under the Apache License 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License. SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License. SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD License. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v2.0 or later. SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL. Licensed under GPLv3. Licensed under GPLv2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1. SPDX-License-Identifier: LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Released under the LGPL.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3. SPDX-License-Identifier: AGPL-3.0",
        "This program is distributed under the terms of the GNU Affero General Public License as published by the Free Software Foundation. Released under the AGPL.",
    ],
    "mpl": [
        "Licensed under the Mozilla Public License, version 2.0. SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under the Creative Commons Attribution License. SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License. SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0. Licensed under CC BY-NC-ND 4.0. SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "public-domain": [
        "Released into the public domain. This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. Licensed under CC0 1.0 Universal. SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright reserved by the author. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: Paragraphs with words of licences that grant nothing: the unknown class's hard cases.
NEAR_MISSES = [
    "the driver lost a license and had to apply for a new version of it",
    "the general public is free to use the park under the terms of the city",
    "she asked for permission to publish a copy of the work",
    "the software was distributed with the source of the program",
    "the file is in the public library at the foundation",
    "apache is a name of a people and of a helicopter",
    "students at mit sell copies of the software",
    "the creative commons room is open to any person",
]
#: Function words: an n-gram of these alone is no feature.
FUNCTION_WORDS = frozenset(
    "a an and any are as at be been but by can for from had has have he her his if in into is it its may must no nor not of on or our shall should she so such than that the their them then there these they this those to was we were which who will with without you your all either one other only also made use used under".split()
)
WORDS = r"[^\p{L}\p{N}]+"
#: Bounds on what is learned from; the share of word pairs that confirms; n-gram sizes.
CORPUS_TEXTS, CORPUS_PARAGRAPHS, CONFIRM, LONGEST = 400, 3000, 0.6, 3
#: Places in which a paragraph of many documents meets its family.
SALTS = 16


@dataclass
class Model:
    families: list[str]
    weights: dict[str, list[int]]  # n-gram -> thousandths by family, unknown last
    intercepts: list[int]
    temperature: float
    sure: float = 0.0  # the calibrated probability under which a prediction is unknown


def tokens(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]


def ngrams(words: list[str], most: int = LONGEST) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)}


def content(gram: str) -> bool:
    return not all(w in FUNCTION_WORDS or len(w) == 1 and not w.isdigit() for w in gram.split()) and not gram.isdigit()


def pair_share(words: list[str], template: list[str]) -> float:
    """Share of a paragraph's word pairs (or its only word) that a template has."""
    n = 2 if len(words) > 1 else 1
    mine, theirs = ({" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (words, template))
    return len(mine & theirs) / len(mine) if mine else 0.0


def examples() -> list[tuple[list[str], str]]:
    """Templates, their sentences, and both with words before and after."""
    out = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            pieces = {text, *re.split(r"(?<=[.:;])\s+", text)}
            for piece in sorted(pieces):
                words = tokens(piece)
                if any(content(g) for g in ngrams(words)):
                    out += [(words, family), (["copyright", "c", "2020", "the", "authors", *words], family), ([*words, "see", "the", "file", "for", "details"], family)]
    return out


def learn(docs: DataFrame, texts: int = CORPUS_TEXTS, paragraphs: int = CORPUS_PARAGRAPHS) -> Model:
    """Fit to the templates and to at most `paragraphs` paragraphs of the `texts` texts of least hash; four times as many, those of least hash, come to the driver."""
    mark = F.xxhash64("text")
    marks = docs.where("text is not null").select(mark.alias("mark")).distinct().orderBy("mark").limit(texts)
    last = marks.agg(F.max("mark").alias("last")).first().last
    sample = docs.where(F.col("text").isNotNull() & (mark <= F.lit(last)) if last is not None else F.lit(False))
    least = sample.select(F.explode(F.split("text", r"\n+")).alias("line")).distinct().orderBy(F.md5("line"), "line").limit(paragraphs * 4)
    lines = [r.line for r in least.collect()]
    known = [tokens(t) for ts in TEMPLATES.values() for t in ts]
    negative = [w for w in map(tokens, lines) if w and max(pair_share(w, t) for t in known) < CONFIRM / 2][:paragraphs]
    families = [*TEMPLATES, UNKNOWN]
    rows = examples() + [(w, UNKNOWN) for w in negative + [tokens(t) for t in NEAR_MISSES] * 5]
    place = {g: i for i, g in enumerate(sorted({g for w, f in rows if f != UNKNOWN for g in ngrams(w) if content(g)} - {g for g in ngrams(["copyright", "c", "2020", "the", "authors"])} - {g for g in ngrams(["see", "the", "file", "for", "details"])}))}
    has = [np.array(sorted(place[g] for g in ngrams(w) if g in place), dtype=np.int64) for w, _ in rows]
    y = np.array([families.index(f) for _, f in rows])
    fold = np.arange(len(rows)) % 4 == 3
    train, check = np.flatnonzero(~fold), np.flatnonzero(fold)
    weights, base = fit(has, y, train, len(place), len(families))
    z = np.array([base + weights[has[i]].sum(axis=0) for i in check])
    scale = [0.25 * 1.25**k for k in range(14)]
    temperature = min(scale, key=lambda t: float(-log_softmax(z / t)[np.arange(len(check)), y[check]].mean()))
    # the least bound that is right most often on the part that the calibration did not fit
    p = np.exp(log_softmax(z / temperature))
    best = lambda bound: int((np.where(p.max(axis=1) >= bound, p.argmax(axis=1), len(families) - 1) == y[check]).sum())
    sure = max((0.2, 0.3, 0.4, 0.5, 0.6), key=lambda b: (best(b), -b))
    weights, base = fit(has, y, np.arange(len(rows)), len(place), len(families))
    whole = np.rint(weights * 1000).astype(int)
    return Model(families, {g: whole[i].tolist() for g, i in place.items() if whole[i].any()}, np.rint(base * 1000).astype(int).tolist(), temperature, sure)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def fit(has: list[np.ndarray], y: np.ndarray, rows: np.ndarray, n: int, k: int, rounds: int = 250, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(has[i]) for i in rows])
    row, col = np.repeat(np.arange(len(rows)), size), np.concatenate([has[i] for i in rows])
    share = np.bincount(y[rows], minlength=k)
    importance = (1 / np.maximum(share, 1))[y[rows]] ** 0.5
    importance /= importance.sum()
    w = np.zeros((n + 1, k))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.tile(w[n], (len(rows), 1))
        np.add.at(z, row, w[col])
        g = np.exp(log_softmax(z))
        g[np.arange(len(rows)), y[rows]] -= 1
        g *= importance[:, None]
        grad = np.zeros_like(w)
        np.add.at(grad, col, g[row])
        grad[n] = g.sum(axis=0)
        grad[:n] += ridge * w[:n]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:n], w[n]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORDS), lambda w: w != "")


def grams_of(words: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct n-grams: each size joins the one before it with the words that follow, in one sweep."""
    rest = lambda x, at, n: F.slice(x, at, F.greatest(F.size(words) - n + 1, F.lit(0)))
    found, out = words, []
    for n in range(1, max(sizes) + 1):
        if n > 1:
            found = F.zip_with(rest(found, 1, n), rest(words, n, n), lambda a, b: F.concat_ws(" ", a, b))
        if n in sizes:
            out.append(found)
    return F.array_distinct(F.concat(*out))


def pairs_of(words: Column) -> Column:
    """The word pairs, or the only word."""
    return F.when(F.size(words) > 1, grams_of(words, (2,))).otherwise(words)


def weight_table(spark: SparkSession, model: Model) -> DataFrame:
    """gram, w: one row a feature; bounded by the templates."""
    rows = ";".join(f"{g}={','.join(map(str, w))}" for g, w in model.weights.items())
    row = spark.range(1).select(F.explode(F.split(F.lit(rows), ";")).alias("r")).select(F.split("r", "=").alias("r"))
    return row.select(F.col("r")[0].alias("gram"), F.split(F.col("r")[1], ",").cast("array<int>").alias("w"))


def template_table(spark: SparkSession) -> DataFrame:
    """family, pairs: each template's word pairs and words; bounded by the templates."""
    rows = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(" ".join(tokens(t))).alias("t")) for f, ts in TEMPLATES.items() for t in ts))
    row = spark.range(1).select(F.explode(rows).alias("r")).select(F.col("r.family").alias("family"), F.split("r.t", " ").alias("words"))
    return row.select("family", grams_of(F.col("words"), (1, 2)).alias("pairs"))


def classify(paragraphs: DataFrame, model: Model, confirm: float = CONFIRM) -> DataFrame:
    """paragraph, family, probability, similarity for each distinct paragraph that is not unknown."""
    spark, k = paragraphs.sparkSession, len(model.families)
    distinct = paragraphs.select("paragraph").distinct().withColumn("words", words_of(F.col("paragraph")))
    grams = distinct.select("paragraph", F.explode(grams_of(F.col("words"), tuple(range(1, LONGEST + 1)))).alias("gram"))
    met = grams.join(F.broadcast(weight_table(spark, model)), "gram")
    sums = met.groupBy("paragraph").agg(*(F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(k)))
    z = [(F.col(f"z{i}") + model.intercepts[i]) / (1000.0 * model.temperature) for i in range(k)]
    top = F.greatest(*z)
    total = sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
    family = F.coalesce(*(F.when(x == top, F.lit(f)) for x, f in zip(z, model.families)))
    scored = sums.select("paragraph", family.alias("family"), (1 / total).alias("probability")).where((F.col("family") != UNKNOWN) & (F.col("probability") >= model.sure))
    mine = scored.withColumn("words", words_of(F.col("paragraph"))).withColumn("mine", pairs_of(F.col("words")))
    pairs = mine.join(F.broadcast(template_table(spark)), "family")
    close = pairs.groupBy("paragraph", "family", "probability").agg(F.max(F.size(F.array_intersect("mine", "pairs")) / F.size("mine")).alias("similarity"))
    return close.where(F.col("similarity") >= confirm)


def paragraphs_of(docs: DataFrame, model: Model, confirm: float = CONFIRM) -> DataFrame:
    """doc_id, text_key, paragraph: those that a template could confirm.

    Such a paragraph has a content word of the templates, and `confirm` of its word pairs are in
    some template; all others would be unknown.
    """
    able = sorted({w for ts in TEMPLATES.values() for t in ts for w in tokens(t) if w not in FUNCTION_WORDS})
    known = sorted({p for ts in TEMPLATES.values() for t in ts for p in [*ngrams(tokens(t), 2)]})
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(F.split("text", r"\n+")).alias("paragraph"))
    rows = rows.withColumn("words", F.split(F.lower("paragraph"), WORDS)).where(F.exists("words", lambda w: w.isin(able)))
    # so many known pairs need as many known words; this is cheaper to see
    vocabulary = sorted({"", *(w for ts in TEMPLATES.values() for t in ts for w in tokens(t))})
    rows = rows.where(F.size(F.filter("words", lambda w: w.isin(vocabulary))) >= confirm * (F.size("words") - 1) - 2)
    rows = rows.withColumn("words", F.filter("words", lambda w: w != "")).withColumn("mine", pairs_of(F.col("words")))
    share = F.size(F.array_intersect("mine", F.array(*map(F.lit, known)))) / F.size("mine")
    return rows.where(share >= confirm).select("doc_id", "text_key", "paragraph")


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_paragraphs, n_licensed (paragraphs with a confirmed family), families
    (sorted, comma-joined, empty if none), licensed, and probability (the calibrated one of its least sure licensed
    paragraph, null if none).

    A null or empty text has no paragraphs. Rows that repeat a doc_id and text are one document and get equal
    rows. Columns of docs but doc_id and text are not read.
    """
    model = model or learn(docs)
    found = settled(paragraphs_of(docs, model))
    known = classify(found, model)
    # equal paragraphs of a document are counted together before they meet their family
    counted = found.groupBy("doc_id", "text_key", "paragraph").agg(F.count("*").alias("n"))
    # one common paragraph may be in a third of all documents: it meets its family in SALTS places
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    families = known.select("paragraph", "family", "probability", salts.alias("salt"))
    salted = counted.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int"))
    each = salted.join(families, ["paragraph", "salt"]).groupBy("doc_id", "text_key").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.min("probability").alias("probability"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.when(F.length("text") > 0, F.size(F.filter(F.split("text", r"\n+"), lambda p: p != ""))).otherwise(0).cast("long").alias("n_paragraphs"))
    # rows that repeat a document were counted once for each
    copies = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"))
    each = each.join(copies, each.doc_id.eqNullSafe(copies.doc_id) & (each.text_key == copies.text_key)).select(each.doc_id.alias("d"), each.text_key.alias("t"), (F.col("n") / F.col("copies")).cast("long").alias("n"), "families", "probability")
    joined = rows.join(each, rows.doc_id.eqNullSafe(F.col("d")) & (rows.text_key == F.col("t")), "left")
    return joined.select("doc_id", "n_paragraphs", F.coalesce("n", F.lit(0)).alias("n_licensed"), F.coalesce("families", F.lit("")).alias("families"), F.col("n").isNotNull().alias("licensed"), F.round("probability", 4).alias("probability"))


def brute_force(text: str | None, model: Model, confirm: float = CONFIRM) -> tuple[int, int, str]:
    """n_paragraphs, n_licensed and families of one text in plain Python; for tests."""
    paragraphs = [p for p in re.split(r"\n+", text or "") if p]
    families = []
    for p in paragraphs:
        words = tokens(p)
        met = [model.weights[g] for g in ngrams(words) if g in model.weights]
        if not met:
            continue
        z = [sum(c) + b for c, b in zip(zip(*met), model.intercepts)]
        family = model.families[max(range(len(z)), key=lambda i: (z[i], -i))]
        probability = 1 / sum(math.exp((x - max(z)) / (1000.0 * model.temperature)) for x in z)
        if probability >= model.sure and family != UNKNOWN and max(pair_share(words, tokens(t)) for t in TEMPLATES[family]) >= confirm:
            families.append(family)
    return len(paragraphs), len(families), ",".join(sorted(set(families)))


def unknown_by_intercepts(model: Model) -> bool:
    """Whether a paragraph without features is unknown, as the scan's filter takes for granted."""
    return max(model.intercepts) == model.intercepts[-1] and math.isfinite(model.temperature)
